import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import exact_dedup as D

U64 = np.uint64


def keys_of(values):
    v = np.array(values, U64).reshape(-1)
    return np.stack([v * U64(0x9E3779B97F4A7C15), v + U64(5)], axis=1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("id"), st.lists(st.integers(0, 30), max_size=8)), max_size=12))
def test_index_is_a_counter(steps):
    index, model = D.CuckooIndex(8), {}
    for kind, values in steps:
        if kind == "i":
            fresh = index.insert(keys_of(values), np.array(values, np.int64))
            assert fresh.sum() == len({v for v in values if not model.get(v)})
            for v in values:
                model[v] = model.get(v, 0) + 1
        else:
            want = []
            for v in values:
                want.append(model.get(v, 0) > 0)
                model[v] = max(model.get(v, 0) - 1, 0)
            assert index.delete(keys_of(values)).tolist() == want
    assert ((index.find(keys_of(range(31))) >= 0) == [model.get(v, 0) > 0 for v in range(31)]).all()
    assert len(index) == sum(n > 0 for n in model.values())


def test_overflow_resizes_from_stored_keys():
    index = D.CuckooIndex(8)
    values = np.arange(20_000)
    for part in np.split(values, 20):
        index.insert(keys_of(part), part)
    assert index.resizes > 3 and (index.find(keys_of(values)) >= 0).all()
    assert (index.find(keys_of(values + 10**6)) < 0).all()
    gone = values[::3]
    assert index.delete(keys_of(gone)).all() and (index.find(keys_of(gone)) < 0).all()
    assert (index.find(keys_of(np.setdiff1d(values, gone))) >= 0).all() and len(index) == 20_000 - len(gone)
    k, payload, count = index.live()
    assert len(k) == len(index) and set(payload) == set(np.setdiff1d(values, gone)) and (count == 1).all()


def test_equal_fingerprints_and_buckets_are_told_apart():
    """Keys that the filter can't tell apart are verified against what is stored."""
    index = D.CuckooIndex(8)
    many = keys_of(range(40_000))
    index.insert(many[:20], np.arange(20))
    assert (index.find(many[20:]) == -1).all()


CASES = [(5, "same"), (3, "same"), (9, "same"), (1, "alone"), (2, ""), (4, ""), (6, None), (7, None), (None, "same"), (8, "Same"), (10, "x" * 300_000), (11, "x" * 300_000), (12, "x" * 299_999 + "y")]


def brute(rows):
    by = {}
    for i, t in rows:
        if i is not None and t is not None:
            by.setdefault(t, []).append(i)
    return sorted((i, min(g), len(g)) for g in by.values() if len(g) > 1 for i in g)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_duplicates_are_brute_force(docs_of, limit):
    got = sorted(map(tuple, D.exact_duplicates(docs_of(CASES), broadcast_bytes=limit).collect()))
    assert got == brute(CASES)


def kept_by_brute_force(rows):
    """Rows that stay: of equal texts one with the least id, and all without id or text."""
    out, seen = [], set()
    least = {}
    for i, t in rows:
        if i is not None and t is not None:
            least[t] = min(i, least.get(t, i))
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
        elif i == least[t] and t not in seen:
            seen.add(t)
            out.append((i, t))
    return sorted(out, key=repr)


REPEATED = [
    [(1, "a"), (1, "a"), (2, "b"), (2, "a"), (3, "b")],
    [(1, "A"), (5, "A"), (5, "B"), (7, "C")],
    [(1, "A"), (5, "A"), (5, None), (7, "C")],
    [(5, None), (5, None), (5, ""), (4, ""), (4, ""), (None, ""), (None, "")],
]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_repeated_rows_and_repeated_ids(docs_of, limit):
    r = random.Random(7)
    drawn = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, "", "a", "b", "c", "d"])) for _ in range(40)]
    rows = [(i and i + 100 * k, t and f"{t}{k}") for k, part in enumerate([*REPEATED, drawn, drawn[:12]]) for i, t in part]
    docs = docs_of(rows)
    assert sorted(map(tuple, D.exact_duplicates(docs, limit).collect())) == sorted((i, min(g), len(g)) for g in groups_of(rows) for i in g)
    kept = D.drop_duplicates(docs, limit)
    assert kept.columns == docs.columns
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=repr) == kept_by_brute_force(rows)


def groups_of(rows):
    by = {}
    for i, t in rows:
        if i is not None and t is not None:
            by.setdefault(t, []).append(i)
    return [g for g in by.values() if len(g) > 1]


def test_a_text_that_half_of_the_rows_have(spark):
    """Each task sends a hot text's digest once, so no task gets its rows."""
    df = spark.range(0, 20_000, 1, 8).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('t', id) END AS text")
    here = D.digests(df).selectExpr("d1", "d2", "doc_id AS first_id", "1L AS refs").mapInArrow(D._counted(1, 1 << 18), D._LIVE_SQL)
    assert here.where("refs > 1").count() == 8
    got = D.exact_duplicates(df, 0).groupBy("keeper_id", "copies").count().collect()
    assert list(map(tuple, got)) == [(0, 10_000, 10_000)]
    assert D.drop_duplicates(df).count() == 10_001


def test_names_of_further_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, "x", 5), (2, "a", 3, 4, "y", 6)], "doc_id int, text string, d1 int, keeper_id int, sha string, ties int")
    assert list(map(tuple, D.drop_duplicates(df).collect())) == [(1, "a", 1, 2, "x", 5)]


def test_empty_table(docs_of):
    assert D.exact_duplicates(docs_of([])).collect() == [] and D.drop_duplicates(docs_of([])).collect() == []


def test_dropping_keeps_the_least_id_nulls_and_columns(docs_of):
    docs = docs_of(CASES)
    got = D.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 6, 7, 8, 10, 12, None]


def test_live_index_takes_insertions_and_deletions(spark):
    r = random.Random(3)
    d = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    empty = spark.createDataFrame([], "d1 bigint, d2 bigint, first_id bigint, refs bigint")
    first = [(i, f"t{r.randrange(20)}") for i in range(60)]
    index = D.apply_changes(empty, d(first), d([]))
    assert index.count() == len({t for _, t in first})
    deleted = [(i, t) for i, t in first if t in ("t1", "t2")] + [(99, "never seen")]
    after = D.apply_changes(index, d([(100, "new")]), d(deleted))
    keys = lambda rows: {tuple(x)[1:] for x in D.digests(d(rows)).collect()}
    assert {(x["d1"], x["d2"]) for x in after.collect()} == keys([x for x in first if x not in deleted] + [(100, "new")])
    one = [(i, t) for i, t in first if t == "t3"]
    fewer = {(x["d1"], x["d2"]): x["refs"] for x in D.apply_changes(index, d([]), d(one[:1])).collect()}
    (k,) = keys(one[:1])
    assert fewer.get(k, 0) == len(one) - 1
