import random
import re

import pytest

from parley.llm import ngram_join as J


def grams(text, n=3):
    w = [x for x in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, t=0.5):
    """Pairs of the full join, by comparing everything with everything."""
    sets = {}
    for i, text in rows:
        if i is not None and grams(text):
            sets.setdefault(i, []).append(grams(text))
    ids, out = sorted(sets), set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(len(p & q) >= t * len(p | q) - 1e-9 for p in sets[a] for q in sets[b]):
                out.add((a, b))
    return out


def expanded(rows):
    """All pairs that rows of representatives stand for."""
    rep = {r["b"]: r["a"] for r in rows if r["common"] == r["total"]}
    members = {}
    for b, a in rep.items():
        members.setdefault(a, {a}).add(b)
    of = lambda i: members.get(i, {i})
    out = {tuple(sorted((x, y))) for m in members.values() for x in m for y in m if x != y}
    for r in rows:
        if r["b"] not in rep:
            out |= {tuple(sorted((x, y))) for x in of(r["a"]) for y in of(r["b"]) if x != y}
    return out


def corpus(seed, n_base=25, long=False):
    """Texts with copies changed to all degrees, over words with very frequent ones among them."""
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(6)], [f"w{i}" for i in range(4000)]
    word = lambda: r.choice(common) if r.random() < 0.7 else r.choice(rare)
    rows, i = [], 0
    for _ in range(n_base):
        base = [word() for _ in range(r.choice([1, 2, 3, 5, 20, 60, 150] if not long else [200, 400, 900]))]
        for share in (0, 0, 0.01, 0.03, 0.06, 0.1, 0.2):
            rows.append((i, " ".join(w if r.random() >= share else word() for w in base)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, long", [(1, False), (2, False), (3, True)])
def test_pairs_are_brute_force(docs_of, seed, long):
    rows = corpus(seed, 12 if long else 25, long)
    got = J.similar_pairs(docs_of(rows)).collect()
    assert expanded(got) == brute(rows)
    text = dict(rows)
    for r in got:
        a, b = grams(text[r["a"]]), grams(text[r["b"]])
        assert (r["common"], r["total"]) == (len(a & b), len(a | b))


@pytest.mark.parametrize("threshold, n", [(0.7, 3), (0.9, 1), (0.3, 2)])
def test_other_thresholds(docs_of, threshold, n):
    rows = corpus(9, 10)
    got = {(r["a"], r["b"]) for r in J.similar_pairs(docs_of(rows), n=n, threshold=threshold, broadcast_bytes=0).collect() if r["common"] < r["total"]}
    sets = {i: grams(t, n) for i, t in rows}
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    reps = sorted(least.values())
    want = {(a, b) for x, a in enumerate(reps) for b in reps[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert got == want


def linked(rows, t=0.5):
    """(doc_id, group_id, links) of rows by comparing everything with everything; each row is a document."""
    rows = [(i, x) for i, x in rows if i is not None and grams(x)]
    sets = [grams(x) for _, x in rows]
    near = [[b for b, q in enumerate(sets) if a != b and len(p & q) >= t * len(p | q) - 1e-9] for a, p in enumerate(sets)]
    out = []
    for a in range(len(rows)):
        if near[a]:
            seen, todo = {a}, [a]
            while todo:
                for b in near[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            out.append((rows[a][0], min(rows[b][0] for b in seen), len(near[a])))
    return sorted(out)


def kept(rows):
    """How many rows stay: one of each group, and all that are similar to nothing."""
    sets = [(i, grams(x)) for i, x in rows if i is not None and grams(x)]
    root = list(range(len(sets)))
    for a, (_, p) in enumerate(sets):
        for b in range(a):
            if 2 * len(p & sets[b][1]) >= len(p | sets[b][1]):
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    return len(rows) - len(sets) + len(set(root))


ODD_LONG = " ".join(f"w{i % 7000}" for i in range(60_000))
ODD = [(1, "a b c d e"), (2, "A, b; C d e"), (3, None), (4, ""), (5, "!!! ..."), (None, "a b c d e"), (6, "x"), (7, "x"), (8, ODD_LONG), (9, ODD_LONG + " tail end"), (10, "nothing like these at all")]


def test_odd_rows(docs_of):
    docs = docs_of(ODD)
    assert sorted(map(tuple, J.similar_documents(docs).collect())) == linked(ODD) == [(1, 1, 1), (2, 1, 1), (6, 6, 1), (7, 6, 1), (8, 8, 1), (9, 8, 1)]
    kept = J.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 4, 5, 6, 8, 10, None]


def test_empty_tables(docs_of):
    for rows in ([], [(1, None)]):
        docs = docs_of(rows)
        assert J.similar_documents(docs).collect() == [] and J.similar_pairs(docs).collect() == [] and J.drop_similar(docs).count() == len(rows)


def test_rows_that_repeat_ids(docs_of):
    """Each row is settled by its own text."""
    base, other = "one two three four five six seven eight", "red green blue black white grey brown pink"
    r = random.Random(5)
    drawn = [(r.randrange(20, 26), t if t is None or r.random() < 0.8 else t + " more") for t in ("the first text of them all is here", "quite another text stands there now", "and a third one with other words in it", None) for _ in range(6)]
    rows = [(1, base), (5, base + " nine"), (5, other), (5, None), (7, base), (7, base), (8, other.upper()), *drawn]
    docs = docs_of(rows)
    assert sorted(map(tuple, J.similar_documents(docs).collect())) == linked(rows)
    got = [(x["doc_id"], x["text"]) for x in J.drop_similar(docs).collect()]
    assert len(got) == kept(rows) and {(1, base), (5, other), (5, None)} <= set(got) and not {(5, base + " nine"), (7, base)} & set(got)
    assert not linked(got)


@pytest.mark.parametrize("limit, block", [(64 << 20, 16 << 20), (0, 1 << 10)])
def test_documents_are_brute_force(docs_of, limit, block):
    rows = corpus(4, 15)
    assert sorted(map(tuple, J.similar_documents(docs_of(rows), broadcast_bytes=limit, block_bytes=block).collect())) == linked(rows)


def test_hot_signatures_are_split():
    """Documents of a split signature still meet, each two of them, and no part has all of them."""
    import numpy as np

    doc = np.arange(2000, dtype=np.int64)
    sig, docs, size = J._spread(np.full(2000, 77, np.uint64), doc, np.ones(2000, np.int64), np.full(2000, 2000), 250)
    parts = {}
    for s, d in zip(sig.tolist(), docs.tolist()):
        parts.setdefault(s, []).append(d)
    assert max(map(len, parts.values())) < 700
    met = np.zeros((2000, 2000), bool)
    for m in parts.values():
        met[np.ix_(m, m)] = True
    assert met.all()


def test_pairs_are_told_in_parts(spark):
    """What a bucket tells in parts adds up to what it tells at once."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, " ".join(f"w{(j * 7 + i % 5) % 40}" for j in range(60))) for i in range(60)], "doc_id bigint, text string")
    sent = spark.sparkContext.broadcast(b"\1\0\0\0" * (1 << J.SKETCH_BITS))
    blobs = d.mapInArrow(J._signatures(3, 0.5, 2, sent), "bucket int, blob binary")
    told = lambda hold: blobs.groupBy("bucket").applyInArrow(J._pairs(0.5, hold), "a bigint, b bigint, n int, least int")
    whole, parts = told(10**9), told(50)
    add = lambda x: sorted(map(tuple, x.groupBy("a", "b").agg(F.sum("n"), F.min("least")).collect()))
    assert add(whole) == add(parts) != [] and parts.count() >= whole.count()


def test_a_long_chain_is_one_group(spark):
    n = 200
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r["doc_id"]: r["keeper_id"] for r in J.groups(pairs).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_extended_prefixes_hold_enough():
    for t in (0.3, 0.5, 0.8, 0.9):
        long = J.long_from(t)
        for n in range(long, long + 500):
            assert J.need(n, t) >= J.shared(n, t) + J.GROUPS


def near_copies(m, seed=3):
    """m different texts, nearly all of them similar to each other, and some that are similar to nothing."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(w if r.random() > 0.06 else f"x{r.randrange(300)}" for w in base)) for i in range(m)]
    return rows + [(m + i, " ".join(f"y{r.randrange(5000)}" for _ in range(50))) for i in range(5)]


@pytest.mark.parametrize("block", [16 << 20, 1 << 16])
def test_pairs_of_a_family_are_not_told(docs_of, block):
    """Links of a group of near copies are counted without a row for each pair, also where the group falls into parts."""
    rows = near_copies(200)
    want = linked(rows)
    assert len(want) > 190 and sum(x[2] for x in want) > 10 * len(rows)
    assert sorted(map(tuple, J.similar_documents(docs_of(rows), block_bytes=block).collect())) == want
    pairs, _, cells = J._similar(docs_of(rows).select("doc_id", "text"), 3, 0.5, 64 << 20, block, True)
    assert pairs.count() < len(rows)
    assert len({(r["a"], r["b"]) for r in cells.collect()}) < 40 * len(rows)


def test_rows_of_a_family_are_brute_force():
    import numpy as np

    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 40, 80)
    sets = [np.unique(np.concatenate([base[r.random(80) < r.uniform(0.5, 1)], r.integers(0, 60, 15), r.integers(1 << 41, 1 << 45, 9)])).astype(np.uint64) for _ in range(120)]
    for na, first in ((120, 0), (50, 50)):
        ok = J._similar_rows(sets, 0.5, na, first)
        want = np.array([[i != j + first and 2 * len(np.intersect1d(sets[i], sets[j + first])) >= len(np.union1d(sets[i], sets[j + first])) for j in range(120 - first)] for i in range(na)])
        assert (ok == want).all() and 0 < want.mean() < 1
    chain = np.zeros((40, 40), bool)
    chain[np.arange(39), np.arange(1, 40)] = chain[np.arange(1, 40), np.arange(39)] = True
    chain[20, 21] = chain[21, 20] = False
    assert J._reached(chain, 40, 0).tolist() == [0] * 21 + [21] * 19


def test_near_copies_are_dropped_by_few_edges(docs_of, monkeypatch):
    """What is grouped of m near copies is about a row for each, not for each pair."""
    rows, groups, seen = near_copies(150, 8), J.groups, []

    def counted(pairs):
        seen.append(pairs.count())
        return groups(pairs)

    monkeypatch.setattr(J, "groups", counted)
    assert J.drop_similar(docs_of(rows)).count() == kept(rows) < 20
    assert seen[-1] < 2 * len(rows)


def test_a_family_of_many_short_texts_falls_into_parts(docs_of, monkeypatch):
    """The matrix of a family's pairs is bounded by the number of its texts too, which may be many where they are short."""
    rows, families = near_copies(150, 5), J._families

    def bounded(n, t):
        run = families(n, t)

        def checked(table):
            assert table.num_rows <= 80, table.num_rows  # two parts of 20 by hash, with room
            return run(table)

        return checked

    monkeypatch.setattr(J, "PART_ROWS", 20, raising=False)
    monkeypatch.setattr(J, "_families", bounded)
    assert sorted(map(tuple, J.similar_documents(docs_of(rows)).collect())) == linked(rows)


def test_broadcasts_leave_room_in_the_driver():
    """A hash table takes the driver several times its estimated size while it is made, whatever the corpus' size."""
    from inspect import signature

    from parley.llm import common, exact_dedup, url_filter

    for f in (J.drop_similar, J.similar_documents, J.similar_pairs, exact_dedup.drop_duplicates, exact_dedup.exact_duplicates, url_filter.listed):
        assert signature(f).parameters["broadcast_bytes"].default <= common.BROADCAST_BYTES <= 16 << 20
