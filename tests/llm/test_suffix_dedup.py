import random

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import kernel as K
from parley.llm import suffix_dedup as P


def brute(rows, length):
    """Maximal spans of windows that occur twice or more, by a dictionary of all windows."""
    import re

    places = {}
    for r, (i, t) in enumerate(rows):
        if i is None or t is None:
            continue
        w = [x for x in re.split(r"[ \t\n\r\f\v]+", t) if x]
        for s in range(len(w) - length + 1):
            places.setdefault(tuple(w[s : s + length]), []).append((i, s))
    hit = {p for g in places.values() if len(g) > 1 for p in g}
    out = set()
    for i, s in hit:
        if (i, s - 1) not in hit:
            e = s
            while (i, e + 1) in hit:
                e += 1
            out.add((i, s, e + length))
    return out


def spans(docs, **options):
    rows = [tuple(r) for r in P.repeated_passages(docs, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=60, vocabulary=3000):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    shared = [[word() for _ in range(r.randrange(8, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(shared)
            a = r.randrange(len(p) // 2)
            at = r.randrange(len(w) + 1)
            w[at:at] = p[a : a + r.randrange(1, len(p))]
        rows.append((i, (" " if r.random() < 0.9 else "\n\t ").join(w)))
    return rows


@pytest.mark.parametrize("seed, vocabulary, length, gram", [(1, 3000, 10, 4), (2, 3000, 20, 8), (3, 4, 10, 10), (4, 2, 12, 3), (5, 3000, 50, 16), (6, 1, 10, 4), (7, 3000, 1, 1)])
def test_spans_are_brute_force(docs_of, seed, vocabulary, length, gram):
    rows = corpus(seed, vocabulary=vocabulary)
    assert spans(docs_of(rows), length=length, gram=gram) == brute(rows, length)


def test_a_tiny_filter_changes_nothing(docs_of):
    rows = corpus(8)
    assert spans(docs_of(rows), length=10, gram=4, filter_bytes=64) == brute(rows, 10)


def test_production_parameters_and_odd_rows(docs_of, english):
    p = english(1, 70)
    long = english(2, 40_000)
    rows = [(1, f"{english(3, 30)} {p} {english(4, 9)}"), (2, f"{p} {english(5, 200)}"), (3, english(6, 300)), (4, None), (5, ""), (6, " ".join(p.split()[:49])), (None, p), (7, f"{long} {p}"), (8, "again " * 120), (9, " ".join(p.split()[5:56]))]
    got = spans(docs_of(rows))
    assert got == brute(rows, P.LENGTH) and {i for i, *_ in got} == {1, 2, 7, 8, 9}
    assert P.repeated_passages(docs_of([])).collect() == [] and P.repeated_passages(docs_of([(1, None), (2, "few words")])).collect() == []
    with pytest.raises(ValueError):
        P.repeated_passages(docs_of([]), length=5, gram=6)


def test_rows_that_repeat_an_id(docs_of, english):
    t = english(1, 60)
    assert spans(docs_of([(1, t), (1, t)])) == {(1, 0, 60)}


@pytest.mark.parametrize("seed", range(4))
def test_sorting_is_python_s(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 3, 300)
    texts = pa.array([" ".join(f"w{x}" for x in ids)])
    (_, _, words), = K.tokenised(texts)
    group = np.sort(rng.integers(0, 5, 200))
    at = rng.permutation(300)[:200]
    end = np.minimum(at + rng.integers(1, 60, 200), 300)
    order = P.Suffixes(ids, words.prefix(), at, end).sort(group, 50)
    key = lambda i: (group[i], ids[at[i] : min(end[i], at[i] + 50)].tolist(), i)
    assert order.tolist() == sorted(range(200), key=key)


def test_common_extensions_are_naive():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 2, 500)
    (_, _, words), = K.tokenised(pa.array([" ".join(f"w{x}" for x in ids)]))
    at = rng.integers(0, 499, 100)
    s = P.Suffixes(ids, words.prefix(), at, np.full(100, 500))
    x, y = rng.integers(0, 100, 200), rng.integers(0, 100, 200)
    for a, b, n in zip(at[x], at[y], s.extension(x, y, 50)):
        m = 0
        while m < 50 and max(a, b) + m < 500 and ids[a + m] == ids[b + m]:
            m += 1
        assert n == m


def test_colliding_hashes_are_verified(docs_of, monkeypatch):
    """With hashes that keep next to nothing of a word, only the comparison of words keeps false repeats out."""
    import re

    r = random.Random(4)
    meta_rows = [(i, " ".join(f"w{r.randrange(5)}" for _ in range(12))) for i in range(40)]
    raw = np.frombuffer("".join(t for _, t in meta_rows).encode(), np.uint8)
    kind = P._KIND
    m = np.zeros(40, kind)
    m["h"], m["doc"], m["starts"], m["words"], m["before"] = 1, range(40), 3, 12, 2
    m["size"] = [len(t) for _, t in meta_rows]
    monkeypatch.setattr(K, "mix", lambda x: x & np.uint64(0))
    seg, step = P.repeats(m, raw, 10)
    windows = {}
    for i, t in meta_rows:
        w = re.split(" ", t)
        for s in range(3):
            windows.setdefault((s, tuple(w[s : s + 10])), []).append(i)
    true = {(i, s) for (s, _), g in windows.items() if len(g) > 1 for i in g}
    assert set(zip(seg.tolist(), step.tolist())) <= true


def test_a_passage_that_all_texts_share(docs_of, spark):
    """Equal segments are sent once by each task, and anchors that are too frequent are compared window by window."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join([*[word() for _ in range(r.randrange(20))], *passage[r.randrange(3) :], *[word() for _ in range(r.randrange(20))]])) for i in range(150)]
    want = brute(rows, 12)
    docs = docs_of(rows).coalesce(2)
    assert spans(docs, length=12, gram=5) == want
    sent = spark.sparkContext.broadcast(b"\xff" * (64 * 2))
    packed = docs.select("doc_id", "text").mapInArrow(P._segments(12, 5, 4, 10, sent, 1 << 30), P._PACKED_SQL)
    for part_bytes in (1 << 20, 50):
        out = packed.groupBy("bucket").applyInArrow(P._sorted_bucket(12, part_bytes), "doc_id bigint, start_word int, end_word int").collect()
        got = {(x["doc_id"], s) for x in out for s in range(x["start_word"], x["end_word"] - 11)}
        assert got == {(i, s) for i, a, e in want for s in range(a, e - 11)}
    texts = b"".join(bytes(x["text"]) for x in packed.select("text").collect())
    assert texts.count(" ".join(passage[10:24]).encode()) < 40


def test_spans_that_touch_are_one():
    s = np.array([(1, 0, 3), (1, 3, 4), (2, 4, 5), (1, 9, 12), (1, 5, 20), (3, 1, 2), (2, 6, 7), (-1, 0, 1)], P._SPAN)
    assert P._merged(s).tolist() == [(-1, 0, 1), (1, 0, 4), (1, 5, 20), (2, 4, 5), (2, 6, 7), (3, 1, 2)]
