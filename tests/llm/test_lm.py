import numpy as np
import pytest

from parley.llm import lm as L


def small(vocabulary=120, seed=1):
    m, rng = L.Model(vocabulary, seed), np.random.default_rng(seed)
    m.count(rng.integers(0, 100, vocabulary))
    m.out[:, :-1] = rng.normal(0, 0.3, (vocabulary, L.DIM))
    return m


@pytest.mark.parametrize("counts", [[0], [1], [5, 0, 31, 32, 33], [55, 56, 57, 80, 200], []])
def test_every_token_is_scored_once(counts):
    count = np.array(counts, np.int64)
    ids = np.arange(100, 100 + count.sum(), dtype=np.int32)
    w, doc, index = L.windows_of(ids, count)
    scored = []
    for row, k in zip(w, index):
        part = row[1:] if k == 0 else row[L.OVERLAP + 1 :]
        scored += part[part >= 0].tolist()
    assert sorted(scored) == ids.tolist()


def naive(m, ids):
    """A text's loss token by token, with the context of the window that scores it, over all tokens of the vocabulary."""
    seq, total = [L.BOS, *ids], 0.0
    p = {k: v.astype(float) for k, v in m.rest.items()}
    for i in range(1, len(seq)):
        k = 0 if i <= L.CONTEXT else -(-(i - L.CONTEXT) // L.STRIDE)
        ctx = np.array(seq[k * L.STRIDE : i])
        x = m.embed[ctx].astype(float) + p["place"][: len(ctx)]
        q, kk, v = x @ p["query"], x @ p["key"], x @ p["value"]
        a = np.exp(q[-1] @ kk.T / np.sqrt(L.DIM))
        h = x[-1] + (a / a.sum()) @ v @ p["mixed"]
        z = h @ p["head"][:-1] + p["head"][-1]
        u = m.out[:, :-1].astype(float) @ h + m.out[:, -1]
        log_p = np.empty(len(m.embed))
        for c in range(L.CLASSES):
            e, f = m.edge[c], m.edge[c + 1]
            log_p[e:f] = z[c] - np.log(np.exp(z).sum()) + u[e:f] - np.log(np.exp(u[e:f]).sum()) if f > e else 0
        total -= log_p[m.order[seq[i]]]
    return total


def test_batched_masked_attention_is_token_by_token():
    m, rng = small(), np.random.default_rng(2)
    count = np.array([0, 1, 20, 32, 33, 57, 130])
    ids = rng.integers(2, 50, count.sum()).astype(np.int32)
    got = L.score_flat(m, ids, count, batch=3)
    for loss, part in zip(got, np.split(ids, np.cumsum(count)[:-1])):
        assert loss == pytest.approx(naive(m, part.tolist()), rel=1e-4, abs=1e-4)


def test_probabilities_sum_to_one():
    for vocabulary in (30, 120, 1000):  # with fewer ids than classes some classes are empty
        m = small(vocabulary)
        w = np.tile(np.append(np.arange(L.CONTEXT) % vocabulary, 0), (vocabulary, 1))
        w[:, -1] = np.arange(vocabulary)
        assert np.exp(-m.nll(w, L.CONTEXT - 1)[:, 0].astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_are_differences():
    """One step of training against numerical gradients of the mean loss."""
    m, rng = small(), np.random.default_rng(3)
    w = rng.integers(2, 120, (4, L.CONTEXT + 1))
    loss = lambda: float(m.nll(w, 0).mean())
    old = L.Model.load(m.dump())
    m.train(w, 1e-3, batch=4)
    of = lambda x, name: {"embed": x.embed, "out": x.out}.get(name) if name in ("embed", "out") else x.rest[name]
    for name in ("head", "query", "key", "value", "mixed", "place", "embed", "out"):
        moved = of(m, name) - of(old, name)
        probe = L.Model.load(old.dump())
        # Adagrad's first step is the rate times g / sqrt(g * g + 1e-4), from which the gradient follows
        step = -moved / 1e-3
        g = step / np.sqrt(np.maximum(1 - step**2, 1e-9)) * 1e-2
        for at in map(tuple, np.argwhere(np.abs(g) > 0)[np.random.default_rng(1).permutation((np.abs(g) > 0).sum())[:6]]):
            value = of(probe, name)[at]
            both = []
            for d in (2e-2, -2e-2):
                of(probe, name)[at] = value + np.float32(d)
                both.append(float(probe.nll(w, 0).astype(np.float64).mean()))
            of(probe, name)[at] = value
            assert (both[0] - both[1]) / 4e-2 == pytest.approx(g[at], rel=0.1, abs=2e-4), (name, at)
    assert loss() < float(old.nll(w, 0).mean())


def test_future_tokens_do_not_matter():
    m, rng = small(), np.random.default_rng(4)
    a = rng.integers(2, 50, (1, L.CONTEXT + 1))
    b = a.copy()
    b[0, 20:] = rng.integers(2, 50, L.CONTEXT + 1 - 20)
    assert np.allclose(m.nll(a, 0)[0, :19], m.nll(b, 0)[0, :19], atol=1e-5)


def test_training_learns_the_corpus(docs_of, english):
    import random

    r = random.Random(1)
    usual = [(i, english(i % 40, 120)) for i in range(150)]
    junk = [(1000 + i, "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(100))) for i in range(5)]
    got = {x["doc_id"]: x["mean_nll"] for x in L.score(docs_of(usual + junk)).collect()}
    assert max(got[i] for i, _ in usual) < min(got[i] for i, _ in junk)


@pytest.fixture(scope="module")
def encoded(docs_of, english):
    """Documents, and what is gathered from them."""
    from parley.llm import common, pieces

    docs = docs_of([(i, english(i % 60, 200)) for i in range(240)] + [(1000, None), (1001, ""), (1002, "one"), (1003, english(5, 9) * 40)])
    return docs, common.materialise(docs.select("doc_id", "text").mapInArrow(L._gather(pieces.MODEL), L._KINDS_SQL), "t", "kind"), pieces.Vocabulary.of(pieces.MODEL)


def test_training_beats_counts_alone(encoded, english):
    """Held-out texts are likelier under the trained model than under the token counts it starts from."""
    _, corpus, v = encoded
    trained, start = L.fit(corpus, v.size), L.fit(corpus, v.size, 0)
    ids = np.array(v.library.encode(english(1000, 400)), np.int32)
    one = np.array([len(ids)])
    assert L.score_flat(trained, ids, one)[0] < L.score_flat(start, ids, one)[0] - 0.1 * len(ids)


def test_whole_query_is_token_by_token(encoded):
    """The query's rows are those of the plain model over the library's ids, token by token."""
    docs, corpus, v = encoded
    m = L.fit(corpus, v.size)
    got = {r["doc_id"]: (r["n_tokens"], r["mean_nll"]) for r in L.score(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    for i in (*range(0, 240, 80), 1000, 1001, 1002, 1003):
        ids = v.library.encode(texts[i] or "")
        assert got[i][0] == len(ids) and (got[i][1] is None) == (not ids)
        if ids:
            assert got[i][1] == pytest.approx(naive(m, ids) / len(ids), abs=2e-3)


def test_odd_rows(docs_of):
    rows = [(1, "some words here"), (1, "some words here"), (2, None), (3, ""), (None, "some words here"), (4, "long text " * 20_000)]
    got = L.score(docs_of(rows)).collect()
    assert len(got) == 6
    assert {(r["n_tokens"], r["mean_nll"]) for r in got if r["doc_id"] in (2, 3)} == {(0, None)}
    assert len({r["mean_nll"] for r in got if r["doc_id"] in (1, None)}) == 1
    assert L.score(docs_of([])).collect() == []


def test_all_tokens_are_trained_on():
    """Pieces hold each token of each document once as a target, after the token before it."""
    import pyarrow as pa

    count = np.array([0, 1, 31, 32, 33, 56, 57, 2047, 2048, 2049, 4097, 10_000])
    ids = np.random.default_rng(6).integers(2, 30_000, count.sum()).astype(np.int32)
    docs = [x.astype("<u2").tobytes() for x in np.split(ids, np.cumsum(count)[:-1])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.binary())], names=["doc_id", "data"])
    cut = [x for b in L._pieces("<u2")([batch]) for x in b.column(2).to_pylist()]
    w = L._windows(cut, "<u2", 1)
    got = [(a, b) for row in w.tolist() for a, b in zip(row, row[1:]) if b >= 0]
    want = [(a, b) for x in np.split(ids, np.cumsum(count)[:-1]) for a, b in zip([L.BOS, *x.tolist()], x.tolist())]
    assert sorted(got) == sorted(want)


def test_small_tables_are_trained_on(docs_of, english):
    """As the query is, a table of a few windows makes its documents likelier than counts and random weights do."""
    docs = docs_of([(i, english(i, 60)) for i in range(6)])
    mean = lambda **o: np.mean([r["mean_nll"] for r in L.score(docs, **o).collect()])
    assert mean() < mean(rounds=0) - 0.01


@pytest.mark.parametrize("n", [0, 1, 5, 64, 1000, 1024, 5000])
def test_products_in_small_parts_are_the_products(n):
    rng = np.random.default_rng(7)
    a, b, w = L._wide(17, n), L._wide(48, n), rng.normal(size=(48, 17)).astype(np.float32)
    a[:], b[:] = rng.normal(size=a.shape), rng.normal(size=b.shape)
    assert np.allclose(L._times(w, a), w @ a, atol=1e-4)
    assert np.allclose(L._across(a, b), a @ b.T, atol=1e-2)
    columns = rng.integers(0, n, 2 * n)
    assert (L._taken(a, columns) == a[:, columns]).all()
    assert [i for r in L._steps(9507, n) for i in range(n)[r]] == list(range(n))


def test_only_scored_places_are_computed():
    """Hidden states from a place on are those of all places from there on; padding has no loss."""
    m, ids = small(), np.random.default_rng(8).integers(2, 120, (5, L.CONTEXT + 1))
    every, some = (m.attend(ids[:, :-1], first)[0] for first in (0, L.OVERLAP))
    assert some.shape == (L.DIM + 1, 5 * L.STRIDE)
    assert np.allclose(every.reshape(L.DIM + 1, 5, -1)[:, :, L.OVERLAP :], some.reshape(L.DIM + 1, 5, -1), atol=1e-5)
    target = ids[:, L.OVERLAP + 1 :].ravel().copy()
    whole = m.losses(some, target)
    target[::3] = -1
    assert np.allclose(m.losses(some, target), np.where(target < 0, 0, whole), atol=1e-5)


def test_ids_are_those_of_the_merges(english):
    """What the library gives for units, as the model's tokens are made, is what the merges of `pieces` give."""
    from parley.llm import pieces

    texts = ["", " ", "\n", "  two  spaces \n\n and lines\n", "a▁b", "é中\U0001f600 mixed\tand\x00odd", "x" * 700, english(3, 300), " lead", "trail ", "\n lead"]
    own, library = pieces.Vocabulary.of(pieces.MODEL), pieces.Vocabulary.of(pieces.MODEL, by_library=True)
    assert library is not own and library.encode(texts) == own.encode(texts) == [own.library.encode(x) for x in texts]
