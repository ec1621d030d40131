"""Queries that SQL can't state, against plain versions over the whole small tables."""

import numpy as np
import pytest

from tables import SF
from parley.functions import text as T
from parley.plans import registry as R
from parley.streaming import session as live


@pytest.fixture(scope="module")
def sessions(spark):
    """Each session's events in order."""
    out = {}
    for r in R.turns(spark, SF).orderBy("session", "ts", "seq").collect():
        out.setdefault(r["session"], []).append(r["event_id"])
    return out


def td0(events, gamma=0.9, eta=0.1):
    """The rule with dense arrays: only events seen so far have columns."""
    m, seen = {}, []
    for t, (a, b) in enumerate(zip(events, events[1:])):
        for e in (a, b):
            if e not in seen:
                seen.append(e)
                m.setdefault((e, e), 1.0)
        rate, new = eta / (1 + 0.01 * t), {}
        for c in seen:
            new[a, c] = m.get((a, c), 0.0) + rate * ((a == c) + gamma * m.get((b, c), 0.0) - m.get((a, c), 0.0))
        m |= new
    return m


def test_sr_td0(spark, sessions):
    got = {(r["session"], r["source"], r["target"]): r["value"] for r in R.sr_td0(spark, SF).collect()}
    want = {(s, *k): v for s, e in sessions.items() for k, v in td0(e).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_hybrid_predict(spark, sessions):
    vocab = sorted({e for s in sessions.values() for e in s})
    counts = {}
    for s in sessions.values():
        for a, b in zip(s, s[1:]):
            counts[a, b] = counts.get((a, b), 0) + 1
    want = {}
    for s, events in sessions.items():
        last = events[-1]
        best = sorted(((max(v, 0.0), c) for (a, c), v in td0(events).items() if a == last and c != last), key=lambda x: (-x[0], x[1]))[:3]
        total = sum(v for v, _ in best)
        if (len(events) - 1) / 50 >= 0.5 and total > 0:
            want[s] = ("sr", [(e, v / total) for v, e in best])
        else:
            n = sum(counts.get((last, e), 0) for e in vocab)
            p = [(-(counts.get((last, e), 0) + 1) / (n + len(vocab)) if n >= 2 else -1 / len(vocab), e) for e in vocab]
            want[s] = ("markov", [(e, -x) for x, e in sorted(p)[:3]])
    got = {}
    for r in R.hybrid_predict(spark, SF).orderBy("session", "rank").collect():
        got.setdefault(r["session"], (r["by"], []))[1].append((r["event_id"], r["probability"]))
    assert set(got) == set(want)
    for s in want:
        assert got[s][0] == want[s][0] and [e for e, _ in got[s][1]] == [e for e, _ in want[s][1]]
        assert np.allclose([p for _, p in got[s][1]], [p for _, p in want[s][1]], atol=2e-6)


def bits_and_labels(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding", "label").collect()
    return np.array([[x >= 0 for x in r["embedding"]] for r in rows], float), np.array([r["label"] for r in rows])


def principal(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])


def test_pca_components(spark):
    x, _ = bits_and_labels(spark)
    values, vectors = principal(x, 8)
    got = R.pca_components(spark, SF).collect()
    loading = np.zeros((64, 8))
    for r in got:
        loading[r["bit"], r["component"]] = r["loading"]
        assert r["eigenvalue"] == pytest.approx(values[r["component"]], abs=2e-6)
    assert np.allclose(loading, vectors, atol=1e-4)


def test_lowrank_predict(spark, sessions):
    x, label = bits_and_labels(spark)
    _, w = principal(x, 16)
    features = {}
    for e in np.unique(label):
        f = ((2 * x[label == e].sum(axis=0) >= (label == e).sum()) - x.mean(axis=0)) @ w
        features[int(e)] = f / np.linalg.norm(f)
    counts = {}
    for s in sessions.values():
        for a, b in zip(s, s[1:]):
            counts[a, b] = counts.get((a, b), 0) + 1
    n, m = sum(counts.values()), np.eye(16)
    for t in range(200):
        m = m + 0.05 / (1 + 0.01 * t) * sum(c / n * np.outer(features[a] + 0.9 * m @ features[b] - m @ features[a], features[a]) for (a, b), c in counts.items())
    got = {}
    for r in R.lowrank_predict(spark, SF).orderBy("source", "rank").collect():
        got.setdefault(r["source"], []).append((r["target"], r["probability"]))
    for e, f in features.items():
        best = sorted(((-max(float(g @ m @ f), 0.0), t) for t, g in features.items() if t != e))[:3]
        total = -sum(v for v, _ in best)
        assert [t for t, _ in got[e]] == [t for _, t in best]
        assert np.allclose([p for _, p in got[e]], [-v / total for v, _ in best], atol=1e-4)


def plain_signature(text):
    """256 bits of a text, token by token."""
    import hashlib

    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x and x not in T.STOP_WORDS]
    total = np.zeros(256, int)
    for f in w + [f"{a}_{b}" for a, b in zip(w, w[1:])]:
        h = hashlib.md5(f"7|0|{f}".encode()).hexdigest()
        for band in range(4):
            total[int(h[8 * band : 8 * band + 7], 16) % 256] += 1 if h[8 * band + 7] >= "8" else -1
    return np.packbits(total >= 0).view(">u8").astype(np.uint64)


def test_session_replay_and_what_is_counted_from_it(spark):
    """Whole conversations through the plain model, with signatures made token by token."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    names = {n: i for i, n in enumerate(sorted({r["source"] or "_default" for r in docs}))}
    index = live.Index(np.array([plain_signature(r["text"]) for r in docs]), np.array([r["doc_id"] for r in docs]), np.array([names[r["source"] or "_default"] for r in docs]))
    import math
    import re

    logs = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").orderBy("conv_id", "turn").collect():
        w = re.split(r"\s+", r["text"])
        for i, (action, part) in enumerate([("observe", 0.25), ("observe", 0.5), ("observe", 0.75), ("finalize", 1.0), ("warm", 1.0)]):
            logs.setdefault(str(r["conv_id"]), []).append((r["turn"] * 8 + i, r["turn"] * 5 + i, action, " ".join(w[: max(math.ceil(len(w) * part), 1)])))
    want = {}
    for name, log in logs.items():
        state = live.Session()
        for seq, ts, action, text in log:
            got = state.apply(index, action, plain_signature(text), 10, float(ts))
            if got:
                want[name, seq] = (got["served_by"], [int(index.doc[r]) for _, r in got["results"]], [d for d, _ in got["results"]], got["top_event"], got["predicted"], got["scope_size"])
    got = {(r["session"], r["seq"]): tuple(r)[2:] for r in R.session_replay(spark, SF).collect()}
    assert got == want
    served = [v[0] for v in want.values() if v[0] != "warm"]
    assert {r["served_by"]: r["n"] for r in R.served_by_tally(spark, SF).collect()} == {x: served.count(x) for x in set(served)}
    cached = {(s, q, v[0], v[5], len(v[1])) for (s, q), v in want.items() if v[0] in ("delta_cache", "speculative")}
    assert set(map(tuple, R.delta_cache_log(spark, SF).collect())) == cached
