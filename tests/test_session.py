import datetime as dt

import numpy as np
import pytest

from parley.streaming import session as live

RNG = np.random.default_rng(4)


def flip(sig, bits):
    out = sig.copy()
    for b in bits:
        out[b // 64] ^= np.uint64(1) << np.uint64(63 - b % 64)
    return out


@pytest.fixture(scope="module")
def index():
    """Four events of 100 signatures each, near their centres."""
    words, event = [], []
    for e in range(4):
        centre = RNG.integers(0, 2**64, 4, dtype=np.uint64)
        for _ in range(100):
            words.append(flip(centre, RNG.integers(0, 256, 10)))
            event.append(e)
    return live.Index(np.array(words), np.arange(400), np.array(event))


def test_index_is_brute_force(index):
    q = index.words[7]
    want = sorted((live.ham(index.words[i], q), i) for i in range(400))
    assert index.top_k(q, 5) == want[:5] and index.top_k(q, 0) == [] and len(index.top_k(q, 1000)) == 400
    assert index.top_k(q, 3, index.scope([2])) == [x for x in want if 200 <= x[1] < 300][:3]
    hits, size, shards = index.search(q, 10, 64, 1)
    assert shards and size == 100 and hits == [x for x in want if x[1] < 100][:10]


def test_gate():
    g, base = live.DriftGate(16), np.full(4, 0xAAAAAAAAAAAAAAAA, np.uint64)
    assert [g.update(base), g.update(flip(base, range(4))), g.update(flip(base, range(8))), g.update(flip(base, range(20)))] == [True, False, False, True]
    assert (g.emitted, g.suppressed) == (2, 2)
    g.reset()
    assert g.update(base)


def test_cache_evicts_the_least_recent_and_keeps_scopes_apart():
    c = live.DeltaCache(tolerance=0, entries=2)
    a, b, d = (np.array([x, 0, 0, 0], np.uint64) for x in (11, 22, 33))
    c.insert([], a, 3, ["a"])
    c.insert([], b, 3, ["b"])
    assert c.lookup([], a, 3) == ["a"]
    c.insert([], d, 3, ["d"])
    assert c.lookup([], b, 3) is None and c.lookup([], a, 3) == ["a"] and c.lookup([1], a, 3) is None and c.lookup([], a, 4) is None
    assert c.stats["evictions"] == 1 and len(c) == 2
    c.clear()
    assert len(c) == 0


def test_cache_takes_the_nearest_within_tolerance():
    c, q = live.DeltaCache(tolerance=32), np.zeros(4, np.uint64)
    c.insert([2, 1], flip(q, range(24)), 1, ["far"])
    c.insert([1, 2], flip(q, range(4)), 1, ["near"])
    assert c.lookup([1, 2, 2], q, 1) == ["near"]
    assert c.lookup([1, 2], flip(q, range(100, 140)), 1) is None


def test_finalize_order_of_decisions(index):
    s, q = live.Session(), index.words[5]
    s.observe(index, q, 10)
    assert s.finalize(index, flip(q, range(3)), 10, 0.0)["served_by"] == "speculative"
    assert s.finalize(index, flip(q, range(5)), 10, 1.0)["served_by"] == "delta_cache"
    assert s.finalize(index, index.words[150], 10, 2.0)["served_by"] == "shard_scan"
    one = live.Index(index.words, index.doc, np.zeros(400, int))
    assert live.Session().finalize(one, q, 10, 0.0)["served_by"] == "full_scan"


def test_small_results_are_never_speculative(index):
    few = live.Index(index.words[:3], index.doc[:3], index.event[:3])
    s = live.Session()
    s.observe(few, few.words[0], 10)
    assert s.finalize(few, few.words[0], 10, 0.0)["served_by"] == "delta_cache"


def test_warm_predicts_a_scope_which_a_reset_of_the_utterance_keeps(index):
    s = live.Session()
    assert s.warm(index) == [] and not len(s.scope)
    for i, row in enumerate((5, 150, 6, 151, 7)):
        s.finalize(index, index.words[row], 5, float(i))
    s.warm(index)
    assert s.events[0] == 1 and len(s.scope) == 200
    s.reset_utterance()
    assert len(s.scope) == 200
    wrong = s.finalize(index, index.words[350], 5, 9.0)
    assert wrong["scope_size"] == 200 and wrong["top_event"] in (0, 1)  # the plain rules never leave the predicted scope


def test_old_events_leave_the_window(index):
    s = live.Session()
    s.finalize(index, index.words[5], 5, 0.0)
    s.finalize(index, index.words[150], 5, 61.0)
    assert [e for e, _ in s.window] == [1]


def test_prefetchers(index):
    m = live.OnlineMarkov()
    for _ in range(5):
        m.observe(0, 1)
    p = live.Prefetcher(index, m)
    p.query(index.words[5], 3)
    assert p.stats["cold_scans"] == 1
    p.prefetch([0])
    assert p.query(index.words[150], 3)[0][0] == 0 and p.stats["warm_hits"] == 1
    s = live.StreamingPrefetcher(index, m)
    assert s.finalize(index.words[5], 3) == ("rescan", [])
    s.prefetch([0])
    s.observe(index.words[150], 3)
    assert s.finalize(index.words[150], 3)[0] == "speculative"
    assert s.finalize(flip(index.words[150], range(4)), 3)[0] == "delta_cache"


@pytest.fixture(scope="module")
def frames(spark, index):
    corpus = spark.createDataFrame([(int(d), *map(int, w.view(np.int64)), int(e)) for d, w, e in zip(index.doc, index.words, index.event)], "doc_idx bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, event_id int")
    rows, at = [], dt.datetime(2024, 1, 1)
    for s in range(3):
        seq = 0
        for turn in range(6):
            final = flip(index.words[RNG.integers(0, 400)], RNG.integers(0, 256, 4))
            for action, n in (("observe", 30), ("observe", 12), ("finalize", 2), ("warm", 0)):
                rows.append((f"s{s}", seq, at + dt.timedelta(seconds=20 * turn + seq % 4), action, 5, *map(int, flip(final, RNG.integers(0, 256, n)).view(np.int64))))
                seq += 1
    schema = "session string, seq bigint, ts timestamp, action string, k int, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    return spark.createDataFrame(rows, schema), corpus, rows


def test_replay_is_the_plain_model(frames, index):
    log, corpus, rows = frames
    got = {(r["session"], r["seq"]): (r["served_by"], r["doc_ids"], r["predicted"]) for r in live.replay(log, corpus).collect()}
    sessions, want = {}, {}
    for s, seq, ts, action, k, *w in rows:
        out = sessions.setdefault(s, live.Session()).apply(index, action, np.array(w, np.int64).view(np.uint64), k, ts.replace(tzinfo=dt.timezone.utc).timestamp())
        if out:
            want[s, seq] = out["served_by"], [int(index.doc[r]) for _, r in out["results"]], out["predicted"]
    assert got == want


def test_stream_gives_the_rows_of_the_replay_over_restarts(frames, spark, tmp_path):
    log, corpus, _ = frames
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("seq < 12", "seq >= 12"):  # the query is stopped in between and takes its state up again
        log.where(part).coalesce(1).write.mode("append").parquet(source)
        q = live.stream(spark.readStream.schema(log.schema).parquet(source), corpus).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120), "the query doesn't end"
            assert q.exception() is None
        finally:
            q.stop()
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(spark.read.parquet(out)) == key(live.replay(log, corpus))


def test_unknown_action(index):
    with pytest.raises(ValueError):
        live.Session().apply(index, "dance", index.words[0], 1, 0.0)


def test_models_outlive_sessions(frames, spark, tmp_path):
    """A reset gives out what was learnt; the next conversation of that name begins with it, in a batch as in a stream."""
    log, corpus, _ = frames
    end = log.groupBy("session").agg({"seq": "max", "ts": "max"}).selectExpr("session", "`max(seq)` + 1 AS seq", "`max(ts)` + INTERVAL 1 SECOND AS ts", "'reset' AS action", "5 AS k", "0L AS s0", "0L AS s1", "0L AS s2", "0L AS s3")
    whole, make = log.unionByName(end), lambda: live.Session(persist=True)
    rows = live.replay(whole, corpus, make=make)
    saved = {r["session"]: r["model"] for r in rows.where("model IS NOT NULL").collect()}
    assert set(saved) == {"s0", "s1", "s2"} and all(live.OnlineMarkov.restore(x).dump() == x for x in saved.values())
    live.save_models(rows, str(tmp_path / "models"))
    prior = live.load_models(spark, str(tmp_path / "models"))
    assert {r["session"]: r["model"] for r in prior.collect()} == saved
    # a session that begins with the model is one that has gone on
    later = log.selectExpr("session", "seq + 100 AS seq", "ts + INTERVAL 1 HOUR AS ts", "action", "k", "s0", "s1", "s2", "s3")
    on = [tuple(r) for r in live.replay(whole.unionByName(later), corpus, make=make).where("seq >= 100").collect()]
    new = [tuple(r) for r in live.replay(later, corpus, make=make, prior=prior).collect()]
    assert sorted(map(repr, on)) == sorted(map(repr, new)) and any(r[6] for r in new)
    source = str(tmp_path / "in")
    whole.coalesce(1).write.parquet(source)
    out = live.stream(spark.readStream.schema(whole.schema).parquet(source), corpus, make=make)
    q = live.keep_models(out, str(tmp_path / "kept"), str(tmp_path / "cp"), str(tmp_path / "out"))
    try:
        assert q.awaitTermination(120) and q.exception() is None
    finally:
        q.stop()
    assert {r["session"]: r["model"] for r in live.load_models(spark, str(tmp_path / "kept")).collect()} == saved
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_a_reset_forgets_or_keeps():
    from parley.operators.successor import Hybrid, TabularSR

    one = live.Index(np.zeros((1, 4), np.uint64), np.array([0]), np.array([0]))
    for predictor in (live.OnlineMarkov(0.5, 60.0, 2), Hybrid(TabularSR(warmup=4), live.OnlineMarkov(0.5))):
        for persist in (False, True):
            s = live.Session(predictor=predictor, persist=persist)
            s.predictor.observe(1, 2)
            row = s.apply(one, "reset", one.words[0], 1, 0.0)
            kept = live.as_markov(s.predictor)
            assert (row["model"] is not None) == persist == bool(kept.counts) and kept.alpha == 0.5 and type(s.predictor) is type(predictor)
    s = live.Session(predictor=TabularSR(), persist=True)
    assert s.apply(one, "reset", one.words[0], 1, 0.0)["model"] is None


def test_gate_streams_through_sorted_rows(spark):
    """The rows of the fold in memory, a hot session among them."""
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 2 else f"s{i % 5}", i, *map(int, rng.integers(-(2**40), 2**40, 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "session string, i bigint, s0 bigint, s1 bigint").repartition(5)
    want, gates = set(), {}
    for name, i, a, b in rows:
        want.add((name, i, gates.setdefault(name, live.DriftGate(40)).update(np.array([a, b], np.int64).view(np.uint64))))
    assert set(map(tuple, live.gate(df, "session", "i", 128, 40).collect())) == want


def test_speculations_are_looked_for_when_they_are_needed(index, monkeypatch):
    """A partial costs no scan of the corpus; what a turn gives out costs one."""
    scans, measure = [], live.Index._measure
    monkeypatch.setattr(live.Index, "_measure", lambda self, q, spans: (scans.append(1), measure(self, q, spans))[1], raising=False)
    s, q = live.Session(), index.words[5]
    for bits in (range(100), range(50), range(4)):
        assert s.observe(index, flip(q, bits), 10)
    assert not scans
    got = s.finalize(index, q, 10, 0.0)
    assert len(scans) == 1 and got["served_by"] == "speculative" and got["results"] == index.top_k(flip(q, range(4)), 10)


def test_scans_of_many_blocks_are_brute_force(monkeypatch):
    """Blocks of rows, events that lie apart, ties and rows without event."""
    monkeypatch.setattr(live, "SCAN_ROWS", 16, raising=False)
    r = np.random.default_rng(2)
    words, event, doc = r.integers(0, 1 << 4, (3000, 4)).astype(np.uint64), r.integers(-1, 5, 3000), r.permutation(9000)[:3000]
    one = live.Index(words, doc, event)
    for q in words[:5]:
        want = sorted((live.ham(w, q), i) for i, w in enumerate(one.words))
        for k in (1, 7, 64, 2999, 5000):
            assert one.top_k(q, k) == want[:k]
            assert one.top_k(q, k, one.scope([3, 1, 3, 77])) == [x for x in want if one.event[x[1]] in (1, 3)][:k]


def test_sessions_are_spread_over_tasks(frames):
    """Their rows are few bytes, and adaptive execution would put them into one task."""
    log, corpus, _ = frames
    assert live.replay(log, corpus).rdd.getNumPartitions() >= 4
