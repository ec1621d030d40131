import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import catalog, markov, successor
from parley.streaming.session import OnlineMarkov


def turns_of(spark, sessions):
    at = dt.datetime(2024, 1, 1)
    rows = [(s, at + dt.timedelta(seconds=10 * i), i, e) for s, events in enumerate(sessions) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "session int, ts timestamp, seq bigint, event_id int")


def table_of(df):
    return {(tuple(r["context"]), r["next"]): r["weight"] for r in df.collect()}


def test_transitions_of_all_orders(spark):
    t = turns_of(spark, [[1, 2, 3], [1, 2]])
    assert table_of(markov.transitions(t)) == {((1,), 2): 2.0, ((2,), 3): 1.0, ((1, 2), 3): 1.0}


def test_unknown_events_are_dropped_before_neighbours_form(spark):
    t = turns_of(spark, [[0, 9, 1], [9, 0]]).withColumn("event", F.concat(F.lit("e"), "event_id")).drop("event_id")
    dim = spark.createDataFrame([(0, "e0"), (1, "e1")], "event_id int, name string")
    assert table_of(markov.transitions(markov.known(t, dim))) == {((0,), 1): 1.0}


def test_weights_halve(spark):
    t = turns_of(spark, [[1, 2]])
    m = markov.transitions(t, markov.MarkovOptions(1, half_life_s=10.0), F.lit("2024-01-01 00:00:20").cast("timestamp"))
    assert m.first()["weight"] == pytest.approx(0.5)
    past = markov.transitions(t, markov.MarkovOptions(1, half_life_s=10.0), F.lit("2023-01-01").cast("timestamp"))
    assert past.first()["weight"] == 1.0
    assert markov.decayed(m, 10.0, 10.0).first()["weight"] == pytest.approx(0.25)


def predict(spark, t, history, k=3, **options):
    q = spark.createDataFrame([(1, history)], "query_id int, history array<int>")
    got = markov.predict(q, markov.transitions(t), markov.vocabulary(t), k, **options).orderBy("rank").collect()
    return [(r["event_id"], r["probability"], r["ord"]) for r in got]


def test_longer_contexts_win_and_fall_back(spark):
    t = turns_of(spark, [[1, 2]] * 50 + [[4, 1, 3]] * 20)
    assert predict(spark, t, [1], 1)[0][0] == 2
    assert predict(spark, t, [4, 1], 1)[0] == (3, pytest.approx(20.01 / 20.04), 2)
    assert predict(spark, t, [7, 1], 1)[0][2] == 1
    assert predict(spark, t, [99], 10) == [(e, 0.25, 0) for e in (1, 2, 3, 4)]
    assert predict(spark, t, [], 10) == [(e, 0.25, 0) for e in (1, 2, 3, 4)]


def test_hand_counted_transcripts(spark):
    lines = [["pricing", "trial", "pricing", "support"], ["account", "security", "support"], ["pricing", "trial", "pricing"], ["support", "security"]]
    names = sorted({e for x in lines for e in x})
    t = turns_of(spark, [[names.index(e) for e in x] for x in lines])
    counts = table_of(markov.transitions(t, markov.MarkovOptions(1)))
    i = names.index
    assert counts == {((i("pricing"),), i("trial")): 2, ((i("trial"),), i("pricing")): 2, ((i("pricing"),), i("support")): 1, ((i("account"),), i("security")): 1, ((i("security"),), i("support")): 1, ((i("support"),), i("security")): 1}
    got = {e: p for e, p, _ in predict(spark, t, [i("pricing")], 5, max_order=1)}
    assert got[i("trial")] == pytest.approx(2.01 / 3.05) and got[i("support")] == pytest.approx(1.01 / 3.05)
    assert {p for _, p, o in predict(spark, t, [i("account")], 5, max_order=1)} == {0.2}  # too little support


def test_batch_and_online_predictions_agree(spark):
    rng = np.random.default_rng(5)
    sessions = [rng.integers(0, 4, 30).tolist() for _ in range(5)]
    t, online = turns_of(spark, sessions), OnlineMarkov(alpha=0.5)
    for s in sessions:
        for a, b in zip(s, s[1:]):
            online.observe(a, b)
    for last in range(4):
        assert [(e, pytest.approx(p)) for e, p, _ in predict(spark, t, [last], 4, alpha=0.5, max_order=1)] == online.predict([last], 4)


def test_windows_of_events(spark):
    t = turns_of(spark, [[0, 1, 2, 3, 4]])
    last = {r["seq"]: r["window"] for r in markov.recent(t, 3, 1000.0).collect()}
    assert last[4] == [2, 3, 4] and last[0] == [0]
    young = {r["seq"]: r["window"] for r in markov.recent(t, 8, 10.0).collect()}
    assert young[4] == [3, 4]  # ten seconds are still young
    assert spark.range(1).select(markov.last_n(F.array(*map(F.lit, [1, 2])), 3)).first()[0] == [1, 2]


def test_catalogue(spark):
    c = spark.createDataFrame([(0, "pricing"), (1, "pricing"), (2, "trial"), (3, None)], "doc_idx bigint, event string")
    dim = {r["name"]: r["event_id"] for r in catalog.event_dim(c).collect()}
    assert dim == {"_default": 0, "pricing": 1, "trial": 2}
    b = catalog.doc_event(c, catalog.event_dim(c))
    assert {r["event_id"]: r["rows"] for r in catalog.inverted_list(b).collect()} == {0: [3], 1: [0, 1], 2: [2]}
    assert sorted(r[0] for r in catalog.scope(b, [1, 2, 1]).collect()) == [0, 1, 2]
    both = b.union(spark.createDataFrame([(0, 2)], "doc_idx bigint, event_id int"))
    assert {r[0]: r[1] for r in catalog.single_event(both).collect()}[0] == 2


# --- successor representations -----------------------------------------------------------------------------------------


def test_a_cycle_has_its_analytic_values():
    m = successor.TabularSR(gamma=0.5, eta=0.05)
    for i in range(9000):
        m.observe(i % 3, (i + 1) % 3)
    for k, want in enumerate((1 / (1 - 0.125), 0.5 / (1 - 0.125), 0.25 / (1 - 0.125))):
        assert abs(m.rows[0][k] - want) < 0.05


@pytest.mark.parametrize("dense", [1000, 1])
def test_closed_form_is_the_inverse(spark, dense):
    """Solved at once, and summed by doubling: M (I - gamma T) = I, whatever gamma."""
    spark.sparkContext.setCheckpointDir("/tmp/parley-checkpoints")
    t = turns_of(spark, [[0, 1, 2] * 10, [0, 3, 3, 1, 0, 4]])
    matrix = successor.transition_matrix(t)
    p = np.zeros((5, 5))
    for r in matrix.collect():
        p[r["source"], r["target"]] = r["p"]
    for gamma in (0.5, 0.9) if dense == 1 else (0.5, 0.9, 0.99):
        m = np.zeros((5, 5))
        for r in successor.closed_form(matrix, gamma, dense=dense).collect():
            m[r["source"], r["target"]] = r["value"]
        assert np.allclose(m @ (np.eye(5) - gamma * p), np.eye(5), atol=1e-8)
    assert successor.closed_form(matrix.limit(0)).collect() == []


def test_saved_models(spark, tmp_path):
    from parley.sources import index_io as io

    m = successor.TabularSR(0.8, 0.2, 10)
    for a, b in ((1, 2), (2, 3), (1, 3), (3, 1)):
        m.observe(a, b)
    io.save_model(spark, m, str(tmp_path / "sr.json"))
    back = io.load_sr(spark, str(tmp_path / "sr.json"))
    assert back == m and back.predict([1], 3) == m.predict([1], 3)
    low = successor.LowRankSR(8, 64)
    for e in range(4):
        low.set_centroid(e, np.arange(64) % (e + 2) == 0)
    for i in range(60):
        low.observe(i % 4, (i + 1) % 4)
    io.save_model(spark, low, str(tmp_path / "low.json"))
    again = io.load_low_rank(spark, str(tmp_path / "low.json"), 8, bits=64)
    assert np.array_equal(again.m, low.m) and (again.t, again.gap) == (low.t, low.gap)
    with pytest.raises(ValueError):
        io.load_low_rank(spark, str(tmp_path / "low.json"), 9, bits=64)
    with pytest.raises(io.CorpusError):
        io.load_low_rank(spark, str(tmp_path / "low.json"), 8, bits=64, projection=np.zeros((64, 8)))


def test_warm_events(spark, tmp_path):
    from parley.sources import index_io as io

    bridge = spark.range(0, 90).selectExpr("id AS doc_idx", "CAST(CASE WHEN id < 50 THEN 1 WHEN id < 80 THEN 2 ELSE 3 END AS INT) AS event_id")
    assert io.load_warm_events(spark, str(tmp_path / "none.json"), bridge) == []
    io.save_warm_events(spark, [3, 1, 7], str(tmp_path / "warm.json"))
    assert io.load_warm_events(spark, str(tmp_path / "warm.json"), bridge, 20) == [1]


def test_predictions_leave_the_event_itself_out(spark):
    m = successor.TabularSR()
    for _ in range(50):
        for _ in range(4):
            m.observe(0, 1)
        m.observe(0, 2)
    got = m.predict([0], 5)
    assert [e for e, _ in got][:2] == [1, 2] and sum(p for _, p in got) == pytest.approx(1)
    assert m.predict([77], 3) == [] and m.predict([], 3) == [] and m.confidence() == 1.0


def test_grouped_td0_is_the_online_model(spark):
    rng = np.random.default_rng(2)
    sessions = [rng.integers(0, 3, 20).tolist() for _ in range(3)]
    got = {(r["session"], r["source"], r["target"]): r["value"] for r in successor.train_td0(turns_of(spark, sessions)).collect()}
    want = {}
    for s, events in enumerate(sessions):
        m = successor.TabularSR()
        for a, b in zip(events, events[1:]):
            m.observe(a, b)
        want |= {(s, a, b): pytest.approx(v) for a, row in m.rows.items() for b, v in row.items()}
    assert got == want


def test_hybrid_uses_the_surer_model():
    h = successor.Hybrid(successor.TabularSR(warmup=4), OnlineMarkov())
    h.observe(0, 1)
    assert h.predict([0], 2) == h.markov.predict([0], 2)
    for _ in range(5):
        h.observe(0, 1)
    assert h.predict([0], 2) == h.sr.predict([0], 2) and h.confidence() == 1.0


def centroids():
    out = []
    for k in range(3):
        x = np.zeros(256)
        x[64 * k : 64 * k + 8] = 1
        out.append(x)
    return out


@pytest.mark.parametrize("counted", [False, True])
def test_low_rank_learns_a_transition(counted):
    m = successor.LowRankSR(k=32)
    for e, c in enumerate(centroids()):
        m.set_centroid(e, c)
    if counted:
        m.observe_counts([(0, 1, 30)])
    else:
        for _ in range(60):
            m.observe(0, 1)
    t, before = m.t, m.m.copy()
    m.observe(0, 99)
    assert m.t == t and (m.m == before).all()
    got = m.predict([0], 2)
    assert got[0][0] == 1 and m.predict([99], 2) == []
    again = successor.LowRankSR(k=32)
    again.load(m.dump())
    assert (again.m == m.m).all() and again.t == m.t
    with pytest.raises(ValueError):
        successor.LowRankSR(k=8).load(m.dump())


def test_components_find_the_varying_bit(spark):
    rows = [(i, (1 << 56) if i % 2 else 0) for i in range(40)]  # bit 7
    n, s, x = successor.bit_statistics(spark.createDataFrame(rows, "i int, s0 bigint"), 64)
    mean, w, values = successor.principal_components(n, s, x, 4)
    assert n == 40 and mean[7] == 0.5 and w[7, 0] > 0.9 and values[0] == pytest.approx(0.25) and not w[:, 1:].any()


def test_components_are_orthogonal_and_the_covariance_is_numpy_s(spark):
    rng = np.random.default_rng(8)
    words = rng.integers(-(2**63), 2**63, 500)
    n, s, x = successor.bit_statistics(spark.createDataFrame([(int(w),) for w in words], "s0 bigint"), 64)
    bits = successor.unpack(words.reshape(-1, 1)).astype(float)
    mean, w, _ = successor.principal_components(n, s, x, 8)
    assert np.allclose(mean, bits.mean(axis=0)) and np.allclose(w.T @ w, np.eye(8), atol=1e-9)
    assert np.allclose(x / n - np.outer(mean, mean), np.cov(bits.T, bias=True))
    empty = successor.bit_statistics(spark.createDataFrame([], "s0 bigint"), 64)
    assert empty[0] == 0 and not empty[2].any()
