import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import cold, metrics


@pytest.mark.parametrize("event, doc", [(0, 0), (1, 42), (0x5EADBEEF, 12345), (2**31 - 1, 2**32 - 1)])
def test_values_round_trip(spark, event, doc):
    df = spark.createDataFrame([(event, doc)], "e bigint, d bigint").select(cold.pack_value(F.col("e"), F.col("d")).alias("v"))
    assert tuple(df.select(*cold.unpack_value(F.col("v"))).first()) == (event, doc)


def bits_to_rows(spark, bits):
    return spark.createDataFrame([(i, -(2**63) if b else 0) for i, b in enumerate(bits)], "insert_seq bigint, s0 bigint")


@pytest.mark.parametrize("n", [1, 5, 64, 128, 200, 512, 576])
@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_rank_and_select_are_naive_counts(spark, n, chunk, monkeypatch):
    bits = np.random.default_rng(n).integers(0, 2, n)
    monkeypatch.setattr(cold.with_prefix, "__defaults__", ((), chunk))
    v = cold.bit_sliced(bits_to_rows(spark, bits), 64).where("bit = 0").select("word_idx", "word")
    at = spark.range(0, n + 3).withColumnRenamed("id", "i")
    for r in cold.rank(v, at, n).collect():
        i = min(r["i"], n)
        assert (r["rank1"], r["rank0"]) == (bits[:i].sum(), i - bits[:i].sum())
    for ones in (True, False):
        where = np.flatnonzero(bits == ones).tolist()
        got = {r["j"]: r["position"] for r in cold.select(v, spark.range(1, n + 2).withColumnRenamed("id", "j"), n, ones).collect()}
        assert got == {j: where[j - 1] if j <= len(where) else None for j in range(1, n + 2)}


def test_radius_and_tiers(spark):
    rows = [(0, 1 << 63), (1, 1 << 62), (2, 3 << 62), (3, 15)]
    s = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v, i) for i, v in rows], "insert_seq bigint, s0 bigint, value bigint")
    q = [-(2**63)]
    assert {(r["insert_seq"], r["distance"]) for r in cold.within(s, q, 2).collect()} == {(0, 0), (1, 2), (2, 1)}
    assert [r["insert_seq"] for r in cold.nearest(s, q, 2).collect()] == [0, 2]
    hot = spark.createDataFrame([(1, 9)], "distance int, doc_idx bigint")
    assert {(r["tier"], r["doc_idx"]) for r in cold.with_tier(hot, cold.within(s, q, 0)).collect()} == {("hot", 9), ("cold", 0)}


def test_cold_tier_appends_and_compacts(spark, tmp_path):
    tier = cold.ColdTier(spark, str(tmp_path / "cold"), 64)
    assert tier.rows().count() == 0
    batch = spark.createDataFrame([(7, 1, 10, 0), (8, 2, 11, 1)], "s0 bigint, event_id int, doc_idx bigint, ordinal bigint")
    tier.append(batch)
    tier.append(batch, compact_at=4)
    assert (tmp_path / "cold/base").exists() and not (tmp_path / "cold/tail").exists()
    tier.append(batch)
    assert [r["insert_seq"] for r in tier.nearest([7], 4).collect()] == [0, 2, 4, 1]


def test_percentiles_are_nearest_ranks(spark):
    rng = np.random.default_rng(6)
    data = {"a": rng.normal(size=777).round(2).tolist(), "b": [5.0] * 40, None: [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, x in data.items() for v in [*x, None]], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in metrics.percentiles(df, "v", ["g"]).collect()}
    for g, x in data.items():
        x = sorted(x)
        assert got[g] == (*(x[min(len(x) * p // 100, len(x) - 1)] for p in (50, 95, 99)), pytest.approx(sum(x) / len(x)))
    whole = sorted(v for x in data.values() for v in x)
    assert metrics.percentiles(df, "v").first()[0] == whole[len(whole) // 2]
    assert metrics.percentiles(df.where("false"), "v", ["g"]).count() == 0


def test_running_rate(spark):
    hits = np.random.default_rng(7).integers(0, 2, 900)
    df = spark.createDataFrame([(i, bool(h)) for i, h in enumerate(hits)], "n_th bigint, hit boolean")
    got = {r["n"]: r["rate"] for r in metrics.running_rate(df, "n_th", "hit", [1, 200, 500, 900, 5000]).collect()}
    assert got == {n: pytest.approx(hits[:n].mean()) for n in (1, 200, 500, 900)}


def test_ratios_and_stats(spark):
    assert spark.range(1).select(metrics.ratio(F.lit(1), F.lit(0)), metrics.ratio(F.lit(1), F.lit(4))).first()[:] == (0.0, 0.25)
    log = spark.createDataFrame([(1500,), (2600,)], "us bigint")
    assert tuple(metrics.server_stats(log, "us").first()) == (2, 4100, 2)
    assert tuple(metrics.server_stats(log.where("false"), "us").first()) == (0, 0, 0)
    t = {r["served_by"]: r["percent"] for r in metrics.tally(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "served_by string")).collect()}
    assert t == {"a": 50.0, "b": 25.0, "c": 25.0}
