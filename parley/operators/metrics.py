"""Statistics over decision logs: hit rates, percentiles, topic correctness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def tally(log: DataFrame, column: str = "served_by") -> DataFrame:
    """(column, n, percent)."""
    n = log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100.0 * ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def _bucketed(rows: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Adds `_bucket`: about equal, ordered slices of a numeric column, so that ranks can be found without one task that sorts everything."""
    from pyspark.ml.feature import Bucketizer

    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = rows.withColumn("_number", F.col(column).cast("double"))
    edges = sorted(set(numbers.approxQuantile("_number", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    if not edges:
        return rows.withColumn("_bucket", F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    return cut.transform(numbers).withColumn("_bucket", F.col("_bucket").cast("int")).drop("_number")


def percentiles(values: DataFrame, column: str, by: list[str] = (), points: list[int] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles sorted[n p / 100] (integer division, last at most) and the mean.

    Values are counted in ordered buckets; only the buckets in which a wanted rank
    falls are sorted, each in a task of its own.
    """
    by = list(by)
    t = _bucketed(values.where(F.col(column).isNotNull()).select(*by, column), column)
    counts = t.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col(column).cast("double")).alias("_s"))
    w, whole = Window.partitionBy(*by).orderBy("_bucket"), Window.partitionBy(*by)
    at = F.least(F.floor(F.col("_n") * F.col("_p") / 100), F.col("_n") - 1)
    counts = counts.select(*by, "_bucket", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), "_c", F.sum("_c").over(whole).alias("_n"), F.sum("_s").over(whole).alias("_total"))
    wanted = counts.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in points]))).withColumn("_at", at - F.col("_before")).where("_at >= 0 AND _at < _c")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in [*by, "_bucket"]]
    near = t.alias("t").join(wanted.alias("w"), same("t", "w"), "left_semi")
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(column)) - 1
    ranked = near.withColumn("_i", place).alias("r").join(wanted.alias("w"), [*same("r", "w"), F.col("_i") == F.col("_at")])
    return ranked.groupBy(*[F.col(f"w.{c}").alias(c) for c in by]).agg(
        *[F.max(F.when(F.col("_p") == p, F.col(f"r.{column}"))).alias(f"p{p}") for p in points], F.max(F.col("_total") / F.col("_n")).alias("mean")
    )


def topic_correctness(log: DataFrame) -> DataFrame:
    """(n, top1, topk) of a log (target, topics): shares of rows whose first topic, or any, is the target."""
    one = F.get("topics", F.lit(0)) == F.col("target")
    return log.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(one, F.lit(False)).cast("int")).alias("top1"), F.avg(F.array_contains("topics", F.col("target")).cast("int")).alias("topk"))


def running_rate(log: DataFrame, order: str, hit: str, points: list[int]) -> DataFrame:
    """(n, rate): share of hits among the first n rows by a numeric column, at those of the given n that there are rows for.

    Whole buckets before a point enter as counts; only the buckets that hold a point are sorted.
    """
    t = _bucketed(log.select(F.col(order).alias("_order"), F.col(hit).cast("int").alias("_hit")), "_order")
    w = Window.orderBy("_bucket")  # over one row for each bucket
    c = t.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"), F.sum("_hit").alias("_h"))
    c = c.select("_bucket", "_c", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), (F.coalesce(F.sum("_h").over(w), F.lit(0)) - F.coalesce("_h", F.lit(0))).alias("_hits"))
    wanted = c.withColumn("n", F.explode(F.array(*[F.lit(p) for p in points]))).where("n > _before AND n <= _before + _c")
    near = t.join(F.broadcast(wanted.select("_bucket").distinct()), "_bucket", "left_semi")
    near = near.withColumn("_i", F.row_number().over(Window.partitionBy("_bucket").orderBy("_order")))
    rows = near.join(F.broadcast(wanted), "_bucket").where("_before + _i <= n")
    return rows.groupBy("n").agg(((F.first("_hits") + F.coalesce(F.sum("_hit"), F.lit(0))) / F.col("n")).alias("rate"))


def server_stats(log: DataFrame, micros: str) -> DataFrame:
    """(requests, total_us, mean_ms): the mean in whole milliseconds over at least one request."""
    return log.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(micros), F.lit(0)).alias("total_us")).withColumn("mean_ms", F.expr("(total_us div 1000) div greatest(requests, 1)"))


def decision_stats(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, finalized, speculative, delta_cache, scanned, speculative_rate, cache_rate, hit_rate) of finalized turns (served_by); a ratio over nothing is 0."""
    one = lambda *names: F.count_if(F.col("served_by").isin(*names))
    served = log.where(F.col("served_by").isin("speculative", "delta_cache", "shard_scan", "full_scan", "rescan"))
    t = served.groupBy(*by).agg(F.count(F.lit(1)).alias("finalized"), one("speculative").alias("speculative"), one("delta_cache").alias("delta_cache"), one("shard_scan", "full_scan", "rescan").alias("scanned"))
    looked = F.col("finalized") - F.col("speculative")  # speculations that hold never ask the cache
    return t.select("*", ratio(F.col("speculative"), F.col("finalized")).alias("speculative_rate"), ratio(F.col("delta_cache"), looked).alias("cache_rate"), ratio(F.col("finalized") - F.col("scanned"), F.col("finalized")).alias("hit_rate"))
