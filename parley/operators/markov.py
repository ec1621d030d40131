"""Variable-order Markov prediction of the next event, as relational steps.

Input turns are (session, ts, seq, event); a session's order is (ts, seq).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SUPPORT = 2.0


@dataclass(frozen=True)
class MarkovOptions:
    max_order: int = 1
    alpha: float = 1.0
    half_life_s: float | None = None


TRAIN = MarkovOptions(max_order=3, alpha=0.01)


def in_order():
    return Window.partitionBy("session").orderBy("ts", "seq")


def known(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Turns with event_id; unknown events are dropped before neighbours are formed, then sessions of fewer than two turns."""
    t = turns.join(events.withColumnRenamed("name", "event"), "event")
    return t.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session"))).where("_n >= 2").drop("_n")


def contexts(turns: DataFrame, order: int, event: str = "event_id") -> DataFrame:
    """Adds `history`: the up to `order` events before each turn, oldest first."""
    w = in_order().rowsBetween(-order, -1)
    return turns.withColumn("history", F.collect_list(event).over(w))


def transitions(turns: DataFrame, options: MarkovOptions = TRAIN, as_of: Column | None = None, event: str = "event_id") -> DataFrame:
    """(ord, context, next, weight): how often each event followed each context of 1 .. max_order events.

    One window and one aggregate serve all orders. With a half-life the weight of an
    observation halves as often as it fits between its ts and `as_of` (never
    negative), a plain sum since decay is multiplicative.
    """
    t = contexts(turns, options.max_order, event)
    weight = F.lit(1.0)
    if options.half_life_s:
        age = F.greatest(F.unix_micros(as_of) - F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)) / 1e6
        weight = F.pow(F.lit(2.0), -age / options.half_life_s)
    each = t.where(F.size("history") >= 1).select(F.explode(F.sequence(F.lit(1), F.size("history"))).alias("ord"), "history", F.col(event).alias("next"), weight.alias("w"))
    context = F.slice("history", F.size("history") - F.col("ord") + 1, F.col("ord"))
    return each.groupBy("ord", context.alias("context"), "next").agg(F.sum("w").alias("weight"))


def decayed(table: DataFrame, half_life_s: float, elapsed_s: float) -> DataFrame:
    """A saved table's weights after `elapsed_s` more seconds; a negative time counts as none."""
    return table.withColumn("weight", F.col("weight") * F.pow(F.lit(2.0), F.lit(-max(elapsed_s, 0.0) / half_life_s)))


def totals(table: DataFrame) -> DataFrame:
    """(ord, context, total)."""
    return table.groupBy("ord", "context").agg(F.sum("weight").alias("total"))


def vocabulary(turns: DataFrame, event: str = "event_id") -> DataFrame:
    """(event_id) seen in training."""
    return turns.select(F.col(event).alias("event_id")).distinct()


def predict(queries: DataFrame, table: DataFrame, vocab: DataFrame, k: int, alpha: float = TRAIN.alpha, max_order: int = TRAIN.max_order) -> DataFrame:
    """(query_id, rank, event_id, probability, ord) for queries (query_id, history).

    The longest suffix of the history with a total of at least two is used, with
    Laplace smoothing over the whole vocabulary; without one the answer is uniform
    (ord 0). Ranked by probability, then event_id.
    """
    size = vocab.agg(F.count(F.lit(1)).alias("v"))
    suffix = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.least(F.size("history"), F.lit(max_order)))).alias("ord"), "history")
    suffix = suffix.select("query_id", "ord", F.when(F.col("ord") > 0, F.slice("history", F.size("history") - F.col("ord") + 1, F.greatest("ord", F.lit(1)))).alias("context"))
    usable = totals(table).where(F.col("total") >= MIN_SUPPORT)
    best = suffix.join(usable, ["ord", "context"], "left").where("total IS NOT NULL OR ord = 0")
    best = best.groupBy("query_id").agg(F.max(F.struct("ord", "context", "total")).alias("b")).select("query_id", "b.*")
    full = best.crossJoin(F.broadcast(size)).crossJoin(vocab.withColumnRenamed("event_id", "next"))
    scored = full.join(table, ["ord", "context", "next"], "left")
    p = F.when(F.col("ord") > 0, (F.coalesce("weight", F.lit(0.0)) + alpha) / (F.col("total") + F.lit(alpha) * F.col("v"))).otherwise(1.0 / F.col("v"))
    scored = scored.select("query_id", F.col("next").alias("event_id"), p.alias("probability"), "ord")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("probability").desc(), "event_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def confident(predictions: DataFrame, threshold: float = 0.05) -> DataFrame:
    return predictions.where(F.col("probability") >= threshold)


def recent(turns: DataFrame, capacity: int = 8, max_age_s: float = 60.0, event: str = "event_id") -> DataFrame:
    """Adds `window`: the session's last `capacity` events at each turn, the turn itself included, without those older than `max_age_s`."""
    w = in_order().rowsBetween(-(capacity - 1), 0)
    items = F.collect_list(F.struct(F.col("ts").alias("at"), F.col(event).alias("event"))).over(w)
    now = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.filter("_items", lambda x: now - F.unix_micros(x["at"].cast("timestamp")) <= int(max_age_s * 1e6))
    return turns.withColumn("_items", items).withColumn("window", F.transform(fresh, lambda x: x["event"])).drop("_items")


def last_n(history: Column, n: int) -> Column:
    """The last n of an array, or all of it if it is shorter."""
    return F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), n)


def sequences(turns: DataFrame, event: str = "event") -> DataFrame:
    """(session, events): every session's events in order, sessions of fewer than two left out."""
    s = turns.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", F.col(event).alias("e")))).alias("x"))
    return s.where(F.size("x") >= 2).select("session", F.transform("x", lambda x: x["e"]).alias("events"))
