"""Events: their ids, which rows belong to them, and the rows of sets of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT = "_default"


def event_of(column: str) -> Column:
    return F.coalesce(column, F.lit(DEFAULT))


def event_dim(corpus: DataFrame, event: str = "event") -> DataFrame:
    """(event_id, name): ids are places in the sorted names; a missing name is `_default`. The names are few, so one window ranks them."""
    names = corpus.select(event_of(event).alias("name")).distinct()
    return names.select((F.row_number().over(Window.orderBy("name")) - 1).alias("event_id"), "name")


def doc_event(corpus: DataFrame, events: DataFrame, event: str = "event") -> DataFrame:
    """(doc_idx, event_id) of a corpus (doc_idx, event)."""
    return corpus.select("doc_idx", event_of(event).alias("name")).join(events, "name").select("doc_idx", "event_id")


def single_event(bridge: DataFrame) -> DataFrame:
    """(doc_idx, event_id): of a row's several events the greatest."""
    return bridge.groupBy("doc_idx").agg(F.max("event_id").alias("event_id"))


def scope(bridge: DataFrame, events: list[int]) -> DataFrame:
    """Distinct rows (doc_idx) of a set of events."""
    return bridge.where(F.col("event_id").isin(events)).select("doc_idx").distinct()


def inverted_list(bridge: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(event_id, block, rows): the sorted rows of each event, in blocks of `block` ids, so that no list grows with the event."""
    return bridge.groupBy("event_id", F.floor(F.col("doc_idx") / block).alias("block")).agg(F.array_sort(F.collect_set("doc_idx")).alias("rows"))


def worth_keeping(bridge: DataFrame, least: int = 1024) -> DataFrame:
    """(event_id, rows) of events with at least `least` rows: those of which an index or a cached copy is worth its cost; others are scanned."""
    return bridge.groupBy("event_id").agg(F.count_distinct("doc_idx").alias("rows")).where(F.col("rows") >= least)


def event_names(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions (with event_id) with the event's `name`; unknown events are left out."""
    return predictions.join(events.select("event_id", "name"), "event_id")


def scope_key(events: Column) -> Column:
    """Hash of a set of events, in whatever order and however often they come."""
    return F.xxhash64(F.array_sort(F.array_distinct(events)))
