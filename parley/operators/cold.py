"""The cold tier: an append-only store of old signatures, and rank/select over bit vectors."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import signature as S
from parley.operators import search

COMPACT_AT = 256


def pack_value(event: Column, doc: Column) -> Column:
    """event << 32 | doc (the low 32 bits of doc)."""
    return S.shl(event.cast("bigint"), 32).bitwiseOR(doc.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_value(value: Column) -> tuple[Column, Column]:
    return S.shru(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF))


class Cold(Protocol):
    """What a cold tier offers, whatever keeps its rows: (insert_seq, s0, ..., value)."""

    def rows(self) -> DataFrame: ...

    def append(self, rows: DataFrame) -> None: ...

    def nearest(self, query: list[int], k: int) -> DataFrame: ...

    def within(self, query: list[int], r: int) -> DataFrame: ...


class ColdTier:
    """Signatures (insert_seq, s0, ..., value) in a folder: `base` and appended `tail` parts, compacted when the tail is long."""

    def __init__(self, spark: SparkSession, path: str, bits: int = 256):
        self.spark, self.path, self.bits = spark, path.rstrip("/"), bits

    def _schema(self) -> str:
        return "insert_seq bigint, " + ", ".join(f"{w} bigint" for w in S.word_names(self.bits)) + ", value bigint"

    def _read(self, part: str) -> DataFrame:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(f"{self.path}/{part}")

    def rows(self) -> DataFrame:
        """Base and tail together."""
        return self._read("base").unionByName(self._read("tail"))

    def append(self, rows: DataFrame, compact_at: int = COMPACT_AT) -> None:
        """Adds (s0, ..., event_id, doc_idx, ordinal), in order of `ordinal`, after all earlier rows; compacts a tail of `compact_at` rows."""
        start = self.rows().agg(F.coalesce(F.max("insert_seq") + 1, F.lit(0))).first()[0]
        new = rows.select((F.col("ordinal") + start).cast("bigint").alias("insert_seq"), *S.word_names(self.bits), pack_value(F.col("event_id"), F.col("doc_idx")).alias("value"))
        new.write.mode("append").parquet(f"{self.path}/tail")
        if self._read("tail").count() >= compact_at:
            self.compact()

    def compact(self) -> None:
        """Rewrites base and tail as a new base; readers of the old files keep working until they are swapped."""
        self.rows().write.mode("overwrite").parquet(f"{self.path}/next")
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = lambda x: fs.Path(f"{self.path}/{x}")
        h = p("next").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        h.delete(p("base"), True)
        h.rename(p("next"), p("base"))
        h.delete(p("tail"), True)

    def nearest(self, query: list[int], k: int) -> DataFrame:
        return nearest(self.rows(), query, k)

    def within(self, query: list[int], r: int) -> DataFrame:
        return within(self.rows(), query, r)


def _hits(store: DataFrame, query: list[int]) -> DataFrame:
    event, doc = unpack_value(F.col("value"))
    return store.select("insert_seq", S.hamming([f"s{w}" for w in range(len(query))], query).alias("distance"), event.alias("event_id"), doc.alias("doc_idx"))


def nearest(store: DataFrame, query: list[int], k: int) -> DataFrame:
    """The k nearest of a store (insert_seq, s0, ..., value): (insert_seq, distance, event_id, doc_idx); ties by insertion."""
    return _hits(store, query).orderBy("distance", "insert_seq").limit(max(k, 0))


def nearest_of(queries: DataFrame, store: DataFrame, k: int, bits: int) -> DataFrame:
    """(query_id, rank, insert_seq, distance, event_id, doc_idx): `nearest` for every query (query_id, q0, ...)."""
    near = search.knn_join(queries, store.withColumnRenamed("insert_seq", "doc_idx"), k, bits).withColumnRenamed("doc_idx", "insert_seq")
    event, doc = unpack_value(F.col("value"))
    return near.join(store.select("insert_seq", event.alias("event_id"), doc.alias("doc_idx")), "insert_seq")


def within_of(queries: DataFrame, store: DataFrame, r: int, bits: int) -> DataFrame:
    """(query_id, insert_seq, distance, event_id, doc_idx): `within` for every query (query_id, q0, ...)."""
    near = search.radius_of(queries, store.withColumnRenamed("insert_seq", "doc_idx"), r, bits).withColumnRenamed("doc_idx", "insert_seq")
    event, doc = unpack_value(F.col("value"))
    return near.join(store.select("insert_seq", event.alias("event_id"), doc.alias("doc_idx")), "insert_seq")


def within(store: DataFrame, query: list[int], r: int) -> DataFrame:
    """All rows within r bits, r included."""
    return _hits(store, query).where(F.col("distance") <= r)


def with_tier(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot and cold results (distance, doc_idx) side by side, told apart by `tier`; they are never merged."""
    pick = lambda d, t: d.select(F.lit(t).alias("tier"), "distance", "doc_idx")
    return pick(hot, "hot").unionByName(pick(cold, "cold"))


def bit_sliced(store: DataFrame, bits: int, block: int = 64) -> DataFrame:
    """(bit, word_idx, word): the store turned by 90 degrees; bit j of a word is the row with insert_seq = 64 word_idx + j, least significant first."""
    words = S.word_names(bits)
    each = store.select("insert_seq", F.posexplode(S.bits_of(words)).alias("bit", "on"))
    at = S.shl(F.col("on").cast("bigint"), (F.col("insert_seq") % block).cast("int"))
    return each.groupBy("bit", F.floor(F.col("insert_seq") / block).alias("word_idx")).agg(F.bit_or(at).alias("word"))


def with_prefix(vector: DataFrame, by: list[str] = (), chunk: int = 1 << 16) -> DataFrame:
    """A bit vector (word_idx, word; 64 bits each, least significant first) with `ones` before each word.

    Two levels, as in a rank directory: running sums within chunks of words, which
    are tasks of their own, and over the chunks' totals, which are few.
    """
    by = list(by)
    v = vector.withColumn("_chunk", F.floor(F.col("word_idx") / chunk))
    over = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = v.groupBy(*by, "_chunk").agg(F.sum(F.bit_count("word")).alias("_sum")).select(*by, "_chunk", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_chunk").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("ones", F.coalesce(F.sum(F.bit_count("word")).over(inside), F.lit(0)))
    return v.join(totals, [*by, "_chunk"]).withColumn("ones", F.col("ones") + F.col("_before")).select(vector.columns + ["ones"])


def rank(vector: DataFrame, positions: DataFrame, length: int) -> DataFrame:
    """(i, rank1, rank0) for positions (i): ones and zeros among the first i bits; i is clamped to 0 .. length."""
    v = with_prefix(vector)
    p = positions.select("i", F.least(F.greatest("i", F.lit(0)), F.lit(length)).alias("at")).withColumn("word_idx", F.floor(F.col("at") / 64))
    total = v.agg(F.sum(F.bit_count("word")).alias("all"))
    j = p.join(v, "word_idx", "left").crossJoin(total)
    below = F.bitwise_not(S.shl(F.lit(-1).cast("bigint"), (F.col("at") % 64).cast("int")))
    one = F.coalesce(F.col("ones") + F.bit_count(F.col("word").bitwiseAND(below)), F.col("all"), F.lit(0))
    return j.select("i", one.alias("rank1"), (F.col("at") - one).alias("rank0"))


def select(vector: DataFrame, ordinals: DataFrame, length: int, ones: bool = True) -> DataFrame:
    """(j, position) of the j-th one (or zero), j from 1; null where there are fewer."""
    v = with_prefix(vector)
    word = F.col("word") if ones else F.bitwise_not("word")
    before = F.col("ones") if ones else 64 * F.col("word_idx") - F.col("ones")
    bits = v.select(F.col("word_idx"), word.alias("w"), before.alias("b"))
    spread = bits.select("word_idx", "w", "b", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where((S.shru("w", F.col("bit")).bitwiseAND(F.lit(1)) == 1) & (64 * F.col("word_idx") + F.col("bit") < length))
    below = F.bitwise_not(S.shl(F.lit(-1).cast("bigint"), F.col("bit")))
    numbered = spread.select((F.col("b") + F.bit_count(F.col("w").bitwiseAND(below)) + 1).alias("j"), (64 * F.col("word_idx") + F.col("bit")).alias("position"))
    return ordinals.join(numbered, "j", "left")
