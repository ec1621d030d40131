"""Dense vectors and signatures from texts and tokens."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import hashing as H
from parley.functions import signature as S
from parley.functions import text as T
from parley.session import small_batches


class Embedder(Protocol):
    """Texts to vectors of `dim` numbers, a batch at a time; any model may stand behind it."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class RemoteEmbedder:
    """An embedder behind a request: `post(texts, timeout_s)` gives {"index", "embedding"} items, in any order.

    Items are put in the order of the texts; a missing, repeated or surplus one is an
    error, as is a vector of another length. A request that fails is repeated
    `retries` times, waiting twice as long each time.
    """

    def __init__(self, post, dim: int, timeout_s: float = 30.0, retries: int = 2, wait_s: float = 0.5):
        self.post, self.dim, self.timeout_s, self.retries, self.wait_s = post, dim, timeout_s, retries, wait_s

    def embed(self, texts: list[str]) -> np.ndarray:
        import time

        for attempt in range(self.retries + 1):
            try:
                items = self.post(texts, self.timeout_s)
                break
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait_s * 2**attempt)
        if sorted(x["index"] for x in items) != list(range(len(texts))):
            raise ValueError(f"embedder gave {len(items)} items for {len(texts)} texts")
        out = [x["embedding"] for x in sorted(items, key=lambda x: x["index"])]
        if any(len(v) != self.dim for v in out):
            raise ValueError(f"embedder gave vectors of other lengths than {self.dim}")
        return np.array(out, np.float32).reshape(len(texts), self.dim)


def embed_with(df: DataFrame, embedder: Embedder, text: str = "text", batch: int = 256) -> DataFrame:
    """Adds `vector` from an embedder, in Arrow batches cut into `batch` texts; count and dimension are checked."""
    import pandas as pd

    dim = embedder.dim

    @F.pandas_udf("array<float>")
    def run(texts):
        out = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].fillna("").tolist()
            v = np.asarray(embedder.embed(part), np.float32)
            if v.shape != (len(part), dim):
                raise ValueError(f"embedder gave {v.shape}, expected {(len(part), dim)}")
            out.extend(v)
        return pd.Series(out, dtype=object)

    return df.withColumn("vector", run(text))


def spread(df: DataFrame, task_bytes: int = 8 << 20) -> DataFrame:
    """Small inputs over all cores, as a file of one row group is one task's otherwise; what has `task_bytes` for each core stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= cores * task_bytes:
        return df
    return df.repartition(cores)


def _words(text: str) -> Column:
    """A lowered text cut at what isn't a letter or digit; empty words are left out later."""
    return F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")


def hashed_components(df: DataFrame, key: str, text: str = "text", dim: int = 256, seed: int = 7, bands: int = 4, use_bigrams: bool = True, drop_stop_words: bool = True) -> DataFrame:
    """(key, pos, value): the non-empty components of each row's hashed embedding, before normalisation.

    Rows are hashed within the row, in Arrow batches, and nothing is shuffled; rows
    that repeat a key have components each. A null text has none.
    """
    stop = T.STOP_WORDS if drop_stop_words else []
    small_batches(df.sparkSession)

    @F.arrow_udf("array<struct<pos:int,value:bigint>>")
    def run(words: pa.Array) -> pa.Array:
        pos, value, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, total, hits in H.components(words, dim, seed, bands, use_bigrams, stop):
            row, at = np.nonzero(hits)
            pos.append(at)
            value.append(total[row, at])
            size.append(np.bincount(row, minlength=len(total)))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(value))], names=["pos", "value"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(size)).astype(np.int32)), pairs)

    return spread(df.select(key, text)).select(key, F.explode(run(_words(text))).alias("c")).select(key, F.col("c.pos").alias("pos"), F.col("c.value").alias("value"))


def hashed_embedding(df: DataFrame, key: str, text: str = "text", dim: int = 256, **options) -> DataFrame:
    """(key, pos, value) with every embedding of length one; an embedding of length below 1e-9 stays as it is."""
    c = hashed_components(df, key, text, dim, **options)  # keys must be unique here, as lengths are taken by key
    norm = F.sqrt(F.sum(F.col("value").cast("double") * F.col("value")).over(Window.partitionBy(key)))
    return c.select(key, "pos", F.when(norm > 1e-9, F.col("value") / norm).otherwise(F.col("value").cast("double")).alias("value"))


def signature_of(text: str, bits: int = 256, use_bigrams: bool = True, drop_stop_words: bool = True, **options) -> Column:
    """A struct of the words s0, ... of a text's signature. Components of zero set their bit, so a text without features is all ones.

    Nothing is shuffled: each row's components live in its Arrow batch only.
    """
    stop, names = T.STOP_WORDS if drop_stop_words else [], S.word_names(bits)

    @F.arrow_udf("struct<" + ",".join(f"{w}:bigint" for w in names) + ">")
    def run(words: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in H.signature_words(words, bits, bigrams=use_bigrams, stop=stop, **options)], names=names)

    return run(_words(text))


def text_signature(df: DataFrame, key: str, text: str = "text", bits: int = 256, **options) -> DataFrame:
    """(key, s0, ...): signatures of texts, each row's by itself."""
    small_batches(df.sparkSession)
    return spread(df.select(key, text)).select(key, signature_of(text, bits, **options).alias("_signature")).select(key, *[F.col(f"_signature.{w}").alias(w) for w in S.word_names(bits)])


def bigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(bigram, n): how often each bigram of words that aren't stop words occurs.

    They are made and counted batch by batch in Arrow and added up after a shuffle: most
    occur once, so a task that counts its own beforehand holds nearly all of them.
    """
    stop = T.STOP_WORDS
    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            values, counts = H.bigrams(b.column(0), stop)
            yield pa.RecordBatch.from_arrays([values, counts], names=["bigram", "n"])

    return spread(df.select(text)).select(_words(text).alias("words")).mapInArrow(run, "bigram string, n bigint").repartition("bigram").groupBy("bigram").agg(F.sum("n").alias("n"))


def random_projection(source_dim: int, bits: int = 256, seed: int = 7) -> np.ndarray:
    """bits x source_dim matrix of +-1/sqrt(source_dim) from MD5 of seed, row and column."""
    import hashlib

    sign = [[1.0 if int(hashlib.md5(f"{seed}|{i}|{j}".encode()).hexdigest()[8], 16) >= 8 else -1.0 for j in range(source_dim)] for i in range(bits)]
    return np.array(sign) / np.sqrt(source_dim)


def project(df: DataFrame, vector: str, matrix: np.ndarray, out: str = "projected") -> DataFrame:
    """Adds matrix x vector, in Arrow batches; the matrix travels in the closure, as it has the model's size. A wrong dimension is an error."""
    import pandas as pd

    m = np.ascontiguousarray(matrix, np.float64)

    @F.pandas_udf("array<double>")
    def run(v):
        x = np.stack([np.asarray(y, np.float64) for y in v]) if len(v) else np.zeros((0, m.shape[1]))
        if x.shape[1] != m.shape[1]:
            raise ValueError(f"expected {m.shape[1]} dimensions, got {x.shape[1]}")
        return pd.Series(list(x @ m.T), dtype=object)

    return df.withColumn(out, run(vector))


def random_index_base(tokens: DataFrame, token: str = "token", dim: int = 256, nonzero: int = 16, seed: int = 7) -> DataFrame:
    """(token, pos, sign): base vectors with nonzero/2 ones and as many minus ones, at places drawn by hash.

    Draw k of a token may hit the place of an earlier one, so draws go on until
    `nonzero` places differ; places come in the order of their draws.
    """
    if nonzero % 2 or not 0 < nonzero <= dim:
        raise ValueError("nonzero must be even, positive and at most dim")
    distinct = tokens.select(token).distinct()
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda p: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), F.col(token), F.lit("|"), p.cast("string"))).alias("h"), p.alias("pos"))))
    chosen = distinct.select(token, F.posexplode(F.slice(ranked, 1, nonzero)).alias("k", "x"))
    return chosen.select(token, F.col("x.pos").alias("pos"), F.when(F.col("k") < nonzero // 2, 1).otherwise(-1).alias("sign"))


def random_index_signature(occurrences: DataFrame, base: DataFrame, key: str, token: str = "token", bits: int = 256) -> DataFrame:
    """(key, s0, ...) of the summed base vectors of each key's tokens; unknown tokens are skipped. Here only components above zero set a bit.

    If the base has more than `bits` dimensions, the `bits` components of largest
    size (ties: lower place) are packed in order of place.
    """
    total = occurrences.join(base, token).groupBy(key, "pos").agg(F.sum("sign").alias("value"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("value").desc(), "pos"))
    kept = total.withColumn("r", rank).where(F.col("r") <= bits)
    wide = kept.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1) if (base.agg(F.max("pos")).first()[0] or 0) >= bits else kept.withColumn("slot", F.col("pos"))
    bit = F.when(F.col("value") > 0, S.shl(F.lit(1).cast("bigint"), (63 - F.col("slot") % 64).cast("int"))).otherwise(0)
    words = wide.groupBy(key).agg(*[F.bit_or(F.when(F.floor(F.col("slot") / 64) == w, bit).otherwise(0)).alias(f"n{w}") for w in range(bits // 64)])
    return occurrences.select(key).distinct().join(words, key, "left").select(key, *[F.coalesce(f"n{w}", F.lit(0).cast("bigint")).alias(f"s{w}") for w in range(bits // 64)])


def majority_signature(df: DataFrame, by: str, bits: int = 256) -> DataFrame:
    """(by, s0, ...): centroid of each group's signatures, bit by bit the majority, ties one. One partial aggregate, no per-bit pass."""
    words = S.word_names(bits)
    count = [F.sum(S.get_bit(words, i)).alias(f"c{i}") for i in range(bits)]
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *count)

    def word(w: int):
        out = F.lit(0).cast("bigint")
        for i in range(64):
            out = out.bitwiseOR(F.when(F.col(f"c{64 * w + i}") * 2 >= F.col("n"), S.shl(F.lit(1).cast("bigint"), 63 - i)).otherwise(F.lit(0).cast("bigint")))
        return out.alias(f"s{w}")

    return c.select(by, *[word(w) for w in range(bits // 64)])
