"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a document are presence indicators of its words, word pairs and
pairs that skip one word, hashed to 2**BITS places. Training is McMahan et al.'s
FTRL-Proximal: every coordinate has its own learning rate, and the L1 term
leaves most weights at exactly zero, so the model that travels to the executors
is a short list of (place, weight).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernel as K

BITS = 18
U64 = np.uint64


def grams(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every n-gram and skip-gram of a chunk, with repetitions."""
    h, d = words.hash, words.doc
    docs, codes = [d], [K.mix(h ^ U64(1))]
    for gap, salt in ((1, 2), (2, 3)):
        if len(h) > gap:
            same = d[gap:] == d[:-gap]
            docs.append(d[gap:][same])
            codes.append(K.mix(h[:-gap][same] * U64(3) + h[gap:][same] * U64(5) + U64(salt)))
    return np.concatenate(docs), (np.concatenate(codes) >> U64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features; a bias is the last coordinate and isn't regularised."""

    def __init__(self, alpha=1.0, beta=1.0, l1=8.0, l2=0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def examples(texts) -> list[np.ndarray]:
    """Distinct places of each text, the bias last."""
    out = []
    for row, end, words in K.tokenised(texts, "ALNUM"):
        d, p = grams(words)
        key = np.unique(d << BITS | p)
        edge = np.searchsorted(key, np.arange(end - row + 1) << BITS)
        place = (key & ((1 << BITS) - 1)).astype(np.int32)
        out += [np.append(place[edge[i] : edge[i + 1]], np.int32(1 << BITS)) for i in range(end - row)]
    return out


def fit(texts, labels: np.ndarray, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights (all of them non-zero; the bias is place 2**BITS)."""
    rows, model, rng = examples(texts), Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.learn(rows[i], int(labels[i]))
    w = model.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w)
    return at, w[at].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> DataFrame:
    """One row (places BINARY int32, weights BINARY float32) learnt from at most `max_rows` labelled documents.

    The bound keeps training in one task whatever the size of the corpus; the
    rows taken are the least by a hash of their doc_id, so any size gives a
    uniform sample. Rows without id, label or text are left out; a doc_id with
    several labels counts as toxic if one of them says so. No labels give a model
    of no weights, which rejects nothing.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # bounded by max_rows, so broadcasting it is safe at any size of the corpus
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def learn(batches):
        got = [b for b in batches if b.num_rows]
        at, w = np.zeros(0, np.int64), np.zeros(0, np.float32)
        if got:
            t = pa.Table.from_batches(got)
            t = t.take(pc.sort_indices(t.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]))
            got.clear()
            at, w = fit(t["text"], t["label"].to_numpy(), **options)
            del t
            K.trim()
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["places", "weights"])

    return rows.repartition(1).mapInArrow(learn, "places binary, weights binary")


class Model:
    """Compact weights, made dense for scoring."""

    def __init__(self, places: bytes, weights: bytes):
        self.places, self.weights = places, weights
        self._dense = None

    def dense(self) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros((1 << BITS) + 1, np.float32)
            self._dense[np.frombuffer(self.places, "<i4")] = np.frombuffer(self.weights, "<f4")
        return self._dense

    def score(self, texts) -> np.ndarray:
        """Probability of each text; 0 under a model without any weight, which has learnt nothing."""
        if not self.weights:
            return np.zeros(len(texts))
        w, out = self.dense(), []
        for row, end, words in K.tokenised(texts, "ALNUM"):
            d, p = grams(words)
            on = np.flatnonzero(w[p])
            key = np.unique(d[on] << BITS | p[on])
            logit = np.bincount(key >> BITS, w[key & ((1 << BITS) - 1)].astype(np.float64), minlength=end - row) + float(w[1 << BITS])
            out.append(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


def probability(model: DataFrame):
    """The model as a function from a text column to a probability column; null for null."""
    common.small_batches(model.sparkSession)
    sent = model.sparkSession.sparkContext.broadcast(tuple(map(bytes, model.first() or (b"", b""))))  # some kilobytes; without any labels there is no row

    @F.pandas_udf("double")
    def of(text):
        import pandas as pd

        column = pa.array(text, pa.string(), from_pandas=True)
        out = pd.Series(Model(*sent.value).score(column)).round(6).mask(text.isna().to_numpy())
        K.trim()
        return out

    return of


def score(docs: DataFrame, model: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, toxic) of every row.

    Whole texts are scored, of any length. A null text has a null score and isn't
    toxic; an empty text has the bias alone. Equal texts score equally. Other
    columns are ignored; an empty table gives no rows.
    """
    out = docs.select("doc_id", probability(model)("text").alias("score"))
    return out.withColumn("toxic", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def drop_toxic(docs: DataFrame, model: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that aren't toxic, null texts among them, with all their columns."""
    return docs.where(F.coalesce(probability(model)("text") < threshold, F.lit(True)))
