"""Successor representations: tabular TD(0), the closed form, low rank, and the hybrid with a Markov predictor."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eta_at(eta: float, t: int) -> float:
    return eta / (1.0 + 0.01 * t)


@dataclass
class TabularSR:
    """Online TD(0) over seen events. gamma is kept in [0.001, 0.999], eta in [0.0001, 1], warmup at 1 at least."""

    gamma: float = 0.9
    eta: float = 0.1
    warmup: int = 50
    t: int = 0
    rows: dict = field(default_factory=dict)

    def __post_init__(self):
        self.gamma = min(max(self.gamma, 1e-3), 1 - 1e-3)
        self.eta = min(max(self.eta, 1e-4), 1.0)
        self.warmup = max(self.warmup, 1)

    def observe(self, prev: int, nxt: int) -> None:
        for e in (prev, nxt):
            self.rows.setdefault(e, {}).setdefault(e, 1.0)
        rate, follow, row = eta_at(self.eta, self.t), dict(self.rows[nxt]), self.rows[prev]
        for c in sorted(self.rows):
            old = row.get(c, 0.0)
            row[c] = old + rate * ((c == prev) + self.gamma * follow.get(c, 0.0) - old)
        self.t += 1

    def predict(self, context: list[int], k: int) -> list[tuple[int, float]]:
        if not context or k == 0 or context[-1] not in self.rows:
            return []
        last = context[-1]
        best = sorted(((max(v, 0.0), e) for e, v in self.rows[last].items() if e != last), key=lambda x: (-x[0], x[1]))[:k]
        total = sum(v for v, _ in best)
        return [(e, v / total) for v, e in best] if total > 0 else []

    def confidence(self) -> float:
        return min(self.t / self.warmup, 1.0)

    def renewed(self) -> TabularSR:
        return TabularSR(self.gamma, self.eta, self.warmup)

    def dump(self) -> dict:
        """Hyper-parameters, events seen and the table as triples."""
        rows = [{"source": s, "target": c, "value": v} for s, r in sorted(self.rows.items()) for c, v in sorted(r.items())]
        return {"gamma": self.gamma, "eta": self.eta, "t": self.t, "warmup": self.warmup, "vocab": sorted(self.rows), "rows": rows}

    @staticmethod
    def restore(saved: dict) -> TabularSR:
        m = TabularSR(saved["gamma"], saved["eta"], saved["warmup"], saved["t"], {e: {} for e in saved["vocab"]})
        for r in saved["rows"]:
            m.rows.setdefault(r["source"], {})[r["target"]] = r["value"]
        return m


class Hybrid:
    """SR where it is confident enough and has an answer, else Markov; both learn from every transition."""

    def __init__(self, sr, markov, threshold: float = 0.5):
        self.sr, self.markov, self.threshold = sr, markov, threshold

    def renewed(self) -> Hybrid:
        return Hybrid(self.sr.renewed(), self.markov.renewed(), self.threshold)

    def observe(self, prev: int, nxt: int) -> None:
        self.sr.observe(prev, nxt)
        self.markov.observe(prev, nxt)

    def predict(self, context: list[int], k: int):
        if self.sr.confidence() >= self.threshold:
            got = self.sr.predict(context, k)
            if got:
                return got
        return self.markov.predict(context, k)

    def confidence(self) -> float:
        return max(self.sr.confidence(), self.markov.confidence())


def train_td0(turns: DataFrame, gamma: float = 0.9, eta: float = 0.1, group: str = "session", event: str = "event_id") -> DataFrame:
    """(group, source, target, value) after TD(0) over each group's turns in order (ts, seq).

    TD(0) depends on the order, so a group is one task's fold; groups run in parallel.
    """

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ts", "ascending"), ("seq", "ascending")])
        m, e = TabularSR(gamma, eta), t["e"].to_pylist()
        for a, b in zip(e, e[1:]):
            m.observe(a, b)
        rows = [(s, c, v) for s, r in sorted(m.rows.items()) for c, v in sorted(r.items())]
        g = t["g"].slice(0, 1).combine_chunks()
        return pa.table([pa.array(g.to_pylist() * len(rows), g.type), *(pa.array(x, y) for x, y in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int32(), pa.float64())))], names=[group, "source", "target", "value"])

    kind = dict(turns.dtypes)[group]
    rows = turns.select(F.col(group).alias("g"), "ts", "seq", F.col(event).cast("int").alias("e"))
    return rows.groupBy("g").applyInArrow(fold, f"{group} {kind}, source int, target int, value double")


def transition_matrix(turns: DataFrame, event: str = "event_id") -> DataFrame:
    """(source, target, p): row-normalised counts of neighbouring events."""
    from .markov import in_order

    pairs = turns.withColumn("source", F.lag(event).over(in_order())).where("source IS NOT NULL").groupBy("source", F.col(event).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("source", "target", (F.col("n") / F.sum("n").over(Window.partitionBy("source"))).alias("p"))


def closed_form(matrix: DataFrame, gamma: float = 0.9, tolerance: float = 1e-12, dense: int = 1000) -> DataFrame:
    """(source, target, value) of (I - gamma T)^-1, the sum of all powers of gamma T; values of `tolerance` or less are left out.

    An order-free alternative to TD(0). The table has the square of the number of
    events at most, whatever the number of turns. Up to `dense` events the system is
    solved on the driver; beyond that the series is summed by doubling, in as many
    rounds of joins as it takes until what is left out is below the tolerance, with a
    checkpoint after each.
    """
    spark = matrix.sparkSession
    nodes = matrix.select(F.col("source").alias("n")).union(matrix.select("target")).distinct()
    names = sorted(r["n"] for r in nodes.limit(dense + 1).collect())
    kind = dict(matrix.dtypes)["source"]
    if len(names) <= dense:
        at, t = {e: i for i, e in enumerate(names)}, np.zeros((len(names), len(names)))
        for r in matrix.collect():  # at most the square of `dense` rows
            t[at[r["source"]], at[r["target"]]] += r["p"]
        m = np.linalg.solve(np.eye(len(names)) - gamma * t, np.eye(len(names)))
        x, y = np.nonzero(m > tolerance)
        e = np.array(names)
        out = pa.table({"source": e[x], "target": e[y], "value": m[x, y]}) if len(names) else pa.table({"source": pa.array([], pa.int64()), "target": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        return spark.createDataFrame(out).select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target"), "value")
    total = nodes.select(F.col("n").alias("source"), F.col("n").alias("target"), F.lit(1.0).alias("value"))
    power, left = matrix.select("source", "target", (F.col("p") * gamma).alias("value")), gamma / (1 - gamma)
    terms = 1
    while left > tolerance:
        total = total.unionByName(_product(power, total)).groupBy("source", "target").agg(F.sum("value").alias("value")).checkpoint()
        power = _product(power, power).checkpoint()
        terms *= 2
        left = gamma**terms / (1 - gamma)
    return total.where(F.col("value") > tolerance)


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two sparse matrices (source, target, value)."""
    b = b.select(F.col("source").alias("via"), F.col("target").alias("to"), F.col("value").alias("v"))
    return a.join(b, a["target"] == b["via"]).groupBy("source", F.col("to").alias("target")).agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def predict(table: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """(keys, source, rank, target, probability): of each source the k targets of largest value, itself excluded, clamped at 0 and normalised over those k; none if they sum to 0."""
    by = [*keys, "source"]
    t = table.where("source <> target").withColumn("v", F.greatest("value", F.lit(0.0)))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("v").desc(), "target"))).where(F.col("rank") <= k)
    total = F.sum("v").over(Window.partitionBy(*by))
    return t.withColumn("total", total).where("total > 0").select(*by, "rank", "target", (F.col("v") / F.col("total")).alias("probability"))


def bit_statistics(signatures: DataFrame, bits: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum of bits, sum of products of bits) over all signatures.

    Each partition makes its own 256 x 256 sum with one matrix product a batch; only
    those sums are shuffled and the driver gets one of them.
    """
    names = [f"s{w}" for w in range(bits // 64)]

    def part(batches):
        n, s, x = 0, np.zeros(bits), np.zeros((bits, bits))
        for b in batches:
            m = unpack(np.stack([b.column(c).to_numpy() for c in names], axis=1).astype(np.int64)).astype(np.float32)
            n, s, x = n + len(m), s + m.sum(axis=0), x + (m.T @ m)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["n", "s", "x"])

    def merge(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(v.as_buffer()) for v in t["s"])
        x = sum(np.frombuffer(v.as_buffer()) for v in t["x"])
        return pa.table([pa.array([sum(t["n"].to_pylist())], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["n", "s", "x"])

    schema = "n bigint, s binary, x binary"
    parts = signatures.select(*names).mapInArrow(part, schema)
    # a first round of partial sums keeps the last merge small
    some = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("g").applyInArrow(lambda t: merge(t.drop_columns("g")), schema)
    row = some.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(lambda t: merge(t.drop_columns("g")), schema).first()
    if row is None:
        return 0, np.zeros(bits), np.zeros((bits, bits))
    return row["n"], np.frombuffer(bytes(row["s"])), np.frombuffer(bytes(row["x"])).reshape(bits, bits)


def unpack(words: np.ndarray) -> np.ndarray:
    """Bits (0/1) of signatures given as rows of int64 words, first dimension first."""
    return np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(words), -1), axis=1)


def principal_components(n: int, s: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components bits x k, eigenvalues) of the population covariance; components whose eigenvalue is below 1e-9 are zero, the largest loading is positive."""
    mean = s / max(n, 1)
    values, vectors = np.linalg.eigh(x / max(n, 1) - np.outer(mean, mean))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    vectors[:, values < 1e-9] = 0
    return mean, vectors, values


class LowRankSR:
    """TD(0) on K features of event centroids: M is K x K, whatever the number of events.

    `projection` is bits x K; by default +-1/sqrt(K) drawn with a seed. Unknown
    events change nothing. Confidence is warmth times at most the spectral gap of M.
    """

    def __init__(self, k: int = 32, bits: int = 256, gamma: float = 0.9, eta: float = 0.05, warmup: int = 50, projection: np.ndarray | None = None, mean: np.ndarray | None = None, seed: int = 11, identity: bool = True):
        self.k, self.gamma, self.eta, self.warmup, self.t = k, min(max(gamma, 1e-3), 1 - 1e-3), min(max(eta, 1e-4), 1.0), warmup, 0
        self.normal = projection is not None
        self.projection = projection if projection is not None else np.where(np.random.default_rng(seed).random((bits, k)) < 0.5, -1.0, 1.0) / np.sqrt(k)
        self.mean = np.zeros(bits) if mean is None else mean
        self.m = np.eye(k) if identity else np.zeros((k, k))
        self.features: dict[int, np.ndarray] = {}
        self.gap = 0.0

    def set_centroid(self, event: int, bits: np.ndarray) -> None:
        f = (np.asarray(bits, float) - self.mean) @ self.projection
        n = np.linalg.norm(f)
        self.features[event] = f / n if self.normal and n >= 1e-9 else f

    def observe(self, prev: int, nxt: int) -> None:
        p, q = self.features.get(prev), self.features.get(nxt)
        if p is None or q is None:
            return
        self.m += eta_at(self.eta, self.t) * np.outer(p + self.gamma * (self.m @ q) - self.m @ p, p)
        self.t += 1
        if self.t % 25 == 0:
            self.gap = spectral_gap(self.m)

    def observe_counts(self, counts: list[tuple[int, int, int]], rounds: int = 200) -> None:
        """Counted transitions (prev, next, n) in `rounds` interleaved passes, whatever their number: each pass steps along the mean change."""
        rows = [(self.features[p], self.features[q], n) for p, q, n in counts if p in self.features and q in self.features]
        if not rows:
            return
        p, q, n = (np.array(x, float) for x in zip(*rows))
        n /= n.sum()
        for _ in range(rounds):
            delta = p + self.gamma * q @ self.m.T - p @ self.m.T
            self.m += eta_at(self.eta, self.t) * (delta * n[:, None]).T @ p
            self.t += 1
        self.gap = spectral_gap(self.m)

    def predict(self, context: list[int], k: int) -> list[tuple[int, float]]:
        if not context or k == 0 or context[-1] not in self.features:
            return []
        last = context[-1]
        y = self.m @ self.features[last]
        best = sorted(((max(float(f @ y), 0.0), e) for e, f in self.features.items() if e != last), key=lambda x: (-x[0], x[1]))[:k]
        total = sum(v for v, _ in best)
        return [(e, v / total) for v, e in best] if total > 0 else []

    def confidence(self) -> float:
        if self.warmup == 0:
            return 1.0
        return min(min(self.t / self.warmup, 1.0), max(self.gap, 0.05))

    def dump(self) -> dict:
        return {"k": self.k, "t": self.t, "gamma": self.gamma, "eta": self.eta, "warmup": self.warmup, "gap": self.gap, "normal": self.normal, "m": self.m.ravel().tolist()}

    def load(self, saved: dict) -> None:
        """Takes over a saved M and counters; another K or length is an error."""
        if saved["k"] != self.k or len(saved["m"]) != self.k**2:
            raise ValueError("saved model has another rank")
        self.m, self.t, self.gap = np.array(saved["m"]).reshape(self.k, self.k), saved["t"], saved["gap"]


def spectral_gap(m: np.ndarray, rounds: int = 40) -> float:
    """(|l0| - |l1|) / |l0| of the two leading eigenvalues by power iteration with deflation, from a fixed start."""

    def lead(a: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
        v = np.random.default_rng(seed).uniform(-1, 1, len(a))
        for _ in range(rounds):
            v = a @ v
            n = np.linalg.norm(v)
            v = v / n if n >= 1e-9 else v
        return float(v @ a @ v), v

    first, v = lead(m, 1)
    second, _ = lead(m - first * np.outer(v, v), 2)
    return abs(abs(first) - abs(second)) / (abs(first) + 1e-9)
