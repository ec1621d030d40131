"""The per-session operator: drift gate, speculation, fuzzy result cache, finalize, warm-next, reset.

The state machine is plain Python over numpy, free of Spark, and is run in two
ways: `replay` folds finite logs session by session, `stream` keeps it as state of
a Structured Streaming query. Both give the same rows for the same log.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import worker_cache
from parley.functions import signature as S

GATE, CACHE_TOLERANCE, CACHE_ENTRIES, ACCEPT = 24, 16, 64, 16
WINDOW, MAX_AGE_S = 8, 60.0


def ham(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.bitwise_count(a ^ b).sum())


@dataclass(frozen=True)
class Scope:
    """The rows of a set of events: which events, and how many rows."""

    events: tuple[int, ...] = ()
    size: int = 0

    def __len__(self):
        return self.size


#: Rows whose distances are worked out at once: few enough for a core's cache.
SCAN_ROWS = 1 << 15


class Index:
    """Signatures and events of a corpus, in memory: `words` (n x words, uint64), `doc` (ascending ids), `event` (-1 for none).

    For scans the words lie column by column, the rows of an event next to each other.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, event: np.ndarray):
        order = np.argsort(doc, kind="stable")
        self.words, self.doc, self.event = words[order], doc[order], event[order]
        self.place = np.argsort(self.event, kind="stable")
        self.columns = [np.ascontiguousarray(self.words[self.place, w]) for w in range(self.words.shape[1])]
        ids, first = np.unique(self.event[self.place], return_index=True)
        self.spans = {int(e): (int(a), int(b)) for e, a, b in zip(ids, first, np.append(first[1:], len(self.doc))) if e >= 0}
        self.distance = np.zeros(len(self.doc), np.uint16)  # of the query of the day
        self.cells, self.counts = np.zeros(min(SCAN_ROWS, len(self.doc)), np.uint64), np.zeros(min(SCAN_ROWS, len(self.doc)), np.uint8)

    def _measure(self, query: np.ndarray, spans: list[tuple[int, int]]) -> None:
        """The distances of the rows of `spans` to a query."""
        for first, last in spans:
            for a in range(first, last, SCAN_ROWS):
                b = min(last, a + SCAN_ROWS)
                cells, counts, total = self.cells[: b - a], self.counts[: b - a], self.distance[a:b]
                total[:] = 0
                for column, word in zip(self.columns, query):
                    np.bitwise_xor(column[a:b], word, out=cells)
                    np.bitwise_count(cells, out=counts)
                    np.add(total, counts, out=total)

    def _least(self, k: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(distance, row) of the k nearest of the measured rows of `spans`; what is kept on the way is what the k nearest so far don't rule out."""
        if k <= 0:
            return []
        bound, held, far, rows = None, 0, [], []
        for first, last in spans:
            for a in range(first, last, SCAN_ROWS):
                d = self.distance[a : min(last, a + SCAN_ROWS)]
                if bound is None and len(d) > k:
                    bound = np.partition(d, k - 1)[k - 1]
                at = np.flatnonzero(d <= bound) if bound is not None else np.arange(len(d))
                far.append(d[at])
                rows.append(self.place[a + at])
                held += len(at)
                if held > 8 * k + 1024:
                    d, at = np.concatenate(far), np.concatenate(rows)
                    bound = np.partition(d, k - 1)[k - 1]
                    on = d <= bound
                    far, rows, held = [d[on]], [at[on]], int(on.sum())
        if not held:
            return []
        d, at = np.concatenate(far), np.concatenate(rows)
        best = np.lexsort((at, d))[:k]
        return list(zip(d[best].tolist(), at[best].tolist()))

    def _spans(self, scope: Scope | None) -> list[tuple[int, int]]:
        return [(0, len(self.doc))] if scope is None else [self.spans[e] for e in scope.events]

    def top_k(self, query: np.ndarray, k: int, scope: Scope | None = None) -> list[tuple[int, int]]:
        """(distance, row) of the k nearest, ties to the lower row; in the given scope, or in all."""
        if k <= 0:
            return []
        spans = self._spans(scope)
        self._measure(query, spans)
        return self._least(k, spans)

    def scope(self, events: list[int]) -> Scope:
        known = tuple(dict.fromkeys(int(e) for e in events if e in self.spans))
        return Scope(known, sum(b - a for a, b in map(self.spans.get, known)))

    def search(self, query: np.ndarray, k: int, coarse_k: int, max_events: int) -> tuple[list, int, bool]:
        """Hierarchical search: (results, scope size, whether shards were used)."""
        if k == 0 or not len(self.doc):
            return [], 0, False
        coarse = self.top_k(query, max(coarse_k, k))
        if len(self.spans) <= 1:
            return coarse[:k], len(self.doc), False
        events: list[int] = []
        for _, r in coarse[: max(4 * k, 1)]:
            e = int(self.event[r])
            if e >= 0 and e not in events:
                events.append(e)
                if len(events) >= max(max_events, 1):
                    break
        scope = self.scope(events)
        if not len(scope):
            return coarse[:k], len(self.doc), False
        return self._least(k, self._spans(scope)), len(scope), True  # all rows are measured


@dataclass
class Pending:
    """Results that are looked for when they are needed: most of what is speculated or cached never is."""

    query: np.ndarray
    k: int
    scope: Scope
    fallback: bool
    coarse_k: int
    max_events: int
    found: tuple[list, int, bool] | None = None

    def get(self, index: Index) -> tuple[list, int, bool]:
        """(results, scope size, whether shards were used)."""
        if self.found is None:
            if len(self.scope) and not (self.fallback and len(self.scope) < self.k):
                self.found = index.top_k(self.query, self.k, self.scope), len(self.scope), True
            else:
                self.found = index.search(self.query, self.k, self.coarse_k, self.max_events)
        return self.found


def _told(results, index: Index) -> list:
    return results.get(index)[0] if isinstance(results, Pending) else results


class DeltaCache:
    """Results by (set of events, k, near query); the least recently used entry of a full set goes."""

    def __init__(self, tolerance: int = CACHE_TOLERANCE, entries: int = CACHE_ENTRIES):
        self.tolerance, self.entries, self.clock, self.sets = tolerance, entries, 0, {}
        self.stats = dict.fromkeys(("lookups", "hits", "misses", "inserts", "evictions"), 0)

    def lookup(self, events, query: np.ndarray, k: int):
        """The nearest entry within the tolerance, the earliest of equally near ones."""
        self.clock += 1
        self.stats["lookups"] += 1
        best = None
        for entry in self.sets.get(frozenset(events), []):
            if entry[2] == k and (d := ham(entry[0], query)) <= self.tolerance and (best is None or d < best[0]):
                best = d, entry
        self.stats["hits" if best else "misses"] += 1
        if best is None:
            return None
        best[1][3] = self.clock
        return best[1][1] if isinstance(best[1][1], Pending) else list(best[1][1])

    def insert(self, events, query: np.ndarray, k: int, results: list | Pending) -> None:
        self.clock += 1
        self.stats["inserts"] += 1
        entries = self.sets.setdefault(frozenset(events), [])
        if len(entries) >= self.entries:
            oldest = min(range(len(entries)), key=lambda i: entries[i][3])
            entries[oldest] = entries[-1]
            entries.pop()
            self.stats["evictions"] += 1
        entries.append([query, results if isinstance(results, Pending) else list(results), k, self.clock])

    def clear(self) -> None:
        self.sets = {}

    def __len__(self):
        return sum(map(len, self.sets.values()))


class DriftGate:
    """Lets the first partial through, then those that differ from the last one let through by `threshold` bits or more."""

    def __init__(self, threshold: int = GATE):
        self.threshold, self.last, self.current, self.emitted, self.suppressed = threshold, None, None, 0, 0

    def update(self, sig: np.ndarray) -> bool:
        self.current = sig
        if self.last is None or ham(self.last, sig) >= self.threshold:
            self.last, self.emitted = sig, self.emitted + 1
            return True
        self.suppressed += 1
        return False

    def reset(self) -> None:
        self.last = self.current = None


def gate(rows: DataFrame, session: str, order: str, bits: int, threshold: int = GATE) -> DataFrame:
    """(session, order, emitted): what a drift gate lets through of each session's signatures (s0, ...), in order.

    Whether a row passes depends on the last that did, so a session is one task's;
    it streams through the sorted rows and holds one signature.
    """
    words = S.word_names(bits)
    kinds = dict(rows.dtypes)

    def run(batches):
        name, last = None, None
        for b in batches:
            on, names = np.zeros(b.num_rows, bool), b.column(0).to_pylist()
            sigs = np.stack([b.column(2 + w).to_numpy() for w in range(len(words))], axis=1).view(np.uint64)
            for i, who in enumerate(names):
                if last is None or who != name or ham(last, sigs[i]) >= threshold:
                    on[i], name, last = True, who, sigs[i].copy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(on)], names=[session, order, "emitted"])

    ordered = rows.select(session, order, *words).repartition(session).sortWithinPartitions(session, order)
    return ordered.mapInArrow(run, f"{session} {kinds[session]}, {order} {kinds[order]}, emitted boolean")


class Predictor(Protocol):
    """What foretells the next event of a session: of a context (event ids, latest last) the k likeliest with their probabilities, learning from what follows what."""

    def predict(self, context: list[int], k: int) -> list[tuple[int, float]]: ...

    def observe(self, prev: int, nxt: int) -> None: ...

    def confidence(self) -> float: ...


class OnlineMarkov:
    """Order-1 counts learnt as they come (or given), Laplace smoothing, optional decay."""

    def __init__(self, alpha: float = 1.0, half_life_s: float | None = None, max_order: int = 1):
        self.alpha, self.half_life, self.max_order, self.counts, self.vocab = alpha, half_life_s, max_order, {}, set()

    def _now(self, cell, now: float) -> float:
        w, at = cell
        return w * 2.0 ** (-max(now - at, 0.0) / self.half_life) if self.half_life else w

    def observe(self, prev: int, nxt: int, now: float = 0.0, weight: float = 1.0) -> None:
        self.vocab |= {prev, nxt}
        row = self.counts.setdefault((prev,), {})
        row[nxt] = (self._now(row.get(nxt, (0.0, now)), now) + weight, now)

    def load(self, rows) -> None:
        """Prior (context, next, weight) rows; orders beyond max_order are skipped."""
        for context, nxt, weight in rows:
            if 1 <= len(context) <= self.max_order:
                self.vocab |= {*context, nxt}
                self.counts.setdefault(tuple(context), {})[nxt] = (weight, 0.0)

    def renewed(self) -> OnlineMarkov:
        """A model with the same settings that has learnt nothing."""
        return OnlineMarkov(self.alpha, self.half_life, self.max_order)

    def dump(self) -> str:
        """The model as JSON."""
        rows = [[list(c), e, w, at] for c, row in sorted(self.counts.items()) for e, (w, at) in sorted(row.items())]
        return json.dumps({"alpha": self.alpha, "half_life_s": self.half_life, "max_order": self.max_order, "vocab": sorted(self.vocab), "rows": rows})

    @staticmethod
    def restore(saved: str) -> OnlineMarkov:
        x = json.loads(saved)
        m = OnlineMarkov(x["alpha"], x["half_life_s"], x["max_order"])
        m.vocab = set(x["vocab"])
        for context, e, w, at in x["rows"]:
            if len(context) <= m.max_order:
                m.counts.setdefault(tuple(context), {})[e] = (w, at)
        return m

    def observed(self, prev: int, now: float = 0.0) -> float:
        return sum(self._now(c, now) for c in self.counts.get((prev,), {}).values())

    def predict(self, context: list[int], k: int, now: float = 0.0) -> list[tuple[int, float]]:
        vocab = sorted(self.vocab)
        if not vocab or k == 0:
            return []
        for order in range(min(len(context), self.max_order), 0, -1):
            row = self.counts.get(tuple(context[-order:]), {})
            total = sum(self._now(c, now) for c in row.values())
            if total >= 2.0:
                p = [((self._now(row[e], now) if e in row else 0.0) + self.alpha) / (total + self.alpha * len(vocab)) for e in vocab]
                return sorted(zip(vocab, p), key=lambda x: (-x[1], x[0]))[:k]
        return [(e, 1.0 / len(vocab)) for e in vocab[:k]]

    def confidence(self) -> float:
        return 1.0


def as_markov(predictor) -> OnlineMarkov | None:
    """The Markov model that a predictor is or holds."""
    return predictor if isinstance(predictor, OnlineMarkov) else getattr(predictor, "markov", None)


@dataclass
class Session:
    """One conversation. `fallback` searches the corpus when the predicted scope has fewer than k rows, which the plain rules don't.

    With `persist`, a reset gives out what the session's Markov model has learnt, and
    the conversation that follows under the same name begins with it.
    """

    predictor: Predictor = field(default_factory=OnlineMarkov)
    coarse_k: int = 64
    max_events: int = 8
    fallback: bool = False
    cold: Index | None = None
    persist: bool = False

    def __post_init__(self):
        self.window: list[tuple[int, float]] = []
        self.gate, self.cache = DriftGate(), DeltaCache()
        self.events: list[int] = []
        self.scope = Scope()
        self.spec = None

    def warm(self, index: Index) -> list[int]:
        context = [e for e, _ in self.window[-3:]]
        self.events = [e for e, _ in self.predictor.predict(context, self.max_events)] if context else []
        self.scope = index.scope(self.events) if context else Scope()
        return self.events

    def _scan(self, sig: np.ndarray, k: int) -> Pending:
        return Pending(sig, k, self.scope, self.fallback, self.coarse_k, self.max_events)

    def observe(self, index: Index, sig: np.ndarray, k: int) -> bool:
        """A partial; true if it passed the gate."""
        if not self.gate.update(sig):
            return False
        got = self.cache.lookup(self.events, sig, k)
        if got is None:
            got = self._scan(sig, k)
            self.cache.insert(self.events, sig, k, got)
        self.spec = sig, got
        return True

    def finalize(self, index: Index, sig: np.ndarray, k: int, now: float) -> dict:
        if self.spec and ham(self.spec[0], sig) <= ACCEPT and len(got := _told(self.spec[1], index)) == k:
            results, size, by = got, len(self.scope), "speculative"
        elif (got := self.cache.lookup(self.events, sig, k)) is not None:
            results, size, by = _told(got, index), len(self.scope), "delta_cache"
        else:
            results, size, shards = self._scan(sig, k).get(index)
            self.cache.insert(self.events, sig, k, results)
            by = "shard_scan" if shards else "full_scan"
        top = int(index.event[results[0][1]]) if results else -1
        if top >= 0:
            if self.window:
                self.predictor.observe(self.window[-1][0], top)
            self.window = [(e, t) for e, t in [*self.window, (top, now)][-WINDOW:] if now - t <= MAX_AGE_S]
        cold = self.cold.top_k(sig, k) if self.cold is not None and len(self.cold.doc) else []
        self.reset_utterance()
        return {"served_by": by, "results": results, "top_event": top, "predicted": list(self.events), "scope_size": size, "cold": cold}

    def reset_utterance(self) -> None:
        """Forgets the utterance; what was predicted stays."""
        self.gate.reset()
        self.spec = None

    def apply(self, index: Index, action: str, sig: np.ndarray, k: int, now: float) -> dict | None:
        """One row of a log; the row to put out, if the action has one."""
        if action == "observe":
            self.observe(index, sig, k)
            return None
        if action == "finalize":
            return self.finalize(index, sig, k, now)
        if action == "warm":
            return {"served_by": "warm", "results": [], "top_event": -1, "predicted": self.warm(index), "scope_size": len(self.scope), "cold": []}
        if action == "reset":
            learnt = as_markov(self.predictor) if self.persist else None
            fresh = self.predictor.renewed() if hasattr(self.predictor, "renewed") else type(self.predictor)()
            if learnt is self.predictor:
                fresh = learnt
            elif learnt is not None:
                fresh.markov = learnt
            self.__init__(predictor=fresh, coarse_k=self.coarse_k, max_events=self.max_events, fallback=self.fallback, cold=self.cold, persist=self.persist)
            return {"served_by": "reset", "results": [], "top_event": -1, "predicted": [], "scope_size": 0, "cold": [], "model": learnt.dump() if learnt else None}
        raise ValueError(f"unknown action {action}")


    def start_from(self, saved: str) -> None:
        """Takes over a Markov model that an earlier conversation gave out."""
        if isinstance(self.predictor, OnlineMarkov):
            self.predictor = OnlineMarkov.restore(saved)
        elif hasattr(self.predictor, "markov"):
            self.predictor.markov = OnlineMarkov.restore(saved)


OUTPUT = "session string, seq bigint, served_by string, doc_ids array<bigint>, distances array<int>, top_event int, predicted array<int>, scope_size bigint, model string"
_COLUMNS = ["session", "seq", "served_by", "doc_ids", "distances", "top_event", "predicted", "scope_size", "model"]


def _rows(session_id, index: Index, state: Session, log: pd.DataFrame, words: list[str]) -> list[tuple]:
    """What a session puts out for rows of its log, which are in order."""
    out = []
    sigs = log[words].to_numpy(np.int64).view(np.uint64)
    for sig, seq, ts, action, k in zip(sigs, log["seq"], log["ts"], log["action"], log["k"]):
        got = state.apply(index, action, sig, int(k), pd.Timestamp(ts).timestamp())
        if got:
            out.append((session_id, int(seq), got["served_by"], [int(index.doc[r]) for _, r in got["results"]], [d for d, _ in got["results"]], got["top_event"], got["predicted"], got["scope_size"], got.get("model")))
    return out


def collect_index(corpus: DataFrame, bits: int, limit_bytes: int = 512 << 20):
    """Broadcasts a corpus (doc_idx, s0, ..., event_id) as arrays: 44 bytes a row at 256 bits. A corpus beyond `limit_bytes` is refused: give each kind of session its own scope, or use the relational search."""
    words = S.word_names(bits)
    rows = corpus.select("doc_idx", *words, F.coalesce("event_id", F.lit(-1)).cast("bigint").alias("event_id")).persist()  # computed once, for the count and for the arrays
    try:
        n = rows.count()
        if n * (8 * len(words) + 12) > limit_bytes:
            raise ValueError(f"a corpus of {n} rows is too large to be held by every worker")
        t = rows.toArrow()
    finally:
        rows.unpersist()
    arrays = np.stack([t[w].to_numpy() for w in words], axis=1).view(np.uint64) if n else np.zeros((0, len(words)), np.uint64), t["doc_idx"].to_numpy(), t["event_id"].to_numpy()
    return corpus.sparkSession.sparkContext.broadcast(arrays)


def _with_prior(log: DataFrame, prior: DataFrame | None) -> DataFrame:
    """The log with each session's saved model, null without one."""
    if prior is None:
        return log.withColumn("model", F.lit(None).cast("string"))
    return log.join(prior.select("session", "model"), "session", "left")


def replay(log: DataFrame, corpus: DataFrame, bits: int = 256, make=Session, prior: DataFrame | None = None) -> DataFrame:
    """Rows of OUTPUT for a log (session, seq, ts, action, k, s0, ...): sessions in parallel, each in the order of (ts, seq).

    A task streams through the sorted rows of its sessions with the state of one
    session at a time, so a long session needs no more memory than a short one.
    Sessions named in `prior` (session, model) begin with that model.
    """
    words, sent = S.word_names(bits), collect_index(corpus, bits)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, name, state = _index_of(sent), None, None
        for frame in frames:
            out = []
            edge = [0, *(np.flatnonzero(frame["session"].to_numpy()[1:] != frame["session"].to_numpy()[:-1]) + 1).tolist(), len(frame)]
            for a, b in zip(edge[:-1], edge[1:]):
                part = frame.iloc[a:b]
                if not len(part):
                    continue
                if state is None or part["session"].iloc[0] != name:
                    name, state = part["session"].iloc[0], _started(make, part)
                out += _rows(name, index, state, part, words)
            yield pd.DataFrame(out, columns=_COLUMNS)

    # by number, as adaptive execution would put sessions, which are few bytes and much work, into few tasks
    spark = log.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = _with_prior(log, prior).repartition(tasks, "session").sortWithinPartitions("session", "ts", "seq")
    return rows.select("session", "seq", "ts", "action", "k", *words, "model").mapInPandas(fold, OUTPUT)


def _started(make, log: pd.DataFrame) -> Session:
    session, saved = make(), log["model"].iloc[0]
    if isinstance(saved, str):
        session.start_from(saved)
    return session


def save_models(rows: DataFrame, path: str) -> None:
    """Appends the models that resets gave out to a folder."""
    rows.where("model IS NOT NULL").select("session", "seq", "model").write.mode("append").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """(session, model): of each session the last model saved."""
    return spark.read.schema("session string, seq bigint, model string").parquet(path).groupBy("session").agg(F.max_by("model", "seq").alias("model"))


def keep_models(rows: DataFrame, path: str, checkpoint: str, output: str):
    """Starts a query that writes a stream's rows to `output` and the models that resets gave out to `path`."""

    def write(batch: DataFrame, _) -> None:
        batch = batch.persist()
        save_models(batch, path)
        batch.write.mode("append").parquet(output)
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _index_of(sent) -> Index:
    """A worker's index over broadcast arrays, kept while it serves the same broadcast."""
    kept, arrays = worker_cache(), sent.value
    if "session index" not in kept or kept["session index"][0] is not arrays:
        kept["session index"] = arrays, Index(*arrays)
    return kept["session index"][1]


def stream(log: DataFrame, corpus: DataFrame, bits: int = 256, make=Session, ttl_ms: int = 3_600_000, prior: DataFrame | None = None) -> DataFrame:
    """The same rows from a stream; a session's state is dropped after `ttl_ms` without rows.

    Rows of one micro-batch are worked off in the order of (ts, seq). Timeouts are
    looked at when there are new rows: micro-batches without any are switched off in
    the session, as with a timeout in processing time they would follow each other
    without end and a query over what is available would never be over.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    log.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    words, sent = S.word_names(bits), collect_index(corpus, bits)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        log = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        session = pickle.loads(state.get[0]) if state.exists else _started(make, log)
        yield pd.DataFrame(_rows(key[0], _index_of(sent), session, log, words), columns=_COLUMNS)
        state.update((_frozen(session),))
        state.setTimeoutDuration(ttl_ms)

    return _with_prior(log, prior).groupBy("session").applyInPandasWithState(step, OUTPUT, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _frozen(session: Session) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps(session)


class Prefetcher:
    """Keeps the rows of the likely next events at hand: queries scan those, and the whole corpus where there are none."""

    def __init__(self, index: Index, predictor: OnlineMarkov, top_n: int = 3, threshold: float = 0.05):
        self.index, self.predictor, self.top_n, self.threshold = index, predictor, top_n, threshold
        self.events, self.scope = [], Scope()
        self.stats = {"queries": 0, "warm_scans": 0, "cold_scans": 0, "warm_hits": 0}

    def prefetch(self, context: list[int]) -> list[int]:
        self.events = [e for e, p in self.predictor.predict(context, self.top_n) if p >= self.threshold] if context else []
        self.scope = self.index.scope(self.events)
        return self.events

    def query(self, sig: np.ndarray, k: int) -> list:
        self.stats["queries"] += 1
        if not len(self.scope):
            self.stats["cold_scans"] += 1
            return self.index.top_k(sig, k)
        self.stats["warm_scans"] += 1
        got = self.index.top_k(sig, k, self.scope)
        best = self.index.top_k(sig, 1)
        self.stats["warm_hits"] += bool(got and best and got[0][0] == best[0][0])
        return got


class StreamingPrefetcher(Prefetcher):
    """A prefetcher with gate, speculation and cache; with nothing prefetched it scans nothing."""

    def __init__(self, index, predictor, drift: int = GATE, accept: int = ACCEPT, cache: DeltaCache | None = None, **options):
        super().__init__(index, predictor, **options)
        self.gate, self.accept, self.cache, self.spec = DriftGate(drift), accept, cache or DeltaCache(), None

    def observe(self, sig: np.ndarray, k: int) -> bool:
        if not self.gate.update(sig):
            return False
        got = self.cache.lookup(self.events, sig, k)
        if got is None:
            got = self.index.top_k(sig, k, self.scope)
            self.cache.insert(self.events, sig, k, got)
        self.spec = sig, got
        return True

    def finalize(self, sig: np.ndarray, k: int) -> tuple[str, list]:
        if self.spec and ham(self.spec[0], sig) <= self.accept and len(self.spec[1]) == k:
            out = "speculative", self.spec[1]
        elif (got := self.cache.lookup(self.events, sig, k)) is not None:
            out = "delta_cache", got
        else:
            got = self.index.top_k(sig, k, self.scope)
            self.cache.insert(self.events, sig, k, got)
            out = "rescan", got
        self.gate.reset()
        self.spec = None
        return out
