"""Exact duplicates by a cuckoo-filter index over live digests.

A document's digest is two independent 64-bit hashes of its text, made in the
JVM. Digests (never texts) are counted in their task and shuffled by digest;
before and after the shuffle a `CuckooIndex` holds them: a filter of 16-bit
fingerprints whose slots also name the stored key. A lookup that hits the filter
is verified against the stored keys of the two buckets; when an insertion finds
no free slot, the filter is rebuilt twice as large from the stored keys. Texts
whose digests were seen more than once are then grouped by the texts themselves,
so a collision of digests cannot make two documents equal; rows are then told
their group by 192 bits of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import mix

U64 = np.uint64
SLOTS = 4


class CuckooIndex:
    """Digests with reference counts and a payload, under a cuckoo filter of 4-slot buckets.

    `insert` and `delete` take arrays; both are exact, since each filter hit is
    checked against the stored key. Deleting what is absent does nothing.
    """

    def __init__(self, capacity: int = 1024, max_kicks: int = 200):
        self.max_kicks = max_kicks
        self.keys = np.zeros((0, 2), U64)
        self.payload = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.size = 0
        self.resizes = -1
        self._allot(max(8, 1 << int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.8))))))

    def __len__(self):
        return int((self.count[: self.size] > 0).sum())

    def _allot(self, buckets: int) -> None:
        self.buckets = buckets
        self.print = np.zeros((buckets, SLOTS), np.uint16)
        self.row = np.full((buckets, SLOTS), -1, np.int64)
        self.resizes += 1

    def _places(self, keys: np.ndarray):
        h = mix(keys[:, 0] ^ (keys[:, 1] * U64(0x9E3779B97F4A7C15)))
        mark = ((h >> U64(48)) | U64(1)).astype(np.uint16)  # never 0, which marks a free slot
        one = (h & U64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket, mark):
        return bucket ^ (mix(np.asarray(mark, U64)) & U64(self.buckets - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each stored key, -1 where it isn't live."""
        keys = np.asarray(keys, U64).reshape(-1, 2)
        found = np.full(len(keys), -1, np.int64)
        if not self.size or not len(keys):
            return found
        mark, one, two = self._places(keys)
        for bucket in (one, two):
            at, slot = np.nonzero(self.print[bucket] == mark[:, None])
            row = self.row[bucket[at], slot]
            same = (self.keys[row] == keys[at]).all(axis=1)  # a filter hit proves nothing yet
            found[at[same]] = row[same]
        return found

    @staticmethod
    def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order that brings equal keys together, where each run of them begins in it, and how long it is."""
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        run = keys[order]
        lead = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]).any(axis=1)])) if len(run) else np.zeros(0, np.int64)
        return order, lead, np.diff(np.append(lead, len(run)))

    def insert(self, keys: np.ndarray, payload: np.ndarray, refs: np.ndarray | None = None) -> np.ndarray:
        """Adds one reference for each key, or `refs` of them; true where the key was new. The payload kept is the least."""
        keys = np.asarray(keys, U64).reshape(-1, 2)
        new = np.zeros(len(keys), bool)
        if not len(keys):
            return new
        order, lead, times = self._runs(keys)
        least = np.minimum.reduceat(np.asarray(payload, np.int64)[order], lead)
        if refs is not None:
            times = np.add.reduceat(np.asarray(refs, np.int64)[order], lead)
        first = order[lead]
        row = self.find(keys[first])
        old = row[row >= 0]
        self.count[old] += times[row >= 0]
        self.payload[old] = np.minimum(self.payload[old], least[row >= 0])
        fresh = first[row < 0]
        new[fresh] = True
        if len(fresh):
            begin, self.size = self.size, self.size + len(fresh)
            if self.size > len(self.keys):
                room = max(self.size, 2 * len(self.keys), 1024)
                self.keys = np.concatenate([self.keys, np.zeros((room - len(self.keys), 2), U64)])
                self.payload = np.concatenate([self.payload, np.zeros(room - len(self.payload), np.int64)])
                self.count = np.concatenate([self.count, np.zeros(room - len(self.count), np.int64)])
            self.keys[begin : self.size] = keys[fresh]
            self.payload[begin : self.size] = least[row < 0]
            self.count[begin : self.size] = times[row < 0]
            self._place(np.arange(begin, self.size))
        return new

    def _place(self, rows: np.ndarray) -> None:
        while self.size > self.buckets * SLOTS * 0.9 or not self._try(rows):
            self._allot(self.buckets * 2)  # overflow: everything again, from the stored keys
            rows = np.flatnonzero(self.count[: self.size] > 0)

    def _try(self, rows: np.ndarray) -> bool:
        """Fills free slots of the first buckets all at once; the rest goes one by one."""
        mark, one, two = self._places(self.keys[rows])
        order = np.argsort(one, kind="stable")
        b = one[order]
        at = np.arange(len(b))
        lead = np.ones(len(b), bool)
        lead[1:] = b[1:] != b[:-1]
        rank = at - np.maximum.accumulate(np.where(lead, at, 0))
        taken = self.row[b] >= 0
        free = np.argsort(taken, axis=1, kind="stable")  # free slots come first
        fits = rank < SLOTS - taken.sum(axis=1)
        bucket, slot = b[fits], free[fits, rank[fits]]
        self.print[bucket, slot], self.row[bucket, slot] = mark[order[fits]], rows[order[fits]]
        left = order[~fits]
        return self._second(rows[left], mark[left], two[left])

    def _second(self, rows, mark, two) -> bool:
        """Places what found no room in its first bucket, evicting where its second is full too."""
        for r, m, b in zip(rows.tolist(), mark.tolist(), two.tolist()):
            for kick in range(self.max_kicks):
                free = np.flatnonzero(self.row[b] < 0)
                if len(free):
                    self.print[b, free[0]], self.row[b, free[0]] = m, r
                    break
                s = (kick * 7 + r) % SLOTS
                m, self.print[b, s] = int(self.print[b, s]), m
                r, self.row[b, s] = int(self.row[b, s]), r
                b = int(self._other(np.array([b]), np.array([m]))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray, refs: np.ndarray | None = None) -> np.ndarray:
        """Takes away one reference for each key, or up to `refs` of them; true where there was one. A key without references leaves the filter."""
        keys = np.asarray(keys, U64).reshape(-1, 2)
        had = np.zeros(len(keys), bool)
        if not len(keys):
            return had
        order, lead, times = self._runs(keys)
        row = self.find(keys[order[lead]])
        there = np.where(row >= 0, self.count[row], 0) if self.size else np.zeros(len(row), np.int64)
        if refs is None:
            had[order] = np.arange(len(keys)) - np.repeat(lead, times) < np.repeat(there, times)
        else:
            had[order] = np.repeat(there > 0, times)
            times = np.add.reduceat(np.asarray(refs, np.int64)[order], lead)
        live = row[row >= 0]
        self.count[live] -= np.minimum(times, there)[row >= 0]
        dead = live[self.count[live] == 0]
        _, one, two = self._places(self.keys[dead])
        for bucket in (one, two):
            at, slot = np.nonzero(self.row[bucket] == dead[:, None])
            self.print[bucket[at], slot], self.row[bucket[at], slot] = 0, -1
        return had

    def live(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, payloads and reference counts of what is live."""
        rows = np.flatnonzero(self.count[: self.size] > 0)
        return self.keys[rows], self.payload[rows], self.count[rows]


def _d1():
    return F.xxhash64("text")


def _d2():
    return F.xxhash64(F.lit("second"), "text")  # the text last: a hash of several columns is seeded with that of those before


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2) of documents with an id and a text."""
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), _d1().alias("d1"), _d2().alias("d2"))


_LIVE = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("first_id", pa.int64()), ("refs", pa.int64())])
_LIVE_SQL = "d1 bigint, d2 bigint, first_id bigint, refs bigint"


def _told(index: CuckooIndex, least: int):
    """Keys with at least so many references, in batches."""
    keys, payload, count = index.live()
    on = np.flatnonzero(count >= least)
    for k in range(0, len(on), 1 << 16):
        at = on[k : k + (1 << 16)]
        d = keys[at].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(payload[at]), pa.array(count[at])], schema=_LIVE)


def _counted(least: int, bound: int | None = None):
    """References of a partition's digests (d1, d2, first_id, refs) put together by an index, which is emptied when it holds `bound` keys."""

    def run(batches):
        index = CuckooIndex(1 << 12)
        for b in batches:
            if b.num_rows:
                d1, d2, first, refs = (c.to_numpy() for c in b.columns)
                index.insert(np.stack([d1.view(U64), d2.view(U64)], axis=1), first, refs)
            if bound and index.size >= bound:
                yield from _told(index, least)
                index = CuckooIndex(1 << 12)
        yield from _told(index, least)

    return run


def _classes(docs: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(d1, d2, d3, keeper_id, copies, ties) of every text that several rows have; ties is the number of rows of the keeper's id, 2 where it isn't known.

    Digests are put together by an index in every task before they are shuffled, so
    a text is sent once by each task however many rows have it, and so are the texts
    of repeated digests when they are compared.
    """
    parts = common.parts_for(docs, 64 << 20)
    here = digests(docs).select("d1", "d2", F.col("doc_id").alias("first_id"), F.lit(1).cast("bigint").alias("refs")).mapInArrow(_counted(1, 1 << 18), _LIVE_SQL)
    seen = common.materialise(here.repartition(parts, "d1").mapInArrow(_counted(2), _LIVE_SQL).select("d1", "d2", "first_id"), "repeated-digests")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", _d1().alias("d1"), _d2().alias("d2"))
    # beyond the bound a join by the digest's shuffle; its rows of one digest are split by adaptive execution
    texts = rows.join(F.broadcast(seen) if seen.count() * 32 <= broadcast_bytes else seen, ["d1", "d2"])
    same = texts.groupBy("d1", "d2", "text").agg(F.min("doc_id").alias("keeper_id"), F.count(F.lit(1)).alias("copies"), F.count_if(F.col("doc_id") == F.col("first_id")).alias("ties"), F.min("first_id").alias("first_id"))
    ties = F.when(F.col("keeper_id") == F.col("first_id"), F.col("ties")).otherwise(2)
    return common.materialise(same.where("copies > 1").select("d1", "d2", F.xxhash64(F.lit("third"), "text").alias("d3"), "keeper_id", "copies", ties.alias("ties")), "equal-texts")


def _with_class(rows: DataFrame, classes: DataFrame, broadcast_bytes: int, how: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows with the columns of their text's class, which are told by name."""
    names = {c: common.unused(rows, c) for c in classes.columns}
    text = F.when(F.col("doc_id").isNotNull(), F.col("text"))
    keyed = rows.withColumns({names["d1"]: F.xxhash64(text), names["d2"]: F.xxhash64(F.lit("second"), text), names["d3"]: F.when(text.isNotNull(), F.xxhash64(F.lit("third"), text))})
    side = classes.select(*[F.col(c).alias(n) for c, n in names.items()])
    return common.join_classes(keyed, side, [names[c] for c in ("d1", "d2", "d3")], names["copies"], how, broadcast_bytes), names


def exact_duplicates(docs: DataFrame, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """(doc_id, keeper_id, copies) of every document whose text another row has too.

    keeper_id is the least doc_id of the rows with that very text, copies their
    number. Texts are compared whole and as they are. A null text equals
    nothing; empty texts equal each other; rows without doc_id are left out;
    rows that repeat a doc_id count as often as they occur. An empty table gives
    no rows. Other columns are ignored.

    What is broadcast are digests of repeated texts within `broadcast_bytes`;
    beyond it they are joined by a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found, _ = _with_class(rows, _classes(docs, broadcast_bytes), broadcast_bytes, "inner")
    return found.select("doc_id", "keeper_id", "copies")


def drop_duplicates(docs: DataFrame, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """The documents without repeated texts: of equal texts one row with the least doc_id stays.

    Each row is settled by its own text, so other rows of its doc_id don't matter.
    Rows with a null text or a null doc_id all stay. Of several rows with the least
    doc_id and the very text, any one stays. All columns are kept, whatever their
    names; an empty table stays empty.
    """
    classes = _classes(docs, broadcast_bytes)
    rows, names = _with_class(docs, classes, broadcast_bytes, "left")
    kept = rows.where(F.col(names["keeper_id"]).isNull() | (F.col("doc_id").cast("bigint") == F.col(names["keeper_id"])))
    if not classes.where("ties > 1").limit(1).count():
        return kept.select(docs.columns)
    one = F.coalesce(names["ties"], F.lit(1)) == 1
    several = kept.where(~one).dropDuplicates(["doc_id", *(names[c] for c in ("d1", "d2", "d3"))])
    return kept.where(one).select(docs.columns).unionByName(several.select(docs.columns))


def apply_changes(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """A live index (d1, d2, first_id, refs) after inserting and deleting documents (doc_id, text).

    Each bucket of digests is rebuilt as a `CuckooIndex` and takes its insertions,
    then its deletions; deleting what isn't live does nothing. Changes of one digest
    are counted in their tasks first, so a hot text is a row a task. first_id is the
    least id inserted. Rows without id or text change nothing.
    """
    # buckets hold digests, 32 bytes each: of the index and of what comes in
    parts = max(common.parts_for(x, 64 << 20) for x in (index, inserted, deleted))

    def change(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        keys = np.stack([table["d1"].to_numpy().view(U64), table["d2"].to_numpy().view(U64)], axis=1)
        ids, refs = table["id"].to_numpy(), table["refs"].to_numpy()
        held = CuckooIndex(max(8, len(kind)))
        old = np.flatnonzero(kind == 0)
        for x in (0, 1):
            held.insert(keys[kind == x], ids[kind == x], refs[kind == x])
        held.delete(keys[kind == 2], refs[kind == 2])
        return pa.Table.from_batches(list(_told(held, 1)), schema=_LIVE)

    rows = index.selectExpr("d1", "d2", "first_id AS id", "refs", "0 AS kind")
    for kind, docs in ((1, inserted), (2, deleted)):
        changes = digests(docs).selectExpr("d1", "d2", "doc_id AS first_id", "1L AS refs").mapInArrow(_counted(1, 1 << 18), _LIVE_SQL)
        rows = rows.unionByName(changes.selectExpr("d1", "d2", "first_id AS id", "refs", f"{kind} AS kind"))
    rows = rows.withColumn("bucket", F.pmod("d1", F.lit(parts)))
    return rows.groupBy("bucket").applyInArrow(change, _LIVE_SQL)


SQL = """
SELECT doc_id, keeper_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper_id, count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE copies > 1
"""
