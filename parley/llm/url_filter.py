"""Exact URL lists as cascades of Bloom filters.

Level 1 holds the listed keys. Level 2 holds the keys of the complete universe
that level 1 takes for listed though they aren't, level 3 the listed keys that
level 2 takes for false ones, and so on until a level errs on nothing. A key of
the universe is then decided exactly by the parity of the first level that
rejects it. The universe is split by key hash into shards of about the same
size, and each shard's cascade is built in one task; the cascades together take
some ten bits for each listed key. They are broadcast only while they fit a
stated size; beyond it the keys go to their shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import mix

U64 = np.uint64


class Bloom:
    """Bits for 128-bit keys, given as two columns of 64; `salt` makes the levels independent."""

    def __init__(self, bits: np.ndarray, hashes: int, salt: int):
        self.bits, self.hashes, self.salt = bits, hashes, salt

    @staticmethod
    def build(keys: np.ndarray, rate: float, salt: int) -> Bloom:
        n = max(64, int(np.ceil(-len(keys) * np.log(rate) / np.log(2) ** 2)))
        b = Bloom(np.zeros(-(-n // 8), np.uint8), max(1, round(-np.log2(rate))), salt)
        for at in b._places(keys):
            np.bitwise_or.at(b.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return b

    def _places(self, keys: np.ndarray):
        salt = mix(np.array([2 * self.salt + 1, 2 * self.salt + 2], U64))
        a = mix(keys[:, 0] ^ salt[0] ^ mix(keys[:, 1] ^ salt[1]))
        step = mix(keys[:, 1] + mix(keys[:, 0] + salt[0])) | U64(1)  # not a function of `a`: all 128 bits tell keys apart
        m = U64(len(self.bits) * 8)
        for i in range(self.hashes):
            yield ((a + U64(i) * step) % m).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        yes = np.ones(len(keys), bool)
        for at in self._places(keys):
            yes &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return yes


class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @staticmethod
    def build(listed: np.ndarray, others: np.ndarray, rate: float = 0.01) -> Cascade:
        """`listed` and `others` are disjoint and together the universe. Later levels use the rate 1/2, as their sets shrink anyway."""
        levels, inside, outside = [], listed, others
        while len(inside):
            level = Bloom.build(inside, rate if not levels else 0.5, len(levels))
            levels.append(level)
            inside, outside = outside[level.has(outside)], inside
        return Cascade(levels)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        alive = np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            alive = alive[level.has(keys[alive])]
            out[alive] = depth % 2 == 0
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(x for b in self.levels for x in (len(b.bits), b.hashes))], "<i8")
        return head.tobytes() + b"".join(b.bits.tobytes() for b in self.levels)

    @staticmethod
    def load(raw: bytes) -> Cascade:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        shape = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
        at, levels = 8 + 16 * n, []
        for i, (size, hashes) in enumerate(shape.tolist()):
            levels.append(Bloom(np.frombuffer(raw, np.uint8, size, at), hashes, i))
            at += size
        return Cascade(levels)


def url_key(url: Column) -> Column:
    """Address without scheme, `www.` or `m.`, query, fragment and closing slash, lowered; null for null."""
    bare = F.regexp_replace(common.lower_ascii(url), r"^[a-z]+://", "")
    bare = F.regexp_replace(bare, r"^(www\.|m\.)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#][\s\S]*$", ""), r"/+$", "")


def _hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a key; the key comes last, as a hash of several columns is seeded with that of those before."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def build(universe: DataFrame, listed: DataFrame, keys_per_shard: int = 1 << 20) -> DataFrame:
    """(shard, shards, cascade BINARY) of all keys (column `key`) of `universe`, exact for the keys in `listed`.

    Only 128-bit hashes of keys are shuffled, of which two keys of a universe have
    the same with a probability below 1e-15 even for 1e11 keys; a listed and an
    unlisted key with one hash would both count as listed. Null keys are left out;
    repeated keys count once; listed keys that aren't in the universe are added to it.
    """
    h1, h2 = _hashes(F.col("key"))
    both = universe.select("key", F.lit(False).alias("on")).unionByName(listed.select("key", F.lit(True).alias("on"))).where("key IS NOT NULL")
    keys = common.materialise(both.groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.max("on").alias("on")), "url-keys")
    shards = max(1, -(-keys.count() // keys_per_shard))
    out = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("cascade", pa.binary())])

    def one(table: pa.Table) -> pa.Table:
        h, on = np.stack([table[c].to_numpy().view(U64) for c in ("h1", "h2")], axis=1), table["on"].to_numpy()
        return pa.table([pa.array([table["shard"][0].as_py()], pa.int32()), pa.array([shards], pa.int32()), pa.array([Cascade.build(h[on], h[~on]).dump()], pa.binary())], schema=out)

    split = keys.withColumn("shard", _shard("h1", shards))
    return split.groupBy("shard").applyInArrow(one, "shard int, shards int, cascade binary")


def _shard(h: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(shards)).cast("int")


def listed(rows: DataFrame, cascades: DataFrame, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """`rows` (with a column `key`) and whether each key is listed, as a further column `blocked`.

    Exact for every key of the universe that the cascades were built over. A null
    key isn't blocked. Repeated rows are decided alike; an empty table gives no
    rows. All columns are kept; if there is one named `blocked` already, the new one
    has an underscore before it.
    """
    blocked = common.unused(rows, "blocked")
    held = common.materialise(cascades, "cascades")
    size = held.agg(F.sum(F.length("cascade")), F.max("shards")).first()
    if not size[0]:
        return rows.withColumn(blocked, F.lit(False))
    shards = size[1]
    h1, h2 = _hashes(F.col("key"))
    if size[0] <= broadcast_bytes:
        sent = rows.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["cascade"]) for r in held.collect()})

        @F.pandas_udf("boolean")
        def probe(shard, h1, h2):
            import pandas as pd

            out, k, s = np.zeros(len(h1), bool), np.stack([h1.to_numpy().view(U64), h2.to_numpy().view(U64)], axis=1), shard.to_numpy()
            order = np.argsort(s, kind="stable")
            edge = np.append(np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1]])), len(s)) if len(s) else [0]
            for a, b in zip(edge[:-1], edge[1:]):
                raw = sent.value.get(int(s[order[a]]))
                if raw is not None:
                    out[order[a:b]] = Cascade.load(raw).has(k[order[a:b]])
            return pd.Series(out)

        return rows.withColumn(blocked, F.col("key").isNotNull() & probe(F.pmod(F.xxhash64(h1), F.lit(shards)).cast("int"), h1, h2))

    # too large to send: every shard's distinct key hashes go to its cascade, and come back as blocked hashes
    def decide(keys: pa.Table, filters: pa.Table) -> pa.Table:
        h = np.stack([keys[c].to_numpy() for c in names], axis=1)
        on = Cascade.load(filters["cascade"][0].as_py()).has(h.view(U64)) if filters.num_rows else np.zeros(len(h), bool)
        return pa.table({names[0]: np.ascontiguousarray(h[on, 0]), names[1]: np.ascontiguousarray(h[on, 1]), "hit": np.ones(int(on.sum()), bool)})

    names = [common.unused(rows, c) for c in ("h1", "h2")]
    hashed = rows.withColumns(dict(zip(names, (h1, h2))))
    distinct = hashed.where("key IS NOT NULL").groupBy(*names).agg(F.count(F.lit(1)).alias("copies")).withColumn("shard", F.pmod(F.xxhash64(names[0]), F.lit(shards)).cast("int"))
    distinct = common.materialise(distinct, "url-hashes")
    hits = distinct.drop("copies").groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(decide, f"{names[0]} bigint, {names[1]} bigint, hit boolean")
    on = common.unused(rows, "copies")
    hits = common.materialise(hits.join(distinct.drop("shard"), names).select(*names, F.col("copies").alias(on)), "url-hits")
    return common.join_classes(hashed, hits, names, on, "left", broadcast_bytes).withColumn(blocked, F.col("key").isNotNull() & F.col(on).isNotNull()).select(*rows.columns, blocked)


def block_pages(pages: DataFrame) -> DataFrame:
    """(page_id, key, blocked): pages whose address was captured with tracking parameters anywhere in the table.

    The list is the set of addresses seen with a `utm_` or `ref` parameter; the
    universe are all addresses of the table. A page with a null url isn't blocked
    and has a null key; rows that repeat a page_id are told each; other columns are
    ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("key"))
    tracked = rows.where(F.col("url").rlike(r"[?&](utm_[a-z]+|ref)=")).select("key")
    return listed(rows.select("page_id", "key"), build(rows.select("key"), tracked))


SQL = r"""
WITH p AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[a-z]+://', ''), '^(www\.|m\.)', ''), '[?#][\s\S]*$', ''), '/+$', '') AS key
  FROM pages)
SELECT page_id, key, coalesce(key IN (SELECT key FROM p WHERE key IS NOT NULL AND regexp_matches(url, '[?&](utm_[a-z]+|ref)=')), false) AS blocked
FROM p
"""
