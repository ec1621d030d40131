"""Benchmark decontamination on canonical templates and on plain words.

Texts are reduced to templates: numbers, names and units become typed
placeholders, every other word its lowered form. Windows of WINDOW template
tokens are joined by hash with the windows of the benchmark items, by broadcast
or, for a large benchmark, by a shuffle; matches on
one diagonal (document position minus item position) are then checked for slot
consistency: one and the same slot value of the item must always have become
one and the same value in the document, and different values different ones, as
it is when a question was re-parameterised. What passes counts towards the
share of the item that the document covers.

A name shows by its capital, which the first word of a sentence has anyway. So
templates are read twice, once without names at the beginning of sentences and
once with those that are capitalised within a sentence of the same text too. As
capitals may be changed or lost in a copy, texts are read a third time as plain
lowered words, whose windows need no slots. What any reading finds counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernel as K

U64 = np.uint64
WINDOW = 8
#: Units, lowered. A unit counts only right after a number.
UNITS = (
    "km m cm mm kg g mg lb lbs oz l ml mi mile miles meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres inch inches ft foot feet yard yards "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp mph kmh kph degrees celsius fahrenheit watt watts kw kwh hz mb gb tb"
).split()
_NUM, _NAME, _UNIT = (int(x) for x in K.mix(np.array([101, 102, 103], U64)))
_STOP = np.isin(np.arange(256), [10, 33, 46, 63])  # newline ! . ?
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_BYTES = np.repeat([1, 2, 3, 4], [192, 32, 16, 16])  # of a UTF-8 letter, by its first
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(K.Words(*K.text_buffers(pa.array(words)), "ALNUM").hash)


class Tokens:
    """Words of a chunk with their kinds: lowered `hash`, `doc`, `first`, and which are numbers, units, capitalised, and first in a sentence."""

    def __init__(self, words: K.Words):
        low = words
        if len(words.data) and words.data.max() >= 128:  # letters beyond ASCII; lowering neither makes nor joins words
            text = pa.LargeStringArray.from_buffers(len(words.offsets) - 1, pa.py_buffer(np.ascontiguousarray(words.offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(words.data)))
            try:
                low = K.Words(*K.text_buffers(pc.utf8_lower(text)), "ALNUM")
            except pa.ArrowInvalid:  # not UTF-8: only ASCII is lowered
                pass
        self.hash, self.doc, self.first = low.hash, words.doc, words.first
        d, n = words.doc, len(words)
        a = words.data[words.start] if n else np.zeros(0, np.uint8)
        self.num = _DIGIT[a]
        self.lead = np.ones(n, bool)
        if n > 1:
            self.lead[1:] = d[1:] != d[:-1]
        stops = np.concatenate([[0], np.cumsum(_STOP[words.data])])
        self.begins = self.lead.copy()
        if n > 1:
            self.begins[1:] |= stops[words.start[1:]] > stops[words.end[:-1]]
        self.capital = _UPPER[a]
        wide = np.flatnonzero(a >= 128)
        for k in range(4):  # a first letter beyond ASCII is a capital if lowering changes one of its bytes
            w = wide[k < _BYTES[a[wide]]]
            self.capital[w] |= words.data[words.start[w] + k] != low.data[np.minimum(low.start[w] + k, len(low.data) - 1)]
        after_number = np.zeros(n, bool)
        after_number[1:] = self.num[:-1] & ~self.lead[1:]
        maybe = np.flatnonzero(after_number & ~self.num)
        self.unit = np.zeros(n, bool)
        self.unit[maybe] = np.isin(self.hash[maybe], _hashes_of(UNITS)) if len(maybe) else False

    def names(self) -> np.ndarray:
        """Capitalised words within sentences."""
        return self.capital & ~self.begins & ~self.unit

    def all_names(self) -> np.ndarray | None:
        """These, and the same text's words that begin a sentence and are such names elsewhere; None if there are no more."""
        name = self.names()
        key = K.mix(self.hash + self.doc.astype(U64) * U64(K.WORD_BASE))
        more = self.capital & self.begins & ~self.unit
        more[more] = np.isin(key[more], key[name])
        return name | more if more.any() else None


class Templates:
    """Template tokens of a chunk: `code` (placeholder or word hash), `value` (hash of what stands there), `slot`, `doc`, `first`, `word` (first word) and `run` for window hashes.

    `name` tells the names among the words; None stands for plain words without slots.
    """

    def __init__(self, tokens: Tokens, name: np.ndarray | None):
        h, d, n = tokens.hash, tokens.doc, len(tokens.hash)
        code, slot = h, np.zeros(n, bool)
        if name is not None:
            code = h.copy()
            code[tokens.num], code[name], code[tokens.unit] = U64(_NUM), U64(_NAME), U64(_UNIT)
            slot = tokens.num | name | tokens.unit
        more = np.zeros(n, bool)  # a further word of the same slot, as in 3.5 or a full name
        if n > 1:
            more[1:] = slot[1:] & slot[:-1] & (code[1:] == code[:-1]) & ~tokens.lead[1:] & ~tokens.unit[1:]
        keep = np.flatnonzero(~more)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(K.mix(h + U64(1)))])
        ends = np.append(keep[1:], n)[: len(keep)]
        self.code, self.slot, self.doc, self.word = code[keep], slot[keep], d[keep], keep
        self.value = total[ends] - total[keep]
        self.first = np.searchsorted(keep, tokens.first)
        p, _ = K.powers(K.WORD_BASE, len(keep) + 1)
        self.run = np.concatenate([np.zeros(1, U64), np.cumsum(self.code * p[: len(keep)])])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.code) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.code) - n + 1])
        return at, K.span(self.run, at, n)


def readings(column):
    """(first row, end row, templates, templates with names that begin sentences or None, plain words), chunk by chunk."""
    for row, end, words in K.tokenised(column, "ALNUM"):
        tokens = Tokens(words)
        name = tokens.all_names()
        yield row, end, (Templates(tokens, tokens.names()), None if name is None else Templates(tokens, name), Templates(tokens, None))


def templates(column):
    for row, end, (t, _, _) in readings(column):
        yield row, end, t


class Index:
    """Windows of the items in some of their readings; an entry is one reading of one item."""

    def __init__(self):
        self.owner, self.code, self.value, self.slot, self.word, self.lengths = [], [], [], [], [], {}

    def add(self, owner: int, t: Templates, i: int, words: int, first: int) -> None:
        """Text i of t, which has `words` words, of which the first is word `first` of the chunk."""
        s = slice(t.first[i], t.first[i + 1])
        self.owner.append(owner)
        self.code.append(t.code[s])
        self.value.append(t.value[s])
        self.slot.append(t.slot[s])
        self.word.append(np.append(t.word[s] - first, words))

    def build(self) -> None:
        by = {}
        for i, c in enumerate(self.code):
            if len(c):
                by.setdefault(min(len(c), WINDOW), []).append(i)
        p, _ = K.powers(K.WORD_BASE, max([64, *(len(c) + 1 for c in self.code)]))
        for n, entries in by.items():
            hs, entry, pos = [], [], []
            for i in entries:
                run = np.concatenate([np.zeros(1, U64), np.cumsum(self.code[i] * p[: len(self.code[i])])])
                at = np.arange(len(self.code[i]) - n + 1)
                hs.append(K.span(run, at, n))
                entry.append(np.full(len(at), i))
                pos.append(at)
            h, o, q = np.concatenate(hs), np.concatenate(entry), np.concatenate(pos)
            order = np.argsort(h, kind="stable")
            gate = np.zeros(1 << 20, bool)
            gate[(h >> U64(44)).astype(np.int64)] = True
            self.lengths[n] = (h[order], o[order], q[order], gate)
        sizes = np.array([len(c) for c in self.code], np.int64)
        self.at = np.cumsum(sizes) - sizes
        self.flat = np.concatenate(self.code) if self.code else np.zeros(0, U64)


class Items:
    """Benchmark items: an index of their templates, with and without names that begin sentences, and one of their plain words; `tokens` are the words at which template tokens begin."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.tokens, self.slots, self.plain, self.templates = np.array(ids, np.int64), [], [], Index(), Index()
        for _, _, (t, named, plain) in readings(pa.array(texts, pa.string())):
            for i in range(len(t.first) - 1):
                owner, first, words = len(self.tokens), int(plain.first[i]), int(plain.first[i + 1] - plain.first[i])
                self.templates.add(owner, t, i, words, first)
                self.tokens.append(self.templates.word[-1])
                self.slots.append(self.templates.slot[-1])
                if named is not None:
                    self.templates.add(owner, named, i, words, first)
                self.plain.add(owner, plain, i, words, first)
        self.templates.build()
        self.plain.build()


def _matches(t: Templates, items: Index):
    """(document in chunk, entry, document position, item position, length) of all windows in common."""
    out = []
    for n, (h, owner, pos, gate) in items.lengths.items():
        at, w = t.windows(n)
        hit = gate[(w >> U64(44)).astype(np.int64)]
        at, w = at[hit], w[hit]
        lo, hi = np.searchsorted(h, w, "left"), np.searchsorted(h, w, "right")
        k = hi - lo
        if not k.sum():
            continue
        at = np.repeat(at, k)
        j = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        same = np.ones(len(at), bool)
        for x in range(n):  # the tokens themselves, not only the window's hash
            same &= t.code[at + x] == items.flat[items.at[owner[j]] + pos[j] + x]
        at, j = at[same], j[same]
        out.append(np.stack([t.doc[at], owner[j], at, pos[j], np.full(len(at), n)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def _consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a -> b is a one-to-one mapping of slot values."""
    pairs = len(np.unique(np.stack([a, b], axis=1), axis=0)) if len(a) else 0
    return pairs == len(np.unique(a)) == len(np.unique(b))


def _spans(t: Templates, items: Index):
    """(document, entry, document token, entry token, tokens) of merged windows on one diagonal with consistent slots."""
    m = _matches(t, items)
    if not len(m):
        return
    m = m[np.lexsort((m[:, 2], m[:, 2] - m[:, 3], m[:, 1], m[:, 0]))]
    diagonal = m[:, 2] - m[:, 3]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:, 0] != m[:-1, 0]) | (m[1:, 1] != m[:-1, 1]) | (diagonal[1:] != diagonal[:-1]) | (m[1:, 2] > m[:-1, 2] + m[:-1, 4])
    edge = np.append(np.flatnonzero(new), len(m))
    for s, e in zip(edge[:-1], edge[1:]):
        d, i, at, p, _ = m[s].tolist()
        n = int(m[e - 1, 2] + m[e - 1, 4]) - at
        slot = items.slot[i][p : p + n]
        if _consistent(items.value[i][p : p + n][slot], t.value[at : at + n][slot]):
            yield d, i, at, p, n


def find(texts: tuple[Templates, Templates | None, Templates], items: Items):
    """For each document and item with consistent matches in any reading: (document, item, tokens covered, tokens of the item, slots, changed slots)."""
    spans: dict[tuple[int, int], list] = {}
    for t, index in ((texts[0], items.templates), (texts[1], items.templates), (texts[2], items.plain)):
        for d, i, at, p, n in _spans(t, index) if t is not None else ():
            owner, word = index.owner[i], index.word[i]
            if index is items.plain:
                tokens, k = items.tokens[owner][:-1], items.slots[owner]
                slots = tokens[k & (tokens >= p) & (tokens < p + n)]
                changed = np.zeros(len(slots), bool)
            else:
                k = index.slot[i][p : p + n]
                slots = word[p : p + n][k]
                changed = index.value[i][p : p + n][k] != t.value[at : at + n][k]
            spans.setdefault((d, owner), []).append((int(word[p]), int(word[p + n]), slots, changed))
    for (d, i), found in spans.items():
        tokens = items.tokens[i]
        on = np.zeros(tokens[-1], bool)
        slots = changed = 0
        for b, e, k, c in sorted(found, key=lambda x: (x[0] - x[1], x[0], int(x[3].sum()))):
            new = ~on[k]  # a slot that another passage or reading has covered isn't counted again
            slots, changed = slots + int(new.sum()), changed + int((new & c).sum())
            on[b:e] = True
        covered = int(np.logical_and.reduceat(on, tokens[:-1]).sum())
        yield d, i, covered, len(tokens) - 1, slots, changed


_FOUND = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int32()), ("item_tokens", pa.int32()), ("slots", pa.int32()), ("changed", pa.int32())])
_FOUND_SQL = "doc_id bigint, d1 bigint, d2 bigint, item_id bigint, covered int, item_tokens int, slots int, changed int"


def _digests() -> list:
    return [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text").alias("d2")]


def _told(items: Items, coverage: float, columns) -> pa.RecordBatch | None:
    """Rows of _FOUND for columns doc_id, text, d1, d2."""
    ids, text, d1, d2 = columns
    ids, d1, d2 = (x.to_numpy() for x in (ids, d1, d2))
    out = [(int(ids[row + d]), int(d1[row + d]), int(d2[row + d]), int(items.ids[i]), *x) for row, _, t in readings(text) for d, i, *x in find(t, items) if x[0] >= coverage * x[1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND) if out else None


def _sorted_windows(readings_of, lengths):
    """Hashes of the windows of `lengths` tokens of each text of a chunk in all readings: (text, hash), repetitions taken out."""
    doc, h = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for t in readings_of:
        for n in lengths if t is not None else ():
            at, w = t.windows(n)
            doc.append(t.doc[at])
            h.append(w)
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _joined(rows: DataFrame, texts: DataFrame, coverage: float, items_per_pass: int, docs_per_task: int) -> DataFrame:
    """Rows of _FOUND by a join of window hashes, for benchmarks that aren't to be broadcast: documents go to the shards of items with which they have a window in common."""
    spark = rows.sparkSession
    shards = -(-texts.count() // items_per_pass)
    items = common.materialise(texts.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")), "benchmark")

    def of_items(batches):
        for b in batches:
            shard = b.column(1).to_numpy()
            for row, end, r in readings(b.column(0)):
                for n in range(1, WINDOW + 1):
                    doc, h = _sorted_windows(r, (n,))
                    # an item shorter than a window is sought as a whole
                    size = [np.diff(t.first)[doc] if t is not None else np.zeros(len(doc), int) for t in r]
                    on = np.logical_or.reduce([np.minimum(x, WINDOW) == n for x in size])
                    yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(shard[row + doc[on]]), pa.array(np.full(int(on.sum()), n, np.int32))], names=["h", "shard", "n"])

    windows = common.materialise(items.select("text", "shard").mapInArrow(of_items, "h bigint, shard int, n int").distinct(), "benchmark-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW
    # a bitmap of 4 MB keeps windows that no item has from being shuffled
    bits = windows.select(F.shiftrightunsigned("h", 39).alias("bit")).distinct().groupBy(F.floor(F.col("bit") / (1 << 19)).cast("int").alias("block"))
    packed = bits.applyInArrow(lambda t: pa.table({"block": t["bit"].slice(0, 1).cast(pa.int64()), "bits": [np.packbits(np.bincount(t["bit"].to_numpy() % (1 << 19), minlength=1 << 19) > 0).tobytes()]}), "block bigint, bits binary")
    have = {int(r["block"]) >> 19: bytes(r["bits"]) for r in packed.collect()}  # 64 blocks
    sent = spark.sparkContext.broadcast(b"".join(have.get(i, bytes(1 << 16)) for i in range(64)))

    def of_docs(batches):
        gate = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            ids = b.column(0)
            for row, end, r in readings(b.column(1)):
                doc, h = _sorted_windows(r, lengths)
                at = (h >> U64(39)).astype(np.int64)
                on = gate[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row).take(pa.array(doc[on])), pa.array(h[on].view(np.int64))], names=["doc_id", "h"])

    met = rows.select("doc_id", "text").mapInArrow(of_docs, "doc_id bigint, h bigint").join(windows.select("h", "shard").distinct(), "h").select("doc_id", "shard").distinct()
    met = common.materialise(met, "benchmark-candidates")
    # a shard that many documents share is searched by several tasks
    tasks = met.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / docs_per_task).alias("tasks"))
    met = met.join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id"), F.col("tasks")))
    left = rows.join(met, "doc_id").select("shard", "task", "doc_id", "text", "d1", "d2")
    right = items.join(tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))

    def search(docs: pa.Table, part: pa.Table) -> pa.Table:
        part = part.sort_by([("item_id", "ascending"), ("text", "ascending")])
        items, got = Items(part["item_id"].to_pylist(), part["text"].to_pylist()), []
        for b in docs.to_batches() if part.num_rows else ():
            got.append(_told(items, coverage, [b.column(c) for c in ("doc_id", "text", "d1", "d2")]))
        K.trim()
        return pa.Table.from_batches([x for x in got if x is not None], schema=_FOUND)

    return left.groupBy("shard", "task").cogroup(right.select("shard", "task", "item_id", "text").groupBy("shard", "task")).applyInArrow(search, _FOUND_SQL)


def _contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float, items_per_pass: int, docs_per_task: int = 20_000) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", *_digests())
    texts = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    part = texts.limit(items_per_pass + 1).collect()
    if len(part) > items_per_pass:
        return _joined(rows, texts, coverage, items_per_pass, docs_per_task)
    part = sorted((r[0], r[1]) for r in part)
    sent = spark.sparkContext.broadcast(([i for i, _ in part], [t for _, t in part]))

    def search(batches):
        items = Items(*sent.value)
        for b in batches:
            got = _told(items, coverage, b.columns)
            if got is not None:
                yield got
        K.trim()

    return rows.mapInArrow(search, _FOUND_SQL)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, items_per_pass: int = 20_000) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, slots, changed): documents that hold at least `coverage` of an item's template.

    `covered` of `item_tokens` template tokens occur in the document in windows of
    WINDOW tokens (items shorter than that as a whole) with consistent slots, or in
    as long windows of equal words, however they are capitalised;
    `changed` of the `slots` in them have other values than the item, 0 for a plain
    copy. Documents are searched whole, at any length. Null or empty texts match
    nothing; rows without id are left out; repeated rows are told as often as they
    occur, each by its own text; items that repeat an id are sought each; other
    columns are ignored; empty tables give no rows.

    Up to `items_per_pass` items are broadcast with their windows, so that the
    hash join needs no shuffle. A larger benchmark is split into shards of that
    size, and windows are joined by a shuffle: the documents are read once to find
    the shards with which they have a window in common, and once to be sent there.
    """
    return _contaminated(docs, benchmark, coverage, items_per_pass).select("doc_id", "item_id", "covered", "item_tokens", "slots", "changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, items_per_pass: int = 20_000) -> DataFrame:
    """The documents in which `contaminated` finds no item.

    Every row is settled by its own text, also where rows repeat a doc_id. Rows with
    a null or empty text or a null doc_id all stay. All columns are kept, whatever
    their names; an empty table stays empty.
    """
    gone = common.materialise(_contaminated(docs, benchmark, coverage, items_per_pass).select("doc_id", "d1", "d2").distinct(), "contaminated")
    small = gone.count() * 48 <= 64 << 20
    names = {c: common.unused(docs, f"_{c}") for c in gone.columns}
    gone = gone.select(*[F.col(c).alias(n) for c, n in names.items()])
    on = (F.col("doc_id").cast("bigint") == F.col(names["doc_id"])) & (F.xxhash64("text") == F.col(names["d1"])) & (F.xxhash64(F.lit("second"), "text") == F.col(names["d2"]))
    return docs.join(F.broadcast(gone) if small else gone, on, "left_anti").select(docs.columns)
