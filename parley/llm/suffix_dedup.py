"""Repeated passages by a hash-compared suffix sort.

A passage is a run of at least LENGTH words (white space aside) that occurs at
two places or more, in one text or in several. Every window of LENGTH words has
an anchor, the least-hashed GRAM-word run within it, so two equal windows have
equal anchors at equal offsets. Anchors that occur once in the corpus can't
belong to a passage; what surrounds the others is brought together by anchor
hash, and there the suffixes that start at the same offset from equal anchors
are sorted: a mergesort in which two suffixes are compared by finding their
common extension through binary search over prefix polynomial hashes, in
logarithmic time. Neighbours with a common extension of LENGTH words or more are
repeats, once their words have been compared one by one, so that a hash
collision can't make a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import kernel as K

U64 = np.uint64
LENGTH = 50
GRAM = 16
_POS = 28  # bits for a word's position in a chunk


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every i, from prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchored(words: K.Words, length: int, gram: int):
    """(window starts, anchor positions, anchor hashes) of all windows of a chunk."""
    n = len(words)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64)
    if n >> _POS:
        raise ValueError("a text of more than 2**28 words")
    run = words.prefix()
    h = K.span(run, np.arange(n - gram + 1), gram)
    # ties of the upper hash bits go to the leftmost, in every copy alike
    low = _sliding_min(h >> U64(_POS) << U64(_POS) | np.arange(len(h), dtype=U64), length - gram + 1)
    at = np.flatnonzero(words.doc[length - 1 :] == words.doc[: n - length + 1])
    anchor = (low[at] & U64((1 << _POS) - 1)).astype(np.int64)
    return at, anchor, h[anchor]


def _anchors(length, gram, parts):
    out = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches):
        for b in batches:
            got = []
            for _, _, words in K.tokenised(b.column(0)):
                at, anchor, h = anchored(words, length, gram)
                if len(at):
                    new = np.ones(len(at), bool)
                    new[1:] = anchor[1:] != anchor[:-1]
                    got.append(h[new])
            if got:
                h = np.sort(np.concatenate(got))
                h = h[np.concatenate([np.ones(min(2, len(h)), bool), h[2:] != h[:-2]])]  # twice is often enough, however often an anchor occurs
                used, raw = common.blobs(((h >> U64(20)) % U64(parts)).astype(np.int64), parts, h)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(raw, pa.binary())], schema=out)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    h = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table["blob"]]))
    again = h[1:][h[1:] == h[:-1]]
    return pa.table([np.unique(again).view(np.int64)], names=["h"])


def _bitmap(bits: int):
    """Bits of a block of hashes; block and bit come from different parts of the hash."""

    def run(table: pa.Table) -> pa.Table:
        m = np.zeros(1 << (bits - 6), bool)
        for p in _probe_places(table["h"].to_numpy().view(U64), bits):
            m[p] = True
        return pa.table([table["block"].slice(0, 1), pa.array([np.packbits(m).tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _probe_places(h: np.ndarray, bits: int):
    x = K.mix(h)
    for shift in (0, 29):
        yield ((x >> U64(shift)) & U64((1 << (bits - 6)) - 1)).astype(np.int64)


_KIND = np.dtype([("h", "<u8"), ("doc", "<i8"), ("first", "<i4"), ("before", "<i2"), ("starts", "<i2"), ("words", "<i2"), ("size", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("stop", "<i4")])
_PACKED = pa.schema([("bucket", pa.int32()), ("meta", pa.binary()), ("text", pa.binary()), ("spans", pa.binary())])
_PACKED_SQL = "bucket int, meta binary, text binary, spans binary"


def _merged(spans: np.ndarray) -> np.ndarray:
    """Window starts `start` up to `stop`, with those that touch or overlap in one document put together."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    doc, stop = spans["doc"], spans["stop"].astype(np.int64)
    order = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 33
    far = np.maximum.accumulate(stop + order) - order  # the furthest stop so far within the document
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (spans["start"][1:] > far[:-1])])
    out = spans[new]
    out["stop"] = np.maximum.reduceat(stop, np.flatnonzero(new))
    return out


def _segments(length, gram, parts, bits, sent, hold=4 << 20):
    """What surrounds possibly repeated anchors, as packed records and the words' bytes, by bucket.

    Equal segments of one task prove each other to be repeated: their window starts
    are told as spans, and the segment is sent once, to be compared with those of
    other tasks. So a passage that many texts share is sent about once by each task.
    """

    def run(batches):
        blocks = np.frombuffer(sent.value, np.uint8).reshape(64, -1)
        metas, pieces, held, often, often_bytes = [], [], 0, {}, 0

        def packed():
            nonlocal often_bytes
            m = np.concatenate(metas)
            send, proved, here = np.ones(len(m), bool), np.zeros(len(m), bool), {}
            for i, key in enumerate(zip(pieces, m["before"].tolist(), m["starts"].tolist())):
                if key in often:  # sent and seen twice by this task before
                    send[i], proved[i] = False, True
                    continue
                at = here.setdefault(key, i)
                if at != i:
                    send[i], proved[i], proved[at] = False, True, True
                    if key not in often and often_bytes < 8 << 20:
                        often[key] = None
                        often_bytes += len(key[0]) + 100
            spans = np.zeros(int(proved.sum()), _SPAN)
            spans["doc"], spans["start"] = m["doc"][proved], m["first"][proved]
            spans["stop"] = spans["start"] + m["starts"][proved]
            spans = _merged(spans)
            bucket = ((m["h"] >> U64(20)) % U64(parts)).astype(np.int64)
            order = np.flatnonzero(send)
            order = order[np.argsort(bucket[order], kind="stable")]
            edge = np.searchsorted(bucket[order], np.arange(parts + 1))
            to = (K.mix(spans["doc"].view(U64)) % U64(parts)).astype(np.int64) if len(spans) else np.zeros(0, np.int64)
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(edge) + np.diff(cut))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()), pa.array([m[order[edge[u] : edge[u + 1]]].tobytes() for u in used], pa.binary()),
                    pa.array([b"".join([pieces[i] for i in order[edge[u] : edge[u + 1]].tolist()]) for u in used], pa.binary()), pa.array([spans[by[cut[u] : cut[u + 1]]].tobytes() for u in used], pa.binary()),
                ],
                schema=_PACKED,
            )
            metas.clear()
            pieces.clear()
            return batch

        for b in batches:
            ids = b.column(0).to_numpy()
            for row, _, words in K.tokenised(b.column(1)):
                at, anchor, h = anchored(words, length, gram)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
                lead = np.flatnonzero(new)
                starts = np.diff(np.append(lead, len(at)))
                hh = h[lead]
                maybe = np.ones(len(lead), bool)
                for p in _probe_places(hh, bits):
                    maybe &= blocks[(hh >> U64(58)).astype(np.int64), p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1 == 1
                lead, starts, hh = lead[maybe], starts[maybe], hh[maybe]
                if not len(lead):
                    continue
                w = at[lead]
                last = w + starts - 1 + length - 1
                m = np.zeros(len(lead), _KIND)
                m["h"], m["doc"], m["first"] = hh, ids[row + words.doc[w]], w - words.first[words.doc[w]]
                m["before"], m["starts"], m["words"] = anchor[lead] - w, starts, last - w + 1
                m["size"] = words.end[last] - words.start[w]
                metas.append(m)
                raw = words.data.tobytes()
                pieces += [raw[x:y] for x, y in zip(words.start[w].tolist(), words.end[last].tolist())]
                held += int(m["size"].sum())
                if held > hold:
                    yield packed()
                    held = 0
        if pieces:
            yield packed()
        often.clear()
        K.trim()

    return run


class Suffixes:
    """Suffixes of segments by their start word, compared through prefix hashes; each ends with its segment."""

    def __init__(self, ids: np.ndarray, run: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.ids, self.run, self.at, self.end = ids, run, at, end

    def extension(self, x: np.ndarray, y: np.ndarray, bound: int) -> np.ndarray:
        """Length of the common beginning of suffixes x and y, up to `bound`: binary search for the longest equal prefix hash."""
        a, b = self.at[x], self.at[y]
        low = np.zeros(len(x), np.int64)
        high = np.minimum(np.minimum(self.end[x] - a, self.end[y] - b), bound)
        whole = K.span(self.run, a, high) == K.span(self.run, b, high)
        low[whole] = high[whole]
        open_ = np.flatnonzero(~whole)
        high[open_] -= 1
        while len(open_):
            mid = (low[open_] + high[open_] + 1) >> 1
            same = K.span(self.run, a[open_], mid) == K.span(self.run, b[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low

    def less(self, x: np.ndarray, y: np.ndarray, bound: int) -> np.ndarray:
        """Whether suffix x sorts before y: by the word after the common beginning, shorter first; ties by number."""
        n = self.extension(x, y, bound)
        a, b = self.at[x] + n, self.at[y] + n
        more_a, more_b = (a < self.end[x]) & (n < bound), (b < self.end[y]) & (n < bound)
        wa = np.where(more_a, self.ids[np.minimum(a, len(self.ids) - 1)], -1)
        wb = np.where(more_b, self.ids[np.minimum(b, len(self.ids) - 1)], -1)
        return np.where(wa != wb, wa < wb, x < y)

    def sort(self, group: np.ndarray, bound: int) -> np.ndarray:
        """Order of all suffixes, by group (given in ascending order) and within it by content: mergesort, all groups' merges of a level at once."""
        n = len(group)
        order = np.arange(n)
        lead = np.ones(n, bool)
        lead[1:] = group[1:] != group[:-1]
        begin = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        size = np.diff(np.append(np.flatnonzero(lead), n))
        stop = begin + np.repeat(size, size)
        width = 1
        active = np.flatnonzero(stop - begin > 1)
        while len(active):
            place = active - begin[active]
            left = place // width % 2 == 0
            run = begin[active] + place // width * width
            other = np.where(left, run + width, run - width)
            other_end = np.minimum(other + width, stop[active])
            other = np.minimum(other, other_end)
            # each suffix's place among the sibling run, by binary search
            low, high = other.copy(), other_end.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(order[mid], order[active[open_]], bound)
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
                open_ = open_[low[open_] < high[open_]]
            pair = np.where(left, run, run - width)
            target = pair + (active - run) + (low - other)
            new = order.copy()
            new[target] = order[active]
            order = new
            width *= 2
            active = active[(stop - begin)[active] > width]
        return order


def repeats(meta: np.ndarray, raw: np.ndarray, length: int):
    """(document, first word, number of window starts) of repeated windows among segments: arrays."""
    offsets = np.concatenate([[0], np.cumsum(meta["size"].astype(np.int64))])
    words = K.Words(raw, offsets, "SPACE")
    # the words themselves, numbered: equal numbers are equal words, whatever their hashes
    off = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    take = np.repeat(words.start - off[:-1], words.end - words.start) + np.arange(off[-1])
    tokens = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(off), pa.py_buffer(raw[take]))
    ids = tokens.dictionary_encode().indices.to_numpy().astype(np.int64)
    run = words.prefix()
    first = words.first[:-1]
    n = meta["starts"].astype(np.int64)
    seg = np.repeat(np.arange(len(meta)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[seg] + step
    gap = meta["before"].astype(np.int64)[seg] - step  # words between a suffix's start and its anchor
    anchor, key = np.unique(meta["h"], return_inverse=True)
    group = key[seg] * (1 << 12) + gap
    by = np.lexsort((at, group))
    group = group[by]
    shared = np.zeros(len(group), bool)
    eq = group[1:] == group[:-1]
    shared[1:] = eq
    shared[:-1] |= eq
    by, group = by[shared], group[shared]
    if not len(by):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = Suffixes(ids, run, at[by], words.first[1:][seg[by]])
    order = s.sort(group, length)
    x, y = order[:-1], order[1:]
    near = np.flatnonzero(group[x] == group[y])
    x, y = x[near], y[near]
    ok = s.extension(x, y, length) >= length
    x, y = x[ok], y[ok]
    hit = np.zeros(len(by), bool)
    for k in range(0, len(x), 1 << 16):  # hash-equal neighbours must be equal word by word
        a, b = s.at[x[k : k + (1 << 16)]], s.at[y[k : k + (1 << 16)]]
        same = np.ones(len(a), bool)
        for j in range(length):
            same &= ids[a + j] == ids[b + j]
        hit[x[k : k + (1 << 16)][same]] = True
        hit[y[k : k + (1 << 16)][same]] = True
    back = by[hit]
    return seg[back], step[back]


_OUT = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32())])


def _windows_alike(meta: np.ndarray, texts: list, length: int, part_bytes: int):
    """Single windows of one anchor's segments whose hashes occur twice or more, as segments of their own in parts of about `part_bytes`: for anchors that are too frequent to be sorted at once."""
    edge = np.cumsum(meta["size"].astype(np.int64))
    n = meta["starts"].astype(np.int64)
    cuts = np.unique(np.searchsorted(edge, np.arange(part_bytes, edge[-1] + part_bytes, part_bytes)))
    chunks = [(a, min(b + 1, len(meta))) for a, b in zip(np.concatenate([[0], cuts[:-1] + 1]).tolist(), cuts.tolist()) if a < len(meta)]

    def windows(a, b):
        raw = np.concatenate(texts[a:b])
        words = K.Words(raw, np.concatenate([[0], np.cumsum(meta["size"][a:b].astype(np.int64))]), "SPACE")
        k = n[a:b]
        seg = np.repeat(np.arange(b - a), k)
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        return raw, words, seg, step, words.first[:-1][seg] + step

    h = []
    for a, b in chunks:
        _, words, _, _, at = windows(a, b)
        h.append(K.span(words.prefix(), at, length))
    whole = np.sort(np.concatenate(h))
    again = np.unique(whole[1:][whole[1:] == whole[:-1]])
    del whole
    # equal hashes go to the same part
    parts = 1 + sum(int(np.isin(x, again).sum()) for x in h) * 8 * length // part_bytes
    metas, pieces = [[] for _ in range(parts)], [[] for _ in range(parts)]
    for (a, b), x in zip(chunks, h):
        on = np.flatnonzero(np.isin(x, again))
        if not len(on):
            continue
        raw, words, seg, step, at = windows(a, b)
        seg, step, at = seg[on], step[on], at[on]
        m = meta[a:b][seg]
        m["first"] += step.astype(np.int32)
        m["before"] -= step.astype(np.int16)
        m["starts"], m["words"] = 1, length
        begin, end = words.start[at], words.end[at + length - 1]
        m["size"] = end - begin
        part = (K.mix(x[on]) % U64(parts)).astype(np.int64)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            metas[p].append(m[mine])
            pieces[p] += [raw[i:j] for i, j in zip(begin[mine].tolist(), end[mine].tolist())]
    for m, text in zip(metas, pieces):
        if m:
            yield np.concatenate(m), text


def _sorted_bucket(length, part_bytes=1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas, raws, spans = [], [], []
        for b in batches:
            for m, t, x in zip(b.column("meta"), b.column("text"), b.column("spans")):
                if x.as_buffer().size:
                    spans.append(np.frombuffer(x.as_buffer().to_pybytes(), _SPAN))
                if m.as_buffer().size:
                    metas.append(np.frombuffer(m.as_buffer().to_pybytes(), _KIND))
                    raws.append(np.frombuffer(t.as_buffer().to_pybytes(), np.uint8))
        found, held = spans, 0

        def told():
            s = _merged(np.concatenate(found))
            return pa.RecordBatch.from_arrays([pa.array(s["doc"]), pa.array(s["start"]), pa.array(s["stop"] + np.int32(length - 1))], schema=_OUT)

        def compare(m, texts):
            seg, step = repeats(m, np.concatenate(texts), length)
            s = np.zeros(len(seg), _SPAN)
            s["doc"], s["start"] = m["doc"][seg], m["first"][seg] + step
            s["stop"] = s["start"] + 1
            found.append(_merged(s))

        if metas:
            # where each segment's bytes are: which blob, and where in it
            blob = np.repeat(np.arange(len(metas)), [len(m) for m in metas])
            begin = np.concatenate([np.cumsum(m["size"].astype(np.int64)) - m["size"] for m in metas])
            meta = np.concatenate(metas)
            metas.clear()
            text = lambda i: raws[blob[i]][begin[i] : begin[i] + meta["size"][i]]
            # segments of one anchor stay together; a bucket is worked off in parts of bounded size
            order = np.argsort(meta["h"], kind="stable")
            h = meta["h"][order]
            lead = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            count = np.diff(lead)
            load = np.add.reduceat(meta["size"][order].astype(np.int64), lead[:-1])
            load[count < 2] = 0
            hot = np.flatnonzero(load > 4 * part_bytes)
            part = np.where(load > 4 * part_bytes, 0, load)
            part = (np.cumsum(part) - 1) // part_bytes
            use = (count > 1) & (load <= 4 * part_bytes)
            each = np.repeat(use, count)
            by = np.repeat(part, count)[each]
            mine = order[each]
            for x in np.split(mine, np.flatnonzero(by[1:] != by[:-1]) + 1) if len(mine) else ():
                compare(meta[x], [text(i) for i in x.tolist()])
                held += 1
                if held % 64 == 0:
                    yield told()
                    found.clear()
            for a in hot:
                x = order[lead[a] : lead[a + 1]]
                for m, t in _windows_alike(meta[x], [text(i) for i in x.tolist()], length, part_bytes):
                    compare(m, t)
                yield told() if found else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _OUT], schema=_OUT)
                found.clear()
            del meta, order, h, mine, each, by
        if found:
            yield told()
        del metas, raws, spans, found
        K.trim()

    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, filter_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, start_word, end_word): the maximal spans of each text all of whose `length`-word windows occur elsewhere too.

    Words are runs of bytes other than ASCII white space, compared as they are and
    counted from 0; end_word is exclusive. A window that overlaps itself at another
    place of the same text counts as repeated. Texts of fewer than `length` words,
    null and empty ones have no spans; rows without doc_id are left out; rows that
    repeat a doc_id are texts of their own whose spans are united. Texts are
    processed whole at any length. Other columns are ignored; an empty table gives
    no rows. `gram` must not exceed `length`.

    The set of repeated anchors travels as a bitmap of at most `filter_bytes`: with
    more anchors than that can tell apart, more segments are shuffled and sorted in
    vain, but the result is the same.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = common.parts_for(rows, 32 << 20)
    anchors = rows.select("text").mapInArrow(_anchors(length, gram, parts), "bucket int, blob binary")
    again = common.materialise(anchors.groupBy("bucket").applyInArrow(_repeated, "h bigint"), "anchors")
    n = again.count()
    bits = min(max(16, int(16 * n).bit_length()), (8 * filter_bytes).bit_length() - 1)
    blocks = again.withColumn("block", F.shiftrightunsigned("h", 58).cast("int")).groupBy("block").applyInArrow(_bitmap(bits), "block int, bits binary").collect()
    parts_of = {r["block"]: bytes(r["bits"]) for r in blocks}
    sent = spark.sparkContext.broadcast(b"".join(parts_of.get(i, bytes(1 << (bits - 9))) for i in range(64)))
    segments = rows.mapInArrow(_segments(length, gram, parts, bits, sent), _PACKED_SQL)
    spans = segments.groupBy("bucket").applyInArrow(_sorted_bucket(length), "doc_id bigint, start_word int, end_word int")
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    far = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # spans of neighbouring windows overlap or their window starts touch
    fresh = spans.withColumn("new", F.when(far.isNull() | (F.col("start_word") > far - length + 1), 1).otherwise(0))
    runs = fresh.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("run")


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0b\x0c\r ]+'), lambda x: x <> '') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
x AS (SELECT r, doc_id, t, unnest(range(0, len(t) - 49)) AS i FROM w),
h AS (SELECT r, doc_id, i, array_to_string(t[i + 1 : i + 50], ' ') AS s FROM x),
d AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM d)
SELECT doc_id, min(i)::INTEGER AS start_word, (max(i) + 50)::INTEGER AS end_word FROM g GROUP BY doc_id, k
"""
