"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they merge to, leftmost first among equals: the best entry is taken, its
symbols are merged, and the entries of the two new neighbours follow. Since no
piece of such a vocabulary has a space mark after another character, texts fall
into units (a run of spaces and what follows it) that don't affect each other;
the agendas of all distinct units of an Arrow batch are worked off together,
each round taking the best entry of every unit, with numpy.

Characters without a piece fall back to their bytes. Every distinct unit is
also encoded by the sentencepiece library, and every text is decoded again.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import worker_cache

from . import common
from . import kernel as K

U64 = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_NONE = np.int64(1) << 40
LONG_UNIT = 256


class Vocabulary:
    """A sentencepiece model's pieces as arrays: merges by pair, single characters, byte pieces, bytes of pieces."""

    def __init__(self, path: str, by_library: bool = False):
        """by_library: new units are encoded by the library, which is faster; `agrees` then says nothing."""
        import sentencepiece

        self.by_library = by_library

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = lib.get_piece_size()
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        ids = {lib.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece has a space mark after another character: units can't be told apart")
        if lib.encode("a  b") == lib.encode("a b") or lib.decode(lib.encode("Ａ")) != "Ａ":
            raise ValueError("the model normalises texts; only identity normalisation is supported")
        order = sorted(normal, key=lambda i: (-lib.get_score(i), i))
        score_rank, last, r = {}, None, -1
        for i in order:  # equal scores have equal ranks
            if lib.get_score(i) != last:
                last, r = lib.get_score(i), r + 1
            score_rank[i] = r
        self.char = np.full(0x110000, -1, np.int32)
        keys, ranks, merged = [], [], []
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(" ") if p == MARK else ord(p)] = i
            for c in range(1, len(p)):
                a, b = ids.get(p[:c]), ids.get(p[c:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(score_rank[i])
                    merged.append(i)
        if MARK not in ids or any("\n" in p for p in ids):
            raise ValueError("the model must have the space mark as a piece and none with a line feed")
        self._table(np.array(keys, np.int64), np.array(ranks, np.int64), np.array(merged, np.int32))
        self.byte = np.full(256, -1, np.int32)
        for i in range(n):
            if lib.is_byte(i):
                self.byte[int(lib.id_to_piece(i)[3:-1], 16)] = i
        if (self.byte < 0).any():
            raise ValueError("the model must have byte pieces")
        text = [bytes([int(lib.id_to_piece(i)[3:-1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else lib.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_size = np.array([len(t) for t in text], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.unknown = lib.unk_id()
        self.mask = U64(2**64 - 1)  # the bits of units' hashes that are used
        self.forget()

    @staticmethod
    def of(path: str, by_library: bool = False) -> Vocabulary:
        kept = worker_cache()
        if ("vocabulary", path, by_library) not in kept:
            kept["vocabulary", path, by_library] = Vocabulary(path, by_library)
        return kept["vocabulary", path, by_library]

    def forget(self) -> None:
        """Empties the store of encoded units."""
        self.known = np.zeros(0, U64)
        self.known_at, self.known_size, self.known_ok = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.known_checked = np.zeros(0, bool)
        self.store = np.zeros(0, np.int32)
        self.unit_at, self.unit_size, self.units = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _table(self, keys, ranks, merged) -> None:
        """An open-addressing hash table of pairs."""
        self.bits = int(4 * max(len(keys), 1)).bit_length()
        size = 1 << self.bits
        self.pair_key, self.pair_rank, self.pair_merged = np.full(size, -1, np.int64), np.full(size, _NONE), np.zeros(size, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            s = slot[left]
            free = self.pair_key[s] < 0
            first = np.unique(s[free], return_index=True)[1]
            put = left[free][first]
            self.pair_key[slot[put]], self.pair_rank[slot[put]], self.pair_merged[slot[put]] = keys[put], ranks[put], merged[put]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left = left[rest]
            slot[left] = np.where(self.pair_key[slot[left]] >= 0, (slot[left] + 1) & (size - 1), slot[left])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that a and b merge to (_NONE if there is none), and the piece."""
        rank, merged = np.full(len(a), _NONE), np.zeros(len(a), np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[open_].astype(np.int64) * self.size + b[open_]
        slot = self._slot(key)
        while len(open_):
            at = self.pair_key[slot]
            hit = at == key
            rank[open_[hit]], merged[open_[hit]] = self.pair_rank[slot[hit]], self.pair_merged[slot[hit]]
            go = ~hit & (at >= 0)
            open_, key, slot = open_[go], key[go], (slot[go] + 1) & (len(self.pair_key) - 1)
        return rank, merged

    def merge(self, symbol: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (-1 for characters without a piece) of units, in order, after all merges; and where each began.

        Units of up to LONG_UNIT characters take their best entries together, round by
        round; each longer one has a heap of its own, as its rounds would be too many.
        """
        if not len(symbol):
            return symbol.copy(), np.arange(0)
        size = np.bincount(unit)
        long = np.flatnonzero(size > LONG_UNIT)
        if not len(long):
            return self._merge_short(symbol, unit)
        lead = np.searchsorted(unit, long)
        rest = np.ones(len(symbol), bool)
        parts = []
        for a, n in zip(lead.tolist(), size[long].tolist()):
            rest[a : a + n] = False
            s, b = self._merge_long(symbol[a : a + n])
            parts.append((s, b + a))
        keep = np.flatnonzero(rest)
        s, b = self._merge_short(symbol[keep], unit[keep])
        symbols, begins = np.concatenate([s, *(x for x, _ in parts)]), np.concatenate([keep[b], *(x for _, x in parts)])
        order = np.argsort(begins, kind="stable")
        return symbols[order], begins[order]

    def _merge_long(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(symbol)
        sym, nxt, prv = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def pair(a, b):
            got = known.get((a, b))
            if got is None:
                r, m = self.pairs(np.array([a]), np.array([b]))
                got = known[a, b] = int(r[0]), int(m[0])
            return got

        rank, merged = self.pairs(symbol[:-1], symbol[1:])
        hit = np.flatnonzero(rank < _NONE)
        heap = list(zip(rank[hit].tolist(), hit.tolist(), symbol[hit].tolist(), symbol[hit + 1].tolist(), merged[hit].tolist()))
        heapq.heapify(heap)
        alive = np.ones(n, bool)
        while heap:
            _, a, x, y, m = heapq.heappop(heap)
            b = nxt[a]
            if sym[a] != x or b >= n or sym[b] != y or not alive[a]:
                continue  # one of the two has been merged since
            sym[a], alive[b], sym[b] = m, False, -1
            c = nxt[a] = nxt[b]
            if c < n:
                prv[c] = a
                if sym[c] >= 0:
                    r, z = pair(m, sym[c])
                    if r < _NONE:
                        heapq.heappush(heap, (r, a, m, sym[c], z))
            p = prv[a]
            if p >= 0 and sym[p] >= 0:
                r, z = pair(sym[p], m)
                if r < _NONE:
                    heapq.heappush(heap, (r, p, sym[p], m, z))
        begin = np.flatnonzero(alive)
        return np.array(sym, symbol.dtype)[begin], begin

    def _merge_short(self, symbol: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = symbol.copy()
        begin = np.arange(len(symbol))
        if not len(symbol):
            return symbol, begin
        alive = np.ones(len(symbol), bool)
        place = np.arange(len(symbol))
        nxt, prv = place + 1, place - 1
        last = np.ones(len(symbol), bool)
        last[:-1] = unit[1:] != unit[:-1]
        first = np.ones(len(symbol), bool)
        first[1:] = last[:-1]
        nxt[last], prv[first] = -1, -1
        rank, merged = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int32)
        p = np.flatnonzero(~last)
        rank[p], merged[p] = self.pairs(symbol[p], symbol[nxt[p]])
        # the agendas: positions that may still merge, unit by unit
        held = np.flatnonzero(rank < _NONE)
        while len(held):
            u = unit[held]
            lead = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            key = rank[held] << 21 | (held - held[np.repeat(lead, np.diff(np.append(lead, len(held))))])
            best = np.minimum.reduceat(key, lead)
            p = held[lead] + (best & ((1 << 21) - 1))
            gone = nxt[p]
            symbol[p] = merged[p]
            alive[gone] = False
            rank[gone] = _NONE
            nxt[p] = nxt[gone]
            follow = nxt[p] >= 0
            prv[nxt[p][follow]] = p[follow]
            rank[p] = _NONE
            q = p[follow]
            rank[q], merged[q] = self.pairs(symbol[q], symbol[nxt[q]])
            q = prv[p]
            q = q[q >= 0]
            rank[q], merged[q] = self.pairs(symbol[q], symbol[nxt[q]])
            # a new pair may sit at a position that had none
            held = np.concatenate([held[rank[held] < _NONE], p[rank[p] < _NONE], q[rank[q] < _NONE]])
            held.sort(kind="stable")
            held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
        return symbol[alive], begin[alive]

    def encode_units(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, check: bool):
        """Ids of units (byte ranges), their counts, and whether the library agrees with each."""
        if self.by_library:
            ids = self._ids_by_library(raw.tobytes(), start, end)
            if None not in ids:
                per = np.array([len(x) for x in ids], np.int64)
                return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(per.sum())), per, np.ones(len(per), bool)
        size = end - start
        off = np.cumsum(size) - size
        take = np.repeat(start - off, size) + np.arange(size.sum())
        data = raw[take]
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        unit = np.repeat(np.arange(len(size)), size)[at]
        width = np.diff(np.append(at, len(data)))
        b = data.astype(np.int64)
        code = b[at].copy()
        for w, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            on = at[width == w]
            c = b[on] & mask
            for k in range(1, w):
                c = c << 6 | (b[on + k] & 0x3F)
            code[width == w] = c
        symbol, begin = self.merge(self.char[np.minimum(code, 0x10FFFF)], unit)
        # characters without a piece become their bytes
        count = np.where(symbol < 0, width[begin], 1)
        out = np.repeat(symbol, count)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            src = np.repeat(at[begin] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            out[lost] = self.byte[data[src[lost]]]
        per = np.bincount(unit[begin], count, minlength=len(size)).astype(np.int64)
        ok = np.ones(len(size), bool)
        if check and len(size):
            flat, edge = out.tolist(), np.concatenate([[0], np.cumsum(per)]).tolist()
            for i, ids in enumerate(self._ids_by_library(data.tobytes(), off, off + size)):
                ok[i] = ids == flat[edge[i] : edge[i + 1]]
        return out, per, ok

    def _ids_by_library(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> list[list[int] | None]:
        """What the library gives for units; None where it merges one with the line feed before it."""
        # it puts a space before each text: a unit's own first space stands for it, others follow a line feed
        spaced = [raw[a] == 32 for a in start.tolist()]
        probe = [raw[a + 1 : b].decode() if s else "\n" + raw[a:b].decode() for a, b, s in zip(start.tolist(), end.tolist(), spaced)]
        head = self.library.encode("\n")
        lone = self.library.encode("a ")[len(self.library.encode("a")) :]  # it encodes an empty text as nothing
        out = []
        for ids, text, s in zip(self.library.encode(probe, num_threads=1), probe, spaced):
            if not s:
                out.append(ids[len(head) :] if ids[: len(head)] == head else None)
            else:
                out.append(ids if text else lone)
        return out

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray, check: bool = True):
        """(ids, number of ids of each text, whether the library agrees) of a chunk of texts."""
        mark = np.flatnonzero(data == 0xE2)
        mark = mark[mark + 2 < len(data)]
        mark = mark[(data[mark + 1] == 0x96) & (data[mark + 2] == 0x81)]
        if len(mark):  # a text's own space mark counts as a space, as in the library
            keep = np.ones(len(data), bool)
            keep[mark + 1] = keep[mark + 2] = False
            data = data.copy()
            data[mark] = 32
            gone = np.concatenate([[0], np.cumsum(~keep)])
            data, offsets = data[keep], offsets - gone[offsets]
        size = np.diff(offsets)
        some = size > 0
        # a space before every text that isn't empty, as the model has a dummy prefix
        shift = np.cumsum(some)
        raw = np.full(len(data) + int(some.sum()), 32, np.uint8)
        raw[np.arange(len(data)) + np.repeat(shift, size)] = data
        edge = np.concatenate([[0], np.cumsum(size + some)])
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64), np.ones(len(size), bool)
        space = raw == 32
        cut = np.zeros(n, bool)
        cut[edge[:-1][some]] = True
        cut[1:] |= space[1:] & ~space[:-1]
        line = np.flatnonzero(raw == 10)  # no piece has a line feed
        cut[line] = True
        cut[line[line + 1 < n] + 1] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        p, q = K.powers(K.BYTE_BASE, n + 1)
        run = np.concatenate([np.zeros(1, U64), np.cumsum(K._CODE[raw] * p[:n])])
        h = K.mix((run[end] - run[start]) * q[start]) & self.mask
        size_of = end - start
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        # units are told apart by their bytes: those that differ from the first of their hash are encoded by themselves
        rep = first[which]
        odd = size_of != size_of[rep]
        differs = np.concatenate([[0], np.cumsum(raw[np.minimum(np.repeat(start[rep] - start, size_of) + np.arange(n), n - 1)] != raw)])
        odd |= differs[end] > differs[start]
        if len(self.known) > 300_000:
            self.forget()
        pos = np.searchsorted(self.known, distinct)
        have = np.zeros(len(distinct), bool)
        inside = pos < len(self.known)
        have[inside] = self.known[pos[inside]] == distinct[inside]
        at_known = np.flatnonzero(have)
        if len(at_known):  # the same of units that were kept
            k, f = pos[at_known], first[at_known]
            same = self.unit_size[k] == size_of[f]
            j = np.flatnonzero(same)
            m = size_of[f[j]]
            off = np.concatenate([[0], np.cumsum(m)])
            step = np.arange(off[-1]) - np.repeat(off[:-1], m)
            wrong = np.concatenate([[0], np.cumsum(self.units[np.repeat(self.unit_at[k[j]], m) + step] != raw[np.repeat(start[f[j]], m) + step])])
            same[j] = wrong[off[1:]] == wrong[off[:-1]]
            odd |= np.isin(which, at_known[~same]) if not same.all() else False
        if check:  # units that were kept without asking the library
            again = np.flatnonzero(have)
            again = again[~self.known_checked[pos[again]] & ~odd[first[again]]]
            if len(again):
                self.known_ok[pos[again]] = self.encode_units(raw, start[first[again]], end[first[again]], True)[2]
                self.known_checked[pos[again]] = True
        new = np.flatnonzero(~have)
        if len(new):
            out, per, ok = self.encode_units(raw, start[first[new]], end[first[new]], check)
            at = len(self.store) + np.cumsum(per) - per
            self.store = np.concatenate([self.store, out])
            m = size_of[first[new]]
            unit_at = len(self.units) + np.cumsum(m) - m
            self.units = np.concatenate([self.units, raw[np.repeat(start[first[new]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]])
            ins = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, ins, distinct[new])
            self.known_checked = np.insert(self.known_checked, ins, check)
            self.known_at, self.known_size, self.known_ok = np.insert(self.known_at, ins, at), np.insert(self.known_size, ins, per), np.insert(self.known_ok, ins, ok)
            self.unit_at, self.unit_size = np.insert(self.unit_at, ins, unit_at), np.insert(self.unit_size, ins, m)
        slot = np.searchsorted(self.known, distinct)[which]
        per, at, agreed, store = self.known_size[slot], self.known_at[slot], self.known_ok[slot], self.store
        if odd.any():
            out, own, ok = self.encode_units(raw, start[odd], end[odd], check)
            at[odd], per[odd], agreed[odd] = len(store) + np.cumsum(own) - own, own, ok
            store = np.concatenate([store, out])
        ids = store[np.repeat(at - (np.cumsum(per) - per), per) + np.arange(per.sum())]
        owner = np.searchsorted(edge, start, "right") - 1
        count = np.bincount(owner, per, minlength=len(size)).astype(np.int64)
        bad = np.bincount(owner, ~agreed, minlength=len(size)) > 0
        return ids, count, ~bad

    def decode_flat(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of runs of ids; the dummy prefix is taken off."""
        n = self.text_size[ids]
        data = self.text[np.repeat(self.text_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = np.concatenate([[0], np.cumsum(n)])
        edge = total[np.concatenate([[0], np.cumsum(count)])]
        head = edge[:-1][np.diff(edge) > 0]
        head = head[data[head] == 32]
        keep = np.ones(len(data), bool)
        keep[head] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return data[keep], edge - gone[edge]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, count, _ = self.encode_chunk(*K.text_buffers(pa.array(texts, pa.string())), check=False)
        return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if len(texts) else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.array([self.unknown if y is None or not 0 <= y < self.size else y for x in ids for y in x], np.int64)
        data, off = self.decode_flat(flat, count)
        return [data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(ids))]


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("roundtrip", pa.bool_()), ("agrees", pa.bool_())])
_OUT_SQL = "doc_id bigint, ids array<int>, n_tokens int, roundtrip boolean, agrees boolean"


def encode(docs: DataFrame, model: str = MODEL, check: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, roundtrip, agrees) of every row.

    `roundtrip`: decoding gives the text back, byte for byte; `agrees`: the
    sentencepiece library gives the same ids for every unit of the text (true
    without looking if `check` is off). Texts are encoded whole, at any length. A
    null text has null ids, no tokens, and both flags true; an empty text has no
    ids. The character U+2581 in a text counts as a space, as in the library, so
    `roundtrip` is false there. Repeated rows are encoded alike; doc_id may be null; other columns are
    ignored; an empty table gives no rows. `model` must be readable where the
    executors run.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        v = Vocabulary.of(model)
        for b in batches:
            column = b.column(1)
            void = column.is_null().to_numpy(zero_copy_only=False)
            for row, end, data, offsets in K.chunks(column):
                ids, count, ok = v.encode_chunk(data, offsets, check)
                back, off = v.decode_flat(ids, count)
                if len(back) == len(data) and (off == offsets).all():
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    same = wrong[off[1:]] == wrong[off[:-1]]
                else:
                    same = np.array([back[off[i] : off[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(count))], bool)
                edge = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                null = void[row:end]
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32())) if null.any() else pa.ListArray.from_arrays(pa.array(edge), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), lists, pa.array(count.astype(np.int32)), pa.array(same), pa.array(ok)], schema=_OUT)
        K.trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _OUT_SQL)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encoded rows (doc_id, ids).

    Null ids give a null text, no ids an empty one; an id that is null or not in the
    vocabulary counts as the unknown piece. Bytes that aren't UTF-8 are replaced.
    Repeated rows are decoded alike; doc_id may be null; other columns are ignored;
    an empty table gives no rows.
    """
    common.small_batches(tokens.sparkSession)

    def run(batches):
        v = Vocabulary.of(model)
        for b in batches:
            got = b.column(1).to_pylist()
            text = v.decode([x or [] for x in got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t for x, t in zip(got, text)], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
