"""Jaccard self-join on word n-gram sets, by token-combination prefixes.

Tokens are distinct word n-grams (48-bit hashes) in a global order, rare ones
first. With threshold t a set of n tokens may miss m = n - ceil(t n) of them, so
two similar sets share k tokens among the first m + k of either; k grows with the
set (`shared`), and a pair is a candidate once it has k common signatures. Tokens
that are frequent in the corpus make poor index keys; for them the prefix is
extended further and pairs of tokens are indexed instead of single ones:

* class 1 (rare) tokens are signatures by themselves;
* class 2 (frequent) tokens are spread over GROUPS groups by hash; the prefix is
  extended until it holds m + k + GROUPS tokens, and every pair of a group's
  prefix tokens is a signature. Similar sets share k + GROUPS of these tokens;
  the common tokens of class 2 make at least as many common pairs as they are,
  less GROUPS, so k signatures are common.

Sets of fewer than `LONG` tokens can't be extended that far; they, and all sets
up to LONG / t that might be similar to one of them, also index their class 2
tokens singly. So every similar pair has k common signatures, k of the smaller.
Identical sets are collapsed before the join. Candidates are verified on whole
gram sets, made anew from the texts of the documents that occur in candidate pairs
only; a text is sent to the cells of blocks in which it has candidates, and as
blocks follow the least gram, groups of near copies are sent about once.

Groups of near copies grow with the corpus, and their pairs as the square. So where
links are counted and not told (`similar_documents`, `drop_similar`), documents that
agree in a band of minima fall into families beforehand. All pairs within a family
are compared as products of matrices in the cells of its texts, of which only a row
for each document comes out, and the index tells pairs across families only. Every
pair is compared by one of the two, so no link depends on what families there are.

Token frequencies are counted over all documents in a fixed number of hash
buckets; collisions merely change the order, which may be any.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernel as K

U64 = np.uint64
GROUPS = 32
BANDS, BAND = 16, 4
SKETCH_BITS = 20
SKETCH_BLOCKS = 64
#: Texts of one part of a family, whose pairs are cells of a matrix.
PART_ROWS = 8192
LOW48 = U64((1 << 48) - 1)


def need(n, t: float):
    """ceil(t n) with care for rounding."""
    return np.ceil(np.asarray(n) * t - 1e-9).astype(np.int64)


def shared(n, t: float):
    """How many common signatures a set of n tokens must have with a similar one."""
    return np.maximum(1, need(n, t) // 8)


def long_from(t: float) -> int:
    """LONG: from this size on the prefix can be extended by GROUPS."""
    n = np.arange(1, ceil(2 * (GROUPS + 2) / t) + 16)
    return int(n[need(n, t) >= shared(n, t) + GROUPS][0])


def gram_sets(column, n: int):
    """(first row, end row, keys): per chunk the sorted distinct `row in chunk << 48 | gram`.

    A text of fewer than n words has the one gram of all its words; one without words has none.
    """
    for row, end, words in K.tokenised(column, "ALNUM"):
        at, h = words.windows(n)
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < n))
        d = words.doc[at].astype(U64)
        if len(short):
            run = words.prefix()
            d = np.concatenate([d, short.astype(U64)])
            h = np.concatenate([h, K.span(run, words.first[short], count[short])])
        key = d << U64(48) | h >> U64(16)
        key.sort()
        if len(key):
            fresh = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=fresh[1:])
            key = key[fresh]
        yield row, end, key


def _edges(key: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(key, np.arange(rows + 1, dtype=U64) << U64(48))


def _sketch_place(gram: np.ndarray) -> np.ndarray:
    return (gram >> U64(48 - SKETCH_BITS)).astype(np.int64)


_FIRST = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int32()), ("low", pa.int64()), ("bands", pa.list_(pa.int64())), ("block", pa.int32()), ("counts", pa.binary())])
_FIRST_SQL = "doc_id bigint, f1 bigint, f2 bigint, n int, low bigint, bands array<bigint>, block int, counts binary"


def _bands(key: np.ndarray, e: np.ndarray, some: np.ndarray) -> np.ndarray:
    """BANDS values for each of `some` rows, each of BAND minima: the least gram from each of as many places in the range of grams on, around its end."""
    places = BANDS * BAND
    start = np.arange(places, dtype=U64) * U64((1 << 48) // places)
    at = np.searchsorted(key, (some.astype(U64)[:, None] << U64(48) | start).ravel()).reshape(-1, places)
    at = np.where(at < e[some + 1][:, None], at, e[some][:, None])
    low = (key[at] & LOW48).reshape(-1, BANDS, BAND)
    out = np.broadcast_to(np.arange(BANDS, dtype=U64), low.shape[:2])
    for i in range(BAND):
        out = K.mix(out * U64(3) + low[:, :, i])
    return out


def _survey(n):
    """Set fingerprints, least grams and bands of a partition's documents, and at the end its share of the frequency sketch."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            ids = b.column(0).to_numpy()
            for row, end, key in gram_sets(b.column(1), n):
                gram = key & LOW48
                counts += np.bincount(_sketch_place(gram), minlength=1 << SKETCH_BITS).astype(np.uint32)
                e = _edges(key, end - row)
                some = np.flatnonzero(np.diff(e))
                if not len(some):
                    continue
                f = []
                for salt in (11, 13):
                    total = np.zeros(len(gram) + 1, U64)
                    np.cumsum(K.mix(gram + U64(salt << 50)), out=total[1:])
                    f.append((total[e[some + 1]] - total[e[some]]).view(np.int64))
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + some]), pa.array(f[0]), pa.array(f[1]), pa.array((e[some + 1] - e[some]).astype(np.int32)), pa.array(gram[e[some]].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * BANDS), pa.array(_bands(key, e, some).ravel().view(np.int64))), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=_FIRST)
        if counts.any():
            parts = [x.astype("<u4").tobytes() for x in np.split(counts, SKETCH_BLOCKS)]
            void = [pa.nulls(SKETCH_BLOCKS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*void, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], schema=_FIRST)
        K.trim()

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.uint64)
    for c in table["counts"]:
        total += np.frombuffer(c.as_buffer(), "<u4")
    return pa.table([table["block"].slice(0, 1), pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["block", "counts"])


_BANDED = np.dtype([("band", "<i8"), ("doc", "<i8")])


def _banded(parts):
    """(bucket, blob): the bands of documents."""

    def run(batches):
        for b in batches:
            band = b.column(1).flatten().to_numpy()
            if len(band):
                record = np.empty(len(band), _BANDED)
                record["band"], record["doc"] = band, np.repeat(b.column(0).to_numpy(), BANDS)
                used, raw = common.blobs((K.mix(band.view(U64)) % U64(parts)).astype(np.int64), parts, record)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(raw, pa.binary())], names=["bucket", "blob"])

    return run


def _leaders(table: pa.Table) -> pa.Table:
    """(a, b): the least document of each band, and each other one."""
    r = np.concatenate([np.frombuffer(x.as_buffer(), _BANDED) for x in table["blob"]])
    r = r[np.lexsort((r["doc"], r["band"]))]
    lead = np.flatnonzero(np.concatenate([[True], r["band"][1:] != r["band"][:-1]]))
    a, b = np.repeat(r["doc"][lead], np.diff(np.append(lead, len(r)))), r["doc"]
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    K.trim()
    return pa.table([a[fresh], b[fresh]], names=["a", "b"])


def _spread(sig, doc, size, often, block):
    """Signatures of tokens that occur `often`, for tasks of about 2 x `block` documents each.

    The documents of a signature that may have more fall into groups by hash, and each
    goes to the pairs of groups that hold its own, as signatures of their own; so any
    two documents still meet.
    """
    groups = 1 + often // block
    hot = groups > 1
    if not hot.any():
        return sig, doc, size
    k = groups[hot]
    at = np.repeat(np.flatnonzero(hot), k)
    other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
    own = (K.mix(doc[at].view(U64)) % groups[at].astype(U64)).astype(np.int64)
    low, high = np.minimum(own, other).astype(U64), np.maximum(own, other).astype(U64)
    own_sig = K.mix(sig[at] * U64(3) + K.mix(low << U64(32) | high)) & LOW48
    return np.concatenate([sig[~hot], own_sig]), np.concatenate([doc[~hot], doc[at]]), np.concatenate([size[~hot], size[at]])


def _signatures(n, t, parts, sent, block=100_000):
    """(bucket, blob): signatures of a partition's sets, packed as parallel arrays; rows are (doc_id, text), and their family where there are families."""
    long = long_from(t)
    out = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches):
        counts = np.frombuffer(sent.value, "<u4")
        frequent = 4 * counts.mean() + 64

        def packed():
            s, d, z = np.concatenate(sigs), np.concatenate(docs), np.concatenate(sizes).astype("<i4")
            h = K.mix(s + U64(17))
            bucket = ((h >> U64(40)) % U64(parts)).astype(np.int64)
            order = np.lexsort((z, d, bucket))
            bucket, h, d, z = bucket[order], h[order], d[order].astype("<i8"), z[order]
            ids, own = np.concatenate(known), np.concatenate(families)
            by = np.argsort(ids, kind="stable")
            lead = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (d[1:] != d[:-1]) | (z[1:] != z[:-1])]))
            times = np.diff(np.append(lead, len(d))).astype("<i4")
            edge, runs = np.searchsorted(bucket, np.arange(parts + 1)), np.searchsorted(bucket[lead], np.arange(parts + 1))
            low, high, d, z = h.astype("<u4"), (h >> U64(32)).astype(np.uint8), d[lead], z[lead]
            family = own[by[np.searchsorted(ids[by], d)]].astype("<i8")
            used = np.flatnonzero(np.diff(edge))
            blob = [
                np.array([runs[u + 1] - runs[u]], "<i8").tobytes() + b"".join(x[runs[u] : runs[u + 1]].tobytes() for x in (d, family, z, times)) + b"".join(x[edge[u] : edge[u + 1]].tobytes() for x in (low, high))
                for u in used
            ]
            for x in (sigs, docs, sizes, known, families):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blob, pa.binary())], schema=out)

        def put(*found):
            for to, x in zip((sigs, docs, sizes), _spread(*found, block)):
                to.append(x)

        sigs, docs, sizes, known, families = [], [], [], [], []
        for b in batches:
            ids, own = b.column(0).to_numpy(), b.column(b.num_columns - 1 if b.num_columns > 2 else 0).to_numpy()
            for row, end, key in gram_sets(b.column(1), n):
                if not len(key):
                    continue
                known.append(ids[row:end])
                families.append(own[row:end])
                gram, d = key & LOW48, (key >> U64(48)).astype(np.int64)
                f = counts[_sketch_place(gram)].astype(np.int64)
                order = np.lexsort((gram, np.minimum(f, (1 << 40)), d))  # the global order within each set
                gram, d, f = gram[order], d[order], f[order]
                e = _edges(key, end - row)
                size = np.diff(e)
                place = np.arange(len(gram)) - e[d]
                m = size - need(size, t) + shared(size, t) - 1  # so that m + 1 tokens hold k common ones
                two = f >= frequent
                rare_before = np.concatenate([[0], np.cumsum(~two)])
                c1 = rare_before[e[:-1] + np.minimum(m + 1, size)] - rare_before[e[:-1]]
                extended = (c1 < m + 1) & (size >= long)
                short = place < (m + 1)[d]
                # class 1 singly, from the extended prefix where there is one (rare tokens all come before frequent ones)
                one = short & ~two
                single = short & two & (size <= ceil(long / t))[d]
                for take in (np.flatnonzero(one), np.flatnonzero(single)):
                    put(gram[take], ids[row + d[take]], size[d[take]], f[take])
                pick = np.flatnonzero(two & extended[d] & (place < (m + 1 + GROUPS)[d]))
                if len(pick):
                    g = K.mix(gram[pick])
                    slot = d[pick] * GROUPS + (g & U64(GROUPS - 1)).astype(np.int64)
                    o = np.lexsort((g, slot))
                    slot, g, dd, ff = slot[o], g[o], d[pick][o], f[pick][o]
                    step = 1
                    while True:
                        same = np.flatnonzero(slot[step:] == slot[:-step])
                        if not len(same):
                            break
                        put(K.mix(g[same] * U64(3) + g[same + step]) & LOW48, ids[row + dd[same]], size[dd[same]], np.minimum(ff[same], ff[same + step]))
                        step += 1
                if sum(map(len, sigs)) > 500_000:
                    yield packed()
        if sigs:
            yield packed()
        K.trim()

    return run


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("least", pa.int32())])


def _pairs(t, hold=2_000_000):
    """Pairs of documents of different families in a bucket with sizes that allow similarity: how many signatures they share there, how many they must share in all.

    They are told whenever `hold` of them have been met, so a pair may be told in parts, to be added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, f, z, times, low, high = [], [], [], [], [], []
        for batch in batches:
            for x in batch.column("blob"):  # documents with how many signatures follow, then the signatures
                raw = np.frombuffer(x.as_buffer(), np.uint8)
                k = int(raw[:8].view("<i8")[0])
                n = (len(raw) - 8 - 24 * k) // 5
                d.append(raw[8 : 8 + 8 * k].view("<i8").copy())
                f.append(raw[8 + 8 * k : 8 + 16 * k].view("<i8").copy())
                z.append(raw[8 + 16 * k : 8 + 20 * k].view("<i4").copy())
                times.append(raw[8 + 20 * k : 8 + 24 * k].view("<i4").copy())
                low.append(np.frombuffer(raw[8 + 24 * k : 8 + 24 * k + 4 * n].tobytes(), "<u4"))
                high.append(raw[8 + 24 * k + 4 * n :].copy())
        z, low, high = np.concatenate(z), np.concatenate(low), np.concatenate(high)
        ids, of_run = np.unique(np.concatenate(d), return_inverse=True)
        family = np.empty(len(ids), np.int64)
        family[of_run] = np.concatenate(f)
        # documents are numbered by families, so that those of a family are next to each other in the order of numbers
        by = np.argsort(family, kind="stable")
        of_run = np.argsort(by)[of_run]
        ids, family = ids[by], family[by]
        smallest = np.full(len(ids), np.iinfo(np.int32).max, np.int64)
        np.minimum.at(smallest, of_run, z)
        run_of = np.repeat(np.arange(len(z), dtype=np.int32), np.concatenate(times))
        del d, f, times, by
        found, held = [], 0

        def told():
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            for k in range(0, len(keys), 1 << 18):
                x, y = (keys[k : k + (1 << 18)] >> U64(32)).astype(np.int64), (keys[k : k + (1 << 18)] & U64(0xFFFFFFFF)).astype(np.int64)
                least = shared(np.minimum(smallest[x], smallest[y]), t)
                yield pa.RecordBatch.from_arrays([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), counts[k : k + (1 << 18)].astype(np.int32), least.astype(np.int32)], schema=_MET)

        # slices of the signatures' range one after another, so that a bucket needs little more memory than itself
        bits = min(max(0, int(len(low) >> 18).bit_length()), 16)
        slot = (low >> np.uint32(32 - bits)).astype(np.uint16) if bits else np.zeros(len(low), np.uint16)
        by_slot = np.argsort(slot, kind="stable").astype(np.uint32)
        edge = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << bits))])
        del slot
        for first, last in zip(edge[:-1], edge[1:]):
            mine = by_slot[first:last]
            sig = low[mine].astype(U64) | high[mine].astype(U64) << U64(32)
            order = np.argsort(sig)
            sig = sig[order]
            again = np.zeros(len(sig), bool)
            if len(sig) > 1:
                eq = sig[1:] == sig[:-1]
                again[1:] = eq
                again[:-1] |= eq
            sig, runs = sig[again], run_of[mine[order[again]]]
            at = of_run[runs]
            order = np.lexsort((at, sig))
            sig, at, size = sig[order], at[order].astype(U64), z[runs[order]]
            if not len(sig):
                continue
            # each with those after its family's, up to the end of its signature's
            fam = family[at.astype(np.int64)]
            turn = np.concatenate([[True], sig[1:] != sig[:-1]])
            stop = np.append(np.flatnonzero(turn)[1:], len(sig))[np.cumsum(turn) - 1]
            turn[1:] |= fam[1:] != fam[:-1]
            begin = np.append(np.flatnonzero(turn)[1:], len(sig))[np.cumsum(turn) - 1]
            before = np.concatenate([[0], np.cumsum(stop - begin)])
            i = 0
            while i < len(sig) and before[i] < before[-1]:
                j = max(i + 1, int(np.searchsorted(before, before[i] + (1 << 20), "right")) - 1)
                x = np.repeat(np.arange(i, j), np.diff(before[i : j + 1]))
                y = begin[x] + np.arange(before[i], before[j]) - before[x]
                ok = np.minimum(size[x], size[y]) >= need(np.maximum(size[x], size[y]), t)
                found.append(at[x[ok]] << U64(32) | at[y[ok]])
                held += len(found[-1])
                if held > hold:
                    yield from told()
                    found, held = [], 0
                i = j
        if held:
            yield from told()
        del low, high, run_of, by_slot, found
        K.trim()

    return run


def _sets(column, n) -> list[np.ndarray]:
    """The sorted grams of each text."""
    sets = []
    for row, end, key in gram_sets(column, n):
        e = _edges(key, end - row)
        gram = key & LOW48
        sets += [gram[e[i] : e[i + 1]] for i in range(end - row)]
    return sets


def _common(sets, ai, bi) -> np.ndarray:
    """How many grams two sets have in common, for pairs in the order of `ai`."""
    common_ = np.zeros(len(ai), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], ai[1:] != ai[:-1], [True]])) if len(ai) else []
    for s, e in zip(edge[:-1], edge[1:]):
        one = sets[ai[s]]
        for c in range(s, e, 256):  # partners in blocks, to bound memory
            other = [sets[j] for j in bi[c : min(e, c + 256)]]
            flat = np.concatenate(other)
            pos = np.minimum(np.searchsorted(one, flat), len(one) - 1)
            hit = np.concatenate([[0], np.cumsum(one[pos] == flat)])
            stop = np.cumsum([len(x) for x in other])
            common_[c : c + len(other)] = hit[stop] - hit[stop - [len(x) for x in other]]
    return common_


def _similar_rows(sets: list[np.ndarray], t, na: int, first: int) -> np.ndarray:
    """Which of the first `na` sets are similar to which from `first` on.

    Grams that an eighth of the sets has are columns of a dense matrix, of at most
    eight times as many cells as there are grams; what others add is counted pair by pair.
    """
    m, size = len(sets), np.array([len(x) for x in sets])
    row = np.repeat(np.arange(m), size)
    _, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = often > m // 8
    x = np.zeros((m, int(dense.sum())), np.float32)
    at = dense[gram]
    x[row[at], (np.cumsum(dense) - 1)[gram[at]]] = 1
    at = np.flatnonzero(~at & (often > 1)[gram])
    at = at[np.argsort(gram[at], kind="stable")]  # by gram, and by row within
    row, gram = row[at], gram[at]
    right = np.flatnonzero(row >= first)
    column, n_right = row[right] - first, np.bincount(gram[right], minlength=len(often))
    begin = np.cumsum(n_right) - n_right
    left = np.flatnonzero(row < na)
    left = left[np.argsort(row[left], kind="stable")]
    of_row = np.searchsorted(row[left], np.arange(na + 1))
    n_b = m - first
    ok = np.empty((na, n_b), bool)
    step = max(1, min(512, (1 << 21) // n_b))
    for s in range(0, na, step):
        e = min(na, s + step)
        c = x[s:e] @ x[first:].T
        i = left[of_row[s] : of_row[e]]
        many = np.concatenate([[0], np.cumsum(n_right[gram[i]])])
        k = 0
        while k < len(i):
            j = max(k + 1, int(np.searchsorted(many, many[k] + (1 << 21), "right")) - 1)
            each = np.repeat(np.arange(k, j), np.diff(many[k : j + 1]))
            other = begin[gram[i[each]]] + np.arange(many[k], many[j]) - many[each]
            c += np.bincount((row[i[each]] - s) * n_b + column[other], minlength=c.size).reshape(c.shape).astype(np.float32)
            k = j
        ok[s:e] = c >= (size[s:e, None] + size[first:] - c.astype(np.float64)) * t - 1e-9
    if not first:
        np.fill_diagonal(ok, False)
    return ok


def _reached(ok: np.ndarray, m: int, first: int) -> np.ndarray:
    """The least set that each of m sets is linked to, from set to set; rows of `ok` are sets from 0, columns those from `first` on."""
    to = np.arange(m, dtype=np.int32)
    while True:
        old = to.copy()
        for s in range(0, len(ok), 512):
            part = ok[s : s + 512]
            low = np.minimum(np.where(part, to[first:], np.int32(m)).min(axis=1), to[s : s + len(part)])
            to[s : s + len(part)] = low
            np.minimum(to[first:], np.where(part, low[:, None], np.int32(m)).min(axis=0), out=to[first:])
        to = to[to]
        if (to == old).all():
            return to


_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _families(n, t, few=4096):
    """(document, one that it is linked to from document to document, rows similar to it) in a cell: the pairs within families, or between two parts of one."""

    def run(table: pa.Table) -> pa.Table:
        sets = _sets(table["text"], n)
        ids, family, part, weight = (table[c].to_numpy() for c in ("doc_id", "family", "part", "weight"))
        order = np.lexsort((ids, part, family))
        edge = np.flatnonzero(np.concatenate([[True], family[order][1:] != family[order][:-1], [True]]))
        across = table["x"][0].as_py() < table["y"][0].as_py()
        links, to = np.zeros(len(ids), np.int64), np.arange(len(ids))
        ai, bi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edge[:-1], edge[1:]):
            rows = order[s:e]
            na = int((part[rows] == part[rows[0]]).sum()) if across else len(rows)
            first = na if across else 0
            if first == len(rows):
                continue
            if na * (len(rows) - first) <= few:
                i, j = np.divmod(np.arange(na * (len(rows) - first)), len(rows) - first)
                j += first
                ai.append(rows[i[i < j]])
                bi.append(rows[j[i < j]])
                continue
            ok = _similar_rows([sets[i] for i in rows], t, na, first)
            w = weight[rows].astype(np.float64)
            for i in range(0, na, 512):
                block = ok[i : i + 512].astype(np.float64)
                links[rows[i : i + len(block)]] += (block @ w[first:]).astype(np.int64)
                if across:
                    links[rows[first:]] += (w[i : i + len(block)] @ block).astype(np.int64)
            to[rows] = rows[_reached(ok, len(rows), first)]
        a, b = np.concatenate(ai), np.concatenate(bi)
        size = np.array([len(x) for x in sets])
        both = _common(sets, a, b)
        ok = both >= (size[a] + size[b] - both) * t - 1e-9
        a, b = a[ok], b[ok]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        while len(a):
            old = to.copy()
            low = np.minimum(to[a], to[b])
            np.minimum.at(to, a, low)
            np.minimum.at(to, b, low)
            to = to[to]
            if (to == old).all():
                break
        some = np.flatnonzero(links)
        del sets
        K.trim()
        return pa.table([ids[some], ids[to[some]], links[some]], schema=_LINKED)

    return run


def _verify(n, t):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32()), ("total", pa.int32())])

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        if not texts.num_rows or not pairs.num_rows:
            return out.empty_table()
        sets, ids = _sets(texts["text"], n), texts["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        ranks = ids[order]
        al, ak = np.searchsorted(ranks, a), np.searchsorted(ranks, a, "right") - np.searchsorted(ranks, a)
        bl, bk = np.searchsorted(ranks, b), np.searchsorted(ranks, b, "right") - np.searchsorted(ranks, b)
        # a doc_id that repeats with several texts is compared with each of them
        pair = np.repeat(np.arange(len(a)), ak * bk)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(ak * bk) - ak * bk, ak * bk)
        ai, bi = order[al[pair] + nth // bk[pair]], order[bl[pair] + nth % bk[pair]]
        a, b = a[pair], b[pair]
        by = np.lexsort((bi, ai))
        a, b, ai, bi = a[by], b[by], ai[by], bi[by]
        common_ = _common(sets, ai, bi)
        size = np.array([len(x) for x in sets])
        del sets
        K.trim()
        total = size[ai] + size[bi] - common_
        ok = np.flatnonzero(common_ >= total * t - 1e-9)
        # of several texts the most similar two are told
        ok = ok[np.lexsort((-common_[ok] / total[ok], b[ok], a[ok]))]
        ok = ok[np.concatenate([[True], (a[ok][1:] != a[ok][:-1]) | (b[ok][1:] != b[ok][:-1])])] if len(ok) else ok
        return pa.table([a[ok], b[ok], common_[ok].astype(np.int32), total[ok].astype(np.int32)], schema=out)

    return run


def _in_families(rows: DataFrame, sets: DataFrame, family: DataFrame, classes: DataFrame, n: int, threshold: float, broadcast_bytes: int, block_bytes: int) -> DataFrame:
    """(a, b, n) as `_families` has it. Small families share cells; one beyond half of `block_bytes` of grams, or `PART_ROWS` texts, falls into parts, any two of which meet in a cell of their own."""
    small = lambda df, width: df.count() * width <= broadcast_bytes
    sized = family.join(sets.select("doc_id", "n"), "doc_id").join(classes.select(F.col("a").alias("doc_id"), F.col("copies").alias("weight")), "doc_id", "left")
    sized = common.materialise(sized.select("doc_id", "family", F.coalesce("weight", F.lit(1)).alias("weight"), (F.col("n").cast("bigint") * 8).alias("load")), "gram-families")
    side = max(6, ceil((sized.agg(F.sum("load")).first()[0] or 0) / block_bytes))
    heavy = sized.groupBy("family").agg(F.ceil(F.greatest(F.sum("load") * 2 / block_bytes, F.count(F.lit(1)) / PART_ROWS)).cast("int").alias("split")).where("split > 1")
    place = sized.join(F.broadcast(heavy) if small(heavy, 24) else heavy, "family", "left").withColumn("split", F.coalesce("split", F.lit(1)))
    place = place.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("split")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    cell = F.when(F.col("split") > 1, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(side)))
    place = place.select("doc_id", "family", "part", "weight", "split", cell.alias("cell"), F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    place = common.materialise(place, "gram-family-cells")
    texts = rows.join(F.broadcast(place) if small(place, 80) else place, "doc_id")
    return common.materialise(texts.groupBy(F.col("split") > 1, "cell", "x", "y").applyInArrow(_families(n, threshold), "a bigint, b bigint, n bigint"), "gram-linked")


def _similar(docs: DataFrame, n: int, threshold: float, broadcast_bytes: int, block_bytes: int, by_family: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(a, b, common, total) of pairs of representatives, and (a, b, n) of classes' other members, over rows whose doc_id is unique.

    With `by_family` the pairs are only those across families, and what is within them is told as `_families` has it.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    first = common.materialise(rows.mapInArrow(_survey(n), _FIRST_SQL), "gram-survey")
    blocks = first.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_add_counts, "block int, counts binary").collect()
    if not blocks:
        return spark.createDataFrame([], "a bigint, b bigint, common int, total int"), spark.createDataFrame([], "a bigint, b bigint, n int"), spark.createDataFrame([], "a bigint, b bigint, n bigint") if by_family else None
    sent = spark.sparkContext.broadcast(b"".join(bytes(x["counts"]) for x in sorted(blocks, key=lambda x: x["block"])))  # 4 MB at any size of the corpus

    small = lambda df, width: df.count() * width <= broadcast_bytes
    sets = first.where("block IS NULL").select("doc_id", "f1", "f2", "n", "low")
    classes = common.materialise(sets.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "gram-classes")
    members = common.join_classes(sets, classes, ["f1", "f2", "n"], "copies", "inner", broadcast_bytes)
    copies = common.materialise(members.where("doc_id <> a").select("a", F.col("doc_id").alias("b"), "n").distinct(), "gram-copies")
    gone = copies.select(F.col("b").alias("doc_id"))
    linked = None
    if by_family:
        parts = max(8, ceil(sets.count() * BANDS * _BANDED.itemsize / (16 << 20)))
        banded = first.where("block IS NULL").select("doc_id", "bands").mapInArrow(_banded(parts), "bucket int, blob binary")
        edges = banded.groupBy("bucket").applyInArrow(_leaders, "a bigint, b bigint")
        # copies agree with their representative, which is less, in all bands
        edges = edges.join(gone.withColumnRenamed("doc_id", "b"), "b", "left_anti")
        family = common.materialise(groups(edges).withColumnRenamed("keeper_id", "family"), "gram-family")
        linked = _in_families(rows, sets, family, classes, n, threshold, broadcast_bytes, block_bytes)
        # one join for both: copies go, and the others get their family
        known = common.materialise(family.select("doc_id", "family", F.lit(False).alias("gone")).unionByName(gone.select("doc_id", F.col("doc_id").alias("family"), F.lit(True).alias("gone"))), "gram-known")
        reps = rows.join(F.broadcast(known) if small(known, 40) else known, "doc_id", "left").where("NOT coalesce(gone, false)").select("doc_id", "text", F.coalesce("family", "doc_id").alias("family"))
    else:
        reps = rows.join(F.broadcast(gone) if small(gone, 40) else gone, "doc_id", "left_anti")

    # few buckets: a similar pair is told once by each bucket in which it has a common signature
    size = common.input_bytes(rows)
    parts = max(8, ceil(size / (12 << 20)))
    blobs = reps.mapInArrow(_signatures(n, threshold, parts, sent), "bucket int, blob binary")
    met = blobs.groupBy("bucket").applyInArrow(_pairs(threshold), "a bigint, b bigint, n int, least int")
    cand = common.materialise(met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("a", "b"), "gram-candidates")

    # similar texts mostly share their least gram, by which texts fall into blocks; a cell holds the texts of two blocks that have candidates in common
    side = max(6, ceil(size / block_bytes))
    place = sets.select("doc_id", F.pmod(F.xxhash64("low"), F.lit(side)).alias("block"), "n")
    heavy = place.groupBy("block").agg((F.sum(F.col("n").cast("bigint") * 8) / (4 * block_bytes)).alias("load")).where("load > 1").select("block", F.ceil("load").alias("split"))
    # blocks that are much too large, such as a group of near copies, are split by document; there are fewer than `side` of them
    place = place.join(F.broadcast(heavy) if side * 24 <= broadcast_bytes else heavy, "block", "left")
    place = common.materialise(place.select("doc_id", F.struct("block", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("split")), F.lit(0)).alias("part")).alias("at")), "gram-blocks")
    side_of = lambda c: (F.broadcast(place) if small(place, 40) else place).select(F.col("doc_id").alias(c), F.col("at").alias(f"at_{c}"))
    cand = common.materialise(cand.join(side_of("a"), "a").join(side_of("b"), "b").select("a", "b", F.struct(F.least("at_a", "at_b").alias("x"), F.greatest("at_a", "at_b").alias("y")).alias("cell")), "gram-cells")
    wanted = common.materialise(cand.select(F.explode(F.array("a", "b")).alias("doc_id"), "cell").distinct(), "gram-wanted")
    texts = rows.join(F.broadcast(wanted) if small(wanted, 60) else wanted, "doc_id")
    pairs = texts.groupBy("cell").cogroup(cand.groupBy("cell")).applyInArrow(_verify(n, threshold), "a bigint, b bigint, common int, total int")
    return pairs, copies, linked


def similar_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, broadcast_bytes: int = common.BROADCAST_BYTES, block_bytes: int = 16 << 20) -> DataFrame:
    """(a, b, common, total): all pairs with |A and B| / |A or B| >= threshold over word n-gram sets, with identical sets collapsed.

    Each class of identical sets is represented by its least doc_id. A row with
    a = representative, b = another member has common = total; the other rows
    are pairs of representatives, a < b. Two documents are a pair of the full
    join exactly if their representatives are equal or form a row.

    Words are runs of ASCII letters, digits and non-ASCII bytes, ASCII lowered. A
    text of 1 to n - 1 words has the one gram of all its words. Null and empty
    texts have no grams and are in no pair, and rows without doc_id are left out.
    A doc_id names one text here: rows that repeat it with the same text count
    once. For tables that repeat ids with several texts see `similar_documents`.
    Texts are processed whole at any length; other columns are ignored; an empty
    table gives no rows.

    Lists of document ids are broadcast only within `broadcast_bytes`; beyond it
    the texts are joined by shuffles. Texts are verified in cells of two blocks of
    about `block_bytes` each.
    """
    pairs, copies, _ = _similar(docs, n, threshold, broadcast_bytes, block_bytes)
    return pairs.unionByName(copies.select("a", "b", F.col("n").alias("common"), F.col("n").alias("total")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """The documents, and the name of a further column that numbers their rows in the order of doc_id; None where doc_id is unique and does that itself."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    if not ids.where("count > 1").limit(1).count():
        return docs, None
    key = common.unused(docs, "row_key")
    # the last sort keys split the rows of a hot doc_id; numbers are kept in a table, so that they are the same at every use
    return common.materialise(docs.orderBy("doc_id", F.xxhash64("text"), F.rand(1)).withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def similar_documents(docs: DataFrame, n: int = 3, threshold: float = 0.5, broadcast_bytes: int = common.BROADCAST_BYTES, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, group_id, links) of every document that another row is similar to, as `similar_pairs` has it.

    links counts the rows similar to it, copies included; group_id is the least
    doc_id of all that links lead to, from document to document. Every row is a
    document of its own, also where rows repeat a doc_id. Null and empty texts and
    rows without doc_id are similar to nothing; an empty table gives no rows.
    """
    docs, key = _keyed(docs)
    rows = docs if key is None else docs.select(F.when(F.col("doc_id").isNotNull(), F.col(key)).alias("doc_id"), "text")
    pairs, copies, linked = _similar(rows, n, threshold, broadcast_bytes, block_bytes, True)
    pairs = common.materialise(pairs.select("a", "b"), "similar")
    sizes = common.materialise(copies.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("size")), "class-sizes")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = sizes.select(F.col("a").alias("b"), "size")
    met = common.join_classes(both, other, ["b"], "size", "left", broadcast_bytes, 24).select("a", F.coalesce("size", F.lit(1)).alias("n"))
    links = met.unionByName(linked.select("a", "n")).unionByName(sizes.select("a", (F.col("size") - 1).alias("n"))).groupBy("a").agg(F.sum("n").alias("links"))
    keeper = groups(pairs.unionByName(linked.select("a", "b"))).select(F.col("doc_id").alias("a"), F.col("keeper_id").alias("group_id"))
    reps = links.join(keeper, "a", "left").join(sizes, "a", "left").select("a", F.coalesce("group_id", "a").alias("group_id"), "links", F.coalesce("size", F.lit(1)).alias("size"))
    reps = common.materialise(reps, "similar-representatives")
    members = common.join_classes(copies.select("a", "b"), reps.where("size > 1"), ["a"], "size", "inner", broadcast_bytes)
    out = reps.select(F.col("a").alias("doc_id"), "group_id", "links").unionByName(members.select(F.col("b").alias("doc_id"), "group_id", "links"))
    if key is None:
        return out
    # numbers follow the ids, so the least number of a group stands for its least id
    name = docs.select(F.col(key), F.col("doc_id").cast("bigint").alias("id"))
    out = out.join(name.select(F.col(key).alias("doc_id"), F.col("id").alias("own")), "doc_id").select("own", "group_id", "links")
    return out.join(name.select(F.col(key).alias("group_id"), F.col("id").alias("group")), "group_id").select(F.col("own").alias("doc_id"), F.col("group").alias("group_id"), "links")


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, keeper_id): connected components of pairs (a, b), named by their least doc_id.

    Least labels travel along edges and along the labels' own labels, so the number
    of rounds grows with the logarithm of a component's diameter; every round's
    table is written to the shared folder, so no lineage builds up.
    """
    edges = common.materialise(pairs.select("a", "b").where("a <> b").unionByName(pairs.selectExpr("b AS a", "a AS b").where("a <> b")).distinct(), "edges")
    labels = common.materialise(edges.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS doc_id", "least(a, m) AS keeper_id"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["doc_id"]).groupBy("a").agg(F.min("keeper_id").alias("near"))
        step = labels.join(near, labels["doc_id"] == near["a"]).select("doc_id", F.col("keeper_id").alias("old"), F.least("keeper_id", "near").alias("new"))
        jump = labels.selectExpr("doc_id AS via", "keeper_id AS far")
        new = step.join(jump, step["new"] == jump["via"], "left").select("doc_id", F.least("new", F.coalesce("far", "new")).alias("keeper_id"), (F.least("new", F.coalesce("far", "new")) < F.col("old")).alias("moved"))
        new = common.materialise(new, "labels")
        common.release(labels)
        labels = new.select("doc_id", "keeper_id")
        labels._parley_path = new._parley_path
        if not new.where("moved").limit(1).count():
            common.release(edges)
            return labels


def drop_similar(docs: DataFrame, n: int = 3, threshold: float = 0.5, broadcast_bytes: int = common.BROADCAST_BYTES, block_bytes: int = 16 << 20) -> DataFrame:
    """One document of each group of similar ones: the one with the least doc_id. Documents similar to none stay.

    Every row is settled by its own text, also where rows repeat a doc_id; of rows
    with the least doc_id of a group one stays. Rows with a null or empty text or a
    null doc_id all stay. All columns are kept, whatever their names; an empty table
    stays empty.
    """
    rows, key = _keyed(docs)
    own = "doc_id" if key is None else key
    pairs, copies, linked = _similar(rows.select(F.when(F.col("doc_id").isNotNull(), F.col(own)).alias("doc_id"), "text"), n, threshold, broadcast_bytes, block_bytes, True)
    gone = groups(pairs.select("a", "b").unionByName(linked.select("a", "b"))).where("doc_id <> keeper_id").select(F.col("doc_id").alias(own)).unionByName(copies.select(F.col("b").alias(own)))
    gone = common.materialise(gone, "similar-gone")
    small = gone.count() * 40 <= broadcast_bytes
    return rows.join(F.broadcast(gone) if small else gone, own, "left_anti").select(docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS gram
  FROM w),
s AS (SELECT r, count(*) AS n FROM g GROUP BY r),
e AS (
  SELECT x.r AS a, y.r AS b FROM g x JOIN g y ON x.gram = y.gram AND x.r <> y.r JOIN s sx ON sx.r = x.r JOIN s sy ON sy.r = y.r
  GROUP BY x.r, y.r HAVING 3 * count(*) >= any_value(sx.n + sy.n)),
reach AS (SELECT DISTINCT a AS r, a AS far FROM e UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.far),
k AS (SELECT reach.r, min(w.doc_id) AS group_id FROM reach JOIN w ON w.r = reach.far GROUP BY reach.r)
SELECT w.doc_id, k.group_id, (SELECT count(*) FROM e WHERE e.a = k.r) AS links FROM k JOIN w USING (r)
"""
