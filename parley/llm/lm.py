"""Language-model scores by a causal self-attention model trained here, in numpy.

Tokens are the subword ids of `pieces`, whose new units the library encodes here. The model embeds id and place, attends
causally within a window of CONTEXT tokens, and predicts the next token in two
steps from the same hidden state: its class, by a softmax over classes, and the
token, by a softmax over the class's tokens. The most frequent tokens of the corpus
are classes of their own, the others fall into slices in the order of their counts.
Windows overlap by OVERLAP tokens, so that every token of a document is scored
exactly once, with at least OVERLAP tokens (or all there are) before it; windows
are scored in batches with masked attention.

Everything learnt comes from the whole corpus: token counts from all documents,
and every token is predicted once in training. Training is data-parallel and goes
in ROUNDS, each over its own share of all windows: groups of about GROUP windows
are trained on from common parameters, TOGETHER of them in one task, and the
changes are averaged, those of embeddings by how often each group saw a token;
only averages reach the driver, whose size is the model's. Windows are cut where
they are trained on; what is shuffled are pieces of documents of PIECE windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernel as K
from . import pieces

U64 = np.uint64
DIM, SINGLE, CLASSES, CONTEXT, OVERLAP = 16, 48, 64, 32, 8
STRIDE = CONTEXT - OVERLAP
GROUP = 16_384
TOGETHER = 8
PIECE = 64
ROUNDS = 3
BLOCKS = 32
BOS = 1
TOP = np.float32(40)  # logits beyond it count as it, so that no exponential overflows
_SEEN = np.triu(np.ones((CONTEXT, CONTEXT), np.float32))  # which places (rows) each place (column) sees
#: A product of so many multiplications at most goes the library's way of small ones, which is several times as fast for thin matrices.
SMALL = 1_000_000
#: Parameters besides those of tokens; the last row of `head` are biases.
SHAPES = (("place", (CONTEXT, DIM)), ("query", (DIM, DIM)), ("key", (DIM, DIM)), ("value", (DIM, DIM)), ("mixed", (DIM, DIM)), ("head", (DIM + 1, CLASSES)))
_SCALE = np.float32(DIM**-0.5)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Where each of CLASSES classes begins among the ids in descending order of their counts, and the number of ids.

    The SINGLE most frequent ids are classes of their own, for which the first softmax
    is all; the others are slices of equal sums of the counts' square roots, which
    makes the mean size of the class of a token least.
    """
    c = np.sqrt(np.sort(counts.astype(np.float64) + 1)[::-1])[SINGLE:]
    if not len(c):
        return np.minimum(np.arange(CLASSES + 1), len(counts))
    mass, rest = np.cumsum(c), CLASSES - SINGLE
    return np.concatenate([np.arange(SINGLE), SINGLE + np.searchsorted((mass - c / 2) / mass[-1] * rest, np.arange(rest + 1))])


def _bound(z: np.ndarray) -> None:
    """Cuts logits at TOP; mostly there are none to cut, and a maximum is sooner taken than minima."""
    if z.size and z.max() > TOP:
        np.minimum(z, TOP, out=z)


def _exp(z: np.ndarray) -> None:
    _bound(z)
    np.exp(z, out=z)


def _wide(rows: int, n: int) -> np.ndarray:
    """A matrix with a column for each token, whose rows don't lie a power of two apart, as they would contend for the same lines of a cache."""
    return np.empty((rows, -(-n // 32) * 32 + 16), np.float32)[:, :n]


def _in_parts(m: np.ndarray, n: int) -> np.ndarray:
    """Parts of n columns each, as a view."""
    return m.reshape(len(m), -1, n).transpose(1, 0, 2)


def _split(by: int, columns: int) -> tuple[int, int]:
    """How many columns, with `by` multiplications each, a small product has, and how many of all are in such parts."""
    n = 1 << max(1, SMALL // max(by, 1)).bit_length() - 1
    return n, columns - columns % n


def _times(w: np.ndarray, m: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """w @ m for many columns."""
    w, out = np.ascontiguousarray(w), _wide(len(w), m.shape[1]) if out is None else out
    n, whole = _split(w.size, m.shape[1])
    if whole:
        np.matmul(w, _in_parts(m[:, :whole], n), out=_in_parts(out[:, :whole], n))
    if whole < m.shape[1]:
        np.matmul(w, m[:, whole:], out=out[:, whole:])
    return out


def _across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for many columns of both."""
    n, whole = _split(len(a) * len(b), a.shape[1])
    out = a[:, whole:] @ b[:, whole:].T
    if whole:
        out += (_in_parts(a[:, :whole], n) @ _in_parts(b[:, :whole], n).transpose(0, 2, 1)).sum(axis=0)
    return out


def _taken(m: np.ndarray, columns: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The columns of a matrix that are told, row by row, as numpy's take along rows is slow."""
    out = np.empty((len(m), len(columns)), m.dtype) if out is None else out
    for a, b in zip(m, out):
        np.take(a, columns, out=b, mode="wrap")
    return out


def _steps(size: int, n: int) -> list[slice]:
    """Slices of n columns for products with a class of so many tokens."""
    k = max(64, SMALL // (size * (DIM + 1)))
    return [slice(b, min(b + k, n)) for b in range(0, n, k)]


def _room(edge: np.ndarray) -> np.ndarray:
    """Room for the logits of one of `_steps`, used again and again, so that it stays in a cache."""
    return np.empty(max(64 * int(np.diff(edge).max()), SMALL // DIM), np.float32)


def _logits(weights: np.ndarray, h: np.ndarray, room: np.ndarray) -> np.ndarray:
    z = room[: len(weights) * h.shape[1]].reshape(len(weights), -1)
    return np.matmul(weights, h, out=z)


def _own(z: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where in a flat matrix each column has its row."""
    return row * z.shape[1] + np.arange(z.shape[1])


class Model:
    """Parameters: `embed` (vocabulary x DIM), `out` (tokens as predicted, those of a class next to each other; DIM weights and a bias) and the rest of SHAPES.

    `order` tells an id's place among the rows of `out`, `edge` where classes begin there, `cls` the class of each id.
    """

    def __init__(self, vocabulary: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (vocabulary, DIM)).astype(np.float32)
        self.rest = {k: rng.normal(0, 0.3 if k != "place" else 0.1, s).astype(np.float32) for k, s in SHAPES}
        self.out = np.zeros((vocabulary, DIM + 1), np.float32)
        self.count(np.zeros(vocabulary))

    def count(self, counts: np.ndarray) -> None:
        """Classes and biases from the corpus' counts, with one added to each."""
        c = counts.astype(np.float64) + 1
        by = np.argsort(-c, kind="stable")
        self.order = np.empty(len(c), np.int32)
        self.order[by] = np.arange(len(c))
        self.edge = classes_of(counts)
        row_cls = np.repeat(np.arange(CLASSES), np.diff(self.edge))
        self.cls = row_cls[self.order].astype(np.int16)
        total = np.bincount(row_cls, c[by], minlength=CLASSES)
        self.out[:, DIM] = np.log(c[by] / total[row_cls])
        self.rest["head"][DIM] = np.log(np.maximum(total, 1e-12) / total.sum())

    def dump(self) -> tuple[bytes, ...]:
        return (self.embed.tobytes(), self.out.tobytes(), *(self.rest[k].tobytes() for k, _ in SHAPES), self.order.tobytes(), self.edge.astype(np.int64).tobytes(), self.cls.tobytes())

    @staticmethod
    def load(raw: tuple[bytes, ...]) -> Model:
        m = Model.__new__(Model)
        m.embed, m.out = (np.frombuffer(x, np.float32).reshape(-1, n).copy() for x, n in zip(raw, (DIM, DIM + 1)))
        m.rest = {k: np.frombuffer(r, np.float32).reshape(s).copy() for (k, s), r in zip(SHAPES, raw[2:-3])}
        m.order, m.edge, m.cls = np.frombuffer(raw[-3], np.int32), np.frombuffer(raw[-2], np.int64), np.frombuffer(raw[-1], np.int16)
        return m

    def attend(self, ids: np.ndarray, first: int = 0):
        """Hidden states of the places from `first` on of windows (batch, CONTEXT) of ids, and what the gradient needs.

        Everything has a column for each token, so that what is done to a token's
        components is done to long rows. The last row of the hidden states is one,
        which biases are multiplied with, and that of `qkv`, queries, keys and values,
        whose sums are so told with the products; `a` (batch, seen, place) are
        exponentials whose sums' inverses are `inv`.
        """
        p, n = self.rest, CONTEXT - first
        rows = self.embed.take(ids, axis=0)
        rows += p["place"]
        x, qkv = _wide(DIM, ids.size), _wide(3 * DIM + 1, ids.size)
        x[:] = rows.reshape(-1, DIM).T
        _times(self._qkv().T, x, qkv[: 3 * DIM])
        qkv[3 * DIM] = 1
        q, k, v = (_in_parts(m, CONTEXT) for m in (qkv[:DIM], qkv[DIM : 2 * DIM], qkv[2 * DIM :]))
        a = k.transpose(0, 2, 1) @ q[:, :, first:]
        _exp(a)
        a *= np.ascontiguousarray(_SEEN[:, first:])
        c = _wide(DIM + 1, len(ids) * n)
        np.matmul(v, a, out=_in_parts(c, n))
        inv = 1 / c[DIM]
        c = c[:DIM]
        c *= inv
        h = _wide(DIM + 1, len(ids) * n)
        _times(p["mixed"].T, c, h[:DIM])
        h[:DIM].reshape(DIM, -1, n)[:] += x.reshape(DIM, -1, CONTEXT)[:, :, first:]
        h[DIM] = 1
        return h, (x, qkv, a, inv, c)

    def _qkv(self) -> np.ndarray:
        """Weights of queries, already scaled, keys and values."""
        return np.concatenate([self.rest["query"] * _SCALE, self.rest["key"], self.rest["value"]], axis=1)

    def losses(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """-log p of a target under each hidden state; 0 for padding."""
        order, edge, several = self._by_class(target)
        h, local = _taken(h, order), self.order.take(target.take(order))
        cls, loss = np.repeat(np.arange(CLASSES), np.diff(edge)), np.zeros(len(order), np.float32)
        room = _room(self.edge)

        def add(weights, own, at, to):
            one = np.ones(len(weights), np.float32)
            for r in _steps(len(weights), to - at):
                z = _logits(weights, h[:, at:to][:, r], room)
                _bound(z)
                mine = z.ravel().take(_own(z, own[r]))
                np.exp(z, out=z)
                loss[at:to][r] += np.log(one @ z) - mine

        add(np.ascontiguousarray(self.rest["head"].T), cls, 0, len(order))
        for c, at, to in several:
            add(self.out[self.edge[c] : self.edge[c + 1]], local[at:to] - self.edge[c], at, to)
        out = np.zeros(len(target), np.float32)
        out[order] = loss
        return out

    def _by_class(self, target: np.ndarray):
        """Targets in the order of their classes, without padding; where in it each class begins; and the classes of several tokens, with from where to where they are."""
        cls = np.append(self.cls, np.int16(CLASSES)).take(target, mode="wrap")
        edge = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES)[:CLASSES])])
        several = np.flatnonzero((np.diff(edge) > 0) & (np.diff(self.edge) > 1))
        return np.argsort(cls, kind="stable")[: edge[-1]], edge, list(zip(several.tolist(), edge[several].tolist(), edge[several + 1].tolist()))

    def nll(self, ids: np.ndarray, first: int) -> np.ndarray:
        """-log p of the tokens at places first + 1 .. CONTEXT of windows of CONTEXT + 1 ids, given all before them in the window."""
        h, _ = self.attend(ids[:, :-1], first)
        target = ids[:, first + 1 :]
        return self.losses(h, target.ravel()).reshape(target.shape)

    def train(self, windows: np.ndarray, rate: float, batch: int) -> None:
        """One pass of Adagrad over windows of CONTEXT + 1 ids; ids of -1 are padding, which has no loss."""
        p, rate = self.rest, np.float32(rate)
        seen = {k: np.full(v.shape, 1e-4, np.float32) for k, v in (("embed", self.embed), ("out", self.out), *p.items())}
        room = _room(self.edge)
        narrow = np.uint16 if len(self.embed) <= 65536 else np.int32

        def step(x, s, d):
            t = d * d
            s += t
            np.sqrt(s, out=t)
            np.divide(d, t, out=t)
            t *= rate
            x -= t

        def softmax(weights, h, own, share, dh):
            """The gradient of the mean of -log p(own) by the weights; that by the hidden states is added to dh."""
            one, back, g = np.ones(len(weights), np.float32), np.ascontiguousarray(weights[:, :DIM].T), None
            for r in _steps(len(weights), h.shape[1]):
                part = h[:, r]
                z = _logits(weights, part, room)
                _exp(z)
                total = one @ z
                z.ravel()[_own(z, own[r])] -= total
                total = share / total
                u = back @ z
                u *= total
                dh[:, r] += u
                d = z @ (part * total).T
                g = d if g is None else g + d
            return g

        for b in range(0, len(windows), batch):
            w = windows[b : b + batch]
            ids, target = np.maximum(w[:, :-1], 0), w[:, 1:].ravel()
            real, edge, several = self._by_class(target)
            if not len(real):
                continue
            h, kept = self.attend(ids)
            share = np.float32(1 / len(real))
            hs, local, dhs = _taken(h, real), self.order.take(target.take(real)), np.zeros((DIM, ids.size), np.float32)
            g = {"head": softmax(np.ascontiguousarray(p["head"].T), hs, np.repeat(np.arange(CLASSES), np.diff(edge)), share, dhs[:, : len(real)]).T}
            for k, at, to in several:
                e, f = self.edge[k], self.edge[k + 1]
                step(self.out[e:f], seen["out"][e:f], softmax(self.out[e:f], hs[:, at:to], local[at:to] - e, share, dhs[:, at:to]))
            back = np.full(ids.size, ids.size - 1)  # padding, if there is any, has the last column, which is 0
            back[real] = np.arange(len(real))
            dx = _wide(DIM, ids.size)
            _taken(dhs, back, dx)
            g |= self._attend_back(dx, *kept)
            for name, d in g.items():
                step(p[name], seen[name], d)
            order = np.argsort(ids.ravel().astype(narrow), kind="stable")
            s = ids.ravel()[order]
            lead = np.concatenate([[True], s[1:] != s[:-1]])
            rows, which = s[lead], np.empty(len(order), np.int64)
            which[order] = np.cumsum(lead) - 1
            d = np.stack([np.bincount(which, x) for x in dx], axis=1).astype(np.float32)
            held = seen["embed"].take(rows, axis=0) + d * d
            seen["embed"][rows] = held
            self.embed[rows] -= rate * d / np.sqrt(held)

    def _attend_back(self, dh: np.ndarray, x, qkv, a, inv, c) -> dict[str, np.ndarray]:
        """Gradients by the parameters of `attend`; dh, those by the hidden states, become those by the embedded tokens."""
        p, n = self.rest, dh.shape[1]
        g = {"mixed": _across(c, dh)}
        # the gradient by a: products with the values, less their mean, which the values' row of ones takes off
        ds = _wide(DIM + 1, n)
        np.multiply(_times(p["mixed"], dh), inv, out=ds[:DIM])
        np.negative(np.einsum("ij,ij->j", ds[:DIM], c), out=ds[DIM])
        q, k, v = (_in_parts(m, CONTEXT) for m in (qkv[:DIM], qkv[DIM : 2 * DIM], qkv[2 * DIM :]))
        da = v.transpose(0, 2, 1) @ _in_parts(ds, CONTEXT)
        da *= a
        dqkv = _wide(3 * DIM, n)
        np.matmul(k, da, out=_in_parts(dqkv[:DIM], CONTEXT))
        np.matmul(q, da.transpose(0, 2, 1), out=_in_parts(dqkv[DIM : 2 * DIM], CONTEXT))
        np.matmul(_in_parts(ds[:DIM], CONTEXT), a.transpose(0, 2, 1), out=_in_parts(dqkv[2 * DIM :], CONTEXT))
        g["query"], g["key"], g["value"] = np.split(_across(x, dqkv), 3, axis=1)
        g["query"] = g["query"] * _SCALE
        dh += _times(self._qkv(), dqkv)
        g["place"] = dh.reshape(DIM, -1, CONTEXT).sum(axis=1).T
        return g


def windows_of(ids: np.ndarray, count: np.ndarray, stride: int = STRIDE):
    """Windows over documents' ids: (rows of CONTEXT + 1 ids padded with -1, document, index in the document).

    Window k of a document begins `stride` k tokens after its BOS; it scores the tokens
    that no earlier window has scored.
    """
    size = np.where(count > 0, 1 + -(-np.maximum(count - CONTEXT, 0) // stride), 0)
    doc = np.repeat(np.arange(len(count)), size)
    index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    begin = np.cumsum(count) - count
    place = index[:, None] * stride + np.arange(CONTEXT + 1)  # 0 is BOS, i the i-th token
    at = begin[doc][:, None] + place - 1
    inside = place <= count[doc][:, None]
    w = np.where(inside, ids[np.clip(at, 0, max(len(ids) - 1, 0))] if len(ids) else -1, -1)
    w[place == 0] = BOS
    return w, doc, index


_KINDS = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("data", pa.binary()), ("kind", pa.string())])
_KINDS_SQL = "doc_id bigint, block int, data binary, kind string"


def _gather(model: str):
    """Encoded documents and, at the end, token counts of a partition."""

    def run(batches):
        v = pieces.Vocabulary.of(model, by_library=True)
        wide = "<u2" if v.size <= 65536 else "<u4"
        total = np.zeros(-(-v.size // BLOCKS) * BLOCKS, np.int64)
        for b in batches:
            doc_ids = b.column(0)
            for row, end, data, offsets in K.chunks(b.column(1)):
                ids, count, _ = v.encode_chunk(data, offsets, check=False)
                total += np.bincount(ids, minlength=len(total))
                raw, edge = ids.astype(wide).tobytes(), (np.concatenate([[0], np.cumsum(count)]) * np.dtype(wide).itemsize).tolist()
                k = end - row
                yield pa.RecordBatch.from_arrays([doc_ids.slice(row, k), pa.nulls(k, pa.int32()), pa.array([raw[edge[i] : edge[i + 1]] for i in range(k)], pa.binary()), pa.array(["doc"] * k)], schema=_KINDS)
        if total.any():
            part = [x.astype("<i8").tobytes() for x in np.split(total, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array(part, pa.binary()), pa.array(["count"] * BLOCKS)], schema=_KINDS)
        K.trim()

    return run


def _sum(dtype):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype).astype(np.float64 if dtype == "<f4" else np.int64) for x in table["data"])
        return pa.table([table["block"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["block", "data"])

    return run


def _pieces(wide: str):
    """(doc_id, piece, data) of documents cut into PIECE windows each, without overlap; data are the ids from the first window's first place on."""
    width, bos = np.dtype(wide).itemsize, np.array([BOS], wide).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            row, piece, out = [], [], []
            for i, x in enumerate(b.column(1)):
                raw = bos + x.as_buffer().to_pybytes()
                n = len(raw) // width - 1
                for k in range(-(-n // (CONTEXT * PIECE))):
                    at = k * PIECE * CONTEXT
                    row.append(i)
                    piece.append(k)
                    out.append(raw[at * width : (at + PIECE * CONTEXT + 1) * width])
            if out:
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(piece, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    return run


def _windows(pieces_of: list[bytes], wide: str, seed: int) -> np.ndarray:
    """All windows of pieces, in an order drawn by seed."""
    kept = [np.zeros((0, CONTEXT + 1), "<i4")]
    for k in range(0, len(pieces_of), 256):
        seq = [np.frombuffer(x, wide) for x in pieces_of[k : k + 256]]
        w, _, index = windows_of(np.concatenate([x[1:] for x in seq]).astype(np.int32), np.array([len(x) - 1 for x in seq]), CONTEXT)
        w[index == 0, 0] = [x[0] for x in seq]
        kept.append(w.astype("<i4"))
    w = np.concatenate(kept)
    return w[np.random.default_rng(seed).permutation(len(w))]


def _flat(m: Model, seen: np.ndarray, old: Model, n: int) -> np.ndarray:
    """Changes of all parameters, weighted, with the weights: how often each id was seen for its embedding, n for the rest."""
    return np.concatenate([seen, ((m.embed - old.embed) * seen[:, None]).ravel(), n * (m.out - old.out).ravel(), *(n * (m.rest[k] - old.rest[k]).ravel() for k, _ in SHAPES), [n]])


def _step(sent, rate, wide):
    """The changes that training on each of a task's groups of windows makes, weighted and summed."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("data", "ascending")])
        w = _windows([x.as_py() for x in order["data"]], wide, key[0].as_py())
        del order
        old, flat = Model.load(sent.value), 0
        for part in np.array_split(w, max(1, len(w) // GROUP)):
            m = Model.load(sent.value)
            batch = min(256, max(4, len(part) // 64))
            # a group of fewer than 64 steps goes in smaller ones, as the first steps tell little of the directions
            m.train(part, rate * min(1.0, len(part) / batch / 64), batch)
            flat = flat + _flat(m, np.bincount(np.maximum(part[:, :-1], 0).ravel(), minlength=len(m.embed)).astype(np.float32), old, len(part))
        flat = np.concatenate([flat, np.zeros(-len(flat) % BLOCKS)]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(flat, BLOCKS)], pa.binary())], names=["block", "data"])
        del w, flat, m, old
        K.trim()

    return run


def _collected(df: DataFrame, dtype) -> np.ndarray | None:
    rows = df.groupBy("block").applyInArrow(_sum(dtype), "block int, data binary").collect()  # BLOCKS rows, the model's size together
    return np.concatenate([np.frombuffer(bytes(r["data"]), "<f8" if dtype == "<f4" else "<i8") for r in sorted(rows, key=lambda r: r["block"])]) if rows else None


def fit(corpus: DataFrame, vocabulary: int, rounds: int = ROUNDS, rate: float = 0.3) -> Model:
    """A model trained on what `_gather` took from the corpus: every token is predicted in one of the rounds."""
    spark = corpus.sparkSession
    m = Model(vocabulary)
    counts = _collected(corpus.where("kind = 'count'").select("block", "data"), "<i8")
    if counts is None:
        return m
    m.count(counts[:vocabulary])
    if not rounds:
        return m
    wide = "<u2" if vocabulary <= 65536 else "<u4"
    docs = corpus.where("kind = 'doc'").select("doc_id", "data")
    count = docs.agg(F.sum(F.ceil(F.length("data") / (np.dtype(wide).itemsize * CONTEXT)))).first()[0] or 0
    tasks = max(1, int(count) // (GROUP * TOGETHER * rounds))
    cut = docs.mapInArrow(_pieces(wide), "doc_id bigint, piece int, data binary").withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "data"), F.lit(tasks * rounds)))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(m.dump())
        got = _collected(cut.where(F.col("g") % rounds == r).groupBy("g").applyInArrow(_step(sent, rate / (1 + r / 2), wide), "block int, data binary"), "<f4")
        if got is None:
            continue
        seen, at = got[:vocabulary], vocabulary * (1 + DIM)
        m.embed += (got[vocabulary:at].reshape(-1, DIM) / np.maximum(seen, 1)[:, None]).astype(np.float32)
        total = max(got[at + m.out.size + sum(x.size for x in m.rest.values())], 1)
        for x in (m.out, *(m.rest[k] for k, _ in SHAPES)):
            x += (got[at : at + x.size].reshape(x.shape) / total).astype(np.float32)
            at += x.size
    return m


def score_flat(m: Model, ids: np.ndarray, count: np.ndarray, batch: int = 128) -> np.ndarray:
    """Sum of -log p of each document's tokens, every token scored once."""
    w, doc, index = windows_of(ids, count)
    out = np.zeros(len(count))
    for head in (True, False):  # a document's first window scores all its tokens, the others the last STRIDE
        rows = np.flatnonzero((index == 0) == head)
        first = 0 if head else OVERLAP
        for b in range(0, len(rows), 16 * batch):
            r = rows[b : b + 16 * batch]
            x = np.maximum(w[r], 0)
            h = np.concatenate([m.attend(x[i : i + batch, :-1], first)[0] for i in range(0, len(x), batch)], axis=1)
            loss = m.losses(h, w[r][:, first + 1 :].ravel()).reshape(len(r), -1)
            out += np.bincount(doc[r], loss.sum(axis=1, dtype=np.float64), minlength=len(count))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("mean_nll", pa.float64())])


def score(docs: DataFrame, model: str = pieces.MODEL, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, mean_nll) of every row, under a model trained on the same rows.

    mean_nll is the mean of -log p over the tokens of the whole text, each scored
    once; null for null and empty texts, which have no tokens. Every token of every
    document is predicted once in training. Equal texts score equally; doc_id may be
    null; repeated rows are trained on and told as often as they occur; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    corpus = common.materialise(rows.mapInArrow(_gather(model), _KINDS_SQL), "lm-corpus", "kind")
    m = fit(corpus, pieces.Vocabulary.of(model).size, rounds)
    sent = spark.sparkContext.broadcast(m.dump())
    wide = "<u2" if len(m.embed) <= 65536 else "<u4"

    def run(batches):
        m = Model.load(sent.value)
        for b in batches:
            ids, data, k = b.column(0), b.column(1), b.num_rows
            size = np.array([len(x.as_buffer()) for x in data], np.int64) if k else np.zeros(0, np.int64)
            count = size // np.dtype(wide).itemsize
            begin = 0
            while begin < k:  # about 400,000 tokens at a time
                end = max(begin + 1, int(np.searchsorted(np.cumsum(count[begin:]), 400_000, "right")) + begin)
                flat = np.frombuffer(b"".join(x.as_buffer() for x in data.slice(begin, end - begin)), wide).astype(np.int32)
                c = count[begin:end]
                loss = score_flat(m, flat, c)
                mean = np.round(loss / np.maximum(c, 1), 4)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array(c.astype(np.int32)), pa.array(mean, mask=c == 0)], schema=_OUT)
                begin = end
        K.trim()

    return corpus.where("kind = 'doc'").select("doc_id", "data").mapInArrow(run, "doc_id bigint, n_tokens int, mean_nll double")
