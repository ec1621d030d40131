"""Secrets, confirmed by their structure.

Candidates lie in maximal runs of base64, base64url or hex characters, found on
the text's bytes. As a run may hold more than a secret, such as a path or a name
before it, candidates begin wherever a kind can begin: at the first characters of
its encoding, or after a separator; the encoding's own lengths tell where they
end. A candidate is reported only once it decodes and what it decodes
to has the inner structure of its kind: a signed token's header and payload are
JSON objects with an algorithm, a DER key's nested lengths add up to the end and
hold the integers of its kind, an OpenSSH blob's length-prefixed fields fill it,
a cloud key id decodes to an account number. A hex value that is assigned to a
secret's name decodes whole to bytes that aren't a mere pattern, but has no inner
structure; it is told apart as not confirmed.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernel as K

LEAST = 16
_RUN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.="))
_HEX = re.compile(rb"[0-9a-fA-F]+\Z")
_B64 = re.compile(rb"[A-Za-z0-9+/]+={0,2}\Z")
_B64URL = re.compile(rb"[A-Za-z0-9_-]+={0,2}\Z")
_NAMED = re.compile(rb"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s*[:=]\s*[\"']?\Z")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\+[nrt/])*)-----END \1-----")
_PEM_SPACE = re.compile(rb"\s+|\\+[nrt]|\\+(?=/)")  # line ends may be escaped, as in JSON
_AWS = re.compile(rb"(?<![A-Za-z0-9+])(?:AKIA|ASIA)([A-Z2-7]{16})(?![A-Za-z0-9+])")
_PART = (re.compile(rb"[A-Za-z0-9+/]{16,}"), re.compile(rb"[A-Za-z0-9_-]{16,}"))
_KEY = re.compile(rb"MI[GHI]|(?<![A-Za-z0-9])M[A-P]|b3BlbnNzaC1rZXktdjEA")  # the first bytes of DER sequences and of OpenSSH keys
_HEXES = re.compile(rb"(?<![A-Za-z0-9])[0-9a-fA-F]{16,}(?![A-Za-z0-9])")
_JSON = re.compile(rb"e[yw][A-Za-z0-9_-]")
SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}


def _b64(raw: bytes, url: bool = False) -> bytes | None:
    """Strict base64: right alphabet, length and padding bits."""
    if not (_B64URL if url else _B64).match(raw):
        return None
    raw = raw.rstrip(b"=")
    if len(raw) % 4 == 1:
        return None
    out = (base64.urlsafe_b64decode if url else base64.b64decode)(raw + b"=" * (-len(raw) % 4))
    back = (base64.urlsafe_b64encode if url else base64.b64encode)(out).rstrip(b"=")
    return out if back == raw else None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """Elements (tag, contents or children) that fill data[at:end] exactly; None if lengths don't add up."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 128:
            k = size & 127
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
            if size < 128:
                return None
        if at + size > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def der_kind(data: bytes) -> str | None:
    """The kind of key that a DER encoding holds."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or not top[0][1]:
        return None
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if tags == [2] * 9 and parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 64:
        return "rsa_private_key"
    if tags[:3] == [2, 0x30, 4] and len(parts[0][1]) == 1 and parts[1][1] and parts[1][1][0][0] == 6:
        return "pkcs8_private_key"
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and 20 <= len(parts[1][1]) <= 66:
        return "ec_private_key"
    if tags == [2] * 6 and parts[0][1] == b"\0" and len(parts[1][1]) >= 64:
        return "dsa_private_key"
    if tags == [0x30, 4] and parts[0][1] and parts[0][1][0][0] == 6:
        return "encrypted_private_key"
    return None


def ssh_kind(data: bytes) -> str | None:
    """The kind of OpenSSH key whose length-prefixed fields fill the data."""
    magic = b"openssh-key-v1\0"
    at, private = (len(magic), True) if data.startswith(magic) else (0, False)
    if not private:
        return None  # public keys are no secrets
    fields = []
    while at < len(data):
        if len(fields) == 3:  # cipher, kdf and kdf options are followed by the number of keys
            if at + 4 > len(data) or not 1 <= int.from_bytes(data[at : at + 4], "big") <= 16:
                return None
            at += 4
        size = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else -1
        if size < 0 or at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return "openssh_private_key" if len(fields) >= 5 and fields[3][4:8] in (b"ssh-", b"ecds", b"sk-s") else None


def signed_token(raw: bytes) -> bool:
    """Whether three base64url parts are a signed token: JSON header with a known algorithm, JSON payload, signature of its length."""
    parts = raw.split(b".")
    if len(parts) != 3:
        return False
    got = [_b64(p, True) if p else b"" for p in parts]
    if None in got or not got[0] or not got[1]:
        return False
    try:
        head, body = json.loads(got[0]), json.loads(got[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or head.get("alg") not in SIGNED:
        return False
    size = SIGNED[head["alg"]]
    return len(got[2]) == size if size is not None else len(got[2]) >= 128


def _random_bytes(data: bytes) -> bool:
    """Whether decoded bytes look drawn, not counted or repeated: at least half of them differ, or of all bytes that there are, and so do their steps."""
    step = {(y - x) % 256 for x, y in zip(data, data[1:])}
    return 2 * len(set(data)) > min(len(data), 256) and 2 * len(step) > min(len(data) - 1, 256)


def _length(data: bytes) -> int | None:
    """How many bytes a DER sequence or OpenSSH key that begins with the data has, by its own lengths; None if they don't say."""
    if data[:1] == b"0":
        if len(data) < 2 or data[1] < 128:
            return 2 + data[1] if len(data) > 1 else None
        k = data[1] & 127
        return 2 + k + int.from_bytes(data[2 : 2 + k], "big") if 1 <= k <= 4 and len(data) >= 2 + k else None
    at, left = len(b"openssh-key-v1\0"), 3
    keys = False
    while left:
        if at + 4 > len(data):
            return None
        at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        if not left and not keys:  # cipher, kdf and its options; then the public keys, and the private ones together
            n = int.from_bytes(data[at : at + 4], "big")
            if not 1 <= n <= 16:
                return None
            at, left, keys = at + 4, n + 1, True
    return at


def _keys(run: bytes):
    """(start, end, kind) of encoded keys in a run."""
    for url, form in enumerate(_PART):
        for part in form.finditer(run):
            for m in _KEY.finditer(run, part.start(), part.end()):
                a, e = m.start(), part.end()
                head = run[a : min(e, a + 8 if run[a] == 77 else e)]
                n = _length((base64.urlsafe_b64decode if url else base64.b64decode)(head[: len(head) // 4 * 4]))
                c = -(-n * 4 // 3) if n else 0
                if not LEAST <= c <= e - a or run[a + c : a + c + 1].isalnum():
                    continue
                data = _b64(run[a : a + c], bool(url))
                kind = data and (der_kind(data) or ssh_kind(data))
                if kind:
                    c += len(re.match(rb"=*", run[a + c : a + c + -c % 4])[0])
                    yield a, a + c, kind


def _tokens(run: bytes):
    """(start, end) of signed tokens in a run: a header that may begin anywhere before a dot, a whole payload, and a signature up to a separator."""
    parts, at = run.split(b"."), 0
    for head, body, tail in zip(parts, parts[1:], parts[2:]):
        if _JSON.match(body) and _b64(body, True):
            sign = re.match(rb"[A-Za-z0-9_-]*(?:={1,2}(?![A-Za-z0-9=]))?", tail)[0]
            for m in _JSON.finditer(head):
                first = head[m.start() :]
                if not _B64URL.match(first):
                    continue
                # after a signature may follow a name set off by a hyphen or underscore
                sizes = {-(-n * 4 // 3) for n in SIGNED.values() if n is not None}
                ends = [sign] + [sign[:n] for n in sorted(sizes, reverse=True) if sign[n : n + 1] in (b"-", b"_")]
                ends += [b""] if sign and not sign[:1].isalnum() else []
                got = next((x for x in ends if signed_token(b".".join((first, body, x)))), None)
                if got is not None:
                    yield at + m.start(), at + len(head) + len(body) + 2 + len(got)
                    break
        at += len(head) + 1


def confirmed(run: bytes, before: bytes):
    """(start, end, kind) of all secrets in a run, given the bytes before it; those that begin first, and of these the longest, where some overlap."""
    found = [(a, e, "signed_token") for a, e in _tokens(run)] if run.count(b".") >= 2 else []
    if b"AKIA" in run or b"ASIA" in run:
        found += [(m.start(), m.end(), "cloud_key_id") for m in _AWS.finditer(run) if int.from_bytes(base64.b32decode(m[1])[:6], "big") >> 7 & 0xFFFFFFFFFF <= 999_999_999_999]
    if b"M" in run or b"b3Blbn" in run:
        found += _keys(run)
    for m in _HEXES.finditer(run):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0].decode())
            kind = der_kind(data) or ssh_kind(data)
            if not kind and _NAMED.search((before + run[: m.start()])[-40:]) and _random_bytes(data):
                kind = "assigned_hex"
            if kind:
                found.append((m.start(), m.end(), kind))
    last = 0
    for a, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= last:
            yield a, e, kind
            last = e


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least LEAST characters within one text."""
    on = _RUN[data]
    n = len(data)
    edge = np.empty(n + 1, bool)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge[0], edge[n] = on[0], on[n - 1]
    np.not_equal(on[1:], on[:-1], out=edge[1:n])
    pos = np.flatnonzero(edge)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[on[cut] & on[cut - 1]]
    if len(cut):
        pos = np.sort(np.concatenate([pos, cut, cut]))
    s, e = pos[0::2], pos[1::2]
    long = e - s >= LEAST
    return s[long], e[long]


def scan_chunk(data: np.ndarray, offsets: np.ndarray):
    """(text in chunk, kind, start byte in the text, secret) of a chunk."""
    raw = data.tobytes()
    taken = []
    at = raw.find(b"-----BEGIN ")
    while at >= 0:
        m = _PEM.match(raw, at)
        if m:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            got = _b64(_PEM_SPACE.sub(b"", m[2])) if m.end() <= offsets[d + 1] else None
            kind = got and (der_kind(got) or ssh_kind(got))
            if kind:
                yield d, kind, at - int(offsets[d]), m[0]
                taken.append((m.start(), m.end()))
        at = raw.find(b"-----BEGIN ", at + 1)
    s, e = candidates(data, offsets)
    d = np.searchsorted(offsets, s, "right") - 1
    for a, b, t in zip(s.tolist(), e.tolist(), d.tolist()):
        low = int(offsets[t])
        for k, end, kind in confirmed(raw[a:b], raw[max(low, a - 40) : a]):
            if not any(x < a + end and a + k < y for x, y in taken):
                yield t, kind, a + k - low, raw[a + k : a + end]


_OUT = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("secret", pa.string()), ("confirmed", pa.bool_())])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, secret, confirmed) of every secret; start counts bytes of the UTF-8 text.

    confirmed tells whether the decoded bytes have the inner structure of their kind;
    it is false for `assigned_hex` alone, which has none.

    Texts are scanned whole, at any length. Null and empty texts hold none; rows
    without doc_id are told with a null id; repeated rows are told as often as they
    occur; other columns are ignored; an empty table gives no rows.
    """

    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(ids[row + t], kind, start, v.decode(), kind != "assigned_hex") for row, _, data, offsets in K.chunks(b.column(1)) for t, kind, start, v in scan_chunk(data, offsets)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, kind string, start bigint, secret string, confirmed boolean")
