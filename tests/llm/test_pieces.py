import random

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import pieces as P

TEXTS = [
    "Hello world", "", " ", "  ", "   a  b   ", "a", "\n", "a\nb", "\n\n a", " \n ", "naïve Ärger über Straße", "日本語のテキスト and more", "emoji 😀😃 x", "\t tab \t", "x" * 3000, "lorem ipsum " * 20, "▁marked▁text", "12345 67.89", "\u0000 null", "mixed\r\nline ends\r\n",
    "ends with space ", "don't stop", "<s> </s> <unk>", "​zero width", "Ａ full width", "0x41", "a" * 7 + " " * 9 + "b",
]


@pytest.fixture(scope="module")
def v():
    return P.Vocabulary(P.MODEL)


def test_ids_are_the_library_s(v):
    for t, ids in zip(TEXTS, v.encode(TEXTS)):
        assert ids == v.library.encode(t), repr(t)


def test_random_texts(v):
    r = random.Random(5)
    alphabet = "abcdefghij  \n.,ÄöüßéABC123日😀'-"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 80))) for _ in range(1500)]
    assert v.encode(texts) == v.library.encode(texts)
    assert v.decode(v.encode(texts)) == texts


def agenda(v, symbols):
    """One unit by the plain algorithm: a heap of adjacent pairs by score, leftmost first."""
    import heapq

    lib, s = v.library, [[x, True] for x in symbols]
    left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
    heap = []

    def push(a, b):
        if a < 0 or b >= len(s):
            return
        piece = s[a][0] + s[b][0]
        i = lib.piece_to_id(piece)
        if i != lib.unk_id() and lib.id_to_piece(i) == piece:
            heapq.heappush(heap, (-lib.get_score(i), a, b, piece))

    for i in range(len(s) - 1):
        push(i, i + 1)
    while heap:
        _, a, b, piece = heapq.heappop(heap)
        if not s[a][1] or not s[b][1] or s[a][0] + s[b][0] != piece or right[a] != b:
            continue
        s[a][0], s[b][1] = piece, False
        right[a] = right[b]
        if right[b] < len(s):
            left[right[b]] = a
        push(left[a], a)
        push(a, right[a])
    return [x for x, alive in s if alive]


@pytest.mark.parametrize("word", ["international", "▁understanding", "▁▁▁▁indented", "aaaaaaa", "▁Donaudampfschifffahrt", "mississippi"])
def test_merges_follow_the_agenda(v, word):
    text = word.replace("▁", " ")
    got = [v.library.id_to_piece(i) for i in v.encode([text])[0]]
    symbols = "▁" + word if not text.startswith(" ") else "▁" + word
    assert got == agenda(v, list(symbols))


def test_encoded_rows(docs_of, v):
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(200_000))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "a b"), (200, "again"), (200, "again"), (101, long), (102, long.replace(" ", ""))]
    got = P.encode(docs_of(rows)).collect()
    assert len(got) == len(rows) and all(r["agrees"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        r = by[i][0]
        if t is None:
            assert r["ids"] is None and r["n_tokens"] == 0 and r["roundtrip"]
            continue
        assert r["n_tokens"] == len(r["ids"]) and r["roundtrip"] == ("▁" not in t)
        if len(t) < 100_000:
            assert r["ids"] == v.library.encode(t)
    assert by[101][0]["ids"] == v.library.encode(long)
    assert P.encode(docs_of([])).collect() == []


def test_decoding(docs_of, spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if "▁" not in t] + [(100, None)]
    back = {r["doc_id"]: r["text"] for r in P.decode(P.encode(docs_of(rows))).collect()}
    assert back == dict(rows)


def test_units_are_kept_apart_from_the_store(v):
    v.forget()
    a = v.encode(["one two three one two"])
    assert a == v.encode(["one two three one two"]) == [v.library.encode("one two three one two")]
    ids, count, ok = v.encode_chunk(*__import__("parley.llm.kernel", fromlist=["x"]).text_buffers(pa.array(["", None, "x"], pa.string())))
    assert count.tolist()[:2] == [0, 0] and ok.all() and len(ids) == count[2]


def test_cached_units_are_still_checked(monkeypatch):
    """Units that were encoded without a check, as for the language model, are checked when they are met again."""
    from parley.llm import kernel as K
    from parley.llm import pieces

    v, asked = pieces.Vocabulary.of(pieces.MODEL), []
    v.forget()
    encode = v.encode_units
    monkeypatch.setattr(v, "encode_units", lambda raw, s, e, check: (asked.append(check), encode(raw, s, e, check))[1])
    text = K.text_buffers(__import__("pyarrow").array(["a few words here"]))
    plain, _, _ = v.encode_chunk(*text, check=False)
    checked, _, ok = v.encode_chunk(*text, check=True)
    v.encode_chunk(*text, check=True)
    assert asked == [False, True] and ok.all() and plain.tolist() == checked.tolist()


def test_units_of_one_hash_are_told_apart():
    """With few bits of the hash left, nearly all units clash, within a chunk and with those kept; the ids stay the library's."""
    v = P.Vocabulary(P.MODEL)
    texts = [f"the {w} house{i} and {i * 7} other  words\n{w}" for i, w in enumerate("red green blue black white grey brown pink".split())] * 2
    for bits in (0, 2, 5):
        v.mask = np.uint64(2**bits - 1)
        v.forget()
        for part in (texts[:5], texts[3:], ["quite new ones here", "the red house0"]):
            ids, count, ok = v.encode_chunk(*P.K.text_buffers(pa.array(part)))
            assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == v.library.encode(part) and ok.all()


def test_ids_beyond_the_vocabulary(spark):
    df = spark.createDataFrame([(1, [5000, None, 10**9, -1]), (2, None), (None, []), (1, [5000, None, 10**9, -1])], "doc_id bigint, ids array<int>")
    v = P.Vocabulary.of(P.MODEL)
    want = v.decode([[5000] + [v.unknown] * 3])[0]
    assert sorted(((r["doc_id"], r["text"]) for r in P.decode(df).collect()), key=repr) == sorted([(1, want), (1, want), (2, None), (None, "")], key=repr)
    assert P.decode(df.limit(0)).collect() == []
