import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parley.functions import signature as S


def words_of(bits):
    """256 bits as four signed words, the first bit being the sign of the first word."""
    out = []
    for w in range(len(bits) // 64):
        n = int("".join(map(str, bits[64 * w : 64 * w + 64])), 2)
        out.append(n - (1 << 64) if n >= 1 << 63 else n)
    return out


@pytest.fixture(scope="module")
def patterns(spark):
    rows = {"zeros": [0] * 256, "ones": [1] * 256, "alternating": [1, 0] * 128, "one bit": [0] * 255 + [1]}
    return spark.createDataFrame([(k, *words_of(v)) for k, v in rows.items()], "name string, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def test_distances_of_patterns(patterns):
    b = patterns.select(F.col("name").alias("other"), *[F.col(f"s{w}").alias(f"q{w}") for w in range(4)])
    d = {(r[0], r[1]): r[2] for r in patterns.crossJoin(b).select("name", "other", S.hamming(S.word_names(256), S.word_names(256, "q"))).collect()}
    assert d["zeros", "ones"] == 256 and d["zeros", "zeros"] == 0 and d["zeros", "one bit"] == 1 and d["ones", "alternating"] == 128
    assert all(d[a, b] == d[b, a] for a, b in d)


def test_signs_are_packed_first_dimension_first(spark):
    rows = [("plus", [1.0] * 64), ("minus", [-1.0] * 64), ("mixed", [1.0, -1.0] * 32), ("zero", [0.0] * 64), ("head", [1.0] * 4 + [-1.0] * 60)]
    got = {r["n"]: r["s0"] & (2**64 - 1) for r in S.with_signature(spark.createDataFrame(rows, "n string, v array<float>"), "v", 64).collect()}
    assert got == {"plus": 2**64 - 1, "minus": 0, "mixed": 0xAAAAAAAAAAAAAAAA, "zero": 2**64 - 1, "head": 0xF << 60}


def test_another_dimension_is_an_error(spark):
    with pytest.raises(PySparkException, match="expected 64 dimensions, got 3"):
        S.with_signature(spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>"), "v", 64).collect()


def test_bytes_round_trip(patterns):
    back = patterns.select("name", S.to_bytes(S.word_names(256)).alias("raw"), *S.word_names(256))
    again = back.select("name", *S.word_names(256), *S.from_bytes(F.col("raw"), 256, "t"))
    assert all(tuple(r)[1:5] == tuple(r)[5:9] for r in again.collect())
    ints = {r[0]: r[1] for r in patterns.select("name", S.to_ints(S.word_names(256))).collect()}
    assert ints["ones"] == [255] * 32 and ints["alternating"] == [170] * 32 and ints["one bit"] == [0] * 31 + [1]


def test_bits_and_bands(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (20, 256))
    df = spark.createDataFrame([(i, *words_of(b.tolist())) for i, b in enumerate(bits)], "i int, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    for count in (4, 7, 17):
        edge = [256 * k // count for k in range(count + 1)]
        for r in df.select("i", S.bits_of(S.word_names(256)).alias("bits"), S.bands(S.word_names(256), count).alias("b")).collect():
            assert r["bits"] == bits[r["i"]].tolist()
            assert [x["value"] & (2**64 - 1) for x in r["b"]] == [int("".join(map(str, bits[r["i"]][a:b])), 2) for a, b in zip(edge, edge[1:])]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=64, max_size=64))
def test_words_keep_all_bits(bits):
    from parley.operators.successor import unpack

    assert unpack(np.array([words_of(bits)], np.int64))[0].tolist() == bits
