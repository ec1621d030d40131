"""Binary signatures as BIGINT words s0, s1, ... and the expressions over them.

Bit i of a signature is dimension i; it lies in word i div 64, at the place
63 - i mod 64, so words are big-endian and the first dimension is the sign bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shl(c: Column, n: Column | int) -> Column:
    """c << n, where n may be a column."""
    return F.call_function("shiftleft", c, F.lit(n) if isinstance(n, int) else n)


def shru(c: Column, n: Column | int) -> Column:
    """c >>> n, where n may be a column."""
    return F.call_function("shiftrightunsigned", c if isinstance(c, Column) else F.col(c), F.lit(n) if isinstance(n, int) else n)


def word_names(bits: int, prefix: str = "s") -> list[str]:
    return [f"{prefix}{w}" for w in range(bits // 64)]


def quantise(vector: Column, bits: int, prefix: str = "s") -> list[Column]:
    """Sign-bit words of an array column of `bits` numbers: a component of zero or more sets its bit."""

    def word(w: int) -> Column:
        part = F.slice(vector, 64 * w + 1, 64)
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x >= 0, 1).otherwise(0).cast("bigint")))

    return [word(w).alias(f"{prefix}{w}") for w in range(bits // 64)]


def with_signature(df: DataFrame, vector: str, bits: int, prefix: str = "s") -> DataFrame:
    """Adds the words of a vector column; a vector of another length is an error."""
    v = F.col(vector)
    checked = F.when(F.size(v) == bits, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {bits} dimensions, got "), F.size(v).cast("string"))))
    return df.select("*", *quantise(checked, bits, prefix))


def hamming(a: list, b: list) -> Column:
    """Number of differing bits of two signatures, given as words (columns, names or integers)."""
    as_col = lambda x: F.lit(x).cast("bigint") if isinstance(x, int) else F.col(x) if isinstance(x, str) else x
    return reduce(lambda x, y: x + y, [F.bit_count(as_col(x).bitwiseXOR(as_col(y))) for x, y in zip(a, b, strict=True)])


def get_bit(words: list[str], i: Column | int) -> Column:
    """Bit i of a signature, 0 or 1."""
    i = F.lit(i) if isinstance(i, int) else i
    word = F.element_at(F.array(*words), (F.floor(i / 64) + 1).cast("int"))
    return shru(word, (63 - i % 64).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def bits_of(words: list[str]) -> Column:
    """All bits of a signature as an array of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(64 * len(words) - 1)), lambda i: get_bit(words, i))


def band(words: list[str], first: int, last: int) -> Column:
    """Bits first .. last - 1 (at most 64 of them) as a number."""
    n, w, off = last - first, first // 64, first % 64
    if off + n <= 64:
        part = shru(F.col(words[w]), 64 - off - n)
    else:
        rest = off + n - 64
        part = shl(F.col(words[w]), rest).bitwiseOR(shru(F.col(words[w + 1]), 64 - rest))
    return part if n == 64 else part.bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def bands(words: list[str], count: int) -> Column:
    """Array of (band, value) structs that split a signature into `count` parts of about the same size."""
    bits = 64 * len(words)
    edge = [bits * i // count for i in range(count + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), band(words, edge[i], edge[i + 1]).cast("bigint").alias("value")) for i in range(count)])


def to_bytes(words: list[str]) -> Column:
    """BINARY form of a signature, big-endian words."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.col(w)), 16, "0") for w in words]))


def from_bytes(raw: Column, bits: int, prefix: str = "s") -> list[Column]:
    """Words of a BINARY signature."""
    digits = F.hex(raw)
    high = lambda w: F.conv(F.substring(digits, 16 * w + 1, 8), 16, 10).cast("bigint")
    low = lambda w: F.conv(F.substring(digits, 16 * w + 9, 8), 16, 10).cast("bigint")
    return [shl(high(w), 32).bitwiseOR(low(w)).alias(f"{prefix}{w}") for w in range(bits // 64)]


def to_ints(words: list[str]) -> Column:
    """The bytes of a signature as an array of numbers from 0 to 255, as in JSON."""
    def of_word(w: str) -> Column:
        return F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: shru(F.col(w), (k * 8).cast("int")).bitwiseAND(F.lit(255)).cast("int"))

    return F.flatten(F.array(*map(of_word, words)))


def literal_words(row, bits: int, prefix: str = "s") -> list[int]:
    return [int(row[f"{prefix}{w}"]) for w in range(bits // 64)]


def register_sql(spark) -> None:
    """Makes `ham64(a, b)` and `ham256(a, b)` known to SQL: differing bits of two numbers, and of two arrays of four."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ham64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")
    words = " + ".join(f"bit_count(a[{w}] ^ b[{w}])" for w in range(4))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ham256(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT RETURN {words}")
