"""Vector expressions over array columns. Arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12
WORD_BITS = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clipped to [-1, 1]; norms below FLOOR count as FLOOR. NaN stays: to Spark it is greater than 1."""
    c = dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))
    # Through an array, so that the sum is evaluated once.
    clip = lambda x: F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return F.get(F.transform(F.array(c), clip), F.lit(0))


def normalized(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(FLOOR))
    return F.transform(a, lambda x: x.cast("double") / n)


def valid(a: Column, width: int) -> Column:
    """Present, of the width, without null or non-finite numbers, and longer than FLOOR."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == width) & finite & (norm(a) > FLOOR), F.lit(False))


def sanitized(ranges: Column) -> Column:
    """array<struct<lo, hi>> with spans below 1e-6 widened; a range whose ends are swapped is an error."""
    bad = F.exists(ranges, lambda r: r["hi"] < r["lo"])
    wide = F.transform(ranges, lambda r: F.struct(r["lo"].alias("lo"), F.when(r["hi"] - r["lo"] < 1e-6, r["lo"] + 1e-6).otherwise(r["hi"]).alias("hi")))
    return F.when(bad, F.raise_error(F.lit("a calibration maximum is below its minimum"))).otherwise(wide)


def quantized(a: Column, ranges: Column) -> Column:
    """Signed 8-bit codes: 256 buckets of equal width from lo to hi, values beyond them clipped."""

    def code(x: Column, r: Column) -> Column:
        bucket = F.floor((x.cast("double") - r["lo"]) / ((r["hi"] - r["lo"]) / 255.0))
        return (F.greatest(F.lit(0), F.least(F.lit(255), bucket)) - 128).cast("tinyint")

    return F.zip_with(a, ranges, code)


def dequantized(q: Column, ranges: Column) -> Column:
    """Centres of the buckets; the last code stands for hi."""
    return F.zip_with(q, ranges, lambda c, r: F.least(r["lo"] + (c.cast("double") + 128.5) * ((r["hi"] - r["lo"]) / 255.0), r["hi"]))


def clipped(a: Column, ranges: Column) -> Column:
    """How many values lie outside their range."""
    return F.size(F.filter(F.zip_with(a, ranges, lambda x, r: (x.cast("double") < r["lo"]) | (x.cast("double") > r["hi"])), lambda b: b))


def sign_words(a: Column, width: int) -> Column:
    """Bits of the positive components, the first in the highest place, in words of WORD_BITS bits."""

    def word(at: int) -> Column:
        part = F.slice(a, at + 1, WORD_BITS)
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0))

    return F.array(*[word(at) for at in range(0, width, WORD_BITS)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
