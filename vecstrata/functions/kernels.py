"""Distance kernels as Column expressions: the semantics that all backends share.

Vectors are array<float>, int8 codes array<tinyint>, sign bits array<int> of
bytes (0 to 255, most significant bit first, padding zero). Float sums run in
order of the dimensions, each step rounded to float; integer sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Backends, the best first: numpy on Arrow batches, and plain expressions.
NAMES = ("arrow", "catalyst")


def detected() -> str:
    """The best backend that is installed."""
    try:
        import pyarrow  # noqa: F401
    except ImportError:
        return "catalyst"
    return "arrow"


def by_name(name: str) -> str | None:
    return name if name in NAMES else None


def binary_code_len(dim: int) -> int:
    """Bytes of the sign bits of dim dimensions."""
    return -(-dim // 8)


def _differ(a: Column, b: Column) -> Column:
    """An error that names the sizes of two arrays."""
    told = lambda x: F.coalesce(F.size(x).cast("string"), F.lit("none"))
    return F.raise_error(F.concat(F.lit("lengths differ: "), told(a), F.lit(" vs "), told(b)))


def same_length(a: Column, b: Column, value: Column, kind: str = "float") -> Column:
    """value, of type `kind`, or an error where the arrays differ in length or one is missing."""
    return F.when(F.size(a) == F.size(b), value).otherwise(_differ(a, b).cast(kind))


def _sum(products: Column, zero: Column) -> Column:
    return F.aggregate(products, zero, lambda t, v: t + v)


def dot_f32(a: Column, b: Column) -> Column:
    return same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("float")), "float")


def dot_i8(a: Column, b: Column) -> Column:
    return same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0)), "int")


def dot_i8_scaled(a: Column, scale_a: Column, b: Column, scale_b: Column) -> Column:
    return dot_i8(a, b).cast("float") * (scale_a * scale_b)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two byte arrays, padding included."""
    return same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0)), "int")


def hamming_score(a: Column, b: Column) -> Column:
    return (-hamming(a, b)).cast("float")


def bit(codes: Column, i: Column) -> Column:
    """Whether bit i of a byte array is set."""
    mask = F.call_function("shiftleft", F.lit(1), F.lit(7) - i % 8)
    return F.get(codes, F.floor(i / 8).cast("int")).bitwiseAND(mask) != 0


def _signed(values: Column, codes: Column, zero: Column, kind: str) -> Column:
    def step(t: Column, i: Column) -> Column:
        v = F.get(values, i)
        return F.when(bit(codes, i), t + v).otherwise(t - v)

    at = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.size(codes) == F.ceil(F.size(values) / 8)
    return F.when(whole, F.aggregate(at, zero, step)).otherwise(_differ(values, codes).cast(kind))


def dot_f32_bin(q: Column, codes: Column) -> Column:
    return _signed(q, codes, F.lit(0.0).cast("float"), "float")


def dot_i8_bin(q: Column, codes: Column) -> Column:
    return _signed(F.transform(q, lambda x: x.cast("int")), codes, F.lit(0), "int")
