"""Quantizers as Column expressions: int8 codes with a scale, and sign bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import bit

_F = lambda x: F.lit(float(x)).cast("float")


def max_abs(x: Column) -> Column:
    """Largest absolute value, NaN ignored; 0 for none."""
    seen = F.filter(F.transform(x, F.abs), lambda v: ~F.isnan(v))
    return F.coalesce(F.array_max(seen), _F(0))


def max_abs_scale(x: Column) -> Column:
    return (max_abs(x) / 127).cast("float")


def fixed_scale(df: DataFrame, vector: str) -> float:
    """One scale for all vectors of a table."""
    found = df.agg((F.coalesce(F.max(max_abs(F.col(vector))), _F(0)) / 127).cast("float").alias("s")).first()
    return found["s"]


def _usable(scale: Column) -> Column:
    return (scale > 0) & ~F.isnan(scale)


def quantize_i8(x: Column, scale: Column) -> Column:
    """Codes from -127 to 127, halves rounded away from zero; all 0 for a scale that isn't positive, 0 for NaN."""
    inverse = F.when(_usable(scale), (F.lit(1.0) / F.nullif(scale.cast("double"), F.lit(0.0))).cast("float")).otherwise(_F(0))

    def code(v: Column) -> Column:
        y = v * inverse
        rounded = F.greatest(_F(-127), F.least(_F(127), F.round(y)))
        return F.when(_usable(scale) & ~F.isnan(y), rounded).otherwise(_F(0)).cast("tinyint")

    return F.transform(x, code)


def dequantize_i8(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("float") * scale)


def pack_sign_bits(x: Column) -> Column:
    """Bytes (0 to 255) of the bits x > 0, most significant first; NaN and zeros give 0, padding too."""

    def one(i: Column) -> Column:
        v = F.coalesce(F.get(x, i), _F(0))
        return F.when((v > 0) & ~F.isnan(v), 1).otherwise(0)

    byte = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, i: a * 2 + one(b * 8 + i))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / 8).cast("int") - 1), byte)


def unpack_sign_bits(codes: Column, dim: Column | int) -> Column:
    """+1 or -1 for each of the dim bits."""
    n = F.lit(dim) if isinstance(dim, int) else dim
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(bit(codes, i), _F(1)).otherwise(_F(-1)))


def to_binary(codes: Column) -> Column:
    """array<int> of bytes as BINARY."""
    return F.unhex(F.array_join(F.transform(codes, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def from_binary(bits: Column) -> Column:
    """BINARY as array<int> of bytes 0 to 255."""
    n = F.octet_length(bits)
    hexed = F.hex(bits)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def offset_binary_to_bits(v: Column) -> Column:
    """Bytes 0 to 255 from offset-binary signed bytes."""
    return F.transform(v, lambda b: b.cast("int") + 128)


def l2_normalize(x: Column) -> Column:
    """x divided by its norm (a double rounded to float); zero rows stay."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))).cast("float")
    return F.when(norm > 0, F.transform(x, lambda v: (v / F.nullif(norm, _F(0))).cast("float"))).otherwise(x)


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))
