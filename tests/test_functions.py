"""Kernels and quantizers: known answers (fixed values), and Column expressions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata.functions import arrays, kernels, quant, rng

NAN = float("nan")


def one(spark, column, **values):
    types = {"x": "array<float>", "y": "array<float>", "s": "float", "c": "array<tinyint>", "d": "array<tinyint>", "b": "array<int>", "e": "array<int>", "bits": "binary"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[k]}" for k in values))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("x, packed", [([1, -1, 0.5, 2, -0.1, -3, -0.5, 1], [0xB1]), ([0.0, -0.0, NAN, 1.0], [0x10]), ([1.0] * 13, [0xFF, 0xF8])])
def test_pack_known(spark, x, packed):
    assert one(spark, quant.pack_sign_bits(F.col("x")), x=[float(v) for v in x]) == packed
    assert arrays.pack_sign_bits(np.array([x], np.float32))[0].tolist() == packed


def test_unpack_and_binary(spark):
    x = [0.0, -0.0, 1e-30, -1e-30, 3.0, -3.0, 1.0, -1.0, 2.0]
    assert one(spark, quant.unpack_sign_bits(quant.pack_sign_bits(F.col("x")), 9), x=x) == [1.0 if v > 0 else -1.0 for v in x]
    assert bytes(one(spark, quant.to_binary(F.col("b")), b=[0, 5, 255])) == b"\x00\x05\xff"
    assert one(spark, quant.from_binary(F.col("bits")), bits=bytearray(b"\x00\x05\xff")) == [0, 5, 255]


@pytest.mark.parametrize("x, scale", [([3.0, -4.0], 4 / 127), ([], 0.0), ([0.0, -0.0], 0.0), ([NAN, 2.0], 2 / 127)])
def test_scale_known(spark, x, scale):
    assert one(spark, quant.max_abs_scale(F.col("x")), x=x) == np.float32(scale)
    assert arrays.max_abs_scale(np.array([x], np.float32).reshape(1, len(x)))[0] == np.float32(scale)


@pytest.mark.parametrize(
    "x, s, codes",
    [
        ([-1e9, 1e9, -1.0, 1.0], 1 / 127, [-127, 127, -127, 127]), ([0.5, -0.5, 1.5, -1.5, 0.49, -0.49], 1.0, [1, -1, 2, -2, 0, 0]), ([1.0, -2.0], 0.0, [0, 0]), ([1.0, -2.0], -1.0, [0, 0]), ([1.0, 2.0], NAN, [0, 0]),
        ([0.5, -0.5], 1 / 127, [64, -64]), ([NAN, 1.0], 1 / 127, [0, 127]), ([0.49999997, -0.49999997], 1.0, [0, 0]), ([1.0, 5.0], float("inf"), [0, 0]),
    ],
)
def test_quantize_known(spark, x, s, codes):
    assert one(spark, quant.quantize_i8(F.col("x"), F.col("s")), x=x, s=s) == codes
    assert arrays.quantize_i8(np.array([x], np.float32), np.array([s], np.float32))[0].tolist() == codes


def test_dequantize_error_is_half_a_step(spark):
    x = np.random.default_rng(21).uniform(-2, 2, (40, 257)).astype(np.float32)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<float>").withColumn("s", quant.max_abs_scale(F.col("x")))
    df = df.withColumn("y", quant.dequantize_i8(quant.quantize_i8(F.col("x"), F.col("s")), F.col("s")))
    assert df.where(F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b))) > F.col("s") / 2 + 1e-6).isEmpty()


def test_int8_extremes(spark):
    a = [127, -127] * 512
    assert one(spark, kernels.dot_i8(F.col("c"), F.col("d")), c=a, d=a) == 1024 * 16129
    assert one(spark, kernels.dot_i8(F.col("c"), F.col("d")), c=[-128] * 1024, d=[127] * 1024) == -1024 * 16256


def test_hamming_counts_padding(spark):
    assert one(spark, kernels.hamming(F.col("b"), F.col("e")), b=[0xFF, 0xF8], e=[0xFF, 0xFD]) == 2


def test_length_check(spark):
    with pytest.raises(Exception, match="lengths differ: 2 vs 1"):
        one(spark, kernels.same_length(F.col("x"), F.col("y"), kernels.dot_f32(F.col("x"), F.col("y"))), x=[1.0, 2.0], y=[1.0])


@pytest.mark.parametrize("dim", [1, 7, 8, 9, 61, 64, 100])
def test_expressions_equal_numpy(spark, dim):
    r = np.random.default_rng(dim)
    x, y = r.normal(size=(12, dim)).astype(np.float32), r.normal(size=(12, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x array<float>, y array<float>")
    for n in "xy":
        df = df.withColumn(f"{n}s", quant.max_abs_scale(F.col(n))).withColumn(f"{n}c", quant.quantize_i8(F.col(n), F.col(f"{n}s"))).withColumn(f"{n}b", quant.pack_sign_bits(F.col(n)))
    c = F.col
    df = df.select("i", "xs", "xc", "xb", kernels.dot_f32(c("x"), c("y")).alias("f32"), kernels.dot_i8(c("xc"), c("yc")).alias("i8"), kernels.hamming(c("xb"), c("yb")).alias("h"), kernels.dot_f32_bin(c("x"), c("yb")).alias("fb"), kernels.dot_i8_bin(c("xc"), c("yb")).alias("ib"), kernels.dot_i8_scaled(c("xc"), c("xs"), c("yc"), c("ys")).alias("s"))
    xs, ys = arrays.max_abs_scale(x), arrays.max_abs_scale(y)
    xc, yc, xb, yb = arrays.quantize_i8(x, xs), arrays.quantize_i8(y, ys), arrays.pack_sign_bits(x), arrays.pack_sign_bits(y)
    f32, i8, h = arrays.dot_f32(x, y), arrays.dot_int(xc, yc), arrays.hamming(xb, yb)
    fb, ib = arrays.dot_f32(x, arrays.signs(yb, dim)), arrays.dot_int(xc, arrays.signs(yb, dim))
    for row in df.collect():
        i = row["i"]
        assert (np.float32(row["xs"]), row["xc"], row["xb"]) == (xs[i], xc[i].tolist(), xb[i].tolist())
        assert (row["f32"], row["i8"], row["h"], row["fb"], row["ib"]) == (f32[i, i], i8[i, i], h[i, i], fb[i, i], ib[i, i])
        assert row["s"] == np.float32(i8[i, i]) * (xs[i] * ys[i])


def test_offset_binary_is_an_involution(spark):
    v = list(range(-128, 128))
    assert one(spark, quant.offset_binary_to_bits(F.col("c")), c=v) == [x + 128 for x in v]


def test_splitmix64_published_outputs():
    assert [hex(x) for x in rng.splitmix64(0, 2).tolist()] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4"]


def test_splitmix64_pieces():
    bits = rng.splitmix64(5, 1000)
    assert rng.splitmix64(5, 10, 300).tolist() == bits[300:310].tolist()
    for n in (1, 7, 2**40 + 3):
        assert rng.bounded(bits, n).tolist() == [(b * n) >> 64 for b in bits.tolist()]
    g = rng.gaussian(rng.splitmix64(6, 20_000)[None, :])[0]
    assert abs(g.mean()) < 0.03 and abs(g.std() - 1) < 0.03
    u = rng.uniform(bits)
    assert 0 <= u.min() and u.max() < 1
    assert len(set(rng.substream(1, np.arange(100)).tolist())) == 100


def test_backends():
    assert kernels.detected() == "arrow"
    assert (kernels.by_name("catalyst"), kernels.by_name("simd"), kernels.binary_code_len(13)) == ("catalyst", None, 2)
