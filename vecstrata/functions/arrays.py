"""The kernels over whole batches in numpy, equal to the Column expressions bit by bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..errors import RaggedError, StorageError


U64 = np.uint64
#: Pairs whose words are compared at once, so that they stay in a core's cache.
TILE_QUERIES, TILE_ROWS = 64, 1024
#: Values of pairs that are summed one by one at once.
PAIR_CELLS = 1 << 21


def matrix(column: pa.Array, dtype: type, dim: int) -> np.ndarray:
    """A list column as rows of dim values."""
    if column.null_count:
        raise StorageError(f"{column.null_count} vectors are null")
    flat = column.flatten()
    if flat.null_count:
        raise StorageError(f"{flat.null_count} elements of vectors are null")
    lengths = pc.list_value_length(column)
    if len(column) and pc.min_max(lengths).as_py() != {"min": dim, "max": dim}:
        raise RaggedError(next(n for n in lengths.to_pylist() if n != dim), dim)
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), dim)


def bit_rows(column: pa.Array, n_bytes: int) -> np.ndarray:
    """A BINARY column as rows of bytes, from its buffers."""
    if column.null_count:
        raise StorageError(f"{column.null_count} rows have no bits")
    if not len(column):
        return np.zeros((0, n_bytes), np.uint8)
    lengths = pc.binary_length(column)
    if pc.min_max(lengths).as_py() != {"min": n_bytes, "max": n_bytes}:
        raise RaggedError(next(n for n in lengths.to_pylist() if n != n_bytes), n_bytes)
    _, places, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    first = int(np.frombuffer(places, wide)[column.offset])
    return np.frombuffer(data, np.uint8, len(column) * n_bytes, first).reshape(len(column), n_bytes)


def signs(bits: np.ndarray, dim: int, dtype: type = np.float32) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=dim).astype(dtype) * 2 - 1


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, zeros behind the end."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return padded.view(U64)


def dot_f32(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All dots of float rows, summed in order of the dimensions."""
    total, by_dim = np.zeros((len(q), len(rows)), np.float32), np.ascontiguousarray(rows.T)
    product = np.empty_like(total)
    with np.errstate(all="ignore"):
        for d in range(rows.shape[1]):
            np.multiply(q[:, d, None], by_dim[d], out=product)
            total += product
    return total


def dot_f32_pairs(q: np.ndarray, rows: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """dot_f32 of some pairs: running sums give the same roundings as a loop."""
    out, step = np.empty(len(qi), np.float32), max(1, PAIR_CELLS // q.shape[1])
    with np.errstate(all="ignore"):
        for at in range(0, len(qi), step):
            part = slice(at, at + step)
            product = q[qi[part]] * rows[ri[part]]
            out[part] = np.add.accumulate(product, axis=1, dtype=np.float32, out=product)[:, -1]
    return out + np.float32(0)  # a loop begins with +0.0


def dot_int(q: np.ndarray, rows: np.ndarray, most: int = 128 * 128) -> np.ndarray:
    """All dots of integers whose products are up to `most`, exactly: floats hold them while no sum can pass 2**24."""
    kind = np.float32 if most * q.shape[1] <= 1 << 24 else np.float64
    found = q.astype(kind, copy=False) @ rows.astype(kind, copy=False).T
    found += 0  # no -0.0
    return found


def hamming(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of rows of bytes, or of 64-bit words."""
    q, rows = (x if x.dtype == U64 else words(x) for x in (q, rows))
    by_word = np.ascontiguousarray(rows.T)
    out = np.zeros((len(q), len(rows)), np.uint16 if q.shape[1] < 1 << 10 else np.uint32)
    for a in range(0, len(q), TILE_QUERIES):
        part = q[a : a + TILE_QUERIES]
        asked, differ, ones = np.empty((len(part), TILE_ROWS), U64), np.empty((len(part), TILE_ROWS), U64), np.empty((len(part), TILE_ROWS), np.uint8)
        for w in range(len(by_word)):
            asked[:] = part[:, w, None]  # spelled out once: XOR with a lone value isn't vectorised
            for b in range(0, len(rows), TILE_ROWS):
                total = out[a : a + TILE_QUERIES, b : b + TILE_ROWS]
                n = total.shape[1]
                np.bitwise_xor(asked[:, :n], by_word[w, b : b + n], out=differ[:, :n])
                total += np.bitwise_count(differ[:, :n], out=ones[:, :n])
    return out


def max_abs_scale(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        seen = np.where(np.isnan(x), np.float32(0), np.abs(x))
    return (seen.max(axis=1, initial=0).astype(np.float64) / 127).astype(np.float32)


def quantize_i8(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        usable = scale > 0
        inverse = np.where(usable, (1.0 / scale.astype(np.float64)).astype(np.float32), np.float32(0))
        y = (x * inverse[:, None]).astype(np.float64)
        rounded = np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127)
        return np.where(usable[:, None] & ~np.isnan(y), rounded, 0).astype(np.int8)


def pack_sign_bits(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.packbits(x > 0, axis=1)
