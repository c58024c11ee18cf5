"""Files of vectors: .npy and raw little-endian floats, read in ranges by many tasks.

The driver reads only the header; each task fetches its own range of rows from
the store (local, HDFS, S3 and others that pyarrow reads). Ids are row numbers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError, ZeroDimError

SCHEMA = "id long, embedding array<float>"
#: Bytes that a task reads.
RANGE_BYTES = 32 << 20
_MAGIC = b"\x93NUMPY"


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem().open_input_file(uri)
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def npy_geometry(uri: str) -> tuple[int, int, int]:
    """First byte of the data, rows and dimension of a .npy file of C-ordered little-endian floats."""
    with _open(uri) as f:
        size, head = f.size(), io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0))
    try:
        version = np.lib.format.read_magic(head)
        if version not in ((1, 0), (2, 0), (3, 0)):
            raise SourceError(f"{uri}: npy version {version} is unknown")
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    except ValueError as e:
        raise SourceError(f"{uri}: {e}") from e
    if dtype.str != "<f4":
        raise SourceError(f"{uri}: dtype is {dtype.str}, expected <f4")
    if fortran:
        raise SourceError(f"{uri}: Fortran order, expected C order")
    if len(shape) != 2:
        raise SourceError(f"{uri}: shape {shape}, expected two dimensions")
    if shape[1] == 0:
        raise ZeroDimError
    if size - head.tell() != 4 * shape[0] * shape[1]:
        raise SourceError(f"{uri}: {size - head.tell()} bytes of data, expected {4 * shape[0] * shape[1]}")
    return head.tell(), shape[0], shape[1]


def raw_geometry(uri: str, dim: int | None) -> tuple[int, int, int]:
    if dim is None:
        raise SourceError(f"{uri}: a raw file needs dim")
    if dim <= 0:
        raise ZeroDimError
    with _open(uri) as f:
        size = f.size()
    if size % (4 * dim):
        raise SourceError(f"{uri}: {size} bytes are not whole rows of {dim} floats")
    return 0, size // (4 * dim), dim


def load_matrix(spark: SparkSession, uri: str, dim: int | None = None, *, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """SCHEMA and dimension of a .npy file (told by its magic) or of raw floats of a given dimension."""
    with _open(uri) as f:
        is_npy = f.size() >= 6 and f.read_at(6, 0) == _MAGIC
    begin, rows, dim = npy_geometry(uri) if is_npy else raw_geometry(uri, dim)
    per = max(1, range_bytes // (4 * dim))
    tasks = -(-rows // per)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(uri) as f:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    first, n = t * per, min(per, rows - t * per)
                    data = np.frombuffer(f.read_at(4 * dim * n, begin + 4 * dim * first), "<f4").astype(np.float32)
                    bounds = pa.array(np.arange(n + 1) * dim, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n), pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(data, pa.float32(), from_pandas=False))], names=["id", "embedding"])

    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(read, SCHEMA), dim
