"""Corpora and query sets: tables of vectors with a known dimension.

A corpus table holds id and any of the representations: embedding (array<float>),
codes (array<tinyint>) with scale (float), bits (BINARY) with bit_bytes
(array<int>). They are columns of their own, so a scan reads only what it scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RaggedError, ScaleCountError, StorageError, StrideError, TooManyRowsError, ZeroDimError
from ..functions import arrays, quant
from ..functions.kernels import binary_code_len, detected

U32_ROWS = 2**32 - 1


def _dim(df: DataFrame, column: str, dim: int | None) -> int:
    """The length that all arrays of a column have."""
    found = df.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi"), F.count("*").alias("n"), F.count(column).alias("full")).first()
    if found["n"] != found["full"]:
        raise StorageError(f"{found['n'] - found['full']} rows have no {column}")
    if found["n"] == 0:
        if not dim:
            raise ZeroDimError
        return dim
    want = dim or found["hi"]
    if want <= 0:
        raise ZeroDimError
    if (found["lo"], found["hi"]) != (want, want):
        raise RaggedError(found["lo"] if found["lo"] != want else found["hi"], want)
    return want


@dataclass(frozen=True)
class Vectors:
    """df with `id` and representations of dimension dim."""

    df: DataFrame
    dim: int

    def __repr__(self) -> str:
        return f"{type(self).__name__}(dim={self.dim}, columns={[c for c in self.df.columns]})"

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    @property
    def representations(self) -> list[str]:
        return [c for c in ("embedding", "codes", "bits") if c in self.df.columns]

    def row(self, row_id: int) -> DataFrame:
        return self.df.where(F.col("id") == row_id)

    def with_int8(self, scale: float | None = None):
        """Adds codes, with one scale per row or the one given."""
        s = quant.max_abs_scale(F.col("embedding")) if scale is None else F.lit(scale).cast("float")
        df = self.df.withColumn("scale", s)
        return replace(self, df=df.withColumn("codes", quant.quantize_i8(F.col("embedding"), F.col("scale"))))

    def with_bits(self):
        """Adds sign bits."""
        df = self.df.withColumn("bit_bytes", quant.pack_sign_bits(F.col("embedding")))
        return replace(self, df=df.withColumn("bits", quant.to_binary(F.col("bit_bytes"))))

    def prepared(self, backend: str | None = None):
        """All representations: in numpy on Arrow batches, or as expressions; both give the same."""
        if (backend or detected()) != "arrow" or "embedding" not in self.df.columns:
            return self.with_int8().with_bits()
        df, dim = self.df.drop("scale", "codes", "bit_bytes", "bits"), self.dim
        at, names = df.columns.index("embedding"), ["scale", "codes", "bit_bytes", "bits"]

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = arrays.matrix(batch.column(at), np.float32, dim)
                scale, bits = arrays.max_abs_scale(x), arrays.pack_sign_bits(x)

                def lists(rows: np.ndarray, kind: pa.DataType, n: int = len(x)) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1), kind))

                places = pa.array(np.arange(len(x) + 1) * bits.shape[1], pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, places.buffers()[1], pa.py_buffer(bits.tobytes())])
                new = [pa.array(scale, pa.float32(), from_pandas=False), lists(arrays.quantize_i8(x, scale), pa.int8()), lists(bits.astype(np.int32), pa.int32()), packed]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return replace(self, df=df.mapInArrow(make, f"{schema}, scale float, codes array<tinyint>, bit_bytes array<int>, bits binary"))


class Corpus(Vectors):
    """The vectors that are searched."""

    @classmethod
    def from_dataframe(cls, df: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int | None = None, *, strict: bool = True, validate: bool = True, u32_ids: bool = False, keep: tuple[str, ...] = ()) -> Corpus:
        """A corpus of float vectors. Rows without a vector or with a null element
        are an error (strict) or left out; `keep` names columns for filters.

        Validation reads all vectors once. Without it the first row gives the
        dimension, and a scan fails in the task that meets a row of another shape.
        """
        df = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<float>").alias("embedding"), *[df[c] for c in keep])
        whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull()) & F.col("id").isNotNull()
        df = df if strict else df.where(whole)
        if not validate:
            first = None if dim else df.select(F.size("embedding").alias("n")).first()
            dim = dim or (first["n"] if first else None)
            if not dim or dim < 0:
                raise ZeroDimError
            return cls(df, dim)
        if strict and not df.where(~whole).isEmpty():
            raise StorageError("a vector, an element or an id is null")
        if u32_ids and (n := df.count()) > U32_ROWS:
            raise TooManyRowsError(n)
        return cls(df, _dim(df, "embedding", dim))

    @classmethod
    def from_int8(cls, df: DataFrame, id_col: str = "id", codes_col: str = "codes", scale_col: str = "scale", dim: int | None = None) -> Corpus:
        """A corpus of codes that were quantized elsewhere."""
        df = df.select(df[id_col].cast("long").alias("id"), df[codes_col].cast("array<tinyint>").alias("codes"), df[scale_col].cast("float").alias("scale"))
        counted = df.agg(F.count("scale").alias("s"), F.count("*").alias("n")).first()
        if counted["s"] != counted["n"]:
            raise ScaleCountError(counted["s"], counted["n"])
        return cls(df, _dim(df, "codes", dim))

    @classmethod
    def from_bits(cls, df: DataFrame, dim: int, id_col: str = "id", bits_col: str = "bits", *, offset_binary: bool = False, check_padding: bool = False) -> Corpus:
        """A corpus of packed sign bits: BINARY, or arrays of signed offset-binary bytes."""
        if dim <= 0:
            raise ZeroDimError
        need = binary_code_len(dim)
        if offset_binary:
            df = df.select(df[id_col].cast("long").alias("id"), quant.offset_binary_to_bits(df[bits_col]).alias("bit_bytes"))
            df = df.withColumn("bits", quant.to_binary(F.col("bit_bytes")))
        else:
            df = df.select(df[id_col].cast("long").alias("id"), df[bits_col].cast("binary").alias("bits"))
            df = df.withColumn("bit_bytes", quant.from_binary(F.col("bits")))
        found = df.agg(F.min(F.octet_length("bits")).alias("lo"), F.max(F.octet_length("bits")).alias("hi"), F.count("*").alias("n"), F.count("bits").alias("full")).first()
        if found["n"] != found["full"]:
            raise StorageError("a row has no bits")
        if found["n"] and (found["lo"], found["hi"]) != (need, need):
            raise StrideError(found["lo"], need) if found["lo"] < need else RaggedError(found["hi"], need)
        if check_padding and dim % 8 and not df.where(F.element_at("bit_bytes", -1).bitwiseAND(F.lit((1 << (8 - dim % 8)) - 1)) != 0).isEmpty():
            raise StorageError("a padding bit is set")
        return cls(df, dim)

    def where(self, predicate: Column | str) -> Corpus:
        return Corpus(self.df.where(predicate), self.dim)

    def normalized(self) -> Corpus:
        return Corpus(self.df.withColumn("embedding", quant.l2_normalize(F.col("embedding"))), self.dim)

    def check_norms(self, tolerance: float = 1e-3) -> None:
        """Raises if any vector's norm isn't 1 within the tolerance."""
        bad = self.df.select("id", quant.l2_norm(F.col("embedding")).alias("norm")).where(F.abs(F.col("norm") - 1) > tolerance).orderBy("id").first()
        if bad:
            raise StorageError(f"id {bad['id']}: the vector's norm is {bad['norm']:.6g}, not 1")


class QuerySet(Vectors):
    """The vectors that are searched for; id is the query's."""

    @classmethod
    def from_dataframe(cls, df: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int | None = None, *, validate: bool = True) -> QuerySet:
        made = Corpus.from_dataframe(df, id_col, vector_col, dim, validate=validate)
        return cls(made.df, made.dim)

    @classmethod
    def from_vectors(cls, spark, vectors: list[list[float]]) -> QuerySet:
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")
        return cls(df, _dim(df, "embedding", None))
