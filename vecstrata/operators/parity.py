"""How far two quantizations of the same vectors agree, as one-row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RaggedError
from ..functions import kernels
from ..functions.quant import offset_binary_to_bits

__all__ = ["binary_parity", "int8_parity", "offset_binary_to_bits"]


def _paired(client: DataFrame, provider: DataFrame, column: str) -> DataFrame:
    """Rows of both tables by id, as a and b; a row that only one side has is an error."""
    a, b = client.select("id", F.col(column).alias("a")), provider.select("id", F.col(column).alias("b"))
    both = a.join(b, "id", "full")
    one = both.where("a is null or b is null or size(a) <> size(b)").select(F.size("a").alias("a"), F.size("b").alias("b")).first()
    if one:
        raise RaggedError(one["b"], one["a"])
    return both


def binary_parity(client: DataFrame, provider: DataFrame, dim: int, column: str = "bit_bytes") -> DataFrame:
    """vectors, bit_mismatch_rate, identical_vector_rate and max_row_mismatch of two tables (id, bit bytes)."""
    h = _paired(client, provider, column).select(kernels.hamming(F.col("a"), F.col("b")).alias("h"))
    n = F.count("*")
    return h.agg(
        n.alias("vectors"),
        F.coalesce(F.sum("h") / F.nullif(n * dim, F.lit(0)), F.lit(0.0)).alias("bit_mismatch_rate"),
        F.coalesce(F.avg((F.col("h") == 0).cast("double")), F.lit(1.0)).alias("identical_vector_rate"),
        F.coalesce(F.max("h"), F.lit(0)).alias("max_row_mismatch"),
    )


def int8_parity(client: DataFrame, provider: DataFrame, column: str = "codes") -> DataFrame:
    """vectors, elem_exact_rate, mean_abs_diff, max_abs_diff and mean_cos_sim of two tables (id, codes).

    A row of zeros has cosine 0; an empty table counts as equal.
    """
    rows = _paired(client, provider, column)

    def total(f) -> Column:
        return F.aggregate(F.zip_with("a", "b", f), F.lit(0).cast("long"), lambda t, v: t + v)

    i = lambda x: x.cast("int")
    diff = F.zip_with("a", "b", lambda x, y: F.abs(i(x) - i(y)))
    per = rows.select(
        F.size("a").alias("n"), total(lambda x, y: F.when(x == y, 1).otherwise(0)).alias("same"), F.coalesce(F.array_max(diff), F.lit(0)).alias("most"),
        total(lambda x, y: F.abs(i(x) - i(y))).alias("diff"), total(lambda x, y: i(x) * i(y)).alias("ab"), total(lambda x, y: i(x) * i(x)).alias("aa"), total(lambda x, y: i(y) * i(y)).alias("bb"),
    )
    norms = F.sqrt(F.col("aa").cast("double")) * F.sqrt(F.col("bb").cast("double"))
    per = per.withColumn("cos", F.when(norms > 0, F.col("ab") / F.nullif(norms, F.lit(0.0))).otherwise(F.lit(0.0)))
    cells = F.nullif(F.sum("n"), F.lit(0))
    return per.agg(
        F.count("*").alias("vectors"), F.coalesce(F.sum("same") / cells, F.lit(1.0)).alias("elem_exact_rate"), F.coalesce(F.sum("diff") / cells, F.lit(0.0)).alias("mean_abs_diff"),
        F.coalesce(F.max("most"), F.lit(0)).alias("max_abs_diff"), F.coalesce(F.avg("cos"), F.lit(1.0)).alias("mean_cos_sim"),
    )
