"""Queries over the table embeddings, each with the same result in SQL.

Searches ask with every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quant
from .operators import parity, recall
from .operators.filters import IdFilter
from .operators.scan import Scorer, kernel_values, select_top_k, two_stage
from .plans.corpus import Corpus, QuerySet

Query = Callable[[SparkSession, str], DataFrame]
QUERY_EVERY, K = 50, 10
FIXED_SCALE_OVER = 127


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_dataframe(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", keep=("label",), validate=False)


def query_set(spark: SparkSession, sf_dir: str, dim: int | None = None) -> QuerySet:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(f"vec_id % {QUERY_EVERY} = 0")
    return QuerySet.from_dataframe(rows, "vec_id", "embedding", dim, validate=False)


def _scan(scorer: Scorer, filter: Callable[[SparkSession], IdFilter] | None = None, k: int = K) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        c = corpus(s, d)
        return scorer.top_k(c, query_set(s, d, c.dim), k, filter and filter(s))

    return run


def _bin_topk(s: SparkSession, d: str) -> DataFrame:
    hits = Scorer.BIN.top_k(corpus(s, d), query_set(s, d), K)
    return hits.select("qid", "id", (-F.col("score")).cast("int").alias("hamming"), "rank")


def _kernel(scorer: Scorer) -> Query:
    """An integer kernel's value for every pair of query and row."""
    return lambda s, d: kernel_values(corpus(s, d), query_set(s, d), scorer)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"), "label")


def _quant_i8(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).with_int8().df
    return c.select(F.col("id").alias("vec_id"), "scale", F.posexplode("codes").alias("dim", "code"))


def _quant_i8_fixed(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    c = c.with_int8(quant.fixed_scale(c.df, "embedding")).df
    return c.select(F.col("id").alias("vec_id"), "scale", F.posexplode("codes").alias("dim", "code"))


def _dequant_error(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d).with_int8().df.withColumn("y", quant.dequantize_i8(F.col("codes"), F.col("scale")))
    return c.select(F.col("id").alias("vec_id"), F.array_max(F.zip_with("embedding", "y", lambda a, b: F.abs(a - b))).alias("max_abs_error"))


def _pack(s: SparkSession, d: str) -> DataFrame:
    return corpus(s, d).with_bits().df.select(F.col("id").alias("vec_id"), F.posexplode("bit_bytes").alias("byte_idx", "byte"))


def _unpack(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    return c.with_bits().df.select(F.col("id").alias("vec_id"), F.posexplode(quant.unpack_sign_bits(F.col("bit_bytes"), c.dim)).alias("dim", "value"))


def _rerank(s: SparkSession, d: str) -> DataFrame:
    """Each query's pool: the rows from its own id to the next query's."""
    c, q = corpus(s, d), query_set(s, d)
    pool = c.df.select((F.col("id") - F.col("id") % QUERY_EVERY).alias("qid"), "id")
    return Scorer.I8.rerank(c, q, pool, K)


def _two_stage(coarse: Scorer, precise: Scorer, factor: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        c = corpus(s, d)
        return two_stage(c, query_set(s, d, c.dim), coarse, precise, factor * K, K)

    return run


def _prefix_property(s: SparkSession, d: str) -> DataFrame:
    c, q = corpus(s, d), query_set(s, d)
    short, long = Scorer.BIN.top_k(c, q, 5), Scorer.BIN.top_k(c, q, 20).where("rank <= 5")
    off = short.join(long, ["qid", "id", "score", "rank"], "left_anti").unionByName(long.join(short, ["qid", "id", "score", "rank"], "left_anti"))
    return off.agg(F.lit(5).alias("k1"), F.count("*").alias("mismatches"))


def _recall_matrix(s: SparkSession, d: str) -> DataFrame:
    rows = recall.recalls(corpus(s, d), query_set(s, d), recall.matrix([2, 4, 8], full=True), [1, K])
    return rows.select("config", "k", F.round("recall", 6).alias("recall"))


def _binary_parity(s: SparkSession, d: str) -> DataFrame:
    """Against a side whose dimension i is negated where (31 * id + i) % 17 = 0."""
    c = corpus(s, d)
    other = c.df.withColumn("embedding", F.transform("embedding", lambda v, i: F.when((F.col("id") * 31 + i) % 17 == 0, -v).otherwise(v)))
    found = parity.binary_parity(c.with_bits().df, Corpus(other, c.dim).with_bits().df, c.dim)
    return found.select("vectors", F.round("bit_mismatch_rate", 6).alias("bit_mismatch_rate"), F.round("identical_vector_rate", 6).alias("identical_vector_rate"), "max_row_mismatch")


def _int8_parity(s: SparkSession, d: str) -> DataFrame:
    """Against a side whose code i is moved by (id + i) % 3 - 1 within -127 to 127."""
    c = corpus(s, d).with_int8().df
    moved = F.transform("codes", lambda v, i: F.greatest(F.lit(-127), F.least(F.lit(127), v.cast("int") + (F.col("id") + i).cast("int") % 3 - 1)).cast("tinyint"))
    found = parity.int8_parity(c, c.withColumn("codes", moved))
    return found.select("vectors", *[F.round(x, 6).alias(x) for x in ("elem_exact_rate", "mean_abs_diff")], "max_abs_diff", F.round("mean_cos_sim", 6).alias("mean_cos_sim"))


def _norm_check(s: SparkSession, d: str) -> DataFrame:
    norm = quant.l2_norm(F.col("x"))
    return _vectors(s, d).agg(F.count("*").alias("rows"), F.round(F.max(F.abs(norm - 1)), 6).alias("max_deviation"))


def _random_filter(s: SparkSession, d: str) -> DataFrame:
    c = corpus(s, d)
    return Scorer.F32.top_k(c, query_set(s, d), K, IdFilter.random(c.count(), 0.3, 42))


def _given_int8(s: SparkSession, d: str) -> DataFrame:
    """A scan of codes and scales as a table of their own, asked with codes."""
    made = corpus(s, d).with_int8().df.select("id", "codes", "scale")
    return Scorer.I8.top_k(Corpus.from_int8(made), query_set(s, d), K)


def _given_bits(s: SparkSession, d: str) -> DataFrame:
    """A scan of sign bits given as offset-binary bytes."""
    c = corpus(s, d)
    made = c.with_bits().df.select("id", F.transform("bit_bytes", lambda b: (b - 128).cast("tinyint")).alias("bits"))
    hits = Scorer.BIN.top_k(Corpus.from_bits(made, c.dim, offset_binary=True), query_set(s, d), K)
    return hits.select("qid", "id", (-F.col("score")).cast("int").alias("hamming"), "rank")


def _normalized(s: SparkSession, d: str) -> DataFrame:
    """Three times each vector (zeros for ids divisible by 7), divided by its norm."""
    c = corpus(s, d)
    scaled = c.df.withColumn("embedding", F.transform("embedding", lambda v: F.when(F.col("id") % 7 == 0, F.lit(0.0)).otherwise(v * 3).cast("float")))
    return Corpus(scaled, c.dim).normalized().df.select(F.col("id").alias("vec_id"), F.posexplode("embedding").alias("dim", "value"))


def _own_score(s: SparkSession, d: str) -> DataFrame:
    """The best rows by a score of the user's own."""
    return select_top_k(_vectors(s, d), F.get("x", F.lit(0)), K, "vec_id")


def _more_ids(s: SparkSession, d: str) -> DataFrame:
    """The ids, in order, that a filter of listed ids keeps after more were set."""
    return IdFilter.from_ids(LISTED_IDS, s).with_ids((5, 9, 499), s).ordered_ids(corpus(s, d))


LISTED_IDS = (3, 9, 17, 42, 77, 101, 250, 333, 404, 499)

QUERIES: dict[str, Query] = {
    "scan_f32_topk": _scan(Scorer.F32),
    "scan_i8_topk": _scan(Scorer.I8),
    "scan_bin_topk": _bin_topk,
    "scan_f32bin_topk": _scan(Scorer.F32_BIN),
    "scan_i8bin_topk": _scan(Scorer.I8_BIN),
    "kernel_dot_i8": _kernel(Scorer.I8),
    "kernel_hamming": _kernel(Scorer.BIN),
    "kernel_dot_i8_bin": _kernel(Scorer.I8_BIN),
    "quant_i8": _quant_i8,
    "quant_i8_fixed": _quant_i8_fixed,
    "dequant_error": _dequant_error,
    "pack_sign_bits": _pack,
    "unpack_sign_bits": _unpack,
    "filtered_scan_label": _scan(Scorer.F32, lambda s: IdFilter.where("label = 3")),
    "filtered_scan_ids": _scan(Scorer.F32_BIN, lambda s: IdFilter.from_ids(LISTED_IDS, s)),
    "filtered_scan_random": _random_filter,
    "filtered_scan_empty": _scan(Scorer.F32, lambda s: IdFilter.empty()),
    "filter_more_ids": _more_ids,
    "scan_given_int8": _given_int8,
    "scan_given_bits": _given_bits,
    "select_top_k": _own_score,
    "rerank_pool": _rerank,
    "two_stage_bin_f32_x8": _two_stage(Scorer.BIN, Scorer.F32, 8),
    "two_stage_f32bin_f32_x8": _two_stage(Scorer.F32_BIN, Scorer.F32, 8),
    "two_stage_i8bin_i8_x4": _two_stage(Scorer.I8_BIN, Scorer.I8, 4),
    "topk_prefix_property": _prefix_property,
    "ground_truth": lambda s, d: recall.ground_truth(corpus(s, d), query_set(s, d), 100),
    "recall_matrix": _recall_matrix,
    "binary_parity": _binary_parity,
    "int8_parity": _int8_parity,
    "norm_check": _norm_check,
    "normalize": _normalized,
}

_BASE = """s AS (SELECT vec_id, label, embedding x, (list_max(list_transform(embedding, lambda v: abs(v))) / 127::FLOAT)::FLOAT sc FROM embeddings),
k AS (SELECT *, list_transform(x, lambda v: least(127, greatest(-127, round(v * (1::FLOAT / sc)::FLOAT)))::TINYINT) q FROM s)"""
_F32 = "list_reduce(list_transform(list_zip(a.x, b.x), lambda p: (p[1] * p[2])::FLOAT), lambda t, v: (t + v)::FLOAT)"
_DI8 = "list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1]::INT * p[2]::INT))::INT"
_HAM = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::INT"
_DI8BIN = "list_sum(list_transform(list_zip(a.q, b.x), lambda p: CASE WHEN p[2] > 0 THEN p[1]::INT ELSE -(p[1]::INT) END))::INT"
_F32BIN = "list_reduce(list_transform(list_zip(a.x, b.x), lambda p: CASE WHEN p[2] > 0 THEN p[1] ELSE -p[1] END), lambda t, v: (t + v)::FLOAT)"
_SCORE = {
    "f32": _F32,
    "i8": f"({_DI8}::FLOAT * (a.sc * b.sc)::FLOAT)::FLOAT",
    "bin": f"(-{_HAM})::FLOAT",
    "f32bin": _F32BIN,
    "i8bin": f"({_DI8BIN}::FLOAT * a.sc)::FLOAT",
}
_RANK = "CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER)"


def _pairs(score: str, where: str = "true") -> str:
    return f"SELECT a.vec_id qid, b.vec_id id, {score} score FROM k a CROSS JOIN k b WHERE a.vec_id % {QUERY_EVERY} = 0 AND {where}"


def _top(score: str, k: int = K, where: str = "true") -> str:
    return f"WITH {_BASE}, p AS ({_pairs(_SCORE[score], where)}), r AS (SELECT qid, id, score, {_RANK} rank FROM p) SELECT qid, id, score, rank FROM r WHERE rank <= {k}"


def _two(coarse: str, precise: str, factor: int) -> str:
    return f"""WITH {_BASE}, p AS ({_pairs(_SCORE[coarse])}), c AS (SELECT qid, id, {_RANK} r FROM p),
m AS (SELECT c.qid, c.id, {_SCORE[precise]} score FROM c JOIN k a ON a.vec_id = c.qid JOIN k b ON b.vec_id = c.id WHERE c.r <= {factor * K}),
r AS (SELECT qid, id, score, {_RANK} rank FROM m) SELECT qid, id, score, rank FROM r WHERE rank <= {K}"""


def _recall_sql() -> str:
    """All cells of the matrix from one table of pairs with five scores."""
    ranks = ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY {n} DESC, id) r_{n}" for n in _SCORE)
    scores = ", ".join(f"{sql} {n}" for n, sql in _SCORE.items())
    names = {"f32 (control)": "f32", "int8 sym": "i8", "bin sym": "bin", "bin asym f32q": "f32bin", "bin asym i8q": "i8bin"}
    parts = []
    for cell in recall.matrix([2, 4, 8], full=True):
        for k in (1, K):
            c = names[cell.coarse]
            if cell.store is None:
                parts.append(f"SELECT '{cell.label}' config, {k} k, count(*) hits FROM r WHERE r_f32 <= {k} AND r_{c} <= {k}")
            else:
                again = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {cell.store} DESC, id) again FROM r WHERE r_{c} <= {cell.factor * k}"
                parts.append(f"SELECT '{cell.label}' config, {k} k, count(*) hits FROM ({again}) WHERE again <= {k} AND r_f32 <= {k}")
    return f"""WITH {_BASE}, p AS (SELECT a.vec_id qid, b.vec_id id, {scores} FROM k a CROSS JOIN k b WHERE a.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, {ranks} FROM p), h AS ({" UNION ALL ".join(parts)}) SELECT config, CAST(k AS INTEGER) k, round(hits / (k * (SELECT count(*) FROM embeddings WHERE vec_id % {QUERY_EVERY} = 0))::DOUBLE, 6) recall FROM h"""


def _random_sql() -> str:
    """The generator's published steps on 64-bit integers, products by way of 128 bits."""
    m = "18446744073709551616::UHUGEINT"
    step = lambda z, shift, by: f"((xor({z}, {z} >> {shift})::UHUGEINT * {by}::UHUGEINT) % {m})::UBIGINT"
    return f"""WITH {_BASE}, z0 AS (SELECT vec_id, ((42::UHUGEINT + (vec_id + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {m})::UBIGINT z FROM k),
z1 AS (SELECT vec_id, {step("z", 30, 0xBF58476D1CE4E5B9)} z FROM z0), z2 AS (SELECT vec_id, {step("z", 27, 0x94D049BB133111EB)} z FROM z1),
f AS (SELECT vec_id FROM z2 WHERE (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992 < 0.3),
p AS ({_pairs(_F32, "b.vec_id IN (SELECT vec_id FROM f)")}), r AS (SELECT qid, id, score, {_RANK} rank FROM p) SELECT qid, id, score, rank FROM r WHERE rank <= {K}"""


_EACH = "SELECT vec_id, unnest(range(len({0}))) i, unnest({0}) v{1} FROM {2}"
ORACLE_SQL: dict[str, str] = {
    "scan_f32_topk": _top("f32"),
    "scan_i8_topk": _top("i8"),
    "scan_bin_topk": f"WITH {_BASE}, p AS ({_pairs(f'-{_HAM}')}), r AS (SELECT qid, id, score, {_RANK} rank FROM p) SELECT qid, id, CAST(-score AS INTEGER) hamming, rank FROM r WHERE rank <= {K}",
    "scan_f32bin_topk": _top("f32bin"),
    "scan_i8bin_topk": _top("i8bin"),
    "kernel_dot_i8": f"WITH {_BASE} SELECT qid, id, score AS value FROM ({_pairs(_DI8)})",
    "kernel_hamming": f"WITH {_BASE} SELECT qid, id, score AS value FROM ({_pairs(_HAM)})",
    "kernel_dot_i8_bin": f"WITH {_BASE} SELECT qid, id, score AS value FROM ({_pairs(_DI8BIN)})",
    "quant_i8": f"WITH {_BASE}, e AS ({_EACH.format('q', ', sc', 'k')}) SELECT vec_id, sc scale, CAST(i AS INTEGER) dim, v code FROM e",
    "quant_i8_fixed": f"""WITH m AS (SELECT (max(list_max(list_transform(embedding, lambda v: abs(v)))) / 127::FLOAT)::FLOAT sc FROM embeddings),
f AS (SELECT vec_id, sc, list_transform(list_transform(embedding, lambda v: v * (1::FLOAT / sc)::FLOAT), lambda y: least(127, greatest(-127, round(y)))::TINYINT) q FROM embeddings CROSS JOIN m),
e AS ({_EACH.format("q", ", sc", "f")}) SELECT vec_id, sc scale, CAST(i AS INTEGER) dim, v code FROM e""",
    "dequant_error": f"WITH {_BASE} SELECT vec_id, list_max(list_transform(list_zip(x, q), lambda p: abs((p[1] - (p[2]::FLOAT * sc)::FLOAT)::FLOAT)))::FLOAT max_abs_error FROM k",
    "pack_sign_bits": f"WITH {_BASE}, e AS ({_EACH.format('x', '', 's')}) SELECT vec_id, CAST(i // 8 AS INTEGER) byte_idx, CAST(sum(CASE WHEN v > 0 THEN 1 << (7 - i % 8) ELSE 0 END) AS INTEGER) byte FROM e GROUP BY vec_id, i // 8",
    "unpack_sign_bits": f"WITH {_BASE}, e AS ({_EACH.format('x', '', 's')}) SELECT vec_id, CAST(i AS INTEGER) dim, CAST(CASE WHEN v > 0 THEN 1 ELSE -1 END AS FLOAT) AS value FROM e",
    "filtered_scan_label": _top("f32", where="b.label = 3"),
    "filtered_scan_ids": _top("f32bin", where=f"b.vec_id IN {LISTED_IDS}"),
    "filtered_scan_random": _random_sql(),
    "filtered_scan_empty": _top("f32", where="false"),
    "filter_more_ids": f"SELECT vec_id id FROM embeddings WHERE vec_id IN {(*LISTED_IDS, 5)}",
    "scan_given_int8": _top("i8"),
    "scan_given_bits": f"WITH {_BASE}, p AS ({_pairs(f'-{_HAM}')}), r AS (SELECT qid, id, score, {_RANK} rank FROM p) SELECT qid, id, CAST(-score AS INTEGER) hamming, rank FROM r WHERE rank <= {K}",
    "select_top_k": f"SELECT vec_id id, x[1] score, CAST(row_number() OVER (ORDER BY x[1] DESC, vec_id) AS INTEGER) rank FROM (SELECT vec_id, embedding x FROM embeddings) ORDER BY score DESC, id LIMIT {K}",
    "rerank_pool": _top("i8", where=f"b.vec_id - b.vec_id % {QUERY_EVERY} = a.vec_id"),
    "two_stage_bin_f32_x8": _two("bin", "f32", 8),
    "two_stage_f32bin_f32_x8": _two("f32bin", "f32", 8),
    "two_stage_i8bin_i8_x4": _two("i8bin", "i8", 4),
    "topk_prefix_property": f"""WITH {_BASE}, p AS ({_pairs(_SCORE["bin"])}), r AS (SELECT qid, id, score, {_RANK} rank FROM p),
l AS (SELECT qid, id, score, rank FROM r WHERE rank <= 20), a AS (SELECT * FROM r WHERE rank <= 5), b AS (SELECT * FROM l WHERE rank <= 5)
SELECT 5 k1, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) mismatches""",
    "ground_truth": _top("f32", 100),
    "recall_matrix": _recall_sql(),
    "binary_parity": f"""WITH {_BASE}, e AS ({_EACH.format('x', '', 's')}), d AS (SELECT vec_id, CASE WHEN v <> 0 AND (31 * vec_id + i) % 17 = 0 THEN 1 ELSE 0 END b FROM e),
h AS (SELECT vec_id, sum(b) h, count(*) n FROM d GROUP BY vec_id)
SELECT count(*) vectors, round(sum(h)::DOUBLE / sum(n), 6) bit_mismatch_rate, round(avg(CASE WHEN h = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) identical_vector_rate, CAST(max(h) AS INTEGER) max_row_mismatch FROM h""",
    "int8_parity": f"""WITH {_BASE}, e AS ({_EACH.format('q', '', 'k')}), d AS (SELECT vec_id, v::INT a, greatest(-127, least(127, v::INT + CAST((vec_id + i) % 3 AS INT) - 1)) b FROM e),
h AS (SELECT vec_id, sum(CASE WHEN a = b THEN 1 ELSE 0 END) same, count(*) n, sum(abs(a - b)) diff, max(abs(a - b)) most, sum(a * b)::DOUBLE ab, sum(a * a)::DOUBLE aa, sum(b * b)::DOUBLE bb FROM d GROUP BY vec_id)
SELECT count(*) vectors, round(sum(same)::DOUBLE / sum(n), 6) elem_exact_rate, round(sum(diff)::DOUBLE / sum(n), 6) mean_abs_diff, CAST(max(most) AS INTEGER) max_abs_diff,
round(avg(CASE WHEN aa * bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END), 6) mean_cos_sim FROM h""",
    "normalize": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN vec_id % 7 = 0 THEN 0::FLOAT ELSE (v * 3::FLOAT)::FLOAT END) x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_reduce(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE), lambda t, v: t + v))::FLOAT norm FROM v),
e AS (SELECT vec_id, unnest(range(len(x))) i, unnest(CASE WHEN norm > 0 THEN list_transform(x, lambda v: (v::DOUBLE / norm::DOUBLE)::FLOAT) ELSE x END) v FROM n)
SELECT vec_id, CAST(i AS INTEGER) dim, v AS value FROM e""",
    "norm_check": "SELECT count(*) AS rows, round(max(abs(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) - 1)), 6) max_deviation FROM embeddings",
}
