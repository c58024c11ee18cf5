"""Exact top-k search, rerank and two-stage search.

Results are (qid, id, score, rank), ordered by score descending, then id
ascending: a total order, so any partitioning gives the same rows and a
shorter result is a prefix of a longer one. NaN ranks above all numbers.

The arrow backend sends a bounded block of queries to the tasks; each scores its
rows in numpy, tile by tile, and keeps a running top-k of all queries in a few
arrays, so a task returns at most k rows per query and nothing of size queries
times rows is ever made. Integer kernels are exact as they are: bits by XOR and
population count, codes by matrix products that floats hold exactly. Float scores
are defined by their order of summation; a matrix product with a proven bound
on its error finds the few pairs that can matter, and only those are summed in
order. Query sets beyond a block are scanned block by block.

The catalyst backend joins queries and rows as expressions and cuts by a window;
it is what the other is tested against.
"""

from __future__ import annotations

from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryDimError, UnknownIdError
from ..functions import arrays, kernels
from ..plans.corpus import Corpus, QuerySet
from .filters import IdFilter

HIT_SCHEMA = "qid long, id long, score float, rank int"
#: Bytes of queries that are sent to every task at once.
QUERY_BYTES = 64 << 20
#: Rows of a tile, and its scores; as many queries as that leaves.
TILE_ROWS, CELLS = 8192, 1 << 20
#: Largest product of norms for which the error bound of a matrix product is used.
LARGEST = 1e30


class Scorer(Enum):
    """The legal pairings of query and row representations."""

    F32 = "f32"
    I8 = "i8"
    BIN = "bin"
    F32_BIN = "f32bin"
    I8_BIN = "i8bin"

    @property
    def query_columns(self) -> list[str]:
        return {"F32": ["embedding"], "I8": ["codes", "scale"], "BIN": ["bits"], "F32_BIN": ["embedding"], "I8_BIN": ["codes", "scale"]}[self.name]

    @property
    def row_columns(self) -> list[str]:
        return {"F32": ["embedding"], "I8": ["codes", "scale"], "BIN": ["bits"], "F32_BIN": ["bits"], "I8_BIN": ["bits"]}[self.name]

    def encoded(self, vectors, side: list[str]):
        """vectors with the columns of a side, made from floats where they are missing."""
        if "codes" in side and "codes" not in vectors.df.columns:
            vectors = vectors.with_int8()
        if "bits" in side and "bits" not in vectors.df.columns:
            vectors = vectors.with_bits()
        return vectors

    def column(self, q: str = "q", row: str = "c") -> Column:
        """The score as an expression over struct columns (or table aliases) q and row."""
        a, b = (lambda c: F.col(f"{q}.{c}")), (lambda c: F.col(f"{row}.{c}"))
        if self is Scorer.F32:
            return kernels.dot_f32(a("embedding"), b("embedding"))
        if self is Scorer.I8:
            return kernels.dot_i8_scaled(a("codes"), a("scale"), b("codes"), b("scale"))
        if self is Scorer.BIN:
            return kernels.hamming_score(a("bit_bytes"), b("bit_bytes"))
        if self is Scorer.F32_BIN:
            return kernels.dot_f32_bin(a("embedding"), b("bit_bytes"))
        return kernels.dot_i8_bin(a("codes"), b("bit_bytes")).cast("float") * a("scale")

    def sides(self, q: dict[str, np.ndarray], rows: dict[str, np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
        """What the kernel compares, of queries and of rows."""
        if self is Scorer.BIN:
            return arrays.words(q["bits"]), arrays.words(rows["bits"])
        return q[self.query_columns[0]].astype(np.float32, copy=False), self.row_side(rows, dim)

    def row_side(self, rows: dict[str, np.ndarray], dim: int) -> np.ndarray:
        if self is Scorer.BIN:
            return arrays.words(rows["bits"])
        if self in (Scorer.F32_BIN, Scorer.I8_BIN):
            return arrays.signs(rows["bits"], dim)
        return rows[self.row_columns[0]].astype(np.float32, copy=False)

    def raw(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The kernel's value for all pairs of two sides; of the float kernels, each sum in order."""
        if self is Scorer.BIN:
            return arrays.hamming(q, rows)
        if self in (Scorer.F32, Scorer.F32_BIN):
            return arrays.dot_f32(q, rows)
        return arrays.dot_int(q, rows, 128 * 128 if self is Scorer.I8 else 128)

    def scaled(self, value: np.ndarray, q: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> np.ndarray:
        """Scores from the kernel's values."""
        if self is Scorer.BIN:
            return np.float32(0) - value.astype(np.float32)
        if self is Scorer.I8:
            return value.astype(np.float32, copy=False) * (q["scale"][:, None] * rows["scale"])
        return value.astype(np.float32, copy=False) * q["scale"][:, None] if self is Scorer.I8_BIN else value

    def scores(self, q: dict[str, np.ndarray], rows: dict[str, np.ndarray], dim: int) -> np.ndarray:
        """Scores of all queries against all rows."""
        with np.errstate(all="ignore"):
            return self.scaled(self.raw(*self.sides(q, rows, dim)), q, rows)

    def top_k(self, corpus: Corpus, queries: QuerySet, k: int, filter: IdFilter | None = None, *, backend: str | None = None, strict_order: bool = False) -> DataFrame:
        """The k best rows for each query."""
        if corpus.dim != queries.dim:
            raise QueryDimError(queries.dim, corpus.dim)
        if filter is not None:
            corpus = filter.apply(corpus)
        if _backend(backend) == "catalyst":
            corpus, queries = self.encoded(corpus, self.row_columns), self.encoded(queries, self.query_columns)
            return ranked(self._pairs(corpus, queries), k, strict_order)
        return ranked(scan(corpus, queries, {self: k}, strict_order).drop("scorer"), k, strict_order)

    def rerank(self, corpus: Corpus, queries: QuerySet, pool: DataFrame, k: int, *, strict: bool = False, strict_order: bool = False) -> DataFrame:
        """The k best of each query's pool (qid, id), by this scorer's own scores.

        Ids that the corpus lacks are left out and repeated ones count once; strict makes both an error.
        """
        if corpus.dim != queries.dim:
            raise QueryDimError(queries.dim, corpus.dim)
        pairs = pool.select("qid", "id")
        if strict and pairs.groupBy("qid", "id").count().where("count > 1").limit(1).count():
            raise UnknownIdError("a pool names an id twice")
        if strict and not pairs.join(corpus.df.select("id"), "id", "left_anti").isEmpty():
            raise UnknownIdError("a pool names an id that the corpus lacks")
        if not strict:
            pairs = pairs.distinct()
        return ranked(self.pool_scores(corpus, queries, pairs), k, strict_order)

    def pool_scores(self, corpus: Corpus, queries: QuerySet, pool: DataFrame) -> DataFrame:
        """pool (qid, id and others) with the score of each of its rows.

        What a stored corpus lacks is encoded after the join, for the pool's rows only.
        """
        need = _stored(corpus, self.row_columns)
        rows = pool.join(corpus.df.select("id", *need), "id")
        rows = self.encoded(Corpus(rows, corpus.dim), self.row_columns).df
        c, q = self._structs(Corpus(rows, corpus.dim), self.encoded(queries, self.query_columns), pool.columns)
        return c.join(q, "qid").select(*pool.columns, self.column().alias("score"))

    def _structs(self, corpus: Corpus, queries: QuerySet, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows with `keep` (id) and a struct c, queries with qid and a struct q."""

        def side(names: list[str]):
            return F.struct(*("bit_bytes" if n == "bits" else n for n in names))

        return corpus.df.select(*(keep or ["id"]), side(self.row_columns).alias("c")), queries.df.select(F.col("id").alias("qid"), side(self.query_columns).alias("q"))

    def _pairs(self, corpus: Corpus, queries: QuerySet) -> DataFrame:
        c, q = self._structs(corpus, queries)
        return c.crossJoin(q).select("qid", "id", self.column().alias("score"))


def _backend(name: str | None) -> str:
    if name is not None and kernels.by_name(name) is None:
        raise ValueError(f"backend must be one of {kernels.NAMES}, not {name!r}")
    return name or kernels.detected()


def _columns(scorers: list[Scorer], side: str) -> list[str]:
    return list(dict.fromkeys(c for s in scorers for c in getattr(s, side)))


def _blocks(queries: QuerySet, columns: list[str], query_bytes: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Ids and sides of the queries, a bounded block at a time."""
    most = max(1, query_bytes // (queries.dim * 4))
    df = queries.df.select("id", *_stored(queries, columns, arrow=True))
    first = df.limit(most + 1).toArrow()
    if first.num_rows <= most:
        tables = iter([first])
    else:
        n = -(-df.count() * 5 // (most * 4))  # hashed blocks differ a little in size
        block = F.pmod(F.xxhash64("id"), F.lit(n))
        tables = (df.where(block == i).toArrow() for i in range(n))
    for table in tables:
        if table.num_rows:
            table = table.combine_chunks()
            yield np.array(table.column("id").to_pylist(), np.int64), _sides(table, columns, queries.dim)


def scan(corpus: Corpus, queries: QuerySet, wanted: dict[Scorer, int], strict: bool = False, *, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """scorer, qid, id, score: of each task's rows the best k by each scorer for each query.

    All scorers share one read of the rows; ranked() of a scorer's rows gives its result.
    """
    spark, dim, scorers = corpus.df.sparkSession, corpus.dim, [s for s, k in wanted.items() if k > 0]
    schema = "scorer string, qid long, id long, score float"
    rows, found = corpus.df.select("id", *_stored(corpus, _columns(scorers, "row_columns"), arrow=True)), None
    if not scorers:
        return spark.createDataFrame([], schema)
    for block in _blocks(queries, _columns(scorers, "query_columns"), query_bytes):
        part = rows.mapInArrow(_scan_task(spark.sparkContext.broadcast(block), scorers, wanted, dim, strict), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _scan_task(given, scorers: list[Scorer], wanted: dict[Scorer, int], dim: int, strict: bool):
    names = _columns(scorers, "row_columns")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = given.value
        best = {s: Best(len(qids), wanted[s], strict) for s in scorers}
        asked = {s: _Asked(s, q) for s in scorers}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = _sides(batch, names, dim)
            for lo in range(0, len(ids), TILE_ROWS):
                part = {c: v[lo : lo + TILE_ROWS] for c, v in rows.items()}
                for s in scorers:
                    _tiles(s, asked[s], part, ids[lo : lo + TILE_ROWS], dim, best[s])
        for s in scorers:
            at, ids, scores = best[s].hits()
            for lo in range(0, len(at), CELLS):
                part = slice(lo, lo + CELLS)
                yield pa.RecordBatch.from_arrays([pa.array([s.value] * len(at[part]), pa.string()), pa.array(qids[at[part]], pa.int64()), pa.array(ids[part], pa.int64()), pa.array(scores[part], pa.float32(), from_pandas=False)], names=["scorer", "qid", "id", "score"])

    return task


class _Asked:
    """A scorer's side of the queries, with what bounds the error of their products."""

    def __init__(self, scorer: Scorer, q: dict[str, np.ndarray]):
        self.q = q
        self.side = arrays.words(q["bits"]) if scorer is Scorer.BIN else q[scorer.query_columns[0]].astype(np.float32, copy=False)
        self.size = None
        if scorer in (Scorer.F32, Scorer.F32_BIN):
            with np.errstate(all="ignore"):
                x = self.side.astype(np.float64)
                self.size = np.abs(x).sum(axis=1) if scorer is Scorer.F32_BIN else np.sqrt((x * x).sum(axis=1))


def _slack(asked: _Asked, part: slice, rows: np.ndarray, largest: float) -> np.ndarray | None:
    """How far apart two ways of summing a dot of n floats can be, per query; null where that isn't bounded.

    Either is within g * sum |x * y| of the true value, g = n * u / (1 - n * u), u = 2**-24;
    the sum is at most the product of the norms. What is added covers the roundings of the bound itself.
    """
    n, u = rows.shape[1] + 4, 2.0**-24
    most = asked.size[part] * largest
    if n * u > 0.01 or not (most < LARGEST).all():
        return None
    return 2.1 * n * u / (1 - n * u) * most + 1e-30


def _tiles(scorer: Scorer, asked: _Asked, rows: dict[str, np.ndarray], ids: np.ndarray, dim: int, best: Best) -> None:
    """Adds the hits of some rows to the best, a tile of queries at a time."""
    side, largest = scorer.row_side(rows, dim), 0.0
    with np.errstate(all="ignore"):
        if scorer is Scorer.F32 and len(ids):
            largest = 1.01 * float(np.sqrt(np.einsum("ij,ij->i", side, side).max()))  # the sum itself is off by less than that
        elif scorer is Scorer.F32_BIN:
            largest = 1.0
        tile = CELLS // max(1, len(ids))
        for first in range(0, len(asked.side), tile):
            part = slice(first, first + tile)
            q, slack = asked.side[part], None
            if asked.size is not None and (slack := _slack(asked, part, side, largest)) is not None:
                found = q @ side.T
            else:
                found = scorer.scaled(scorer.raw(q, side), {c: v[part] for c, v in asked.q.items()}, rows)
            qi, ri = best.near(found, part, slack)
            if len(qi):
                scores = found[qi, ri] if slack is None else arrays.dot_f32_pairs(q, side, qi, ri)
                best.add(qi + first, ids[ri], scores)


class Best:
    """The best k hits of each of n queries so far."""

    def __init__(self, n: int, k: int, strict: bool):
        self.k, self.strict = k, strict
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.floor = np.full(n, -np.inf)  # what a hit must reach
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, max(4096, n * k // 2)

    def near(self, found: np.ndarray, part: slice, slack: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of a tile (queries by rows) that may be among the best; found is off by slack at most."""
        off = np.zeros(len(found)) if slack is None else slack
        least = self.floor[part] - off
        hit = ~(found < least.astype(np.float32)[:, None])  # NaN is a hit
        if found.shape[1] > self.k and np.count_nonzero(hit) > 2 * self.k * len(found):
            kth = np.partition(found, found.shape[1] - self.k, axis=1)[:, found.shape[1] - self.k].astype(np.float64)
            least = np.fmax(least, np.where(np.isnan(kth), np.inf, kth) - 2 * off)
            hit = ~(found < least.astype(np.float32)[:, None])
        return np.nonzero(hit)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = ~(scores < self.floor[at])
        self.waiting.append((at[keep], ids[keep], scores[keep]))
        self.held += int(keep.sum())
        if self.held >= self.most:
            self.merge()

    def merge(self) -> None:
        """Cuts to k hits per query, in order; strict puts -0.0 after +0.0."""
        parts = [(self.at, self.ids, self.scores), *self.waiting]
        at, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        nan = np.isnan(scores)
        order = np.lexsort((ids, self.strict & (scores == 0) & np.signbit(scores), -np.where(nan, np.float32(np.inf), scores), ~nan, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order = order[place < self.k]
        last = at[place == self.k - 1], scores[order][place[place < self.k] == self.k - 1].astype(np.float64)
        self.at, self.ids, self.scores = at[place < self.k], ids[order], scores[order]
        self.floor[last[0]] = np.where(np.isnan(last[1]), np.inf, last[1])
        self.waiting, self.held = [], 0

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        return self.at, self.ids, self.scores


def kernel_values(corpus: Corpus, queries: QuerySet, scorer: Scorer, *, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """qid, id, value (int): an integer kernel of every query and row, a block of queries at a time."""
    spark, dim, found = corpus.df.sparkSession, corpus.dim, None
    rows = corpus.df.select("id", *_stored(corpus, scorer.row_columns, arrow=True))

    def task(given):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = given.value
            asked, step = _Asked(scorer, q).side, max(1, CELLS // len(qids))
            for batch in batches:
                ids, sides = batch.column(0).to_numpy(zero_copy_only=False), _sides(batch, scorer.row_columns, dim)
                for lo in range(0, len(ids), step):
                    value = scorer.raw(asked, scorer.row_side({c: v[lo : lo + step] for c, v in sides.items()}, dim))
                    n = value.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.tile(ids[lo : lo + n], len(qids))), pa.array(value.reshape(-1).astype(np.int32))], names=["qid", "id", "value"])

        return run

    for block in _blocks(queries, scorer.query_columns, query_bytes):
        part = rows.mapInArrow(task(spark.sparkContext.broadcast(block)), "qid long, id long, value int")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "qid long, id long, value int") if found is None else found


def _stored(vectors, wanted: list[str], arrow: bool = False) -> list[str]:
    """The columns to read for a side: those wanted, or the floats that they are made from."""
    names = []
    for c in wanted:
        stored = [c, *(["bit_bytes"] if c == "bits" and not arrow else [])]
        made = c in vectors.df.columns and not (c == "scale" and "codes" not in vectors.df.columns)
        names += stored if made else ["embedding"]
    return list(dict.fromkeys(names))


def _sides(batch: pa.RecordBatch | pa.Table, wanted: list[str], dim: int) -> dict[str, np.ndarray]:
    """The wanted representations of a batch in numpy, made from its floats where they aren't stored."""

    def column(name: str) -> pa.Array:
        found = batch.column(name)
        return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found

    names, out = batch.schema.names, {}
    x = arrays.matrix(column("embedding"), np.float32, dim) if "embedding" in names else None
    for c in wanted:
        if c == "embedding":
            out[c] = x
        elif c == "scale":
            out[c] = column(c).to_numpy(zero_copy_only=False).astype(np.float32, copy=False) if c in names else arrays.max_abs_scale(x)
        elif c == "bits":
            out[c] = arrays.bit_rows(column(c), kernels.binary_code_len(dim)) if c in names else arrays.pack_sign_bits(x)
        else:
            out[c] = arrays.matrix(column(c), np.int8, dim) if c in names else arrays.quantize_i8(x, arrays.max_abs_scale(x))
    return out


def ranked(scored: DataFrame, k: int, strict_order: bool = False) -> DataFrame:
    """The best k of (qid, id, score) for each query, with their rank from 1."""
    keys = [F.desc("score"), *([(F.col("score").cast("string") == "-0.0").asc()] if strict_order else []), F.asc("id")]
    order = Window.partitionBy("qid").orderBy(*keys)
    return scored.select("qid", "id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def select_top_k(df: DataFrame, score: Column, k: int, id_col: str = "id") -> DataFrame:
    """id, score and rank of the k best rows by any score."""
    best = df.select(df[id_col].alias("id"), score.cast("float").alias("score")).orderBy(F.desc("score"), "id").limit(max(k, 0))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows at most


def two_stage(corpus: Corpus, queries: QuerySet, coarse: Scorer, precise: Scorer, pool: int, k: int, filter: IdFilter | None = None, **options) -> DataFrame:
    """The k best by `precise` of the `pool` best by `coarse`; the filter acts in the first stage."""
    found = coarse.top_k(corpus, queries, pool, filter, **options)
    return precise.rerank(corpus, queries, found, k)
