"""Recall of quantized searches against the exact one, over a matrix of configurations."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ScanError
from ..plans.corpus import Corpus, QuerySet
from .filters import IdFilter
from .scan import Scorer, ranked, scan

# Labels of the configurations.
COARSE = {"f32 (control)": Scorer.F32, "int8 sym": Scorer.I8, "bin sym": Scorer.BIN, "bin asym f32q": Scorer.F32_BIN, "bin asym i8q": Scorer.I8_BIN}
STORES = {"i8": Scorer.I8, "f32": Scorer.F32}
ROW_SCHEMA = "filter_s double, config string, coarse string, rerank string, factor int, k int, r int, recall double, us_per_query double, n long, dim int, queries long, seed long, backend string"


@dataclass(frozen=True)
class Cell:
    """One configuration: a scan, or a scan for factor * k candidates and a rerank."""

    coarse: str
    store: str | None = None
    factor: int | None = None

    @property
    def label(self) -> str:
        return self.coarse if self.store is None else f"{self.coarse:<13} -> {self.store:<3} x{self.factor}"


def matrix(factors: list[int], full: bool = False) -> list[Cell]:
    """Every scan, then the binary ones with a rerank; `full` adds int8 with a float rerank."""
    cells = [Cell(c) for c in COARSE]
    cells += [Cell(c, s, f) for c in ("bin sym", "bin asym f32q", "bin asym i8q") for s in STORES for f in factors]
    return cells + [Cell("int8 sym", "f32", f) for f in factors if full]


def ground_truth(corpus: Corpus, queries: QuerySet, kmax: int, filter: IdFilter | None = None, **options) -> DataFrame:
    """The exact top kmax of each query under the same filter."""
    return Scorer.F32.top_k(corpus, queries, kmax, filter, **options)


def gt_prefixes(truth: DataFrame, ks: list[int]) -> DataFrame:
    """k, qid, id: the first k hits of each query, for each k."""
    return truth.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "qid", "id", "rank").where("rank <= k").drop("rank")


def recall_at_k(result: DataFrame, truth: DataFrame, queries: QuerySet, ks: list[int]) -> DataFrame:
    """k, qid, recall: the share of the true first k that the result's first k hold.

    The share is of as many as there are; a query without any true hit has recall 1.
    """
    want = gt_prefixes(truth, ks)
    hits = want.join(gt_prefixes(result, ks), ["k", "qid", "id"], "left_semi").groupBy("k", "qid").agg(F.count("*").alias("hits"))
    of = want.groupBy("k", "qid").agg(F.count("*").alias("of"))
    each = queries.df.select(F.col("id").alias("qid"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    share = F.when(F.coalesce("of", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.coalesce("hits", F.lit(0)) / F.col("of"))
    return each.join(of, ["k", "qid"], "left").join(hits, ["k", "qid"], "left").select("k", "qid", share.alias("recall"))


def mean_recalls(result: DataFrame, truth: DataFrame, queries: QuerySet, ks: list[int]) -> DataFrame:
    """k and mean recall over all queries."""
    return recall_at_k(result, truth, queries, ks).groupBy("k").agg(F.avg("recall").alias("recall"))


def _pools(factors: list[int], ks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(k).alias("k")) for f in factors for k in ks])


def _reranked(ranked: DataFrame, corpus: Corpus, queries: QuerySet, store: str, factors: list[int], ks: list[int]) -> DataFrame:
    """factor, k, qid, id: the k best of each pool of factor * k, all pools in one pass.

    Every pool is a prefix of the coarse result, so each of its rows is scored
    once and then ranked in the pools that hold it.
    """
    deep = max(factors) * max(ks)
    pool = ranked.where(F.col("rank") <= deep).select("qid", "id", F.col("rank").alias("at"))
    scored = STORES[store].pool_scores(corpus, queries, pool)
    each = scored.withColumn("p", F.explode(_pools(factors, ks))).where(F.col("at") <= F.col("p.factor") * F.col("p.k")).select("p.factor", "p.k", "qid", "id", "score")
    order = Window.partitionBy("factor", "k", "qid").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where("rank <= k").select("factor", "k", "qid", "id")


def _hits(ranked: DataFrame, corpus: Corpus, queries: QuerySet, cells: list[Cell], ks: list[int]) -> list[DataFrame]:
    """config, k, qid, id of what cells of one coarse scan return, a table per kind of cell."""
    out = [gt_prefixes(ranked, ks).select(F.lit(c.label).alias("config"), "k", "qid", "id") for c in cells if c.store is None]
    for store in STORES:
        by_factor = {c.factor: c.label for c in cells if c.store == store}
        if by_factor:
            label = F.create_map(*[F.lit(x) for pair in by_factor.items() for x in pair])[F.col("factor")]
            out.append(_reranked(ranked, corpus, queries, store, list(by_factor), ks).select(label.alias("config"), "k", "qid", "id"))
    return out


def _means(found: list[DataFrame], configs: list[str], truth: DataFrame, queries: QuerySet, ks: list[int]) -> DataFrame:
    """config, k and recall over all queries, for the hits of many configurations at once."""
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    want = gt_prefixes(truth, ks)
    hits = every.join(want, ["k", "qid", "id"], "left_semi").groupBy("config", "k", "qid").agg(F.count("*").alias("hits"))
    of = want.groupBy("k", "qid").agg(F.count("*").alias("of"))
    cells = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(k).alias("k")) for c in configs for k in ks])
    each = queries.df.select(F.col("id").alias("qid"), F.explode(cells).alias("p")).select("qid", "p.config", "p.k")
    share = F.when(F.coalesce("of", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.coalesce("hits", F.lit(0)) / F.col("of"))
    return each.join(of, ["k", "qid"], "left").join(hits, ["config", "k", "qid"], "left").groupBy("config", "k").agg(F.avg(share).alias("recall"))


def recalls(corpus: Corpus, queries: QuerySet, cells: list[Cell], ks: list[int], truth: DataFrame | None = None, filter: IdFilter | None = None) -> DataFrame:
    """config, k and recall of all cells.

    All coarse scans share one read of the rows, each at the largest depth that its
    cells need: shorter results and pools are its prefixes, and so is the exact
    result if no truth is given. The coarse hits are cached while this runs; what is
    returned is one row per cell and k.
    """
    if queries.is_empty():
        raise ScanError("there is no query to measure recall with")
    kmax, named = max(ks), {s.value: c for c, s in COARSE.items()}
    deep = {COARSE[c.coarse]: 0 for c in cells} | ({Scorer.F32: 0} if truth is None else {})
    for c in cells:
        deep[COARSE[c.coarse]] = max(deep[COARSE[c.coarse]], (c.factor or 1) * kmax)
    deep = {s: max(k, kmax) for s, k in deep.items()}
    found = scan(filter.apply(corpus) if filter else corpus, queries, deep).persist()
    try:
        best, out = {s: ranked(found.where(F.col("scorer") == s.value), k) for s, k in deep.items()}, []
        for s in deep:
            if mine := [c for c in cells if c.coarse == named[s.value]]:
                out += _hits(best[s], corpus, queries, mine, ks)
        means = _means(out, [c.label for c in cells], best[Scorer.F32] if truth is None else truth, queries, ks)
        rows = [tuple(r) for r in means.select("config", "k", "recall").collect()]
    finally:
        found.unpersist()
    return corpus.df.sparkSession.createDataFrame(rows, "config string, k int, recall double")


def run_matrix(corpus: Corpus, queries: QuerySet, cells: list[Cell], ks: list[int], truth: DataFrame, filter: IdFilter | None = None, *, filter_s: float = 1.0, seed: int = 0, backend: str | None = None) -> list[tuple]:
    """Rows of ROW_SCHEMA, timed: scans first, then reranks by their coarse scan.

    us_per_query of a rerank includes the shared scan at the largest depth.
    """
    from ..functions import kernels

    n, q, kmax = corpus.count(), queries.count(), max(ks)
    if not q:
        raise ScanError("there is no query to measure recall with")
    named = backend or kernels.detected()
    rows: list[tuple] = []

    def add(cell: Cell, k: int, recall: float, seconds: float) -> None:
        rows.append((filter_s, cell.label, cell.coarse, cell.store, cell.factor, k, cell.factor * k if cell.factor else None, recall, seconds * 1e6 / q, n, corpus.dim, q, seed, named))

    for cell in [c for c in cells if c.store is None]:
        began = time.perf_counter()
        ranked = COARSE[cell.coarse].top_k(corpus, queries, kmax, filter, backend=backend).persist()
        ranked.count()
        took = time.perf_counter() - began
        for r in sorted(mean_recalls(ranked, truth, queries, ks).collect()):
            add(cell, r["k"], r["recall"], took)
        ranked.unpersist()
    for coarse in ("int8 sym", "bin sym", "bin asym f32q", "bin asym i8q"):
        mine = [c for c in cells if c.coarse == coarse and c.store]
        if not mine:
            continue
        began = time.perf_counter()
        ranked = COARSE[coarse].top_k(corpus, queries, max(c.factor for c in mine) * kmax, filter, backend=backend).persist()
        ranked.count()
        shared = time.perf_counter() - began
        for cell in mine:
            began = time.perf_counter()
            means = _means(_hits(ranked, corpus, queries, [cell], ks), [cell.label], truth, queries, ks)
            found = sorted((r["k"], r["recall"]) for r in means.collect())
            took = shared + time.perf_counter() - began
            for k, recall in found:
                add(cell, k, recall, took)
        ranked.unpersist()
    return rows
