"""Scans, filters, rerank and their order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata.errors import FilterLengthError, QueryDimError, RaggedError, ScaleCountError, StorageError, StrideError, UnknownIdError, ZeroDimError
from vecstrata.functions import arrays
from vecstrata.operators import scan
from vecstrata.operators.filters import IdFilter
from vecstrata.operators.scan import Scorer, select_top_k, two_stage
from vecstrata.plans.corpus import Corpus, QuerySet

BACKENDS = ["arrow", "catalyst"]


def make(spark, x, cls=Corpus, parts=3):
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(parts)
    return cls.from_dataframe(df)


def hits(df):
    return [tuple(r) for r in df.select("qid", "id", "score", "rank").orderBy("qid", "rank").collect()]


def brute(scores, k):
    out = []
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        out += [(q, i, float(row[i]), r + 1) for r, i in enumerate(order)]
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(54)
    x, q = r.uniform(-1, 1, (200, 61)).astype(np.float32), r.uniform(-1, 1, (5, 61)).astype(np.float32)
    return x, q, make(spark, x), make(spark, q, QuerySet)


@pytest.mark.parametrize("scorer", list(Scorer))
@pytest.mark.parametrize("backend", BACKENDS)
def test_every_scorer(data, scorer, backend):
    x, q, corpus, queries = data

    def sides(v):
        s = arrays.max_abs_scale(v)
        return {"embedding": v, "scale": s, "codes": arrays.quantize_i8(v, s), "bits": arrays.pack_sign_bits(v)}

    want = brute(scorer.scores(sides(q), sides(x), 61), 12)
    assert hits(scorer.top_k(corpus, queries, 12, backend=backend)) == want
    assert hits(scorer.top_k(corpus.prepared(), queries.prepared(), 12, backend=backend)) == want
    pool = corpus.df.crossJoin(queries.df.select(F.col("id").alias("qid"))).select("qid", "id")
    assert hits(scorer.rerank(corpus, queries, pool, 12)) == want


@pytest.mark.parametrize("backend", BACKENDS)
def test_ties_prefixes_and_partitions(spark, backend):
    r = np.random.default_rng(52)
    x = r.choice([-1.0, 1.0], (300, 6))
    queries = make(spark, [[1, 1, 1, 1, 1, -1]], QuerySet)
    long = hits(Scorer.BIN.top_k(make(spark, x, parts=1), queries, 300, backend=backend))
    for k, parts in ((1, 1), (5, 7), (37, 4), (300, 2)):
        assert hits(Scorer.BIN.top_k(make(spark, x, parts=parts), queries, k, backend=backend)) == long[:k]
    assert [h[1] for h in hits(Scorer.F32.top_k(make(spark, [[1.0]] * 100), make(spark, [[1.0]], QuerySet), 5, backend=backend))] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("backend", BACKENDS)
def test_edges(spark, data, backend):
    _, _, corpus, queries = data
    assert hits(Scorer.F32.top_k(corpus, queries, 0, backend=backend)) == []
    assert len(hits(Scorer.F32.top_k(corpus, queries, 10_000, backend=backend))) == 5 * 200
    assert hits(Scorer.F32.top_k(corpus, queries, 5, IdFilter.empty(), backend=backend)) == []
    assert hits(Scorer.F32.top_k(Corpus(corpus.df.where("false"), 61), queries, 5, backend=backend)) == []


@pytest.mark.parametrize("backend", BACKENDS)
def test_nan_and_signed_zero(spark, backend):
    nan = float("nan")
    found = hits(Scorer.F32.top_k(make(spark, [[1.0], [nan], [2.0], [nan]]), make(spark, [[1.0]], QuerySet), 3, backend=backend))
    assert [h[1] for h in found] == [1, 3, 2]
    # a sum starts at +0.0, so a score of -0.0 only comes from scaled or foreign scores
    df = spark.createDataFrame([(0, 0, -0.0), (0, 1, 0.0), (0, 2, -1.0)], "qid long, id long, score float")
    from vecstrata.operators.scan import ranked

    assert [h[1] for h in hits(ranked(df, 2, strict_order=True))] == [1, 0]
    assert [h[1] for h in hits(ranked(df, 2))] == [0, 1]


def test_bin_perfect_match_is_positive_zero(spark):
    for backend in BACKENDS:
        score = hits(Scorer.BIN.top_k(make(spark, [[1, -1]]), make(spark, [[1, -1]], QuerySet), 1, backend=backend))[0][2]
        assert score == 0 and not np.signbit(score)


@pytest.mark.parametrize("backend", BACKENDS)
def test_filters(spark, data, backend):
    x, q, corpus, queries = data
    ids = [int(i) for i in np.flatnonzero(np.random.default_rng(99).random(200) < 0.25)]
    scores = arrays.dot_f32(q, x)
    want = [(a, i, s, r) for a in range(5) for r, (i, s) in enumerate(sorted(((i, float(scores[a, i])) for i in ids), key=lambda t: (-t[1], t[0]))[:20], 1)]
    assert hits(Scorer.F32.top_k(corpus, queries, 20, IdFilter.from_ids(ids + ids, spark, universe=200), backend=backend)) == want
    grown = IdFilter.from_ids(ids[1:], spark, universe=200).with_ids(ids[:2], spark)
    assert hits(Scorer.F32.top_k(corpus, queries, 20, grown, backend=backend)) == want
    assert hits(Scorer.F32.top_k(corpus, queries, 20, IdFilter.where(F.col("id").isin(ids)), backend=backend)) == want


def test_random_filter(spark):
    corpus = Corpus(spark.range(100_000).select("id"), 1)
    a, b, c = (IdFilter.random(100_000, 0.1, s) for s in (42, 42, 43))
    assert abs(a.count(corpus) / 100_000 - 0.1) < 0.01
    rows = [sorted(r["id"] for r in f.apply(corpus).df.collect()) for f in (a, b, c)]
    assert rows[0] == rows[1] != rows[2]
    scattered = Corpus(corpus.df.where("id % 997 = 0").repartition(3), 1)
    assert sorted(r["id"] for r in IdFilter(a.predicate).apply(scattered).df.collect()) == [i for i in rows[0] if i % 997 == 0]
    assert [r["id"] for r in a.ordered_ids(corpus).take(3)] == rows[0][:3] and a.contains(corpus, rows[0][0])


def test_rerank_stays_in_the_pool(spark, data):
    x, q, corpus, queries = data
    pool = spark.createDataFrame([(0, i) for i in (3, 9, 17, 42, 77, 77, 9999)], "qid long, id long")
    scores = arrays.dot_f32(q[:1], x)[0]
    best = sorted((3, 9, 17, 42, 77), key=lambda i: (-scores[i], i))[:3]
    assert [h[1] for h in hits(Scorer.F32.rerank(corpus, queries, pool, 3))] == best
    with pytest.raises(UnknownIdError):
        Scorer.F32.rerank(corpus, queries, pool, 3, strict=True)
    with pytest.raises(UnknownIdError):
        Scorer.F32.rerank(corpus, queries, pool.distinct(), 3, strict=True)


def test_two_stage(spark, data):
    x, q, corpus, queries = data
    keep = IdFilter.where("id % 3 <> 0")
    found = hits(two_stage(corpus, queries, Scorer.F32_BIN, Scorer.F32, 40, 10, keep))
    pools = {(h[0], h[1]) for h in hits(Scorer.F32_BIN.top_k(corpus, queries, 40, keep))}
    assert len(found) == 50 and {(h[0], h[1]) for h in found} <= pools and all(h[1] % 3 for h in found)
    exact = {(h[0], h[1]): h[2] for h in hits(Scorer.F32.top_k(corpus, queries, 200))}
    assert all(exact[h[0], h[1]] == h[2] for h in found)
    small = make(spark, [[1, 0], [-0.6, 0.8], [0.6, 0.8]])
    assert hits(two_stage(small, make(spark, [[0.6, -0.8]], QuerySet), Scorer.F32_BIN, Scorer.F32, 2, 1))[0][1] == 0
    quick = make(spark, [[1, 0, 0, 0], [0, 1, 0, 0], [0.707, 0.707, 0, 0], [0, 0, 0.707, 0.707]])
    assert hits(two_stage(quick, make(spark, [[0.9, 0.1, -0.1, -0.1]], QuerySet), Scorer.F32_BIN, Scorer.F32, 3, 1))[0][1] == 0


@pytest.mark.parametrize("dim", [3, 64, 130])
def test_products_are_corrected_to_sums_in_order(dim):
    """Float hits found by a matrix product are those of sums in order, bit by bit, with ties, NaN, infinities and large values."""
    r = np.random.default_rng(dim)
    x, q = r.normal(size=(3000, dim)).astype(np.float32), r.normal(size=(7, dim)).astype(np.float32)
    x[100:300] = x[:200]  # ties
    for case in range(4):
        if case == 1:
            x[5, 0], x[17, 1], q[2, 0] = np.nan, np.inf, np.inf
        elif case == 2:
            x, q = np.nan_to_num(x) * np.float32(1e19), np.nan_to_num(q) * np.float32(1e19)
        elif case == 3:
            x, q = r.choice([-1.0, 1.0], x.shape).astype(np.float32), r.choice([-1.0, 1.0], q.shape).astype(np.float32)
        with np.errstate(all="ignore"):
            s = arrays.max_abs_scale(x), arrays.max_abs_scale(q)
            rows, asked = ({"embedding": v, "scale": t, "codes": arrays.quantize_i8(v, t), "bits": arrays.pack_sign_bits(v)} for v, t in zip((x, q), s, strict=True))
        for scorer in Scorer:
            full = scorer.scores(asked, rows, dim)
            best, side = scan.Best(len(q), 9, False), scan._Asked(scorer, asked)
            for lo in range(0, 3000, 700):
                scan._tiles(scorer, side, {c: v[lo : lo + 700] for c, v in rows.items()}, np.arange(lo, min(3000, lo + 700)), dim, best)
            at, ids, scores = best.hits()
            for i, row in enumerate(full):
                want = sorted(range(3000), key=lambda j: (not np.isnan(row[j]), -row[j] if not np.isnan(row[j]) else 0, j))[:9]
                assert ids[at == i].tolist() == want and np.array_equal(scores[at == i], row[want], equal_nan=True)


def test_blocks_of_queries(spark, data):
    _, _, corpus, queries = data
    whole = scan.ranked(scan.scan(corpus, queries, {Scorer.F32: 6, Scorer.BIN: 4}).where("scorer = 'f32'"), 6)
    parts = scan.ranked(scan.scan(corpus, queries, {Scorer.F32: 6}, query_bytes=61 * 4), 6)
    assert hits(whole) == hits(parts) == hits(Scorer.F32.top_k(corpus, queries, 6))
    assert hits(Scorer.F32.top_k(corpus, QuerySet(queries.df.where("false"), 61), 6)) == []
    got = [{tuple(r) for r in scan.kernel_values(corpus, queries, Scorer.BIN, query_bytes=n).collect()} for n in (61 * 4, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 5 * 200


@pytest.mark.parametrize("backend", BACKENDS)
def test_ragged_rows_fail_the_scan(spark, backend):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "id long, embedding array<float>").coalesce(1)
    corpus, queries = Corpus.from_dataframe(df, dim=2, validate=False), make(spark, [[1.0, 1.0]], QuerySet)
    for scorer in (Scorer.F32, Scorer.I8) if backend == "catalyst" else Scorer:
        with pytest.raises(Exception, match="lengths differ: 2 vs 3|holds 3 values; expected 2|3 values"):
            hits(scorer.top_k(corpus, queries, 2, backend=backend))


def test_prepared_is_the_same_both_ways(spark):
    x = np.concatenate([np.random.default_rng(8).normal(size=(40, 13)), np.zeros((1, 13)), np.full((1, 13), np.nan)]).astype(np.float32)
    corpus = make(spark, x)
    corpus = Corpus(corpus.df.withColumn("label", F.col("id") * 2), 13)
    a, b = (sorted(str(sorted(r.asDict().items())) for r in corpus.prepared(backend=n).df.collect()) for n in BACKENDS)
    assert a == b


def test_select_top_k(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(20)], "id long, v double")
    assert [r["id"] for r in select_top_k(df, F.col("v"), 6).orderBy("rank").collect()] == [3, 7, 11, 15, 19, 2]
    assert select_top_k(df, F.col("v"), 0).count() == 0


def test_errors(spark, data):
    _, _, corpus, _ = data
    with pytest.raises(QueryDimError, match="queries have 1 dimensions; the corpus has 61"):
        Scorer.F32.top_k(corpus, make(spark, [[1.0]], QuerySet), 1)
    with pytest.raises(FilterLengthError, match="made for 3 rows; the corpus has 200"):
        Scorer.F32.top_k(corpus, data[3], 1, IdFilter.from_ids([1], spark, universe=3))
    with pytest.raises(IndexError):
        IdFilter.from_ids([5], spark, universe=5)
    with pytest.raises(ValueError, match="backend"):
        Scorer.F32.top_k(corpus, data[3], 1, backend="simd")
    rows = lambda v, t: spark.createDataFrame(v, f"id long, embedding {t}")
    with pytest.raises(RaggedError):
        Corpus.from_dataframe(rows([(0, [1.0]), (1, [1.0, 2.0])], "array<float>"))
    with pytest.raises(ZeroDimError):
        Corpus.from_dataframe(rows([(0, [])], "array<float>"))
    holes = rows([(0, [1.0, None]), (1, None), (2, [1.0, 2.0])], "array<float>")
    with pytest.raises(StorageError):
        Corpus.from_dataframe(holes)
    assert Corpus.from_dataframe(holes, strict=False).count() == 1
    with pytest.raises(ScaleCountError):
        Corpus.from_int8(spark.createDataFrame([(0, [1], None)], "id long, codes array<tinyint>, scale float"))
    bits = spark.createDataFrame([(0, bytearray(b"\xff\xff"))], "id long, bits binary")
    with pytest.raises(StrideError):
        Corpus.from_bits(bits, 17)
    with pytest.raises(RaggedError):
        Corpus.from_bits(bits, 8)
    with pytest.raises(StorageError, match="padding"):
        Corpus.from_bits(bits, 13, check_padding=True)
    assert Corpus.from_bits(bits, 13).dim == 13
    with pytest.raises(StorageError, match="norm"):
        make(spark, [[1.0, 1.0]]).check_norms()
    make(spark, [[1.0, 1.0]]).normalized().check_norms()
    assert "dim=61" in repr(corpus)


def test_plans(spark, tables, capsys):
    from vecstrata import queries as Q

    Q.QUERIES["two_stage_bin_f32_x8"](spark, tables).explain("formatted")
    assert "WindowGroupLimit" in capsys.readouterr().out
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    corpus = Corpus.from_dataframe(df, "vec_id", "embedding", keep=("label",))
    Scorer.F32.top_k(corpus, Q.query_set(spark, tables), 3, IdFilter.where("label = 3")).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan and "MapInArrow" in plan


def test_stream(spark, tmp_path, data):
    from vecstrata.streaming.feed import search_stream

    _, _, corpus, queries = data
    source, seen = str(tmp_path / "in"), []
    queries.df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(queries.df.schema).parquet(source)
    run = search_stream(stream, corpus, Scorer.F32, 4, lambda hits_, n: seen.extend(hits(hits_))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert seen == hits(Scorer.F32.top_k(corpus, queries, 4))
