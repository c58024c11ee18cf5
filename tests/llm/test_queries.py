"""Queries and the pipeline over whole tables, against SQL and brute force."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from vecstrata.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    c = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in c.description]
    want = sorted(repr(sorted(zip(names, r, strict=True))) for r in c.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in Q.QUERIES[name](spark, tables).collect()) == want


def test_language_id_held_out(spark, tables):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = Q.op5_language_id(spark, tables).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [lang[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]
    assert sum(held) >= 0.97 * len(held) > 0


def test_all_queries_cover_the_table(spark, tables):
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    for name in ("op2_token_counts", "op4_sentencepiece", "op8_fingerprints", "op9_sharding"):
        got = Q.QUERIES[name](spark, tables)
        assert got.select("doc_id").distinct().count() == n == got.count()


def test_packed_ids_of_the_whole_table(spark, tables):
    encode = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json")).encode
    want, start = [], 0
    for r in spark.read.parquet(f"{tables}/documents.parquet").orderBy("doc_id").collect():
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = Q.op7_packed_token_ids(spark, tables).orderBy("doc_id")
    assert [tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()] == want


def test_pipeline(spark, tables):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    joined = {r["doc_id"]: r for r in Q.op1_ngram_jaccard_join(spark, tables).collect()}
    und = {r["doc_id"] for r in Q.op5_language_id(spark, tables).collect() if r["lang_pred"] == "und"}
    dirty = {r["doc_id"] for r in Q.op10_benchmark_decontamination(spark, tables).collect() if r["contaminated"]}
    kept = collections.defaultdict(list)
    for i, r in joined.items():
        if i not in und:
            kept[r["class_id"]].append(i)
    want = {min(v) for v in kept.values()} - dirty
    got = P.run(spark, tables).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) and all(r["round_trip"] for r in got)
    assert [name for name, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece_encoding"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
        assert stage(spark, docs.where("false"), tables).count() == 0
