"""Queries of this subpackage over whole tables, with their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dec
from . import packed_ids
from . import fingerprints, language_id, licenses, ngram_join, sharding, token_counts, unigram, warc
from . import sentencepiece_codec as codec
from .shared import columns, new_path, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(spread(table(spark, sf_dir, "documents"))).drop("text_hash", "class_node")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return token_counts.token_counts(docs, unigram.load_pieces(tokenizer_path("piece_bpe_32k.model")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return licenses.scan(docs).drop("text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return codec.round_trips(docs, unigram.load_pieces(tokenizer_path("piece_bpe_32k.model")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return warc.read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op7_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        made = f.read()
    return packed_ids.read_ids(spark, packed_ids.write_ids(docs, new_path(spark, "packed-ids"), made, end_id=2))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare(table(spark, sf_dir, "documents"))
    kept = {"fingerprint": fingerprints.digest(found["entries"]), "edited_fingerprint": fingerprints.digest(found["edited_entries"])}
    return found.withColumns(kept).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return dec.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_packed_token_ids": op7_packed_token_ids,
    "op8_fingerprints": op8_fingerprints,
    "op9_sharding": op9_sharding,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

#: Words as the operators take them: only A-Z are lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) m FROM r GROUP BY a),
c AS (SELECT a, count(*) n_links FROM l GROUP BY a),
q AS (SELECT s.doc_id, md5(string_agg(g, '|' ORDER BY g)) h FROM s GROUP BY s.doc_id),
e AS (SELECT h, count(*) e FROM q GROUP BY h)
SELECT d.doc_id, least(d.doc_id, coalesce(k.m, d.doc_id)) class_id, coalesce(e.e, 1) n_copies, coalesce(c.n_links, 0) n_links
FROM documents d LEFT JOIN k ON k.a = d.doc_id LEFT JOIN c ON c.a = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN e ON e.h = q.h
""",
    "op3_license_scan": licenses.oracle_sql(),
    "op10_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) item_id, {_WORDS} w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) n, unnest(range(greatest(len(w) - 9, 1))) i FROM b WHERE len(w) > 0),
win AS (SELECT item_id, n, array_to_string(w[i + 1:i + n], ' ') g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) i FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, x.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') g FROM di) x JOIN win ON x.n = win.n AND x.g = win.g),
cover AS (SELECT doc_id, i + unnest(range(n)) spot FROM hit),
c AS (SELECT doc_id, count(DISTINCT spot) n_hit FROM cover GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
     d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) payload_bytes, sha256(h) payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
""",
}
