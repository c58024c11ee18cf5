"""From raw documents to token ids, in four stages.

Each stage takes (spark, docs, sf_dir), decides on every document that the one
before kept, and returns a DataFrame that is written as Parquet and reread. All
but the last return the columns of documents. Documents go if their language
can't be told, if they nearly repeat one with a lower id, or if they hold a
passage of the benchmark; all others stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecstrata.llm import decontaminate, language_id, ngram_join, sentencepiece_codec, unigram
from vecstrata.llm.queries import table, tokenizer_path
from vecstrata.llm.shared import written

#: A language is told if its share of the posterior is at least this.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null and letterless texts and those whose language can't be told."""
    model = language_id.fit(docs)
    told = language_id.identify(docs, model, lang_out="_lang_pred", score_out="_lang_score")
    if not model.langs:  # nothing to learn from: only letterless texts can be told apart
        return docs.where(docs["text"].rlike(r"\p{L}"))
    return told.where(f"_lang_pred <> '{language_id.UNDETERMINED}' and _lang_score >= {LEAST_SCORE}").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of the least id."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the ids of the whole text, with proof that they decode to it."""
    pieces = unigram.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_codec.round_trips(docs, pieces, ids_col="ids")


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: SQL can't express a learned language model or the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
