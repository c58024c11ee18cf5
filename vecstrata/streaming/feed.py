"""A stream of queries against a corpus: each micro-batch is one search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.filters import IdFilter
from ..operators.scan import Scorer
from ..plans.corpus import Corpus, QuerySet


def search_stream(stream: DataFrame, corpus: Corpus, scorer: Scorer, k: int, sink: Callable[[DataFrame, int], None], filter: IdFilter | None = None, *, id_col: str = "id", vector_col: str = "embedding") -> DataStreamWriter:
    """A writer that hands the top k of each batch of (id, embedding) to sink(hits, batch_id).

    Results of a batch depend on it alone, so a replayed batch gives the same hits.
    """

    def search(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            queries = QuerySet.from_dataframe(batch, id_col, vector_col, corpus.dim)
            sink(scorer.top_k(corpus, queries, k, filter).withColumn("batch_id", F.lit(batch_id)), batch_id)

    return stream.writeStream.foreachBatch(search)
