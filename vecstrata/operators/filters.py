"""Filters on ids and attributes, applied before anything is scored."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FilterLengthError
from ..functions.rng import outputs, uniform
from ..plans.corpus import Corpus


@dataclass(frozen=True)
class IdFilter:
    """A predicate, or a table of ids; `universe` is the number of rows it was made for, if that is to be checked."""

    predicate: Column | None = None
    ids: DataFrame | None = None
    universe: int | None = None

    @classmethod
    def where(cls, predicate: Column | str) -> IdFilter:
        return cls(predicate=F.expr(predicate) if isinstance(predicate, str) else predicate)

    @classmethod
    def empty(cls, universe: int | None = None) -> IdFilter:
        return cls(predicate=F.lit(False), universe=universe)

    @classmethod
    def from_ids(cls, ids: DataFrame | Iterable[int], spark: SparkSession | None = None, universe: int | None = None) -> IdFilter:
        """Ids of a table's first column or of a list; repeated ids count once."""
        if not isinstance(ids, DataFrame):
            listed = sorted(set(ids))
            if universe is not None and listed and not 0 <= listed[0] <= listed[-1] < universe:
                raise IndexError(f"id {listed[-1] if listed[0] >= 0 else listed[0]} is outside 0..{universe}")
            ids = spark.createDataFrame([(i,) for i in listed], "id long")
        return cls(ids=ids.select(ids[0].cast("long").alias("id")).distinct(), universe=universe)

    @classmethod
    def random(cls, universe: int, keep_fraction: float, seed: int) -> IdFilter:
        """Keeps each id with this probability: a function of the seed and the id alone."""

        @F.pandas_udf("boolean")
        def keep(ids: pd.Series) -> pd.Series:
            drawn = uniform(outputs(np.array([seed % 2**64], np.uint64), ids.to_numpy(np.int64)))[0]
            return pd.Series(drawn < keep_fraction)

        return cls(predicate=keep(F.col("id")), universe=universe)

    def with_ids(self, ids: Iterable[int], spark: SparkSession) -> IdFilter:
        """This filter of ids with more ids set."""
        more = IdFilter.from_ids(ids, spark, self.universe).ids
        return IdFilter(self.predicate, more if self.ids is None else self.ids.union(more).distinct(), self.universe)

    def apply(self, corpus: Corpus) -> Corpus:
        """The corpus's rows that pass."""
        if self.universe is not None and (rows := corpus.count()) != self.universe:
            raise FilterLengthError(self.universe, rows)
        df = corpus.df
        if self.predicate is not None:
            df = df.where(self.predicate)
        if self.ids is not None:
            df = df.join(self.ids, "id", "left_semi")
        return Corpus(df, corpus.dim)

    def contains(self, corpus: Corpus, row_id: int) -> bool:
        return not self.apply(corpus).df.where(F.col("id") == row_id).isEmpty()

    def count(self, corpus: Corpus) -> int:
        return self.apply(corpus).count()

    def ordered_ids(self, corpus: Corpus) -> DataFrame:
        return self.apply(corpus).df.select("id").orderBy("id")
