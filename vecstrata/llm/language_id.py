"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. A
word that it doesn't know falls back to character n-grams: from the longest
length on, n-grams that the model knows are scored, and only what they
leave uncovered goes to the next shorter length; characters unknown even as
1-grams count alike for all languages. The language with the highest mean score
wins; the score is its share of the posterior with `evidence` words at most.

The model is fitted on a bounded sample: about `sample_rows` labelled rows per
language, chosen by a hash of their content, `max_words` words and `max_grams`
n-grams per language. Counting runs on the executors; only the bounded model
reaches the driver. Every text is then scored whole. Words are runs of letters
(number letters such as Roman numerals included) of any length, in fitting and scoring.

Defined results: null and letterless texts are `und` with score 0, and so are
all texts if nothing could be learned; ties go to the first language by name;
equal texts get equal results. Language, source and id are no inputs.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import worker_state, written

UNDETERMINED = "und"
SAMPLE_ROWS, MAX_WORDS, MAX_GRAMS, MAX_N = 3000, 20_000, 20_000, 4
#: Words whose scores a worker remembers; bounds its memory.
REMEMBERED = 150_000
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = r"[\p{L}\p{Nl}\p{No}]+"  # the same runs in Java
#: Letters of a word whose n-grams are listed at once.
STRETCH = 64


@dataclass
class Model:
    langs: list[str]
    max_n: int = MAX_N
    evidence: float = 50.0
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[str, tuple[float, ...]] = field(default_factory=dict)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word(self, w: str) -> tuple[float, ...]:
        """Log-frequency scores of one word in each language."""
        if (known := self.words.get(w)) is not None:
            return known
        total, parts = [0.0] * len(self.langs), 0
        gaps = [(0, f"<{w}>")]
        for n in range(self.max_n, 0, -1):
            rest = []
            for at, s in gaps:
                i = begin = 0
                while i + n <= len(s):
                    g = self.grams.get(s[i : i + n])
                    if g is None:
                        i += 1
                        continue
                    for k, v in enumerate(g):
                        total[k] += v
                    parts += 1
                    if i > begin:
                        rest.append((at + begin, s[begin:i]))
                    i += n
                    begin = i
                if begin < len(s):
                    rest.append((at + begin, s[begin:]))
            gaps = rest
        return tuple(t / parts for t in total) if parts else tuple(total)


class Scorer:
    """A model in a worker, with the scores of recent words."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.scores = np.zeros((1024, len(model.langs)))

    def _row(self, w: str) -> int:
        i = self.rows[w] = len(self.rows)
        if i >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[i] = self.model.word(w)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORDS.findall(text.lower()) if text and self.model.langs else []
        if not words or not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0
        total, weight = np.zeros(len(self.model.langs)), 0
        for first in range(0, len(words), 50_000):
            counted = Counter(words[first : first + 50_000])
            if len(self.rows) + len(counted) > REMEMBERED:
                self.rows.clear()  # rows of one call must stay valid together
            known = self.rows.get
            at = np.fromiter([i if (i := known(w)) is not None else self._row(w) for w in counted], np.int64, len(counted))
            times = np.fromiter(counted.values(), np.float64, len(counted))
            total += times @ self.scores[at]
            weight += int(times.sum())
        mean = total / weight
        p = np.exp((mean - mean.max()) * min(self.model.evidence, weight))
        best = int(np.argmax(mean))
        return self.model.langs[best], float(p[best] / p.sum())


def scorer(model: Model) -> Scorer:
    """This worker's scorer of a model; it remembers words from task to task."""
    return worker_state(f"language-{model.name}", lambda: Scorer(model))


def _table(counts: DataFrame, langs: list[str], key: str) -> dict[str, tuple[float, ...]]:
    """Log frequencies per language of the counted keys, smoothed by a half."""
    rows = counts.collect()  # bounded: the most frequent keys of each language
    total = {lang: 0 for lang in langs}
    found: dict[str, dict[str, int]] = {}
    for r in rows:
        total[r["lang"]] += r["n"]
        found.setdefault(r[key], {})[r["lang"]] = r["n"]
    size = [math.log(total[lang] + 0.5 * len(found)) if found else 0.0 for lang in langs]
    return {k: tuple(math.log(c.get(lang, 0) + 0.5) - s for lang, s in zip(langs, size, strict=True)) for k, c in found.items()}


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_n: int = MAX_N) -> Model:
    """A model of the languages named in docs; rows without text or language teach nothing."""
    known = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_rows / per[lang]))])
    draw = (F.xxhash64("text", F.lit("sample")).cast("double") / 2.0**64) + 0.5
    sample = known.where(draw <= share[F.col("lang")]).distinct()
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = written(words, "language-words")  # bounded like the sample; counted once for both tables
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    known_words = words.where("n > 1").withColumn("r", F.row_number().over(top)).where(F.col("r") <= max_words)
    bordered = words.select("lang", "n", F.concat(F.lit("<"), "word", F.lit(">")).alias("w"))
    # long words in stretches that overlap, so that every n-gram begins in one of them
    begin = F.explode(F.sequence(F.lit(0), F.floor((F.length("w") - 1) / STRETCH).cast("int")))
    stretches = bordered.select("lang", "n", "w", begin.alias("i")).select("lang", "n", F.expr(f"substr(w, i * {STRETCH} + 1, {STRETCH + max_n - 1})").alias("w"))

    def of_length(n: int) -> Column:
        at = F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length("w") - (n - 1)))
        found = F.transform(at, lambda i: F.col("w").substr(i, F.lit(n)))
        return F.when(F.length("w") >= n, found).otherwise(F.array().cast("array<string>"))

    each = [of_length(n) for n in range(1, max_n + 1)]
    grams = stretches.select("lang", "n", F.explode(F.concat(*each)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = grams.withColumn("r", F.row_number().over(top)).where(F.col("r") <= max_grams)
    return Model(langs, max_n, words=_table(known_words, langs, "word"), grams=_table(best, langs, "gram"))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its score (0 to 1); columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_out, score_out)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = scorer(shared.value).predict
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(at)]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, lang_out, score_out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{lang_out}` string, `{score_out}` double")
