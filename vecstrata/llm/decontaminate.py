"""Benchmark decontamination by winnowing.

Of each `width` successive k-grams of a text the one with the least hash is
kept, so two texts that share k + width - 1 words share a kept hash at the same
place of what they share. Kept hashes of documents are joined with those of the
benchmark, and each hit is extended to the windows of `window` words around it:
those that the benchmark holds too are counted, and so a run of any length is
covered window by window. A place is looked up once, whatever the number of its
partners, so the work grows with the hits of a document, also where texts repeat
themselves. Items of fewer words are matched whole.

Words are compared by 64-bit hashes. The index of the benchmark goes to the
tasks only while it has at most `max_local_words` words (about 40 bytes each);
a larger benchmark is joined by shuffling the kept hashes.

Defined results: a null text has no words; a text or item without words has no
hits; rows are judged one by one, so repeated rows repeat their result; an item
with a null id is called "null"; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .words import U64, grams, owners, winnow, word_hashes

WINDOW, K = 10, 5
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Bytes of text that a task hashes at once.
SLICE = 4 << 20


class Windows:
    """The distinct windows of n words of benchmark items: hashes, the word where one begins, and the items that hold it."""

    def __init__(self, h: np.ndarray, own: np.ndarray, first: np.ndarray, n: int):
        self.n, g = n, grams(h, n)[first]
        order = np.lexsort((own[first], g))
        g, first = g[order], first[order]
        self.hashes, at = np.unique(g, return_index=True)
        self.first = first[at]
        number = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(g))))
        pairs = np.unique(np.stack([number, own[first]], 1), axis=0)
        self.items = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(at) + 1))

    def find(self, g: np.ndarray) -> np.ndarray:
        """The number of each window hash, -1 for those that no item holds."""
        if not len(self.hashes):
            return np.full(len(g), -1)
        at = np.minimum(np.searchsorted(self.hashes, g), len(self.hashes) - 1)
        return np.where(self.hashes[at] == g, at, -1)


class Index:
    """Word hashes of benchmark items, their kept k-grams and their windows."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW, k: int = K):
        self.window, self.k, self.ids = window, k, ids
        self.h, bounds = word_hashes([(t or "").encode() for t in texts])
        own, lengths = owners(bounds), np.diff(bounds)
        self.kept = np.unique(winnow(self.h, bounds, k, window - k + 1)[0])
        whole = np.flatnonzero(own[: max(0, len(own) - window + 1)] == own[window - 1 :])
        self.windows = [Windows(self.h, own, whole, window)]
        for n in sorted(set(lengths[(lengths > 0) & (lengths < window)].tolist())):
            self.windows.append(Windows(self.h, own, bounds[:-1][lengths == n], n))

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
        """For each length of windows: where in documents of words h they occur, and which."""
        own = owners(bounds)
        for w in self.windows:
            first = np.flatnonzero(own[: max(0, len(own) - w.n + 1)] == own[w.n - 1 :])
            if w.n == self.window:
                g, place = winnow(h, bounds, self.k, self.window - self.k + 1)
                first = around(place[np.isin(g, self.kept)], bounds, own, self.window, self.k)
            number = w.find(grams(h, w.n)[first]) if len(first) else np.zeros(0, np.int64)
            first, number = first[number >= 0], number[number >= 0]
            same = np.ones(len(first), bool)
            for j in range(w.n):  # word by word: equal hashes of windows are no proof
                same &= h[first + j] == self.h[w.first[number] + j]
            yield w, first[same], number[same]


def around(place: np.ndarray, bounds: np.ndarray, own: np.ndarray, window: int, k: int) -> np.ndarray:
    """First words of all windows of a document that hold a kept k-gram at one of these places."""
    first = (place[:, None] - np.arange(window - k + 1)).reshape(-1)
    doc = np.repeat(own[place], window - k + 1)
    inside = (first >= bounds[doc]) & (first + window <= bounds[doc + 1])
    return np.unique(first[inside])


def _judge(texts: list[bytes], index: Index | None) -> tuple[list, ...]:
    """n_words, n_hit and the items' ids of each text."""
    h, bounds = word_hashes(texts)
    hits, items = np.zeros(len(texts), np.int64), [set() for _ in texts]
    if index is not None and len(h):
        own, cover = owners(bounds), np.zeros(len(h) + 1, np.int64)
        for w, first, number in index.hits(h, bounds):
            np.add.at(cover, first, 1)
            np.add.at(cover, first + w.n, -1)
            for doc, i in np.unique(np.stack([own[first], number], 1), axis=0).tolist():
                items[doc].update(w.items[w.bounds[i] : w.bounds[i + 1]].tolist())
        hits = np.bincount(own[np.cumsum(cover)[:-1] > 0], minlength=len(texts))
    return np.diff(bounds), hits, [{index.ids[i] for i in x} for x in items]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 in runs of about SLICE bytes, with the number of the first."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= SLICE:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def decontaminate(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, max_local_words: int = 2_000_000) -> DataFrame:
    """docs with the columns of RESULT added (columns of these names are replaced).

    n_words: words of the text; n_hit: those inside an occurrence of a window of
    an item; n_items, items_sha256: the items with such windows, ids as sorted,
    comma-joined strings; contaminated: n_hit > 0.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    spark = docs.sparkSession
    items = bench.select(F.coalesce(bench[item_col].cast("string"), F.lit("null")).alias("item_id"), bench[item_text_col].alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    docs = docs.drop(*[c.split()[0] for c in RESULT.split(", ")])
    if size // 2 > max_local_words:  # a word takes two bytes at least, with what parts it from the next
        return _joined(docs, items, text_col, window, k)
    rows = items.collect()
    index = spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], window, k))
    names, at = docs.columns, docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(at).to_pylist()):
                n, hit, found = _judge(part, index.value)
                listed = [",".join(sorted(x)) for x in found]
                new = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]), pa.array(hit > 0)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(part)).columns, *new], names=[*names, *(c.split()[0] for c in RESULT.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{schema}, {RESULT}")


def _joined(docs: DataFrame, items: DataFrame, text_col: str, window: int, k: int) -> DataFrame:
    """As decontaminate, for benchmarks of any size: equal texts are judged once.

    Documents send their kept hashes with the windows around them; those whose kept
    hash the benchmark has too are looked up among its windows. No text moves.
    """
    items = items.withColumn("_n", F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))))
    short = [r["_n"] for r in items.where(f"_n between 1 and {window - 1}").select("_n").distinct().collect()]
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    distinct = docs.select(sha.alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text")).dropDuplicates(["key"])

    def sent(whole: bool):
        """key, n, kept, first and hash of windows; for items all of them, for short windows kept is the hash itself."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, part in slices(batch.column("text").to_pylist()):
                    h, bounds = word_hashes(part)
                    own, lengths = owners(bounds), np.diff(bounds)
                    g, place = winnow(h, bounds, k, window - k + 1)
                    for n in [window, *short]:
                        if n == window:
                            first = (place[:, None] - np.arange(window - k + 1)).reshape(-1)
                            kept, doc = np.repeat(g, window - k + 1), np.repeat(own[place], window - k + 1)
                            inside = (first >= bounds[doc]) & (first + window <= bounds[doc + 1])
                            first, kept = first[inside], kept[inside]
                            found = grams(h, window)[first] if len(first) else np.zeros(0, U64)
                        else:
                            first = np.flatnonzero(own[: max(0, len(own) - n + 1)] == own[n - 1 :])
                            first = first[lengths[own[first]] == n] if whole else first
                            found = kept = grams(h, n)[first] if len(first) else np.zeros(0, U64)
                        doc = own[first]
                        columns = [batch.column(0).slice(at, len(part)).take(pa.array(doc)), pa.array(np.full(len(first), n), pa.int32()), pa.array(kept.view(np.int64)), pa.array(first - bounds[doc]), pa.array(found.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "kept", "first", "hash"])

        return run

    schema = "key string, n int, kept long, first long, hash long"
    mine = distinct.mapInArrow(sent(False), schema)
    theirs = items.select(F.col("item_id").alias("key"), "text").mapInArrow(sent(True), schema)
    near = mine.join(theirs.select("n", "kept").distinct(), ["n", "kept"], "left_semi").select("key", "n", "first", "hash").distinct()
    found = near.join(theirs.select(F.col("key").alias("item_id"), "n", "hash").distinct(), ["n", "hash"])
    listed = found.select("key", "item_id").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    runs = found.select("key", F.col("first").alias("l"), (F.col("first") + F.col("n")).alias("r")).distinct()
    before = Window.partitionBy("key").orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("r") - F.greatest("l", F.coalesce(F.max("r").over(before), F.col("l"))))
    hit = runs.withColumn("new", fresh).groupBy("key").agg(F.sum("new").alias("n_hit"))
    counted = distinct.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), pa.array([int(word_hashes([t.encode()])[1][-1]) for t in b.column(1).to_pylist()], pa.int64())], names=["key", "n_words"]) for b in bs), "key string, n_words long")
    judged = counted.join(hit, "key", "left").join(listed, "key", "left").select(
        F.col("key").alias("_vs_sha"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.greatest(F.coalesce(F.size("ids"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    return docs.withColumn("_vs_sha", sha).join(judged, "_vs_sha").drop("_vs_sha")
