"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a batch are walked in sorted order, which is a
depth-first walk of their trie: the path from the root is a stack of forward
scores and counts, and a pre-token computes only what lies below the prefix it
shares with the one before. The best unigram segmentation's number of tokens is
stored at each terminal; a document's count is the sum over its pre-tokens.
Workers remember the counts of frequent pre-tokens, up to a bound; no row moves
between tasks. Counts equal the number of ids that sentencepiece_codec gives.

Defined results: null and empty texts have no tokens; equal texts equal counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .sentencepiece_codec import runs
from .shared import worker_state
from .unigram import LITERAL, MARK, Pieces, segments

REMEMBERED, LONGEST = 600_000, 48


class Counter:
    """Scores by piece, with the counts of recent pre-tokens."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)
        self.known: dict[str, int] = {}

    def terminals(self, tokens: list[str]) -> dict[str, int]:
        """Tokens of each pre-token."""
        found, get, longest, unknown = {}, self.scores.get, self.longest, self.unknown
        score, count, before = [0.0], [0], ""
        for t in sorted(tokens):
            shared, most = 0, min(len(t), len(before))
            while shared < most and t[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for d in range(shared + 1, len(t) + 1):
                best, n = float("-inf"), 0
                for i in range(max(0, d - longest), d):  # longer last pieces first
                    s = get(t[i:d])
                    if s is not None and score[i] + s > best:
                        best, n = score[i] + s, count[i] + 1
                if t[d - 1] not in self.scores and score[d - 1] + unknown > best:
                    best, n = score[d - 1] + unknown, count[d - 1] + len(t[d - 1].encode())
                score.append(best)
                count.append(n)
            found[t] = count[len(t)]
            before = t
        return found

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens between spaces, and tokens, of whole texts."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [t.split(" ") if t else [] for t in texts]
        cut = {p: segments(p) for p in set(chain.from_iterable(split)).difference(self.known)}
        at = self.terminals(list({t for parts in cut.values() for t in parts}))
        if LITERAL in at:
            at[LITERAL] = len(MARK.encode())
        fresh = {}
        for p, parts in cut.items():
            (self.known if len(p) <= LONGEST else fresh)[p] = sum([at[t] for t in parts])
        known = self.known
        totals = [sum([known[p] if p in known else fresh[p] for p in s]) for s in split] if fresh else [sum(map(known.__getitem__, s)) for s in split]
        return [len(s) for s in split], totals


def token_counts(docs: DataFrame, pieces: Pieces, *, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_pieces (between spaces) and n_tokens; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(({p: s for _, p, s in pieces.normal()}, pieces.unknown))
    docs = docs.drop("n_pieces", "n_tokens")
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("counts", dict)  # nothing of another operator stays in the worker
        counter = Counter(*shared.value)
        for batch in batches:
            for first, part in runs(batch.column(text_col)):
                n, total = counter.count(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(part)) for c in kept), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_pieces", "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, ", ".join(filter(None, [schema, "n_pieces long, n_tokens long"])))
