"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The trie holds the pieces' UTF-8 bytes in two integer arrays: the child of state
s by byte b is t = base[s] + b + 1 if check[t] = s. Distinct pre-tokens of a batch
run through the Viterbi search side by side in numpy, sorted into groups of
like length; workers remember frequent ones. Memory is bounded by the batch and
by what is remembered, and no row moves between tasks.

Defined results: null and empty texts have no ids and decode to the empty text;
ids of control pieces decode to nothing; equal texts have equal ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import worker_state
from .unigram import LITERAL, MARK, Pieces, segments

#: Pre-tokens that a worker remembers, and the longest of these in characters.
REMEMBERED, LONGEST = 200_000, 48
ENCODED = "n_ids long, n_fallback long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


class DoubleArray:
    """A double-array trie from byte strings to numbers."""

    STRETCH = 256

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], free, dense = 0, 257, 1  # from 257 on, any first child can take the first free place
        todo = [(0, 0, len(keys), 0)]
        for state, lo, hi, depth in todo:
            if lo < hi and len(keys[lo][0]) == depth:
                value[state] = keys[lo][1]
                lo += 1
            children = []
            while lo < hi:
                b, first = keys[lo][0][depth], lo
                while lo < hi and keys[lo][0][depth] == b:
                    lo += 1
                children.append((b, first, lo))
            if not children:
                continue
            codes = np.array([b + 1 for b, _, _ in children])
            while check[free] != -1:
                free += 1
            at = max(1, free - int(codes[0]), dense if len(codes) > 1 else 1)
            while True:  # the first place where all children fit, a stretch at a time
                while at + self.STRETCH + 257 >= len(base):
                    base, check, value = (np.concatenate([a, np.full(len(a), fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                fits = np.logical_and.reduce([check[at + c : at + c + self.STRETCH] == -1 for c in codes])
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += self.STRETCH
                dense = max(dense, at) if len(codes) > 1 else dense
            base[state], check[at + codes] = at, state
            todo += [(at + b + 1, first, end, depth + 1) for b, first, end in children]
        self.base, self.check, self.value = base, check, value


class Codec:
    """Encodes and decodes; what the driver broadcasts."""

    def __init__(self, pieces: Pieces):
        normal = list(pieces.normal())
        self.trie = DoubleArray([(p.encode(), i) for i, p, _ in normal])
        self.scores = np.array(pieces.scores)
        self.byte_ids = np.array(pieces.byte_ids(), np.int64)
        self.unknown = pieces.unknown
        self.shown = [b" \xe2\x81\x87 " if k == "unknown" else b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() for p, k in zip(pieces.pieces, pieces.kinds, strict=True)]
        self.is_byte = np.array([k == "byte" for k in pieces.kinds])

    def viterbi(self, tokens: list[bytes]) -> list[bytes]:
        """Best ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(tokens)
        order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        at = 0
        while at < len(order):
            longest = max(8, len(tokens[order[at]]) * 5 // 4)
            end = at
            while end < len(order) and len(tokens[order[end]]) <= longest and (end == at or (end - at) * longest < 1 << 22):
                end += 1
            for i, ids in zip(order[at:end], self._group([tokens[i] for i in order[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out

    def _group(self, tokens: list[bytes]) -> Iterator[bytes]:
        n, most = len(tokens), max(map(len, tokens))
        width = most + 1
        text = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(n, width)
        length = np.array([len(t) for t in tokens])
        best = np.full((n, width + 4), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, width + 4), np.int32)  # bytes of the last piece
        last = np.full((n, width + 4), -1, np.int32)  # its id; -1: a character as bytes
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(most):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (length > i))
            lead = text[rows, i]
            chars = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for d in range(most - i):
                r = rows[live]
                nxt = base[state] + text[r, i + d] + 1
                ok = (check[nxt] == state) & (i + d < length[r])
                live, state = live[ok], nxt[ok]
                if not len(live):
                    break
                got = value[state]
                has = got >= 0
                r, v, l = rows[live[has]], got[has], live[has]
                single[l[chars[l] == d + 1]] = True
                s = best[r, i] + self.scores[v]
                better = s > best[r, i + d + 1]
                r, e = r[better], i + d + 1
                best[r, e], back[r, e], last[r, e] = s[better], d + 1, v[better]
            lone = np.flatnonzero(~single)
            r, e = rows[lone], i + chars[lone]
            s = best[r, i] + self.unknown
            better = s > best[r, e]
            r, e = r[better], e[better]
            best[r, e], back[r, e], last[r, e] = s[better], chars[lone][better], -1
        # backwards: each step puts the last piece's ids before those found so far
        ids = np.zeros((n, width), np.uint32)
        place, at, rows = np.full(n, width), length.copy(), np.flatnonzero(length > 0)
        while len(rows):
            size, piece = back[rows, at[rows]], last[rows, at[rows]]
            plain = piece >= 0
            r = rows[plain]
            place[r] -= 1
            ids[r, place[r]] = piece[plain]
            r, size_of = rows[~plain], size[~plain]
            for k in range(1, 5):
                some = r[size_of >= k]
                place[some] -= 1
                ids[some, place[some]] = self.byte_ids[text[some, at[some] - k]]
            at[rows] -= size
            rows = rows[at[rows] > 0]
        for row, p in zip(ids, place.tolist(), strict=True):
            yield row[p:].astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids, without the space that encoding put first."""
        data = b"".join(map(self.shown.__getitem__, ids.tolist()))
        return data[1:] if data[:1] == b" " else data


class Worker:
    """A codec with the ids of recent pre-tokens."""

    def __init__(self, codec: Codec):
        self.codec, self.known = codec, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [t.split(" ") if t else [] for t in texts]
        new = set().union(*split).difference(known) if split else set()
        cut = {p: segments(p) for p in new}
        tokens = list({t for parts in cut.values() for t in parts})
        ids = dict(zip(tokens, self.codec.viterbi([t.encode() for t in tokens]), strict=True))
        if LITERAL in ids:
            ids[LITERAL] = self.codec.byte_ids[list(MARK.encode())].astype("<u4").tobytes()
        fresh = {}
        for p, parts in cut.items():
            got = b"".join([ids[t] for t in parts])
            (known if len(p) <= LONGEST else fresh)[p] = got
        if fresh:
            return [b"".join([known[p] if p in known else fresh[p] for p in s]) for s in split]
        return [b"".join(map(known.__getitem__, s)) for s in split]


def runs(column: pa.Array, characters: int = 2 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of about so many characters, with the number of the first."""
    part, size, first = [], 0, 0
    for i, t in enumerate(column):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= characters:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def encode(docs: DataFrame, pieces: Pieces, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of the whole text (array of int); a column of that name is replaced."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(pieces))
    docs = docs.drop(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pieces", dict)  # nothing of another operator stays in the worker
        worker = Worker(codec.value)
        for batch in batches:
            for first, part in runs(batch.column(text_col)):
                ids = [np.frombuffer(x, "<i4") for x in worker.encode(part)]
                ends = np.cumsum([0, *map(len, ids)])
                array = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(part)).columns, array], names=[*batch.schema.names, ids_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{ids_col}` array<int>")


def decode(docs: DataFrame, pieces: Pieces, *, ids_col: str = "ids", text_out: str = "decoded") -> DataFrame:
    """docs with the text of the ids; null ids give null, bytes that are no UTF-8 the replacement character."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(pieces))
    docs = docs.drop(text_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else codec.value.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{text_out}` string")


def round_trips(docs: DataFrame, pieces: Pieces, *, text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """docs without the text, with ENCODED: the whole text is encoded and decoded again in one pass.

    n_fallback counts ids that stand for a byte; ids_crc32 is that of the ids as
    little-endian unsigned 32-bit integers; round_trip: the decoded text is the text.
    The ids themselves are added if ids_col names a column for them.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(pieces))
    added = [c.split()[0] for c in ENCODED.split(", ")]
    docs = docs.drop(*added, *filter(None, [ids_col]))
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pieces", dict)  # nothing of another operator stays in the worker
        worker = Worker(codec.value)
        for batch in batches:
            for first, part in runs(batch.column(text_col)):
                rows, encoded = [], worker.encode(part)
                for text, data in zip(part, encoded, strict=True):
                    ids = np.frombuffer(data, "<u4")
                    back = worker.codec.decode(ids)
                    rows.append((len(ids), int(worker.codec.is_byte[ids].sum()), zlib.crc32(data), hashlib.sha256(back).hexdigest(), back == (text or "").encode()))
                new = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                if ids_col:
                    ends = np.cumsum([0, *(len(x) // 4 for x in encoded)])
                    new.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(part)) for c in kept), *new], names=[*kept, *added, *filter(None, [ids_col])])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, ", ".join(filter(None, [schema, ENCODED, f"`{ids_col}` array<int>" if ids_col else ""])))
