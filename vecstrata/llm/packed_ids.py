"""Token ids as binary files: fixed-width bit packing with block offsets.

A file holds the ids of some documents, one document after the other:

    magic | blocks | index | index offset (8 bytes) | magic

Each block packs `block_ids` ids (the last may hold fewer), each in the least
bits that the vocabulary needs: 64 ids become `width` little-endian 64-bit
words, so numpy packs and unpacks whole blocks at once. The index is, in
little-endian 64-bit integers: width, block_ids, documents, ids, blocks, the
byte offset of each block and of the end, the documents' keys, whether each key
is null, and the first id of each document and the end. Any id range is read by
fetching the blocks that hold it, and nothing else.

Files are written under a name of the attempt and then moved, so repeated,
speculative or lost tasks leave one whole file; their content depends on the
rows alone. `start` of a document counts all ids of earlier files too.

Ids are the library's own for the whole text: strings of added tokens, such as an
end mark that stands in a text, get their ids too.

Defined results: a null text has no ids but the end id; a null key sorts first;
rows with equal keys follow each other in order of a hash of their text; keys that
are no integers are an error; an empty table gives no files and no rows. Columns
besides key and text are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import worker_state

U64 = np.uint64
MAGIC = b"VSPACK01"
BLOCK_IDS = 1 << 16
#: Bytes of text that a file holds about; the number of files grows with the input.
FILE_TEXT_BYTES = 256 << 20
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    rows = -(-len(ids) // 64)
    padded = np.zeros((rows, 64), U64)
    padded.reshape(-1)[: len(ids)] = ids
    words = np.zeros((rows, width), U64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, word] |= padded[:, j] << U64(shift)
        if shift + width > 64:
            words[:, word + 1] |= padded[:, j] >> U64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    out, mask = np.empty((len(words), 64), np.uint32), U64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        ids = words[:, word] >> U64(shift)
        if shift + width > 64:
            ids = ids | words[:, word + 1] << U64(64 - shift)
        out[:, j] = ids & mask
    return out.reshape(-1)[:count]


def store(uri: str):
    """File system and path of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file, a block at a time."""

    def __init__(self, uri: str, vocabulary: int, block_ids: int = BLOCK_IDS):
        self.fs, self.path = store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.vocabulary, self.width, self.block_ids = vocabulary, width_of(vocabulary), block_ids
        self.offsets, self.keys, self.null, self.bounds = array("q", [len(MAGIC)]), array("q"), array("q"), array("q", [0])
        self.waiting, self.held = [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.vocabulary:
            raise ValueError(f"id {ids.max()} is not below {self.vocabulary}")
        self.keys.append(key or 0)
        self.null.append(key is None)
        self.bounds.append(self.bounds[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(self.held // self.block_ids * self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.uint32)])
        for at in range(0, n, self.block_ids):
            data = pack(ids[at : min(n, at + self.block_ids)], self.width)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.held)
        for part in ([self.width, self.block_ids, len(self.keys), self.bounds[-1], len(self.offsets) - 1], self.offsets, self.keys, self.null, self.bounds):
            self.out.write(np.array(part, "<i8").tobytes())
        self.out.write(struct.pack("<Q", self.offsets[-1]) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.keys), self.bounds[-1]


class Reader:
    """Reads ids of one file; only the index stays in memory."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a whole file of packed ids")
        at = struct.unpack("<Q", tail[:8])[0]
        index = np.frombuffer(self.file.read_at(size - 16 - at, at), "<i8")
        self.width, self.block_ids, docs, self.count, blocks = map(int, index[:5])
        self.offsets, self.keys, self.null, self.bounds = np.split(index[5:], np.cumsum([blocks + 1, docs, docs]))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1 of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        parts = []
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        for b in range(first, last + 1):
            lo = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[lo : lo + int(self.offsets[b + 1] - self.offsets[b])], self.width, min(self.block_ids, self.count - b * self.block_ids)))
        return np.concatenate(parts)[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, first id and ids of each document, read in runs of whole blocks."""
        have, lo = np.zeros(0, np.uint32), 0
        for key, null, a, b in zip(self.keys.tolist(), self.null.tolist(), self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            if b > lo + len(have):
                have, lo = self.ids(a, min(self.count, max(b, a + ids_at_once))), a
            yield None if null else key, a, have[a - lo : b - lo]


class Encoder:
    """Ids by the tokenizers library, remembering those of frequent pieces.

    Byte-level BPE treats each pre-token by itself. Texts are cut in numpy where a
    pre-token surely ends: before a single space between two other non-space
    characters, around such a lone line break, and between a Latin letter and the
    ASCII marks after it. Equal pieces are found by Arrow and looked up once a slice
    of texts; what has not been seen is encoded by the library, words and marks by its
    model without the rest of its machinery. Texts with other white space around a
    space or at an end, or with the string of an added token, and tokenizers of
    another make, go through the library whole.
    """

    #: Pieces remembered by a worker; bounds its memory.
    REMEMBERED = 1_200_000
    #: Bytes of text whose equal pieces are looked up together.
    SLICE = 8 << 20
    _ODD = re.compile(r"\A ?[^\S ]|  |\s\Z|[\x1c-\x1f\x85]")
    #: One pre-token each.
    _PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[!-&(-/:-@\[-`{-~]+)\Z")

    def __init__(self, tokenizer_json: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        made = json.loads(tokenizer_json)
        pre = made.get("pre_tokenizer") or {}
        self.cuts = made["model"]["type"] == "BPE" and not made.get("normalizer") and not made["model"].get("dropout") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t["content"] for t in made.get("added_tokens") or () if t["content"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces not seen yet."""
        plain = [p for p in pieces if self._PLAIN.match(p)]
        shown = "\n".join(plain).encode().decode("latin-1").translate(self.shown).split(self.shown[10])
        tokens = [self.model.tokenize(s) for s in shown] if plain else []
        ids = np.array([t.id for ts in tokens for t in ts], "<u4").tobytes()
        ends = [0, *accumulate(4 * len(ts) for ts in tokens)]
        got = dict(zip(plain, (ids[a:b] for a, b in pairwise(ends)), strict=True))
        out = [got[p] if p in got else self._whole(p) for p in pieces]
        if len(self.known) + len(pieces) > self.REMEMBERED:
            self.known.clear()
        for piece, i in zip(pieces[: self.REMEMBERED], out, strict=False):
            if len(piece) <= 64:
                self.known[piece] = i
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all(pa.array([text])))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, null ones as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.cuts:
            yield from (self._whole(t.as_py()) for t in texts)
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.SLICE, "right")))
            yield from self._slice(texts[at:to])
            at = to

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        first, end = int(bounds[0]), int(bounds[-1])
        if first == end:
            yield from (b"" for _ in range(len(texts)))
            return
        bounds, data = bounds - first, texts.buffers()[2].slice(first, end - first)
        offsets = _cuts(np.frombuffer(data, np.uint8), bounds)
        pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data).dictionary_encode()
        index = pieces.indices.to_numpy()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        edges = np.searchsorted(offsets, bounds)  # the pieces of each text

        found = [self.known.get(p) for p in names]
        missing = [i for i, ids in enumerate(found) if ids is None]
        odd = np.zeros(len(names), bool)
        odd[[i for i in missing if names[i] != "\n" and self._ODD.search(names[i])]] = True
        by_text = _odd_ends(np.frombuffer(data, np.uint8), bounds)
        for added in self.added:
            by_text |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        if odd.any():
            sums = np.concatenate([[0], np.cumsum(odd[index])])
            by_text |= sums[edges[1:]] > sums[edges[:-1]]
        if by_text.any():
            needed = np.bincount(index[np.repeat(~by_text, np.diff(edges))], minlength=len(names)) > 0
            missing = [i for i in missing if needed[i]]
        for i, ids in zip(missing, self._new([names[i] for i in missing]), strict=True):
            found[i] = ids
        ids = pa.array([i or b"" for i in found], pa.large_binary()).take(pa.array(index))
        stops = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset :][edges].tolist()
        out = memoryview(ids.buffers()[2] or b"")
        for t, a, b in zip(range(len(texts)), stops, stops[1:], strict=False):
            yield self._whole(texts[t].as_py()) if by_text[t] else bytes(out[a:b])


#: Bytes that are white space or control characters, ASCII letters, marks (no apostrophe), second bytes of two-byte characters.
_LOW, _LETTER, _MARK, _SECOND = (np.array([bool(re.fullmatch(p, bytes([b]))) for b in range(256)]) for p in (rb"[\x00-\x20\x7f]", rb"[A-Za-z]", rb"[!-&(-/:-@\[-`{-~]", rb"[\x80-\xbf]"))


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin, and the end: at each text and each space, around lone line breaks, before marks after letters."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    cut[:n] |= data == 32
    lines = np.flatnonzero(data == 10)
    lines = lines[(lines > 1) & (lines < n - 1)]
    before, lead, after = data[lines - 1], data[lines - 2], data[lines + 1]
    dense = ~_LOW[before] & (before < 128) | _SECOND[before] & (lead >= 0xC3) & (lead < 0xE0)
    lone = lines[dense & (~_LOW[after] & (after < 128) | (after >= 0xC3) & (after < 0xE0))]
    cut[lone] = True
    cut[lone + 1] = True
    marks = np.flatnonzero(_MARK[data])
    marks = marks[marks > 1]
    before, lead = data[marks - 1], data[marks - 2]
    wide = _SECOND[before] & ((lead == 0xC3) & (before != 0x97) & (before != 0xB7) | (lead > 0xC3) & (lead < 0xC9))
    cut[marks[_LETTER[before] | wide]] = True
    return np.flatnonzero(cut)


def _odd_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text begins or ends with a space or control character."""
    some = np.diff(bounds) > 0
    out = np.zeros(len(some), bool)
    out[some] = _LOW[data[bounds[:-1][some]]] | _LOW[data[bounds[1:][some] - 1]]
    return out


def encoder(tokenizer_json: str) -> Encoder:
    """This worker's encoder."""
    return worker_state(f"encoder-{zlib.crc32(tokenizer_json.encode())}", lambda: Encoder(tokenizer_json))


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, *, key_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, vocabulary: int | None = None, files: int | None = None) -> list[dict]:
    """Encodes whole texts and writes their ids in ascending key order below path.

    There are `files` files, or as many as keep each at about FILE_TEXT_BYTES of text
    (spark.sql.shuffle.partitions at least). Returns the manifest, a dict(file, docs,
    ids, start) for each file in order.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key_col].dataType, IntegralType):
        raise ValueError(f"{key_col} must hold integers")
    given = spark.sparkContext.broadcast(tokenizer_json)
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab_size()
    n = files
    if n is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text_col])), F.lit(0)).alias("b")).first()["b"]
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_TEXT_BYTES))
    rows = docs.select(docs[key_col].cast("long").alias("key"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(given.value).encode_all
        part, out = TaskContext.get().partitionId(), None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                out = out or Writer(f"{path}/part-{part:06d}.ids", vocabulary)
                out.add(key, np.frombuffer(ids + end, "<u4"))
        if out:
            docs_n, ids_n = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs_n], "ids": [ids_n]})

    manifest, start = [], 0
    for r in sorted(rows.mapInArrow(write, "part long, docs long, ids long").collect()):
        manifest.append({"file": f"{path}/part-{r.part:06d}.ids", "docs": r.docs, "ids": r.ids, "start": start})
        start += r.ids
    return manifest


def read_ids(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """READ of each document of the files: its first id, ids and their crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = [(key, manifest[i]["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in Reader(manifest[i]["file"]).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(read, READ)
