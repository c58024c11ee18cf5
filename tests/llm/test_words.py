"""Word hashes, shingles, pieces and codecs without Spark, against plain loops."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecstrata.llm import packed_ids, token_counts, unigram, words
from vecstrata.llm import sentencepiece_codec as codec
from vecstrata.llm.packed_ids import Encoder, pack, unpack, width_of
from vecstrata.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXT = st.text(st.sampled_from("abAB z0-.\n\té日😀 ▁'s"), max_size=60)


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words(texts):
    h, bounds = words.word_hashes([t.encode() for t in texts])
    found = [plain(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(f) for f in found]
    flat = [w for f in found for w in f]
    assert len(set(h.tolist())) == len(set(flat)) and len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat))


def test_words_across_chunks(monkeypatch):
    texts = [b"one two three", b"x" * 500, b"", b"a b " * 90, "日本 語".encode()]
    want = words.word_hashes(texts)
    for n in (1, 7, 64):
        monkeypatch.setattr(words, "CHUNK", n)
        got = words.word_hashes(texts)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=4), st.integers(1, 3), st.integers(1, 4))
def test_winnow(docs, k, width):
    h = np.array([v + 1 for d in docs for v in d], np.uint64)
    bounds = np.cumsum([0, *map(len, docs)])
    g = words.grams(h, k)
    kept = set()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for s in range(a, b - k - width + 2):
            kept.add(max(range(s, s + width), key=lambda i: (-int(g[i]), i)))
    assert words.winnow(h, bounds, k, width)[1].tolist() == sorted(kept)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), max_size=200)), np.uint32)
    assert unpack(pack(ids, width), width, len(ids)).tolist() == ids.tolist()


def test_widths():
    assert [width_of(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_file(tmp_path):
    r = np.random.default_rng(0)
    docs = [(i if i % 5 else None, r.integers(0, 1000, n).astype(np.uint32)) for i, n in enumerate((0, 5, 300, 0, 1, 64, 1000))]
    w = packed_ids.Writer(f"file://{tmp_path}/a/x.ids", 1000, block_ids=64)
    for key, ids in docs:
        w.add(key, ids)
    assert w.close() == (7, 1370)
    read = packed_ids.Reader(f"file://{tmp_path}/a/x.ids")
    assert read.width == 10
    for n in (1, 100, 1 << 20):
        assert [(k, ids.tolist()) for k, _, ids in read.documents(n)] == [(k, ids.tolist()) for k, ids in docs]
    flat = np.concatenate([d[1] for d in docs])
    for a, b in ((0, 1), (63, 65), (100, 100), (500, 1370)):
        assert read.ids(a, b).tolist() == flat[a:b].tolist()
    with pytest.raises(ValueError, match="not below"):
        packed_ids.Writer(f"file://{tmp_path}/y.ids", 10).add(1, np.array([10], np.uint32))
    (tmp_path / "cut.ids").write_bytes((tmp_path / "a/x.ids").read_bytes()[:-3])
    with pytest.raises(ValueError, match="whole"):
        packed_ids.Reader(f"file://{tmp_path}/cut.ids")


@pytest.fixture(scope="module")
def bpe():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return Encoder(f.read())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abAB  z0-.,\n\t\ré日😀'sdon't\x1c |<>"), max_size=50))
def test_encoder_equals_the_library(bpe, text):
    want = bpe.whole.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == np.array(want, "<u4").tobytes() == bpe.encode(text)


def test_encoder_forgets(bpe, monkeypatch):
    monkeypatch.setattr(Encoder, "REMEMBERED", 3)
    text = "one two, three four <|endoftext|> five\nsix seven über"
    assert zlib.crc32(bpe.encode(text)) == zlib.crc32(np.array(bpe.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes())


def test_encoder_asks_the_library_once_a_word():
    from types import SimpleNamespace

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        bpe = Encoder(f.read())
    model, asked = bpe.model, []
    bpe.model = SimpleNamespace(tokenize=lambda s: asked.append(s) or model.tokenize(s))
    some = ["erwh", "chèlé", "Éna", "tzte", "ofnt", "pfiß", "thly", "ñon"]
    text = " ".join(f"{a}{mark}\n{b}{mark}" for a in some for b in some for mark in (".", ",$", "..."))
    assert bpe.encode(text) == np.array(bpe.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(asked) <= 2 * len(some) + 4  # with and without a space; line break and marks


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aZ  .,|\n\n\té×ŋɐß日\xa0\x1c'1"), max_size=20) | st.just("<|endoftext|>"), max_size=8), st.sampled_from([1, 20, 1 << 20]))
def test_encoder_of_many_texts(bpe, texts, size):
    bpe.SLICE = size
    want = [np.array(bpe.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(bpe.encode_all(pa.array(["a .", *texts, " "], pa.string())[1:-1])) == want


@pytest.fixture(scope="module")
def pieces():
    return unigram.load_pieces(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coder(pieces):
    return codec.Codec(pieces)


def brute(pieces, text):
    """Best ids by trying all pieces at all places."""
    ids, by = pieces.byte_ids(), {p: (i, s) for i, p, s in pieces.normal()}
    out = []
    for part in text.split(" ") if text else []:
        for t in unigram.segments(part):
            if t == unigram.LITERAL:
                out += [ids[b] for b in unigram.MARK.encode()]
                continue
            best = [(0.0, [])] + [(float("-inf"), None)] * len(t)
            for d in range(1, len(t) + 1):
                for i in range(d):
                    if t[i:d] in by and best[i][0] + by[t[i:d]][1] > best[d][0]:
                        best[d] = (best[i][0] + by[t[i:d]][1], best[i][1] + [by[t[i:d]][0]])
                if t[d - 1] not in by and best[d - 1][0] + pieces.unknown > best[d][0]:
                    best[d] = (best[d - 1][0] + pieces.unknown, best[d - 1][1] + [ids[b] for b in t[d - 1].encode()])
            out += best[-1][1]
    return out


@settings(max_examples=100, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=30)))
def test_viterbi_and_round_trip(pieces, coder, text):
    text = text.encode("utf-8", "ignore").decode()
    data = codec.Worker(coder).encode([text])[0]
    ids = np.frombuffer(data, "<u4")
    assert ids.tolist() == brute(pieces, text)
    assert coder.decode(ids).decode() == text
    counter = token_counts.Counter({p: s for _, p, s in pieces.normal()}, pieces.unknown)
    assert counter.count([text]) == ([len(text.split(" ")) if text else 0], [len(ids)])


def test_workers_forget(pieces, coder, monkeypatch):
    texts = ["one two three", None, "", "x" * 200 + " two", "one two\nthree"] * 3
    want = [codec.Worker(coder).encode([t])[0] for t in texts]
    monkeypatch.setattr(codec, "REMEMBERED", 1)
    monkeypatch.setattr(token_counts, "REMEMBERED", 1)
    worker, counter = codec.Worker(coder), token_counts.Counter({p: s for _, p, s in pieces.normal()}, pieces.unknown)
    for i in range(0, len(texts), 4):
        assert worker.encode(texts[i : i + 4]) == want[i : i + 4]
        assert counter.count(texts[i : i + 4])[1] == [len(w) // 4 for w in want[i : i + 4]]


def test_double_array():
    r = np.random.default_rng(1)
    keys = sorted({bytes(r.integers(0, 256, r.integers(1, 6)).astype(np.uint8)) for _ in range(2000)})
    trie = codec.DoubleArray([(k, i) for i, k in enumerate(keys)])

    def find(key):
        s = 0
        for b in key:
            t = trie.base[s] + b + 1
            if trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"\0\0\0") == -1 for k in keys[:200] if k + b"\0\0\0" not in keys)


def test_decoding_of_special_ids(pieces, coder):
    at = pieces.pieces.index
    assert coder.decode(np.array([at("<s>"), at("▁the"), at("<unk>"), at("</s>")])) == "the ⁇ ".encode()


def test_common_values_of_many_pairs():
    from vecstrata.llm import ngram_join as n

    r = np.random.default_rng(8)
    pool = r.integers(0, 2**64, 300, dtype=np.uint64)
    sets = {i: np.unique(r.choice(pool, r.integers(1, 200))) for i in (0, 2, 3, 7, 9)}
    a, b = np.array([0, 0, 2, 3]), np.array([2, 9, 7, 9])
    want = [n._both(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert want == [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    for cells, at_once in ((1 << 22, 1 << 20), (50, 64), (7, 1000)):
        assert n._dense(sets, np.array(sorted(sets)), a, b, cells, at_once).tolist() == want
