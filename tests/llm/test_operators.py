"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecstrata.llm import decontaminate as dec
from vecstrata.llm import fingerprints, language_id, licenses, ngram_join, packed_ids, sharding, token_counts, unigram, warc
from vecstrata.llm import sentencepiece_codec as codec
from vecstrata.llm.components import components
from vecstrata.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, key string, size long, shard int, n_links int, entries string, score string, n_hit string, ids string"
LICENCE = "Intro line\nReleased under the MIT License.\nmore text here"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def texts():
    r = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)] + ["über", "Straße", "日本", "don't"]
    said = lambda n: " ".join(r.choice(vocab, n))
    base, long = said(120), said(30_000)
    near = base.split(" ")
    near[60] = "changed"
    far = base.split(" ")
    far[::6] = ["other"] * 20
    out = [base, base, base, " ".join(near), " ".join(far), base.upper() + "!", None, None, "", "   \n\t ", "...", "one", "two words", "two words", "a b c d", "x" * 5000, long, long + " end", LICENCE, "tie tie tie tie tie tie tie tie tie tie tie tie"]
    return out + [said(int(n)) for n in r.integers(1, 200, 25)]


@pytest.fixture(scope="module")
def rows():
    found = [(i * 3, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts())]
    return found + [found[0], found[3], (None, "row without an id", "en"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    filler = ("k", 1, 2, 3, "e", "s", "h", "i")
    return spark.createDataFrame([r + filler for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pieces():
    return unigram.load_pieces(tokenizer_path("piece_bpe_32k.model"))


def test_ngram_join(spark, rows, docs):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else None for _, t, _ in rows]
    near = lambda a, b: a is not None and b is not None and len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(rows))]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted(repr((rows[i][0], least[group[i]], max(1, sets.count(sets[i]) if sets[i] else 1), len(links[i]))) for i in range(len(rows)))
    for options in ({}, {"block": 1, "broadcast_nodes": 0}):
        got = ngram_join.similar(docs, **options).select("doc_id", "class_id", "n_copies", "n_links").collect()
        assert sorted(repr(tuple(r)) for r in got) == want
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    full = [i for i in range(len(rows)) if sets[i] is not None]
    assert collections.Counter(r["doc_id"] for r in kept.where("text is not null").collect() if words(r["text"])) == collections.Counter({least[group[i]] for i in full})
    assert ngram_join.similar(docs.where("false")).count() == 0 == ngram_join.one_of_each(docs.where("false")).count()


def test_ngram_join_large_group(spark):
    r = np.random.default_rng(3)
    base, rows = [f"v{i}" for i in range(100)], []
    for i in range(90):
        w = list(base)
        for at in r.integers(0, 100, 2):
            w[at] = f"e{r.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in (t.split(" ") for _, t in rows)]
    links = [sum(j != i and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (16, 256):
        got = {x["doc_id"]: x["n_links"] for x in ngram_join.similar(df, block=block).collect()}
        assert sum(abs(got[i] - links[i]) for i in range(90)) <= 0.01 * sum(links)  # pairs near 0.8 may be missed, very rarely


def test_forest_shortens_until_the_recall_is_reached():
    f = ngram_join.Forest()
    for n in range(1, 300):
        best = min((c / (n + m - c) for m in range(1, 2 * n + 2) for c in range(1, min(n, m) + 1) if (n, n) != (m, c) and c / (n + m - c) >= 0.8 - 1e-9), default=0.0)
        assert f.least(n) == pytest.approx(best) or (n > 100 and f.least(n) == 0.8 <= best)
        d = f.stop(n)
        assert (d == 0) == (best == 0) and (not d or 1 - (1 - best**d) ** 20 >= 0.9999 and (d == 8 or 1 - (1 - f.least(n) ** (d + 1)) ** 20 < 0.9999))
        # each pair meets at the longer of its two prefixes
        assert all(max(f.stop(n), f.stop(m)) in f.levels(n) for m in range(1, 400) if d and f.stop(m) and min(n, m) >= 0.8 * max(n, m) - 1e-9)
    assert [f.stop(n) for n in (1, 3, 4, 6, 7, 1000)] == [0, 0, 4, 5, 6, 4]
    assert ngram_join.Forest(recall=0.9).stop(1000) == 8
    with pytest.raises(ValueError, match="more trees"):
        ngram_join.Forest(trees=1).stop(50)


def test_forest_recall_is_what_it_promises():
    """Pairs of known similarity meet as often as the estimate says."""
    r = np.random.default_rng(1)
    for forest, s in ((ngram_join.Forest(trees=3, depth=4, recall=0.1), 0.8), (ngram_join.Forest(trees=6, depth=8, recall=0.5), 0.9)):
        common, met = 180, 0
        each = round(common * (1 - s) / s / 2)
        for _ in range(300):
            x = r.integers(0, 2**63, common + 2 * each, dtype=np.uint64)
            pair = np.concatenate([x[: common + each], x[:common], x[common + each :]])
            p = ngram_join.prefixes(ngram_join.signatures(pair, np.array([0, common + each, len(pair)]), forest), forest.stop(common + each))
            met += bool((p[0] == p[1]).any())
        true = common / (common + 2 * each)
        assert abs(met / 300 - (1 - (1 - true ** forest.stop(common + each)) ** forest.trees)) < 0.1


def test_components(spark):
    r = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100)] + [(200, 200 + int(x)) for x in r.integers(1, 50, 40)] + [(3, 0), (0, 3)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: (0 if n < 100 else 100 if n == 100 else 200) for e in edges for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts_and_codec(docs, rows, pieces):
    counted = token_counts.token_counts(docs.select("doc_id", "text", "key"), pieces)
    assert counted.columns == ["doc_id", "key", "n_pieces", "n_tokens"]
    made = codec.round_trips(docs, pieces, ids_col="ids").collect()
    assert len(made) == len(rows) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in made)
    assert sorted(str((r["doc_id"], r["n_ids"])) for r in made) == sorted(str((r["doc_id"], r["n_tokens"])) for r in counted.collect())
    back = codec.decode(codec.encode(docs, pieces), pieces, text_out="score").select("text", "score").collect()
    assert all((r["text"] or "") == r["score"] for r in back) and len(back) == len(rows)
    none = docs.where("false")
    assert token_counts.token_counts(none, pieces).count() + codec.round_trips(none, pieces).count() + codec.decode(codec.encode(none, pieces), pieces).count() == 0


def test_licenses(spark, docs):
    found = {r["doc_id"]: r for r in licenses.scan(docs.withColumn("licenses", F.lit("x"))).collect()}
    assert found[54]["licenses"] == "MIT" and found[54]["n_rules"] == 1 and sum(bool(r["licenses"]) for r in found.values()) == 1
    s = licenses.SENTENCES
    mit = "\n\n".join([s["mit-grant"][0] + ":", s["mit-notice"][0] + ".", s["mit-warranty"][0] + ". " + s["mit-liability"][0] + "."])
    wrapped = re.sub(r"(.{50,70}) ", r"\1\n", mit)
    bsd = ".\n".join(s[n][0] for n in ("bsd-conditions", "bsd-source", "bsd-binary"))
    cases = [
        (mit, "MIT"), (wrapped, "MIT"), (bsd, "BSD-2-Clause"), (bsd + ".\n" + s["bsd-names"][0], "BSD-3-Clause"), ("\n".join(reversed(bsd.split("\n"))), ""),
        ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC-4.0,LicenseRef-all-rights-reserved"),
        ("this work is licensed under the gnu general public licence, version 3", "GPL-3.0-only"), ("text. Released under the MIT License. text", "MIT"), ("Released under the MIT License or so", ""), (mit.split("\n\n")[1], ""), (None, ""), ("", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan(df).orderBy("doc_id").collect()] == [w for _, w in cases]
    apache = "Copyright 2020 A\n\n" + s["apache-notice"][0].replace("; ", ";\n") + ".\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + s["apache-warranty"][0].replace("software ", "software\n") + ".\nSee the License for more."
    hashed = "\n".join(f"# {x}".rstrip() for x in apache.split("\n"))
    zlib_ = ".\n\n".join(s[n][0] for n in ("zlib-warranty", "zlib-damages", "zlib-grant"))
    more = [
        (wrapped, "MIT", 1, "<mit-grant><mit-notice><mit-warranty><mit-liability>"), (apache, "Apache-2.0", 1, "<apache-notice><apache-at><apache-url><apache-warranty>"), (hashed, "Apache-2.0", 1, "<apache-notice><apache-at><apache-url><apache-warranty>"),
        ("Copyright (c) 2020, A. All rights reserved.\n\n" + bsd, "BSD-2-Clause", 1, None), ("// SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache-2.0,MIT", 2, "<spdx-apache-2.0><spdx-mit>"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later", 1, None), ("SPDX-License-Identifier: LGPL-2.1-or-later AND (MIT OR Zlib)", "LGPL-2.1-or-later,MIT,Zlib", 3, None),
        ("This project is licensed under the terms of the MIT license.", "MIT", 1, "<mit-short>"), (zlib_, "Zlib", 1, None), ("All rights reserved", "LicenseRef-all-rights-reserved", 1, "<all-rights>"), (s["agpl3-later"][0].replace(" ", "\n", 9) + ".", "AGPL-3.0-or-later", 1, None),
    ]
    told = licenses.scan(spark.createDataFrame([(i, x[0]) for i, x in enumerate(more)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["licenses"], r["n_rules"], x[3] and r["sentence_ids"]) for r, x in zip(told, more, strict=True)] == [x[1:] for x in more]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, x[0]) for i, x in enumerate([*more, *cases])])
    asked = con.execute(f"SELECT doc_id, licenses, n_rules, sentence_ids FROM ({licenses.oracle_sql()}) ORDER BY doc_id").fetchall()
    every = licenses.scan(spark.createDataFrame([(i, x[0]) for i, x in enumerate([*more, *cases])], "doc_id long, text string")).orderBy("doc_id")
    assert [tuple(r) for r in every.select("doc_id", "licenses", "n_rules", "sentence_ids").collect()] == asked
    with pytest.raises(ValueError, match="one sentence"):
        licenses.scan(df, known={"a": ["First. Second."]}, rules=[(("a",), "X")])
    own = licenses.scan(df, known={"a": ["Text"], "b": ["released under the mit license"]}, rules=[(("a", "b", "a"), "X")])
    assert [r["licenses"] for r in own.orderBy("doc_id").collect()][8] == "X"
    assert licenses.scan(df.where("false")).count() == 0


def test_language_id(spark, docs, rows):
    r = np.random.default_rng(2)
    vocab = {"aa": ["red", "green", "blue", "house"], "bb": ["rouge", "vert", "bleu", "maison"], "cc": ["rot", "grün", "blau", "haus"]}
    said = [(i, " ".join(r.choice(vocab[lang], 12)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    model = language_id.fit(spark.createDataFrame(said, "doc_id long, text string, lang string"))
    got = language_id.identify(spark.createDataFrame([(0, "RED house"), (1, "maisons vertes"), (2, "Grünhaus rot"), (3, None), (4, "123 !?"), (5, "")], "doc_id long, text string"), model)
    found = [tuple(x) for x in got.orderBy("doc_id").select("lang_pred", "score").collect()]
    assert [f[0] for f in found] == ["aa", "bb", "cc", "und", "und", "und"] and all(0 <= f[1] <= 1 for f in found) and found[5][1] == 0
    assert language_id.Scorer(model).predict("red " * 120_000 + "rouge") [0] == "aa"
    assert model.word("unseenword") == model.word("unseenword") and len(model.word("日")) == 3
    own = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(own) == len(rows) and all((x["lang_pred"] == "und") == (not any(c.isalpha() for c in x["text"] or "")) for x in own)
    none = language_id.fit(docs.where("false"))
    assert {tuple(x) for x in language_id.identify(docs, none).select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}
    assert language_id.identify(docs.where("false"), model).count() == 0


def plain_score(model, text):
    """The language and score by the definition, one word and one n-gram at a time."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0
    sums = []
    for k in range(len(model.langs)):
        total = 0.0
        for w in words:
            if w in model.words:
                total += model.words[w][k]
                continue
            s, free, seen = f"<{w}>", [True] * (len(w) + 2), []
            for n in range(model.max_n, 0, -1):
                i = 0
                while i + n <= len(s):
                    if all(free[i : i + n]) and s[i : i + n] in model.grams:
                        seen.append(model.grams[s[i : i + n]][k])
                        free[i : i + n] = [False] * n
                        i += n
                    else:
                        i += 1
            total += sum(seen) / len(seen) if seen else 0.0
        sums.append(total / len(words))
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    return model.langs[best], 1 / sum(np.exp((x - sums[best]) * min(model.evidence, len(words))) for x in sums)


def test_language_scores_by_the_definition(spark, docs, rows):
    long = "wort" * 100
    model = language_id.fit(docs.select("text", "lang").union(spark.createDataFrame([(f"{long} {long}x", "de")], "text string, lang string")), max_words=150, max_grams=400)
    # n-grams of words of any length are learned, each as often as it occurs
    want = collections.Counter()
    for _, t, lang in {(None, t, lang) for _, t, lang in rows if t and lang == "de"} | {(None, f"{long} {long}x", "de")}:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            want.update(f"<{w}>"[i : i + n] for n in range(1, 5) for i in range(len(w) + 3 - n))
    learned = language_id.fit(docs.select("text", "lang").union(spark.createDataFrame([(f"{long} {long}x", "de")], "text string, lang string")).where("lang = 'de'"), max_grams=10**6)
    total = sum(want.values()) + 0.5 * len(want)
    assert set(learned.grams) == set(want) and all(v == (pytest.approx(np.log((want[g] + 0.5) / total)),) for g, v in learned.grams.items())
    got = language_id.identify(docs, model).select("text", "lang_pred", "score").collect()
    for r in got:
        lang, score = plain_score(model, r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score)


def test_language_scores_are_bounded_in_memory(monkeypatch):
    model = language_id.Model(["a", "b"], words={f"w{chr(97 + i)}": (float(-i), float(i - 30)) for i in range(26)})
    text = " ".join(f"w{chr(97 + i % 26)}" for i in range(300))
    want = language_id.Scorer(model).predict(text)
    monkeypatch.setattr(language_id, "REMEMBERED", 5)
    assert language_id.Scorer(model).predict(text) == want


def pages(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    big = "<html>" + "é" * 200
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (9, "http://a/3", big), (1, "http://b\u2028c\x85", "short"), (2, "http://b", "short"), (4, None, None), (6, "u\r\nX: y", ""), (7, "http://m", fake * 3), (8, "http://m", "WARC/1.0\r\n" + fake + "x" * 300), (None, "http://n", big + "n"), (10, "http://e", "tail WARC/1."), (11, "http://c", "z" * 100_000 + fake + "WARC/1.1\r\n\r\n" * 50)]
    rows += [rows[3], rows[1]]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(2)


@pytest.mark.parametrize("split", ["128m", "100", "5000"])
def test_warc(spark, tmp_path, split):
    rows, df = pages(spark)
    warc.write_warc(df, f"{tmp_path}/w", broadcast_groups=0 if split == "100" else 10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.read_warc(spark, f"{tmp_path}/w", keep_payload=True, block=300 if split == "5000" else warc.BLOCK).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        data, again = (h or "").encode(), i is not None and first.get(h, i) != i
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(first[h]) if again else None, None if again else data))
    number = lambda s: s and (s[len("<urn:page:") : -1] or "None")
    found = [(number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]), None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert {r["url"] for r in got} == {"http://a/1", "http://a/2", "http://a/3", "http://b", "http://b\u2028c\x85", None, "u%0D%0AX: y", "http://m", "http://n", "http://e", "http://c"}


def test_warc_edges(spark, tmp_path):
    _, df = pages(spark)
    warc.write_warc(df.where("false"), f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "junk").write_bytes(b"no record\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    assert warc.read_warc(spark, f"{tmp_path}/junk").count() == 0


def test_warc_long_headers(spark, tmp_path):
    urls = ["http://a", "data:text/html," + "x" * 70_000, "http://b", "http://c/" + " " * 200_000 + "y", "http://d", None]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w", keep_payload=True).collect()
    assert sorted((r["record_id"], r["url"], bytes(r["payload"]).decode()) for r in got) == [(f"<urn:page:{i}>", u, t) for i, u, t in rows]


@pytest.mark.parametrize("broken", [0, 1])
def test_warc_broken_chain(spark, tmp_path, broken):
    parts = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n" for i in range(3)]
    (tmp_path / "good").write_text("".join(parts), newline="")
    assert warc.read_warc(spark, f"{tmp_path}/good").count() == 3
    parts[broken] = parts[broken].replace("Content-Length", "Content-Size")
    (tmp_path / "bad").write_text("".join(parts), newline="")
    with pytest.raises(ValueError, match=f"no record begins at {len(parts[0]) * broken} of "):
        warc.read_warc(spark, f"{tmp_path}/bad").count()


@pytest.mark.parametrize("block", [warc.BLOCK, 100])
def test_warc_damage_is_reported(spark, tmp_path, block):
    """A header without a length, a wrong length, a truncated end and a broken first record: the others come back."""
    record = lambda i, size=None: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(f'text {i}') if size is None else size}\r\n\r\ntext {i}\r\n\r\n"
    parts = [record(i) for i in range(12)]
    parts[3] = parts[3].replace("Content-Length", "Content-Size")
    parts[6], parts[8] = record(6, 9999), record(8, 3)
    parts[11] = parts[11][:-8]
    (tmp_path / "a").write_text("".join(parts), newline="")
    (tmp_path / "b").write_text("WARC/1.1\r\nno length\r\n\r\n" + record(20) + record(21), newline="")
    (tmp_path / "c").write_text(record(30) + record(31), newline="")
    with pytest.raises(ValueError, match="no record begins at"):
        warc.read_warc(spark, str(tmp_path))
    got = warc.read_warc(spark, str(tmp_path), damaged="report", keep_payload=True, block=block).collect()
    good = {(r["record_id"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response"}
    assert good == {(f"<{i}>", f"text {i}") for i in (0, 1, 2, 4, 5, 7, 9, 10, 20, 21, 30, 31)}
    at = np.cumsum([0, *map(len, parts)]).tolist()
    want = {("a", at[i], len(parts[i])) for i in (3, 6, 8, 11)} | {("b", 0, len("WARC/1.1\r\nno length\r\n\r\n"))}
    assert {(r["file"][-1], r["offset"], r["payload_bytes"]) for r in got if r["record_type"] == "damaged"} == want and len(got) == 12 + 5


def test_warc_magic_in_written_fields(spark, tmp_path):
    fields = [("a", "http://a/WARC/1.1"), ("WARC/1.0\r\n", "WARC/1.WARC/1."), ("c", "http://c"), ("d", "http://d/WARC/1.1\r\n\r\nWARC/1.0\r\n"), ("e", "http://e")]
    same = "same text " * 20
    escaped = lambda s: s.replace("\r", "%0D").replace("\n", "%0A").replace("WARC/1.", "%57ARC/1.")
    warc.write_warc(spark.createDataFrame([(i, u, same) for i, u in fields], "page_id string, url string, html string").coalesce(1), f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w").collect()
    first = f"<urn:page:{escaped(fields[1][0])}>"
    assert sorted((r["record_id"], r["url"], r["refers_to"] or first) for r in got) == sorted((f"<urn:page:{escaped(i)}>", escaped(u), first) for i, u in fields)


@pytest.mark.parametrize("split", ["128m", "100"])
def test_warc_magic_in_read_fields(spark, tmp_path, split):
    urls = ["http://a", "http://b/WARC/1.1", "WARC/1.WARC/1.1", "http://c/WARC/1.1/WARC/1.0/x", "http://d", "WARC/1.Content-Length: 3", "Content-Length: 3WARC/1.", "http://e"] + ["http://f/WARC/1.1"] * 20 + ["http://g"]
    payloads = ["text", "", "WARC/1.1\r\nContent-Length: 1", "WARC/1.1\r\nWARC/1.0\r\nx", "\r\n\r\n"]
    want = [(f"<{i}>", u, payloads[i % 5]) for i, u in enumerate(urls)]
    parts = [f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {u}\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(t)}\r\nX: WARC/1.1\r\nY: y\r\n\r\n{t}\r\n\r\n" for i, u, t in want]
    (tmp_path / "w").write_text("".join(parts), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.read_warc(spark, f"{tmp_path}/w", keep_payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["record_id"], r["url"], bytes(r["payload"]).decode()) for r in got) == sorted(want)


def test_packed_ids(spark, docs, rows, tmp_path):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        made = f.read()
    marked = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n<|endoftext|>", "<|endoftext", "plain <|endoftext|>" + " more words" * 50]
    rows = rows + [(1000 + i, t, None) for i, t in enumerate(marked)]
    docs = docs.select("doc_id", "text", "key").union(spark.createDataFrame([(i, t, "k") for i, t, _ in rows[-len(marked) :]], "doc_id long, text string, key string"))
    manifest = packed_ids.write_ids(docs, f"file://{tmp_path}/ids", made, files=3)
    got = packed_ids.read_ids(spark, manifest).orderBy("start").collect()
    encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode  # untouched, as the library gives it
    assert encode(marked[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ends = np.cumsum([0, *(r["n_tokens"] for r in got)]).tolist()
    assert [r["start"] for r in got] == ends[:-1]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    assert packed_ids.read_ids(spark, packed_ids.write_ids(docs.where("false"), f"file://{tmp_path}/none", made)).count() == 0
    with pytest.raises(ValueError, match="integers"):
        packed_ids.write_ids(docs, f"file://{tmp_path}/bad", made, key_col="key")


def winnowed(text):
    """Kept hashes of a text by plain loops over the hashes of its token runs, with positions."""
    import regex

    tokens = regex.findall(fingerprints.TOKENS, (text or "").lower())
    k, w = fingerprints.K, fingerprints.WIDTH
    grams = [tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))] if tokens else []
    return grams, [range(s, min(s + w, len(grams))) for s in range(max(1, len(grams) - w + 1))] if grams else []


def test_fingerprints(spark, docs, rows):
    got = fingerprints.compare(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows)
    for at, (i, t, _) in enumerate(order):
        t = t or ""
        near = {order[(at + d) % len(order)][1] or "" for d in (1, 2) } | {x[1] or "" for x in order if x[0] == i}
        q = len(t) // 4
        edits = {hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest() for n in near}
        assert any(r["n_chars"] == len(t) and r["edited_sha256"] in edits for r in by[i])
    # each window's least hash is kept, the rightmost on ties
    for r in got:
        if len(by[r["doc_id"]]) > 1:
            continue
        grams, windows = winnowed(dict((x[0], x[1]) for x in rows)[r["doc_id"]])
        at = [fingerprints._LAST - (e & fingerprints._LAST) for e in r["entries"]]
        value = {grams[p]: e >> fingerprints.POSITION_BITS for p, e in zip(at, r["entries"], strict=True)}
        assert at == sorted(at) and all(value[grams[p]] == e >> fingerprints.POSITION_BITS for p, e in zip(at, r["entries"], strict=True))
        for w in windows:
            kept = [p for p in at if p in w]
            assert kept and max(kept, key=lambda p: (-value[grams[p]], p)) == max((p for p in w if grams[p] in value), key=lambda p: (-value[grams[p]], p))
    alone = {r["doc_id"]: r for r in fingerprints.compare(docs.where("doc_id = 0").limit(1)).collect()}
    assert alone[0]["near_next"] == 1.0 and fingerprints.compare(docs.where("false")).count() == 0


def test_fingerprints_by_plain_python(spark):
    """Every output of the query, from texts alone: only the hash of a token is taken from Spark."""
    import regex

    base = [f"t{i % 37}x" for i in range(300)]
    cases = [" ".join(base), " ".join(base[:250] + ["new"] * 30), "", None, "one", "Zwei Wörter", "a b c d e f g", "x" * 100 + "!?" * 20, " ".join(base), "tie " * 50]
    rows = [(i * 2, t) for i, t in enumerate(cases)]
    edited = [(t or "")[: len(t or "") - len(t or "") // 4] + (cases[(i + 1) % len(cases)] or "")[: len(t or "") // 4] for i, t in enumerate(cases)]
    tokens = lambda t: regex.findall(fingerprints.TOKENS, t.lower())
    seen = sorted({x for t in [*cases, *edited] for x in tokens(t or "")})
    made = spark.createDataFrame(list(enumerate(seen)), "i int, a string")
    token_hash = {seen[r["i"]]: r["h"] % 2**64 for r in made.select("i", F.xxhash64("a").alias("h")).collect()}

    def rolled(text):
        """The hash of each gram by rolling over the tokens; missing ones count as 0."""
        h = [token_hash[t] for t in tokens(text)]
        h += [0] * (3 - len(h)) if h else []
        out, at = [], 0
        for i, x in enumerate(h):
            at = ((at << 14) ^ x ^ (h[i - 3] << 42 if i >= 3 else 0)) % 2**64
            out += [at >> 28] if i >= 2 else []
        return out

    def kept(text):
        g = rolled(text)
        windows = [range(i, min(i + 4, len(g))) for i in range(max(1, len(g) - 3))] if g else []
        places = sorted({min(w, key=lambda p: (g[p], -p)) for w in windows})
        return [(g[p] << 27) | (2**27 - 1 - p) for p in places], [g[p] for p in places]

    def like(a, b):
        a, b = collections.Counter(kept(a)[1]), collections.Counter(kept(b)[1])
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0

    digest = lambda t: hashlib.sha256(",".join(map(str, kept(t)[0])).encode()).hexdigest()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.compare(df).withColumns({"f": fingerprints.digest(F.col("entries")), "e": fingerprints.digest(F.col("edited_entries"))}).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        t, nxt = cases[i] or "", cases[(i + 1) % len(cases)] or ""
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"], r["f"], r["e"]) == (i * 2, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), digest(t), digest(edited[i]))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(like(t, edited[i])), pytest.approx(like(t, nxt)))


def test_fingerprints_of_other_sizes(spark):
    df = spark.createDataFrame([("a b c d e f",), ("",), (None,), ("a",)], "text string")
    for k, width in ((1, 1), (29, 2)):
        got = [r["n"] for r in df.select(F.size(fingerprints.entries(F.coalesce("text", F.lit("")), k, width)).alias("n")).collect()]
        assert got == [6 if k == 1 else 1, 0, 0, 1]
    for k, width in ((0, 4), (30, 4), (3, 0)):
        with pytest.raises(ValueError, match="k must be"):
            fingerprints.entries(F.col("text"), k, width)


def test_likeness(spark):
    r = np.random.default_rng(4)
    bags = [sorted(r.integers(0, 6, n).tolist()) for n in (0, 1, 5, 9, 20, 20)]
    df = spark.createDataFrame([(a, b) for a in bags for b in bags], "a array<long>, b array<long>")
    for x in df.withColumn("s", fingerprints.likeness(F.col("a"), F.col("b"))).collect():
        a, b = collections.Counter(x["a"]), collections.Counter(x["b"])
        assert x["s"] == pytest.approx(sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0)


def test_fingerprints_many_blocks(spark):
    rows = [(i * 7 % 1009, f"text {i} " * (i % 5 + 1)) for i in range(1009)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spread, window = fingerprints.with_next(df, "doc_id", "text", 100)
    got = {r["doc_id"]: r["n"] for r in spread.withColumn("n", F.lead("text").over(window)).where("_own").collect()}
    order = sorted(rows)
    assert got == {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_sharding(docs, rows, parts):
    got = sharding.shard(docs, parts=parts).collect()
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(range(40)) == set(slots)
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard(docs.where("false")).count() == 0


def test_shards_and_slots_by_plain_python(spark, docs, rows):
    """Shard and slot of every row, from the rows' two keys and the matrix alone."""
    parts, seed = 5, 7
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("t"), F.xxhash64("doc_id", text, F.lit(seed)).alias("a"), F.xxhash64(F.lit(seed), text, "doc_id", F.lit("second")).alias("b"))
    keyed = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("a", "b").orderBy("a")).cast("long") - 1)  # equal rows have keys of their own
    keyed = keyed.withColumns({c: F.when(F.col("copy") == 0, F.col(c)).otherwise(F.xxhash64(c, "copy")) for c in "ab"}).collect()
    by_part = [sorted((r["a"], r["b"], str(r["doc_id"]), r["t"]) for r in keyed if r["a"] % parts == p) for p in range(parts)]
    matrix = sharding.communication_matrix([len(x) for x in by_part], 6, seed)
    shards = [[] for _ in range(6)]
    for own, sent in zip(by_part, matrix, strict=True):
        for s, n in enumerate(sent):
            shards[s], own = shards[s] + own[:n], own[n:]
    want = collections.Counter((i, zlib.crc32(t.encode()), s, slot) for s, x in enumerate(shards) for slot, (_, i, t) in enumerate(sorted((b, i, t) for _, b, i, t in x)))
    got = collections.Counter((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs, shards=6, seed=seed, parts=parts).collect())
    assert got == want


def test_sharding_deals_equal_rows_like_others(spark):
    n = 3 * sharding.COPIES_AT_ONCE + 5
    same = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    other = spark.range(n, 3 * n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = sharding.shard(same.unionByName(other), shards=8, parts=16).collect()
    assert len(got) == 3 * n and len({(r["shard"], r["slot"]) for r in got}) == 3 * n
    for s in range(8):
        at = sorted(r["slot"] for r in got if r["shard"] == s and r["doc_id"] == 7)
        assert abs(len(at) - n / 8) < 6 * (n / 8) ** 0.5  # a third of each shard
        assert abs(sum(b == a + 1 for a, b in zip(at, at[1:])) / len(at) - 1 / 3) < 0.08  # spread inside it


def test_matrix_is_exact_and_uniform():
    counts = [5, 0, 17, 40, 1]
    found = np.array([sharding.communication_matrix(counts, 4, s) for s in range(400)])
    assert (found.sum(axis=2) == counts).all() and (found.sum(axis=1) == [16, 16, 16, 15]).all()
    assert abs(found[:, 2, 0].mean() - 17 * 16 / 63) < 0.25
    r = np.random.default_rng(0)
    big = np.array([sharding.hypergeometric(r, 10**9, 3 * 10**9, 1000) for _ in range(400)])
    assert abs(big.mean() - 250) < 3 and abs(big.std() - 13.7) < 2


def test_decontamination_of_periodic_texts(spark):
    """One word repeated, and short periods: time grows with the texts, not with the pairs of their places."""
    cases = [("a " * 40_000, "a " * 2000), ("a b " * 20_000, "b a " * 1000), ("a b c " * 5000 + "x " + "a b c a " * 500, "c a b " * 300 + "a"), ("p q " * 4, "p q p"), ("z " * 9, "z " * 10), ("z " * 10, "z " * 10)]
    rows = [(i, t, None) for i, (t, _) in enumerate(cases)] + [(9, "m " * 30_000 + "a b c a", None)]
    items = [(i, t) for i, (_, t) in enumerate(cases)]
    began = time.perf_counter()
    index = dec.Index([str(i) for i, _ in items], [t for _, t in items])
    n, hit, found = dec._judge([t.encode() for _, t, _ in rows], index)
    assert time.perf_counter() - began < 20
    want = judged(rows, items)
    assert [(a, b, len(c), hashlib.sha256(",".join(sorted(c)).encode()).hexdigest()) for a, b, c in zip(n.tolist(), hit.tolist(), found, strict=True)] == [x[1:5] for x in want]
    docs, bench = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for local in (0, 10**6):
        assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in dec.decontaminate(docs, bench, max_local_words=local).select("doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == sorted(want)


def judged(rows, items):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(len(w) - min(10, len(w)) + 1) if w else ():
            wins[tuple(w[j : j + 10])].add("null" if i is None else str(i))
    out = []
    for i, t, _ in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if found := wins.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("local", [10**6, 0])
def test_decontamination(spark, docs, rows, local):
    base = texts()[0].split(" ")
    items = [(1, " ".join(base[5:30])), (2, " ".join(base[40:49])), (3, "two words"), (10, " ".join(base[20:31])), (4, None), (5, ""), (6, "tie tie tie tie tie tie tie tie tie tie"), (None, " ".join(base[100:112])), (7, "never seen " * 8), (7, "a b c d"), (8, "...")]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, n_words string")
    added = [c.split()[0] for c in dec.RESULT.split(", ")]
    got = [tuple(r) for r in dec.decontaminate(docs, bench, max_local_words=local).select("doc_id", *added).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, judged(rows, items)))
    none = bench.where("false")
    assert {r["n_hit"] for r in dec.decontaminate(docs, none).collect()} == {0} and dec.decontaminate(docs.where("false"), bench, max_local_words=local).count() == 0
