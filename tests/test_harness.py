"""Parity, recall, sources, sinks and the command line."""

import glob
import io

import numpy as np
import pytest

from vecstrata import cli
from vecstrata.errors import RaggedError, SourceError, ZeroDimError
from vecstrata.functions import rng
from vecstrata.operators import parity, recall
from vecstrata.plans.corpus import Corpus, QuerySet
from vecstrata.sources import sinks, synth
from vecstrata.sources.files import load_matrix


def test_binary_parity(spark):
    a = spark.createDataFrame([(0, [0, 0]), (1, [255, 1])], "id long, bit_bytes array<int>")
    b = spark.createDataFrame([(0, [0, 3]), (1, [255, 1])], "id long, bit_bytes array<int>")
    assert tuple(parity.binary_parity(a, b, 16).first()) == (2, 2 / 32, 0.5, 2)
    assert tuple(parity.binary_parity(a.where("false"), b.where("false"), 16).first()) == (0, 0.0, 1.0, 0)
    with pytest.raises(RaggedError):
        parity.binary_parity(a, b.where("id = 0"), 16)


def test_int8_parity(spark):
    a = spark.createDataFrame([(0, [10, -20, 30, -40]), (1, [1, 2, 3, 4])], "id long, codes array<tinyint>")
    b = spark.createDataFrame([(0, [20, -40, 60, -80]), (1, [1, 2, 3, 6])], "id long, codes array<tinyint>")
    found = parity.int8_parity(a, b).first()
    assert (found["vectors"], found["elem_exact_rate"], found["max_abs_diff"]) == (2, 3 / 8, 40)
    assert found["mean_cos_sim"] == pytest.approx((1 + 38 / (30**0.5 * 50**0.5)) / 2)
    assert tuple(parity.int8_parity(a.where("false"), b.where("false")).first()) == (0, 1.0, 0.0, 0, 1.0)


def test_generator(spark):
    for dist in ("gmm", "uniform"):
        a, b = (synth.generate(spark, dist, 50, 128, 8, 7, partitions=p).orderBy("id").collect() for p in (1, 4))
        assert a == b
        x = np.array([r["embedding"] for r in a])
        assert np.allclose((x**2).sum(axis=1), 1, atol=1e-5)
    near = lambda dist: np.sort(np.abs((m := synth.rows(dist, np.arange(60), 256, 3, 0, synth.clusters(3, 4, 256))) @ m.T)[np.triu_indices(60, 1)])[-60:].mean()
    assert near("gmm") > 2 * near("uniform")
    # a row's stream gives the cluster first, then the noise
    state = rng.substream(7, np.array([3]))
    means, sigma = synth.clusters(7, 8, 5)
    c = int(rng.bounded(rng.outputs(state, np.array([0]))[0], 8)[0])
    noise = rng.gaussian(rng.outputs(state, np.arange(1, 7)))[0, :5].astype(np.float32)
    assert np.array_equal(synth.rows("gmm", np.array([3]), 5, 7, 0, (means, sigma))[0], synth.normalize((means[c] + sigma[c] * noise)[None])[0])


def test_normalize_keeps_zero_rows():
    assert synth.normalize(np.array([[0, 0], [3, 4]], np.float32)).tolist() == [[0, 0], [np.float32(3) / np.float32(5), np.float32(4) / np.float32(5)]]


def test_npy_and_raw(spark, tmp_path):
    x = np.arange(1, 601, dtype="<f4").reshape(100, 6)
    np.save(tmp_path / "a.npy", x)
    df, dim = load_matrix(spark, str(tmp_path / "a.npy"), range_bytes=100)
    assert dim == 6 and [r["embedding"] for r in df.orderBy("id").collect()] == x.tolist()
    x.tofile(tmp_path / "raw")
    df, dim = load_matrix(spark, f"file://{tmp_path}/raw", 3)
    assert dim == 3 and df.count() == 200
    with open(tmp_path / "v2.npy", "wb") as f:
        np.lib.format.write_array(f, x, version=(2, 0))
    assert load_matrix(spark, str(tmp_path / "v2.npy"))[1] == 6
    bad = {"be": x.astype(">f4"), "f8": x.astype("<f8"), "fortran": np.asfortranarray(x), "flat": x.reshape(-1), "empty": np.zeros((3, 0), "<f4")}
    for name, a in bad.items():
        np.save(tmp_path / f"{name}.npy", a)
        with pytest.raises((SourceError, ZeroDimError)):
            load_matrix(spark, str(tmp_path / f"{name}.npy"))
    (tmp_path / "short.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-4])
    for path, dim in (("short.npy", None), ("raw", 7), ("raw", None)):
        with pytest.raises(SourceError):
            load_matrix(spark, str(tmp_path / path), dim)


def test_matrix_sizes():
    assert [len(recall.matrix(f, full)) for f, full in (([2, 4, 8], False), ([2, 4, 8], True), ([4], False))] == [23, 26, 11]
    assert recall.Cell("bin sym", "i8", 2).label == "bin sym       -> i8  x2"


def test_recall_arithmetic(spark):
    rows = lambda v: spark.createDataFrame([(0, i, 0.0, r) for r, i in enumerate(v, 1)], "qid long, id long, score float, rank int")
    queries = QuerySet(spark.createDataFrame([(0,)], "id long"), 1)
    for result, want in (([1, 2, 3], 1.0), ([1, 8, 9], 1 / 3), ([7, 8, 9], 0.0), ([3, 1], 2 / 3), ([9, 8, 7, 1], 0.0)):
        assert recall.recall_at_k(rows(result), rows([1, 2, 3]), queries, [3]).first()["recall"] == pytest.approx(want)
    assert recall.recall_at_k(rows([1]), rows([1]).where("false"), queries, [3]).first()["recall"] == 1.0


def test_recall_shape(spark):
    made = [synth.generate(spark, "gmm", n, 64, 8, 5, s) for n, s in ((400, synth.CORPUS_STREAM), (10, synth.QUERY_STREAM))]
    corpus, queries = Corpus(made[0], 64).prepared(), QuerySet(made[1], 64).prepared()
    truth = recall.ground_truth(corpus, queries, 10).persist()
    found = {(r["config"], r["k"]): r["recall"] for r in recall.recalls(corpus, queries, recall.matrix([2, 8]), [10], truth).collect()}
    assert len(found) == len(recall.matrix([2, 8])) and found["f32 (control)", 10] == 1.0
    for coarse in ("bin sym", "bin asym f32q", "bin asym i8q"):
        for store in recall.STORES:
            assert found[recall.Cell(coarse, store, 2).label, 10] <= found[recall.Cell(coarse, store, 8).label, 10]


def test_truth_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(0, 1, 0.5, 1)], "qid long, id long, score float, rank int")

    path = sinks.truth_path(str(tmp_path / "gt"), 0.1)
    assert path.endswith(".s0.1000")
    assert [sinks.load_or_compute_truth(spark, p, params, compute)[1] for p, params in ((path, {"a": 1}), (path, {"a": 1}), (path, {"a": 2}), (None, {"a": 1}))] == [False, True, False, False]
    assert len(calls) == 3
    for part in glob.glob(f"{path}/*/rows/*.parquet"):  # damage behind a readable footer is a miss
        with open(part, "r+b") as f:
            f.seek(4)
            f.write(b"\xff" * 30)
    spark.catalog.clearCache()
    with pytest.warns(UserWarning, match="no ground truth"):
        assert not sinks.load_or_compute_truth(spark, path, {"a": 1}, compute)[1]
    (tmp_path / "file").write_text("")
    with pytest.warns(UserWarning, match="isn't kept"):
        found, cached = sinks.load_or_compute_truth(spark, f"{tmp_path}/file/gt", {}, compute)
    assert not cached and found.count() == 1


def test_cli(spark, tmp_path):
    p = cli.parser()
    assert (p.parse_args([]).k, p.parse_args([]).rerank, p.parse_args([]).dim) == ([10, 100], [2, 4, 8], 1024)
    for wrong in (["--vectors", "x"], ["--k", "0"], ["--rerank", ""], ["--filter", "0"], ["--filter", "1.5"], ["--threads", "0"], ["--gmm-clusters", "0"], ["--n", "0"], ["--dist", "zipf"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code == 2
    assert cli.session(3) is spark
    out = io.StringIO()
    cfg = p.parse_args(["--n", "120", "--dim", "16", "--queries", "4", "--gmm-clusters", "4", "--k", "3", "--rerank", "2", "--filter", "1.0,0.5", "--gt-cache", str(tmp_path / "gt"), "--csv", str(tmp_path / "csv")])
    rows = cli.run(spark, cfg, out)
    assert len(rows) == 2 * 11 and all(r[7] == 1.0 for r in rows if r[1] == "f32 (control)")
    assert "bin sym       -> f32 x2" in out.getvalue() and "recall@3" in out.getvalue()
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert csv.count() == 22 and csv.columns == [c.split()[0] for c in recall.ROW_SCHEMA.split(", ")]
