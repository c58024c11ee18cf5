"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A text's set holds the hashes of its runs of five words (one run of all words if
there are fewer). Texts with equal sets form one node with its number of copies.
A node's signature has `depth` MinHash values in each of `trees` prefix tries: a
trie's node at level d stands for all signatures that begin with the same d values.

Two nodes of similarity s share a prefix of d values in some tree with probability
1 - (1 - s**d)**trees. Each node starts with its whole signatures and shortens the
prefixes that it matches, level by level, until that estimate reaches the target
recall for the least similarity that any partner of it can have: the threshold for
most, more for small sets, whose similarities are few (4/5, 5/6, 6/7 ...), and sets
too small to have a partner don't search at all. A pair needs the longer of its two
prefixes. Levels of the tries are counted by partial sums, so a branch that holds
much of the corpus is no task's burden. Branches with the same members as one in an
earlier tree are left out.

Candidates are verified where they meet, and no pair becomes a row. A task gets
the sets of a branch, or of two blocks of a large branch, settles the pairs that
no earlier tree has brought together (so each pair counts once), and returns
a row per linked node: its links and one link of a spanning forest.
Classes are the connected components of all links.

Result: one row per document with its class (the least id in it), the number
of its copies and of its links: other documents of similarity `threshold` or more,
equal ones included. With the default 20 trees a pair just at 0.8 is
missed with probability 3e-5, closer ones with less.

Defined results: null texts and texts without words have no set: a class of
their own and no links; so has every document of an empty or one-row table.
Rows that repeat a document are documents of their own that are equal.
Columns besides key and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .decontaminate import slices
from .shared import hot_join, worker_state, written
from .words import U64, grams, mix, owners, word_hashes

#: Candidate nodes up to which their list is sent to all tasks (about 40 bytes each).
BROADCAST_NODES = 400_000
#: Nodes of a large group that meet in one task: two blocks of about so many.
BLOCK = 256


@dataclass(frozen=True)
class Forest:
    words: int = 5
    threshold: float = 0.8
    trees: int = 20
    depth: int = 8
    recall: float = 0.9999
    seed: int = 20240229

    def least(self, size: int) -> float:
        """The least similarity, of the threshold at least, that a set of this size can have with another; 0 for none."""
        if size > self.smallest_usual():
            return self.threshold
        t, found = self.threshold - 1e-9, []
        for common in range(1, size + 1):
            other = int(common / t + common - size)  # the largest set for which it is enough
            other = other if (common, other) != (size, size) else other - 1
            if other >= common and common / (size + other - common) >= t:
                found.append(common / (size + other - common))
        return min(found, default=0.0)

    def smallest_usual(self) -> int:
        """Sets above this size can come as close to the threshold as makes no difference."""
        return int(4 / (1 - self.threshold + 1e-9) ** 2)

    def stop(self, size: int) -> int:
        """Values of the prefix at which a node of this size stops shortening; 0 if it needs no search."""
        return self._stops().get(size, self._stops()[0]) if size else 0

    def _stops(self) -> dict[int, int]:
        """stop() by size; 0: of all larger sizes."""
        return _stops(self)

    def levels(self, size: int) -> list[int]:
        """Levels at which a node of this size meets partners: the longer prefix of each pair counts."""
        mine = self.stop(size)
        if not mine:
            return []
        t = self.threshold - 1e-9
        partners = {self.stop(n) for n in range(max(1, int(size * t)), min(int(size / t), size + 2 * self.smallest_usual()) + 1)}
        return sorted({max(mine, p) for p in partners if p})

    def multipliers(self) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return rng.integers(0, 2**31, size=(self.trees, self.depth), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    @property
    def width(self) -> int:
        """Values of a path as stored, in whole 64-bit words."""
        return -(-self.depth // 4) * 4


@cache
def _stops(forest: Forest) -> dict[int, int]:
    def shortened(similarity: float) -> int:
        d = forest.depth
        while d and 1 - (1 - similarity**d) ** forest.trees < forest.recall:
            d -= 1
        if not d:
            raise ValueError("more trees are needed for this recall")
        return d

    least = {n: forest.least(n) for n in range(1, forest.smallest_usual() + 1)}
    return {0: shortened(forest.threshold)} | {n: shortened(s) if s else 0 for n, s in least.items()}


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of all texts, and the bounds of each text's."""
    h, bounds = word_hashes(texts)
    length = np.diff(bounds)
    own, g = owners(bounds), grams(h, n)
    inside = own[: len(g)] == own[n - 1 :] if len(g) else np.zeros(0, bool)
    out, who = [g[inside]], [own[: len(g)][inside]]
    for m in range(1, n):
        first = bounds[:-1][length == m]
        if len(first):
            out.append(mix(grams(h, m)[first] + U64(m)))
            who.append(np.flatnonzero(length == m))
    values, who = np.concatenate(out), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return values[order], np.searchsorted(who[order], np.arange(len(texts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, forest: Forest) -> np.ndarray:
    """Text x tree x level: 16 bits of each MinHash value; texts must have shingles."""
    out = np.zeros((len(bounds) - 1, forest.trees, forest.width), np.uint16)
    x = (values >> U64(32)).astype(np.uint32)
    for t, row in enumerate(forest.multipliers()):
        for level, a in enumerate(row):
            least = np.minimum.reduceat(x * a, bounds[:-1])
            out[:, t, level] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def prefixes(paths: np.ndarray, level: int) -> np.ndarray:
    """For each node and tree one number for the first `level` values."""
    kept = paths.copy()
    kept[:, :, level:] = 0
    words = kept.view(U64)
    out = words[:, :, 0]
    for i in range(1, words.shape[2]):
        out = mix(out) + words[:, :, i]
    return out


def _sketch(docs: DataFrame, forest: Forest) -> DataFrame:
    """key, text_hash, node (null without words), size of its set, and paths of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ngrams", dict)  # nothing of another operator stays in the worker
        for batch in batches:
            for first, part in slices(batch.column(2).to_pylist()):
                values, bounds = shingles(part, forest.words)
                full = np.flatnonzero(np.diff(bounds))
                nodes: list = [None] * len(part)
                paths: list = [None] * len(part)
                sizes: list = [None] * len(part)
                if len(full):
                    found = signatures(values, np.append(bounds[:-1][full], bounds[-1]), forest)
                    for i, row in zip(full.tolist(), found, strict=True):
                        own = np.unique(values[bounds[i] : bounds[i + 1]])
                        nodes[i], sizes[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own)
                        paths[i] = row.astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(paths, pa.binary())], names=["key", "text_hash", "node", "size", "paths"])

    return docs.select("key", "text_hash", "text").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, text_hash long, node binary, size long, paths binary")


def _sets(docs: DataFrame, forest: Forest) -> DataFrame:
    """node and its sorted set of shingles, for documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1).to_pylist()):
                values, bounds = shingles(part, forest.words)
                sets = [np.unique(values[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node binary, shingles binary")


def _meet(tree: int, level: int, across: bool, rows: list[tuple], forest: Forest) -> list[tuple[bytes, bytes, int]]:
    """node, a node of its class, weight of its links, for the linked nodes of a block.

    rows: node, copies, paths, shingles and side; `across`: only pairs of different sides count.
    """
    rows, threshold = sorted({r[0]: r for r in rows}.values()), forest.threshold
    m = len(rows)
    paths = prefixes(np.stack([np.frombuffer(r[2], "<u2") for r in rows]).reshape(m, forest.trees, forest.width), level)
    side = np.array([r[4] for r in rows])
    size = np.array([len(r[3]) // 8 for r in rows])
    stop = np.array([forest.stop(int(n)) for n in size])
    new = np.zeros((m, m), bool)
    for i in range(m - 1):
        j = slice(i + 1, m)
        ok = (paths[j, tree] == paths[i, tree]) & (np.maximum(stop[j], stop[i]) == level)
        if tree:
            ok &= ~(paths[j, :tree] == paths[i, :tree]).any(axis=1)
        if across:
            ok &= side[j] != side[i]
        # sets of too different sizes can't be similar enough
        ok &= np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]) - 1e-9
        new[i, j] = ok
    a, b = np.nonzero(new)
    if not len(a):
        return []
    used = np.unique(np.concatenate([a, b]))
    sets = {i: np.frombuffer(rows[i][3], "<u8") for i in used.tolist()}
    common = _dense(sets, used, a, b) if len(a) > 8 * len(used) else np.array([_both(sets[i], sets[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    linked = common >= threshold * (size[a] + size[b] - common) - 1e-9
    a, b = a[linked].tolist(), b[linked].tolist()
    root, weight = list(range(m)), [0] * m

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(a, b, strict=True):
        weight[i] += rows[j][1]
        weight[j] += rows[i][1]
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [(rows[i][0], rows[find(i)][0], weight[i]) for i in range(m) if weight[i]]


def _both(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _dense(sets: dict[int, np.ndarray], used: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int = 1 << 22, at_once: int = 1 << 20) -> np.ndarray:
    """Common values of many pairs, by products of 0/1 matrices over stretches of values.

    The hashes are taken range by range, about `at_once` of them at a time.
    """
    listed = [sets[i] for i in used.tolist()]
    total = np.zeros((len(used), len(used)), np.float32)
    ranges = -(-sum(map(len, listed)) // at_once)
    edges = np.array([(i << 64) // ranges for i in range(ranges)], U64)
    cuts = [np.append(np.searchsorted(x, edges), len(x)) for x in listed]
    step = max(1, cells // len(used))
    for r in range(ranges):
        parts = [x[c[r] : c[r + 1]] for x, c in zip(listed, cuts, strict=True)]
        _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(used)), list(map(len, parts)))
        shared = times > 1
        row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(shared.sum()), step):
            part = slice(*np.searchsorted(column, [lo, lo + step]))
            cell = np.zeros((len(used), step), np.float32)
            cell[row[part], column[part] - lo] = 1
            total += cell @ cell.T
    at = np.searchsorted(used, np.stack([a, b]))
    return total[at[0], at[1]].astype(np.int64)


def similar(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest(), block: int = BLOCK, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """key_col, class_id, n_copies, n_links, text_hash (xxhash64 of the text) and
    class_node (a digest, null without words) of each row of docs."""
    docs = docs.select(docs[key_col].alias("key"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    sketch = written(_sketch(docs, forest), "ngram-sketch")
    nodes = sketch.where("node is not null").groupBy("node", "size", "paths").agg(F.min(F.struct("key", "text_hash")).alias("first"), F.min("key").alias("least_key"), F.count("*").alias("copies"))
    nodes = written(nodes, "ngram-nodes")
    usual = F.lit(forest.levels(4 * forest.smallest_usual()))
    by_size = [forest.levels(n) for n in range(1, 3 * forest.smallest_usual() + 1)]
    levels = F.when(F.col("size") <= len(by_size), F.get(F.from_json(F.lit(json.dumps(by_size)), "array<array<int>>"), F.col("size").cast("int") - 1)).otherwise(usual)
    entries = nodes.select("node", "paths", F.explode(levels).alias("level"))
    bytes_of_tree = 2 * forest.width
    branch = F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.xxhash64(F.substring("paths", t * bytes_of_tree + 1, F.col("level") * 2)))
    branches = entries.select("node", "level", F.posexplode(branch).alias("tree", "prefix"))
    sums = [F.sum(F.shiftright(F.xxhash64("node", F.lit(i)), 24)).alias(f"members_{i}") for i in range(2)]
    groups = branches.groupBy("tree", "level", "prefix").agg(F.count("*").alias("n"), *sums, F.min("node").alias("least")).where("n > 1")
    groups = groups.groupBy("level", "n", "members_0", "members_1", "least").agg(F.min(F.struct("tree", "prefix")).alias("g")).select("g.tree", "level", "g.prefix", "n")
    members = written(branches.join(groups, ["tree", "level", "prefix"]), "ngram-members")

    wanted = written(members.select("node").distinct().join(nodes, "node"), "ngram-wanted")
    pick = wanted.select("node", F.col("first.key").alias("key"), F.col("first.text_hash").alias("text_hash"))
    few = wanted.count() <= broadcast_nodes
    pick = F.broadcast(pick) if few else pick.hint("merge")
    texts = docs.join(pick, docs["key"].eqNullSafe(pick["key"]) & (docs["text_hash"] == pick["text_hash"])).select("node", "text").dropDuplicates(["node"])
    sets = wanted.select("node", "copies", "paths").join(_sets(texts, forest), "node")

    own = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / block)).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
    block_id = ["tree", "level", "prefix", "lo", "hi"]
    dealt = dealt.select("tree", "level", "prefix", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node")
    met = dealt.join(sets, "node").repartition(*map(F.col, block_id)).sortWithinPartitions(*block_id)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["a", "b", "weight"])

        here, rows, out = None, [], []
        for batch in batches:
            for *block_id, side, node, copies, paths, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block_id != here:
                    if len(rows) > 1:
                        out += _meet(here[0], here[1], here[3] != here[4], rows, forest)
                    here, rows = block_id, []
                rows.append((node, copies, paths, values, side))
            yield result(out)
            out = []
        if len(rows) > 1:
            yield result(_meet(here[0], here[1], here[3] != here[4], rows, forest))

    links = written(met.select(*block_id, "own", "node", "copies", "paths", "shingles").mapInArrow(verify, "a binary, b binary, weight long"), "ngram-links")
    weights = links.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("weight"))
    linked = nodes.select("node", "copies", "least_key").join(weights, "node").join(components(links.select("a", "b")), "node")
    linked = written(linked, "ngram-linked")
    ids = linked.groupBy("root").agg(F.min("least_key").alias("class_id"), F.count("*").alias("n"))
    linked = hot_join(linked, ids, "root", linked.count()).select("node", "root", "class_id", "weight")
    of_node = nodes.select("node", "copies", "least_key").join(linked, "node", "left")
    of_node = of_node.select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("least_key")).otherwise(F.col("class_id")).alias("class_id"), F.col("copies").alias("n"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))
    of_node = written(of_node, "ngram-of-node")
    full = hot_join(sketch.where("node is not null").select("key", "text_hash", "node"), of_node, "node", of_node.agg(F.sum("n").alias("n")).first()["n"] or 0)
    none = sketch.where("node is null").select("key", "text_hash", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("binary").alias("class_node"))
    full = full.select("key", "text_hash", F.coalesce("class_id", "key").alias("class_id"), F.col("n").alias("n_copies"), F.col("n_links").cast("long").alias("n_links"), F.col("root").alias("class_node"))
    out = full.unionByName(none)
    return out.select(F.col("key").alias(key_col), "class_id", "n_copies", "n_links", "text_hash", "class_node")


def one_of_each(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest(), broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """docs without near duplicates: of each class the document of the least id stays, and one row of it.

    Documents without words stay; rows that repeat an id and its text stay once.
    """
    found = written(similar(docs, key_col=key_col, text_col=text_col, forest=forest), "ngram-classes")
    least = found.where(F.col("class_node").isNotNull() & F.col(key_col).eqNullSafe(F.col("class_id"))).groupBy("class_node").agg(F.min(F.struct(F.col(key_col).alias("k"), "text_hash")).alias("d"))
    rows = found.groupBy(F.col(key_col).alias("_key"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_rows"), F.max("class_node").alias("_node"))
    chosen = least.select(F.col("d.k").alias("_key"), F.col("d.text_hash").alias("_hash"), F.col("class_node").alias("_node"))
    same = rows["_key"].eqNullSafe(least["d.k"]) & (rows["_hash"] == least["d.text_hash"]) & (rows["_node"] == least["class_node"])
    chosen = rows.where("_node is null").unionByName(rows.join(least, same).select(*rows.columns)).select("_key", "_hash", "_rows")
    chosen = written(chosen, "ngram-kept")
    few = chosen.count() <= broadcast_nodes
    pick = F.broadcast(chosen) if few else chosen.hint("merge")
    out = docs.join(pick, docs[key_col].eqNullSafe(pick["_key"]) & (F.xxhash64(docs[text_col]) == pick["_hash"]), "left_semi")
    return out if chosen.where("_rows > 1").isEmpty() else out.dropDuplicates([key_col, text_col])
