"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt into `parts` logical partitions by a hash of their content, which
a lost task recomputes alike. The driver counts the partitions and draws how
many rows each sends to each shard: partition by partition a multivariate
hypergeometric draw from the room that is left, so that every shard gets exactly
its size and every outcome of a uniform shuffle is as likely as any other. Each
partition permutes its rows by a random key and deals the first of them to
shard 0, the next to shard 1 and so on; each shard permutes what it received by
a second key, and a row's place there is its slot. A shard is sorted in
`blocks` tasks, by ranges of the second key, so a slot is an offset plus a rank.

Texts are read once: what is known of each row is written as a table of keys and
numbers, which is counted and dealt. The matrix has parts * shards entries, whatever
the number of rows.

Law `rows`: shards' row counts differ by one at most. It is the one law that holds:
a document's shard depends on no other's text, so documents of equal texts (groups)
are spread over shards like any others; `text_crc32` tells them.

Defined results: a null text counts as empty; a null key is a key like others; rows
equal in key and text are counted and numbered, and each number has random keys of its
own, so they are dealt like any other rows and no partition gets more for them; an
empty table gives no rows. Columns besides key and text are not read.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SHARDS = 40
#: Rows that a logical partition gets about, and the most partitions there are.
PART_ROWS, MOST_PARTS = 250_000, 4096
#: Tasks that sort one shard.
BLOCKS = 16
#: Numbers of equal rows that are made at once.
COPIES_AT_ONCE = 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` without replacement; exact for any sizes."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good + bad else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    left, down, up = rng.random(), mode, mode + 1
    p_down = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    p_up = p_down * (good - mode) * (draws - mode) / ((mode + 1) * (bad - draws + mode + 1))
    while down >= low or up <= high:  # from the mode outwards, until the probability is used up
        if down >= low:
            left -= p_down
            if left <= 0:
                return down
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
        if up <= high:
            left -= p_up
            if left <= 0:
                return up
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
        if p_down < 1e-300 and p_up < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition of so many rows how many go to each shard."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left) if rest else left
            row.append(k)
            left -= k
        room = [r - k for r, k in zip(room, row, strict=True)]
        out.append(row)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with keys of their own for the second and later ones of equal rows."""
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    some = equal.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    each = some.withColumn("copy", F.explode(F.sequence("at", F.least(F.col("at") + COPIES_AT_ONCE, "n") - 1)))
    own = {c: F.when(F.col("copy") == 0, F.col(c)).otherwise(F.xxhash64(c, "copy")) for c in ("first", "second")}
    return each.withColumns(own).select(*rows.columns)


def shard(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 20240229, parts: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """key_col, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot and
    grown_shard (null: the law is not `key`) of each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[key_col].alias("key"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(docs[key_col], text, F.lit(seed)).alias("first"), F.xxhash64(F.lit(seed), text, docs[key_col], F.lit("second")).alias("second"))
    rows = written(_numbered(rows), "sharding")
    if parts is None:
        parts = int(min(MOST_PARTS, max(8, -(-rows.count() // PART_ROWS))))
    rows = rows.withColumn("part", F.pmod("first", F.lit(parts)).cast("int"))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)

    # ranks below the cumulated counts belong to a shard
    ends = [[int(x) for x in np.cumsum(row)] for row in matrix]
    dealt = spark.sql(f"SELECT p AS part, transform(ends, x -> CAST(x AS BIGINT)) AS ends FROM (SELECT posexplode(from_json('{json.dumps(ends)}', 'array<array<bigint>>')) AS (p, ends))")
    local = Window.partitionBy("part").orderBy("first", "second", "key", "size", "crc")
    placed = rows.withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(dealt), "part")
    placed = placed.withColumn("shard", F.expr("size(filter(ends, x -> x <= rank))").cast("int")).select("key", "size", "crc", "second", "first", "shard")

    # the second key is uniform, so its ranges are even; unsigned order of its top bits
    placed = placed.withColumn("block", F.floor((F.col("second").cast("double") / 2.0**64 + 0.5) * blocks).cast("int"))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "block").orderBy("second", "first", "key", "size", "crc")
    out = placed.withColumn("place", F.row_number().over(inner) - 1).join(F.broadcast(offsets), ["shard", "block"])
    return out.select(F.col("key").alias(key_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
