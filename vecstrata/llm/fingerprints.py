"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of letters and digits, cut after eight characters, and single
other characters that aren't white space, in lower case. Each token is hashed
once. The hash of k successive tokens is a rolling one: a step shifts it left, XORs
the new token's hash in and the shifted hash of the token that leaves out; the shift
leaves each token 36 bits at least. Of each window of `width`
such hashes the least is kept, the rightmost one on ties, with its position. So
any two texts that share k + width - 1 tokens in a row share a kept hash, and
the positions say where. A kept entry is one long: 36 bits of the hash above 27
bits of the position counted down, which makes the least long the rightmost
least hash. Windows cover the whole text.

Likeness is the share of common hashes among all of both, a repeated hash
counting each time (1 if both have none).

Defined results: a null text counts as empty and has no entries; a text of
fewer than k tokens has one hash of all of them; fewer than k + width - 1 tokens
make one window; equal texts have equal fingerprints. The document after the
last is the first; equal keys are ordered by a hash of their text; null keys come first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 3, 4
POSITION_BITS = 27
HASH_BITS = 63 - POSITION_BITS
TOKENS = r"[\p{L}\p{M}\p{N}]{1,8}|[^\s\p{L}\p{M}\p{N}]"
_LAST = (1 << POSITION_BITS) - 1
#: Documents that stand next to each other in a window, about, and the most windows.
BLOCK_ROWS, MOST_BLOCKS = 1000, 1 << 16
#: Quantiles are searched in steps of so many.
STEP = 256


def entries(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Kept entries of a text in order of position; k is 29 at most, that tokens keep their bits."""
    if not 1 <= k <= 65 - HASH_BITS or width < 1:
        raise ValueError(f"k must be 1 to {65 - HASH_BITS} and width at least 1, not {k} and {width}")
    return _winnowed(_grams(F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0)), k), width)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(tokens: Column, k: int) -> Column:
    shift = (64 - HASH_BITS) // max(k - 1, 1)

    def rolled(h: Column) -> Column:
        def gram(first: Column, i: Column) -> Column:
            # what the rolling hash holds at this place: array functions carry no state, so its terms are written out
            value = F.shiftleft(first, shift * (k - 1)) if k > 1 else first
            for j in range(1, k):
                value = value.bitwiseXOR(F.shiftleft(F.get(h, i + j), shift * (k - 1 - j)))
            return F.shiftrightunsigned(value, 1).bitwiseOR(F.lit(_LAST)) - i

        return F.transform(F.slice(h, 1, F.size(h) - k + 1), gram)

    def filled(h: Column) -> Column:
        few = F.concat(h, F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size(h)))
        return F.when(F.size(h) >= k, h).otherwise(few)

    empty = F.array().cast("array<bigint>")
    made = F.transform(tokens, lambda t: F.xxhash64(t))
    return _let(made, lambda h: F.when(F.size(h) == 0, empty).otherwise(_let(filled(h), rolled)))


def _winnowed(grams: Column, width: int) -> Column:
    def windows(g: Column) -> Column:
        # least() passes over the nulls behind the end, which only the one window of a short text reaches
        least = lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, width)]) if width > 1 else x
        return F.array_distinct(F.transform(F.slice(g, 1, F.greatest(F.size(g) - width + 1, F.lit(1))), least))

    return _let(grams, windows)


def hashes(kept: Column) -> Column:
    """Sorted hashes of kept entries, repeated ones included."""
    return F.sort_array(F.transform(kept, lambda x: F.shiftright(x, POSITION_BITS)))


def positions(kept: Column) -> Column:
    """Token positions of kept entries."""
    return F.transform(kept, lambda x: (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("int"))


def _merged(a: Column, b: Column) -> Column:
    """How many values two sorted arrays share, each repeat for itself."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("same"))

    def merge(at: Column, _: Column) -> Column:
        x, y = F.get(a, at["i"]), F.get(b, at["j"])  # null behind the end
        move = lambda i, j, same: F.struct((at["i"] + i).alias("i"), (at["j"] + j).alias("j"), (at["same"] + same).alias("same"))
        return F.when(x == y, move(1, 1, 1)).when(x < y, move(1, 0, 0)).when(y < x, move(0, 1, 0)).otherwise(at)

    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, merge, lambda at: at["same"])).otherwise(0)


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes, from hashes() of both texts; a repeated hash counts each time.

    Values in both count once each; only the repeats, mostly few, are merged.
    """
    again = lambda h: F.filter(h, lambda x, i: (i > 0) & (x == F.get(h, i - 1)))
    repeats = F.struct(again(a).alias("a"), again(b).alias("b"))
    common = F.when(a == b, F.size(a)).otherwise(F.size(F.array_intersect(a, b)) + _let(repeats, lambda r: _merged(r["a"], r["b"])))
    sizes = F.size(a) + F.size(b)
    return F.when(sizes == 0, F.lit(1.0)).otherwise(_let(common, lambda c: c / (sizes - c)))


def digest(kept: Column) -> Column:
    """SHA-256 of kept entries, with positions, as hex."""
    return F.sha2(F.array_join(kept.cast("array<string>"), ","), 256)


def _listed(values: list, kind: str) -> Column:
    """A constant array, however long."""
    return F.expr(f"from_json('{json.dumps(values)}', 'array<{kind}>')")


def _block(key: Column, cuts: list[int]) -> Column:
    """The number of sorted cuts that are not above the key, found among every STEP-th first."""
    below = lambda c: F.size(F.filter(c, lambda x: x <= key))
    coarse = below(_listed(cuts[STEP - 1 :: STEP], "bigint")) * STEP
    return _let(coarse, lambda i: i + below(F.slice(_listed(cuts, "bigint"), i + 1, F.lit(STEP))))


def with_next(docs: DataFrame, key: str, text: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Window]:
    """docs with `_own` (false for copies) and the window in which lead() gives the next document.

    Rows are put into blocks by quantiles of the integer key; the first row of each
    block also goes, as a copy, to the block before, the first of all to the last.
    """
    n = docs.count()
    parts = max(1, min(MOST_BLOCKS, n // block_rows))
    shares = _listed([i / parts for i in range(1, parts)], "double")
    cuts = docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts)).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    placed = docs.withColumn("_block", F.when(F.col(key).isNull() | F.lit(not cuts), 0).otherwise(_block(F.col(key), cuts) if cuts else F.lit(0)))
    order = F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("b"), F.xxhash64(text).alias("c"))
    firsts = placed.groupBy("_block").agg(F.min(order).alias("_first")).orderBy("_block").collect()  # one row per block
    blocks = len(cuts) + 1
    before, keys, marks = [None] * blocks, [None] * blocks, [None] * blocks
    for i, r in enumerate(firsts):
        before[r["_block"]], keys[r["_block"]], marks[r["_block"]] = firsts[i - 1]["_block"], r["_first"]["b"], r["_first"]["c"]
    here = lambda values: F.get(_listed(values, "bigint"), F.col("_block"))
    is_first = F.col(key).eqNullSafe(here(keys)) & (F.xxhash64(text) == here(marks))
    own = F.struct(F.col("_block").alias("block"), F.lit(True).alias("own"))
    copy = F.struct(here(before).cast("int").alias("block"), F.lit(False).alias("own"))
    spread = placed.withColumn("_to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))))
    spread = spread.withColumn("_block", F.col("_to.block")).withColumn("_own", F.col("_to.own")).drop("_to")
    return spread, Window.partitionBy("_block").orderBy(F.desc("_own"), F.col(key).asc_nulls_first(), F.xxhash64(text))


def compare(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """key, n_chars, edited_sha256, entries and edited_entries, near_edited and near_next of each row.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document in ascending key order.
    """
    rows = docs.select(docs[key_col].cast("long").alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    spread, window = with_next(rows, "key", "text")
    quarter = F.floor(F.length("text") / 4).cast("int")
    rows = spread.withColumn("next_text", F.lead("text").over(window)).withColumn("entries", entries(F.col("text"), k, width))
    rows = rows.withColumn("hashes", hashes(F.col("entries"))).withColumn("next_hashes", F.lead("hashes").over(window)).where("_own")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = rows.withColumn("edited_entries", entries(F.col("edited"), k, width))
    rows = rows.withColumn("edited_hashes", hashes(F.col("edited_entries")))
    return rows.select(F.col("key").alias(key_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "entries", "edited_entries", likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
