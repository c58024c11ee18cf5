"""WARC archives: written with Spark's text writer, read back in splits.

Writing: one record per page. Of records with equal payloads of at least
`least_revisit` bytes only the one with the smallest id carries the payload;
the others are revisit records that refer to it. Every record ends in two line
ends, which is what the text writer puts after a row. A record's block is a
short HTTP header and the payload.

Reading (boundary-chain verification): the text reader cuts archives of any
size at the magic "WARC/1.", in as many tasks as there are splits. Every cut is
a candidate record; its header gives the offset of its successor. Offsets are
added up within splits, and then only the splits' sums within files. Candidates
that follow each other without a gap inside a block of the file form a run; pointer
jumping from the file's start over the runs' exits keeps the reachable records, so
magic inside a payload is no record. Payloads that hold magic span several cuts and
are put together again, and so are headers with magic in their fields, which archives
written here don't have: it is escaped, as line ends are. Payloads don't move between
tasks unless they are asked for or hold magic.

Damage: where the chain of a file that begins with magic breaks before the file's
end, reading is an error, or (damaged="report") goes on at the next candidate after
the damage; each damaged stretch is a row of record_type `damaged` with its file,
offset and, in payload_bytes, its length. A record whose announced end is neither
magic nor the file's end, such as a truncated last one, is part of the stretch.

Defined results: a null payload is empty; rows that repeat the smallest id of
equal payloads are all responses; a page with a null id is a response, and its
id comes back as null; an archive that doesn't begin with a record has none; an
empty table gives no records. Columns besides id, url and payload are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

MAGIC = "WARC/1."
END = "\r\n"
LEAST_REVISIT = 100
#: Groups of equal payloads up to which their list is sent to all tasks (about 100 bytes each).
BROADCAST_GROUPS = 200_000
#: Bytes of a file whose records stand next to each other in a window.
BLOCK = 256 << 20


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = LEAST_REVISIT, date: str = "2000-01-01T00:00:00Z", broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """Writes one record per row of pages to archives below path, one per task."""
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = written(groups, "warc-groups")
    few = groups.count() <= broadcast_groups
    rows = rows.join(F.broadcast(groups) if few else groups.hint("merge"), "digest", "left")
    rows.select(_record(date).alias("value")).write.option("lineSep", END + END).text(path)


def _record(date: str) -> Column:
    again = F.coalesce(F.col("first") != F.col("id"), F.lit(False))

    def safe(c: str) -> Column:
        """A field's value without line ends and magic."""
        value = F.col(c).cast("string")
        for raw, escaped in (("\r", "%0D"), ("\n", "%0A"), (MAGIC, f"%{ord(MAGIC[0]):X}{MAGIC[1:]}")):
            value = F.replace(value, F.lit(raw), F.lit(escaped))
        return value

    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(safe(c), F.lit("")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    lines = [
        F.lit(MAGIC + "1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe("url")),  # null, and so left out, where there is no URL
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END)),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END), block)


def _field(name: str) -> Column:
    line = F.regexp_replace(F.regexp_extract("header", rf"(?imd)^{name}:(.*)$", 1), r"\r\z", "")
    found = F.trim(line, F.lit(" \t"))  # not by the pattern, whose time would grow with the square of a run of spaces
    return F.when(found != "", found)


def _parsed(lines: DataFrame, keep_payload: bool) -> DataFrame:
    """Header fields and payload of each text that follows magic; `size` is null where there is no header.

    For headers with magic in them: `begins` where a header may begin, `stop` the bytes before the
    first empty line, if there is one, and `told` the length that a line before it gives.
    """
    before = F.substring_index("value", END + END, 1)
    out = lines.withColumn("length", F.octet_length("value").cast("long")).withColumn("begins", F.col("value").rlike(r"\A[01]\r\n"))
    out = out.withColumn("stop", F.octet_length(before).cast("long")).withColumn("stop", F.when(F.col("stop") < F.col("length"), F.col("stop")))
    out = out.withColumn("header", F.when(F.col("begins") & F.col("stop").isNotNull(), before))
    full_lines = F.when(F.col("stop").isNotNull(), F.concat(before, F.lit(END))).otherwise(F.col("value"))
    out = out.withColumn("told", F.regexp_extract(full_lines, r"(?id)\nContent-Length:[ \t]*(\d+)[ \t]*\r?\n", 1).try_cast("long"))
    out = out.withColumn("size", _field("Content-Length").try_cast("long")).withColumn("begin", F.octet_length("header") + F.lit(5))
    out = out.withColumn("span", F.col("begin") - 1 + F.col("size")).withColumn("whole", F.col("span") <= F.col("length"))
    out = out.withColumn("http", _field("Content-Type").startswith("application/http"))
    block = F.expr("substring(cast(value as binary), begin, cast(size as int))")
    out = out.withColumn("block", F.when(F.col("whole"), block))
    http_header = F.when(F.col("http"), F.substring_index(F.col("block").cast("string"), END + END, 1))
    out = out.withColumn("http_header", http_header)
    body = F.expr("if(http, substring(block, octet_length(http_header) + 5), block)")
    out = out.withColumn("payload", body)
    told = F.regexp_extract("http_header", r"(?imd)^Content-Length:[ \t]*(\d+)[ \t]*\r?$", 1).try_cast("long")
    kind = F.lower(_field("WARC-Type"))
    again = kind == "revisit"
    return out.select(
        *[c for c in lines.columns if c != "value"], "length", "size", "span", "whole", "begins", "stop", "told",
        kind.alias("record_type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Refers-To").alias("refers_to"),
        F.when(again, told).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha256:(.*)$", 1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        *[F.when(~again, F.col("payload")).alias("payload")] * keep_payload,
    )


FIELDS = ["record_type", "record_id", "url", "refers_to", "payload_bytes", "payload_digest"]


def read_warc(spark: SparkSession, path: str, *, keep_payload: bool = False, damaged: str = "raise", block: int = BLOCK) -> DataFrame:
    """FIELDS (and payload as binary) of each record, with its file and offset.

    payload_bytes and payload_digest (SHA-256) come from the payload as read;
    for revisits, which have none, from their headers.
    """
    if damaged not in ("raise", "report"):
        raise ValueError(f"damaged must be raise or report, not {damaged!r}")
    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    cuts = written(_in_split(_parsed(lines, False)), "warc-cuts")  # headers and lengths, no payloads
    base = written(_bases(cuts), "warc-splits")
    cuts = _long_headers(_placed(cuts, base)).withColumn("next", F.col("offset") + len(MAGIC) + F.col("span") + len(END + END))
    cuts = cuts.withColumn("block", F.floor(F.greatest("offset", F.lit(0)) / block))

    in_block = Window.partitionBy("file", "block").orderBy("offset")
    found = cuts.where("next is not null and offset >= 0").withColumn("gap", (F.col("next") != F.lead("offset").over(in_block)).cast("int"))
    run = F.coalesce(F.sum("gap").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = written(found.withColumn("run", F.shiftleft("block", 32) + run).drop("gap"), "warc-candidates")
    exits = found.groupBy("file", "run").agg(F.max("next").alias("exit"), F.max("offset").alias("last"))
    jump = exits.join(found.select("file", F.col("offset").alias("exit"), F.col("run").alias("to"), F.col("offset").alias("entry")), ["file", "exit"]).select("file", "run", "to", "entry")
    start = found.where("offset = 0").select("file", "run", F.col("offset").alias("entry"))
    true = found.join(_entered(jump, start), ["file", "run"]).where("offset >= entry").drop("run", "entry")
    short = written(_unread(cuts, true), "warc-unread")
    stretches = None
    if not short.isEmpty():
        if damaged == "raise":
            r = short.orderBy("file").first()
            raise ValueError(f"no record begins at {r['reached']} of {r['file']}, which has {r['end']} bytes")
        true, stretches = _resumed(cuts, found, exits, jump, start, short)
    true = written(true.select("file", "offset", "next", "block", "whole", *FIELDS), "warc-records")

    parts = written(true.where(~F.col("whole")).select("file", "offset", "next"), "warc-parts")
    texts = None if parts.isEmpty() else _whole_texts(lines, base, cuts, parts, block)
    out = true.where("whole").select("file", "offset", *FIELDS)
    if texts is not None:
        out = out.unionByName(_parsed(texts, False).select("file", "offset", *FIELDS))
    if keep_payload:
        here = _parsed(_placed(_in_split(lines.withColumn("length", F.octet_length("value").cast("long"))), base), True).where("whole")
        payloads = here.select("file", "offset", "payload")
        if texts is not None:
            payloads = payloads.unionByName(_parsed(texts, True).select("file", "offset", "payload"))
        out = out.join(payloads, ["file", "offset"], "left")
    return out if stretches is None else out.unionByName(stretches, allowMissingColumns=True)


def _in_split(cuts: DataFrame) -> DataFrame:
    """cuts with the bytes from their split's first cut to their own; `at` gives the order."""
    before = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return cuts.withColumn("before", F.coalesce(F.sum(F.col("length") + len(MAGIC)).over(before), F.lit(0))).drop("at")


def _bases(cuts: DataFrame) -> DataFrame:
    """file, split, base: where the first cut of each split begins, magic included."""
    sums = cuts.groupBy("file", "split").agg(F.max(F.col("before") + F.col("length") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "split", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base"))


def _placed(cuts: DataFrame, base: DataFrame) -> DataFrame:
    """cuts with their offset in the file, which no other read of it changes.

    Another read may split files elsewhere, if the session has other cores by then; that is an error.
    """
    other = F.raise_error(F.lit("the archives were split otherwise when they were read again"))
    placed = cuts.join(base, ["file", "split"], "left").withColumn("offset", F.col("base") + F.col("before"))
    return placed.withColumn("offset", F.when(F.col("base").isNull(), other.cast("long")).otherwise(F.col("offset"))).drop("split", "before", "base")


def _long_headers(cuts: DataFrame) -> DataFrame:
    """cuts, with size and span also where the header goes on in the next cuts, up to an empty line."""
    files = cuts.where("begins and stop is null").select("file").distinct()
    spare = ["begins", "stop", "told"]
    if files.isEmpty():
        return cuts.drop(*spare)
    rest, cuts = cuts.join(files, "file", "left_anti").drop(*spare), cuts.join(files, "file", "left_semi")
    onward = Window.partitionBy("file").orderBy(F.desc("offset")).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.last(F.when(F.col("stop").isNotNull(), F.col("offset") + len(MAGIC) + F.col("stop")), ignorenulls=True).over(onward)
    told = F.last(F.when(F.col("told").isNotNull() | F.col("stop").isNotNull(), F.struct("told")), ignorenulls=True).over(onward)["told"]
    cuts = cuts.withColumn("_stop", stop).withColumn("_told", told)
    open_end = F.col("begins") & F.col("stop").isNull()
    span = F.col("_stop") - F.col("offset") - len(MAGIC) + len(END + END) + F.col("_told")
    cuts = cuts.withColumn("size", F.when(open_end, F.col("_told")).otherwise(F.col("size"))).withColumn("span", F.when(open_end, span).otherwise(F.col("span")))
    return cuts.withColumn("whole", F.col("span") <= F.col("length")).drop(*spare, "_stop", "_told").unionByName(rest)


def _unread(cuts: DataFrame, true: DataFrame) -> DataFrame:
    """file, reached, end: files that begin with magic whose records end elsewhere than the file does."""
    files = cuts.groupBy("file").agg(F.max(F.col("offset") + len(MAGIC) + F.col("length")).alias("end"), F.max((F.col("offset") == 0).cast("int")).alias("begins"))
    last = true.groupBy("file").agg(F.max("next").alias("reached"))
    return files.where("begins = 1").join(last, "file", "left").select("file", F.coalesce("reached", F.lit(0)).alias("reached"), "end").where("reached <> end")


def _resumed(cuts: DataFrame, found: DataFrame, exits: DataFrame, jump: DataFrame, start: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and damaged stretches, where chains that break go on at the next candidate after the damage."""
    ends = short.select("file", "end")
    magic = cuts.select("file", F.col("offset").alias("exit"), F.lit(True).alias("at_magic"))
    heads = found.select("file", F.col("offset").alias("exit"), F.lit(True).alias("at_head"))
    broken = exits.join(ends, "file").where("exit <> end").join(heads, ["file", "exit"], "left_anti").join(magic, ["file", "exit"], "left")
    broken = broken.select("file", "run", F.when(F.col("at_magic"), F.col("exit")).otherwise(F.col("last")).alias("from"))
    first = ends.join(found.where("offset = 0"), "file", "left_anti").select("file", F.lit(-1).cast("long").alias("run"), F.lit(0).cast("long").alias("from"))
    broken = broken.unionByName(first)
    # in the damaged files only: the next candidate after each place
    both = found.join(ends, "file", "left_semi").select("file", F.col("offset").alias("from"), F.lit(None).cast("long").alias("run"), F.struct(F.col("run").alias("to"), F.col("offset").alias("entry")).alias("head"))
    both = both.unionByName(broken.withColumn("head", F.lit(None).cast("struct<to:bigint,entry:bigint>")))
    after = Window.partitionBy("file").orderBy(F.desc("from"), F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    broken = both.withColumn("head", F.last("head", ignorenulls=True).over(after)).where("run is not null")
    broken = written(broken.select("file", "run", "from", "head.to", "head.entry"), "warc-broken")
    jump = jump.unionByName(broken.where("to is not null").select("file", "run", "to", "entry"))
    start = start.unionByName(broken.where("run = -1 and to is not null").select("file", F.col("to").alias("run"), "entry"))
    entered = written(_entered(jump, start).groupBy("file", "run").agg(F.min("entry").alias("entry")), "warc-entered")
    true = found.join(entered, ["file", "run"]).where("offset >= entry").drop("entry")
    bad = broken.join(entered.select("file", "run").unionByName(first.select("file", "run")), ["file", "run"])
    true = true.join(bad.select("file", "run", F.col("from").alias("offset")), ["file", "run", "offset"], "left_anti").drop("run")
    stretch = bad.join(ends, "file").select("file", F.col("from").alias("offset"), F.lit("damaged").alias("record_type"), *[F.lit(None).cast("string").alias(c) for c in ("record_id", "url", "refers_to")], (F.coalesce("entry", "end") - F.col("from")).alias("payload_bytes"), F.lit(None).cast("string").alias("payload_digest"))
    return true, stretch


def _entered(jump: DataFrame, reached: DataFrame) -> DataFrame:
    """file, run, entry: the runs reached from each file's start and where they are entered."""
    if jump.isEmpty():
        return reached
    jump, reached = written(jump, "warc-jump"), written(reached, "warc-reached")
    known = reached.count()
    while True:  # each round doubles the length of the jumps
        more = reached.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reached = written(reached.unionByName(more).distinct(), "warc-reached")
        n = reached.count()
        if n == known:
            return reached
        known = n
        onward = jump.select("file", F.col("run").alias("to"), F.col("to").alias("last"), F.col("entry").alias("last_entry"))
        jump = written(jump.join(onward, ["file", "to"]).select("file", "run", F.col("last").alias("to"), F.col("last_entry").alias("entry")), "warc-jump")


def _owned(cuts: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """The cuts that make up each of the records parts: file, offset of the cut, owner, end."""
    begins = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("next") - 1) / block))))
    begins = begins.select("file", "block", F.greatest("offset", F.col("block") * block).alias("offset"), F.lit(0).alias("is_cut"), F.col("offset").alias("owner"), F.col("next").alias("end"))
    rows = cuts.join(parts.select("file").distinct(), "file", "left_semi").select("file", "block", "offset", F.lit(1).alias("is_cut"), F.lit(None).cast("long").alias("owner"), F.lit(None).cast("long").alias("end"))
    order = Window.partitionBy("file", "block").orderBy("offset", "is_cut").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.unionByName(begins).withColumn("owner", F.last("owner", ignorenulls=True).over(order)).withColumn("end", F.last("end", ignorenulls=True).over(order))
    return marked.where("is_cut = 1 and offset < end").select("file", "offset", "owner", "end")


def _whole_texts(lines: DataFrame, base: DataFrame, cuts: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """The records parts as one text each, from the cuts that they span."""
    mine = lines.join(parts.select("file").distinct(), "file", "left_semi").withColumn("length", F.octet_length("value").cast("long"))
    texts = _placed(_in_split(mine), base).join(_owned(cuts, parts, block), ["file", "offset"])
    texts = texts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("cuts"))
    return texts.select("file", F.col("owner").alias("offset"), F.array_join(F.col("cuts.value"), MAGIC).alias("value"))
