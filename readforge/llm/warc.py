"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

A split may start anywhere and a payload may hold the magic line, so finding the magic proves nothing.  Each task lists
its candidates: the offset of a magic line and the offset at which, by its own header, the next record would start.
Pointer jumping over these links from the start of each file keeps the reachable candidates only: the true records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, materialize

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SHORTEST_SHARED = 1000
#: Digests of repeated payloads up to this many are broadcast (about 80 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages with payload, digest, record type and the page that a revisit refers to."""
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    base = base.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    same = base.where(F.col("n") >= SHORTEST_SHARED).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    out = base.join(bounded(same, BROADCAST_ROWS), ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row; the committer of Spark's writer makes a lost task's file vanish."""
    rec = plan_records(pages, key, url, html)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(HTTP_HEAD), F.when(F.col("kind") == "response", F.col("html")).otherwise(F.lit("")))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Bytes", F.col("n").cast("string")),
        F.when(F.col("kind") == "revisit", line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rec.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def _parsed(df: DataFrame, value: str) -> DataFrame:
    """Adds the fields of a record whose text after the magic line is in `value`; `clen` is null if it has no sane header."""
    head = F.substring_index(F.col(value), END, 1)
    df = df.withColumn("_head", F.when(F.instr(F.col(value), END) > 0, head))
    df = df.withColumn("hlen", F.octet_length("_head") + 4).withColumn("clen", F.expr("try_cast(regexp_extract(_head, '(?:^|\\r\\n)Content-Length: ([0-9]+)', 1) as bigint)"))
    df = df.withColumn("kind", _field(F.col("_head"), "WARC-Type")).withColumn("record_id", _field(F.col("_head"), "WARC-Record-ID")).withColumn("refers", _field(F.col("_head"), "WARC-Refers-To"))
    return df.withColumn("told", _field(F.col("_head"), "WARC-Payload-Digest")).withColumn("told_n", F.expr("try_cast(regexp_extract(_head, '(?:^|\\r\\n)X-Payload-Bytes: ([0-9]+)', 1) as bigint)")).withColumn("uri", _field(F.col("_head"), "WARC-Target-URI")).drop("_head")


def _payload(df: DataFrame, value: str) -> DataFrame:
    """Adds `payload` (binary): the block after its HTTP head."""
    body = F.expr(f"substring(cast({value} as binary), cast(hlen + 1 as int), cast(clen as int))")
    df = df.withColumn("_body", body)
    return df.withColumn("payload", F.expr(f"substring(_body, instr(substring({value}, instr({value}, '\\r\\n\\r\\n') + 4), '\\r\\n\\r\\n') + 4)")).drop("_body")


FIELDS = ["kind", "record_id", "refers", "told", "told_n", "uri"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between magic lines, with file, start of the split and an id that follows their order in the split."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, off, succ, place (block, seq), and the record's fields; `value` only where the piece up to the next magic is not the whole record.

    Splits are cut at the magic line; offsets are sums of lengths, first inside each split and then over the splits.
    """
    d = len(MAGIC)
    raw = _pieces(spark, path).withColumn("len", F.octet_length("value").cast("long"))
    raw = _payload(_parsed(raw, "value"), "value")
    whole = F.col("len") == F.col("hlen") + F.col("clen") + 4
    raw = raw.withColumn("whole", F.coalesce(whole, F.lit(False)))
    raw = raw.select("file", "block", "seq", "len", "hlen", "clen", *FIELDS, "whole", F.when(F.col("whole"), F.sha1("payload")).alias("digest"), F.when(F.col("whole"), F.octet_length("payload").cast("long")).alias("n"), F.when(~F.col("whole"), F.col("value")).alias("value"))
    raw = materialize(raw, "warc-candidates")
    sums = raw.groupBy("file", "block").agg(F.sum(F.col("len") + d).alias("total"))
    sums = sums.withColumn("base", F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total")).drop("total")
    out = raw.join(sums, ["file", "block"])
    inside = F.sum(F.col("len") + d).over(Window.partitionBy("file", "block").orderBy("seq")) - (F.col("len") + d)
    out = out.withColumn("off", F.col("base") + inside - d).where("off >= 0").drop("base")
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")))
    return out.withColumn("succ", F.col("off") + d + F.col("hlen") + F.col("clen") + 4)


def reachable(links: DataFrame) -> DataFrame:
    """(file, off) of the candidates on the chain from the first offset of each file.

    links: file, off, succ.  Runs in which each candidate leads to the next are contracted to one link; a candidate
    that some other one jumps to begins a run of its own.  Then pointer jumping doubles the reach in each round.
    """
    w = Window.partitionBy("file").orderBy("off")
    at = links.withColumn("_next", F.lead("off").over(w)).withColumn("_prev", F.lag("succ").over(w))
    jumps = at.where("succ is not null and (_next is null or succ <> _next)").select("file", F.col("succ").alias("off")).distinct().withColumn("_target", F.lit(True))
    at = at.join(jumps, ["file", "off"], "left")
    starts = F.coalesce(F.col("_target"), F.lit(False)) | ~F.coalesce(F.col("_prev") == F.col("off"), F.lit(False))
    at = at.withColumn("head", F.last(F.when(starts, F.col("off")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = materialize(at.select("file", "off", "succ", "head"), "warc-runs")
    jump = at.groupBy("file", F.col("head").alias("off")).agg(F.max_by("succ", "off").alias("to"))
    reach = jump.groupBy("file").agg(F.min("off").alias("off"))
    while True:
        grown = reach.join(jump, ["file", "off"]).select("file", F.col("to").alias("off")).where("off is not null")
        grown = grown.join(jump.select("file", "off"), ["file", "off"], "left_semi")
        reach = materialize(reach.union(grown).distinct(), "warc-reach")
        jump = materialize(jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.off")), "left").select("a.file", "a.off", F.col("b.to").alias("to")), "warc-jump")
        if jump.where("to is not null").limit(1).count() == 0:
            break
    return at.join(reach.select("file", F.col("off").alias("head")), ["file", "head"], "left_semi").select("file", "off")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per true record: file, off, kind, record_id, uri, refers, digest and n (of the payload read), told, told_n.

    A record whose payload holds the magic line was cut at it; its pieces are put together again.
    """
    found = candidates(spark, path)
    true = reachable(found.select("file", "off", "succ")).withColumn("real", F.lit(True))
    found = found.join(true, ["file", "off"], "left")
    whole = found.where("real and whole").select("file", "off", *FIELDS, "digest", "n")
    w = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    cut = found.withColumn("rec", F.last(F.when(F.col("real"), F.col("off")), ignorenulls=True).over(w)).withColumn("rec_whole", F.last(F.when(F.col("real"), F.col("whole")), ignorenulls=True).over(w))
    cut = cut.where("not rec_whole").select("file", "rec", "off", "block", "seq", "value")
    if cut.where("value is null").limit(1).count():  # a piece inside a payload that looks like a whole record: read its text again
        again = _pieces(spark, path).withColumn("seq", F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")) - F.when(F.col("block") == 0, 1).otherwise(0))
        again = again.select("file", "block", "seq", F.col("value").alias("text"))
        cut = cut.join(again, ["file", "block", "seq"]).select("file", "rec", "off", F.coalesce("value", "text").alias("value"))
    cut = cut.groupBy("file", "rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    cut = _payload(_parsed(cut, "value"), "value").select("file", F.col("rec").alias("off"), *FIELDS, F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    return whole.unionByName(cut)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write pages as an archive at `path`, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least 1000 bytes that with the largest page_id is the response (rows that repeat
    this page_id too) and the others revisit it; a null html is an empty payload; a null page_id comes back as null and
    never is what a revisit refers to.  An empty table gives an empty result.  Other columns are not read.
    """
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    back = read_archive(pages.sparkSession, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as {kind.simpleString()})")
    revisit = F.col("kind") == "revisit"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("told_n")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("told", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, number("refers")).alias("refers_to"),
    )
