"""WARC archives: writing pages, and reading them by boundary-chain verification.

Writing.  Pages with equal payloads (of at least a given size) are stored once,
as the response of the largest page id; the others are revisit records that
refer to it.  Payloads are grouped by digest, pre-aggregated, and only (id,
digest) rows take part.  Records go out through Spark's text writer, whose line
separator is the blank line that ends a record.

Reading.  The archives are read in splits, cut wherever the version line stands,
also inside payloads.  Each cut is a candidate boundary; its offset comes from
sums of lengths (within a split, and over the splits of a file), and its
successor is where its own length field says that its record ends.  Pointer
jumping from each file's start keeps the candidates that the chain from there
reaches; each round doubles the distance.  Magic inside a payload is never
reached.  Only (file, offset, successor) rows take part in the jumping.  A record
whose payload was cut is put together again from its parts; parts are found again
by their content's hash and length, so no number of a row must stay the same when
a file is scanned a second time.

A record is returned if the chain reaches it, the next record or the file's end
stands right where it ends, and its payload has the digest that its header names.
faults() reports what isn't: a file that doesn't begin with a record, a record
that doesn't end where it says (cut off, lengthened, without a length), which ends
its file's chain, and a payload with another digest.

Defined results: a null html is an empty payload; a page without an id is
written and read with a null id, as a response of its own; rows with the same id and payload are equal records;
line breaks in a URL become %0D and %0A; an empty table makes no records and no faults; empty
files have no records; a very long page is one record and must fit a task; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memengine.llm.common import forget, integral, only, shared_dir, table, written

VERSION = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The base 32 digits by value, as Spark's conv writes them and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32: each five hex digits are four of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


#: Bytes of the revisits' table (about 96 a row in memory) that may be broadcast; beyond it the pages are shuffled to their decisions.
BROADCAST_BYTES = 64 << 20


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Write one record for each row of pages (page_id, url, html) to text files of records in folder."""
    integral(pages, "page_id")
    rows = only(pages, page_id="page_id", url="url", html="html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    thin = rows.where("page_id IS NOT NULL").select("page_id", "digest", "bytes").distinct()
    first = thin.groupBy("digest").agg(F.max("page_id").alias("response"))
    # Only revisits are named; every other page is a response.
    revisits = thin.join(first, "digest").where((F.col("bytes") >= least_bytes) & (F.col("response") != F.col("page_id")))
    revisits = written(revisits.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "response"), "warc_revisits")
    named = F.broadcast(revisits) if revisits.count() * 96 <= broadcast_bytes else revisits
    rows = rows.join(named, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.coalesce(F.col("response") != F.col("page_id"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(BLANK))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("response"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(BLANK),
    )
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", BLANK).text(folder)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}: *([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """What stands between version lines: value, its hash, the file and its size, its split and the part's place in this scan."""
    raw = spark.read.option("lineSep", VERSION).text(folder)
    file = F.col("_metadata.file_path")
    return raw.select("value", F.xxhash64("value").alias("print"), file.alias("file"), F.xxhash64(file).alias("fid"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"))


def _parsed(parts: DataFrame) -> DataFrame:
    """Header fields, lengths in bytes, and what the payload says if the part holds all of it."""
    header = F.substring_index("value", BLANK, 1)
    out = parts.withColumns({"size": F.octet_length("value").cast("long"), "header": header})
    out = out.withColumns({"head": F.octet_length("header").cast("long") + 4, "body": _field(F.col("header"), "Content-Length").try_cast("long")})
    block = F.expr("substring(cast(value AS binary), cast(head + 1 AS int), cast(least(body, size) AS int))")
    out = out.withColumn("block", F.when(F.col("body").isNotNull(), block))
    return out.withColumn("http", F.octet_length(F.substring_index(F.col("block").cast("string"), BLANK, 1)).cast("long") + 4)


def _described(rows: DataFrame) -> DataFrame:
    """The output columns from header, block and http (the length of the block's own header), and whether the payload has the digest that the header names."""
    payload = F.expr("substring(block, cast(http + 1 AS int))")
    own = F.substring_index(F.col("block").cast("string"), BLANK, 1)
    kind, id_ = F.lower(_field(F.col("header"), "WARC-Type")), "WARC-Record-ID"
    page = lambda f: F.regexp_extract(F.coalesce(_field(F.col("header"), f), F.lit("")), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    revisit = kind == "revisit"
    return rows.withColumns(
        {
            "page_id": page(id_),
            "payload_bytes": F.when(revisit, _field(own, "Content-Length").try_cast("long")).otherwise(F.octet_length(payload).cast("long")),
            "payload_digest": F.when(revisit, F.regexp_extract(F.col("header"), r"WARC-Payload-Digest: sha1:(\w+)", 1)).otherwise(base32_sha1(payload)),
            "record_type": kind,
            "refers_to": F.when(revisit, page("WARC-Refers-To")),
            "target_uri": _field(F.col("header"), "WARC-Target-URI"),
            "sound": F.coalesce(revisit | (base32_sha1(payload) == F.regexp_extract(F.col("header"), r"WARC-Payload-Digest: sha1:(\w+)", 1)), F.lit(False)),
        }
    )


OUT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


def candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each version line of the archives: its part's description (if the part holds the whole record), and its place:
    file, offset, successor (null if its header is no header)."""
    parsed = _described(_parsed(_parts(spark, folder)))
    parts = written(parsed.select("file", "fid", "file_size", "split", "number", "print", "size", "head", "body", (F.col("size") >= F.col("head") + F.col("body") + 4).alias("whole"), *OUT, "sound"), "warc_parts")
    if not parts.groupBy("fid").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").isEmpty():
        raise ValueError("two archives' paths have the same hash")
    step = F.col("size") + len(VERSION)
    splits = parts.groupBy("fid", "split").agg(F.sum(step).alias("length"))
    before = splits.withColumn("base", F.coalesce(F.sum("length").over(Window.partitionBy("fid").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("fid", "split").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    thin = parts.select("fid", "file_size", "split", "number", "print", "size", "head", "body", "whole")
    placed = thin.withColumn("ahead", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(before.drop("length"), ["fid", "split"])
    # The first part of a file ends where the first version line begins; the version line of a part lies before it.
    offset = F.col("base") + F.col("ahead") - len(VERSION)
    end = F.col("offset") + len(VERSION) + F.col("head") + F.col("body") + 4
    return parts, written(placed.withColumn("offset", offset).where("offset >= 0").withColumn("successor", F.when(F.col("body") >= 0, end)).drop("base", "ahead"), "warc_places")


def reachable(places: DataFrame) -> DataFrame:
    """(fid, offset) of the candidates on the chain from each file's start, by pointer jumping."""
    jump = places.where("successor IS NOT NULL").select("fid", "offset", F.col("successor").alias("to"))
    jump = written(jump.join(places.select("fid", F.col("offset").alias("to")), ["fid", "to"], "left_semi"), "warc_jumps")
    reached = written(places.where("offset = 0").select("fid", "offset"), "warc_reached")
    n, last = reached.count(), -1
    while n != last:
        on = reached.join(jump, ["fid", "offset"]).select("fid", F.col("to").alias("offset"))
        old, reached = reached, written(reached.union(on).distinct(), "warc_reached")
        forget(old)
        last, n = n, reached.count()
        if n != last:
            far = jump.select("fid", F.col("offset").alias("to"), F.col("to").alias("far"))
            old, jump = jump, written(jump.join(far, ["fid", "to"]).select("fid", "offset", F.col("far").alias("to")), "warc_jumps")
            forget(old)
    forget(jump)
    return reached


def _chain(places: DataFrame) -> DataFrame:
    """The places that the chains reach, and whether the next record or the file's end stands where each ends (linked)."""
    reached = reachable(places)
    nexts = places.select(F.col("fid").alias("next_fid"), F.col("offset").alias("next_offset"))
    chain = places.join(reached, ["fid", "offset"])
    chain = chain.join(nexts, (F.col("fid") == F.col("next_fid")) & (F.col("successor") == F.col("next_offset")), "left")
    linked = F.coalesce(F.col("next_offset").isNotNull() | (F.col("successor") == F.col("file_size")), F.lit(False))
    chain = written(chain.withColumn("linked", linked).drop("next_fid", "next_offset"), "warc_chain")
    forget(reached)
    return chain


def _joined(spark: SparkSession, folder: str, places: DataFrame, cut: DataFrame) -> DataFrame:
    """The records of cut (their payloads hold version lines), put together from their parts: all from their own up to their successor."""
    ranges = cut.select("fid", F.col("offset").alias("record"), "successor", "head", "body")
    width = 1 << 20
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("record") / width), F.floor((F.col("successor") - 1) / width))))
    owned = places.select("fid", "offset", "print", F.col("size").alias("bytes")).withColumn("cell", F.floor(F.col("offset") / width)).join(cells, ["fid", "cell"]).where("offset >= record AND offset < successor").drop("cell", "successor")
    # Equal contents are one: many records may hold them, so each comes once.
    texts = _parts(spark, folder).select("value", "print", F.octet_length("value").cast("long").alias("bytes"))
    texts = texts.join(owned.select("print", "bytes").distinct(), ["print", "bytes"], "left_semi").groupBy("print", "bytes").agg(F.first("value").alias("value"))
    joined = owned.join(texts, ["print", "bytes"]).groupBy("fid", "record", "head", "body").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), VERSION).alias("value"))
    return _described(_parsed(joined.select("fid", F.col("record").alias("offset"), "value")))


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every linked record of the archives with OUT and sound, and (file, offset, fault) of what the chains broke at."""
    parts, places = candidates(spark, folder)
    chain = _chain(places)
    real = chain.where("linked")
    records = parts.select("fid", "split", "number", *OUT, "sound").join(real.where("whole").select("fid", "offset", "split", "number"), ["fid", "split", "number"]).select("fid", "offset", *OUT, "sound")
    cut = real.where("NOT whole")
    if not cut.isEmpty():
        records = records.union(_joined(spark, folder, places, cut).select("fid", "offset", *OUT, "sound"))
    ends = F.when(F.col("successor").isNull(), "no length").otherwise("does not end where it says")
    broken = chain.where("NOT linked").select("fid", "offset", ends.alias("fault"))
    starts = parts.where("size > 0").select("fid").distinct().join(places.where("offset = 0").select("fid"), "fid", "left_anti").select("fid", F.lit(0).cast("long").alias("offset"), F.lit("does not begin with a record").alias("fault"))
    files = parts.groupBy("fid").agg(F.min("file").alias("file"))
    wrong = records.where("NOT sound").select("fid", "offset", F.lit("another digest").alias("fault"))
    return records, broken.union(starts).union(wrong).join(files, "fid").select("file", "offset", "fault")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each sound record of the archives in folder: OUT."""
    return _read(spark, folder)[0].where("sound").select(*OUT)


def faults(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, fault) for each fault of the archives in folder."""
    return _read(spark, folder)[1]


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("target_uri")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS r FROM p),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> CAST(5 * (3 - j) AS BIGINT)) & 31 AS INTEGER) + 1, 1), '' ORDER BY i, j) AS digest
      FROM (SELECT page_id, i, CAST('0x' || substr(x, i * 5 + 1, 5) AS BIGINT) AS v FROM d, range(8) t(i)), range(4) u(j) GROUP BY page_id)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN r = d.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r = d.page_id THEN NULL ELSE r END AS refers_to
FROM d JOIN b USING (page_id)
"""
