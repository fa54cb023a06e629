"""WARC archives: writing with revisits, and boundary-chain verified reading.

Writing.  Of records with equal payloads (length and SHA-256) the one with the largest page_id is a
response, the others are revisits that carry its id, length and digest but not
the bytes.  Only rows that share a payload (found by a Bloom filter of bounded
size) are shuffled to decide this; all others are written where they are read.

Reading.  Spark's text source cuts archives at the record magic, wherever the
byte ranges of tasks fall.  Each piece is a candidate record: its offset is the
prefix sum of the pieces before it, its successor follows from its header.  A
magic inside a payload makes false candidates, so only candidates reachable
from the start of a file count: every byte range first jumps its own chain to
where it leaves the range, then pointer jumping over these exits doubles the
reach until it no longer grows.  Payloads that false candidates had cut are put
together again from their pieces.  The bytes of those pieces are read a second
time and found by their digest, not by a row number: which byte ranges a scan
makes depends on how many cores are alive, and may differ between two scans.

Candidates and byte ranges grow with the input, and names of files compress to
so little that Spark, which goes by the size of the staged files, would
broadcast tables a hundred times over its threshold.  Their joins are therefore
merge joins by hint.  Only shared digests are left to the threshold: as hex of
a hash they take three times their stored size at most.

Defined results: null html is an empty payload; a null page_id is the smallest;
rows that repeat page_id and payload are all responses, or all revisits; the
records after a damaged one are unreachable and dropped; an empty table writes
and reads nothing.  Only page_id, url and html are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import new_path, prepare, staged, table, text_or_empty

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from its 40 hex digits in four parts."""
    digest = F.sha1(payload)
    chars = []
    for part in range(4):
        value = F.conv(F.substring(digest, part * 10 + 1, 10), 16, 10).cast("long")
        for k in range(8):
            at = F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1
            chars.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*chars)


def _record(revisit: Column) -> Column:
    """A record without the line breaks that end it; the writer adds those."""
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(BREAK),
    )
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        page("page_id"),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), url)),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: "), page("last"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(BREAK),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record for each row to archive files under ``path``."""
    prepare(pages.sparkSession)
    payload = text_or_empty("html")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    shared = staged(
        rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "last"),
        "warc-shared",
    )
    hashed = F.xxhash64("sha").alias("h")
    bits = bloom.build(shared.select(hashed), bloom.log2_bits(shared.count()))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bloom.test(bits, batch.column("h").to_numpy()) if batch.num_rows else []
            at = batch.schema.get_field_index("h")
            yield batch.remove_column(at).append_column("maybe", pa.array(found, pa.bool_()))

    marked = rows.select("*", hashed).mapInArrow(test, "page_id long, url string, payload string, sha string, maybe boolean")
    alone = marked.filter("NOT maybe").withColumn("last", F.col("page_id")).drop("maybe")
    together = marked.filter("maybe").drop("maybe").join(shared.withColumnRenamed("sha", "sha2"), F.col("sha") == F.col("sha2"), "left")
    together = together.select("page_id", "url", "payload", "sha", F.when(F.col("sha2").isNull(), F.col("page_id")).otherwise(F.col("last")).alias("last"))
    records = alone.select(*together.columns).union(together).select(
        "*", F.octet_length("payload").alias("bytes"), base32_sha1(F.col("payload")).alias("digest")
    )
    record = _record(~F.col("page_id").eqNullSafe(F.col("last")))
    records.select(record.alias("value")).write.option("lineSep", BREAK).option("compression", "none").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between magics: file, range, order within the range, value."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            "value",
        )
    )


def _identity() -> Column:
    """What a piece is found by in another scan: the digest of its bytes."""
    return F.unhex(F.sha1("value"))


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract("head", rf"(?m)^{name}: {pattern}\r?$", 1)


def _parsed(value: str = "value") -> list[Column]:
    """Columns of a record from the text after its magic."""
    first = F.octet_length(F.substring_index(value, BREAK, 1))
    second = F.octet_length(F.substring_index(value, BREAK, 2))
    return [
        F.octet_length(value).cast("long").alias("length"),
        F.substring_index(value, BREAK, 1).alias("head"),
        _stated(value),
        first.alias("head_bytes"),
        second.alias("http_bytes"),
    ]


def _stated(value: str) -> Column:
    """The length in the HTTP header that follows a record's header."""
    http = F.substring_index(F.substring_index(value, BREAK, 2), BREAK, -1)
    length = F.regexp_extract(http, r"(?mi)^Content-Length: (\d{1,18})\r?$", 1)
    return F.when(length != "", length).cast("long").alias("stated")


def _payload(value: str = "value") -> Column:
    size = F.col("head_bytes") + len(BREAK) + F.col("content") - F.col("http_bytes") - len(BREAK)
    return F.substring(F.col(value).cast("binary"), F.col("http_bytes") + len(BREAK) + 1, size.cast("int"))


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Offsets and successors of a byte range, and where its chains leave it."""
    pdf = pdf.sort_values("seq", ignore_index=True)
    step = pdf["length"].to_numpy() + len(MAGIC)
    offset = pdf["base"].to_numpy() + np.cumsum(step) - step - len(MAGIC)
    end = np.where(pdf["content"] >= 0, offset + len(MAGIC) + pdf["head_bytes"] + len(BREAK) + pdf["content"] + len(BREAK), -1)
    number = {o: i for i, o in enumerate(offset.tolist())}
    out = end.copy()
    for i in range(len(out) - 1, -1, -1):
        j = number.get(int(end[i]))
        if j is not None and j > i:
            out[i] = out[j]
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "seq": pdf["seq"], "offset": offset, "succ": end, "leave": out})


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a byte range on a chain from an entry that is reachable."""
    pdf = pdf.sort_values("offset", ignore_index=True)
    number = {o: i for i, o in enumerate(pdf["offset"].tolist())}
    on = pdf["entry"].to_numpy().copy()
    for i, succ in enumerate(pdf["succ"].tolist()):
        if on[i] and (j := number.get(succ)) is not None:
            on[j] = True
    pdf["reached"] = on
    return pdf[["file", "block", "seq", "offset", "succ", "reached"]]


def reachable_entries(candidates: DataFrame, most: int = 40) -> DataFrame:
    """(file, at) of the entries of byte ranges reachable from offset 0.

    The reach doubles each round, so rounds are the logarithm of the number of
    byte ranges that the longest file has.
    """
    exits = candidates.select("file", F.col("leave").alias("offset")).distinct()
    starts = candidates.filter("offset = 0").select("file", "offset")
    jump = candidates.join(exits.union(starts).distinct().hint("merge"), ["file", "offset"]).select("file", F.col("offset").alias("at"), F.col("leave").alias("to"))
    jump = staged(jump, "warc-jumps")
    entries = jump.select("file", "at")
    reach = jump.filter("at = 0").select("file", "at")
    known = reach.count()
    for _ in range(most):
        landed = reach.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at")).join(entries.hint("merge"), ["file", "at"], "left_semi")
        reach = staged(reach.union(landed).distinct(), "warc-reach")
        now = reach.count()
        if now == known:
            break
        known = now
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = jump.join(onward.hint("merge"), ["file", "to"]).select("file", "at", F.col("far").alias("to"))
        jump = staged(jump, "warc-jumps")
    return reach


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Reachable records: file, offset, head, type and what their payloads hold."""
    prepare(spark)
    whole = F.col("head_bytes") + len(BREAK) + F.col("content") <= F.col("length")
    content = F.when(_field("Content-Length", r"(\d{1,18})") != "", _field("Content-Length", r"(\d{1,18})").cast("long")).otherwise(F.lit(-1))
    pieces = _pieces(spark, path).select("*", *_parsed()).withColumn("content", content)
    good = whole & (F.col("content") >= F.col("http_bytes") - F.col("head_bytes"))
    pieces = pieces.select(
        "file", "block", "seq", "length", "head", "head_bytes", "content", "stated", _identity().alias("id"),
        F.when(good, F.octet_length(_payload())).alias("bytes"),
        F.when(good, base32_sha1(_payload())).alias("digest"),
    )
    pieces = staged(pieces, "warc-pieces")

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy("file", "block").agg(F.sum(F.col("length") + len(MAGIC)).alias("n"))
    ranges = ranges.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    light = pieces.select("file", "block", "seq", "length", "head_bytes", "content").join(ranges.hint("merge"), ["file", "block"])
    candidates = staged(
        light.groupBy("file", "block").applyInPandas(_chain, "file string, block long, seq long, offset long, succ long, leave long"),
        "warc-candidates",
    )
    entries = reachable_entries(candidates).select("file", F.col("at").alias("offset"), F.lit(True).alias("entry"))
    flagged = candidates.join(entries.hint("merge"), ["file", "offset"], "left").select(
        "file", "block", "seq", "offset", "succ", F.coalesce("entry", F.lit(False)).alias("entry")
    )
    placed = flagged.groupBy("file", "block").applyInPandas(_reached, "file string, block long, seq long, offset long, succ long, reached boolean")
    placed = staged(placed, "warc-placed")

    records = placed.filter("reached").hint("merge").join(pieces, ["file", "block", "seq"])
    cut = staged(records.filter("digest IS NULL").select("file", "offset"), "warc-cut")
    done = records.filter("digest IS NOT NULL").select("file", "offset", "head", "stated", "bytes", "digest")
    if cut.limit(1).count():
        done = done.union(_mended(spark, path, placed, pieces, cut))
    return done.select(
        "file",
        "offset",
        "head",
        _field("WARC-Type", r"(\w+)").alias("type"),
        F.col("bytes").cast("long").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("stated").alias("stated_bytes"),
    )


def _mended(spark: SparkSession, path: str, placed: DataFrame, pieces: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, put together from their pieces."""
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = placed.withColumn("of", F.last(F.when(F.col("reached"), F.col("offset")), ignorenulls=True).over(upto))
    owned = owned.join(cut.withColumnRenamed("offset", "of").hint("merge"), ["file", "of"]).select("file", "block", "seq", "offset", "of")
    owned = staged(owned.hint("merge").join(pieces.select("file", "block", "seq", "id"), ["file", "block", "seq"]).select("file", "of", "offset", "id"), "warc-owned")
    ids = owned.select("id").distinct()
    bits = bloom.build(ids.select(F.xxhash64("id").alias("h")), bloom.log2_bits(ids.count()))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bloom.test(bits, batch.column("h").to_numpy()) if batch.num_rows else []
            yield batch.select(["id", "value"]).filter(pa.array(hit, pa.bool_()))

    again = _pieces(spark, path).select(_identity().alias("id"), "value").select("*", F.xxhash64("id").alias("h"))
    again = again.mapInArrow(wanted, "id binary, value string")
    # pieces with one digest have the same bytes, so any of them will do
    values = staged(again.groupBy("id").agg(F.first("value").alias("value")), "warc-values")
    joined = owned.hint("merge").join(values, "id").groupBy("file", "of").agg(
        F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts")  # one record's own pieces
    )
    value = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
    parsed = joined.select("file", F.col("of").alias("offset"), value.alias("value")).select("*", *_parsed())
    parsed = parsed.withColumn("content", _field("Content-Length", r"(\d{1,18})").cast("long"))
    return parsed.select("file", "offset", "head", "stated", F.octet_length(_payload()).alias("bytes"), base32_sha1(_payload()).alias("digest"))


def described(records: DataFrame) -> DataFrame:
    """The records of ``write_archives`` as rows, with the page they refer to."""
    number = lambda text: F.when(text.isin("", "null"), F.lit(None)).otherwise(text).cast("long")
    revisit = F.col("type") == "revisit"
    stated = _field("WARC-Payload-Digest", r"sha1:(\w+)")
    return records.select(
        number(_field("WARC-Record-ID", r"<urn:page:([^>]*)>")).alias("page_id"),
        # a revisit holds the HTTP header of the payload that it leaves out
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, number(_field("WARC-Refers-To", r"<urn:page:([^>]*)>"))).alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(prepare(spark), "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return described(read_archives(spark, path))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
         max(page_id) OVER (PARTITION BY html) AS last
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM d
"""
