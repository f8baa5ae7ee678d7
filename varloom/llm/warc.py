"""WARC archives: writing captures, reading records, assembling transactions.

Archives are UTF-8 text files of WARC 1.1 records, gzip-compressed by file, and
are written and read by Spark's own text source, so they live in any store that
Spark reaches. Records are cut at the version line; a payload that holds a
version line itself, or makes one with the line end behind it, is stored in
base64 under a transfer-encoding header, so the cut is exact. Each block is
checked against its Content-Length when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import materialise

VERSION = "WARC/1.1\r\n"
MIN_REVISIT_BYTES = 1000
EMPTY_DATE = "1970-01-01T00:00:00Z"


def payload_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest; null html is an empty payload."""
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def mark_revisits(captures: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds record_type and refers_to to the rows of :func:`payload_table`.

    Of equal payloads of at least min_bytes the largest page_id is the response;
    the others revisit it. The groups are combined in the map tasks and joined
    back by digest, which lets a very large group be split.
    """
    shared = captures.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = captures.join(shared.select(F.col("payload_digest").alias("d"), "first"), F.col("payload_digest") == F.col("d"), "left").drop("d")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def _record(kind: str | Column, record_id: Column, headers: list[Column], block: Column, media: str) -> Column:
    """Text of one record, without its version line and the last line end."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(VERSION + "WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {EMPTY_DATE}\r\n"),
        *[F.coalesce(h, F.lit("")) for h in headers],
        F.lit(f"Content-Type: {media}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or null where the value is null."""
    return F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, max_records_per_file: int = 30_000, **columns: str) -> None:
    """Write each page's request, response or revisit, and metadata records below path.

    Captures get random record ids, so rows that repeat a page_id are captures
    of their own. Header values have line ends percent-coded, and
    the last dot of a url that ends in a version. A null url or
    page_id leaves its header out. An empty table writes no record.
    """
    captures = mark_revisits(payload_table(pages, **columns))
    unsafe = F.contains("payload", F.lit(VERSION)) | F.endswith("payload", F.lit(VERSION.strip()))
    body = F.when(unsafe, F.base64(F.col("payload").cast("binary"))).otherwise(F.col("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), F.when(unsafe, F.lit("Content-Transfer-Encoding: base64\r\n")).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.when(F.col("record_type") == "revisit", http).otherwise(F.concat(http, body))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    url = F.when(F.trim(url) == url, url).otherwise(F.replace(url, F.lit(" "), F.lit("%20")))
    url = F.regexp_replace(url, r"WARC/1\.1$", "WARC/1%2E1")
    target = _line("WARC-Target-URI", url)
    c = captures.withColumn("id", F.expr("uuid()"))
    main_id, request_id, metadata_id = (F.concat(F.lit(f"<urn:{kind}:"), F.col("id"), F.lit(">")) for kind in ("uuid", "request", "metadata"))
    with_main = _line("WARC-Concurrent-To", main_id)
    again = F.col("record_type") == "revisit"
    records = F.array(
        _record("request", request_id, [with_main, target], F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.coalesce(F.parse_url("url_safe", F.lit("HOST")), F.lit("")), F.lit("\r\n\r\n")), "application/http; msgtype=request"),
        _record(
            F.col("record_type"), main_id,
            [target, _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), _line("WARC-Payload-Length", F.col("payload_bytes")),
             F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")), _line("WARC-Refers-To-Page", F.col("refers_to"))],
            block, "application/http; msgtype=response",
        ),
        _record("metadata", metadata_id, [with_main, target, _line("WARC-Page-ID", F.col("page_id"))], F.lit("fetchTimeMs: 0\r\n"), "application/warc-fields"),
    )
    c = c.withColumn("url_safe", F.when(F.col("url").rlike(r"^https?://[A-Za-z0-9.:-]+([/?#][\x21-\x7e]*)?$") & ~F.col("url").rlike(r"[\[\]{}|\\^`<>\"%]"), F.regexp_replace("url", r"[?#].*", "")))
    c.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max_records_per_file).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """type, record_id, concurrent_to, target_uri, headers (text), block: one row for each record of the archives.

    A block that is not as long as its Content-Length says raises an error.
    """
    raw = spark.read.option("lineSep", VERSION).text(path).where(F.col("value") != "")
    cut = F.instr("value", "\r\n\r\n")
    head = F.concat(F.lit("\r\n"), F.substring("value", F.lit(1), cut + 1))
    # a record ends with two line ends after its block
    block = F.substring("value", cut + 4, F.length("value") - cut - 3 - 4)
    parsed = raw.select(head.alias("headers"), block.alias("block"))
    length = header("Content-Length").cast("long")
    wrong = F.raise_error(F.concat(F.lit("WARC record cut at a wrong place: "), F.coalesce(header("WARC-Record-ID"), F.lit("no id"))))
    parsed = parsed.withColumn("block", F.when(F.octet_length("block") == length, F.col("block")).otherwise(wrong.cast("string")))
    return parsed.select(
        header("WARC-Type").alias("type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Concurrent-To").alias("concurrent_to"),
        header("WARC-Target-URI").alias("target_uri"), header("Content-Length").cast("long").alias("content_length"), "headers", "block",
    )


def header(name: str, text: str = "headers") -> Column:
    """Value of a header line, or null."""
    after = F.substring_index(F.col(text), f"\r\n{name}: ", -1)
    return F.when(F.contains(text, F.lit(f"\r\n{name}: ")), F.substring_index(after, "\r\n", 1))


def concurrent_ids(text: str = "headers") -> Column:
    """All ids that a record names as concurrent."""
    return F.regexp_extract_all(F.col(text), F.lit(r"\r\nWARC-Concurrent-To: ([^\r]*)"), F.lit(1))


def _owners(ids: DataFrame) -> DataFrame:
    """side, owner: the captures that request and metadata records belong to, from type, record_id and concurrent ids.

    A record belongs to a capture that it names, that names it, or that a record
    it is named with so belongs to.
    """
    main = ids.where(F.col("type").isin("response", "revisit"))
    named = ids.where(F.col("type").isin("request", "metadata")).select(F.col("record_id").alias("side"), F.explode("concurrent").alias("owner"))
    back = main.where(F.size("concurrent") > 0).select(F.explode("concurrent").alias("side"), F.col("record_id").alias("owner"))
    captures = main.select(F.col("record_id").alias("owner"))
    first = named.join(captures, "owner", "left_semi").select("side", "owner").unionByName(back)
    # names between request and metadata, both ways; most archives have none
    between = named.join(captures, "owner", "left_anti").select(F.col("side").alias("x"), F.col("owner").alias("y"))
    if between.isEmpty():
        return first.distinct()
    both = between.unionByName(between.select(F.col("y").alias("x"), F.col("x").alias("y")))
    second = both.join(first.select(F.col("side").alias("y"), "owner"), "y").select(F.col("x").alias("side"), "owner")
    return first.unionByName(second).distinct()


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response, request and metadata joined by their concurrent-to ids.

    A capture is a response or revisit record. Its request and metadata are the
    records that are concurrent to it, whichever of the two names the other and
    however many ids a record names, or to one of its records; a missing one is
    null, and of several the smallest by record id stands. Records that belong
    to no capture (information about the archive, orphans) give no row. Ids are
    unique to a capture, so no key gathers more than its few records. The ids
    alone are written first; whole records are then read twice.
    """
    owners = _owners(materialise(records.select("type", "record_id", concurrent_ids().alias("concurrent")), "warc-ids"))
    main = records.where(F.col("type").isin("response", "revisit"))
    sides = records.where(F.col("type").isin("request", "metadata"))
    cut = F.instr("block", "\r\n\r\n")
    http = F.substring("block", F.lit(1), cut + 1)
    body = F.substring("block", cut + 4, F.length("block"))
    coded = F.contains(http, F.lit("Content-Transfer-Encoding: base64\r\n"))
    payload = F.when(F.col("type") == "revisit", F.lit(None).cast("string")).when(coded, F.decode(F.unbase64(body), "UTF-8")).otherwise(body)
    main = main.withColumn("payload", payload).select(
        "record_id", F.col("type").alias("record_type"), "target_uri",
        F.coalesce(F.sha1("payload"), F.replace(header("WARC-Payload-Digest"), F.lit("sha1:"), F.lit(""))).alias("payload_digest"),
        F.coalesce(F.octet_length("payload").cast("long"), header("WARC-Payload-Length").cast("long")).alias("payload_bytes"),
        header("WARC-Refers-To-Page").cast("long").alias("refers_to"), "payload",
    )
    side = F.struct("record_id", "headers", "block")
    met = sides.select("type", "record_id", "headers", "block").join(owners, F.col("record_id") == F.col("side"))
    met = met.groupBy("owner").agg(F.min(F.when(F.col("type") == "request", side)).alias("request"), F.min(F.when(F.col("type") == "metadata", side)).alias("metadata"))
    joined = main.join(met, F.col("record_id") == F.col("owner"), "left")
    return joined.select(
        "record_id", "record_type", "target_uri", F.struct("payload", "payload_digest", "payload_bytes", "refers_to").alias("response"), "request",
        F.struct("metadata.record_id", "metadata.block", header("WARC-Page-ID", "metadata.headers").cast("long").alias("page_id")).alias("metadata"),
    )
