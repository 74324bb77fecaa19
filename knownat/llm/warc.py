"""Content-addressed web archive: payload bytes once by SHA-256, exact record headers beside them, records by joins.

An archive is a folder of two tables.  ``payloads`` holds ``content`` (hex SHA-256), ``payload_digest`` (SHA-1 in base32, as
record headers name it) and ``payload``.  ``records`` holds one row per record: the exact header block, its kind and the
``content`` it refers to.  A record is header + payload + two line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit digest given in hexadecimal: each five hex digits are four symbols."""
    symbols = []
    for group in range(8):
        value = F.conv(F.substring(digest, 1 + 5 * group, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + F.lit(1)
            symbols.append(F.substring(F.lit(ALPHABET), place, F.lit(1)))
    return F.concat(*symbols)


def header_value(text: Column) -> Column:
    """A value without line breaks: CR and LF are percent-encoded."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, folder: str, minimum: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive ``page_id, url, html``; a null html is an empty payload.

    Of records with equal payloads of at least ``minimum`` bytes the one with the largest (page_id, url) is the response and
    the others revisit it; smaller payloads are all responses.  Rows that are equal in all three columns are separate records;
    the first of them counts as the largest.  Null ids rank below all others.  Extra columns are not archived.  Records are
    counted per distinct row before anything is shuffled by payload, so a payload that a third of the pages share is one row
    per task.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("content"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))
    # The payload's bytes go through a map-side aggregate: each task sends each content once.
    payloads = rows.groupBy("content").agg(
        F.first("payload").alias("payload"), F.min("sha1").alias("sha1"), F.max("sha1").alias("other"),
        F.min("payload_bytes").alias("payload_bytes"), F.max("payload_bytes").alias("longest"))
    same = (F.col("sha1") == F.col("other")) & (F.col("payload_bytes") == F.col("longest"))
    payloads.select(
        "content", base32_of_hex(F.col("sha1")).alias("payload_digest"), "payload_bytes",
        F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("payload"),
    ).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    counted = rows.drop("payload").groupBy("page_id", "url", "content", "sha1", "payload_bytes").agg(F.count("*").alias("copies"))
    largest = counted.groupBy("content").agg(F.max(F.struct("page_id", "url")).alias("largest"))
    each = counted.join(largest, "content").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = F.struct("page_id", "url").eqNullSafe(F.col("largest")) & (F.col("copy") == 1)
    record_id = lambda page, url, copy: F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws(
        "\n", F.coalesce(page.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("u"), url), F.lit("null")),
        copy.cast("string"), F.col("content")), 256), F.lit(">"))
    named = each.withColumn("response", first | (F.col("payload_bytes") < minimum)).select(
        "page_id", "content", "response", F.col("largest.page_id").alias("refers_to"),
        record_id(F.col("page_id"), F.col("url"), F.col("copy")).alias("record_id"),
        record_id(F.col("largest.page_id"), F.col("largest.url"), F.lit(1)).alias("refers_id"),
        header_value(F.col("url")).alias("uri"), base32_of_hex(F.col("sha1")).alias("digest"), "payload_bytes")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("uri")),
        line("Page-ID", page_text("page_id")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("response"), F.lit("")).otherwise(F.concat(
            line("WARC-Refers-To", F.col("refers_id")), line("Refers-To-Page", page_text("refers_to")),
            line("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("response"), F.col("payload_bytes").cast("string")).otherwise(F.lit("0"))),
        F.lit("\r\n"))
    named.select("record_id", "content", head.cast("binary").alias("header")).write.option(
        "compression", "zstd").parquet(f"{folder}/records")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its header, its whole payload and the exact bytes of the record.

    A revisit has an empty block in ``record``, while ``payload`` is what it refers to.  A payload whose digest is not its
    address, or a record without its payload, is an error.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    checked = payloads.withColumn("payload", F.when(
        F.sha2("payload", 256) == F.col("content"), F.col("payload")).otherwise(F.raise_error(F.lit("damaged payload"))))
    rows = spark.read.parquet(f"{folder}/records").join(checked, "content", "left")
    block = F.when(F.col("header").cast("string").contains("WARC-Type: response\r\n"), F.col("payload")).otherwise(F.lit(b""))
    return rows.withColumn("payload", F.coalesce("payload", F.raise_error(F.lit("missing payload")))).withColumn(
        "record", F.concat(F.col("header"), block, F.lit(END.encode())))


def describe(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """What the headers say of each page, with length and digest taken anew from the payload."""
    head = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(head, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    page = lambda name: F.nullif(F.nullif(field(name), F.lit("null")), F.lit("")).cast(id_type)
    return records.select(
        page("Page-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"), field("WARC-Type").alias("record_type"),
        page("Refers-To-Page").alias("refers_to"), F.sha2("record", 256).alias("record_sha256"))
