"""Landed files: immutable versions, verification, and readers for the official formats."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.functions.ordered import latest_by

# Metadata keys that hold secrets, and keys that hold addresses.
SECRET_KEYS = ["servicekey", "service_key", "authorization", "api_key", "apikey"]
URL_KEYS = ["url", "source_url", "request_url"]
ENCODINGS = ["utf-8-sig", "cp949"]

#: Characters of a piece of a decoded file, after which the next record begins another piece.
PIECE = 1 << 20
#: Pieces of small files that leave a task together.
PIECES_AT_ONCE = 10_000
PIECES = "path string, digest string, piece int, header string, first_row long, records array<string>, rule_id string"
# A field in quotes (they open at the start of a field only, and may hold line ends), or a line end.
MARKS = re.compile(r'(?<![^,\r\n])"[^"]*(?:""[^"]*)*(?:"|\Z)|\r\n|\n|\r')
# The same in the JVM's spelling: fields of a record that is followed by a comma, and the quoted part of a field.
FIELD = r'("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+),'
QUOTED = r'^"([^"]*+(?:""[^"]*+)*+)"'


def read_landing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Landed files as ``(path, content, length, modificationTime)``; Spark does not list files of zero bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def register_raw(landing: DataFrame, manifest: DataFrame) -> DataFrame:
    """New versions by content: one row per (dataset, scope, sha256) not yet in the manifest.

    ``landing`` (landing_seq, dataset, scope, content); ``manifest`` (raw_version_id, dataset, scope, sha256).  Ids continue
    after the manifest in landing order.  Numbering needs no single sorted task: each landing range of
    a million rows is numbered on its own and shifted by the ranges before it.
    """
    key = ["dataset", "scope", "sha256"]
    hashed = landing.select("dataset", "scope", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "landing_seq")
    fresh = hashed.groupBy(*key).agg(F.min("landing_seq").alias("first_seen")).join(manifest.select(*key), key, "left_anti")
    ranged = fresh.withColumn("_range", F.floor(F.col("first_seen") / 1_000_000))
    inside = Window.partitionBy("_range").orderBy("first_seen", *key)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    last = manifest.agg(F.coalesce(F.max("raw_version_id"), F.lit(0))).scalar()
    numbered = ranged.withColumn("_place", F.row_number().over(inside)).join(offsets, "_range")
    return numbered.select((last + F.col("_offset") + F.col("_place")).cast("long").alias("raw_version_id"), *key, "first_seen")


def changed_versions(versions: DataFrame) -> DataFrame:
    """Versions of a (dataset, scope) that already had another one."""
    first = versions.groupBy("dataset", "scope").agg(F.min("raw_version_id").alias("_first"))
    joined = versions.join(first, ["dataset", "scope"])
    return joined.filter(F.col("raw_version_id") > F.col("_first")).drop("_first")


def _inflate(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _archive_check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for content in batch["content"]:
            try:
                digests.append(hashlib.sha256(_inflate(content)).hexdigest())
            except (OSError, EOFError):
                digests.append(None)
        yield pd.DataFrame({"path": batch["path"], "actual": digests})


def verify_archive(files: DataFrame) -> DataFrame:
    """``(path, expected, actual, reason)``: the sha256 in each file name against the unpacked content."""
    expected = F.regexp_extract("path", r"([^/-]*)$", 1)
    expected = F.regexp_extract(expected, r"^([^.]*)", 1)
    checked = files.select("path", "content").mapInPandas(_archive_check, "path string, actual string")
    return checked.select(
        "path", expected.alias("expected"), "actual",
        F.when(~expected.rlike("^[0-9a-f]{64}$"), "bad_name").when(F.col("actual").isNull(), "unreadable")
        .when(F.col("actual") != expected, "checksum_mismatch").alias("reason"),
    )


def _text(body: bytes) -> tuple[str, str | None]:
    """Decoded text and, where it cannot be used, the reason."""
    if not body:
        return "", "empty_file"
    for encoding in ENCODINGS:
        try:
            text = body.decode(encoding)
        except UnicodeDecodeError:
            continue
        return text, "html_response" if text.lstrip()[:9].lower().startswith(("<html", "<!doctype")) else None
    return "", "unknown_encoding"


def _records(text: str) -> Iterator[str]:
    """Records of a text: line ends inside quoted fields do not end one."""
    start = 0
    for mark in MARKS.finditer(text):
        if text[mark.start()] != '"':
            yield text[start:mark.start()]
            start = mark.end()
    yield text[start:]


def _cut_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of about ``PIECE`` characters, each with the file's header and its place; one empty piece of a file without rows.

    Pieces are handed on together until they hold ``PIECE`` characters or ``PIECES_AT_ONCE`` of them wait, so small files cost no frame each.
    """
    made, waiting = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            body = b"" if content is None else bytes(content)
            text, rule = _text(body)
            name = (path, hashlib.sha256(body).hexdigest())
            records = _records(text)
            header, piece, first, held, size = next(records), 0, 1, [], 0
            for record in records:
                if not record:
                    continue
                held.append(record)
                size += len(record)
                if size >= PIECE:
                    made.append((*name, piece, header, first, held, rule))
                    yield pd.DataFrame(made, columns=PIECE_COLUMNS)
                    made, waiting = [], 0
                    piece, first, held, size = piece + 1, first + len(held), [], 0
            if held or not piece:
                made.append((*name, piece, header, first, held, rule))
                waiting += size + len(header)
            if waiting >= PIECE or len(made) >= PIECES_AT_ONCE:
                yield pd.DataFrame(made, columns=PIECE_COLUMNS)
                made, waiting = [], 0
    if made:
        yield pd.DataFrame(made, columns=PIECE_COLUMNS)


PIECE_COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def _fields(record: Column) -> Column:
    """Fields of a CSV record without their quotes; a quote that never closes is a character like others."""
    found = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(FIELD), F.lit(1))
    return F.transform(found, lambda f: F.when(f.startswith('"'), F.concat(
        F.replace(F.regexp_extract(f, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_replace(f, QUOTED, ""))).otherwise(f))


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(path, source_row_number, header, fields)`` of CSV files, and ``(path, rule_id)`` of files that cannot be used.

    Python only decodes bytes (Spark does not know CP949) and cuts texts between records.  The pieces are dealt to all tasks, which
    split them into fields and count rows and widths; a large file is many tasks' work, and its verdict is a sum over its pieces.
    Empty lines do not count.  A null content is an empty file; copies of one file under one path give its rows as often.
    """
    keys = ["path", "digest", "piece"]
    pieces = files.select("path", "content").mapInPandas(_cut_files, PIECES).repartition(*keys)
    lines = pieces.select(*keys, "rule_id", _fields(F.col("header")).alias("header"), "first_row",
                          F.posexplode_outer("records").alias("_at", "_record")).select(
        *keys, "rule_id", "header", (F.col("first_row") + F.col("_at")).alias("source_row_number"), _fields(F.col("_record")).alias("fields"))
    counts = lines.groupBy(*keys).agg(
        F.max("rule_id").alias("_broken"), F.max(F.size("header")).alias("_width"), F.count("fields").alias("_rows"),
        F.count_if(F.size("fields") != F.size("header")).alias("_ragged"))
    file = Window.partitionBy("path", "digest")
    judged = counts.select(*keys, F.coalesce(
        "_broken", F.when(F.col("_width") < 2, "too_few_columns"), F.when(F.sum("_rows").over(file) == 0, "no_rows"),
        F.when(F.sum("_ragged").over(file) > 0, "ragged_row")).alias("_rule"))
    rows = lines.join(judged.filter("_rule IS NULL").select(*keys), keys).select("path", "source_row_number", "header", "fields")
    unusable = judged.filter("_rule IS NOT NULL").groupBy("path", "digest").agg(F.max("_rule").alias("rule_id"))
    return rows, unusable.select("path", "rule_id")


def read_official_csv(files: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Text rows of official CSV files (UTF-8 with or without mark, then CP949) and findings per unusable file.

    Of columns with one name the last counts; a column that the file lacks is null.
    """
    decoded, unusable = decode_files(files)

    def value(column: str) -> Column:
        place = F.array_position(F.reverse("header"), F.lit(column))
        return F.when(place > 0, F.get("fields", (F.size("header") - place).cast("int")))

    return decoded.select("path", "source_row_number", *[value(c).alias(c) for c in columns]), unusable


def read_paged_json(pages: DataFrame, columns: list[str], content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Item rows of paged envelopes, whether ``item`` is a list or a single object, and unreadable rows.

    All other columns of ``pages`` are carried along.
    """
    item = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def envelope(kind: T.DataType) -> T.StructType:
        items = T.StructType([T.StructField("item", kind)])
        body = T.StructType([T.StructField("items", items)])
        response = T.StructType([T.StructField("response", T.StructType([T.StructField("body", body)]))])
        return T.StructType([T.StructField("pages", T.ArrayType(response))])

    carried = [c for c in pages.columns if c != content]
    parsed = pages.select(*carried, content, F.from_json(content, envelope(T.ArrayType(item))).alias("_many"))
    # Texts are read for single objects only where a page has no list.
    unlisted = F.exists("_many.pages", lambda p: p["response"]["body"]["items"]["item"].isNull())
    parsed = parsed.select(*carried, "_many", F.when(unlisted, F.from_json(content, envelope(item))).alias("_one"))
    broken = parsed.filter(F.col("_many.pages").isNull()).select(*carried, F.lit("unreadable_envelope").alias("rule_id"))
    # No pages give no rows; a filter that says so would move to the texts and read them once more.
    numbered = parsed.select(*carried, "_one", F.posexplode("_many.pages").alias("page", "_page"))
    many = F.filter(F.coalesce("_page.response.body.items.item", F.array()), lambda i: i.isNotNull())
    single = F.get("_one.pages", F.col("page"))["response"]["body"]["items"]["item"]
    paged = numbered.select(*carried, "page", many.alias("_list"), single.alias("_single"))
    one = F.when(F.col("_single").isNotNull(), F.array("_single")).otherwise(F.array().cast(T.ArrayType(item)))
    rows = paged.select(*carried, "page", F.posexplode(F.when(F.size("_list") > 0, F.col("_list")).otherwise(one)))
    filled = F.coalesce(*[F.col(f"col.{c}") for c in columns]).isNotNull()
    return rows.filter(filled).select(*carried, "page", F.col("pos").alias("item"), *[f"col.{c}" for c in columns]), broken


COMPANY = "stock_code string, corp_code string, corp_name string"


def read_company_master(spark: SparkSession, path: str) -> DataFrame:
    """Companies of the unpacked master file; of repeated stocks the last in the file wins."""
    rows = spark.read.format("xml").option("rowTag", "list").schema(COMPANY).load(path)
    return _companies(rows.withColumn("_place", F.monotonically_increasing_id()))


def parse_company_master(contents: DataFrame, order: str, content: str = "content") -> DataFrame:
    """Companies of master files held as text, one file a row; of repeated stocks the last of the last file wins."""
    parsed = contents.select(F.col(order).alias("_file"), F.from_xml(content, f"list array<struct<{COMPANY}>>").alias("_x"))
    rows = parsed.select("_file", F.posexplode("_x.list")).select(F.struct("_file", "pos").alias("_place"), "col.*")
    return _companies(rows)


def _companies(rows: DataFrame) -> DataFrame:
    placed = rows.select(
        F.trim("stock_code").alias("stock"), F.trim("corp_code").alias("corp_code"), F.trim("corp_name").alias("name"), "_place",
    ).filter(F.col("stock").rlike("^[0-9A-Z]{6}$") & F.col("corp_code").rlike(r"^\d{8}$"))
    return latest_by(placed, ["stock"], [F.col("_place").desc()]).drop("_place")


def redact_metadata(metadata: Column) -> Column:
    """Metadata map without secret entries, and addresses without query and fragment."""
    safe = F.map_filter(metadata, lambda key, value: ~F.lower(key).isin(SECRET_KEYS))
    return F.transform_values(
        safe, lambda key, value: F.when(F.lower(key).isin(URL_KEYS), F.regexp_replace(value, r"[?#].*$", "")).otherwise(value)
    )
