"""Token-id tables in Parquet: a list column of ids beside small metadata columns, in document order.

Each file holds rows in ascending ``doc_id`` order.  Row groups and pages are kept small, and Spark's writer adds column and
offset indexes, so a reader that asks for some documents or for the metadata only skips the pages of the other ids.  Ids are
dictionary-encoded (or delta-encoded where the dictionary is switched off), lists are stored flat with repetition levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knownat.llm.common import crc_of_ids, new_folder
from knownat.llm.encode import encoder, gathered

#: Documented layout: bytes of a row group and of a page before compression.
ROW_GROUP, PAGE = 32 << 20, 256 << 10


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows ``doc_id, part, part_start, n_tokens, ids`` in ascending ``doc_id`` order.

    ``part`` numbers the ordered parts, ``part_start`` counts the ids of the part's earlier documents.  Null ids come first;
    rows that repeat an id stand side by side, ordered by a hash of their text.  Nulls and empty texts hold the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in gathered(batches):
            ids = [found + end for found in own.encode_all(batch.column("text"))]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            edges = np.concatenate([[0], np.cumsum(counts)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "part": pa.array(np.full(len(ids), part, np.int32)),
                "part_start": pa.array(before + edges[:-1]),
                "n_tokens": pa.array(counts),
                "ids": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values),
            })
            before += int(edges[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = (
        docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    return ordered.mapInArrow(run, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, dictionary: bool = True) -> None:
    """Write ``folder/ids`` and the small ``folder/parts`` (ids before each part)."""
    spark = docs.sparkSession
    (
        encode_sorted(docs, tokenizer, end_id).write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE).option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.dictionary.page.size", 1 << 20).parquet(f"{folder}/ids")
    )
    totals = spark.read.parquet(f"{folder}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per part, not per document: the running sum is as small as the list of files.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("ids_before")).coalesce(1).write.parquet(f"{folder}/parts")


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens`` of every document; the pages of ids are not read."""
    rows = spark.read.parquet(f"{folder}/ids").select("doc_id", "part", "part_start", "n_tokens")
    return _started(rows, spark, folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``, of all or of the given documents; the page index finds the latter."""
    rows = spark.read.parquet(f"{folder}/ids")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return _started(rows, spark, folder)


def _started(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/parts")
    return rows.join(parts, "part").withColumn("start", F.col("part_start") + F.col("ids_before")).drop(
        "part", "part_start", "ids_before")


def check_ids(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by their ``ids_crc32``, each id taken as four little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, edges = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            crc = [crc_of_ids(values[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            kept = {name: batch.column(name) for name in ("doc_id", "start", "n_tokens")}
            yield pa.RecordBatch.from_pydict(kept | {"ids_crc32": pa.array(crc, pa.int64())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to the shared folder, then read back one checked row per document."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, end_id)
    return check_ids(read_tokens(docs.sparkSession, folder))
