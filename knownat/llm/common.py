"""Tables kept in the shared folder, the split of labelled rows, and small helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts define it.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine may lack the setting; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="knownat-llm-"))
    return os.path.dirname(context.getCheckpointDir().rstrip("/"))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back: no executor's loss undoes them."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def normal_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8(texts: pa.Array) -> list[bytes]:
    """Bytes of each text, null as empty, without a detour over str."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def crc_of_ids(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def lower_table() -> bytes:
    """Byte translation that lower-cases A-Z and nothing else."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that ``df`` has no column of, whatever its case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_scores(docs: DataFrame, scorer, threshold: float) -> DataFrame:
    """All columns of ``docs``, then ``_score`` double and ``_predicted`` int; ``scorer`` maps a column of texts to an array.

    Columns of these two names are replaced.
    """
    docs = docs.drop("_score", "_predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray(scorer(batch.column(at)), np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [*batch.schema.names, "_score", "_predicted"])

    at = docs.columns.index("text")
    fields = [*docs.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType(fields))


def keep_predicted(docs: DataFrame, judge, wanted: int) -> DataFrame:
    """The rows of ``docs`` that ``judge`` predicts as ``wanted``, with all their columns, also those named like its own two."""
    hidden = {name: free_name(docs, name) for name in docs.columns if name.lower() in ("_score", "_predicted")}
    judged = judge(docs.withColumnsRenamed(hidden)).where(F.col("_predicted") == wanted)
    return judged.select(*[F.col(hidden.get(name, name)).alias(name) for name in docs.columns])


def bounded_sample(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> list[tuple[str, float]]:
    """Text and label of at most ``rows`` labelled documents, of at most ``chars`` characters in all.

    ``labels`` has ``doc_id, _label``, one row per id.  Each id gives one text, its shortest (of equal lengths the one with the smallest
    hash), however many rows carry the id.  Documents come in the order of a hash of their id; one that is longer than an
    eighth of ``chars`` is passed over.  Ids, lengths and hashes are chosen first, at most ``rows`` of them, and only the chosen
    texts are read for the driver.  The same rows give the same sample in any order and partitioning.
    """
    sized = docs.select("doc_id", "text", F.length(normal_text()).alias("_size"), F.xxhash64("doc_id", normal_text()).alias("_print"))
    sized = sized.where(F.col("doc_id").isNotNull() & (F.col("_size") <= chars // 8))
    each = sized.groupBy("doc_id").agg(F.min(F.struct("_size", "_print")).alias("_one")).select("doc_id", "_one.*")
    order = each.join(labels, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    chosen: dict = {}
    used = 0
    for row in order.collect():
        used += row["_size"]
        if used > chars:
            break
        chosen[row["doc_id"]] = (row["_size"], row["_print"], float(row["_label"]))
    if not chosen:
        return []
    # Bounded by ``rows`` ids and hashes, so the lists may go along with the scan.  Repeats of one text are one row after the grouping.
    picked = sized.where(F.col("doc_id").isin(list(chosen)) & F.col("_print").isin([p for _, p, _ in chosen.values()]))
    texts = picked.groupBy("doc_id", "_size", "_print").agg(F.min("text").alias("text")).collect()
    found = {r["doc_id"]: r["text"] or "" for r in texts if chosen[r["doc_id"]][:2] == (r["_size"], r["_print"])}
    return [(found[key], label) for key, (_, _, label) in chosen.items()]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0, by Stirling's series after shifting x up to 8."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    inverse = 1.0 / (y * y)
    series = (1 / 12.0 - inverse * (1 / 360.0 - inverse * (1 / 1260.0 - inverse / 1680.0))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift
