"""Stable ids and order-independent table fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces of the published ids.
LIFECYCLE_NAMESPACE = "lifecycle-v1:"
INVESTABILITY_NAMESPACE = "investability-v1:"


def stable_id(prefix: str, key: Column) -> Column:
    """``prefix_`` and the first 20 hex digits of sha256 over the namespaced key."""
    digest = F.sha2(F.concat(F.lit(LIFECYCLE_NAMESPACE), key), 256)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 20))


def evidence_id(dataset: Column, requested_date: Column, raw_version_id: Column, row_number: Column) -> Column:
    """Id of one source row of one dataset, day and version."""
    text = F.concat(
        F.lit(INVESTABILITY_NAMESPACE),
        F.concat_ws(
            ":", dataset, requested_date.cast("string"), raw_version_id.cast("string"), row_number.cast("string")
        ),
    )
    return F.concat(F.lit("inv_"), F.substring(F.sha2(text, 256), 1, 20))


def _canonical(field: T.StructField) -> Column:
    """Text of one value after its length: equal values give equal text, null differs from empty.

    Doubles are written with all digits that tell them from their neighbours; -0.0 counts as 0.0, NaN as null.
    """
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = column.cast("double")
        text = F.when(~F.isnan(value), (value + F.lit(0.0)).cast("string"))
    elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        text = F.when(column.isNotNull(), F.to_json(F.struct(column)))
    else:
        text = column.cast("string")
    return F.coalesce(F.concat(F.lit("="), F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def row_digest(df: DataFrame) -> Column:
    """sha256 of a row, whatever the order of its columns."""
    fields = sorted(df.schema.fields, key=lambda field: field.name)
    parts = [F.concat(F.lit(f"{field.name}"), _canonical(field)) for field in fields]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


WORDS = ["w0", "w1", "w2", "w3"]


def _whole(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast("decimal(20,0)")


def digest_sums(digests: DataFrame, *keys: str) -> DataFrame:
    """``row_count, w0..w3`` of row digests, per key: four 60-bit words of each digest, summed as decimals.

    Sums do not depend on row order, count duplicates, combine before the shuffle, and can be added to and taken from: sums of parts add up
    to the sums of the whole, so what is stored per part need not be read again when another part changes.
    """
    # Halves of 30 bits are summed as longs, which 2^33 rows cannot overflow; decimals come in once per group.
    words = [F.conv(F.substring("digest", 1 + 15 * index, 15), 16, 10).cast("long") for index in range(len(WORDS))]
    halves = [_whole(F.sum(F.shiftright(word, 30))) * F.lit(1 << 30) + _whole(F.sum(word.bitwiseAND(F.lit((1 << 30) - 1)))) for word in words]
    sums = [half.cast("decimal(38,0)").alias(name) for name, half in zip(WORDS, halves)]
    return digests.groupBy(*keys).agg(F.count("digest").alias("row_count"), *sums)


def add_sums(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums of parts added up per key."""
    return sums.groupBy(*keys).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        *[F.coalesce(F.sum(w), F.lit(0)).cast("decimal(38,0)").alias(w) for w in WORDS])


def fingerprint_of_sums() -> Column:
    """The fingerprint that a count and four sums stand for."""
    return F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *[F.col(w).cast("string") for w in WORDS]), 256)


def _summed(digests: DataFrame, *keys: str) -> DataFrame:
    """``row_count, fingerprint`` of row digests, per key: one pass and a few numbers per task."""
    return digest_sums(digests, *keys).select(*keys, "row_count", fingerprint_of_sums().alias("fingerprint"))


def day_sums(df: DataFrame, day: str = "trade_date") -> DataFrame:
    """``(day, row_count, w0..w3)`` of the rows of each day."""
    return digest_sums(df.select(day, row_digest(df).alias("digest")), day)


def digest_tree(tables: Mapping[str, DataFrame], days: Mapping[str, str]) -> DataFrame:
    """Leaves ``(table_name, day, bucket, row_count, w0..w3)`` of named tables: rows by the day in ``days[name]`` and by the first hex
    digit of their digest.  Sums of leaves are the sums of days, tables and the model.
    """
    leaves = None
    for name in sorted(tables):
        rows = tables[name].select(
            F.lit(name).alias("table_name"), F.col(days[name]).cast("date").alias("day"), row_digest(tables[name]).alias("digest"))
        leaves = rows if leaves is None else leaves.unionByName(rows)
    return digest_sums(leaves.withColumn("bucket", F.substring("digest", 1, 1)), "table_name", "day", "bucket")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(row_count, fingerprint)``, whatever the order of the rows."""
    return _summed(df.select(row_digest(df).alias("digest")))


def fingerprints_by(df: DataFrame, key: str) -> DataFrame:
    """``(key, row_count, fingerprint)`` of the rows of each key."""
    return _summed(df.select(key, row_digest(df).alias("digest")), key)


def model_fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(fingerprint)`` over named tables: all their row digests go through one aggregate."""
    spark = next(iter(tables.values())).sparkSession
    # A row without digest for each name, so that an empty table has a fingerprint too.
    digests = spark.createDataFrame([(name, None) for name in sorted(tables)], "table_name string, digest string")
    for name in sorted(tables):
        digests = digests.unionByName(tables[name].select(F.lit(name).alias("table_name"), row_digest(tables[name]).alias("digest")))
    return _model_of(digest_sums(digests, "table_name"))


def _model_of(sums: DataFrame) -> DataFrame:
    parts = sums.select(F.concat_ws("=", "table_name", fingerprint_of_sums()).alias("part"))
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), ";"), 256).alias("fingerprint"))


def tree_fingerprint(leaves: DataFrame) -> DataFrame:
    """``(fingerprint)`` of the model whose digest tree is given: equal to ``model_fingerprint`` where every table has rows."""
    return _model_of(add_sums(leaves, "table_name"))
