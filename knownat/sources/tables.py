"""Published tables: whole-day replacement, upserts, runs and model revisions.

A set of tables becomes visible through a small row written last, so a reader never sees half a write.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.functions.hashing import add_sums, day_sums, fingerprint_of_sums, model_fingerprint
from knownat.functions.ordered import latest_by, small_side
from knownat.schemas import TRANSITIONS


def promote_days(df: DataFrame, path: str, states: DataFrame | None = None, sums: str | None = None) -> None:
    """Replace the partitions of the days in ``df``; other days stay.

    With ``states`` (trade_date, state) only days that may step to promoted are written.  With ``sums`` the digest sums of the same days
    are added to the table there (one row a day), from which ``stored_fingerprint`` is read: promoting a day costs that day.
    """
    ready = [state for state, targets in TRANSITIONS.items() if "promoted" in targets]
    if states is not None:
        df = df.join(states.filter(F.col("state").isin(ready)).select("trade_date").distinct(), "trade_date", "left_semi")
    # Rebalancing gathers a day's rows into few files but splits a day that is too large for one task.
    (df.hint("rebalance", "trade_date").sortWithinPartitions("trade_date", "code").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path))
    if sums is not None:
        spark = df.sparkSession
        # Read back what is stored for these days only: the days, one row each, prune the partitions.
        kept = spark.read.parquet(path).join(small_side(df.select("trade_date").distinct()), "trade_date", "left_semi")
        before = read_if_present(spark, sums)
        turn = 0 if before is None else before.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0]
        # One file, but many tasks for the digests: the rows of days are shuffled into one task only once they are summed.
        day_sums(kept.select(*df.columns)).withColumn("turn", F.lit(turn + 1)).repartition(1).write.mode("append").parquet(sums)


def stored_fingerprint(spark: SparkSession, sums: str) -> DataFrame:
    """``(row_count, fingerprint)`` of the promoted table, from the newest stored sums of each day: no market row is read."""
    newest = latest_by(spark.read.parquet(sums), ["trade_date"], [F.col("turn").desc()])
    return add_sums(newest).select("row_count", fingerprint_of_sums().alias("fingerprint"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows with the new winning per key; of several new ones the highest ``seq``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by(both, list(keys), [F.col("_new").desc(), F.col("seq").desc()]).drop("_new")


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored, one per key: what an insert-or-ignore would add."""
    first = latest_by(new, list(keys), [F.col("seq").asc()])
    return first.join(old.select(*keys).distinct(), list(keys), "left_anti")


def touched_partitions(path: str, new: DataFrame, part: str, most: int = 10_000) -> DataFrame | None:
    """Stored rows of the partitions of ``part`` that ``new`` has rows in, or None before the first write.

    At most ``most`` values are read for the driver and prune the scan; beyond that a join by ``part`` picks them.
    """
    spark = new.sparkSession
    if read_if_present(spark, path) is None:
        return None
    stored = spark.read.schema(new.schema).parquet(path)
    values = [row[0] for row in new.select(part).distinct().limit(most + 1).collect()]
    if len(values) > most:
        return stored.join(new.select(part).distinct(), stored[part].eqNullSafe(new[part]), "left_semi")
    known = F.col(part).isin([v for v in values if v is not None])
    return stored.filter(known | F.col(part).isNull() if None in values else known)


def upsert_into(new: DataFrame, path: str, keys: Sequence[str], part: str) -> None:
    """Put ``new`` into the stored table: its rows win per key, of several the one of the highest ``seq``.

    ``part`` is a column that all rows of one key share, such as the month of a key's date.  Only partitions that ``new`` has rows in are
    read and written; files of all others stay as they are.  Repeating a write that stopped half-way gives the same table.
    """
    old = touched_partitions(path, new, part)
    rows = upsert(new.filter("false") if old is None else old, new, keys)
    (rows.hint("rebalance", part).sortWithinPartitions(part, *keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))


def append_into(new: DataFrame, path: str, keys: Sequence[str], part: str) -> None:
    """Add the rows of ``new`` whose key is not stored, one per key (the lowest ``seq``); stored files stay as they are.

    Only partitions that ``new`` has rows in are searched for keys; ``part`` is as in ``upsert_into``.
    """
    old = touched_partitions(path, new, part)
    fresh = append_new(new.filter("false") if old is None else old, new, keys)
    fresh.hint("rebalance", part).sortWithinPartitions(part, *keys).write.mode("append").partitionBy(part).parquet(path)


def export_csv(df: DataFrame, path: str, headers: Mapping[str, str]) -> None:
    """CSV with renamed headers; each part starts with its header and the UTF-8 mark office programs expect."""
    mark = "\ufeff"
    renamed = df.withColumnsRenamed(dict(headers))
    first, *rest = renamed.columns
    renamed.withColumnRenamed(first, mark + first).write.mode("overwrite").option("header", True).csv(path)


def save_run(spark: SparkSession, path: str, run_id: int, header: Mapping[str, str], tables: Mapping[str, DataFrame]) -> None:
    """Store the tables of one run; the header row goes last and makes the run visible.  A finished run is not replaced."""
    finished = read_if_present(spark, f"{path}/header")
    if finished is not None and finished.filter(F.col("run_id") == run_id).limit(1).count():
        raise FileExistsError(f"run {run_id} is stored already")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")
    row = {"run_id": run_id, **{key: str(value) for key, value in header.items()}}
    fields = ", ".join(f"`{key}` {'long' if key == 'run_id' else 'string'}" for key in row)
    spark.createDataFrame([tuple(row.values())], fields).coalesce(1).write.mode("append").parquet(f"{path}/header")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Finished runs, newest first."""
    return spark.read.parquet(f"{path}/header").orderBy(F.col("run_id").desc())


def load_run(spark: SparkSession, path: str, run_id: int, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of a finished run."""
    if runs(spark, path).filter(F.col("run_id") == run_id).limit(1).count() == 0:
        raise KeyError(run_id)
    return {name: spark.read.parquet(f"{path}/{name}/run_id={run_id}") for name in names}


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def current_revision(spark: SparkSession, path: str) -> int:
    """Newest promoted revision, 0 when there is none."""
    meta = read_if_present(spark, f"{path}/meta")
    return 0 if meta is None else meta.agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]


def promote_model(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], selection: DataFrame) -> int:
    """Write all tables under the next revision, then its meta row with fingerprint and selection.

    A failure before the last step leaves the earlier revision the current one.
    """
    revision = current_revision(spark, path) + 1
    written = {}
    for name, table in tables.items():
        target = f"{path}/{name}/revision={revision}"
        table.write.mode("overwrite").parquet(target)
        written[name] = spark.read.parquet(target)
    chosen = selection.select(F.concat_ws("=", "dataset", F.col("raw_version_id").cast("string")).alias("pair"))
    picked = chosen.agg(F.array_join(F.sort_array(F.collect_set("pair")), ",")).scalar()
    meta = model_fingerprint(written).select(F.lit(revision).alias("revision"), "fingerprint", picked.alias("selection"))
    meta.coalesce(1).write.mode("append").parquet(f"{path}/meta")
    return revision


def load_model(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of the current revision."""
    revision = current_revision(spark, path)
    if not revision:
        raise KeyError(path)
    return {name: spark.read.parquet(f"{path}/{name}/revision={revision}") for name in names}


def store_tables(tables: Mapping[str, DataFrame], path: str, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Write named tables once and read them back, so that each reader scans a table instead of making it anew.

    Tables that have all ``keys`` are dealt and sorted by them: a reader that asks for few keys skips most row groups.
    """
    stored = {}
    for name, table in tables.items():
        if keys and set(keys) <= set(table.columns):
            # Rebalancing splits a key that is too large for one task.
            table = table.hint("rebalance", *keys).sortWithinPartitions(*keys)
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        stored[name] = table.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}")
    return stored


def append_journal(proposal: DataFrame, path: str, note: str, settings: str) -> None:
    """Add a proposal with its note and settings to the journal."""
    stamped = proposal.withColumns({"note": F.lit(note), "settings": F.lit(settings), "saved_at": F.current_timestamp()})
    stamped.write.mode("append").parquet(path)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal entries, newest first."""
    return spark.read.parquet(path).orderBy(F.col("saved_at").desc())
