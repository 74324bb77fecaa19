"""File-driven ingest of daily market payloads, one file a day and source.

A micro-batch registers its files in a ledger of immutable versions, judges each day against a small table of promoted day
summaries, records verdicts and findings, and promotes the days that pass.  Every table is partitioned by batch and turn and a batch reads
only what earlier ones wrote, so a batch that runs twice leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knownat.findings import findings, union_all
from knownat.functions.hashing import fingerprints_by
from knownat.operators import normalize as nm
from knownat.operators import quality as qu
from knownat.schemas import DAILY_MARKET_API, DAILY_MARKET_COLUMNS, DAILY_MARKET_CSV
from knownat.session import scratch_folder
from knownat.sources import landing as la
from knownat.sources.tables import promote_days, read_if_present, store_tables

#: Where a landed file lies: source, requested day, name.
LAYOUT = r"/([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$"


def judge_days(rows: DataFrame, history: DataFrame | None) -> DataFrame:
    """Verdicts of the days in ``rows`` (requested_date and canonical columns), after the promoted ``history`` days.

    Promoted days are never judged again: they are history for later days, whatever lands.  A day that lands once more stays
    promoted if its rows are the same and is quarantined if they are not, so the half of a day that comes later changes nothing.
    """
    hard = qu.validate_days(rows).groupBy("requested_date").agg(F.sum("n").alias("hard_errors"))
    facts = qu.day_facts(rows).join(hard, "requested_date", "left").select(
        F.col("requested_date").alias("trade_date"), "row_count", F.col("total_marcap").cast("double").alias("total_marcap"),
        F.coalesce("hard_errors", F.lit(0)).alias("hard_errors"), F.lit(False).alias("settled"),
    )
    if history is None:
        return _judge(facts)
    known = qu.day_summaries(history).select(
        "trade_date", "row_count", F.col("total_marcap").cast("double").alias("total_marcap"), F.lit(0).cast("long").alias("hard_errors"),
        F.lit(True).alias("settled"),
    )
    fresh = facts.join(known.select("trade_date"), "trade_date", "left_anti")
    judged = _judge(fresh.unionByName(known)).join(fresh.select("trade_date"), "trade_date", "left_semi")
    columns = sorted(set(rows.columns) & set(history.columns) - {"trade_date"})
    landed = fingerprints_by(rows.select(F.col("requested_date").alias("trade_date"), *columns), "trade_date")
    before = fingerprints_by(history.select("trade_date", *columns), "trade_date").withColumnRenamed("fingerprint", "_before")
    again = landed.join(before, "trade_date").select(
        "trade_date", F.when(F.col("fingerprint") == F.col("_before"), "promoted").otherwise("quarantined").alias("state"),
        F.lit(False).alias("row_anomaly"), F.lit(False).alias("cap_anomaly"),
    )
    return judged.unionByName(again)


def _judge(facts: DataFrame) -> DataFrame:
    return qu.resolve_day_states(facts.withColumns(
        {"changed": F.lit(False), "empty": F.lit(False), "attempts": F.lit(1), "evidence": F.lit(None).cast("string")}
    ))


def _earlier(spark: SparkSession, path: str, batch_id: int, turn: int = 0) -> DataFrame | None:
    """Rows written before this batch and turn; later ones belong to a run that is being replayed."""
    table = read_if_present(spark, path)
    return None if table is None else table.filter(
        (F.col("batch_id") < batch_id) | ((F.col("batch_id") == batch_id) & (F.col("turn") < turn)))


def _write(df: DataFrame, path: str, batch_id: int, turn: int) -> DataFrame:
    target = f"{path}/batch_id={batch_id}/turn={turn}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def file_columns(files: DataFrame) -> DataFrame:
    """``(path, columns, rule_id)`` per file: its sorted headers, or why it cannot be used.

    JSON headers are the keys of the first item of the first page; a page without items has none and is no fault.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    items = "$.pages[0].response.body.items.item"
    first = F.coalesce(F.json_object_keys(F.get_json_object("_text", items + "[0]")), F.json_object_keys(F.get_json_object("_text", items)))
    pages = files.filter("path LIKE '%.json'").withColumn("_text", text).select(
        "path", F.sort_array(first).alias("columns"),
        F.when(F.get_json_object("_text", "$.pages").isNull(), "unreadable_envelope").alias("rule_id"))
    rows, unusable = la.decode_files(files.filter("path LIKE '%.csv'"))
    decoded = rows.filter("source_row_number = 1").select("path", F.sort_array(F.array_distinct("header")).alias("columns")).unionByName(
        unusable, allowMissingColumns=True)
    other = files.filter("path NOT LIKE '%.json' AND path NOT LIKE '%.csv'").select(
        "path", F.lit(None).cast("array<string>").alias("columns"), F.lit("unknown_format").alias("rule_id"))
    return pages.unionByName(decoded).unionByName(other)


def register_files(files: DataFrame, batch_id: int, root: str) -> DataFrame:
    """Write the ledger of this batch: one row per delivered file that lies where a day's file belongs.

    ``fresh`` marks content not seen before for its source and day, ``changed`` content that follows a different version, ``drift``
    headers that differ from those of the source's version before.  ``turn`` orders the deliveries of one day in the batch.
    """
    spark = files.sparkSession
    placed = files.select(
        "path", "modificationTime", "content", F.regexp_extract("path", LAYOUT, 1).alias("dataset"),
        F.regexp_extract("path", LAYOUT, 2).try_cast("date").alias("trade_date")).filter("trade_date IS NOT NULL")
    landed = placed.select(
        "path", "dataset", F.col("trade_date").cast("string").alias("scope"), "trade_date", "content",
        F.sha2("content", 256).alias("sha256"), F.unix_micros(F.col("modificationTime")).alias("landing_seq"))
    key = ["dataset", "scope", "sha256"]
    before = _earlier(spark, f"{root}/ledger", batch_id)
    known = (before.select("raw_version_id", *key, "columns") if before is not None else spark.createDataFrame(
        [], "raw_version_id long, dataset string, scope string, sha256 string, columns array<string>")).distinct()
    new = la.register_raw(landed, known)
    described = landed.join(file_columns(landed), "path").join(new.select("raw_version_id", *key), key, "left").join(
        known.select(F.col("raw_version_id").alias("_known_id"), *key), key, "left")
    rows = described.select(
        "path", *key, "trade_date", "landing_seq", F.coalesce("raw_version_id", "_known_id").alias("raw_version_id"),
        F.col("raw_version_id").isNotNull().alias("fresh"), "columns", "rule_id")
    # One row per file: what follows reads it several times, the contents once.
    rows = store_tables({"described": rows}, scratch_folder(spark, "ingest"))["described"]
    versions = known.select("raw_version_id", "dataset", "scope", "columns").unionByName(
        rows.filter("fresh").select("raw_version_id", "dataset", "scope", "columns")).distinct()
    changed = la.changed_versions(versions.join(rows.select("dataset", "scope").distinct(), ["dataset", "scope"], "left_semi"))
    drift = qu.schema_drift(versions.filter("columns IS NOT NULL"))
    # One row per file; a day has few.
    order = Window.partitionBy("trade_date").orderBy("landing_seq", "path")
    ledger = (
        rows.join(changed.select("raw_version_id", F.lit(True).alias("_changed")), "raw_version_id", "left")
        .join(drift.select("raw_version_id", F.lit(True).alias("_drift")), "raw_version_id", "left")
        .select(*rows.columns, (F.col("fresh") & F.coalesce("_changed", F.lit(False))).alias("changed"),
                (F.col("fresh") & F.coalesce("_drift", F.lit(False))).alias("drift"), F.row_number().over(order).alias("delivery"))
    )
    return _write(ledger, f"{root}/ledger", batch_id, 0)


def landed_rows(files: DataFrame) -> DataFrame:
    """Canonical rows of files with ``requested_date, raw_version_id, delivery``, from paged JSON or official CSV."""
    carried = ["trade_date", "raw_version_id", "delivery"]
    text = files.filter("path LIKE '%.json'").select(*carried, F.col("content").cast("string").alias("content"))
    api, _ = la.read_paged_json(text, list(DAILY_MARKET_API))
    csv, _ = la.read_official_csv(files.filter("path LIKE '%.csv'"), [h for h in DAILY_MARKET_CSV if h != "단축코드"])
    csv = csv.join(files.select("path", *carried), "path")
    return union_all([
        nm.normalize_daily_market(rows.withColumnRenamed("trade_date", "requested_date"), ("requested_date", "raw_version_id", "delivery"))
        for rows in (api, csv)])


def judge_files(
    own: DataFrame, rows: DataFrame, summaries: DataFrame | None, attempts: DataFrame, notices: DataFrame | None = None,
) -> DataFrame:
    """Verdict per delivery of ``own`` (at most one a day), against the promoted days before each.

    Days promoted earlier stay promoted: the same version again is no news, any other one is quarantined.  Only the
    summaries from the twentieth promoted day before the first judged day on are read.
    """
    keys = ["trade_date", "raw_version_id"]
    facts = qu.day_facts(rows.drop("raw_version_id")).select(
        F.col("requested_date").alias("trade_date"), "row_count", F.col("total_marcap").cast("double").alias("total_marcap"),
        sum((F.col(rule) for rule in qu.DAY_RULES), F.lit(0)).alias("hard_errors"),
        F.coalesce(*[F.when(F.col(rule) > 0, rule) for rule in qu.DAY_RULES]).alias("first_rule"))
    notes = notices if notices is not None else own.sparkSession.createDataFrame([], "trade_date date, evidence string")
    unusable = F.col("rule_id").isNotNull()
    nothing = F.col("columns").isNull() & ~unusable
    days = own.join(facts, "trade_date", "left").join(attempts, "trade_date").join(notes, "trade_date", "left").withColumns({
        "empty": nothing,
        "first_rule": F.coalesce("rule_id", "first_rule", F.when(F.col("row_count").isNull() & ~nothing, "no_market_rows")),
        "row_count": F.coalesce("row_count", F.lit(0)), "total_marcap": F.coalesce("total_marcap", F.lit(0.0)),
    }).withColumn("hard_errors", F.coalesce("hard_errors", F.lit(0)) + F.when(F.col("first_rule").isNotNull(), 1).otherwise(0))
    settled = summaries if summaries is not None else own.sparkSession.createDataFrame(
        [], "trade_date date, row_count long, total_marcap double, raw_version_id long")
    done = settled.select("trade_date", F.col("raw_version_id").alias("_promoted"))
    days = days.join(done, "trade_date", "left")
    again = days.filter("_promoted IS NOT NULL").select(
        *keys, "dataset", F.when(F.col("_promoted") == F.col("raw_version_id"), "promoted").otherwise("quarantined").alias("state"),
        F.lit(False).alias("row_anomaly"), F.lit(False).alias("cap_anomaly"), "changed", "drift", "first_rule", "attempts",
        "row_count", "total_marcap", F.lit(True).alias("settled"))
    fresh = days.filter("_promoted IS NULL")
    first = fresh.agg(F.min("trade_date")).scalar()
    last = fresh.agg(F.max("trade_date")).scalar()
    history = settled.filter(F.col("trade_date") < first).orderBy(F.col("trade_date").desc()).limit(qu.HISTORY).unionByName(
        settled.filter((F.col("trade_date") >= first) & (F.col("trade_date") <= last)))
    known = history.select(
        "trade_date", "row_count", "total_marcap", F.lit(0).cast("long").alias("hard_errors"), F.lit(False).alias("changed"),
        F.lit(False).alias("empty"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("evidence"), F.lit(True).alias("settled"))
    asked = fresh.select(
        "trade_date", "row_count", "total_marcap", "hard_errors", (F.col("changed") | F.col("drift")).alias("changed"), "empty", "attempts",
        "evidence", F.lit(False).alias("settled"))
    states = qu.resolve_day_states(asked.unionByName(known))
    judged = fresh.join(states, "trade_date").select(
        *keys, "dataset", "state", "row_anomaly", "cap_anomaly", "changed", "drift", "first_rule", "attempts", "row_count", "total_marcap",
        F.lit(False).alias("settled"))
    return judged.unionByName(again)


def verdict_findings(verdicts: DataFrame) -> DataFrame:
    """What stands against each delivery: the first broken rule, else every reason for quarantine."""
    failed = verdicts.filter("state = 'failed'")
    held = verdicts.filter("state = 'quarantined'")
    reasons = {
        "row_count_anomaly": "row_anomaly", "marcap_anomaly": "cap_anomaly", "changed_checksum": "changed", "schema_drift": "drift",
        "day_already_promoted": "settled AND NOT changed",
    }
    named = held.withColumn("rule_id", F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in reasons.items()]))))
    evidence = F.array(F.col("raw_version_id").cast("string"))
    return union_all([
        findings(failed, source="ingest", severity="blocking", rule=F.coalesce("first_rule", F.lit("no_rows")), subject=F.col("dataset"),
                 date=F.col("trade_date"), evidence=evidence),
        findings(named, source="ingest", severity="quarantine", rule=F.col("rule_id"), subject=F.col("dataset"), date=F.col("trade_date"),
                 observed=F.when(F.col("rule_id") == "row_count_anomaly", F.col("row_count").cast("string")), evidence=evidence),
    ])


def ingest_files(files: DataFrame, batch_id: int, root: str, notices: DataFrame | None = None) -> None:
    """Take in one batch of landed files (``path, modificationTime, content``) below ``root``.

    Tables: ``ledger`` (deliveries), ``rows`` (canonical rows of all deliveries), ``verdicts``, ``findings``, ``summaries`` (promoted
    days) and ``market`` (their rows with ``raw_version_id``, partitioned by day).  Of a day delivered more than once the deliveries are
    judged one turn after the other.  ``notices`` (trade_date, evidence) confirm days without a session.
    """
    spark = files.sparkSession
    ledger = register_files(files, batch_id, root)
    turns = ledger.agg(F.max("delivery")).first()[0] or 0
    before = _earlier(spark, f"{root}/ledger", batch_id)
    parsed = landed_rows(files.select("path", "content").join(ledger.select("path", "trade_date", "raw_version_id", "delivery"), "path"))
    parsed = _write(parsed, f"{root}/rows", batch_id, 0)
    for turn in range(1, turns + 1):
        own = ledger.filter(F.col("delivery") == turn)
        so_far = ledger.filter(F.col("delivery") <= turn).select("trade_date")
        if before is not None:
            so_far = so_far.unionByName(before.select("trade_date"))
        attempts = so_far.join(own.select("trade_date"), "trade_date", "left_semi").groupBy("trade_date").agg(
            F.count("*").cast("int").alias("attempts"))
        rows = parsed.filter(F.col("delivery") == turn).drop("delivery")
        summaries = _earlier(spark, f"{root}/summaries", batch_id, turn)
        if summaries is not None:
            summaries = summaries.drop("batch_id", "turn")
        verdicts = _write(judge_files(own, rows, summaries, attempts, notices), f"{root}/verdicts", batch_id, turn)
        _write(verdict_findings(verdicts), f"{root}/findings", batch_id, turn)
        passed = verdicts.filter("state = 'promoted' AND NOT settled")
        # Rows first: a summary speaks of a day whose rows are there.
        promote_days(
            rows.join(passed.select("raw_version_id"), "raw_version_id", "left_semi").select(*DAILY_MARKET_COLUMNS, "raw_version_id"),
            f"{root}/market")
        _write(passed.select("trade_date", "row_count", "total_marcap", "raw_version_id"), f"{root}/summaries", batch_id, turn)


def ingest_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, notices: DataFrame | None = None) -> StreamingQuery:
    """Take in the files that lie under ``landing`` (``<source>/<day>/<name>.json|csv``) and are new since the checkpoint."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    landed = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(landing)

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_files(batch, batch_id, root, notices)

    return landed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
