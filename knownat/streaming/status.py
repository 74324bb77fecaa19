"""Streamed status assertions with change propagation to the decisions that stand on them.

Landed status rows become assertions once; a later one never rewrites what was decided for times before it was known.  Per
micro-batch only those standing requests are decided anew that new evidence can reach: requests of a security from the instant its new
assertion can be used, and requests on days that newly covered days join to the evidence before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knownat.findings import union_all
from knownat.functions import calendar as cal
from knownat.functions import text as tx
from knownat.functions.ordered import latest_by
from knownat.operators import investability as iv
from knownat.schemas import Policy
from knownat.sources.tables import read_if_present

DECISION = ["security_id", "as_of", "state", "reason_codes", "evidence_ids", "policy_fingerprint"]


@dataclass(frozen=True)
class Standing:
    """What assertions are tied to and decided for: listings, sessions and standing requests ``(security_id, as_of)``."""

    lifecycle: DataFrame
    sessions: DataFrame
    requests: DataFrame
    policy: Policy = iv.V1


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    table = read_if_present(spark, path)
    return None if table is None else table.filter(F.col("batch_id") < batch_id)


def _write(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    target = f"{path}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def _assertions(joined: DataFrame, standing: Standing) -> tuple[DataFrame, DataFrame]:
    """Assertions of identified rows, with ``date_only`` where the time was left to the calendar, and their findings."""
    tied, ambiguous = iv.split_identity(joined)
    given = F.col("published_at").isNotNull()
    if dict(joined.dtypes)["published_at"] == "string":
        given = tx.clean(F.col("published_at")) != ""
    dated = iv.with_known_at(tied, standing.sessions).select(
        "evidence_id", "security_id", "requested_date", F.col("effective_date").alias("effective_from"), "known_at", "observed_at",
        "market", "security_kind", *iv.FLAGS, "raw_version_id", "source_row_number", (~F.coalesce(given, F.lit(False))).alias("date_only"))
    return dated, union_all([ambiguous, iv.unreadable_times(tied)])


def _dated_now(waiting: DataFrame, sessions: DataFrame) -> DataFrame:
    """Date-only assertions that had no next session when they landed and have one now."""
    following = cal.with_next_session(waiting, F.col("effective_from"), sessions, "_next")
    return following.withColumn("known_at", cal.at_seoul(F.col("_next"))).drop("_next").filter("known_at IS NOT NULL")


def newest_assertions(assertions: DataFrame) -> DataFrame:
    """Each assertion once, as its last batch wrote it."""
    return latest_by(assertions, ["evidence_id"], [F.col("batch_id").desc()])


def joined_days(sessions: DataFrame, coverage: DataFrame, new_days: DataFrame) -> DataFrame:
    """Days whose decisions newly covered days can change: from each such day to the last session before the next gap.

    ``(day, run_start)``: evidence before ``run_start``, the first session of the covered run, cannot count on that day.  Calendars
    have one row a day.
    """
    runs = cal.coverage_runs(sessions, coverage).select("session_date", "covered", "gaps_to")
    run = Window.partitionBy("gaps_to")
    marked = runs.join(new_days.select(F.col("requested_date").alias("session_date"), F.lit(True).alias("_new")), "session_date", "left")
    return marked.withColumns({
        "_first_new": F.min(F.when(F.col("_new"), F.col("session_date"))).over(run),
        "run_start": F.min(F.when(F.col("covered"), F.col("session_date"))).over(run),
    }).filter("covered AND session_date >= _first_new").select(F.col("session_date").alias("day"), "run_start")


def reached(requests: DataFrame, new: DataFrame, days: DataFrame) -> DataFrame:
    """Standing requests whose decision the new assertions or the newly joined days can change."""
    usable = F.greatest(F.col("known_at"), cal.at_seoul(F.col("effective_from")), cal.at_seoul(F.col("requested_date")))
    first = new.filter("known_at IS NOT NULL").groupBy("security_id").agg(F.min(usable).alias("_from"))
    later = requests.join(first, "security_id").filter("as_of >= _from").select("security_id", "as_of")
    joined = requests.withColumn("day", cal.seoul_day(F.col("as_of"))).join(days.select("day"), "day", "left_semi").select("security_id", "as_of")
    return later.unionByName(joined).distinct()


def status_batch(rows: DataFrame, batch_id: int, root: str, standing: Standing) -> None:
    """Append the assertions of landed status rows (as ``normalize_status`` gives them) and decide anew what they reach.

    Tables below ``root``, one partition a batch: ``coverage`` (days newly asked for), ``identified`` (landed rows with their
    matches), ``assertions``, ``findings``, ``reached`` (requests to decide anew) and ``decisions`` (of these).  A batch reads what earlier batches wrote, so a replay writes the same partition again.
    Before the first batch every standing request counts as undecided; ``current_decisions`` says what such requests get.
    """
    spark = rows.sparkSession
    seen_days, seen = _before(spark, f"{root}/coverage", batch_id), _before(spark, f"{root}/assertions", batch_id)
    asked = rows.select("requested_date").distinct()
    fresh_days = asked if seen_days is None else asked.join(seen_days.select("requested_date"), "requested_date", "left_anti")
    new_days = _write(fresh_days, f"{root}/coverage", batch_id)
    # Assertions and findings both read the tied rows, which are kept for that.
    made, found = _assertions(_write(iv.identified(rows, standing.lifecycle, asked), f"{root}/identified", batch_id), standing)
    if seen is not None:
        # A row that lands twice is one assertion; one whose next session is known by now becomes usable.
        again = newest_assertions(seen)
        made = made.join(seen.select("evidence_id"), "evidence_id", "left_anti")
        waiting = again.filter("known_at IS NULL AND date_only").drop("batch_id")
        made = made.unionByName(_dated_now(waiting, standing.sessions))
    new = _write(made.dropDuplicates(["evidence_id"]), f"{root}/assertions", batch_id)
    _write(found, f"{root}/findings", batch_id)

    coverage = new_days if seen_days is None else new_days.unionByName(seen_days.select("requested_date"))
    days = joined_days(standing.sessions, coverage, new_days)
    todo = _write(reached(standing.requests, new, days), f"{root}/reached", batch_id)
    if seen is None:
        known = new
    else:
        known = newest_assertions(seen.unionByName(new.withColumn("batch_id", F.lit(batch_id)))).drop("batch_id")
    # Only securities with something to decide are scanned.
    known = known.join(todo.select("security_id").distinct(), "security_id", "left_semi").drop("date_only")
    listings = standing.lifecycle.join(todo.select("security_id").distinct(), "security_id", "left_semi")
    model = iv.StatusModel(known, known, coverage, listings, standing.sessions, found)
    _write(iv.decide(model, todo, standing.policy).select(*DECISION), f"{root}/decisions", batch_id)


def current_decisions(spark: SparkSession, root: str, standing: Standing) -> DataFrame:
    """The last decision of every standing request, with the batch that made it; null batch where none was reached yet."""
    made = read_if_present(spark, f"{root}/decisions")
    last = latest_by(made, ["security_id", "as_of"], [F.col("batch_id").desc()])
    never = standing.requests.select("security_id", "as_of").distinct().join(last.select("security_id", "as_of"), ["security_id", "as_of"], "left_anti")
    # No batch reached these: nothing usable is known of them, so the model decides from coverage and listings alone.
    coverage = spark.read.parquet(f"{root}/coverage").select("requested_date")
    nothing = spark.read.parquet(f"{root}/assertions").drop("batch_id", "date_only").limit(0)
    model = iv.StatusModel(nothing, nothing, coverage, standing.lifecycle, standing.sessions, nothing)
    rest = iv.decide(model, never, standing.policy).select(*DECISION, F.lit(None).cast(last.schema["batch_id"].dataType).alias("batch_id"))
    return last.select(*DECISION, "batch_id").unionByName(rest)


def all_assertions(spark: SparkSession, root: str) -> DataFrame:
    """Assertions of all batches, each once."""
    return newest_assertions(spark.read.parquet(f"{root}/assertions")).drop("batch_id", "date_only")


def status_stream(
    spark: SparkSession, landing: str, schema: str, root: str, checkpoint: str, standing: Standing,
) -> StreamingQuery:
    """Take in landed parquet files of normalised status rows that are new since the checkpoint."""
    landed = spark.readStream.schema(schema).parquet(landing)

    def handle(batch: DataFrame, batch_id: int) -> None:
        status_batch(batch, batch_id, root, standing)

    return landed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
