"""Designation and halt histories of many securities: checks, states on dates, timing audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.findings import explode_reasons, findings
from knownat.functions.text import clock_text
from knownat.schemas import MARKETS

# Events of a designation history.
DESIGNATED, RELEASED, NO_EVENT = "지정", "해제", "-"


def _row_checks() -> dict:
    return {
        "bad_code": ~F.coalesce(F.col("code").rlike(r"^\d{6}$"), F.lit(False)),
        "name_missing": F.trim(F.coalesce("name", F.lit(""))) == "",
        "bad_market": ~F.coalesce(F.col("market").isin(list(MARKETS)), F.lit(False)),
    }


def _split_files(rows: DataFrame, row_checks: dict, file_checks: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """A file with any finding is left out as a whole."""
    per_row = explode_reasons(rows, row_checks).select("file", "source_row_number", "rule_id")
    per_file = file_checks.select("file", F.lit(None).cast("long").alias("source_row_number"), "rule_id")
    found = per_row.unionByName(per_file)
    good = rows.join(found.select("file").distinct(), "file", "left_anti")
    return good, findings(
        found, source=source, severity="blocking", rule=F.col("rule_id"), subject=F.col("file"), observed=F.col("source_row_number")
    )


def designation_history(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows and findings; a file holds one security, one row per date and at least one event.

    Columns file, code, name, market, date, event, reason, source_row_number.
    """
    checks = {
        **_row_checks(), "bad_date": F.col("date").isNull(),
        "bad_event": ~F.coalesce(F.col("event").isin(DESIGNATED, RELEASED, NO_EVENT), F.lit(False)),
    }
    daily = rows.groupBy("file", "date").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("event").isin(DESIGNATED, RELEASED).cast("int")).alias("_events"),
        F.min(F.struct("code", "name", "market")).alias("_a"), F.max(F.struct("code", "name", "market")).alias("_b"),
    )
    files = daily.groupBy("file").agg(
        F.max("_n").alias("_copies"), F.max("_events").alias("_events"), F.min("_a").alias("_a"), F.max("_b").alias("_b")
    )
    file_checks = explode_reasons(files, {
        "several_securities": F.col("_a") != F.col("_b"), "duplicate_date": F.col("_copies") > 1, "no_event": F.coalesce("_events", F.lit(0)) == 0,
    })
    return _split_files(rows, checks, file_checks, "designation")


def _with_last_event(history: DataFrame) -> DataFrame:
    order = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("event") != NO_EVENT, F.col("event"))
    last = F.last(event, ignorenulls=True).over(order)
    state = F.when(last == DESIGNATED, "designated").when(last == RELEASED, "released").otherwise("unknown")
    return history.withColumn("state", state)


def designation_state(history: DataFrame, requests: DataFrame) -> DataFrame:
    """State per (code, date): unknown unless the export has that date, else by the last event up to it.

    One row per code and date after the checks, so the window is bounded by the calendar.
    """
    known = _with_last_event(history).select("code", "date", "state")
    return requests.select("code", "date").distinct().join(known, ["code", "date"], "left").select(
        "code", "date", F.coalesce("state", F.lit("unknown")).alias("state")
    )


def event_boundaries(history: DataFrame) -> DataFrame:
    """Each event row and the row before it, with the derived state."""
    order = Window.partitionBy("code").orderBy("date")
    staged = _with_last_event(history).withColumn("_next", F.lead("event").over(order))
    return staged.filter(F.col("event").isin(DESIGNATED, RELEASED) | F.col("_next").isin(DESIGNATED, RELEASED)).select(
        "code", "date", "event", "state"
    )


def halt_intervals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable halts and findings: resumption not before the halt, no overlap, only the last may be open.

    Columns file, code, name, market, halt_date, resume_date, source_row_number.
    """
    checks = {
        **_row_checks(), "bad_halt_date": F.col("halt_date").isNull(),
        "resumed_before_halt": F.coalesce(F.col("resume_date") < F.col("halt_date"), F.lit(False)),
    }
    # Halts of one day collapse to their count and latest end first: rows per file are then bounded by the calendar.
    open_end = F.lit("9999-12-31").cast("date")
    daily = rows.groupBy("file", "halt_date").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce("resume_date", open_end) > F.col("halt_date")).alias("_long"),
        F.max(F.coalesce("resume_date", open_end)).alias("_until"),
        F.min(F.struct("code", "name", "market")).alias("_a"), F.max(F.struct("code", "name", "market")).alias("_b"),
    )
    order = Window.partitionBy("file").orderBy("halt_date")
    clash = (F.lag("_until").over(order) > F.col("halt_date")) | ((F.col("_n") > 1) & (F.col("_long") > 0))
    files = daily.withColumn("_clash", F.coalesce(clash, F.lit(False))).groupBy("file").agg(
        F.bool_or("_clash").alias("_clash"), F.min("_a").alias("_a"), F.max("_b").alias("_b")
    )
    file_checks = explode_reasons(files, {"overlapping_halts": F.col("_clash"), "several_securities": F.col("_a") != F.col("_b")})
    return _split_files(rows, checks, file_checks, "halt")


def halt_state(halts: DataFrame, requests: DataFrame) -> DataFrame:
    """State per (code, date): suspended on the halt date and inside a closed halt, resumption_event at its end.

    Everything else is unknown.  Requests and halts of a code form one ordered series; a request looks at the
    last halt begun before it, and at one begun on its own day.
    """
    real = halts.filter(~F.coalesce(F.col("resume_date") == F.col("halt_date"), F.lit(False)))
    span = F.struct("halt_date", "resume_date")
    marks = real.groupBy("code", F.col("halt_date").alias("date")).agg(F.min(span).alias("_halt"))
    asked = requests.select("code", "date").distinct().withColumn("_asked", F.lit(True))
    series = asked.join(marks, ["code", "date"], "full_outer")
    before = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    seen = series.withColumn("_prior", F.last("_halt", ignorenulls=True).over(before)).filter("_asked")
    end = F.col("_prior.resume_date")
    state = (
        F.when(end > F.col("date"), "suspended").when(end == F.col("date"), "resumption_event")
        .when(F.col("_halt").isNotNull(), "suspended").otherwise("unknown")
    )
    return seen.select("code", "date", state.alias("state"))


def _timing(joined: DataFrame, matches) -> DataFrame:
    """Boolean audit columns shared by both histories; publication is never verified from files alone."""
    first, second = F.col("first_disclosed_at"), F.col("second_disclosed_at")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    ordered = (
        (F.col("first_disclosed_on") <= F.col("first_effective_on"))
        & (F.col("first_effective_on") < F.col("second_disclosed_on"))
        & (F.col("second_disclosed_on") <= F.col("second_effective_on"))
    )
    malformed = (~blank(first) & ~clock_text(first)) | (~blank(second) & ~clock_text(second))
    return joined.select(
        "code", matches.alias("effective_dates_match"), F.coalesce(ordered, F.lit(False)).alias("calendar_order_valid"),
        (~blank(first) & ~blank(second)).alias("publication_times_recorded"), F.lit(False).alias("publication_time_verified"),
        F.when(malformed, "bad_clock").alias("reason"),
    )


def compare_designation_timing(history: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Disclosed against recorded effective dates of a designation (first) and its release (second), per code."""
    events = history.filter(F.col("event") != NO_EVENT).select("code", "date", "event").distinct()
    starts = events.filter(F.col("event") == DESIGNATED).select("code", F.col("date").alias("first_effective_on"), F.lit(1).alias("_a"))
    ends = events.filter(F.col("event") == RELEASED).select("code", F.col("date").alias("second_effective_on"), F.lit(1).alias("_b"))
    joined = disclosures.join(starts, ["code", "first_effective_on"], "left").join(ends, ["code", "second_effective_on"], "left")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("first_effective_on") < F.col("second_effective_on"))
    return _timing(joined, F.coalesce(ok, F.lit(False)))


def compare_halt_timing(halts: DataFrame, disclosures: DataFrame) -> DataFrame:
    """Disclosed against recorded dates of a halt (first) and its resumption (second), per code."""
    spans = halts.filter("resume_date > halt_date").select(
        "code", F.col("halt_date").alias("first_effective_on"), F.col("resume_date").alias("second_effective_on"), F.lit(1).alias("_a")
    ).distinct()
    joined = disclosures.join(spans, ["code", "first_effective_on", "second_effective_on"], "left")
    return _timing(joined, F.col("_a").isNotNull())
