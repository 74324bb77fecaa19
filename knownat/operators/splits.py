"""Share splits: validation, adjusted closes as of a time, converted positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.functions.text import clean, has_offset, offset_timestamp
from knownat.findings import explode_reasons

# Supported action types and the required status and price basis.
SPLIT_TYPES = ["split", "reverse_split"]
VALIDATED = "validated"
RAW_BASIS = "raw"


def validate_splits(events: DataFrame, basis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable events with typed columns, and ``(code, effective_date, source_fingerprint, rule_id)`` for the others.

    ``events`` carry text columns as landed.  An event is usable when every check passes, its (code, day) is
    unique and exactly one raw price basis is on record for the code.  Ratios finer than
    nine decimals are refused rather than rounded.
    """
    evidence = basis.groupBy("code").agg(
        F.count(F.lit(1)).alias("_basis_rows"),
        F.min(
            (F.col("basis") == RAW_BASIS) & (clean(F.col("provider")) != "") & (clean(F.col("source_version")) != "")
            & (clean(F.col("fingerprint")) != "") & has_offset(F.col("retrieved_at"))
        ).alias("_basis_ok"),
    )
    day = clean(F.col("effective_date")).try_cast("date")
    exact = F.col("ratio").cast("string").try_cast("decimal(38,20)")
    stored = F.col("ratio").cast("string").try_cast("decimal(18,9)")
    copies = events.groupBy("code", "effective_date").agg(F.count(F.lit(1)).alias("_copies"))
    joined = events.join(copies, ["code", "effective_date"], "left").join(evidence, "code", "left")
    checks = {
        "code_missing": clean(F.col("code")) == "",
        "bad_effective_date": day.isNull(),
        "published_without_offset": ~has_offset(F.col("published_at")),
        "source_missing": clean(F.col("source_fingerprint")) == "",
        "unsupported_action": ~F.coalesce(F.col("action_type").isin(SPLIT_TYPES), F.lit(False)),
        "not_validated": ~F.coalesce(F.col("status") == VALIDATED, F.lit(False)),
        "bad_ratio": F.coalesce(exact <= 0, F.lit(True)),
        "ratio_too_fine": F.coalesce(exact != stored, F.lit(False)),
        "duplicate_event": F.coalesce(F.col("_copies") > 1, F.lit(False)),
        "basis_missing": F.coalesce(F.col("_basis_rows") != 1, F.lit(True)),
        "basis_not_raw": F.coalesce((F.col("_basis_rows") == 1) & ~F.col("_basis_ok"), F.lit(False)),
    }
    failed = F.lit(False)
    for condition in checks.values():
        failed = failed | condition
    good = joined.filter(~failed).select(
        "code", day.alias("effective_date"), offset_timestamp(F.col("published_at")).alias("published_at"),
        "action_type", stored.alias("ratio"), "status", "source_fingerprint",
    )
    found = explode_reasons(joined, checks).select("code", "effective_date", "source_fingerprint", "rule_id")
    return good, found


def split_adjusted(bars: DataFrame, events: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closes up to each code's signal time, divided by the splits between the day and the signal.

    ``signals`` (code, signal_at) has one time per code, ``events`` are validated.  A code with an effective
    but unpublished event is blocked: no rows, one finding.  Bars and events of a code form one
    series (bounded by the calendar) and a product running backwards gives the divisor.
    """
    timed = signals.withColumn("_day", cal.seoul_day(F.col("signal_at")))
    due = events.join(timed, "code").filter(F.col("effective_date") <= F.col("_day"))
    hidden = due.filter(F.col("published_at") > F.col("signal_at"))
    blocked = hidden.groupBy("code").agg(
        F.min("effective_date").alias("effective_date"), F.first("signal_at").alias("signal_at"),
        F.lit("split_not_public").alias("rule_id"),
    )
    history = bars.join(timed, "code").filter(F.col("trade_date") <= F.col("_day"))
    series = history.select(
        "code", "signal_at", "trade_date", F.col("close").cast("double").alias("close"), F.lit(1.0).alias("_ratio"),
        F.lit(1).alias("_side"),
    ).unionByName(
        due.select(
            "code", "signal_at", F.date_sub("effective_date", 1).alias("trade_date"),
            F.lit(None).cast("double").alias("close"), F.col("ratio").cast("double").alias("_ratio"),
            F.lit(0).alias("_side"),
        )
    )
    # An event touches days before its effective date, so it is placed on the eve and met first going back.
    back = Window.partitionBy("code").orderBy(F.col("trade_date").desc(), "_side").rowsBetween(
        Window.unboundedPreceding, 0
    )
    adjusted = series.withColumn("divisor", F.product("_ratio").over(back)).filter("_side = 1")
    return (
        adjusted.join(blocked.select("code"), "code", "left_anti").select(
            "code", "signal_at", "trade_date", "close", "divisor", (F.col("close") / F.col("divisor")).alias("adjusted_close")
        ),
        blocked,
    )


def convert_positions(positions: DataFrame, events: DataFrame, *, fractional: bool = False) -> tuple[DataFrame, DataFrame]:
    """Quantities after the split on ``effective_date``; fractions of whole-share positions are refused.

    ``positions`` (portfolio, code, effective_date, quantity).  A split first published after 09:00 Seoul on its day blocks too.
    """
    late = F.col("published_at") > cal.at_seoul(F.col("effective_date"), cal.OPEN_TIME)
    old = F.col("quantity").cast("decimal(18,0)") if not fractional else F.col("quantity").cast("decimal(18,9)")
    converted = old * F.col("ratio")
    joined = positions.join(
        events.select("code", "effective_date", "published_at", "ratio", "source_fingerprint"), ["code", "effective_date"]
    ).withColumn("new_quantity", converted)
    reasons = {"published_late": late, "bad_quantity": ~F.coalesce(F.col("quantity") > 0, F.lit(False))}
    if not fractional:
        reasons["position_not_whole"] = F.col("quantity") != F.floor("quantity")
        reasons["fractional_entitlement"] = F.col("new_quantity") != F.floor("new_quantity")
    failed = F.lit(False)
    for condition in reasons.values():
        failed = failed | F.coalesce(condition, F.lit(False))
    columns = ["portfolio", "code", "effective_date", "quantity", "ratio"]
    good = joined.filter(~failed).select(*columns, F.col("new_quantity").cast("double").alias("new_quantity"))
    return good, explode_reasons(joined, reasons).select(*columns[:4], "rule_id")


def event_bars(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Open and close on each event's day with a reason when there is not exactly one valid bar."""
    daily = bars.groupBy("code", F.col("trade_date").alias("effective_date")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("open").alias("open"), F.max("close").alias("close")
    )
    rows = events.select("code", "effective_date").join(daily, ["code", "effective_date"], "left")
    positive = F.coalesce((F.col("open") > 0) & (F.col("close") > 0), F.lit(False))
    return rows.select(
        "code", "effective_date", "open", "close",
        F.when(F.coalesce("_n", F.lit(0)) != 1, "not_one_bar").when(~positive, "not_positive").alias("reason"),
    )


def actions_match(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Rows on one side only, with the side: an empty result means the two agree as sets.

    Rows stored twice are reported as ``repeated``.
    """
    columns = ["code", "effective_date", "action_type", "status"]
    stored = actions.select(*[F.col(c).cast("string").alias(c) for c in columns])
    given = events.select(*[F.col(c).cast("string").alias(c) for c in columns])
    repeated = stored.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*columns)
    return (
        stored.join(given, columns, "left_anti").distinct().withColumn("side", F.lit("stored_only"))
        .unionByName(given.join(stored, columns, "left_anti").distinct().withColumn("side", F.lit("given_only")))
        .unionByName(repeated.withColumn("side", F.lit("repeated")))
    )
