"""Day validation, anomalies, promotion verdicts, ingest state and source selections."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.findings import explode_reasons, findings
from knownat.functions.hashing import WORDS, digest_tree, model_fingerprint
from knownat.functions.ordered import latest_by, previous_row
from knownat.schemas import STATES, TRANSITIONS

# Rules of the hard day validation in the order they are reported.
DAY_RULES = [
    "date_mismatch", "bad_code", "duplicate_code", "market_missing", "name_missing", "close_not_positive",
    "marcap_not_positive", "listed_shares_not_positive", "volume_or_amount_negative", "open_high_low_not_positive",
]
HISTORY = 20
LOW, HIGH = 0.9, 1.1
CAP_CHANGE = 0.2 - 1e-12
ATTEMPTS = 3


def day_facts(rows: DataFrame) -> DataFrame:
    """One row per requested day with the counts every rule needs.

    Rows are first counted per (day, code), which combines before the shuffle, so a repeated
    code is seen without gathering a day's rows.
    """
    def not_positive(name: str) -> Column:
        return ~F.coalesce((F.col(name) > 0) & ~F.isnan(name), F.lit(False))

    wrong_day = ~F.coalesce(F.col("trade_date") == F.col("requested_date"), F.lit(False))
    def not_negative(name: str) -> Column:
        return (F.col(name) >= 0) & ~F.isnan(name)

    negative = ~F.coalesce(not_negative("volume") & not_negative("amount"), F.lit(False))
    optional = F.coalesce(F.least("open", "high", "low") <= 0, F.lit(False))
    bad_code = ~F.coalesce(F.col("code").rlike(r"^[0-9A-Z]{6}$"), F.lit(False))
    per_code = rows.groupBy("requested_date", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong_day).alias("date_mismatch"), F.count_if(bad_code).alias("bad_code"),
        F.count_if(F.col("market") == "KOSPI").alias("_kospi"), F.count_if(F.col("market") == "KOSDAQ").alias("_kosdaq"),
        F.count_if(F.coalesce(F.col("name"), F.lit("")) == "").alias("name_missing"),
        *[F.count_if(not_positive(c)).alias(f"{c}_not_positive") for c in ("close", "marcap", "listed_shares")],
        F.count_if(negative).alias("volume_or_amount_negative"),
        F.count_if(optional).alias("open_high_low_not_positive"),
        F.sum("marcap").alias("_marcap"),
    )
    summed = ["date_mismatch", "bad_code", "name_missing", "close_not_positive", "marcap_not_positive",
              "listed_shares_not_positive", "volume_or_amount_negative", "open_high_low_not_positive"]
    return per_code.groupBy("requested_date").agg(
        F.sum("n").alias("row_count"), F.sum("_marcap").alias("total_marcap"),
        *[F.sum(name).alias(name) for name in summed],
        F.sum(F.col("n") - 1).alias("duplicate_code"),
        ((F.sum("_kospi") == 0).cast("int") + (F.sum("_kosdaq") == 0).cast("int")).cast("long").alias("market_missing"),
    )


def validate_days(rows: DataFrame) -> DataFrame:
    """``(requested_date, ordinal, rule_id, n)`` per broken rule; the lowest ordinal is the day's error."""
    entries = [
        F.when(F.col(rule) > 0, F.struct(F.lit(i).alias("ordinal"), F.lit(rule).alias("rule_id"), F.col(rule).alias("n")))
        for i, rule in enumerate(DAY_RULES, start=1)
    ]
    return day_facts(rows).select("requested_date", F.explode(F.array_compact(F.array(*entries))).alias("_e")).select(
        "requested_date", "_e.*"
    )


def day_summaries(daily_market: DataFrame) -> DataFrame:
    """Rows and total market cap per day."""
    return daily_market.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("marcap").cast("decimal(28,4)")).cast("double").alias("total_marcap")
    )


def row_count_anomaly(summaries: DataFrame) -> DataFrame:
    """Days whose row count leaves 0.9-1.1 of the median of the 20 promoted days before.

    ``summaries`` are promoted days, one row each.
    """
    before = Window.orderBy("trade_date").rowsBetween(-HISTORY, -1)
    # Spark has no median over a frame; a frame holds at most twenty counts.
    frame = F.sort_array(F.collect_list("row_count").over(before))
    middle = (F.get(frame, F.lit(HISTORY // 2 - 1)) + F.get(frame, F.lit(HISTORY // 2))) / 2
    counted = summaries.withColumns(
        {"expected": middle, "_n": F.count(F.lit(1)).over(before)}
    ).withColumn("ratio", F.when(F.col("expected") != 0, F.col("row_count") / F.col("expected")).otherwise(0.0))
    return counted.filter((F.col("_n") >= HISTORY) & ((F.col("ratio") < LOW) | (F.col("ratio") > HIGH))).select(
        "trade_date", "row_count", "expected", "ratio"
    )


def marcap_anomaly(summaries: DataFrame) -> DataFrame:
    """Days whose total market cap moves by a fifth or more against the promoted day before."""
    stepped = summaries.withColumn("previous", F.lag("total_marcap").over(Window.orderBy("trade_date")))
    change = F.when(F.col("previous") == 0, F.lit(float("inf"))).otherwise(
        F.abs(F.col("total_marcap") / F.col("previous") - 1)
    )
    return stepped.withColumn("change", change).filter(F.col("change") >= CAP_CHANGE).select(
        "trade_date", "total_marcap", "previous", "change"
    )


def schema_drift(versions: DataFrame) -> DataFrame:
    """Versions whose sorted column list differs from the one before of the same dataset."""
    staged = previous_row(
        versions.withColumn("_columns", F.array_join(F.sort_array("columns"), ",")), ["dataset"],
        F.floor(F.col("raw_version_id") / 100_000), ["raw_version_id"], ["_columns"], "_before",
    )
    return staged.filter(F.col("_before").isNotNull() & (F.col("_before._columns") != F.col("_columns"))).select(
        "dataset", "raw_version_id", F.lit("schema_drift").alias("rule_id")
    )


VERDICT = [("trade_date", T.DateType()), ("state", T.StringType()), ("row_anomaly", T.BooleanType()), ("cap_anomaly", T.BooleanType())]


def _fold_days(days: pd.DataFrame) -> Iterator[tuple]:
    """Verdicts of one source's days in order; remembers twenty counts and one total."""
    counts: deque[float] = deque(maxlen=HISTORY)
    cap: float | None = None
    for day in days.sort_values("trade_date").itertuples(index=False):
        odd_rows = odd_cap = False
        if len(counts) == HISTORY:
            middle = median(counts)
            ratio = day.row_count / middle if middle else 0.0
            odd_rows = ratio < LOW or ratio > HIGH
        total = None if day.total_marcap is None else float(day.total_marcap)
        if cap is not None and total is not None:
            # A total that is no number is no total close to the one before.
            odd_cap = cap == 0 or not abs(total / cap - 1) < CAP_CHANGE
        if day.settled:
            state = "promoted"
        elif day.empty and (day.evidence or "").strip():
            state = "non_session"
        elif day.empty and day.attempts >= ATTEMPTS:
            state = "calendar_unresolved"
        elif day.empty or day.hard_errors > 0:
            state = "failed"
        elif odd_rows or odd_cap or day.changed:
            state = "quarantined"
        else:
            state = "promoted"
        if state == "promoted":
            counts.append(float(day.row_count))
            cap = total
        yield day.trade_date, state, odd_rows and not day.empty, odd_cap and not day.empty


def resolve_day_states(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Verdict per day, with history made of promoted days only; sources named by ``keys`` are judged side by side.

    ``days`` (keys, trade_date, row_count, total_marcap, hard_errors, changed, empty, attempts, evidence): one row per source and
    day.  Where ``days`` has a true ``settled``, the day was promoted earlier and stays so.
    A day's verdict depends on the verdicts before it, so the day rows of a source - one per calendar day, whatever the number of its
    market rows - are folded in order by one task, in time linear in the days.
    """
    keys = list(keys)
    fields = ["trade_date", "row_count", "total_marcap", "hard_errors", "changed", "empty", "attempts", "evidence", "settled"]
    settled = F.coalesce("settled", F.lit(False)) if "settled" in days.columns else F.lit(False)
    staged = days.filter("trade_date IS NOT NULL").withColumn("settled", settled).select(*keys, *fields)
    names = [name for name, _ in VERDICT]

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        plain = pd.DataFrame({name: pd.Series(table.column(name).to_pylist(), dtype=object) for name in fields})
        found = list(_fold_days(plain))
        columns = dict(zip(names, zip(*found))) if found else {name: [] for name in names}
        kinds = {"trade_date": pa.date32(), "state": pa.string(), "row_anomaly": pa.bool_(), "cap_anomaly": pa.bool_()}
        out = {name: table.column(name).take(pa.array([0] * len(found), pa.int64())) for name in keys}
        return pa.table(out | {name: pa.array(columns[name], kinds[name]) for name in names})

    schema = T.StructType([staged.schema[name] for name in keys] + [T.StructField(name, kind) for name, kind in VERDICT])
    return staged.withColumn("_all", F.lit(0)).groupBy(*keys, "_all").applyInArrow(fold, schema)


def invalid_transitions(log: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Steps of an event log outside the allowed edges, compared within (job, day) in sequence.

    The log of one job may be most of the table; it is scanned in buckets of its sequence number.
    """
    stepped = previous_row(
        log, ["job_id", "trade_date"], F.floor(F.col("seq") / rows_per_bucket), ["seq"], ["state"], "_before"
    )
    edges = F.array(*[F.lit(f"{a}>{b}") for a, targets in TRANSITIONS.items() for b in targets])
    edge = F.concat_ws(">", F.col("_before.state"), F.col("state"))
    return stepped.filter(F.col("_before").isNotNull() & ~F.array_contains(edges, edge)).select(
        "job_id", "trade_date", "seq", F.col("_before.state").alias("from_state"), F.col("state").alias("to_state")
    )


def latest_per_key(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest log row per key."""
    return latest_by(log, keys, [F.col(order).desc()])


def latest_entries(log: DataFrame, order: str, limit: int = 500) -> DataFrame:
    """The last entries of a log, newest first: the limit is the report's definition."""
    return log.orderBy(F.col(order).desc()).limit(limit)


def ingest_summary(states: DataFrame) -> DataFrame:
    """Days per state and job, total, remaining, and whether the acquisition is complete."""
    counts = states.groupBy("job_id").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count(F.lit(1)).alias("total")
    )
    done = F.col("promoted") + F.col("non_session")
    return counts.withColumn("remaining", F.col("total") - done).withColumn(
        "complete", (F.col("remaining") == 0) & (done == F.col("total"))
    )


def processable_days(states: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Pending days, and failed days with attempts left."""
    return states.filter((F.col("state") == "pending") | ((F.col("state") == "failed") & (F.col("attempts") < attempts)))


def bar_coverage(bars: DataFrame) -> DataFrame:
    """First day, last day and number of stored days per code."""
    return bars.groupBy("code").agg(
        F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count(F.lit(1)).alias("days")
    )


# ---- source versions and selections ----------------------------------------------------------
def pending_revisions(versions: DataFrame, selections: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose newest version is not the selected one, or that have no selection."""
    newest = versions.groupBy(*keys).agg(F.max("raw_version_id").alias("latest_id"))
    chosen = selections.select(*keys, F.col("raw_version_id").alias("selected_id"))
    return newest.join(chosen, keys, "left").filter(
        F.col("selected_id").isNull() | (F.col("selected_id") != F.col("latest_id"))
    )


def check_selections(selections: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Findings on selections without a reason, or naming a version that is unknown or of another key."""
    owner = versions.select("raw_version_id", *[F.col(k).alias(f"_{k}") for k in keys])
    joined = selections.join(owner, "raw_version_id", "left")
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(key) == F.col(f"_{key}"))
    known = F.col(f"_{keys[0]}").isNotNull()
    checks = {
        "reason_missing": F.trim(F.coalesce("reason", F.lit(""))) == "",
        "unknown_version": ~known,
        "version_of_other_key": known & ~F.coalesce(same, F.lit(False)),
    }
    return findings(
        explode_reasons(joined, checks), source="selections", severity="blocking", rule=F.col("rule_id"),
        subject=F.concat_ws("/", *keys), observed=F.col("raw_version_id"),
    )


def default_selection(versions: DataFrame, selections: DataFrame, keys: list[str]) -> DataFrame:
    """Existing selections, and the first version seen for every key without one."""
    first = versions.groupBy(*keys).agg(F.min("raw_version_id").alias("raw_version_id"))
    added = first.join(selections.select(*keys), keys, "left_anti").withColumn("reason", F.lit("first_seen"))
    return selections.select(*keys, "raw_version_id", "reason").unionByName(added.select(*keys, "raw_version_id", "reason"))


def selected_rows(rows: DataFrame, selections: DataFrame) -> DataFrame:
    """Source rows of selected versions."""
    return rows.join(selections.select("raw_version_id").distinct(), "raw_version_id", "left_semi")


def missing_evidence(tables: dict[str, DataFrame], rows: DataFrame, selections: DataFrame) -> DataFrame:
    """Model rows whose source row does not exist or belongs to a version not selected."""
    key = ["raw_version_id", "source_row_number"]
    cited = None
    for name, table in tables.items():
        part = table.select(F.lit(name).alias("table_name"), *key)
        cited = part if cited is None else cited.unionByName(part)
    cited = cited.distinct()
    known = rows.select(*key).distinct()
    chosen = selections.select("raw_version_id").distinct()
    absent = cited.join(known, key, "left_anti").withColumn("reason", F.lit("row_missing"))
    stray = cited.join(known, key, "left_semi").join(chosen, "raw_version_id", "left_anti").withColumn(
        "reason", F.lit("version_not_selected")
    )
    return absent.select("table_name", *key, "reason").unionByName(stray.select("table_name", *key, "reason"))


def verify_rebuild(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Compare the fingerprint of rebuilt tables with the stored one: ``(expected, actual, status)``."""
    actual = model_fingerprint(tables).select(F.col("fingerprint").alias("actual"))
    stored = expected.agg(F.max("fingerprint")).scalar()
    status = F.when(F.col("expected").isNull(), "failed").when(F.col("expected") == F.col("actual"), "verified")
    return actual.withColumn("expected", stored).select("expected", "actual", status.otherwise("mismatch").alias("status"))


def differing_places(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Leaves of two digest trees that differ: ``(table_name, day, bucket, expected_rows, actual_rows)``.

    Trees are compared leaf by leaf: a leaf holds a sixteenth of a table's rows of one day, so few rows need looking at.
    """
    leaf = ["table_name", "day", "bucket"]

    def side(tree: DataFrame, prefix: str) -> DataFrame:
        return tree.select(*[F.col(c).alias(f"{prefix}_{c}") for c in [*leaf, "row_count", *WORDS]])

    same = F.lit(True)
    for name in leaf:
        same = same & F.col(f"e_{name}").eqNullSafe(F.col(f"a_{name}"))
    both = side(expected, "e").join(side(actual, "a"), same, "full_outer")
    equal = F.lit(True)
    for name in ["row_count", *WORDS]:
        equal = equal & F.col(f"e_{name}").eqNullSafe(F.col(f"a_{name}"))
    return both.filter(~equal).select(
        *[F.coalesce(f"e_{c}", f"a_{c}").alias(c) for c in leaf],
        F.coalesce("e_row_count", F.lit(0)).alias("expected_rows"), F.coalesce("a_row_count", F.lit(0)).alias("actual_rows"))


def rebuild(
    rows: DataFrame, selections: DataFrame, build: Callable[[DataFrame], Mapping[str, DataFrame]], days: Mapping[str, str], expected: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Build a model anew from the source rows of the selected versions and compare it with the stored digest tree.

    ``build`` makes the named tables from rows.  Returns one verdict per table ``(table_name, status, differing_days, first_day)`` and
    the differing places.  A selected version without any row leaves the rebuild ``failed``; else a table is ``verified`` or a ``mismatch``.
    """
    made = build(selected_rows(rows, selections))
    places = differing_places(expected, digest_tree(made, days))
    absent = selections.select("raw_version_id").distinct().join(
        rows.select("raw_version_id").distinct(), "raw_version_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    names = expected.sparkSession.createDataFrame([(name,) for name in sorted(made)], "table_name string")
    found = places.groupBy("table_name").agg(F.count_distinct("day").alias("differing_days"), F.min("day").alias("first_day"))
    status = F.when(F.col("_absent") > 0, "failed").when(F.col("differing_days").isNotNull(), "mismatch").otherwise("verified")
    verdicts = names.join(found, "table_name", "left").withColumn("_absent", absent).select(
        "table_name", status.alias("status"), F.coalesce("differing_days", F.lit(0)).alias("differing_days"), "first_day")
    return verdicts, places
