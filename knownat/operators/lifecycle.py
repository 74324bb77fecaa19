"""Valid-time identity of securities: who was listed under which code, name and market, and when."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.findings import STOPPING, findings, union_all
from knownat.functions import calendar as cal
from knownat.functions.hashing import stable_id
from knownat.functions.ordered import latest_by, running
from knownat.functions.text import security_kind
from knownat.schemas import LIFECYCLE_DATASETS, SUPPORTED_EVENTS

FAR_END = "9999-12-31"
ORDER = ["effective_date", "raw_version_id", "source_row_number"]


@dataclass(frozen=True)
class LifecycleModel:
    issuers: DataFrame
    securities: DataFrame
    identifiers: DataFrame
    names: DataFrame
    events: DataFrame
    intervals: DataFrame
    findings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in ("issuers", "securities", "identifiers", "names", "events", "intervals", "findings")}


def security_facts(rows: DataFrame) -> DataFrame:
    """One row per standard code: first row, dates, final class, issuer.

    Everything is an aggregate that combines before the shuffle, so a code with
    very many rows costs no more than any other.
    """
    position = F.struct(*ORDER)
    first = F.struct(
        F.coalesce("previous_code", F.nullif("short_code", F.lit(""))).alias("short_code"),
        F.coalesce("previous_name", "name").alias("name"), F.coalesce("previous_market", "market").alias("market"),
        "raw_version_id", "source_row_number",
    )
    typed = F.when(F.col("stock_type").isNotNull(), position)
    issued = F.when(F.col("issuer_reference").isNotNull(), position)
    issuer = F.struct("issuer_reference", "raw_version_id", "source_row_number")
    unsupported = F.when(~F.coalesce(F.col("event_type").isin(SUPPORTED_EVENTS), F.lit(False)), position)
    facts = rows.groupBy("standard_code").agg(
        F.min_by(first, position).alias("first"), F.max_by("stock_type", typed).alias("stock_type"),
        F.min_by(issuer, issued).alias("issuer"), F.min("listing_date").alias("listed_on"),
        F.min("delisting_date").alias("delisted_on"), F.min(unsupported).alias("unsupported"),
    )
    return facts.select(
        "*", stable_id("sec", F.col("standard_code")).alias("security_id"),
        F.when(F.col("issuer.issuer_reference").isNotNull(), stable_id("iss", F.col("issuer.issuer_reference"))).alias("issuer_id"),
        security_kind(F.col("stock_type")).alias("security_kind"),
    )


def issuers(facts: DataFrame) -> DataFrame:
    known = facts.filter("issuer_id IS NOT NULL").select(
        "issuer_id", F.col("issuer.issuer_reference").alias("official_reference"), "issuer.raw_version_id",
        "issuer.source_row_number", "standard_code",
    )
    return latest_by(known, ["issuer_id"], [F.col("standard_code").asc()]).drop("standard_code")


def securities(facts: DataFrame) -> DataFrame:
    return facts.select("security_id", "issuer_id", "standard_code", "security_kind", "first.raw_version_id", "first.source_row_number")


def _change_points(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """State at the listing date and at each later change; several on one day leave the last."""
    base = facts.select("standard_code", "security_id", "issuer_id", "listed_on", "delisted_on", "first", "security_kind")
    opening = base.select(
        "standard_code", "security_id", "issuer_id", "delisted_on", F.col("listed_on").alias("valid_from"),
        F.struct("first.short_code", "first.name", "first.market", "security_kind", "first.raw_version_id",
                 "first.source_row_number").alias("state"),
    )
    moves = rows.filter("event_type IS NULL OR event_type <> 'delisting'")
    last = moves.groupBy("standard_code", "effective_date").agg(
        F.max_by(
            F.struct(F.nullif("short_code", F.lit("")).alias("short_code"), "name", "market", "stock_type",
                     "raw_version_id", "source_row_number"),
            F.struct("raw_version_id", "source_row_number"),
        ).alias("move")
    )
    changes = last.join(base, "standard_code").filter(F.col("effective_date") > F.col("listed_on")).select(
        "standard_code", "security_id", "issuer_id", "delisted_on", F.col("effective_date").alias("valid_from"),
        F.struct(
            F.coalesce("move.short_code", "first.short_code").alias("short_code"),
            F.coalesce("move.name", "first.name").alias("name"), F.coalesce("move.market", "first.market").alias("market"),
            security_kind(F.col("move.stock_type")).alias("security_kind"),
            F.col("move.raw_version_id").alias("raw_version_id"), F.col("move.source_row_number").alias("source_row_number"),
        ).alias("state"),
    )
    return opening.unionByName(changes)


def lifecycle_intervals(rows: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership intervals ``[valid_from, valid_to)`` and findings for those that end before they start.

    Change points are one per code and day, so the window below is bounded by the calendar.
    """
    points = _change_points(rows, facts)
    order = Window.partitionBy("standard_code").orderBy("valid_from")
    spans = points.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(order), F.col("delisted_on")))
    wrong = F.coalesce(F.col("valid_to") <= F.col("valid_from"), F.lit(False))
    good = spans.filter(~wrong).select("security_id", "issuer_id", "standard_code", "state.*", "valid_from", "valid_to")
    found = findings(
        spans.filter(wrong), source="lifecycle", severity="blocking", rule="invalid_interval", subject=F.col("security_id"),
        date=F.col("valid_from"),
    )
    return good, found


def lifecycle_events(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """All events but listings as reported, and one listing per security; the last duplicate stays."""
    ids = facts.select("standard_code", "security_id")
    reported = rows.filter("event_type IS NULL OR event_type <> 'listing'").join(ids, "standard_code").select(
        "security_id", "event_type", "effective_date", "last_trading_date", "successor_standard_code", "raw_version_id",
        "source_row_number",
    )
    listed = facts.select(
        "security_id", F.lit("listing").alias("event_type"), F.col("listed_on").alias("effective_date"),
        F.lit(None).cast("date").alias("last_trading_date"), F.lit(None).cast("string").alias("successor_standard_code"),
        "first.raw_version_id", "first.source_row_number",
    )
    newest = [F.col("raw_version_id").desc(), F.col("source_row_number").desc()]
    return latest_by(reported, ["security_id", "event_type", "effective_date"], newest).unionByName(listed)


def classification_findings(facts: DataFrame) -> DataFrame:
    """Securities whose class is unknown, and securities with an event that needs a later stage."""
    unknown = findings(
        facts.filter("security_kind = 'unknown'"), source="lifecycle", severity="blocking", rule="unknown_classification",
        subject=F.col("security_id"),
    )
    linked = findings(
        facts.filter("unsupported IS NOT NULL"), source="lifecycle", severity="blocking", rule="unsupported_lineage",
        subject=F.col("security_id"), date=F.col("unsupported.effective_date"),
    )
    return unknown.unionByName(linked)


def overlapping_codes(intervals: DataFrame) -> DataFrame:
    """Starts of an interval inside the one with the furthest end so far under the same code, of another security.

    Equal ends keep the earlier interval.  A code reused by very many securities is swept in pieces:
    by start day and the leading characters of the (hashed) security id.
    """
    end = F.coalesce("valid_to", F.lit(FAR_END).cast("date"))
    staged = intervals.withColumns({
        "_reach": F.struct(end.alias("end"), F.datediff(F.lit(FAR_END).cast("date"), F.col("valid_from")).alias("early"),
                           F.translate(F.substring("security_id", 5, 20), "0123456789abcdef", "fedcba9876543210").alias("tie"),
                           F.col("security_id").alias("security_id")),
    })
    piece = F.struct("valid_from", F.substring("security_id", 5, 2))
    swept = running(
        staged, ["short_code"], piece, ["valid_from", "security_id"], {"_before": ("max", F.col("_reach"))}, inclusive=False
    )
    clash = (F.col("_before.security_id") != F.col("security_id")) & (F.col("valid_from") < F.col("_before.end"))
    return findings(
        swept.filter(clash), source="lifecycle", severity="blocking", rule="overlapping_code", subject=F.col("security_id"),
        date=F.col("valid_from"), observed=F.col("short_code"),
    )


def build_model(rows: DataFrame) -> LifecycleModel:
    facts = security_facts(rows)
    intervals, invalid = lifecycle_intervals(rows, facts)
    source = ["raw_version_id", "source_row_number"]
    return LifecycleModel(
        issuers=issuers(facts), securities=securities(facts),
        identifiers=intervals.select("security_id", "standard_code", "short_code", "valid_from", "valid_to", *source),
        names=intervals.select("security_id", "name", "valid_from", "valid_to", *source),
        events=lifecycle_events(rows, facts), intervals=intervals,
        findings=union_all([classification_findings(facts), invalid, overlapping_codes(intervals)]),
    )


def listed_on(intervals: DataFrame, dates: DataFrame | cal.DateList, column: str = "date") -> DataFrame:
    """Listed securities at each given date (start inclusive, end exclusive)."""
    listed = cal.DateList.of(dates, column)
    return cal.expand_intervals(intervals, F.col("valid_from"), F.col("valid_to"), listed, "date")


def listed_when(intervals: DataFrame, keys: list[str], wanted: DataFrame, date: Column, dates: cal.DateList) -> DataFrame:
    """``listed_on`` at the days that ``wanted`` names per key only.

    The days of a key meet its intervals as one array, so securities and days that nobody asks for are never expanded.
    """
    days = dates.numbers_per_key(wanted, keys, date, "_asked")
    return cal.expand_intervals(
        intervals.join(days, keys), F.col("valid_from"), F.col("valid_to"), dates, "date", only="_asked")


def security_catalog(intervals: DataFrame) -> DataFrame:
    """Code, name and market of the latest interval per security."""
    return latest_by(intervals, ["security_id"], [F.col("valid_from").desc()]).select("security_id", "short_code", "name", "market")


def timeline(model: LifecycleModel, ids: DataFrame | None = None) -> DataFrame:
    """Events and intervals as one dated list with the source row of each; ``ids`` restricts the securities."""
    source = ["raw_version_id", "source_row_number"]
    events = model.events.select(
        "security_id", F.lit("event").alias("entry"), F.col("effective_date").alias("date"),
        F.lit(None).cast("date").alias("until"), F.col("event_type").alias("detail"), *source,
    )
    spans = model.intervals.select(
        "security_id", F.lit("interval").alias("entry"), F.col("valid_from").alias("date"), F.col("valid_to").alias("until"),
        F.concat_ws("/", "short_code", "name", "market").alias("detail"), *source,
    )
    both = events.unionByName(spans)
    return both if ids is None else both.join(ids.select("security_id").distinct(), "security_id", "left_semi")


def linked_versions(entries: DataFrame, versions: DataFrame, selections: DataFrame) -> DataFrame:
    """Timeline entries with the source version behind each: ``dataset, sha256, state``.

    ``versions`` (raw_version_id, dataset, sha256); ``selections`` (dataset, raw_version_id), at most one per dataset.  A version is
    ``selected``, ``superseded`` (older than the selected one of its dataset) or ``pending`` (newer, or nothing is selected);
    an entry whose version is not known keeps its row with the state ``unknown``.
    """
    chosen = selections.select("dataset", F.col("raw_version_id").alias("_chosen"))
    placed = versions.join(chosen, "dataset", "left").select(
        "raw_version_id", "dataset", "sha256",
        F.when(F.col("raw_version_id") == F.col("_chosen"), "selected")
        .when(F.col("raw_version_id") < F.col("_chosen"), "superseded").otherwise("pending").alias("state"),
    )
    return entries.join(placed, "raw_version_id", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))


def reconcile_market(intervals: DataFrame, market: DataFrame, raw_dates: DataFrame) -> DataFrame:
    """Findings where the listed securities and the daily market rows of a day disagree.

    ``raw_dates`` (trade_date) are the days with landed files.  Per code, stretches of days with one listed security and the code's
    market rows form one ordered scan; only the days between two of them, on which a listed security has no row, become rows of their own.
    """
    days = cal.DateList(raw_dates, "trade_date")
    listed = _listed_stretches(intervals, days)
    number = days.table.select(F.col("session_date").alias("trade_date"), F.col("session_no").alias("_no"))
    rows = market.select("trade_date", "code", F.struct("name", "market", "raw_version_id").alias("_row")).join(number, "trade_date").drop("trade_date")
    known = rows.filter("code IS NOT NULL")
    merged = listed.select("code", F.col("_start").alias("_no"), F.struct("_end", "_who").alias("_span"), F.lit(0).alias("_kind")).unionByName(
        known.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    # At most one stretch and one market row a code and day are expected.
    order = Window.partitionBy("code").orderBy("_no", "_kind")
    scanned = merged.withColumns({
        "_span": F.last("_span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_no").over(order),
    })
    both = scanned.unionByName(rows.filter("code IS NULL").withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_who", F.when(F.col("_no") < F.col("_span._end"), F.col("_span._who"))).select(
        "code", "_no", "_kind", "_next", F.col("_span._end").alias("_end"), F.col("_who.security_id").alias("security_id"),
        F.col("_who.name").alias("_listed_name"), F.col("_who.market").alias("_listed_market"), "_row.*",
    )
    in_market, in_model = F.col("raw_version_id").isNotNull(), F.col("security_id").isNotNull()

    def entry(condition: Column, severity: str, rule: str, listed: Column, seen: Column) -> Column:
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"),
                                          listed.alias("listed"), seen.alias("seen")))

    shown = F.concat_ws("/", "name", "market")
    missing = F.lit(None).cast("string")
    absent = F.struct(F.lit("warning").alias("severity"), F.lit("active_security_missing").alias("rule_id"),
                      F.concat_ws("/", "_listed_name", "_listed_market").alias("listed"), missing.alias("seen"))
    entries = F.array_compact(F.array(
        entry(in_market & ~in_model, "blocking", "market_without_lifecycle", missing, shown),
        entry(in_market & in_model & (F.col("name") != F.col("_listed_name")), "warning", "name_conflict",
              F.col("_listed_name"), F.col("name")),
        entry(in_market & in_model & (F.col("market") != F.col("_listed_market")), "warning", "market_conflict",
              F.col("_listed_market"), F.col("market")),
        F.when(in_model & ~in_market, absent),
    ))
    first = F.col("_no") + F.col("_kind")
    last = F.least(F.col("_next"), F.col("_end")) - 1
    silent = F.when(in_model & (first <= last), F.transform(F.sequence(first, last), lambda no: F.struct(no.alias("no"), absent.alias("entry"))))
    own = F.when(F.col("_kind") == 1, F.transform(entries, lambda e: F.struct(F.col("_no").alias("no"), e.alias("entry"))))
    some = F.array_compact(F.array(own, silent))
    told = both.withColumn("_e", F.explode(F.flatten(some))).select(
        "code", "security_id", F.col("_e.no").alias("_no"), "_e.entry.severity", "_e.entry.rule_id", "_e.entry.listed", "_e.entry.seen")
    return days.with_date(told, "_no", "trade_date").select("trade_date", "code", "security_id", "severity", "rule_id", "listed", "seen")


def _listed_stretches(intervals: DataFrame, days: cal.DateList) -> DataFrame:
    """``(code, _start, _end, _who)``: the security that stands for a short code between two date numbers, the end left out.

    A code's intervals are cut where any of them begins or ends, and of equal pieces the one of the greatest market and security id
    stays.  A code has at most one cut a listed date, so its cuts fit one array however many securities share the code.
    """
    who = F.struct("market", "security_id", "name")
    staged = cal.numbered_intervals(intervals, F.col("valid_from"), F.col("valid_to"), days).select(
        F.col("short_code").alias("code"), "_from_no", "_to_no", who.alias("_who"))
    cuts = staged.groupBy(F.col("code").alias("_code")).agg(
        F.sort_array(F.array_union(F.collect_set("_from_no"), F.collect_set("_to_no"))).alias("_cuts"))
    cut = staged.join(cuts, F.col("code").eqNullSafe(F.col("_code")))
    starts = F.filter("_cuts", lambda no: (no >= F.col("_from_no")) & (no < F.col("_to_no")))
    ends = F.filter("_cuts", lambda no: (no > F.col("_from_no")) & (no <= F.col("_to_no")))
    pieces = cut.withColumn("_p", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e")))).select(
        "code", F.col("_p.s").alias("_start"), F.col("_p.e").alias("_end"), "_who")
    return latest_by(pieces, ["code", "_start"], [F.col("_who.market").desc(), F.col("_who.security_id").desc()])


def market_coverage(market: DataFrame, raw_dates: DataFrame, by: str | None = None) -> DataFrame:
    """Share of landed days that have market rows: ``(landed, covered, coverage)``, or one such row per value of ``by``."""
    landed = raw_dates.select("trade_date").distinct()
    if by is not None:
        days = market.select(by, "trade_date").distinct().join(landed.withColumn("_landed", F.lit(True)), "trade_date", "left")
        return days.groupBy(by).agg(F.count("_landed").alias("covered")).select(
            by, landed.agg(F.count(F.lit(1))).scalar().alias("landed"), "covered").withColumn(
            "coverage", F.when(F.col("landed") > 0, F.col("covered") / F.col("landed")).otherwise(0.0))
    covered = market.select("trade_date").distinct().withColumn("_seen", F.lit(True))
    joined = landed.join(covered, "trade_date", "left")
    return joined.agg(F.count(F.lit(1)).alias("landed"), F.count("_seen").alias("covered")).withColumn(
        "coverage", F.when(F.col("landed") > 0, F.col("covered") / F.col("landed")).otherwise(0.0)
    )


def action_signals(market: DataFrame) -> DataFrame:
    """Jumps of listed shares or close against a code's row before; one row per code and day is expected."""
    order = Window.partitionBy("code").orderBy("trade_date")
    stepped = market.withColumns({"_shares": F.lag("listed_shares").over(order), "_close": F.lag("close").over(order)})
    shares = F.abs(F.col("listed_shares") - F.col("_shares")) / F.nullif("_shares", F.lit(0.0))
    ratio = F.col("close") / F.nullif("_close", F.lit(0.0))

    def entry(condition: Column, rule: str, before: str, now: str) -> Column:
        return F.when(condition, F.struct(F.lit(rule).alias("rule_id"), F.col(before).alias("before"), F.col(now).alias("after")))

    jumps = F.array_compact(F.array(
        entry((F.col("_shares") > 0) & (shares >= 0.2), "listed_shares_jump", "_shares", "listed_shares"),
        entry((F.col("_close") > 0) & ((ratio < 0.5) | (ratio > 2.0)), "close_ratio_jump", "_close", "close"),
    ))
    return stepped.withColumn("_e", F.explode(jumps)).select("trade_date", "code", "raw_version_id", "_e.*")


def latest_run_findings(runs: DataFrame, found: DataFrame, start: str, end: str) -> DataFrame:
    """Findings of the newest reconciliation run of exactly this range."""
    run = runs.filter(
        (F.col("start_date") == F.lit(start).cast("date")) & (F.col("end_date") == F.lit(end).cast("date"))
    ).agg(F.max("run_id")).scalar()
    return found.filter(F.col("run_id") == run)


def lifecycle_readiness(
    versions: DataFrame, selections: DataFrame, model_findings: DataFrame, reconciliation: DataFrame, signals: DataFrame,
    meta: DataFrame, rebuilds: DataFrame,
) -> DataFrame:
    """One row with the verdict and the codes of everything that stands against it.

    ``versions``/``selections`` (dataset, raw_version_id); ``meta`` (revision, dataset, raw_version_id) names what the promoted
    model was built from; ``rebuilds`` (id, status).
    """
    chosen = selections.agg(F.collect_set("dataset")).scalar()
    unselected = F.array_except(F.array(*[F.lit(d) for d in LIFECYCLE_DATASETS]), chosen)
    newest = versions.groupBy("dataset").agg(F.max("raw_version_id").alias("_latest"))
    unreviewed = newest.join(selections, "dataset", "left").agg(
        F.count_if(F.coalesce(F.col("raw_version_id") != F.col("_latest"), F.lit(True)))
    ).scalar()
    last = meta.agg(F.max("revision")).scalar()
    current = meta.filter(F.col("revision") == last).select("dataset", "raw_version_id")
    built = current.withColumn("_built", F.lit(1))
    differing = built.join(selections.select("dataset", "raw_version_id").withColumn("_chosen", F.lit(1)),
                           ["dataset", "raw_version_id"], "full_outer").agg(
        F.count_if(F.col("_built").isNull() | F.col("_chosen").isNull())).scalar()
    stopping = model_findings.filter(F.col("severity").isin(STOPPING)).agg(F.count(F.lit(1))).scalar()
    days = reconciliation.agg(F.count_distinct("trade_date")).scalar()
    pending = signals.limit(1).agg(F.count(F.lit(1))).scalar()
    base = rebuilds.agg(F.max_by("status", "id").alias("_rebuild")).select(
        "_rebuild", last.alias("model_revision"), unselected.alias("_unselected"), unreviewed.alias("_unreviewed"),
        differing.alias("_differing"), stopping.alias("blocking_count"), days.alias("unresolved_days"),
        (pending > 0).alias("corporate_action_pending"),
    )
    codes = F.array_compact(F.array(
        F.when(F.size("_unselected") > 0, "datasets_not_selected"),
        F.when(F.col("_unreviewed") > 0, "unreviewed_version"),
        F.when(F.col("model_revision").isNull(), "missing_promoted_model"),
        F.when(F.col("model_revision").isNotNull() & (F.col("_differing") > 0), "model_differs_from_selection"),
        F.when(F.col("_rebuild") == "failed", "rebuild_mismatch"),
        F.when(F.col("blocking_count") > 0, "blocking_findings"),
        F.when(F.col("unresolved_days") > 0, "unresolved_dates"),
        F.when(F.col("corporate_action_pending"), "corporate_action_pending"),
    ))
    return base.select(
        (F.size(codes) == 0).alias("lifecycle_ready"), F.array_join(codes, ",").alias("blocking_codes"), "model_revision",
        "blocking_count", "unresolved_days", "corporate_action_pending",
    )
