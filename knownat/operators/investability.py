"""Bitemporal trading status: what was in force on a day, and what was known about it at a time."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.findings import STOPPING, findings, union_all
from knownat.functions import calendar as cal
from knownat.functions import text as tx
from knownat.functions.hashing import evidence_id
from knownat.functions.ordered import running, small_side
from knownat.operators.lifecycle import listed_on, listed_when
from knownat.schemas import Policy
from knownat.sources.tables import store_tables

V1 = Policy()
FLAGS = list(V1.blocking_flags)
DAY_STATES = ["passed", "unknown", "blocked"]
#: Requests, claims and listings of one security beyond which its scan is cut into days.
HOT_ROWS = 100_000


def policy_fingerprint(policy: Policy) -> str:
    return hashlib.sha256(json.dumps(asdict(policy), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class StatusModel:
    assertions: DataFrame
    intervals: DataFrame
    coverage: DataFrame
    lifecycle: DataFrame
    sessions: DataFrame
    findings: DataFrame
    #: Coverage runs of the sessions, where they are kept; made from sessions and coverage otherwise.
    days: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in ("assertions", "intervals", "coverage", "lifecycle", "sessions", "findings")}

    def runs(self) -> DataFrame:
        return cal.coverage_runs(self.sessions, self.coverage) if self.days is None else self.days


def with_known_at(rows: DataFrame, sessions: DataFrame | cal.DateList) -> DataFrame:
    """Add ``known_at``: the publication time, else midnight in Seoul of the session after the effective date.

    Publication text without an offset is Seoul time.  Text that is no time leaves ``known_at`` null: the row is never used.
    """
    dated = cal.with_next_session(rows, F.col("effective_date"), sessions, "_next")
    if isinstance(rows.schema["published_at"].dataType, T.StringType):
        published, given = published_time(F.col("published_at")), tx.clean(F.col("published_at")) != ""
    else:
        published, given = F.col("published_at").cast("timestamp"), F.col("published_at").isNotNull()
    return dated.withColumn("known_at", F.when(given, published).otherwise(cal.at_seoul(F.col("_next")))).drop("_next")


def published_time(text: Column) -> Column:
    """Instant of publication text: its own offset, else Seoul's; null where it is no time."""
    plain = F.replace(tx.clean(text), F.lit("T"), F.lit(" "))
    return F.when(tx.has_offset(text), tx.offset_timestamp(text)).otherwise(F.concat(plain, F.lit("+09:00")).try_cast("timestamp"))


def unreadable_times(tied: DataFrame) -> DataFrame:
    """Findings for rows whose publication text is no time."""
    if not isinstance(tied.schema["published_at"].dataType, T.StringType):
        tied = tied.withColumn("published_at", F.lit(None).cast("string"))
    bad = tied.filter((tx.clean(F.col("published_at")) != "") & published_time(F.col("published_at")).isNull())
    return findings(
        bad, source="status", severity="blocking", rule="bad_published_at", subject=F.col("security_id"),
        date=F.col("requested_date"), evidence=F.array("evidence_id"), observed=F.col("published_at"),
    )


def resolve_identity(rows: DataFrame, lifecycle: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status rows tied to the one security listed that day, and findings for the others.

    A row is looked up by standard code when it has one, by short code otherwise.  The listed
    securities are reduced to one row per day and code first, so an ambiguous code does not
    multiply the status rows.
    """
    return split_identity(identified(rows, lifecycle, coverage))


def identified(rows: DataFrame, lifecycle: DataFrame, coverage: DataFrame) -> DataFrame:
    """Status rows with ``_matches``, how many securities were listed that day under their code, and ``_who``, the first of them.

    Listings are expanded only to the codes and days that rows ask for.
    """
    asked = F.coalesce(
        F.concat(F.lit("s:"), F.nullif(F.trim("standard_code"), F.lit(""))), F.concat(F.lit("c:"), F.col("short_code"))
    )
    tagged = rows.withColumns({
        "_key": asked,
        "evidence_id": evidence_id(F.col("dataset"), F.col("requested_date"), F.col("raw_version_id"), F.col("source_row_number")),
    })
    identity = F.struct("security_id", "market", "security_kind")
    codes = F.array(F.concat(F.lit("s:"), "standard_code"), F.concat(F.lit("c:"), "short_code"))
    coded = lifecycle.select(identity.alias("_who"), "valid_from", "valid_to", F.explode(codes).alias("_key"))
    listed = listed_when(coded, ["_key"], tagged, F.col("requested_date"), cal.DateList(coverage, "requested_date"))
    known = listed.groupBy(F.col("date").alias("requested_date"), "_key").agg(
        F.count(F.lit(1)).alias("_matches"), F.min("_who").alias("_who"))
    return tagged.join(known, ["requested_date", "_key"], "left")


def split_identity(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``identified`` that name one security, and findings for the others."""
    one = F.coalesce(F.col("_matches") == 1, F.lit(False))
    good = joined.filter(one).drop("market", "security_kind").select("*", "_who.*").drop("_who", "_key", "_matches")
    found = findings(
        joined.filter(~one), source="status", severity="blocking", rule="ambiguous_lifecycle_identity",
        subject=F.col("short_code"), date=F.col("requested_date"), evidence=F.array("evidence_id"),
        observed=F.coalesce("_matches", F.lit(0)),
    )
    return good, found


def _flag_code() -> Column:
    """The three flags as one number 0-7."""
    code = F.lit(0)
    for position, flag in enumerate(FLAGS):
        code = code + F.when(F.col(flag), 1 << position).otherwise(0)
    return code


def _flag_mask() -> Column:
    """A bit per flag combination; or-ing masks tells how many combinations occur."""
    mask = F.lit(0)
    for value in range(1 << len(FLAGS)):
        mask = F.when(_flag_code() == value, 1 << value).otherwise(mask)
    return mask


def _combinations(mask: str, flags: tuple[str, ...]) -> Column:
    """How many combinations of the given flags a mask of all flags' combinations holds."""
    seen = sum(1 << position for position, flag in enumerate(FLAGS) if flag in flags)
    groups: dict[int, int] = {}
    for value in range(1 << len(FLAGS)):
        groups[value & seen] = groups.get(value & seen, 0) | 1 << value
    return sum(((F.col(mask).bitwiseAND(F.lit(group)) != 0).cast("int") for group in groups.values()), F.lit(0))


def contradictions(assertions: DataFrame) -> DataFrame:
    """Securities and days whose rows disagree about the flags of one effective date."""
    grouped = assertions.groupBy("security_id", "requested_date", "effective_from").agg(
        F.bit_or(_flag_mask()).alias("_mask"),
        F.min_by("evidence_id", F.struct("raw_version_id", "source_row_number")).alias("evidence_id"),
    )
    return findings(
        grouped.filter(F.bit_count("_mask") > 1), source="status", severity="blocking", rule="contradictory_assertions",
        subject=F.col("security_id"), date=F.col("requested_date"), evidence=F.array("evidence_id"),
        observed=F.col("effective_from"),
    )


def build_model(rows: DataFrame, lifecycle: DataFrame, sessions: DataFrame, path: str | None = None) -> StatusModel:
    """Assertions, their intervals and findings from normalised status rows.

    With ``path`` the listings and the rows tied to them are kept there: assertions, intervals and findings then read
    those tables, where each would tie all rows anew otherwise.
    """
    coverage = rows.select("requested_date").distinct()
    if path is not None:
        lifecycle = store_tables({"lifecycle": lifecycle}, path, ["security_id"])["lifecycle"]
    joined = identified(rows, lifecycle, coverage)
    if path is not None:
        joined = store_tables({"identified": joined}, path)["identified"]
    tied, ambiguous = split_identity(joined)
    dates = cal.DateList(sessions, "session_date")
    assertions = with_known_at(tied, dates).select(
        "evidence_id", "security_id", "requested_date", F.col("effective_date").alias("effective_from"), "known_at",
        "observed_at", "market", "security_kind", *FLAGS, "raw_version_id", "source_row_number",
    )
    return StatusModel(
        assertions=assertions, intervals=status_intervals(assertions, dates), coverage=coverage, lifecycle=lifecycle,
        sessions=sessions, findings=union_all([ambiguous, contradictions(assertions), unreadable_times(tied)]),
    )


def stored_model(model: StatusModel, path: str) -> StatusModel:
    """The model as tables below ``path``: decisions, universes and reconciliations then scan it instead of building it again."""
    return StatusModel(**store_tables(model.tables() | {"days": model.runs()}, path, ["security_id"]))


def status_intervals(assertions: DataFrame, sessions: DataFrame | cal.DateList) -> DataFrame:
    """Each assertion with the session after its requested date as its end."""
    dated = cal.with_next_session(assertions, F.col("requested_date"), sessions, "effective_to")
    return dated.select(
        "evidence_id", "security_id", "effective_from", "effective_to", "known_at", "market", "security_kind", *FLAGS,
        "raw_version_id", "source_row_number",
    )


def _claims(assertions: DataFrame) -> DataFrame:
    """Assertions gathered per (security, requested date, known time): flags seen, evidence, newest row.

    Groups are the rows one security has in the files of one day with one time stamp.  ``_usable_from`` is the instant from which the
    first of a group can be used: a claim without an effective day counts from its other two times on.
    """
    newest = F.struct("raw_version_id", "source_row_number", "market", "security_kind", *FLAGS)
    by_date = assertions.filter("known_at IS NOT NULL").groupBy("security_id", "requested_date", "known_at", "effective_from").agg(
        F.bit_or(_flag_mask()).alias("mask"), F.sort_array(F.collect_set("evidence_id")).alias("ids"), F.max(newest).alias("newest"),
    )
    effective = F.when(F.count_if(F.col("effective_from").isNull()) == 0, F.min("effective_from"))
    gathered = by_date.groupBy("security_id", "requested_date", "known_at").agg(
        F.collect_list(F.struct("effective_from", "mask", "ids", "newest")).alias("_claims"), effective.alias("_effective")
    )
    usable_from = F.greatest(F.col("known_at"), cal.at_seoul(F.col("_effective")), cal.at_seoul(F.col("requested_date")))
    return gathered.withColumn("_usable_from", usable_from).drop("_effective")


def decide(
    model: StatusModel, requests: DataFrame, policy: Policy = V1, model_fingerprint: Column | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """State of each (security_id, as_of) request with reasons and evidence; ``carry`` names columns of requests that come along.

    An assertion can be used from the latest of its known time, effective day and requested day on.
    Ordered by that instant, the running greatest (requested date, known time) is the evidence a request
    sees, so requests, assertions and listings are merged into one ordered scan per security, instead of pairing every request
    with every assertion.  The evidence travels with the scan; securities with very many rows are cut into days.
    """
    asked = requests.select("security_id", "as_of", F.struct(*carry, F.lit(0).alias("_none")).alias("_carry"))
    if not carry:
        asked = asked.distinct()
    span_type = "struct<valid_from:date,valid_to:date>"
    claims = _claims(model.assertions.filter("security_id IS NOT NULL"))
    claim = F.struct("requested_date", "known_at", "_claims")
    claim_type = claims.select(claim.alias("c")).schema["c"].dataType
    nothing = F.lit(None).cast(asked.schema["_carry"].dataType)
    known = claims.select(
        "security_id", "_usable_from", F.lit(1).alias("_kind"), F.lit(None).cast(span_type).alias("_span"),
        claim.cast(claim_type).alias("_claim"), nothing.alias("_carry"),
    ).withColumnRenamed("_usable_from", "as_of")
    spans = model.lifecycle.filter("security_id IS NOT NULL").select(
        "security_id", cal.at_seoul(F.col("valid_from")).alias("as_of"), F.lit(0).alias("_kind"),
        F.struct("valid_from", "valid_to").cast(span_type).alias("_span"), F.lit(None).cast(claim_type).alias("_claim"),
        nothing.alias("_carry"),
    )
    wanted = asked.select(
        "security_id", "as_of", F.lit(2).alias("_kind"), F.lit(None).cast(span_type).alias("_span"),
        F.lit(None).cast(claim_type).alias("_claim"), "_carry",
    )
    merged = spans.unionByName(known).unionByName(wanted)
    found = running(
        merged, ["security_id"], F.to_date("as_of"), ["as_of", "_kind"],
        {"_listing": ("last", F.col("_span")), "_seen": ("max", F.col("_claim"))}, hot_rows=HOT_ROWS,
    ).filter("_kind = 2").withColumn("_day", cal.seoul_day(F.col("as_of")))
    return _judged(found, model, policy, model_fingerprint, carry)


def _judged(
    found: DataFrame, model: StatusModel, policy: Policy, model_fingerprint: Column | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Decisions of requests ``(security_id, as_of, _day, _carry)`` from the listing and the evidence ``_seen`` that each of them sees."""
    days = small_side(model.runs())
    today = days.select(F.col("session_date").alias("_day"), F.col("covered").alias("_covered"), "gaps_to")
    then = days.select(F.col("session_date").alias("_requested"), "gaps_before")
    found = (
        found.withColumns({"_requested": F.col("_seen.requested_date"), "_claims": F.col("_seen._claims")})
        .join(today, "_day", "left")
        .join(then, "_requested", "left")
    )
    in_force = F.filter("_claims", lambda c: c["effective_from"] <= F.col("_day"))
    found = found.withColumn("_force", F.coalesce(in_force, F.array()))
    mask = F.aggregate("_force", F.lit(0), lambda acc, c: acc.bitwiseOR(c["mask"]))
    newest = F.array_max(F.transform("_force", lambda c: c["newest"]))
    ids = F.sort_array(F.flatten(F.transform("_force", lambda c: c["ids"])))
    found = found.withColumns({"_mask": mask, "_newest": newest, "_ids": ids})

    covered = F.coalesce("_covered", F.lit(False))
    listed = F.coalesce(
        (F.col("_listing.valid_from") <= F.col("_day"))
        & (F.col("_listing.valid_to").isNull() | (F.col("_listing.valid_to") > F.col("_day"))),
        F.lit(False),
    )
    evidence = F.coalesce((F.size("_force") > 0) & (F.col("gaps_to") == F.col("gaps_before")), F.lit(False))
    against = F.array_compact(F.array(
        F.when(~F.col("_newest.market").isin(list(policy.allowed_markets)), "market_not_allowed"),
        F.when(~F.col("_newest.security_kind").isin(list(policy.allowed_security_kinds)), "security_kind_not_allowed"),
        *[F.when(F.col(f"_newest.{flag}"), flag) for flag in policy.blocking_flags],
    ))
    clash = _combinations("_mask", policy.blocking_flags) > 1
    none = F.array().cast("array<string>")
    state = (
        F.when(~covered, "unknown").when(~listed, "not_listed").when(~evidence, "unknown").when(clash, "unknown")
        .when(F.size(against) > 0, "ineligible").otherwise("eligible")
    )
    reasons = (
        F.when(~covered, F.array(F.lit("missing_daily_coverage"))).when(~listed, F.array(F.lit("not_listed")))
        .when(~evidence, F.array(F.lit("evidence_not_yet_known"))).when(clash, F.array(F.lit("contradictory_assertions")))
        .otherwise(against)
    )
    shown = F.when(covered & listed & evidence, F.col("_ids")).otherwise(none)
    return found.select(
        *[F.col(f"_carry.{c}").alias(c) for c in carry],
        "security_id", "as_of", state.alias("state"), reasons.alias("reason_codes"), shown.alias("evidence_ids"),
        F.lit(policy_fingerprint(policy)).alias("policy_fingerprint"),
        (F.lit(None).cast("string") if model_fingerprint is None else model_fingerprint).alias("model_fingerprint"),
    )


def decision_sheet(model: StatusModel, stamps: DataFrame, policy: Policy = V1) -> DataFrame:
    """Decisions of all listed securities at given times: ``stamps`` (date, as_of), one time per day.

    What a security's requests see changes only where a listing or a better claim begins, so listings meet the spans in which one
    claim is the best, and only then become one row per stamp: no decision is shuffled.  Times on another day than their date are
    asked one by one.
    """
    carry = ["date", "short_code", "name", "market", "security_kind"]
    rows, distinct, own = stamps.agg(
        F.count(F.lit(1)), F.count_distinct("date"),
        F.coalesce(F.bool_and(F.coalesce(cal.seoul_day(F.col("as_of")) == F.col("date"), F.lit(False))), F.lit(False)),
    ).first()
    if not (own and rows == distinct):
        listed = listed_on(model.lifecycle, stamps, "date").join(small_side(stamps), "date")
        return decide(model, listed, policy, carry=carry)
    dates = cal.DateList(stamps, "date")
    spans = _evidence_spans(model.assertions, stamps, dates).withColumnRenamed("security_id", "_security")
    listed = cal.numbered_intervals(model.lifecycle, F.col("valid_from"), F.col("valid_to"), dates)
    meets = (F.col("security_id") == F.col("_security")) & (F.col("_first") < F.col("_to_no")) & (F.col("_until") > F.col("_from_no"))
    pieces = listed.join(spans, meets, "left")
    first, until = F.greatest("_from_no", "_first"), F.least("_to_no", "_until")
    asked = dates.with_date(pieces.withColumn("_no", F.explode(F.sequence(first, until - 1))), "_no", "date").join(
        small_side(stamps), "date")
    found = asked.select(
        "security_id", "as_of", F.col("date").alias("_day"), F.struct(*carry).alias("_carry"), "_seen",
        F.when(F.col("security_id").isNotNull(), F.struct("valid_from", "valid_to")).alias("_listing"),
    )
    return _judged(found, model, policy, carry=carry)


def _evidence_spans(assertions: DataFrame, stamps: DataFrame, dates: cal.DateList) -> DataFrame:
    """``(security_id, _first, _until, _seen)``: from which stamp up to which one a claim is the best that can be used.

    Stamps are numbered by their day.  The spans of a security join without gaps from the first stamp to the last; before its first
    claim ``_seen`` is null.  Claims are reduced to one per security and stamp before the window.
    """
    claims = _claims(assertions.filter("security_id IS NOT NULL")).withColumn("_on", cal.seoul_day(F.col("_usable_from")))
    clock = small_side(stamps.select(F.col("date").alias("_on"), F.col("as_of").alias("_stamp")))
    late = F.coalesce(F.col("_stamp") < F.col("_usable_from"), F.lit(False)).cast("int")
    numbered = dates.with_next_no(claims, F.col("_on"), "_next_no").join(clock, "_on", "left").select(
        "security_id", (F.col("_next_no") + late).alias("_first"), F.struct("requested_date", "known_at", "_claims").alias("_seen"))
    best = numbered.filter(F.col("_first") <= dates.count).groupBy("security_id", "_first").agg(F.max("_seen").alias("_seen"))
    order = Window.partitionBy("security_id").orderBy("_first")
    running_best = best.withColumns({
        "_seen": F.max("_seen").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_until": F.coalesce(F.lead("_first").over(order), F.lit(dates.count + 1)), "_row": F.row_number().over(order),
    })
    blank = F.when((F.col("_row") == 1) & (F.col("_first") > 1), F.struct(
        F.lit(1).alias("_first"), F.col("_first").alias("_until"), F.lit(None).cast(best.schema["_seen"].dataType).alias("_seen")))
    spans = F.array_compact(F.array(F.struct("_first", "_until", "_seen"), blank))
    return running_best.select("security_id", F.explode(spans).alias("_span")).select("security_id", "_span.*")


def universe(model: StatusModel, stamps: DataFrame, policy: Policy = V1) -> DataFrame:
    """Eligible securities at given times."""
    return decision_sheet(model, stamps, policy).filter("state = 'eligible'")


def execution_status(model: StatusModel, requests: DataFrame, policy: Policy | None = V1) -> DataFrame:
    """Decisions at execution: unknown when the session date is not the day of the time, or the policy is unknown.

    ``requests`` (security_id, session_date, as_of).
    """
    joined = decide(model, requests, policy or V1, carry=["session_date"])
    other_day = F.col("session_date") != cal.seoul_day(F.col("as_of"))
    none = F.array().cast("array<string>")
    refused = F.when(other_day, "execution_date_mismatch")
    if policy is None:
        refused = F.coalesce(refused, F.lit("unknown_policy"))
    return joined.select(
        "security_id", "session_date", "as_of",
        F.when(refused.isNotNull(), "unknown").otherwise(F.col("state")).alias("state"),
        F.when(refused.isNotNull(), F.array(refused)).otherwise(F.col("reason_codes")).alias("reason_codes"),
        F.when(refused.isNotNull(), none).otherwise(F.col("evidence_ids")).alias("evidence_ids"),
    )


def reconcile(model: StatusModel, market: DataFrame, start: str, end: str, policy: Policy = V1) -> tuple[DataFrame, DataFrame]:
    """End-of-day state of every listed allowed security, and findings against listings and market rows."""
    within = F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    days = model.sessions.filter(within).select(F.col("session_date").alias("date"))
    dates = cal.DateList(days, "date")
    lifecycle, day = model.lifecycle, F.col("requested_date")
    said = model.assertions.join(days.withColumnRenamed("date", "requested_date"), "requested_date", "left_semi")
    said_days = said.select("requested_date", "security_id").distinct()
    outside = said.join(
        listed_when(lifecycle, ["security_id"], said_days, day, dates).select(F.col("date").alias("requested_date"), "security_id"),
        ["requested_date", "security_id"], "left_anti",
    )
    allowed = lifecycle.filter(
        F.col("market").isin(list(policy.allowed_markets)) & F.col("security_kind").isin(list(policy.allowed_security_kinds))
    )
    # The days a security speaks of meet its listings as one array: listings become days without a shuffle of days.
    silent = cal.expand_intervals(
        allowed.join(dates.numbers_per_key(said_days, ["security_id"], day, "_said"), "security_id", "left"),
        F.col("valid_from"), F.col("valid_to"), dates, "requested_date", without="_said",
    ).select("requested_date", "security_id")
    none = F.array().cast("array<string>")
    unknown = silent.select(
        "requested_date", "security_id", F.lit("unknown").alias("state"),
        F.array(F.lit("missing_selected_daily_status")).alias("reason_codes"), none.alias("evidence_ids"),
    )
    spoken = listed_when(allowed, ["security_id"], said_days, day, dates).select(
        F.col("date").alias("requested_date"), "security_id", cal.at_seoul(F.col("date"), cal.DAY_END).alias("as_of")
    )
    decided = decide(model, spoken, policy, carry=["requested_date"]).select(
        "requested_date", "security_id", "state", "reason_codes", "evidence_ids"
    )
    inside = market.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    coded = lifecycle.select("security_id", F.col("short_code").alias("code"), "valid_from", "valid_to")
    listed = listed_when(coded, ["code"], inside, F.col("trade_date"), dates)
    identities = listed.groupBy(F.col("date").alias("trade_date"), "code").agg(
        F.count(F.lit(1)).alias("_n"), F.min("security_id").alias("_security")
    )
    tied = inside.join(identities, ["trade_date", "code"], "left")
    order = Window.partitionBy("code").orderBy("trade_date")
    gap = F.col("close") / F.nullif(F.lag("close").over(order), F.lit(0.0))
    jumps = tied.withColumn("_gap", gap).filter("_gap < 0.5 OR _gap > 2.0")
    found = union_all([
        findings(outside, source="reconciliation", severity="blocking", rule="status_outside_listing",
                 subject=F.col("security_id"), date=F.col("requested_date"), evidence=F.array("evidence_id")),
        findings(silent, source="reconciliation", severity="blocking", rule="missing_selected_daily_status",
                 subject=F.col("security_id"), date=F.col("requested_date")),
        findings(tied.filter(F.coalesce("_n", F.lit(0)) != 1), source="reconciliation", severity="quarantine",
                 rule="market_without_lifecycle", subject=F.col("code"), date=F.col("trade_date"),
                 evidence=F.array(F.concat_ws(":", F.lit("market"), F.col("raw_version_id").cast("string"),
                                              F.col("trade_date").cast("string"), "code"))),
        findings(jumps, source="reconciliation", severity="warning", rule="price_gap",
                 subject=F.when(F.col("_n") == 1, F.col("_security")), date=F.col("trade_date")),
    ])
    return unknown.unionByName(decided), found


def reconciliation_days(results: DataFrame, found: DataFrame) -> DataFrame:
    """Worst status per day: blocked above unknown above passed."""
    level = F.when(F.col("state") == "unknown", 1).otherwise(0)
    stop = F.when(F.col("severity").isin(STOPPING), 2).otherwise(0)
    both = results.select(F.col("requested_date").alias("date"), level.alias("_level")).unionByName(
        found.filter("date IS NOT NULL").select("date", stop.alias("_level"))
    )
    names = F.array(*[F.lit(s) for s in DAY_STATES])
    return both.groupBy("date").agg(F.element_at(names, F.max("_level") + 1).alias("status"))


def latest_day_status(run_days: DataFrame) -> DataFrame:
    """Status of each day in the newest run that covers it."""
    return run_days.groupBy("date").agg(F.max("run_id").alias("run_id"), F.max_by("status", "run_id").alias("status"))


def all_findings(model_findings: DataFrame, reconciliation: DataFrame) -> DataFrame:
    return model_findings.withColumn("source", F.lit("model")).unionByName(
        reconciliation.withColumn("source", F.lit("reconciliation"))
    )


def readiness(
    model: StatusModel, pending: DataFrame, day_status: DataFrame, rebuilds: DataFrame, start: str, end: str,
    *, policy_known: bool = True, promoted: bool = True,
) -> DataFrame:
    """One row with the verdict for a range and the codes of everything against it.

    ``pending`` lists unselected revisions in the range (requested_date), ``day_status`` (date, status), ``rebuilds`` (id, status).
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    sessions = model.sessions.filter(F.col("session_date").between(first, last))
    uncovered = sessions.join(model.coverage.select(F.col("requested_date").alias("session_date")), "session_date", "left_anti")

    def total(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    facts = sessions.agg(F.min("session_date").alias("_from"), F.max("session_date").alias("_to")).select(
        "*", total(uncovered).alias("unknown_days"),
        total(model.findings.filter(F.col("severity").isin(STOPPING))).alias("blocking_count"),
        total(pending.filter(F.col("requested_date").between(first, last))).alias("pending_days"),
        total(day_status.filter(F.col("date").between(first, last) & (F.col("status") != "passed"))).alias("blocked_days"),
        rebuilds.agg(F.max_by("status", "id")).scalar().alias("_rebuild"),
    )
    codes = F.array_compact(F.array(
        F.when(F.lit(not policy_known), "unknown_policy"),
        F.when(F.lit(not promoted), "missing_promoted_model"),
        F.when(F.col("_from").isNull() | (F.col("_from") > first) | (F.col("_to") < last), "missing_session_calendar"),
        F.when(F.col("unknown_days") > 0, "missing_daily_coverage"),
        F.when(F.col("blocking_count") > 0, "blocking_findings"),
        F.when(F.col("pending_days") > 0, "unselected_revision"),
        F.when(F.col("_rebuild") == "failed", "rebuild_mismatch"),
        F.when(F.col("blocked_days") > 0, "reconciliation_blocked"),
    ))
    return facts.select(
        (F.size(codes) == 0).alias("investability_ready"), F.array_join(codes, ",").alias("blocking_codes"), "unknown_days",
        "blocking_count", "pending_days", "blocked_days",
    )
