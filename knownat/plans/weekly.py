"""The weekly ranking as one plan over all weeks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.operators import fundamentals as fu
from knownat.operators import ranking as rk
from knownat.schemas import RankingRules
from knownat.session import scratch_folder
from knownat.sources.tables import store_tables


@dataclass(frozen=True)
class Desk:
    """Point-in-time inputs, all lazy."""

    sessions: DataFrame
    snapshots: DataFrame
    bars: DataFrame
    statements: DataFrame
    accounts: DataFrame
    companies: DataFrame


@dataclass(frozen=True)
class Choice:
    """The names that the weeks rank and what belongs to them: small tables kept in the scratch folder, and the lazy rest."""

    candidates: DataFrame
    filings: DataFrame
    factors: DataFrame
    metrics: DataFrame


def choose(
    desk: Desk, rules: RankingRules, start: str | None, end: str | None, eligible: DataFrame | None, splits: DataFrame | None,
) -> Choice:
    """Candidates first: bars, statements and accounts are read only for names and filings that a week can rank.

    Candidates (at most ``limit`` names a week) and their filings are written once; read back, their size is known, so the tables that
    they thin out need no shuffle for it.
    """
    root = scratch_folder(desk.sessions.sparkSession, "ranking")
    schedule = store_tables({"schedule": cal.weekly_schedule(desk.sessions, start, end)}, root)["schedule"]
    listing = desk.snapshots.join(schedule.select("signal_date"), "signal_date", "left_semi")
    if eligible is not None:
        listing = listing.join(eligible.select("signal_date", "code").distinct(), ["signal_date", "code"], "left_semi")
    candidates = store_tables({"candidates": rk.candidate_universe(listing, rules).drop("cap_rank")}, root)["candidates"]
    codes, weeks = candidates.select("code").distinct(), candidates.select("signal_date", "code")
    dates = cal.DateList(schedule, "signal_date")
    # A filter, unlike a semi-join, also moves below the derivations that these tables may be made by.
    of_candidates = F.col("stock").isin(codes)
    factors = rk.price_factors(desk.bars.filter(F.col("code").isin(codes)), dates, rules.history, splits)
    filings = fu.select_filings(desk.statements.filter(of_candidates), dates).join(weeks, ["signal_date", "code"], "left_semi")
    filings = store_tables({"filings": filings}, root)["filings"]
    used = filings.select(F.col("code").alias("stock"), "year", "basis", "receipt").distinct()
    accounts = desk.accounts.filter(of_candidates & F.col("receipt").isin(used.select("receipt").distinct()))
    metrics = fu.statement_metrics(accounts.join(used, fu.FILING, "left_semi"))
    return Choice(candidates, filings, factors.join(weeks, ["signal_date", "code"], "left_semi"), metrics)


def rank_weeks(
    desk: Desk,
    rules: RankingRules = rk.RULES,
    *,
    start: str | None = None,
    end: str | None = None,
    eligible: DataFrame | None = None,
    splits: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked names and exclusions for every scheduled week.

    ``eligible`` (signal_date, code) restricts the listing to names the status decisions allow.
    """
    return rank_choice(desk, choose(desk, rules, start, end, eligible, splits), rules)


def rank_choice(desk: Desk, chosen: Choice, rules: RankingRules) -> tuple[DataFrame, DataFrame]:
    return rk.build_ranking(chosen.candidates, chosen.factors, chosen.filings, chosen.metrics, desk.companies, rules)


def readiness_report(
    desk: Desk,
    index_bars: DataFrame,
    start: str,
    end: str,
    rules: RankingRules = rk.RULES,
    locks: dict[str, bool] | None = None,
) -> DataFrame:
    """One row: weeks with and without enough names, warm-up start, missing inputs, locks."""
    root = scratch_folder(desk.sessions.sparkSession, "readiness")
    desk = replace(desk, **store_tables({"sessions": desk.sessions}, root))
    schedule = cal.weekly_schedule(desk.sessions, start, end).filter(F.col("execution_date") <= F.lit(end).cast("date"))
    ranked, _ = rank_weeks(desk, rules, start=start, end=end)
    weeks = store_tables({"weeks": rk.week_readiness(schedule, ranked, rules)}, root)["weeks"]
    symbols = {row[0] for row in index_bars.filter("symbol IN ('KOSPI', 'KOSDAQ')").select("symbol").distinct().collect()}
    # A ranked name has a snapshot, bars, a filing and a company; without one the tables themselves are looked at.
    if weeks.filter("ranked > 0").isEmpty():
        absent = [name for name in ("snapshots", "bars", "statements", "companies") if getattr(desk, name).isEmpty()]
    else:
        absent = []
    absent += [f"index_{symbol}" for symbol in ("KOSPI", "KOSDAQ") if symbol not in symbols]
    before = desk.sessions.filter(F.col("session_date") < F.lit(start).cast("date")).orderBy(F.col("session_date").desc())
    warmup = before.limit(rules.history).agg(
        F.when(F.count(F.lit(1)) >= rules.history, F.min("session_date"))
    ).scalar()
    closed = [name for name, ready in (locks or {}).items() if not ready]
    counts = weeks.agg(
        F.count_if("ready").alias("valid_weeks"), F.count_if(~F.col("ready")).alias("invalid_weeks")
    )
    missing = F.lit(",".join(absent))
    return counts.select(
        "valid_weeks",
        "invalid_weeks",
        ((F.col("invalid_weeks") > 0) | (missing != "") | F.lit(bool(closed))).alias("blocking"),
        warmup.alias("warmup_start"),
        missing.alias("missing_inputs"),
        F.lit(",".join(closed)).alias("locks"),
    )
