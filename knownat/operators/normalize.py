"""From landed text columns to canonical tables, with findings for what does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.findings import explode_reasons, findings
from knownat.functions import text as tx
from knownat.functions.ordered import latest_by
from knownat.schemas import (
    DAILY_MARKET_API, DAILY_MARKET_COLUMNS, DAILY_MARKET_CSV, DEFAULT_EVENTS, LIFECYCLE_COLUMNS, LIFECYCLE_HEADERS,
    MARKETS, STATUS_COLUMNS, STATUS_HEADERS,
)

PRICES = ["open", "high", "low", "close", "volume"]


class MissingColumns(ValueError):
    """A landed table lacks columns its canonical form needs."""


def rename_headers(df: DataFrame, aliases: dict[str, str], required: set[str]) -> DataFrame:
    """Apply the header aliases present in the table and insist on the required columns."""
    renamed = df.withColumnsRenamed({old: new for old, new in aliases.items() if old in df.columns})
    missing = required - set(renamed.columns)
    if missing:
        raise MissingColumns(", ".join(sorted(missing)))
    return renamed


def _with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = {name: F.lit(None).cast("string") for name in columns if name not in df.columns}
    return df.withColumns(absent) if absent else df


def normalize_daily_market(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Daily full-market rows of the two exchanges; ``extra`` columns are carried through."""
    aliases = DAILY_MARKET_API if set(DAILY_MARKET_API) <= set(df.columns) else DAILY_MARKET_CSV
    renamed = rename_headers(df, aliases, set(DAILY_MARKET_COLUMNS) - {"segment"})
    renamed = _with_missing(renamed, ["segment"])
    numbers = ["open", "high", "low", "close", "volume", "amount", "marcap", "listed_shares"]
    typed = renamed.select(
        *extra,
        tx.parse_date(F.col("trade_date")).alias("trade_date"), tx.pad_code_or_blank(F.col("code")).alias("code"),
        tx.clean(F.col("name")).alias("name"), tx.market_name(F.col("market")).alias("market"),
        tx.clean(F.col("segment")).alias("segment"), *[tx.number(F.col(n)).alias(n) for n in numbers],
    )
    return typed.filter(F.col("market").isin(list(MARKETS)))


def normalize_lifecycle(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lifecycle rows in canonical form and findings for rows without code or dates.

    The table carries ``dataset``, ``raw_version_id``, ``source_row_number`` and ``observed_at`` from its landing.
    """
    required = {"standard_code", "short_code", "name", "market", "stock_type", "listing_date", "dataset"}
    data = _with_missing(rename_headers(df, LIFECYCLE_HEADERS, required), LIFECYCLE_COLUMNS)
    texts = ["standard_code", "name", "security_type", "stock_type", "issuer_reference", "event_type", "previous_name",
             "previous_market", "successor_standard_code"]
    dates = ["listing_date", "last_trading_date", "delisting_date", "effective_date"]
    default = F.create_map(*[F.lit(v) for pair in DEFAULT_EVENTS.items() for v in pair])
    data = data.withColumns(
        {
            **{name: tx.blank_to_null(F.col(name)) for name in texts},
            **{name: tx.parse_date(F.col(name)) for name in dates},
            "market": F.nullif(tx.market_name(F.col("market")), F.lit("")),
            "short_code": tx.pad_code_or_blank(F.col("short_code")),
            "previous_code": F.nullif(tx.pad_code_or_blank(F.col("previous_code")), F.lit("")),
        }
    ).withColumn("event_type", F.coalesce("event_type", F.element_at(default, F.col("dataset"))))
    fallback = F.when(F.col("event_type") == "delisting", F.col("delisting_date")).otherwise(F.col("listing_date"))
    data = data.withColumn("effective_date", F.coalesce("effective_date", fallback)).select(*LIFECYCLE_COLUMNS)
    checks = {
        "standard_code_missing": F.col("standard_code").isNull(),
        "listing_date_missing": F.col("listing_date").isNull(),
        "effective_date_missing": F.col("effective_date").isNull(),
    }
    return _split(data, checks, "lifecycle", F.col("standard_code"), F.col("effective_date"))


def normalize_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily status rows in canonical form and findings for rows with a bad flag, date, market or name.

    ``requested_date`` is the day asked for; the table's own date column must agree with it.
    """
    own = next((h for h in ("기준일", "BAS_DD", "basDt") if h in df.columns), None)
    aliases = {old: new for old, new in STATUS_HEADERS.items() if new != "requested_date"}
    required = {"requested_date", "short_code", "name", "market", "security_kind", "management_designation",
                "trading_suspension", "liquidation_trading"}
    data = _with_missing(rename_headers(df, aliases, required), STATUS_COLUMNS)
    flags = ["management_designation", "trading_suspension", "liquidation_trading"]
    own_date = tx.parse_date(F.col(own)) if own else F.col("requested_date")
    effective = tx.clean(F.col("effective_date"))
    data = data.withColumns(
        {
            "_own_date": own_date,
            "_bad_effective": (effective != "") & tx.parse_date(F.col("effective_date")).isNull(),
            "standard_code": tx.blank_to_null(F.col("standard_code")),
            "short_code": tx.pad_code_or_blank(F.col("short_code")),
            "name": tx.clean(F.col("name")),
            "market": tx.market_name(F.col("market")),
            "security_kind": tx.security_kind(F.col("security_kind"), funds=True),
            **{flag: tx.flag(F.col(flag)) for flag in flags},
            "effective_date": F.coalesce(tx.parse_date(F.col("effective_date")), F.col("requested_date")),
            "published_at": tx.blank_to_null(F.col("published_at")),
        }
    )
    checks = {
        "date_mismatch": ~F.coalesce(F.col("_own_date") == F.col("requested_date"), F.lit(False)),
        **{f"bad_{flag}": F.col(flag).isNull() for flag in flags},
        "bad_effective_date": F.col("_bad_effective"),
        "code_missing": F.col("short_code") == "",
        "name_missing": F.col("name") == "",
        "bad_market": ~F.col("market").isin(list(MARKETS)),
    }
    good, found = _split(data, checks, "status", F.col("short_code"), F.col("requested_date"))
    return good.select(*STATUS_COLUMNS), found


def _split(data: DataFrame, checks: dict[str, Column], source: str, subject: Column, date: Column):
    failed = F.lit(False)
    for condition in checks.values():
        failed = failed | condition
    found = findings(
        explode_reasons(data, checks), source=source, severity="blocking", rule=F.col("rule_id"), subject=subject,
        date=date, observed=F.col("source_row_number"),
    )
    return data.filter(~failed), found


def normalize_bars(df: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """Daily bars up to ``end``: five non-negative finite numbers, close above zero, the last ingested per day.

    Columns code, trade_date, the five numbers and ``ingest_seq``; rows that fail are returned as findings.
    """
    typed = df.select(
        tx.pad_code(F.col("code")).alias("code"), F.col("trade_date").cast("string").try_cast("date").alias("trade_date"),
        *[F.col(n).cast("string").try_cast("double").alias(n) for n in PRICES], "ingest_seq",
    )
    broken = F.lit(False)
    for name in PRICES:
        broken = broken | ~tx.finite(F.col(name)) | (F.col(name) < 0)
    checks = {"bad_date": F.col("trade_date").isNull(), "bad_number": F.coalesce(broken, F.lit(True)),
              "close_not_positive": F.coalesce(F.col("close") <= 0, F.lit(False))}
    failed = checks["bad_date"] | checks["bad_number"] | checks["close_not_positive"]
    good = typed.filter(~failed & (F.col("trade_date") <= F.lit(end).cast("date")))
    found = findings(
        explode_reasons(typed, checks), source="bars", severity="blocking", rule=F.col("rule_id"), subject=F.col("code"),
        date=F.col("trade_date"), observed=F.col("ingest_seq"),
    )
    return latest_by(good, ["code", "trade_date"], [F.col("ingest_seq").desc()]), found


def check_series(df: DataFrame, key: str, source: str) -> DataFrame:
    """Findings on bars or index bars: repeated dates and prices that are missing or not positive."""
    bad = ~F.coalesce((F.col("open") > 0) & (F.col("close") > 0), F.lit(False))
    daily = df.groupBy(key, "trade_date").agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    checks = {"duplicate_date": F.col("_n") > 1, "bad_price": F.col("_bad") > 0}
    return findings(
        explode_reasons(daily, checks), source=source, severity="blocking", rule=F.col("rule_id"), subject=F.col(key),
        date=F.col("trade_date"), observed=F.when(F.col("rule_id") == "bad_price", F.col("_bad")).otherwise(F.col("_n")),
    )


def check_snapshot(df: DataFrame) -> DataFrame:
    """Findings on dated listings: repeated codes and values that are missing or not positive."""
    bad = ~F.coalesce((F.col("marcap") > 0) & (F.col("amount") > 0), F.lit(False))
    rows = df.groupBy("signal_date", "code").agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    checks = {"duplicate_code": F.col("_n") > 1, "value_not_positive": F.col("_bad") > 0}
    return findings(
        explode_reasons(rows, checks), source="snapshot", severity="blocking", rule=F.col("rule_id"),
        subject=F.col("code"), date=F.col("signal_date"),
    )


def listing_completeness(listings: DataFrame, share: float = 0.95) -> DataFrame:
    """Per day, rows with positive market cap and turnover against the needed number."""
    valid = F.coalesce((F.col("marcap") > 0) & (F.col("amount") > 0), F.lit(False))
    counted = listings.groupBy("day").agg(F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"))
    needed = F.greatest(F.lit(1), F.floor(F.col("total") * share)).cast("long")
    return counted.withColumn("needed", needed).withColumn("complete", F.col("valid") >= F.col("needed"))


def latest_complete_listing(listings: DataFrame, as_of: str | None = None, days_back: int = 7) -> DataFrame:
    """Rows of the newest complete day, looking back at most ``days_back`` days from ``as_of``."""
    offered = listings
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        offered = listings.filter(F.col("day").between(F.date_sub(day, days_back), day))
    newest = listing_completeness(offered).filter("complete").agg(F.max("day")).scalar()
    return offered.filter(F.col("day") == newest)


def check_actions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corporate actions with padded codes and parsed dates; rows missing a key field become findings."""
    typed = df.withColumns({"code": tx.pad_code(F.col("code")), "effective_date": tx.parse_date(F.col("effective_date"))})
    fields = ["code", "effective_date", "action_type", "status", "source"]
    checks = {f"{name}_missing": F.col(name).isNull() for name in fields}
    failed = F.lit(False)
    for condition in checks.values():
        failed = failed | condition
    found = findings(
        explode_reasons(typed, checks), source="actions", severity="blocking", rule=F.col("rule_id"),
        subject=F.col("code"), date=F.col("effective_date"), observed=F.col("seq"),
    )
    return typed.filter(~failed), found


def market_for_days(daily_market: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Market rows of the given days, and the raw versions behind them, one row each."""
    rows = daily_market.join(days.select("trade_date").distinct(), "trade_date", "left_semi")
    return rows, rows.select("raw_version_id").distinct()
