"""Annual filings: validation, account extraction, metrics and the choice as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.functions.text import amount

# Standard account names and statement sections.
PROFIT = {"CFS": "ProfitLossAttributableToOwnersOfParent", "OFS": "ProfitLoss"}
EQUITY = {"CFS": "EquityAttributableToOwnersOfParent", "OFS": "Equity"}
PROFIT_SECTIONS = ["IS", "CIS"]
EQUITY_SECTIONS = ["BS"]
FILING = ["stock", "year", "basis", "receipt"]


def validate_filings(accounts: DataFrame, filings: DataFrame) -> DataFrame:
    """``(filing, receipt, filed_at, reason)``: one 14-digit receipt per filing and its date.

    ``accounts`` (filing, receipt) are statement rows, ``filings`` (receipt, received) the filing list with
    ``yyyyMMdd`` dates.  A unique match gives the date, otherwise the receipt's own prefix.
    """
    one = accounts.groupBy("filing").agg(
        F.min("receipt").alias("receipt"),
        F.max("receipt").alias("_other"),
        F.count_if(F.col("receipt").isNull()).alias("_missing"),
    )
    listed = filings.groupBy("receipt").agg(F.count(F.lit(1)).alias("_n"), F.min("received").alias("_received"))
    day = F.when(F.col("_n") == 1, F.col("_received")).otherwise(F.substring("receipt", 1, 8))
    good = (F.col("receipt") == F.col("_other")) & (F.col("_missing") == 0) & F.col("receipt").rlike(r"^\d{14}$")
    return (
        one.join(listed, "receipt", "left")
        .withColumn("_day", F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date"))
        .select(
            "filing",
            F.when(F.coalesce(good, F.lit(False)), F.col("receipt")).alias("receipt"),
            F.when(F.coalesce(good, F.lit(False)), F.col("_day")).alias("filed_at"),
            F.when(~F.coalesce(good, F.lit(False)), "receipt_mismatch")
            .when(F.col("_day").isNull(), "bad_receipt_date")
            .alias("reason"),
        )
    )


def _is_account(names: dict[str, str], sections: list[str]) -> Column:
    wanted = F.when(F.col("basis") == "CFS", names["CFS"]).when(F.col("basis") == "OFS", names["OFS"])
    named = (F.col("account_id") == F.concat(F.lit("ifrs-full_"), wanted)) | (
        F.col("account_id") == F.concat(F.lit("ifrs_"), wanted)
    )
    return F.coalesce(named & F.col("sj_div").isin(sections), F.lit(False))


def _with_values(accounts: DataFrame, match: Column, fields: list[str]) -> DataFrame:
    """Amounts of the matching rows, read from text once a row: aggregates that name the parsing again would repeat it for each."""
    return accounts.withColumns({f"_value_{name}": F.when(match, amount(F.col(name))) for name in fields})


def _picked(label: str, match: Column, fields: list[str]) -> list[Column]:
    """Aggregates over ``_with_values`` that decide whether an account is present, in won, numeric and unambiguous."""
    bad_number = F.lit(False)
    columns = []
    for name in fields:
        value = F.col(f"_value_{name}")
        bad_number = bad_number | value.isNull()
        columns += [F.min(F.when(match, value)).alias(f"_{label}_{name}"),
                    F.max(F.when(match, value)).alias(f"_{label}_{name}_top")]
    return columns + [
        F.count_if(match).alias(f"_{label}_n"),
        F.count_if(match & ~F.coalesce(F.col("currency") == "KRW", F.lit(False))).alias(f"_{label}_foreign"),
        F.count_if(match & bad_number).alias(f"_{label}_bad"),
    ]


def _pick_reason(label: str, fields: list[str]) -> Column:
    differs = F.lit(False)
    for name in fields:
        differs = differs | (F.col(f"_{label}_{name}") != F.col(f"_{label}_{name}_top"))
    return (
        F.when(F.col(f"_{label}_n") == 0, F.lit(f"{label}_missing"))
        .when(F.col(f"_{label}_foreign") > 0, F.lit(f"{label}_not_krw"))
        .when(F.col(f"_{label}_bad") > 0, F.lit(f"{label}_not_numeric"))
        .when(differs, F.lit(f"{label}_ambiguous"))
    )


def pick_account(accounts: DataFrame, label: str, names: dict[str, str], sections: list[str], fields: list[str]) -> DataFrame:
    """One row per filing with the account's values, or the reason it cannot be used."""
    match = _is_account(names, sections)
    picked = _with_values(accounts, match, fields).groupBy(*FILING).agg(*_picked(label, match, fields))
    reason = _pick_reason(label, fields)
    return picked.select(
        *FILING,
        *[F.when(reason.isNull(), F.col(f"_{label}_{name}")).alias(name) for name in fields],
        reason.alias("reason"),
    )


def statement_metrics(accounts: DataFrame) -> DataFrame:
    """Profit, equity and return on equity per filing, or the first reason against it.

    One aggregation over the account rows; every aggregate combines before the shuffle.
    """
    profit, equity = _is_account(PROFIT, PROFIT_SECTIONS), _is_account(EQUITY, EQUITY_SECTIONS)
    one, two = ["thstrm_amount"], ["thstrm_amount", "frmtrm_amount"]
    corp = F.nullif(F.col("corp_code"), F.lit(""))
    picked = _with_values(accounts, profit | equity, two).groupBy(*FILING).agg(
        *_picked("profit", profit, one),
        *_picked("equity", equity, two),
        F.min(corp).alias("min_corp"),
        F.max(corp).alias("max_corp"),
    )
    gain = F.col("_profit_thstrm_amount")
    now, before = F.col("_equity_thstrm_amount"), F.col("_equity_frmtrm_amount")
    reason = F.coalesce(
        F.when(~F.col("basis").isin("CFS", "OFS"), "bad_basis"),
        _pick_reason("profit", one),
        _pick_reason("equity", two),
        F.when((now <= 0) | (before <= 0), "equity_not_positive"),
    )
    usable = reason.isNull()
    roe = gain.cast("double") / ((now + before).cast("double") / 2) * 100
    return picked.select(
        *FILING,
        F.when(usable, gain).alias("profit"),
        F.when(usable, now).alias("equity"),
        F.when(usable, before).alias("previous_equity"),
        F.when(usable, roe).alias("roe"),
        "min_corp",
        "max_corp",
        reason.alias("reason"),
    )


def company_reason(listed: Column, company: Column, corp_code: Column) -> Column:
    """Why a stock cannot be tied to one company, null when it can.

    ``listed`` counts listing rows of the stock; null stands for an empty listing.
    """
    return (
        F.when(listed.isNull(), "listing_empty")
        .when(listed != 1, "listing_not_unique")
        .when(company.isNull(), "company_missing")
        .when(~F.coalesce(corp_code.rlike(r"^\d{8}$"), F.lit(False)), "corp_code_invalid")
    )


def match_company(stocks: DataFrame, companies: DataFrame, listing: DataFrame) -> DataFrame:
    """``(stock, corp_code, company_name, marcap, listing_rows, reason)`` for each given stock."""
    rows = listing.groupBy(F.col("code").alias("stock")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("marcap").alias("marcap")
    )
    any_rows = listing.limit(1).agg(F.count(F.lit(1))).scalar()
    named = companies.select("stock", "corp_code", F.col("name").alias("company_name"), F.lit(True).alias("_company"))
    listed = F.when(any_rows > 0, F.coalesce("_n", F.lit(0)))
    return (
        stocks.select("stock").distinct().join(rows, "stock", "left").join(named, "stock", "left")
        .select(
            "stock", "corp_code", "company_name", "marcap",
            F.coalesce("_n", F.lit(0)).alias("listing_rows"),
            company_reason(listed, F.col("_company"), F.col("corp_code")).alias("reason"),
        )
    )


def summarize_statements(metrics: DataFrame, matches: DataFrame) -> DataFrame:
    """Metrics per filing with the company check and the earnings yield.

    The yield needs a matched company and a positive market cap.
    """
    joined = metrics.withColumnRenamed("reason", "_metric").join(
        matches.withColumnRenamed("reason", "_match"), "stock", "left"
    )
    other = F.col("min_corp").isNotNull() & ~F.coalesce(
        (F.col("min_corp") == F.col("corp_code")) & (F.col("max_corp") == F.col("corp_code")), F.lit(False)
    )
    account_status = F.coalesce(F.when(other, "issuer_mismatch"), F.col("_metric"))
    usable = account_status.isNull()
    cap_ok = F.coalesce((F.col("marcap") > 0) & (F.col("marcap") < float("inf")), F.lit(False))
    matched = F.col("_match").isNull()
    return joined.select(
        *FILING,
        F.coalesce("company_name", "stock").alias("company_name"),
        F.coalesce("_match", F.lit("matched")).alias("company_status"),
        F.when(usable, F.col("profit")).alias("profit"),
        F.when(usable, F.col("equity")).alias("equity"),
        F.when(usable, F.col("previous_equity")).alias("previous_equity"),
        F.when(usable, F.col("roe")).alias("roe"),
        F.when(usable & matched & cap_ok, F.col("profit").cast("double") / F.col("marcap") * 100).alias("earnings_yield"),
        account_status.alias("account_status"),
        F.coalesce(
            F.col("_match"),
            F.when(~usable, "accounts_unchecked").when(cap_ok, "reference_value").otherwise("market_cap_invalid"),
        ).alias("value_status"),
    )


def select_filings(statements: DataFrame, signals: DataFrame | cal.DateList) -> DataFrame:
    """The filing to use per stock and signal date: filed by then, best by year, consolidated, date, receipt.

    Filings are first reduced to the best per stock and first signal that sees them;
    the running best over those (at most one row per signal) then serves the signals up to the next change.
    """
    best = F.struct(
        F.col("year"), (F.col("basis") == "CFS").cast("int").alias("consolidated"), F.col("filed_at"),
        F.col("receipt"), F.col("basis"),
    )
    dates = cal.DateList.of(signals, "signal_date")
    seen = (
        dates.with_next_no(statements, F.col("filed_at"), "_no")
        .filter(F.col("_no") <= dates.count)
        .groupBy("stock", "_no")
        .agg(F.max(best).alias("_best"))
    )
    upto = Window.partitionBy("stock").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    running_best = seen.withColumn("_best", F.max("_best").over(upto)).withColumnRenamed("_no", "_from_no")
    return dates.carry_forward(running_best, ["stock"], "_from_no", "signal_date").select(
        F.col("stock").alias("code"), "signal_date", "_best.year", "_best.basis", "_best.receipt", "_best.filed_at"
    )


def visible_filings(statements: DataFrame, as_of: str) -> DataFrame:
    """All filings filed by a date."""
    return statements.filter(F.col("filed_at") <= F.lit(as_of).cast("date"))


def statement_coverage(statements: DataFrame, year: int | None = None) -> DataFrame:
    """CFS per stock and year when any consolidated filing exists, else OFS."""
    rows = statements if year is None else statements.filter(F.col("year") == year)
    return rows.groupBy("stock", "year").agg(
        F.when(F.bool_or(F.col("basis") == "CFS"), "CFS").otherwise("OFS").alias("basis")
    )


def pending_statements(candidates: DataFrame, statements: DataFrame, year: int) -> DataFrame:
    """Candidates without any filing for the year."""
    return candidates.select(F.col("code").alias("stock")).distinct().join(
        statement_coverage(statements, year), "stock", "left_anti"
    )
