"""Hand-computed cases of calendar, factors, scores and filings."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.operators import fundamentals as fu
from knownat.operators import ranking as rk
from knownat.schemas import RankingRules, RunConfig, TradingRules

D = dt.date


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_momentum_of_rising_closes(spark):
    span = days(D(2025, 1, 1), 252)
    bars = frame(spark, [("000001", d, 100.0 + i) for i, d in enumerate(span)], "code string, trade_date date, close double")
    signals = frame(spark, [(span[-1],), (span[-2],)], "signal_date date")
    got = {r["signal_date"]: r for r in rk.price_factors(bars, signals).collect()}
    assert got[span[-1]]["momentum"] == pytest.approx(251.0)
    assert got[span[-2]]["reason"] == "short_history" and got[span[-2]]["momentum"] is None


def test_future_bars_change_nothing(spark):
    span = days(D(2025, 1, 1), 30)
    rnd = random.Random(1)
    rows = [("000001", d, 50 + 10 * rnd.random()) for d in span]
    schema = "code string, trade_date date, close double"
    signals = frame(spark, [(span[19],)], "signal_date date")
    before = rk.price_factors(frame(spark, rows[:20], schema), signals, 10).collect()
    after = rk.price_factors(frame(spark, rows, schema).repartition(3), signals, 10).collect()
    assert before == after
    closes = [r[2] for r in rows[10:20]]
    returns = [b / a - 1 for a, b in zip(closes, closes[1:])]
    assert after[0]["volatility"] == pytest.approx(statistics.stdev(returns) * math.sqrt(252) * 100)


def test_last_duplicate_not_positive_removes_the_day(spark):
    bars = frame(
        spark,
        [("000001", D(2025, 1, 1), 5.0, 1), ("000001", D(2025, 1, 1), 0.0, 2), ("000001", D(2025, 1, 2), None, 3),
         ("000001", D(2025, 1, 3), 7.0, 4)],
        "code string, trade_date date, close double, ingest_seq long",
    )
    assert [r["close"] for r in rk.usable_bars(bars).collect()] == [7.0]


def scoring(spark, values, **change):
    rows = [(D(2025, 1, 3), f"{i:06d}", 10000.0, v, v, v, 1.0 + i, 2e11, 2e9, change.get("eligible", {}).get(i, True))
            for i, v in enumerate(values)]
    return frame(spark, rows, "signal_date date, code string, price double, momentum double, value double, quality double,"
                              "volatility double, market_cap double, turnover double, eligible boolean")


def test_ineligible_and_incomplete_rows_are_not_ranked(spark):
    values = [40.0 - i for i in range(40)]
    values[1] = float("nan")
    ranked = rk.score(scoring(spark, values, eligible={0: False})).orderBy("rank").collect()
    assert len(ranked) == 38 and ranked[0]["code"] == "000002" and ranked[0]["score"] == pytest.approx(100.0)


def test_wide_scores_equal_window_scores_with_hot_ties(spark):
    rnd = random.Random(3)
    values = [float(rnd.choice([1, 1, 1, 2, 3, 50, 7])) for _ in range(300)]
    rows = scoring(spark, values)
    names = [f"{f}_score" for f in ("momentum", "value", "quality", "volatility")]
    one = {r["code"]: [r[n] for n in names] for r in rk.score(rows).collect()}
    two = {r["code"]: [r[n] for n in names] for r in rk.score_wide(rows, pieces=8).collect()}
    assert one.keys() == two.keys()
    for code in one:
        assert two[code] == pytest.approx(one[code])


def test_universe_leaves_out_names_and_markets(spark):
    d = D(2025, 1, 3)
    rows = [(d, "000001", "A", "KOSPI", 5e11, 1e10), (d, "000002", "B우", "KOSPI", 9e11, 1e10), (d, "000003", "C", "KOSDAQ", 4e11, 1e10),
            (d, "000004", "D스팩", "KOSDAQ", 4e11, 1e10), (d, "000005", "E", "KONEX", 4e11, 1e10), (d, "00000A", "F", "KOSPI", 4e11, 1e10)]
    snap = frame(spark, rows, "signal_date date, code string, name string, market string, marcap double, amount double")
    assert [r["code"] for r in rk.candidate_universe(snap).orderBy("cap_rank").collect()] == ["000001", "000003"]


def test_week_runs_saturday_to_friday(spark):
    dates = [D(2025, 1, 2), D(2025, 1, 3), D(2025, 1, 6), D(2025, 1, 9), D(2025, 1, 13)]
    sessions = cal.numbered(frame(spark, [(d,) for d in dates], "d date"), "d")
    got = [tuple(r) for r in cal.weekly_schedule(sessions).orderBy("signal_date").collect()]
    assert got == [(dates[1], dates[2]), (dates[3], dates[4])]


def test_filing_is_chosen_as_of_its_own_date(spark):
    rows = [("000001", 2024, "OFS", "1", D(2025, 3, 1)), ("000001", 2024, "CFS", "2", D(2025, 3, 31)),
            ("000001", 2024, "CFS", "3", D(2025, 9, 10)), ("000001", 2023, "CFS", "0", D(2025, 3, 5))]
    filings = frame(spark, rows, "stock string, year int, basis string, receipt string, filed_at date")
    signals = frame(spark, [(D(2025, 2, 1),), (D(2025, 3, 7),), (D(2025, 4, 4),), (D(2025, 9, 9),), (D(2025, 9, 12),)], "signal_date date")
    got = {r["signal_date"]: r["receipt"] for r in fu.select_filings(filings, signals).collect()}
    assert got == {D(2025, 3, 7): "1", D(2025, 4, 4): "2", D(2025, 9, 9): "2", D(2025, 9, 12): "3"}


ACCOUNTS = ("stock string, year int, basis string, receipt string, filed_at date, corp_code string, account_id string,"
            "sj_div string, thstrm_amount string, frmtrm_amount string, currency string")


@pytest.mark.parametrize("profit, equity, expected", [
    (["100"], ("1,000", "600"), None), (["100", "101"], ("1000", "600"), "profit_ambiguous"), ([], ("1000", "600"), "profit_missing"),
    (["100"], ("0", "600"), "equity_not_positive"), (["100"], ("x", "600"), "equity_not_numeric"),
])
def test_statement_metrics(spark, profit, equity, expected):
    head = ("000001", 2024, "OFS", "r", D(2025, 3, 1), "00000001")
    rows = [(*head, "ifrs-full_ProfitLoss", "IS", p, None, "KRW") for p in profit]
    rows.append((*head, "ifrs_Equity", "BS", *equity, "KRW"))
    got = fu.statement_metrics(frame(spark, rows, ACCOUNTS)).first()
    assert got["reason"] == expected
    if expected is None:
        assert got["roe"] == pytest.approx(12.5)


def test_position_sheet_keeps_names_held_without_being_candidates(spark):
    d = D(2025, 1, 3)
    cand = frame(spark, [(d, "000001", "A")], "signal_date date, code string, name string")
    held = frame(spark, [(d, "000009", 3)], "signal_date date, code string, quantity int")
    prices = frame(spark, [("000001", 5.0)], "code string, price double")
    got = {r["code"]: (r["name"], r["price"], r["quantity"]) for r in rk.position_sheet(cand, held, cand, prices).collect()}
    assert got == {"000001": ("A", 5.0, 0), "000009": ("000009", None, 3)}


def test_parameters_are_checked():
    for bad in (lambda: RankingRules(weights={"momentum": 100}), lambda: RankingRules(history=1), lambda: TradingRules(fee=1.0),
                lambda: RunConfig("2025-01-02", "2025-01-01"), lambda: RunConfig("2025-01-01", "2025-01-02", initial_cash=0)):
        with pytest.raises(ValueError):
            bad()
