"""Work that must not grow beyond its input: inputs read once, amounts parsed once, prices of held names only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knownat import session
from knownat.functions import calendar as cal
from knownat.operators import fundamentals as fu
from knownat.operators import ranking as rk
from knownat.operators import valuation as va
from knownat.plans import weekly
from knownat.schemas import RankingRules
from workload import fixtures
from workload.registry import Inputs, spark_text

D = dt.date


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def statement_tables(spark, folder):
    """Orders and lines that meet every case of the account rows, with null and repeated rows among them."""
    keys = [0, 2, 5, 37 * 2 + 5, 41, 43, 47 * 2, 53, 59, 61, 106, None]
    orders = [(k, float(1000 + (k or 0)) if k != 5 else None, dt.datetime(1996, 1, 1 + i), "1-URGENT" if i % 2 else "5-LOW")
              for i, k in enumerate(keys)]
    lines = [(k, s, 100.5 * (i + 1), 0.05 if s != 3 else None) for i, k in enumerate(keys) for s in (1, 2, 3, None)]
    spark.createDataFrame(orders + orders[:2], "o_orderkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(
        f"{folder}/orders.parquet")
    spark.createDataFrame(lines + lines[:3], "l_orderkey long, l_suppkey long, l_extendedprice double, l_discount double").write.parquet(
        f"{folder}/lineitem.parquet")


def test_account_rows_come_from_one_pass(spark, tmp_path):
    statement_tables(spark, str(tmp_path))
    found = Inputs(spark, str(tmp_path)).statement_accounts
    parts = [f"{base} AS (SELECT * FROM parquet.`{tmp_path}/{base}.parquet`)" for base in ("orders", "lineitem")]
    common = spark.sql(spark_text("WITH " + ", ".join(parts + fixtures.ctes(["statement_accounts"])) + " SELECT * FROM statement_accounts"))
    assert found.dtypes == common.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, common.collect()))
    assert found.count() > 60
    assert plan(found).count("l_extendedprice#") < plan(common).count("l_extendedprice#")
    assert plan(found).count("Relation [") == 2


def test_amounts_are_parsed_before_the_aggregation(spark):
    rows = [("a", 2024, "OFS", "r", "ifrs_ProfitLoss", "IS", "5", None, "KRW", "00000001"),
            ("a", 2024, "OFS", "r", "ifrs_Equity", "BS", "40", "60", "KRW", "00000001")]
    accounts = spark.createDataFrame(rows, "stock string, year int, basis string, receipt string, account_id string, sj_div string, "
                                           "thstrm_amount string, frmtrm_amount string, currency string, corp_code string")
    for found in (fu.statement_metrics(accounts), fu.pick_account(accounts, "equity", fu.EQUITY, fu.EQUITY_SECTIONS, ["thstrm_amount"])):
        aggregates = [line for line in plan(found).splitlines() if "Aggregate [" in line]
        assert aggregates and not any("regexp_extract" in line for line in aggregates)
    assert fu.statement_metrics(accounts).first()["roe"] == pytest.approx(10.0)


def test_only_held_names_are_priced(spark, monkeypatch):
    days = [D(2024, 1, d) for d in range(1, 13)]
    sessions = spark.createDataFrame([(d,) for d in days], "session_date date")
    schedule = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 2)), (D(2024, 1, 8), D(2024, 1, 9))], "signal_date date, execution_date date")
    universe = spark.createDataFrame([("p", D(2024, 1, 1), "a"), ("p", D(2024, 1, 8), "a")], "portfolio string, signal_date date, code string")
    bars = spark.createDataFrame([(c, d, 10.0, 10.0 + i) for c in "abc" for i, d in enumerate(days)],
                                 "code string, trade_date date, open double, close double")
    seen, price = [], va.price_states

    def priced(given, splits, dates):
        seen.append({r["code"] for r in given.select("code").distinct().collect()})
        return price(given, splits, dates)

    monkeypatch.setattr(va, "price_states", priced)
    index, _ = va.equal_weight_runs(universe, bars, schedule, sessions, 100.0)
    assert seen == [{"a"}]
    assert index.filter(F.col("date") == D(2024, 1, 3)).first()["equity"] == pytest.approx(120.0)


def test_positions_sort_a_series_once(spark):
    trades = spark.createDataFrame(
        [("p", "a", D(2024, 1, 1), "buy", 10.0), ("p", "a", D(2024, 1, 3), "sell", 5.0), ("p", "a", D(2024, 1, 3), "buy", 1.0),
         ("p", "a", D(2024, 1, 5), "sell", 16.0), ("p", "b", None, "buy", 2.0), (None, "a", D(2024, 1, 2), "buy", 1.0)],
        "portfolio string, code string, trade_date date, side string, quantity double")
    splits = spark.createDataFrame(
        [("a", D(2024, 1, 3), 2.0), ("a", D(2024, 1, 3), 0.5), ("a", D(2024, 1, 4), 2.0), ("a", D(2024, 1, 4), None), ("a", D(2024, 1, 1), 9.0),
         ("b", D(2024, 1, 4), 2.0), (None, D(2024, 1, 4), 2.0)], "code string, effective_date date, ratio double")
    held = va.positions(trades, splits)
    assert sorted(map(str, map(tuple, held.collect()))) == sorted(map(str, [
        ("p", "a", D(2024, 1, 1), D(2024, 1, 3), 10.0), ("p", "a", D(2024, 1, 3), D(2024, 1, 4), 6.0),
        ("p", "a", D(2024, 1, 4), D(2024, 1, 5), 12.0), ("p", "a", D(2024, 1, 5), None, -4.0), ("p", "b", None, None, 2.0),
        (None, "a", D(2024, 1, 2), D(2024, 1, 3), 1.0), (None, "a", D(2024, 1, 3), D(2024, 1, 4), 1.0),
        (None, "a", D(2024, 1, 4), None, 2.0)]))
    alone = va.positions(trades)
    assert plan(alone).count("Aggregate [") == 1 and plan(alone).count("lead(") == 1
    assert alone._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2
    physical = alone._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Sort [") == 1


def test_shuffles_are_cut_by_size(spark, tmp_path):
    kept = {key: spark.conf.get(key, None) for key in session.SIZED}
    first, second = session.SIZED
    try:
        for key in session.SIZED:
            spark.conf.unset(key)
        spark.conf.set(second, "5m")
        Inputs(spark, str(tmp_path))
        assert spark.conf.get(first) == session.SIZED[first] and spark.conf.get(second) == "5m"
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_generated_methods_stay_compiled(spark, tmp_path):
    (key, value), = session.COMPILED.items()
    given = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        Inputs(spark, str(tmp_path))
        assert spark.conf.get(key) == value
        spark.conf.set(key, "9000")
        Inputs(spark, str(tmp_path))
        assert spark.conf.get(key) == "9000"
    finally:
        spark.conf.unset(key) if given is None else spark.conf.set(key, given)


def test_filings_are_dealt_to_many_tasks(spark, tmp_path):
    statement_tables(spark, str(tmp_path))
    signals = spark.createDataFrame([(D(1996, 1, 6),), (D(1996, 1, 13),)], "signal_date date")
    given = {key: spark.conf.get(key, None) for key in session.SIZED}
    try:
        for key in session.SIZED:
            spark.conf.unset(key)
        chosen = fu.select_filings(Inputs(spark, str(tmp_path)).statements, signals)
        exchanges = [line for line in chosen._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line]
        assert exchanges and all(", 1024)" in line for line in exchanges)
        assert chosen.count() > 0
    finally:
        for key, value in given.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_holdings_meet_prices_before_they_become_days(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(60)]
    sessions = cal.numbered(spark.createDataFrame([(d,) for d in days if d.day % 7], "d date"), "d")
    listed = [r["session_date"] for r in sessions.orderBy("session_date").collect()]
    holdings = [("p", "a", days[2], days[40], 3.0), ("p", "a", days[10], None, 5.0), ("p", "a", days[10], None, 5.0), ("q", "b", days[0], days[59], 2.0),
                ("q", "none", days[5], days[9], 1.0), ("q", None, days[5], days[7], 1.0), (None, "a", days[5], days[20], 1.0),
                ("p", "b", days[6], days[6], 9.0), ("p", "b", None, days[6], 9.0)]
    bars = [("a", days[0] - dt.timedelta(9), 7.0), ("a", days[6], 11.0), ("a", days[8], float("nan")), ("a", days[30], 13.0), ("a", days[31], 14.0),
            ("b", days[20], 2.0), ("b", None, 5.0), (None, days[3], 5.0), ("b", days[58], None)]
    splits = [("a", days[25]), ("a", days[25]), ("b", days[12]), ("b", days[40]), ("b", None), (None, days[1])]
    cash = [("p", days[0], None, 100.0, 100.0, 0.0), ("q", days[1], None, 50.0, 50.0, 1.0)]
    held = spark.createDataFrame(holdings, "portfolio string, code string, from_date date, to_date date, quantity double")
    nav, missing = va.value_positions(
        held, spark.createDataFrame(cash, "portfolio string, from_date date, to_date date, cash double, cash_change double, external_flow double"),
        spark.createDataFrame(bars, "code string, trade_date date, close double"), sessions,
        spark.createDataFrame(splits, "code string, effective_date date"))

    def close_on(code, day):
        seen = [(d, x) for c, d, x in bars if c == code and c and d and d <= day and x is not None and x == x]
        cut = [d for c, d in splits if c == code and c and d and d <= day]
        if not seen or (cut and max(seen)[0] < max(cut)):
            return None
        return max(seen)

    expected, unpriced = {}, []
    for portfolio, begin in (("p", days[0]), ("q", days[1]), (None, days[0])):
        for day in listed:
            own = [(c, q, close_on(c, day)) for p, c, a, b, q in holdings if p == portfolio and a and a <= day and (b is None or day < b)]
            unpriced += [(c, day, portfolio) for c, _, close in own if close is None]
            if portfolio and day >= begin and all(close for _, _, close in own):
                expected[portfolio, day] = (sum(q * close[1] for _, q, close in own), sum(close[0] < day for _, _, close in own))
    assert {(r["portfolio"], r["date"]): (r["positions_value"], r["carried_prices"]) for r in nav.collect()} == expected
    assert sorted(map(str, unpriced)) == sorted(str((r["subject"], r["date"], r["observed"])) for r in missing.collect())
    # Before, every holding became days first, and the days were joined with a close per code and day.
    joins = [line for line in plan(nav).splitlines() if "Join LeftOuter" in line and "code#" in line]
    assert len(joins) == 1 and "_block#" in joins[0]


RULES = RankingRules(limit=1, history=3, minimum_ready=1)


def small_desk(spark, with_filings=True):
    """Two weeks of two names; the larger one, 000001, is the only candidate and files twice, the first time seen by no week."""
    days = [D(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15)]
    weeks, codes = [D(2024, 1, 5), D(2024, 1, 12)], ["000001", "000002"]
    listing = [(w, c, f"name {c}", "KOSPI", "s", 9e12 / int(c), 5e9) for w in weeks for c in codes]
    bars = [(c, d, 100.0 + i * int(c)) for c in codes for i, d in enumerate(days)]
    filings = [(c, 2023, "OFS", f"{n}{c}", D(2024, 1, 2 + n)) for c in codes for n in (0, 1)] if with_filings else []
    accounts = [(c, y, b, r, f"0000000{c[-1]}", account, section, "40", "60", "KRW") for c, y, b, r, _ in filings
                for account, section in (("ifrs_ProfitLoss", "IS"), ("ifrs_Equity", "BS"))]
    frame = spark.createDataFrame
    return weekly.Desk(
        sessions=cal.numbered(frame([(d,) for d in days], "d date"), "d"),
        snapshots=frame(listing, "signal_date date, code string, name string, market string, sector string, marcap double, amount double"),
        bars=frame(bars, "code string, trade_date date, close double"),
        statements=frame(filings, "stock string, year int, basis string, receipt string, filed_at date"),
        accounts=frame(accounts, "stock string, year int, basis string, receipt string, corp_code string, account_id string, "
                                 "sj_div string, thstrm_amount string, frmtrm_amount string, currency string"),
        companies=frame([(c, f"0000000{c[-1]}") for c in codes], "stock string, corp_code string"))


def test_only_candidates_and_their_filings_are_read(spark, monkeypatch):
    met = {}
    for module, name, column in ((rk, "price_factors", "code"), (fu, "select_filings", "stock"), (fu, "statement_metrics", "receipt")):
        def watched(rows, *rest, name=name, column=column, own=getattr(module, name)):
            met[name] = {row[0] for row in rows.select(column).distinct().collect()}
            return own(rows, *rest)
        monkeypatch.setattr(module, name, watched)
    ranked, excluded = weekly.rank_weeks(small_desk(spark), RULES)
    assert met == {"price_factors": {"000001"}, "select_filings": {"000001"}, "statement_metrics": {"1000001"}}
    found = {(r["signal_date"], r["code"], r["receipt"], r["rank"]) for r in ranked.collect()}
    assert found == {(w, "000001", "1000001", 1) for w in (D(2024, 1, 5), D(2024, 1, 12))}
    assert excluded.count() == 0


def test_sectors_are_counted_from_candidates_alone(spark, monkeypatch):
    met = []
    own = fu.statement_metrics
    monkeypatch.setattr(fu, "statement_metrics", lambda rows: met.append(rows.select("receipt").distinct().count()) or own(rows))
    ranked, _ = weekly.rank_weeks(small_desk(spark), RULES)
    assert met == [1]
    counted = rk.sector_counts(ranked.filter("rank <= 20"), ["signal_date"]).collect()
    assert sorted(tuple(r) for r in counted) == [(D(2024, 1, 5), "s", 1), (D(2024, 1, 12), "s", 1)]


def test_exclusions_come_from_candidates_alone(spark, monkeypatch):
    met = []
    own = rk.price_factors
    monkeypatch.setattr(rk, "price_factors", lambda rows, *rest: met.append(rows.select("code").distinct().count()) or own(rows, *rest))
    excluded = weekly.rank_weeks(small_desk(spark, with_filings=False), RULES)[1]
    assert met == [1]
    assert {(r["signal_date"], r["code"], r["reason"]) for r in excluded.collect()} == {
        (w, "000001", "no_visible_filing") for w in (D(2024, 1, 5), D(2024, 1, 12))}


def test_readiness_looks_at_tables_only_where_nothing_ranks(spark):
    index = spark.createDataFrame([("KOSPI", D(2024, 1, 2), 1.0)], "symbol string, trade_date date, close double")
    report = weekly.readiness_report(small_desk(spark), index, "2024-01-05", "2024-01-15", RULES)
    # The inputs were read before; none is read again for the report.
    assert "close#" not in plan(report) and "thstrm_amount#" not in plan(report)
    row = report.first()
    assert (row["valid_weeks"], row["invalid_weeks"], row["warmup_start"], row["missing_inputs"]) == (2, 0, D(2024, 1, 2), "index_KOSDAQ")
    row = weekly.readiness_report(small_desk(spark, with_filings=False), index.limit(0), "2024-01-05", "2024-01-15", RULES).first()
    assert (row["valid_weeks"], row["invalid_weeks"], row["missing_inputs"]) == (0, 2, "statements,index_KOSPI,index_KOSDAQ")
