"""Listings and evidence become rows per day only after the last shuffle, with the same rows as day by day."""

import datetime as dt

from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.functions.ordered import running
from knownat.operators import investability as iv
from knownat.operators import lifecycle as lc

D = dt.date
INTERVAL = "security_id string, standard_code string, short_code string, name string, market string, security_kind string, valid_from date, valid_to date"


def day(n):
    return D(2024, 1, n)


def listings(spark):
    return spark.createDataFrame([
        ("s1", "K1", "001", "one", "KOSPI", "common", day(1), day(4)), ("s1", "K1", "001", "uno", "KOSPI", "common", day(4), None),
        ("s2", "K2", "002", "two", "KOSDAQ", "common", day(2), day(5)), ("s3", "K3", "002", "three", "KOSPI", "common", day(3), None),
        (None, None, "009", "none", "KOSPI", "common", day(1), None),
    ], INTERVAL)


def status_model(spark, tmp_path=None):
    rows = [("daily", day(n), 1, 10 * n + k, dt.datetime(2024, 1, n, 2), f"K{k}", f"00{k}", "x", "x", k == 1 and n == 3, False, False,
             day(n), dt.datetime(2024, 1, n, 9 if k == 2 else 5)) for n in (2, 3, 5, 6) for k in (1, 2)]
    status = spark.createDataFrame(rows, """dataset string, requested_date date, raw_version_id long, source_row_number long,
        observed_at timestamp, standard_code string, short_code string, market string, security_kind string, management_designation boolean,
        trading_suspension boolean, liquidation_trading boolean, effective_date date, published_at timestamp""")
    sessions = spark.createDataFrame([(day(n),) for n in range(2, 8)], "session_date date")
    return iv.build_model(status, listings(spark), sessions, tmp_path)


def above_first_explode(df):
    """The operators that take rows from the topmost explode."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    return lines.count("Exchange hashpartitioning")


def test_a_sheet_is_what_deciding_each_listed_day_gives(spark):
    model = status_model(spark)
    stamps = model.sessions.select(F.col("session_date").alias("date"), cal.at_seoul(F.col("session_date"), cal.SIGNAL_TIME).alias("as_of"))
    sheet = iv.decision_sheet(model, stamps)
    assert above_first_explode(sheet) == 0
    carry = ["date", "short_code", "name", "market", "security_kind"]
    single = iv.decide(model, lc.listed_on(model.lifecycle, stamps, "date").join(stamps, "date"), carry=carry)
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(sheet) == shown(single) and sheet.count() == 20
    states = {(r["date"].day, r["security_id"]): r["reason_codes"] for r in sheet.collect()}
    assert states[3, "s1"] == ["management_designation"] and states[2, "s2"] == ["evidence_not_yet_known"]


def test_stamps_of_another_day_are_asked_one_by_one(spark):
    model = status_model(spark)
    late = model.sessions.select(F.col("session_date").alias("date"), cal.at_seoul(F.date_add("session_date", 1), "08:00:00").alias("as_of"))
    assert iv.decision_sheet(model, late).count() == 20


def test_a_kept_model_holds_the_same_rows(spark, tmp_path):
    plain, kept = status_model(spark), status_model(spark, str(tmp_path / "parts"))
    for name, table in plain.tables().items():
        assert sorted(map(repr, table.collect())) == sorted(map(repr, kept.tables()[name].collect())), name


def test_running_cuts_only_hot_keys_and_gives_the_same(spark):
    rows = spark.createDataFrame([(k, n // 3, n, n % 5 if n % 2 else None) for k in ("a", "b", None) for n in range(9 if k != "b" else 3)],
                                 "k string, bucket int, n int, v int")
    values = {"last": ("last", F.col("v")), "top": ("max", F.col("v"))}
    known = rows.filter("k IS NOT NULL")
    whole = sorted(map(repr, running(known, ["k"], F.col("bucket"), ["n"], values).collect()))
    for hot in (1, 5, 100):
        assert sorted(map(repr, running(known, ["k"], F.col("bucket"), ["n"], values, hot_rows=hot).collect())) == whole
    assert "_bucket" not in running(rows, ["k"], F.col("bucket"), ["n"], values, hot_rows=100)._jdf.queryExecution().optimizedPlan().toString()


def test_market_days_are_compared_by_stretches(spark):
    market = spark.createDataFrame([
        (day(2), "001", "one", "KOSPI", 1), (day(5), "001", "one", "KOSPI", 1), (day(4), "002", "three", "KOSDAQ", 1),
        (day(4), "002", "three", "KOSDAQ", None), (day(3), "777", "new", "KOSPI", 1), (day(3), None, "null", "KOSPI", 1),
    ], "trade_date date, code string, name string, market string, raw_version_id long")
    days = spark.createDataFrame([(day(n),) for n in (2, 3, 4, 5)], "trade_date date")
    found = lc.reconcile_market(listings(spark), market, days)
    assert above_first_explode(found) == 0
    told = sorted((r["trade_date"].day, r["code"] or "", r["security_id"] or "", r["rule_id"], r["listed"] or "", r["seen"] or "")
                  for r in found.collect())
    gone = "active_security_missing"
    assert told == sorted([
        (2, "002", "s2", gone, "two/KOSDAQ", ""), (3, "001", "s1", gone, "one/KOSPI", ""), (3, "002", "s3", gone, "three/KOSPI", ""),
        (4, "001", "s1", gone, "uno/KOSPI", ""), (5, "001", "s1", "name_conflict", "uno", "one"), (5, "002", "s3", gone, "three/KOSPI", ""),
        (4, "002", "s3", "market_conflict", "KOSPI", "KOSDAQ"),
        (4, "002", "s3", gone, "three/KOSPI", ""), (3, "777", "", "market_without_lifecycle", "", "new/KOSPI"),
        (3, "", "", "market_without_lifecycle", "", "null/KOSPI"),
    ])
