"""Identity intervals, bitemporal decisions and the ordered helpers on hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from knownat.functions.hashing import table_fingerprint
from knownat.functions.ordered import running
from knownat.operators import histories as hi
from knownat.operators import investability as iv
from knownat.operators import lifecycle as lc
from knownat.operators import quality as qu

D = dt.date
ROWS = ("dataset string, raw_version_id long, source_row_number long, standard_code string, short_code string, name string, market string,"
        "stock_type string, listing_date date, last_trading_date date, delisting_date date, issuer_reference string, event_type string,"
        "effective_date date, previous_code string, previous_name string, previous_market string, successor_standard_code string")


def row(code, short, effective, event="listing", n=1, listed=D(2020, 1, 2), out=None, name="A", kind="보통주", market="KOSPI"):
    return ("security_master", 1, n, code, short, name, market, kind, listed, None, out, "I1", event, effective, None, None, None, None)


def test_reused_code_does_not_overlap_but_early_reuse_does(spark):
    first = row("KR1", "000001", D(2020, 1, 2), out=D(2022, 5, 1))
    after = row("KR2", "000001", D(2022, 5, 1), listed=D(2022, 5, 1), n=2)
    early = row("KR3", "000001", D(2022, 4, 30), listed=D(2022, 4, 30), n=3, out=D(2022, 5, 1))
    model = lc.build_model(spark.createDataFrame([first, after], ROWS))
    assert model.findings.count() == 0
    clash = lc.build_model(spark.createDataFrame([first, after, early], ROWS)).findings.collect()
    assert [(f["rule_id"], f["date"]) for f in clash] == [("overlapping_code", D(2022, 4, 30))]


def test_same_day_changes_keep_the_last_and_delisting_closes(spark):
    rows = [row("KR1", "000001", D(2020, 1, 2)), row("KR1", "000001", D(2021, 3, 1), "name_change", 2, name="B"),
            row("KR1", "000001", D(2021, 3, 1), "name_change", 3, name="C"),
            row("KR1", "000001", D(2022, 1, 1), "delisting", 4, out=D(2022, 1, 1))]
    model = lc.build_model(spark.createDataFrame(rows, ROWS).repartition(3))
    got = [(r["name"], r["valid_from"], r["valid_to"]) for r in model.intervals.orderBy("valid_from").collect()]
    assert got == [("A", D(2020, 1, 2), D(2021, 3, 1)), ("C", D(2021, 3, 1), D(2022, 1, 1))]
    dates = spark.createDataFrame([(D(2020, 1, 1),), (D(2021, 3, 1),), (D(2022, 1, 1),)], "date date")
    assert [(r["date"], r["name"]) for r in lc.listed_on(model.intervals, dates).collect()] == [(D(2021, 3, 1), "C")]


STATUS = ("dataset string, requested_date date, raw_version_id long, source_row_number long, observed_at timestamp, standard_code string,"
          "short_code string, market string, security_kind string, management_designation boolean, trading_suspension boolean,"
          "liquidation_trading boolean, effective_date date, published_at timestamp")


def status(day, n, halted=False, published=None, version=None, effective=None):
    return ("daily_status", day, version or day.day, n, dt.datetime(2025, 1, 1), "KR1", "000001", "KOSPI", "common", False, halted, False,
            effective or day, published)


def decisions(spark, rows, stamps, sessions=(6, 7, 8, 9)):
    intervals = lc.build_model(spark.createDataFrame([row("KR1", "000001", D(2020, 1, 2))], ROWS)).intervals
    days = spark.createDataFrame([(D(2025, 1, d),) for d in sessions], "session_date date")
    model = iv.build_model(spark.createDataFrame(rows, STATUS), intervals, days)
    sid = intervals.first()["security_id"]
    asked = spark.createDataFrame([(sid, s) for s in stamps], "security_id string, as_of timestamp")
    return {r["as_of"]: (r["state"], tuple(r["reason_codes"])) for r in iv.decide(model, asked).collect()}


def utc(day, hour, minute=0):
    return dt.datetime(2025, 1, day, hour, minute)


def test_late_release_leaves_the_restriction_in_force(spark):
    rows = [status(D(2025, 1, 6), 1, True, utc(6, 0)), status(D(2025, 1, 7), 2, False, utc(7, 8))]
    got = decisions(spark, rows, [utc(7, 6, 30), utc(7, 8)])
    assert got[utc(7, 6, 30)] == ("ineligible", ("trading_suspension",))
    assert got[utc(7, 8)] == ("eligible", ())


def test_date_only_evidence_is_known_next_session(spark):
    got = decisions(spark, [status(D(2025, 1, 6), 1), status(D(2025, 1, 7), 2)], [utc(6, 6), utc(6, 15), utc(7, 6)])
    assert got[utc(6, 6)] == ("unknown", ("evidence_not_yet_known",))
    assert got[utc(6, 15)][0] == "eligible" and got[utc(7, 6)][0] == "eligible"


def test_missing_middle_day_and_contradiction(spark):
    rows = [status(D(2025, 1, 6), 1, published=utc(6, 0)), status(D(2025, 1, 8), 2, published=utc(8, 9)),
            status(D(2025, 1, 8), 3, True, utc(8, 9))]
    got = decisions(spark, rows, [utc(7, 5), utc(8, 6), utc(8, 10)])
    assert got[utc(7, 5)] == ("unknown", ("missing_daily_coverage",))
    assert got[utc(8, 6)] == ("unknown", ("evidence_not_yet_known",))
    assert got[utc(8, 10)] == ("unknown", ("contradictory_assertions",))


def test_running_values_equal_a_plain_scan_on_a_hot_key(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.8 else "cold", i, rnd.choice([None, rnd.randint(0, 99)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    for inclusive in (True, False):
        got = running(df, ["k"], F.floor(F.col("t") / 37), ["t"], {"last": ("last", F.col("v")), "top": ("max", F.col("v"))}, inclusive=inclusive)
        seen = {}
        expected = {}
        for k, t, v in rows:
            past = seen.setdefault(k, [])
            if inclusive:
                past.append(v)
            known = [x for x in past if x is not None]
            expected[(k, t)] = (known[-1] if known else None, max(known) if known else None)
            if not inclusive:
                past.append(v)
        assert {(r["k"], r["t"]): (r["last"], r["top"]) for r in got.collect()} == expected


def test_fingerprint_ignores_order_and_sees_values_and_copies(spark):
    rows = [("a", 1.0, None), ("b", 2.0, "x"), ("b", 2.0, "x")]
    schema = "k string, v double, t string"
    base = spark.createDataFrame(rows, schema)

    def of(df):
        return table_fingerprint(df).first()["fingerprint"]

    assert of(base) == of(spark.createDataFrame(rows[::-1], schema).select("t", "v", "k").repartition(3))
    assert of(base) != of(spark.createDataFrame(rows[:2], schema))
    assert of(base) != of(spark.createDataFrame([("a", 1.0, ""), *rows[1:]], schema))


def test_only_promoted_days_form_history(spark):
    rows = [(D(2025, 1, 1) + dt.timedelta(i), 100, 1000.0) for i in range(20)]
    rows += [(D(2025, 1, 21), 100, 2000.0), (D(2025, 1, 22), 100, 1100.0), (D(2025, 1, 23), 80, 1100.0), (D(2025, 1, 24), 109, 1100.0)]
    days = spark.createDataFrame(rows, "trade_date date, row_count long, total_marcap double").selectExpr(
        "*", "0L AS hard_errors", "false AS changed", "false AS empty", "1 AS attempts", "cast(null AS string) AS evidence")
    got = {r["trade_date"].day: r["state"] for r in qu.resolve_day_states(days).collect()}
    assert got[21] == "quarantined" and got[22] == "promoted" and got[23] == "quarantined" and got[24] == "promoted"


def test_halt_states(spark):
    halts = spark.createDataFrame([("000001", D(2025, 1, 6), D(2025, 1, 8)), ("000001", D(2025, 1, 10), None)],
                                  "code string, halt_date date, resume_date date")
    asked = spark.createDataFrame([("000001", D(2025, 1, d)) for d in (5, 6, 7, 8, 9, 10, 11)], "code string, date date")
    got = {r["date"].day: r["state"] for r in hi.halt_state(halts, asked).collect()}
    assert got == {5: "unknown", 6: "suspended", 7: "suspended", 8: "resumption_event", 9: "unknown", 10: "suspended", 11: "unknown"}
