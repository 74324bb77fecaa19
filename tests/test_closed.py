"""Inputs that must not slip through: late news, repeated landings, values that are no numbers."""

import datetime as dt

from pyspark.sql import functions as F
from test_identity import ROWS, STATUS, row, status

from knownat.functions.hashing import model_fingerprint, table_fingerprint
from knownat.functions.text import number
from knownat.operators import investability as iv
from knownat.operators import lifecycle as lc
from knownat.operators import ranking as rk
from knownat.operators import splits as sp
from knownat.operators import valuation as va
from knownat.schemas import Policy

D = dt.date


def test_fingerprints_see_every_digit_and_no_separator(spark):
    def of(value, text="a"):
        return table_fingerprint(spark.createDataFrame([(value, text)], "v double, t string")).first()["fingerprint"]

    assert len({of(123456789012.0), of(123456789013.0), of(0.1), of(0.1 + 2 ** -55), of(None)}) == 5
    assert of(0.0) == of(-0.0) and of(float("nan")) == of(None)
    two = [spark.createDataFrame([(a, b)], "a string, b string") for a, b in (("x\u001fb=1:y", "z"), ("x", "y\u001fb=1:z"))]
    assert len({table_fingerprint(t).first()["fingerprint"] for t in two}) == 2
    rows = spark.range(2).toDF("id")
    assert model_fingerprint({"a": rows}).first() != model_fingerprint({"a": rows, "b": rows.filter("false")}).first()


def test_numbers_are_finite(spark):
    texts = spark.createDataFrame([("1,000.5",), ("NaN",), ("Infinity",), ("-inf",), ("x",), (None,)], "t string")
    assert [r[0] for r in texts.select(number(F.col("t"))).collect()] == [1000.5, None, None, None, None, None]


def test_a_split_counts_from_its_publication(spark):
    bars = spark.createDataFrame([("000001", D(2025, 1, d), c) for d, c in ((2, 100.0), (3, 100.0), (6, 50.0), (7, 50.0), (8, 50.0))],
                                 "code string, trade_date date, close double")
    signals = spark.createDataFrame([(D(2025, 1, d),) for d in (3, 6, 7, 8)], "signal_date date")
    event = [("000001", D(2025, 1, 6), 2.0, "2025-01-07T15:30:00+09:00")]
    splits = spark.createDataFrame(event, "code string, effective_date date, ratio double, published_at string")
    found = {r["signal_date"].day: (r["price"], r["momentum"], r["reason"]) for r in rk.price_factors(bars, signals, 2, splits).collect()}
    assert found == {3: (100.0, 0.0, None), 6: (None, None, "split_not_public"), 7: (50.0, 0.0, None), 8: (50.0, 0.0, None)}
    unreadable = splits.withColumn("published_at", F.lit("soon"))
    assert [r["reason"] for r in rk.price_factors(bars, signals, 2, unreadable).orderBy("signal_date").collect()] == [
        None, "split_not_public", "split_not_public", "split_not_public"]


def status_model(spark, rows, schema=STATUS):
    intervals = lc.build_model(spark.createDataFrame([row("KR1", "000001", D(2020, 1, 2))], ROWS)).intervals
    days = spark.createDataFrame([(D(2025, 1, d),) for d in (6, 7, 8)], "session_date date")
    return iv.build_model(spark.createDataFrame(rows, schema), intervals, days)


def test_publication_text_without_offset_is_seoul_time(spark):
    texts = ["2025-01-06 15:00:00", "2025-01-06T15:00:00+00:00", "soon", "", None]
    rows = [(*status(D(2025, 1, 6), n)[:-1], text) for n, text in enumerate(texts)]
    model = status_model(spark, rows, STATUS.replace("published_at timestamp", "published_at string"))
    known = {r["source_row_number"]: r["t"] for r in model.assertions.select(
        "source_row_number", F.date_format("known_at", "dd HH:mm").alias("t")).collect()}
    assert known == {0: "06 06:00", 1: "06 15:00", 2: None, 3: "06 15:00", 4: "06 15:00"}
    assert [r["observed"] for r in model.findings.filter("rule_id = 'bad_published_at'").collect()] == ["soon"]


def test_rows_clash_only_in_flags_of_the_policy(spark):
    early = dt.datetime(2025, 1, 6, 1)
    model = status_model(spark, [status(D(2025, 1, 6), 1, published=early), status(D(2025, 1, 6), 2, halted=True, published=early)])
    asked = spark.createDataFrame([(model.lifecycle.first()["security_id"], dt.datetime(2025, 1, 6, 6))], "security_id string, as_of timestamp")
    strict = iv.decide(model, asked).first()
    assert (strict["state"], strict["reason_codes"]) == ("unknown", ["contradictory_assertions"])
    assert iv.decide(model, asked, Policy(blocking_flags=("management_designation",))).first()["state"] == "eligible"


def test_positions_without_quantity_are_findings(spark):
    events = spark.createDataFrame([("1", D(2025, 1, 6), dt.datetime(2025, 1, 1), 2.0, "s")],
                                   "code string, effective_date date, published_at timestamp, ratio double, source_fingerprint string")
    held = spark.createDataFrame([("p", "1", D(2025, 1, 6), None), ("q", "1", D(2025, 1, 6), 3.0)],
                                 "portfolio string, code string, effective_date date, quantity double")
    good, bad = sp.convert_positions(held, events)
    assert [r["portfolio"] for r in good.collect()] == ["q"]
    assert [(r["portfolio"], r["rule_id"]) for r in bad.collect()] == [("p", "bad_quantity")]


def test_unsound_values_give_no_result(spark):
    nav = spark.createDataFrame([("a", D(2025, 1, 6), 1.0), ("a", D(2025, 1, 6), 2.0), ("b", D(2025, 1, 6), None), ("c", D(2025, 1, 6), 5.0)],
                                "portfolio string, date date, equity double")
    index = spark.createDataFrame([("KOSPI", D(2025, 1, 6), 10.0)], "symbol string, trade_date date, close double")
    assert [r["portfolio"] for r in va.compare(nav, nav.filter("portfolio = 'c'").select("date", "equity"), index).collect()] == ["c"]
    books = nav.filter("portfolio <> 'a'").selectExpr("portfolio", "date", "5.0D cash", "0.0D positions_value", "equity", "0.0D cash_change")
    assert [(r["subject"], r["rule_id"]) for r in va.reconcile_nav(books).collect()] == [("b", "value_missing")]


def test_an_index_needs_a_price_of_every_name(spark):
    days = [D(2025, 1, d) for d in (3, 6, 7, 8)]
    schedule = spark.createDataFrame([(D(2025, 1, 3), D(2025, 1, 6))], "signal_date date, execution_date date")
    universe = spark.createDataFrame([(D(2025, 1, 3), c) for c in "ab"], "signal_date date, code string")
    rows = [("a", days[1], 10.0, 20.0), ("b", days[1], 10.0, None), ("a", days[2], 10.0, 20.0), ("b", days[2], 10.0, 30.0), ("a", days[3], 10.0, 20.0)]
    bars = spark.createDataFrame(rows, "code string, trade_date date, open double, close double")
    sessions = spark.createDataFrame([(d,) for d in days], "session_date date")

    def values(more=()):
        own = bars.unionByName(spark.createDataFrame(list(more), bars.schema))
        index, _ = va.equal_weight_index(universe, own, schedule, sessions, 100.0, "2025-01-01")
        return {r["date"].day: r["equity"] for r in index.collect()}

    assert values() == {1: 100.0, 7: 250.0, 8: 250.0}
    assert values([("b", D(2025, 1, 2), 1.0, 40.0)]) == {1: 100.0, 6: 300.0, 7: 250.0, 8: 250.0}


def test_runs_convert_at_splits_and_stop_at_unsound_days(spark):
    """Three weeks of one name a run: a split inside a week, a late one, one without a bar, a week left out, an open that lacks."""
    days = [D(2025, 1, d) for d in (3, 6, 7, 8, 10, 13, 14, 17, 20, 21)]
    weeks = [(days[0], days[1]), (days[4], days[5]), (days[7], days[8])]
    schedule = spark.createDataFrame(weeks, "signal_date date, execution_date date")
    sessions = spark.createDataFrame([(d,) for d in days], "session_date date")
    held = [(p, week[0], p[0]) for p in ("a", "b", "c", "d", "e") for week in weeks] + [("a out", weeks[0][0], "a"), ("a out", weeks[2][0], "a")]
    universe = spark.createDataFrame(held, "portfolio string, signal_date date, code string")
    # A split of two on the 7th halves prices; the 8th has no bar, and d has none on the day of its split.
    rows = [(c, d, 10.0 if d < days[2] else 5.0, 12.0 if d < days[2] else 6.0) for c in "abcde" for d in days
            if d != days[3] and (c, d) != ("d", days[2]) and (c, d) != ("e", days[5])]
    bars = spark.createDataFrame(rows, "code string, trade_date date, open double, close double")
    public = {"a": 1, "b": 7, "d": 1, "e": 1}
    splits = spark.createDataFrame([(c, days[2], dt.datetime(2025, 1, n, 1), 2.0) for c, n in public.items()],
                                   "code string, effective_date date, published_at timestamp, ratio double")
    index, blocked = va.equal_weight_runs(universe, bars, schedule, sessions, 100.0, splits)
    found = {}
    for row in index.orderBy("portfolio", "date").collect():
        found.setdefault(row["portfolio"], {})[row["date"].day] = round(row["equity"], 9)
    assert found["a"] == {d.day: 120.0 for d in days[1:]}
    assert found["a out"] == {d.day: 120.0 for d in days[1:5]}
    assert found["b"] == {6: 120.0} and found["d"] == {6: 120.0}
    # Without an event the fall of the price is a loss, which the next weeks carry on.
    assert found["c"] == {6: 120.0} | {d.day: 60.0 for d in days[2:]}
    assert found["e"] == {d.day: 120.0 for d in days[1:5]}
    reasons = {(r["portfolio"], r["signal_date"].day): (r["missing_opens"], r["bad_splits"], r["left_out"]) for r in blocked.collect()}
    assert reasons == {("a out", 17): (0, 0, True), ("b", 3): (0, 1, False), ("d", 3): (0, 1, False), ("e", 3): (1, 0, False),
                       ("e", 10): (1, 0, False)}


def test_no_close_is_carried_across_a_split(spark):
    days = [D(2025, 1, d) for d in (3, 6, 7, 8)]
    schedule = spark.createDataFrame([(days[0], days[1])], "signal_date date, execution_date date")
    sessions = spark.createDataFrame([(d,) for d in days], "session_date date")
    universe = spark.createDataFrame([("p", days[0], "a")], "portfolio string, signal_date date, code string")
    bars = spark.createDataFrame([("a", days[0], 10.0, 10.0), ("a", days[1], 5.0, None), ("a", days[2], 5.0, 6.0)],
                                 "code string, trade_date date, open double, close double")
    split = spark.createDataFrame([("a", days[1], dt.datetime(2025, 1, 2), 2.0)],
                                  "code string, effective_date date, published_at timestamp, ratio double")
    # The split is on the day of entry: what is bought then is in new units already, only the old close is stale.
    index, blocked = va.equal_weight_runs(universe, bars, schedule, sessions, 100.0, split)
    assert {r["date"].day: r["equity"] for r in index.collect()} == {7: 120.0, 8: 120.0} and blocked.count() == 0
    empty = va.equal_weight_runs(universe.limit(0), bars.limit(0), schedule, sessions, 100.0, split.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0
