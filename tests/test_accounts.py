"""Orders, positions and valuation against small cases and a plain Python walk."""

import datetime as dt
import math
import random

import pytest

from knownat.functions.calendar import numbered
from knownat.operators import orders as od
from knownat.operators import splits as sp
from knownat.operators import valuation as va

DAY = dt.date(2025, 1, 3)
RANKED = "signal_date date, code string, name string, rank int, price double"
PRICES = "signal_date date, code string, price double"
ACCOUNT = "account string, signal_date date, cash double"
HELD = "account string, code string, quantity double"


def book(spark, ranked, accounts, held, prices=(), **options):
    return od.rebalance(
        spark.createDataFrame([(a, DAY, c) for a, c in accounts], ACCOUNT), spark.createDataFrame(list(held), HELD),
        spark.createDataFrame([(DAY, c, c, r, p) for c, r, p in ranked], RANKED),
        spark.createDataFrame([(DAY, c, p) for c, p in prices], PRICES), **options,
    )


def board(n, price=10000.0):
    return [(f"{i:06d}", i + 1, price) for i in range(n)]


def test_ten_million_in_twenty_names(spark):
    summary = book(spark, board(38), [("a", 10_000_000.0)], []).summary().first()
    orders = book(spark, board(38), [("a", 10_000_000.0)], []).orders().collect()
    assert len(orders) == 20 and {o["quantity"] for o in orders} == {49}
    assert summary["invested_after"] == 9_800_000 and summary["turnover"] == pytest.approx(98.0)


def test_retention_and_rejection(spark):
    held = [("a", "000024", 5.0), ("a", "000035", 5.0), ("b", "999999", 1.0)]
    got = book(spark, board(38), [("a", 1e7), ("b", 1e7), ("c", -1.0)], held)
    targets = [r["code"] for r in got.target_sheet().orderBy("position").collect() if r["account"] == "a"]
    assert targets[0] == "000024" and "000035" not in targets and len(targets) == 20
    assert {(r["account"], r["reason"]) for r in got.rejected().collect()} == {("b", "held_without_price"), ("c", "bad_cash")}


def test_blocked_names_keep_their_shares_at_execution(spark):
    blocked = spark.createDataFrame([(DAY, "000000"), (DAY, "000030")], "signal_date date, code string")
    prices = [(c, p) for c, _, p in board(31)]
    got = book(spark, board(29), [("a", 1e7)], [("a", "000000", 3.0), ("a", "000030", 40.0)], prices, execution=True, blocked=blocked)
    after = {r["code"]: r["quantity"] for r in got.holdings_after().collect()}
    assert after["000000"] == 3 and after["000030"] == 40
    assert {(r["code"], r["side"]) for r in got.unfilled().collect() if r["reason"] == "blocked"} == {("000000", "buy"), ("000030", "sell")}


def walk(ranked, holdings, cash, fee=0.003, minimum=100_000):
    """The rules in plain Python, one account."""
    price = {c: p for c, _, p in ranked}
    order = [c for c, _, _ in ranked]
    rank = {c: r for c, r, _ in ranked}
    kept = [c for c in order if c in holdings and rank[c] <= 30][:20]
    targets = kept + [c for c in order if c not in kept][: 20 - len(kept)]
    equity = cash + sum(price[c] * q for c, q in holdings.items())
    want = {c: math.floor(equity / 20 / (1 + fee) / price[c]) for c in targets}
    after, money = dict(holdings), cash
    for c in holdings:
        gap = holdings[c] - want.get(c, 0)
        if gap > 0 and gap * price[c] >= minimum:
            after[c] -= gap
            money += gap * price[c] * (1 - fee)
    for c in targets:
        gap = want[c] - holdings.get(c, 0)
        if gap <= 0:
            continue
        q = min(gap, math.floor((money + 1e-8) / (price[c] * (1 + fee))))
        if q > 0 and q * price[c] >= minimum:
            after[c] = after.get(c, 0) + q
            money -= q * price[c] * (1 + fee)
    return {c: q for c, q in after.items() if q > 0}, money


def test_many_accounts_equal_the_plain_walk(spark):
    rnd = random.Random(5)
    ranked = [(f"{i:06d}", i + 1, float(rnd.randint(900, 400_000))) for i in range(60)]
    accounts, held, expected = [], [], {}
    for a in range(25):
        own = {c: rnd.randint(1, 400) for c, _, _ in rnd.sample(ranked, rnd.randint(0, 30))}
        cash = float(rnd.randint(0, 20_000_000))
        accounts.append((str(a), cash))
        held += [(str(a), c, float(q)) for c, q in own.items()]
        expected[str(a)] = walk(ranked, own, cash)
    got = book(spark, ranked, accounts, held)
    after = {}
    for r in got.holdings_after().collect():
        after.setdefault(r["account"], {})[r["code"]] = r["quantity"]
    cash = {r["account"]: r["cash_after"] for r in got.summary().collect()}
    for a, (holdings, money) in expected.items():
        assert after.get(a, {}) == holdings
        assert cash[a] == pytest.approx(max(money, 0.0))


def test_sheet_and_targets_agree(spark):
    accounts = spark.createDataFrame([("a", DAY, 1e7)], ACCOUNT)
    held = spark.createDataFrame([("a", "000025", 4.0)], HELD)
    ranked = spark.createDataFrame([(DAY, c, c, r, p) for c, r, p in board(40)], RANKED)
    alone = od.select_targets(ranked, accounts, held).orderBy("position").collect()
    sheet = book(spark, board(40), [("a", 1e7)], [("a", "000025", 4.0)]).target_sheet().orderBy("position").collect()
    assert [r["code"] for r in alone] == [r["code"] for r in sheet]


def test_splits_multiply_what_is_held_and_carry_stops(spark):
    d = [DAY + dt.timedelta(days=i) for i in range(5)]
    trades = spark.createDataFrame([("p", "000001", d[0], "buy", 10.0), ("p", "000001", d[3], "sell", 4.0)],
                                   "portfolio string, code string, trade_date date, side string, quantity double")
    events = spark.createDataFrame([("000001", d[2], 2.0)], "code string, effective_date date, ratio double")
    held = va.positions(trades, events)
    assert [(r["from_date"], r["quantity"]) for r in held.orderBy("from_date").collect()] == [(d[0], 10.0), (d[2], 20.0), (d[3], 16.0)]
    bars = spark.createDataFrame([("000001", d[0], 100.0), ("000001", d[3], 55.0)], "code string, trade_date date, close double")
    cash = spark.createDataFrame([("p", d[0], None, 50.0, 50.0, 0.0)],
                                 "portfolio string, from_date date, to_date date, cash double, cash_change double, external_flow double")
    sessions = numbered(spark.createDataFrame([(x,) for x in d], "d date"), "d")
    nav, missing = va.value_positions(held, cash, bars, sessions, events)
    got = {r["date"]: (r["equity"], r["carried_prices"]) for r in nav.collect()}
    assert got == {d[0]: (1050.0, 0), d[1]: (1050.0, 1), d[3]: (930.0, 0), d[4]: (930.0, 1)}
    assert [r["date"] for r in missing.collect()] == [d[2]]


def test_performance_of_three_points(spark):
    rows = [("p", DAY, 100.0), ("p", DAY + dt.timedelta(1), 80.0), ("p", DAY + dt.timedelta(2), 120.0), ("q", DAY, 1.0)]
    got = {r["portfolio"]: r for r in va.performance(spark.createDataFrame(rows, "portfolio string, date date, equity double")).collect()}
    assert got["p"]["cumulative_return"] == pytest.approx(0.2) and got["p"]["max_drawdown"] == pytest.approx(-0.2)
    assert got["q"]["reason"] == "too_few_observations"


def test_whole_shares_stay_whole(spark):
    held = spark.createDataFrame([("p", "000001", DAY, 3.0), ("p", "000002", DAY, 4.0)],
                                 "portfolio string, code string, effective_date date, quantity double")
    events = spark.createDataFrame([(c, DAY, dt.datetime(2025, 1, 2), "0.5", "s") for c in ("000001", "000002")],
                                   "code string, effective_date date, published_at timestamp, ratio string, source_fingerprint string")
    events = events.withColumn("ratio", events.ratio.cast("decimal(18,9)"))
    good, bad = sp.convert_positions(held, events)
    assert [(r["code"], r["new_quantity"]) for r in good.collect()] == [("000002", 2.0)]
    assert [(r["code"], r["rule_id"]) for r in bad.collect()] == [("000001", "fractional_entitlement")]
