"""Splits, positions, daily valuation and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.operators import ranking as rk
from knownat.operators import orders as od
from knownat.operators import splits as sp
from knownat.operators import valuation as va
from knownat.session import scratch_folder
from workload import parts
from workload.ranking import schedule, sessions
from workload.registry import Inputs, query

SPLIT_CHECKS = """
    WITH b AS (SELECT code, count(*) AS n, bool_and(basis = 'raw') AS ok FROM price_basis GROUP BY code),
    c AS (SELECT code, effective_date, count(*) AS n FROM raw_split_events GROUP BY code, effective_date),
    j AS (SELECT e.*, c.n AS copies, b.n AS bn, b.ok,
                 try_cast(e.effective_date AS date) AS day,
                 regexp_full_match(published_at, '[0-9-]{10}T[0-9:]{8}[+-][0-9]{2}:[0-9]{2}') AS offs,
                 try_cast(ratio AS decimal(38,20)) AS r
          FROM raw_split_events e LEFT JOIN c ON c.code = e.code AND c.effective_date = e.effective_date
          LEFT JOIN b ON b.code = e.code),
    k AS (SELECT *, [CASE WHEN day IS NULL THEN 'bad_effective_date' END,
                     CASE WHEN NOT offs THEN 'published_without_offset' END,
                     CASE WHEN source_fingerprint = '' THEN 'source_missing' END,
                     CASE WHEN action_type NOT IN ('split', 'reverse_split') THEN 'unsupported_action' END,
                     CASE WHEN status <> 'validated' THEN 'not_validated' END,
                     CASE WHEN r IS NULL OR r <= 0 THEN 'bad_ratio' END,
                     CASE WHEN r <> round(r, 9) THEN 'ratio_too_fine' END,
                     CASE WHEN copies > 1 THEN 'duplicate_event' END,
                     CASE WHEN bn IS NULL OR bn <> 1 THEN 'basis_missing' END,
                     CASE WHEN bn = 1 AND NOT ok THEN 'basis_not_raw' END] AS rules FROM j)"""


@query("validate_splits", "raw_split_events", "price_basis", oracle=SPLIT_CHECKS + """
    SELECT code, day AS effective_date, action_type, cast(r AS decimal(18,9)) AS ratio, status, source_fingerprint
    FROM k WHERE len(list_filter(rules, lambda x: x IS NOT NULL)) = 0""")
def _(t):
    good, _ = sp.validate_splits(t.raw_split_events, t.price_basis)
    return good.drop("published_at")


@query("split_findings", "raw_split_events", "price_basis", oracle=SPLIT_CHECKS + """
    SELECT code, effective_date, source_fingerprint, rule_id
    FROM (SELECT code, effective_date, source_fingerprint, unnest(rules) AS rule_id FROM k) WHERE rule_id IS NOT NULL""")
def _(t):
    return sp.validate_splits(t.raw_split_events, t.price_basis)[1]


def split_signals(t: Inputs):
    """One signal per code: 15:30 in Seoul on the last session of 1999 + a day per code."""
    return t.price_basis.select(
        "code", F.concat(F.date_add(F.lit("1999-12-01").cast("date"), F.col("code").cast("int") % 30).cast("string"),
                         F.lit(" 15:30:00+09:00")).cast("timestamp").alias("signal_at")
    )


TIMED_SPLITS = """
    WITH s AS (SELECT code, DATE '1999-12-01' + cast(cast(code AS int) % 30 AS int) AS day FROM price_basis),
    e AS (SELECT v.*, s.day, cast(replace(left(published_at, 19), 'T', ' ') AS timestamp) AS seoul_time
          FROM split_events v JOIN s ON s.code = v.code WHERE v.effective_date <= s.day),
    hidden AS (SELECT code, min(effective_date) AS effective_date FROM e
               WHERE seoul_time > cast(day AS timestamp) + INTERVAL 15 HOUR + INTERVAL 30 MINUTE GROUP BY code)"""


def timed_events(t: Inputs):
    return t.split_events.withColumn("published_at", F.replace(F.col("published_at"), F.lit("T"), F.lit(" ")).cast("timestamp"))


@query("split_adjusted", "price_basis", "split_events", "bars", oracle=TIMED_SPLITS + """
    SELECT code, trade_date, close, round(divisor, 6) AS divisor, round(close / divisor, 9) AS adjusted_close FROM (
        SELECT b.code, b.trade_date, b.close,
               coalesce((SELECT product(cast(ratio AS double)) FROM e
                         WHERE e.code = b.code AND e.effective_date > b.trade_date), 1) AS divisor
        FROM bars b JOIN s ON s.code = b.code WHERE b.trade_date <= s.day
              AND b.code NOT IN (SELECT code FROM hidden))""")
def _(t):
    found, _ = sp.split_adjusted(t.bars, timed_events(t), split_signals(t))
    return found.select("code", "trade_date", "close", F.round("divisor", 6).alias("divisor"),
                        F.round("adjusted_close", 9).alias("adjusted_close"))


@query("split_not_public", "price_basis", "split_events", oracle=TIMED_SPLITS + """
    SELECT code, effective_date, 'split_not_public' AS rule_id FROM hidden""")
def _(t):
    return sp.split_adjusted(t.bars, timed_events(t), split_signals(t))[1].drop("signal_at")


POSITIONS_AT_SPLITS = """
    WITH p AS (SELECT e.*, h.account AS portfolio, h.quantity,
                      cast(replace(left(published_at, 19), 'T', ' ') AS timestamp)
                        > cast(effective_date AS timestamp) + INTERVAL 9 HOUR AS late
               FROM split_events e JOIN holdings h ON h.code = e.code)"""


def positions_at_splits(t: Inputs):
    held = t.holdings.select(F.col("account").alias("portfolio"), "code", "quantity")
    return held.join(t.split_events.select("code", "effective_date"), "code")


@query("convert_positions", "split_events", "holdings", oracle=POSITIONS_AT_SPLITS + """
    SELECT portfolio, code, effective_date, quantity, cast(quantity * cast(ratio AS double) AS double) AS new_quantity
    FROM p WHERE NOT late AND quantity = floor(quantity)
          AND quantity * cast(ratio AS double) = floor(quantity * cast(ratio AS double))""")
def _(t):
    return sp.convert_positions(positions_at_splits(t), timed_events(t))[0].drop("ratio")


@query("convert_position_findings", "split_events", "holdings", oracle=POSITIONS_AT_SPLITS + """
    SELECT * FROM (
        SELECT portfolio, code, effective_date, quantity, unnest([
            CASE WHEN late THEN 'published_late' END, CASE WHEN quantity <> floor(quantity) THEN 'position_not_whole' END,
            CASE WHEN round(quantity) * cast(ratio AS double) <> floor(round(quantity) * cast(ratio AS double))
                 THEN 'fractional_entitlement' END]) AS rule_id FROM p) WHERE rule_id IS NOT NULL""")
def _(t):
    return sp.convert_positions(positions_at_splits(t), timed_events(t))[1]


@query("event_bars", "split_events", "bars", oracle="""
    SELECT e.code, e.effective_date, b.open, b.close, CASE WHEN b.code IS NULL THEN 'not_one_bar' END AS reason
    FROM split_events e LEFT JOIN bars b ON b.code = e.code AND b.trade_date = e.effective_date""")
def _(t):
    return sp.event_bars(t.split_events, t.bars)


@query("actions_match", "actions", "split_events", oracle="""
    WITH a AS (SELECT lpad(code, 6, '0') AS code, effective_date, action_type, status FROM actions
               WHERE action_type IS NOT NULL),
    e AS (SELECT code, cast(effective_date AS varchar) AS effective_date, action_type, status FROM split_events)
    SELECT *, 'stored_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM e)
    UNION ALL SELECT *, 'given_only' FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
    UNION ALL SELECT *, 'repeated' FROM (SELECT * FROM a GROUP BY ALL HAVING count(*) > 1)""")
def _(t):
    stored = t.actions.filter("action_type IS NOT NULL").withColumn("code", F.lpad("code", 6, "0"))
    return sp.actions_match(stored, t.split_events)


# ---- ledgers --------------------------------------------------------------------------------
@query("normalize_cashflows", "cashflows", oracle="""
    SELECT portfolio, cast(replace(date, '/', '-') AS date) AS date, cast(amount AS double) AS amount, kind, code
    FROM cashflows WHERE date <> 'soon' AND amount <> 'NaN'""")
def _(t):
    return va.normalize_cashflows(t.cashflows)[0]


@query("cashflow_findings", "cashflows", oracle="""
    SELECT portfolio AS subject, 'bad_cashflow' AS rule_id, amount AS observed FROM cashflows
    WHERE date = 'soon' OR amount = 'NaN'""")
def _(t):
    return va.normalize_cashflows(t.cashflows)[1].select("subject", "rule_id", "observed")


LEDGER = """daily AS (
    SELECT portfolio, code, trade_date AS d, 1 AS side, sum(CASE side WHEN 'sell' THEN -quantity ELSE quantity END) AS q,
           cast(1 AS double) AS ratio
    FROM trades GROUP BY portfolio, code, trade_date),
firsts AS (SELECT portfolio, code, min(d) AS d0 FROM daily GROUP BY portfolio, code),
series AS (
    SELECT * FROM daily
    UNION ALL
    SELECT f.portfolio, f.code, e.effective_date, 0, 0, cast(e.ratio AS double)
    FROM firsts f JOIN split_events e ON e.code = f.code AND e.effective_date > f.d0),
growth AS (SELECT *, product(ratio) OVER (PARTITION BY portfolio, code ORDER BY d, side) AS g FROM series),
sums AS (SELECT *, sum(q / g) OVER (PARTITION BY portfolio, code ORDER BY d, side) * g AS quantity FROM growth),
days AS (SELECT portfolio, code, d, max_by(quantity, side) AS quantity FROM sums GROUP BY portfolio, code, d),
held AS (SELECT portfolio, code, d AS from_date, lead(d) OVER (PARTITION BY portfolio, code ORDER BY d) AS to_date, quantity
         FROM days)"""

CASH = """flows AS (SELECT portfolio, cast(replace(date, '/', '-') AS date) AS d, cast(amount AS double) AS amount FROM cashflows
          WHERE date <> 'soon' AND amount <> 'NaN'),
moves AS (
    SELECT portfolio, trade_date AS d, cast(CASE side WHEN 'sell' THEN quantity * price - quantity * price * 0.003::double
           ELSE -(quantity * price) - quantity * price * 0.003::double END AS decimal(38,10)) AS c,
           cast(0 AS decimal(38,10)) AS f FROM trades
    UNION ALL SELECT portfolio, d, cast(amount AS decimal(38,10)), cast(amount AS decimal(38,10)) FROM flows),
cash_days AS (SELECT portfolio, d, sum(c) AS c, sum(f) AS f FROM moves GROUP BY portfolio, d),
cash AS (SELECT portfolio, d AS from_date, lead(d) OVER w AS to_date, cast(1000000 + sum(c) OVER w AS double) AS cash,
                cast(c AS double) AS cash_change, cast(f AS double) AS external_flow
         FROM cash_days WINDOW w AS (PARTITION BY portfolio ORDER BY d))"""

LEDGER_TABLES = ["trades", "split_events", "cashflows"]


def written_once(t: Inputs, made, name: str):
    place = scratch_folder(t.spark, name)
    made.write.parquet(place)
    return t.spark.read.schema(made.schema).parquet(place)


def stored_trades(t: Inputs):
    """The trades written once, for queries that read them several times: three tables are joined to make them."""
    return written_once(t, t.trades.select("portfolio", "code", "trade_date", "side", "quantity", "price"), "trades")


def ledger(trades):
    gross = trades.withColumn("gross_amount", F.col("quantity") * F.col("price"))
    return od.with_costs(gross)


def ledger_cash(t: Inputs, trades=None):
    trades = t.trades if trades is None else trades
    flows, _ = va.normalize_cashflows(t.cashflows)
    opening = trades.select("portfolio").distinct().withColumn("cash", F.lit(1_000_000.0))
    return va.cash_balances(ledger(trades), flows, opening)


@query("positions", "trades", "split_events", oracle=f"""WITH {LEDGER}
    SELECT portfolio, code, from_date, to_date, round(quantity, 6) AS quantity FROM held WHERE quantity <> 0""")
def _(t):
    return va.positions(t.trades, t.split_events).withColumn("quantity", F.round("quantity", 6))


@query("cash_balances", "trades", "cashflows", oracle=f"""WITH {CASH}
    SELECT portfolio, from_date, to_date, round(cash, 6) AS cash, round(cash_change, 6) AS cash_change,
           round(external_flow, 6) AS external_flow FROM cash""")
def _(t):
    return ledger_cash(t).withColumns({c: F.round(c, 6) for c in ["cash", "cash_change", "external_flow"]})


NAV = f"""{LEDGER}, {CASH},
closes AS (
    SELECT g.code, g.date, b.close, b.trade_date AS price_date
    FROM (SELECT DISTINCT bars.code, session_date AS date FROM bars, session_days) g
    ASOF JOIN bars b ON b.code = g.code AND g.date >= b.trade_date),
last_split AS (
    SELECT g.code, g.date, e.effective_date AS split_date
    FROM (SELECT DISTINCT code, date FROM closes) g
    ASOF JOIN split_events e ON e.code = g.code AND g.date >= e.effective_date),
usable AS (SELECT c.* FROM closes c LEFT JOIN last_split s ON s.code = c.code AND s.date = c.date
           WHERE s.split_date IS NULL OR c.price_date >= s.split_date),
open_days AS (
    SELECT h.portfolio, h.code, h.quantity, d.session_date AS date FROM held h JOIN session_days d
    ON d.session_date >= h.from_date AND (h.to_date IS NULL OR d.session_date < h.to_date) WHERE h.quantity <> 0),
priced AS (SELECT o.*, u.close, u.price_date FROM open_days o LEFT JOIN usable u ON u.code = o.code AND u.date = o.date),
worth AS (
    SELECT portfolio, date, sum(quantity * close) AS positions_value,
           count(*) FILTER (price_date < date) AS carried_prices, count(*) FILTER (close IS NULL) AS unpriced
    FROM priced GROUP BY portfolio, date),
nav AS (
    SELECT c.portfolio, d.session_date AS date, c.cash, coalesce(w.positions_value, 0) AS positions_value,
           c.cash + coalesce(w.positions_value, 0) AS equity,
           CASE WHEN d.session_date = c.from_date THEN c.external_flow ELSE 0 END AS external_flow,
           CASE WHEN d.session_date = c.from_date THEN c.cash_change ELSE 0 END AS cash_change,
           coalesce(w.carried_prices, 0) AS carried_prices, coalesce(w.unpriced, 0) AS unpriced
    FROM cash c JOIN session_days d ON d.session_date >= c.from_date
         AND (c.to_date IS NULL OR d.session_date < c.to_date)
    LEFT JOIN worth w ON w.portfolio = c.portfolio AND w.date = d.session_date)"""
NAV_TABLES = [*LEDGER_TABLES, "bars", "session_days"]


def valued(t: Inputs, trades, cash=None):
    held = va.positions(trades, t.split_events)
    return va.value_positions(held, ledger_cash(t, trades) if cash is None else cash, t.bars, sessions(t), t.split_events)


@query("value_positions", *NAV_TABLES, oracle=f"""WITH {NAV}
    SELECT portfolio, date, round(cash + 1.3e-5::double, 3) AS cash,
           round(positions_value + 1.3e-5::double, 3) AS positions_value, round(equity + 1.3e-5::double, 3) AS equity,
           round(external_flow + 1.3e-5::double, 3) AS external_flow, carried_prices
    FROM nav WHERE unpriced = 0""")
def _(t):
    nav, _ = valued(t, stored_trades(t))
    # The small shift keeps exact halves from rounding apart in the two engines.
    money = ["cash", "positions_value", "equity", "external_flow"]
    return nav.withColumns({c: F.round(F.col(c) + 1.3e-5, 3) for c in money})


@query("valuation_findings", *NAV_TABLES, oracle=f"""WITH {NAV}
    SELECT code AS subject, date, portfolio AS observed FROM priced WHERE close IS NULL""")
def _(t):
    return valued(t, stored_trades(t))[1].select("subject", "date", "observed")


@query("reconcile_nav", *NAV_TABLES, oracle=f"""WITH {NAV}
    SELECT portfolio AS subject, date, 'cash_mismatch' AS rule_id FROM (
        SELECT *, lag(cash) OVER (PARTITION BY portfolio ORDER BY date) AS before FROM nav WHERE unpriced = 0)
    WHERE abs(cash - before - cash_change) > 1e-3""")
def _(t):
    trades = stored_trades(t)
    cash = written_once(t, ledger_cash(t, trades), "cash")
    nav, _ = valued(t, trades, cash)
    changes = cash.select("portfolio", F.col("from_date").alias("date"), "cash_change")
    joined = nav.join(changes, ["portfolio", "date"], "left").withColumn("cash_change", F.coalesce("cash_change", F.lit(0.0)))
    return va.reconcile_nav(joined, 1e-3).select("subject", "date", "rule_id")


# ---- performance ----------------------------------------------------------------------------
PERFORMANCE = """steps AS (
    SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS r, max(equity) OVER w AS peak FROM nav_rows
    WINDOW w AS (PARTITION BY portfolio ORDER BY date)),
sums AS (
    SELECT portfolio, count(*) AS n, min(equity) AS lowest, min_by(equity, date) AS e0, max_by(equity, date) AS e1,
           max(date) - min(date) AS days, min(equity / peak - 1) AS dd, stddev_samp(r) * sqrt(252) AS vol, avg(r) AS m
    FROM steps GROUP BY portfolio),
metrics AS (
    SELECT portfolio, n AS observations, CASE WHEN lowest > 0 THEN e1 / e0 - 1 END AS cumulative_return,
           CASE WHEN lowest > 0 THEN pow(e1 / e0, 365.2425::double / days) - 1 END AS cagr,
           CASE WHEN lowest > 0 THEN dd END AS max_drawdown, CASE WHEN lowest > 0 THEN vol END AS annual_volatility,
           CASE WHEN lowest > 0 THEN (m * 252 - 0.02::double) / vol END AS sharpe,
           CASE WHEN lowest <= 0 THEN 'equity_not_positive' END AS reason FROM sums)"""
MEASURES = ["cumulative_return", "cagr", "max_drawdown", "annual_volatility", "sharpe"]
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)


@query("performance", "nav_rows", oracle=f"""WITH {PERFORMANCE}
    SELECT portfolio, observations, {ROUNDED}, cast(0.02 AS double) AS risk_free_rate, reason FROM metrics""")
def _(t):
    return va.performance(t.nav_rows, 0.02).withColumns({m: F.round(m, 6) for m in MEASURES})


@query("official_metrics", "nav_rows", oracle=f"""WITH {PERFORMANCE}
    SELECT portfolio, {", ".join(f"CASE WHEN cast(portfolio AS int) % 3 = 0 THEN round({m}, 6) END AS {m}" for m in MEASURES)},
           CASE WHEN cast(portfolio AS int) % 3 = 0 THEN '' ELSE 'official_backtest_locked' END AS withheld FROM metrics""")
def _(t):
    metrics = va.performance(t.nav_rows, 0.02)
    ready = t.nav_rows.select("portfolio").distinct().select(
        "portfolio", F.lit(True).alias("complete"), F.lit(True).alias("lifecycle_ready"),
        F.lit(True).alias("investability_ready"), F.lit(True).alias("corporate_action_ready"),
        (F.col("portfolio").cast("int") % 3 == 0).alias("official_backtest_ready"),
    )
    return va.official_metrics(metrics, ready).withColumns({m: F.round(m, 6) for m in MEASURES})


@query("compare", "nav_rows", "index_bars", oracle="""
    WITH bench AS (SELECT date, equity FROM nav_rows WHERE portfolio = '0'),
    unsound AS (SELECT portfolio FROM nav_rows GROUP BY portfolio, date
                HAVING count(*) > 1 OR bool_or(equity IS NULL OR isnan(equity) OR isinf(equity) OR equity <= 0)),
    s AS (SELECT portfolio, date, equity / first_value(equity) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS strategy
          FROM nav_rows WHERE portfolio NOT IN (SELECT portfolio FROM unsound)),
    a AS (SELECT s.portfolio, s.date, y.symbol, i.close FROM s
          JOIN (SELECT DISTINCT symbol FROM index_bars) y ON true
          ASOF JOIN index_bars i ON i.symbol = y.symbol AND s.date >= i.trade_date),
    r AS (SELECT portfolio, date, symbol,
                 close / first_value(close) OVER (PARTITION BY portfolio, symbol ORDER BY date) - 1 AS v FROM a)
    SELECT s.portfolio, s.date, round(s.strategy, 6) AS strategy,
           round(b.equity / (SELECT min_by(equity, date) FROM bench) - 1, 6) AS benchmark,
           round(k.v, 6) AS kospi, round(q.v, 6) AS kosdaq
    FROM s LEFT JOIN bench b ON b.date = s.date
    LEFT JOIN r k ON k.portfolio = s.portfolio AND k.date = s.date AND k.symbol = 'KOSPI'
    LEFT JOIN r q ON q.portfolio = s.portfolio AND q.date = s.date AND q.symbol = 'KOSDAQ'""")
def _(t):
    bench = t.nav_rows.filter("portfolio = '0'").select("date", "equity")
    found = va.compare(t.nav_rows, bench, t.index_bars)
    return found.withColumns({c: F.round(c, 6) for c in ["strategy", "benchmark", "kospi", "kosdaq"]})


EQUAL_WEIGHT = f"""{parts.SCHEDULE}, {parts.CANDIDATES},
dense AS (
    SELECT g.code, g.date AS trade_date, b.open, b.close
    FROM (SELECT DISTINCT bars.code, session_date AS date FROM bars, session_days) g
    ASOF JOIN bars b ON b.code = g.code AND g.date >= b.trade_date),
wk AS (SELECT *, lead(execution_date) OVER (ORDER BY signal_date) AS next_execution FROM sched),
h AS (SELECT w.*, c.code, o.open AS entry, n.open AS leave FROM wk w JOIN candidates c ON c.signal_date = w.signal_date
      LEFT JOIN dense o ON o.code = c.code AND o.trade_date = w.execution_date
      LEFT JOIN dense n ON n.code = c.code AND n.trade_date = w.next_execution),
g AS (SELECT signal_date, execution_date, next_execution, avg(leave / entry) AS growth FROM h GROUP BY ALL),
lv AS (SELECT *, exp(coalesce(sum(ln(growth)) OVER (ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                              0)) * 1e7 AS level FROM g)"""


@query("equal_weight_index", "session_days", "snapshots", "bars", oracle=f"""WITH {EQUAL_WEIGHT}
    SELECT DATE '1995-01-01' AS date, cast(1e7 AS double) AS equity
    UNION ALL
    SELECT d.session_date, round(max(lv.level) * avg(x.close / h.entry), 2)
    FROM h JOIN lv ON lv.signal_date = h.signal_date
    JOIN session_days d ON d.session_date >= h.execution_date
         AND (h.next_execution IS NULL OR d.session_date < h.next_execution)
    LEFT JOIN dense x ON x.code = h.code AND x.trade_date = d.session_date GROUP BY d.session_date""")
def _(t):
    dates = cal.DateList(sessions(t), "session_date")
    universe = rk.candidate_universe(t.snapshots)
    # A row a session is made only for names of the universe, the only ones whose prices the index reads.
    bars = t.bars.join(universe.select("code").distinct(), "code", "left_semi")
    placed = dates.with_next_no(bars, F.col("trade_date"), "_from_no").drop("trade_date")
    dense = dates.carry_forward(placed, ["code"], "_from_no", "trade_date")
    index, _ = va.equal_weight_index(universe, dense, schedule(t), dates, 1e7, "1995-01-01")
    return index.withColumn("equity", F.round("equity", 2))


@query("equal_weight_blocked", "session_days", "snapshots", "bars", oracle=f"""
    WITH {parts.SCHEDULE}, {parts.CANDIDATES},
    wk AS (SELECT *, lead(execution_date) OVER (ORDER BY signal_date) AS next_execution FROM sched)
    SELECT w.signal_date, w.execution_date,
           count(*) FILTER (o.code IS NULL) + count(*) FILTER (n.code IS NULL AND w.next_execution IS NOT NULL)
               AS missing_opens
    FROM wk w JOIN candidates c ON c.signal_date = w.signal_date
    LEFT JOIN bars o ON o.code = c.code AND o.trade_date = w.execution_date
    LEFT JOIN bars n ON n.code = c.code AND n.trade_date = w.next_execution
    GROUP BY w.signal_date, w.execution_date HAVING missing_opens > 0""")
def _(t):
    blocked = va.equal_weight_index(rk.candidate_universe(t.snapshots), t.bars, schedule(t), sessions(t), 1e7, "1995-01-01")[1]
    return blocked.filter("missing_opens > 0").select("signal_date", "execution_date", "missing_opens")


# Quarterly runs of each sector and of each name on the bars as they are, so that runs stop, carry prices and meet splits.
RUNS = f"""{parts.SCHEDULE}, {parts.CANDIDATES},
wk AS (SELECT *, lead(execution_date) OVER (ORDER BY signal_date) AS next_execution FROM sched),
u AS MATERIALIZED (
    SELECT unnest([sector, code]) || ' ' || year(signal_date) || ' ' || quarter(signal_date) AS portfolio, signal_date, code FROM candidates),
pw AS MATERIALIZED (
    SELECT *, coalesce(lead(execution_date) OVER w = next_execution, false) AS goes_on,
           coalesce(lag(next_execution) OVER w < execution_date, false) AS left_out
    FROM (SELECT DISTINCT portfolio, signal_date FROM u) JOIN wk USING (signal_date)
    WINDOW w AS (PARTITION BY portfolio ORDER BY signal_date)),
h AS MATERIALIZED (
    SELECT pw.*, u.code, o.open AS entry, x.open AS leave
    FROM pw JOIN u USING (portfolio, signal_date)
    LEFT JOIN bars o ON o.code = u.code AND o.trade_date = pw.execution_date
    LEFT JOIN bars x ON x.code = u.code AND x.trade_date = pw.next_execution),
e AS MATERIALIZED (
    SELECT v.code, v.effective_date, v.ratio,
           b.code IS NULL OR cast(replace(left(v.published_at, 19), 'T', ' ') AS timestamp)
                             > cast(v.effective_date AS timestamp) + INTERVAL 9 HOUR AS bad
    FROM split_events v LEFT JOIN bars b ON b.code = v.code AND b.trade_date = v.effective_date),
days AS MATERIALIZED (
    SELECT h.*, d.session_date AS date, coalesce(d.session_date = h.next_execution, false) AS leaves
    FROM h JOIN session_days d ON d.session_date >= h.execution_date AND (h.next_execution IS NULL OR d.session_date <= h.next_execution)),
closes AS (
    SELECT g.code, g.date, b.close, b.trade_date AS price_date
    FROM (SELECT DISTINCT code, date FROM days) g ASOF JOIN bars b ON b.code = g.code AND g.date >= b.trade_date),
split_days AS (
    SELECT g.code, g.date, e.effective_date
    FROM (SELECT DISTINCT code, date FROM days) g ASOF JOIN e ON e.code = g.code AND g.date >= e.effective_date),
inside AS (
    SELECT g.code, g.execution_date, g.date, product(cast(e.ratio AS double)) AS factor, bool_or(e.bad) AS bad
    FROM (SELECT DISTINCT code, execution_date, date FROM days) g
    JOIN e ON e.code = g.code AND e.effective_date > g.execution_date AND e.effective_date <= g.date GROUP BY ALL),
moves AS (
    SELECT days.*, coalesce(i.bad, false) AS bad, coalesce(i.factor, 1) / entry
           * CASE WHEN leaves THEN leave WHEN s.effective_date IS NULL OR c.price_date >= s.effective_date THEN c.close END AS move
    FROM days LEFT JOIN closes c USING (code, date) LEFT JOIN split_days s USING (code, date)
         LEFT JOIN inside i USING (code, execution_date, date)),
steps AS MATERIALIZED (
    SELECT portfolio, signal_date, execution_date, date, leaves, goes_on, left_out, avg(move) AS move,
           count(*) FILTER (move IS NULL) AS unpriced,
           count(*) FILTER (date = execution_date AND entry IS NULL OR leaves AND goes_on AND leave IS NULL) AS no_open,
           count(*) FILTER (bad AND (goes_on OR NOT leaves)) AS bad
    FROM moves GROUP BY ALL),
stops AS (SELECT portfolio, min(date) AS stop FROM steps WHERE no_open > 0 OR bad > 0 OR left_out GROUP BY portfolio),
levels AS (
    SELECT portfolio, signal_date, 1e7 * exp(coalesce(sum(ln(move)) OVER (
               PARTITION BY portfolio ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM (SELECT portfolio, signal_date, max(move) FILTER (leaves) AS move FROM steps GROUP BY portfolio, signal_date))"""
RUN_TABLES = ["session_days", "snapshots", "bars", "split_events"]


def quarterly_runs(t: Inputs):
    names = rk.candidate_universe(t.snapshots)
    quarter = F.concat_ws(" ", F.lit(""), F.year("signal_date"), F.quarter("signal_date"))
    universe = names.select("signal_date", "code", F.explode(F.array("sector", "code")).alias("_of")).select(
        F.concat("_of", quarter).alias("portfolio"), "signal_date", "code")
    return va.equal_weight_runs(universe, t.bars, schedule(t), sessions(t), 1e7, timed_events(t))


@query("equal_weight_runs", *RUN_TABLES, oracle=f"""WITH {RUNS}
    SELECT portfolio, date, round(level * move, 2) AS equity FROM steps JOIN levels USING (portfolio, signal_date)
    LEFT JOIN stops USING (portfolio) WHERE NOT leaves AND unpriced = 0 AND (stop IS NULL OR date < stop)""")
def _(t):
    return quarterly_runs(t)[0].withColumn("equity", F.round("equity", 2))


@query("equal_weight_runs_blocked", *RUN_TABLES, oracle=f"""WITH {RUNS}
    SELECT portfolio, signal_date, execution_date, cast(sum(no_open) AS bigint) AS missing_opens, max(bad) AS bad_splits,
           bool_or(left_out) AS left_out
    FROM steps GROUP BY portfolio, signal_date, execution_date HAVING sum(no_open) > 0 OR max(bad) > 0 OR bool_or(left_out)""")
def _(t):
    return quarterly_runs(t)[1]
