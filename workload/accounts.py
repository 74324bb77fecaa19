"""Targets, orders and costs of many accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.operators import orders as od
from knownat.schemas import TradingRules
from workload.registry import Inputs, query

TARGETS = """kept AS (
    SELECT * FROM (
        SELECT a.account, a.signal_date, b.code, b.rank,
               row_number() OVER (PARTITION BY a.account ORDER BY b.rank) AS k
        FROM sound a JOIN holdings h ON h.account = a.account
        JOIN board b ON b.signal_date = a.signal_date AND b.code = h.code
        WHERE h.quantity > 0 AND b.rank <= 30) WHERE k <= 20),
kept_n AS (SELECT account, count(*) AS n FROM kept GROUP BY account),
fill AS (
    SELECT a.account, a.signal_date, b.code, b.rank, row_number() OVER (PARTITION BY a.account ORDER BY b.rank) AS k
    FROM sound a JOIN board b ON b.signal_date = a.signal_date
    WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.account = a.account AND kept.code = b.code)),
targets AS (
    SELECT account, signal_date, k AS position, code, rank, true AS kept FROM kept
    UNION ALL
    SELECT f.account, f.signal_date, coalesce(n, 0) + k, f.code, f.rank, false
    FROM fill f LEFT JOIN kept_n ON kept_n.account = f.account WHERE k <= 20 - coalesce(n, 0))"""

CHECKS = """quotes AS (
    SELECT coalesce(b.signal_date, o.signal_date) AS signal_date, coalesce(b.code, o.code) AS code,
           coalesce(b.price, o.price) AS price
    FROM board b FULL JOIN open_prices o ON o.signal_date = b.signal_date AND o.code = b.code),
rejected AS (
    SELECT account, 'bad_cash' AS reason FROM accounts WHERE cash < 0
    UNION SELECT account, 'bad_quantity' FROM holdings WHERE quantity <> floor(quantity)
    UNION SELECT h.account, 'held_without_price' FROM holdings h JOIN accounts a ON a.account = h.account
          LEFT JOIN quotes q ON q.signal_date = a.signal_date AND q.code = h.code WHERE q.price IS NULL),
sound AS (SELECT * FROM accounts WHERE account NOT IN (SELECT account FROM rejected))"""


def book(desired: str, order: str, blocked: str, extra: str) -> str:
    """Check SQL of a rebalance: sheet, sells, then the buys one position at a time."""
    return f"""WITH RECURSIVE {CHECKS}, {TARGETS},
held AS (SELECT h.account, h.code, cast(h.quantity AS bigint) AS quantity FROM holdings h
         JOIN sound s ON s.account = h.account WHERE h.quantity > 0),
lines AS (
    SELECT coalesce(h.account, t.account) AS account, coalesce(h.code, t.code) AS code,
           coalesce(h.quantity, 0) AS quantity, t.position, t.rank
    FROM held h FULL JOIN targets t ON t.account = h.account AND t.code = h.code),
priced AS (
    SELECT l.*, s.signal_date, s.cash, q.price, coalesce(b.name, l.code) AS name, {blocked} AS stopped
    FROM lines l JOIN sound s ON s.account = l.account
    LEFT JOIN quotes q ON q.signal_date = s.signal_date AND q.code = l.code
    LEFT JOIN board b ON b.signal_date = s.signal_date AND b.code = l.code),
worth AS (SELECT account, cash + sum(coalesce(quantity * price, 0)) AS equity FROM priced GROUP BY account, cash),
wanted AS (
    SELECT p.*, w.equity, CASE WHEN position IS NULL THEN 0 WHEN stopped THEN quantity WHEN price IS NULL THEN NULL
                               ELSE cast({desired} AS bigint) END AS desired
    FROM priced p JOIN worth w ON w.account = p.account),
gaps AS (SELECT *, coalesce(desired, 0) - quantity AS gap FROM wanted),
sells AS (
    SELECT *, CASE WHEN gap < 0 AND stopped THEN 'blocked' WHEN gap < 0 AND -gap * price < 100000
                   THEN 'below_minimum' END AS sell_reason FROM gaps),
sold AS (SELECT *, CASE WHEN gap < 0 AND sell_reason IS NULL THEN -gap ELSE 0 END AS sold FROM sells),
buys AS (
    SELECT account, code, gap AS need, price, row_number() OVER (PARTITION BY account ORDER BY {order}) AS pos
    FROM sold WHERE position IS NOT NULL AND gap > 0),
opening AS (
    SELECT account, cash + sum(sold * coalesce(price, 0) - sold * coalesce(price, 0) * 0.003::double) AS cash
    FROM sold GROUP BY account, cash),
walk AS (
    SELECT account, cast(0 AS bigint) AS pos, cash, cast(NULL AS varchar) AS code, cast(0 AS bigint) AS filled,
           cast(NULL AS varchar) AS buy_reason FROM opening
    UNION ALL
    SELECT account, pos, CASE WHEN q > 0 AND q * price >= 100000 THEN cash - q * price - q * price * 0.003::double
                              ELSE cash END,
           code, cast(CASE WHEN q > 0 AND q * price >= 100000 THEN q ELSE 0 END AS bigint),
           CASE WHEN q = 0 THEN 'no_cash' WHEN q * price < 100000 THEN 'below_minimum' END
    FROM (SELECT w.account, b.pos, w.cash, b.code, b.price,
                 greatest(least(b.need, floor((w.cash + 1e-8) / (b.price * 1.003::double))), 0) AS q
          FROM walk w JOIN buys b ON b.account = w.account AND b.pos = w.pos + 1)),
fills AS (
    SELECT s.*, CASE WHEN gap < 0 THEN 'sell' ELSE 'buy' END AS side,
           cast(CASE WHEN sold > 0 THEN sold ELSE coalesce(k.filled, 0) END AS bigint) AS filled,
           coalesce(sell_reason, buy_reason, CASE WHEN position IS NOT NULL AND stopped THEN 'blocked' END{extra})
               AS reason
    FROM sold s LEFT JOIN walk k ON k.account = s.account AND k.code = s.code),
after AS (SELECT *, quantity + CASE WHEN side = 'sell' THEN -filled ELSE filled END AS left_over FROM fills)"""


TABLES = ["accounts", "holdings", "board", "open_prices"]
LIVE = book("floor(equity / 20 / (1 + 0.003::double) / price)", "position", "false", "")
EXECUTION = book(
    "floor(equity / 20 / (price * (1 + 0.003::double)))", "rank", "coalesce(b.rank % 9 = 4, false)",
    ", CASE WHEN position IS NOT NULL AND price IS NULL THEN 'no_open' "
    "WHEN position IS NOT NULL AND desired = 0 THEN 'allocation_too_small' END",
).replace(
    """FROM board b FULL JOIN open_prices o ON o.signal_date = b.signal_date AND o.code = b.code)""",
    """FROM open_prices o LEFT JOIN board b ON false WHERE o.code <> '000042')""",
)


def live(t: Inputs) -> od.Proposal:
    return od.rebalance(t.accounts, t.holdings, t.board, t.open_prices)


def execution(t: Inputs) -> od.Proposal:
    blocked = t.board.filter("rank % 9 = 4").select("signal_date", "code")
    opens = t.open_prices.filter("code <> '000042'")
    return od.rebalance(t.accounts, t.holdings, t.board, opens, execution=True, blocked=blocked)


@query("select_targets", *TABLES, oracle=f"""WITH sound AS (SELECT * FROM accounts), {TARGETS}
    SELECT account, signal_date, cast(position AS int) AS position, code, rank, kept FROM targets""")
def _(t):
    return od.select_targets(t.board, t.accounts, t.holdings)


@query("check_accounts", *TABLES, oracle=f"WITH {CHECKS} SELECT * FROM rejected")
def _(t):
    held = t.holdings.join(t.accounts.select("account", "signal_date"), "account")
    quotes = t.board.select("signal_date", "code", "price").unionByName(t.open_prices.select("signal_date", "code", "price"))
    return od.check_accounts(t.accounts, held, quotes.dropDuplicates(["signal_date", "code"]))


@query("desired_quantities", *TABLES, oracle=LIVE + """
    SELECT account, code, desired, round(equity, 4) AS equity FROM fills WHERE position IS NOT NULL""")
def _(t):
    return live(t).fills().filter("position IS NOT NULL").select("account", "code", "desired", F.round("equity", 4).alias("equity"))


@query("desired_quantities_at_execution", *TABLES, oracle=EXECUTION + """
    SELECT account, code, desired FROM fills WHERE position IS NOT NULL""")
def _(t):
    return execution(t).fills().filter("position IS NOT NULL").select("account", "code", "desired")


@query("sell_orders", *TABLES, oracle=LIVE + """
    SELECT account, code, filled AS quantity, price, reason FROM fills WHERE side = 'sell'""")
def _(t):
    return live(t).fills().filter("side = 'sell'").select("account", "code", F.col("filled").alias("quantity"), "price", "reason")


@query("buy_orders", *TABLES, oracle=LIVE + """
    SELECT account, code, filled AS quantity, price, reason FROM fills WHERE side = 'buy' AND gap > 0""")
def _(t):
    found = live(t).fills().filter("side = 'buy' AND coalesce(desired, 0) > quantity")
    return found.select("account", "code", F.col("filled").alias("quantity"), "price", "reason")


@query("trade_cost", "trades", oracle="""
    SELECT seq, code, side, round(quantity * price, 6) AS gross_amount, round(quantity * price * 0.003::double, 6) AS fee,
           round(CASE side WHEN 'sell' THEN quantity * price * 0.002::double ELSE 0 END, 6) AS tax,
           round(quantity * price * 0.001::double, 6) AS slippage
    FROM trades""")
def _(t):
    gross = t.trades.withColumn("gross_amount", F.col("quantity") * F.col("price"))
    costed = od.with_costs(gross, TradingRules(tax=0.002, slippage=0.001))
    return costed.select("seq", "code", "side", *[F.round(c, 6).alias(c) for c in ["gross_amount", "fee", "tax", "slippage"]])


@query("rebalance_orders", *TABLES, oracle=LIVE + """
    SELECT account, signal_date, code, name, side, filled AS quantity, price, round(filled * price, 4) AS gross_amount,
           round(filled * price * 0.003::double, 8) AS cost_total FROM fills WHERE filled > 0""")
def _(t):
    return live(t).orders().select(
        "account", "signal_date", "code", "name", "side", "quantity", "price", F.round("gross_amount", 4).alias("gross_amount"),
        F.round("cost_total", 8).alias("cost_total"),
    )


@query("rebalance_unfilled", *TABLES, oracle=LIVE + """
    SELECT account, signal_date, code, side, reason FROM fills WHERE reason IS NOT NULL""")
def _(t):
    return live(t).unfilled()


@query("rebalance_holdings_after", *TABLES, oracle=LIVE + """
    SELECT account, signal_date, code, left_over AS quantity, price FROM after WHERE left_over > 0""")
def _(t):
    return live(t).holdings_after()


SUMMARY = """
    SELECT account, signal_date, round(equity, 4) AS equity,
           round(greatest(cash + sum(CASE side WHEN 'sell' THEN 1 ELSE -1 END * filled * coalesce(price, 0)
                     - filled * coalesce(price, 0) * 0.003::double), 0), 4) AS cash_after,
           round(sum(coalesce(left_over * price, 0)), 4) AS invested_after,
           round(sum(filled * coalesce(price, 0)), 4) AS turnover_amount,
           round(sum(filled * coalesce(price, 0)) / equity * 100, 6) AS turnover,
           round(sum(filled * coalesce(price, 0) * 0.003::double), 4) AS cost_total,
           count(*) FILTER (filled > 0) AS order_count
    FROM after GROUP BY account, signal_date, equity, cash"""


def rounded_summary(p: od.Proposal):
    money = ["equity", "cash_after", "invested_after", "turnover_amount", "cost_total"]
    return p.summary().withColumns({**{c: F.round(c, 4) for c in money}, "turnover": F.round("turnover", 6)})


@query("rebalance_summary", *TABLES, oracle=LIVE + SUMMARY)
def _(t):
    return rounded_summary(live(t))


@query("rebalance_target_sheet", *TABLES, oracle=LIVE + """
    SELECT account, signal_date, cast(position AS int) AS position, rank, code, name, price, left_over AS quantity,
           round(price * left_over, 4) AS amount, cast(5 AS double) AS target_weight,
           round(price * left_over / equity * 100, 6) AS actual_weight FROM after WHERE position IS NOT NULL""")
def _(t):
    return live(t).target_sheet().withColumns({"amount": F.round("amount", 4), "actual_weight": F.round("actual_weight", 6)})


@query("rebalance_unfunded", *TABLES, oracle=LIVE + """
    SELECT account, signal_date, code FROM fills WHERE position IS NOT NULL AND desired = 0""")
def _(t):
    return live(t).unfunded_targets()


@query("execution_orders", *TABLES, oracle=EXECUTION + """
    SELECT account, signal_date, code, side, filled AS quantity, price FROM fills WHERE filled > 0""")
def _(t):
    return execution(t).orders().select("account", "signal_date", "code", "side", "quantity", "price")


@query("execution_unfilled", *TABLES, oracle=EXECUTION + """
    SELECT account, signal_date, code, side, reason FROM fills WHERE reason IS NOT NULL
    UNION ALL SELECT account, signal_date, code, 'buy', 'allocation_too_small' FROM fills
    WHERE position IS NOT NULL AND NOT stopped AND desired = 0 AND gap < 0""")
def _(t):
    return execution(t).unfilled()


@query("execution_summary", *TABLES, oracle=EXECUTION + SUMMARY)
def _(t):
    return rounded_summary(execution(t))


@query("execution_rejections", *TABLES, oracle=f"""WITH sound AS (SELECT * FROM accounts), {TARGETS},
    touched AS (SELECT account, signal_date, code FROM targets
                UNION SELECT h.account, a.signal_date, h.code FROM holdings h JOIN accounts a ON a.account = h.account)
    SELECT t.account, t.signal_date, t.code, coalesce(CASE WHEN b.rank % 9 = 4 THEN 'ineligible'
               WHEN b.rank IS NOT NULL THEN 'eligible' END, 'unknown') AS state,
           CASE WHEN b.rank IS NULL THEN 'missing_security_identity' ELSE 'trading_suspension' END AS reasons
    FROM touched t LEFT JOIN board b ON b.signal_date = t.signal_date AND b.code = t.code
    WHERE b.rank IS NULL OR b.rank % 9 = 4""")
def _(t):
    targets = od.select_targets(t.board, t.accounts, t.holdings)
    held = t.holdings.join(t.accounts.select("account", "signal_date"), "account")
    stopped = F.col("rank") % 9 == 4
    decisions = t.board.select(
        "signal_date", "code", F.when(stopped, "ineligible").otherwise("eligible").alias("state"),
        F.when(stopped, F.array(F.lit("trading_suspension"))).otherwise(F.array()).alias("reason_codes"),
    )
    found = od.execution_rejections(targets, held, decisions)
    return found.select("account", "signal_date", "code", "state", F.array_join("reason_codes", ",").alias("reasons"))


@query("weekly_summary", *TABLES, oracle=LIVE + """
    SELECT signal_date, side, count(*) AS order_count, round(sum(filled * price), 2) AS turnover_amount,
           round(sum(filled * price * 0.003::double), 2) AS fee, cast(0 AS double) AS tax, cast(0 AS double) AS slippage,
           round(sum(filled * price * 0.003::double), 2) AS cost_total
    FROM fills WHERE filled > 0 GROUP BY signal_date, side""")
def _(t):
    found = od.weekly_summary(live(t).orders(), ("signal_date", "side"))
    return found.withColumns({c: F.round(c, 2) for c in ["turnover_amount", "fee", "cost_total"]})
