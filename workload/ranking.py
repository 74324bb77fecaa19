"""Calendar, fundamentals, universe, factors and the weekly ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.findings import union_all
from knownat.functions import calendar as cal
from knownat.operators import fundamentals as fu
from knownat.operators import ranking as rk
from knownat.plans import weekly
from knownat.schemas import RankingRules
from workload import parts
from workload.registry import Inputs, query


def sessions(t: Inputs):
    return cal.numbered(t.session_days, "session_date")


def schedule(t: Inputs):
    return cal.weekly_schedule(sessions(t))


def inputs(t: Inputs) -> weekly.Desk:
    return weekly.Desk(
        sessions=sessions(t), snapshots=t.snapshots, bars=t.bars, statements=t.statements,
        accounts=t.statement_accounts, companies=t.companies,
    )


# ---- calendar -------------------------------------------------------------------------------
@query("sessions_from_bars", "bars", oracle="""
    SELECT session_date, cast(row_number() OVER (ORDER BY session_date) AS int) AS session_no
    FROM (SELECT DISTINCT trade_date AS session_date FROM bars)""")
def _(t):
    return cal.numbered(t.bars, "trade_date")


@query("weekly_schedule", "session_days", oracle=f"WITH {parts.SCHEDULE} SELECT * FROM sched")
def _(t):
    return schedule(t)


@query("weekly_schedule_between", "session_days", oracle=f"""WITH {parts.SCHEDULE}
    SELECT * FROM sched WHERE signal_date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30'""")
def _(t):
    return cal.weekly_schedule(sessions(t), "1997-01-01", "1999-06-30")


@query("next_session", "session_days", "orders", oracle="""
    WITH d AS (SELECT DISTINCT cast(o_orderdate AS date) AS day FROM orders)
    SELECT day, (SELECT min(session_date) FROM session_days WHERE session_date > day) AS next_date FROM d""")
def _(t):
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return cal.with_next_session(days, F.col("day"), sessions(t), "next_date")


@query("requested_days", "orders", oracle="""
    SELECT cast(d AS date) AS trade_date FROM (
        SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM (
            SELECT cast(min(o_orderdate) AS timestamp) AS a, cast(max(o_orderdate) AS timestamp) AS b FROM orders))
    WHERE isodow(d) < 6""")
def _(t):
    span = t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return cal.requested_days(span, "a", "b")


# ---- fundamentals ---------------------------------------------------------------------------
@query("validate_filings", "lineitem", "orders", oracle="""
    WITH a AS (SELECT l_orderkey AS filing, CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN 'short'
                 ELSE strftime(cast(o_orderdate AS date), '%Y%m%d') || lpad(cast(o_orderkey % 1000 AS varchar), 6, '0')
               END AS receipt
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    l AS (SELECT strftime(cast(o_orderdate AS date), '%Y%m%d') || lpad(cast(o_orderkey % 1000 AS varchar), 6, '0')
              AS receipt, strftime(cast(o_orderdate AS date) + 1, '%Y%m%d') AS received
          FROM orders WHERE o_orderstatus <> 'P'),
    g AS (SELECT filing, min(receipt) AS receipt, count(DISTINCT receipt) AS d FROM a GROUP BY filing),
    n AS (SELECT receipt, count(*) AS k, min(received) AS received FROM l GROUP BY receipt),
    j AS (SELECT filing, g.receipt, d = 1 AND regexp_full_match(g.receipt, '[0-9]{14}') AS good,
                 try_strptime(CASE WHEN k = 1 THEN received ELSE left(g.receipt, 8) END, '%Y%m%d')::date AS day
          FROM g LEFT JOIN n ON n.receipt = g.receipt)
    SELECT filing, CASE WHEN good THEN receipt END AS receipt, CASE WHEN good THEN day END AS filed_at,
           CASE WHEN NOT good THEN 'receipt_mismatch' WHEN day IS NULL THEN 'bad_receipt_date' END AS reason FROM j""")
def _(t):
    receipt = F.concat(
        F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd"),
        F.lpad((F.col("o_orderkey") % 1000).cast("string"), 6, "0"),
    )
    odd = (F.col("l_linenumber") == 7) & (F.col("l_tax") == 0)
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    accounts = joined.select(F.col("l_orderkey").alias("filing"), F.when(odd, "short").otherwise(receipt).alias("receipt"))
    filings = t.orders.filter("o_orderstatus <> 'P'").select(
        receipt.alias("receipt"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyyMMdd").alias("received")
    )
    return fu.validate_filings(accounts, filings)


@query("pick_account", "statement_accounts", oracle=f"""WITH {parts.METRICS}
    SELECT stock, year, basis, receipt,
           CASE WHEN r IS NULL THEN profit END AS thstrm_amount, r AS reason
    FROM (SELECT *, CASE WHEN pn = 0 THEN 'profit_missing' WHEN pf > 0 THEN 'profit_not_krw'
                         WHEN pb > 0 THEN 'profit_not_numeric' WHEN pd > 1 THEN 'profit_ambiguous' END AS r
          FROM filing_sums)""")
def _(t):
    return fu.pick_account(t.statement_accounts, "profit", fu.PROFIT, fu.PROFIT_SECTIONS, ["thstrm_amount"])


@query("statement_metrics", "statement_accounts", oracle=f"""WITH {parts.METRICS}
    SELECT stock, year, basis, receipt, profit, equity, previous_equity, round(roe, 6) AS roe, reason FROM metrics""")
def _(t):
    found = fu.statement_metrics(t.statement_accounts)
    return found.withColumn("roe", F.round("roe", 6)).drop("min_corp", "max_corp")


@query("match_company", "companies", "snapshots", "statements", oracle="""
    WITH last_day AS (SELECT * FROM snapshots WHERE signal_date = (SELECT max(signal_date) FROM snapshots)),
    n AS (SELECT code, count(*) AS n, max(marcap) AS marcap FROM last_day GROUP BY code)
    SELECT s.stock, k.corp_code, k.name AS company_name, n.marcap, coalesce(n.n, 0) AS listing_rows,
           CASE WHEN coalesce(n.n, 0) <> 1 THEN 'listing_not_unique' WHEN k.stock IS NULL THEN 'company_missing'
                WHEN NOT coalesce(regexp_full_match(k.corp_code, '[0-9]{8}'), false) THEN 'corp_code_invalid' END AS reason
    FROM (SELECT DISTINCT stock FROM statements) s LEFT JOIN n ON n.code = s.stock
    LEFT JOIN companies k ON k.stock = s.stock""")
def _(t):
    listing = t.sql(["snapshots"], "SELECT * FROM snapshots WHERE signal_date = (SELECT max(signal_date) FROM snapshots)")
    return fu.match_company(t.statements, t.companies, listing)


@query("summarize_statements", "statement_accounts", "companies", "candidates_listing", oracle=f"""
    WITH {parts.METRICS},
    j AS (SELECT m.*, k.corp_code, coalesce(k.name, m.stock) AS company_name, l.marcap,
                 CASE WHEN l.code IS NULL THEN 'listing_not_unique' WHEN k.stock IS NULL THEN 'company_missing'
                      WHEN NOT coalesce(regexp_full_match(k.corp_code, '[0-9]{{8}}'), false) THEN 'corp_code_invalid'
                 END AS mismatch,
                 CASE WHEN c1 IS DISTINCT FROM k.corp_code OR c2 IS DISTINCT FROM k.corp_code
                      THEN 'issuer_mismatch' ELSE m.reason END AS status
          FROM metrics m LEFT JOIN companies k ON k.stock = m.stock LEFT JOIN candidates_listing l ON l.code = m.stock)
    SELECT stock, year, basis, receipt, company_name, coalesce(mismatch, 'matched') AS company_status,
           CASE WHEN status IS NULL THEN profit END AS profit, CASE WHEN status IS NULL THEN equity END AS equity,
           CASE WHEN status IS NULL THEN previous_equity END AS previous_equity,
           CASE WHEN status IS NULL THEN round(roe, 6) END AS roe,
           CASE WHEN status IS NULL AND mismatch IS NULL AND marcap > 0
                THEN round(cast(profit AS double) / marcap * 100, 6) END AS earnings_yield,
           status AS account_status,
           CASE WHEN mismatch IS NOT NULL THEN mismatch WHEN status IS NOT NULL THEN 'accounts_unchecked'
                ELSE 'reference_value' END AS value_status
    FROM j""")
def _(t):
    metrics = fu.statement_metrics(t.statement_accounts)
    found = fu.summarize_statements(metrics, fu.match_company(t.statements, t.companies, t.candidates_listing))
    return found.withColumns({"roe": F.round("roe", 6), "earnings_yield": F.round("earnings_yield", 6)})


@query("select_filings", "statements", "session_days", oracle=f"""
    WITH {parts.SCHEDULE}, {parts.CHOSEN} SELECT * FROM chosen""")
def _(t):
    return fu.select_filings(t.statements, schedule(t))


@query("visible_filings", "statements", oracle="""
    SELECT stock, year, basis, receipt, filed_at FROM statements WHERE filed_at <= DATE '1998-06-30'""")
def _(t):
    return fu.visible_filings(t.statements, "1998-06-30").select("stock", "year", "basis", "receipt", "filed_at")


@query("statement_coverage", "statements", oracle="""
    SELECT stock, year, CASE WHEN bool_or(basis = 'CFS') THEN 'CFS' ELSE 'OFS' END AS basis
    FROM statements GROUP BY stock, year""")
def _(t):
    return fu.statement_coverage(t.statements)


@query("pending_statements", "statements", "companies", oracle="""
    SELECT b.basis, c.stock FROM companies c, (SELECT unnest(['CFS', 'OFS']) AS basis) b
    WHERE NOT EXISTS (SELECT 1 FROM statements s WHERE s.stock = c.stock AND s.year = 1994 AND s.basis = b.basis)""")
def _(t):
    codes = t.companies.select(F.col("stock").alias("code"))
    return union_all([fu.pending_statements(codes, t.statements.filter(F.col("basis") == basis), 1994).withColumn("basis", F.lit(basis))
                      for basis in ("CFS", "OFS")])


@query("pending_statements_any_basis", "statements", "companies", oracle="""
    SELECT stock FROM companies WHERE stock NOT IN (SELECT stock FROM statements WHERE year = 1994)""")
def _(t):
    return fu.pending_statements(t.companies.select(F.col("stock").alias("code")), t.statements, 1994)


# ---- universe and factors -------------------------------------------------------------------
@query("candidate_universe", "snapshots", oracle=f"""
    WITH {parts.CANDIDATES.replace('<= 100', '<= 20')}
    SELECT signal_date, code, name, market, round(marcap, 2) AS marcap, cast(cap_rank AS int) AS cap_rank
    FROM candidates""")
def _(t):
    found = rk.candidate_universe(t.snapshots, RankingRules(limit=20))
    return found.select("signal_date", "code", "name", "market", F.round("marcap", 2).alias("marcap"), "cap_rank")


@query("price_factors", "bars", "session_days", oracle=f"""
    WITH {parts.SCHEDULE}, {parts.FACTORS}
    SELECT code, signal_date, price, round(momentum, 6) AS momentum, round(volatility, 5) AS volatility, price_date,
           cast(history AS int) AS history, reason FROM factors""")
def _(t):
    found = rk.price_factors(t.bars, schedule(t))
    return found.withColumns({"momentum": F.round("momentum", 6), "volatility": F.round("volatility", 5)})


@query("price_factors_with_splits", "bars", "split_events", "session_days", oracle=f"""
    WITH {parts.SCHEDULE},
    ev AS (SELECT code, effective_date AS d, product(cast(ratio AS double)) AS r,
                  max(cast(left(published_at, 19) AS timestamp) - INTERVAL 9 HOUR) AS public
           FROM split_events GROUP BY code, effective_date),
    upto AS (SELECT code, d, product(r) OVER w AS f, max(public) OVER w AS public FROM ev WINDOW w AS (PARTITION BY code ORDER BY d)),
    adj AS (SELECT b.code, b.trade_date, b.close, coalesce(u.f, 1) AS f, b.close * coalesce(u.f, 1) AS c
            FROM bars b ASOF LEFT JOIN upto u ON u.code = b.code AND b.trade_date >= u.d),
    steps AS (SELECT *, c / lag(c) OVER w - 1 AS r, row_number() OVER w AS n, lag(c, 251) OVER w AS c0
              FROM adj WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    spread AS (SELECT *, stddev_samp(r) OVER (PARTITION BY code ORDER BY trade_date
                                              ROWS BETWEEN 250 PRECEDING AND CURRENT ROW) AS sd FROM steps),
    seen AS (SELECT g.code, g.signal_date, s.* EXCLUDE (code)
             FROM (SELECT DISTINCT bars.code, sched.signal_date FROM bars, sched) g
             ASOF JOIN spread s ON s.code = g.code AND g.signal_date >= s.trade_date),
    told AS (SELECT s.*, coalesce(u.f, 1) AS sf, coalesce(u.public > cast(s.signal_date AS timestamp) + INTERVAL 390 MINUTE, false) AS hidden
             FROM seen s ASOF LEFT JOIN upto u ON u.code = s.code AND s.signal_date >= u.d)
    SELECT code, signal_date, CASE WHEN NOT hidden THEN round(close / (sf / f), 6) END AS price,
           CASE WHEN n >= 252 AND NOT hidden THEN round((c / c0 - 1) * 100, 6) END AS momentum,
           CASE WHEN n >= 252 AND NOT hidden THEN round(sd * sqrt(252) * 100, 5) END AS volatility, trade_date AS price_date,
           CASE WHEN hidden THEN 'split_not_public' WHEN n < 252 THEN 'short_history' END AS reason
    FROM told""")
def _(t):
    found = rk.price_factors(t.bars, schedule(t), splits=t.split_events)
    return found.select(
        "code", "signal_date", F.round("price", 6).alias("price"), F.round("momentum", 6).alias("momentum"),
        F.round("volatility", 5).alias("volatility"), "price_date", "reason"
    )


@query("latest_prices", "bars", oracle="""
    SELECT code, max_by(close, trade_date) AS price, max(trade_date) AS price_date FROM bars
    WHERE trade_date <= DATE '1999-12-31' AND close > 0 GROUP BY code""")
def _(t):
    return rk.latest_prices(t.bars, "1999-12-31")


SCORE_ORACLE = """
    WITH d AS (SELECT signal_date, code, marcap AS price, amount AS momentum, marcap / amount AS value,
                      floor(amount / 1e9) AS quality, marcap AS volatility, marcap AS market_cap, amount AS turnover
               FROM snapshots WHERE marcap >= 1e11 AND amount >= 1e9 AND market <> 'KONEX'),
    s AS (SELECT *, (rank() OVER (g ORDER BY momentum) + count(*) OVER (g ORDER BY momentum)) / 2.0 / count(*) OVER g
                    * 100 AS m,
               (rank() OVER (g ORDER BY value) + count(*) OVER (g ORDER BY value)) / 2.0 / count(*) OVER g * 100 AS v,
               (rank() OVER (g ORDER BY quality) + count(*) OVER (g ORDER BY quality)) / 2.0 / count(*) OVER g * 100 AS q,
               (rank() OVER (g ORDER BY volatility DESC) + count(*) OVER (g ORDER BY volatility DESC)) / 2.0
                    / count(*) OVER g * 100 AS o
          FROM d WINDOW g AS (PARTITION BY signal_date))
    SELECT signal_date, code, round(m, 6) AS momentum_score, round(v, 6) AS value_score, round(q, 6) AS quality_score,
           round(o, 6) AS volatility_score,
           round(m * 45 / 100 + v * 20 / 100 + q * 20 / 100 + o * 15 / 100, 6) AS score FROM s"""


def scoring_rows(t: Inputs):
    return t.snapshots.select(
        "signal_date", "code", F.col("marcap").alias("price"), F.col("amount").alias("momentum"),
        (F.col("marcap") / F.col("amount")).alias("value"), F.floor(F.col("amount") / 1e9).cast("double").alias("quality"),
        F.col("marcap").alias("volatility"), F.col("marcap").alias("market_cap"), F.col("amount").alias("turnover"),
        (F.col("market") != "KONEX").alias("eligible"),
    )


def rounded_scores(df):
    names = ["momentum_score", "value_score", "quality_score", "volatility_score", "score"]
    return df.select("signal_date", "code", *[F.round(n, 6).alias(n) for n in names])


@query("score", "snapshots", oracle=SCORE_ORACLE)
def _(t):
    return rounded_scores(rk.score(scoring_rows(t)))


@query("score_wide", "snapshots", oracle=SCORE_ORACLE)
def _(t):
    return rounded_scores(rk.score_wide(scoring_rows(t)))


# ---- weekly panel ---------------------------------------------------------------------------
RANKED_COLUMNS = """signal_date, code, name, rank, round(score, 6) AS score, price, round(momentum, 6) AS momentum,
    round(value, 6) AS value, round(quality, 6) AS quality, round(volatility, 5) AS volatility, price_date"""


@query("weekly_ranking", *parts.RANKING_TABLES, oracle=f"""
    WITH {parts.RANKING} SELECT {RANKED_COLUMNS}, filed_at AS filing_date, basis AS statement_basis FROM ranked""")
def weekly_ranking(t):
    ranked, _ = weekly.rank_weeks(inputs(t))
    return ranked.selectExpr(
        "signal_date", "code", "name", "rank", "round(score, 6) AS score", "price", "round(momentum, 6) AS momentum",
        "round(value, 6) AS value", "round(quality, 6) AS quality", "round(volatility, 5) AS volatility", "price_date",
        "filing_date", "statement_basis",
    )


@query("ranking_exclusions", *parts.RANKING_TABLES, oracle=f"""
    WITH {parts.RANKING} SELECT signal_date, code, name, reason FROM checked WHERE reason IS NOT NULL""")
def _(t):
    return weekly.rank_weeks(inputs(t))[1]


@query("week_panel", "snapshots", "bars", "session_days", oracle=f"""
    WITH {parts.SCHEDULE}
    SELECT s.signal_date, sched.execution_date, s.code, s.name, s.market, round(s.marcap, 2) AS marcap,
           b.open AS next_open
    FROM snapshots s JOIN sched ON sched.signal_date = s.signal_date
    LEFT JOIN bars b ON b.code = s.code AND b.trade_date = sched.execution_date""")
def _(t):
    panel, _ = rk.week_panel(schedule(t), t.snapshots, t.bars)
    return panel.select(
        "signal_date", "execution_date", "code", "name", "market", F.round("marcap", 2).alias("marcap"), "next_open"
    )


@query("week_panel_issues", "snapshots", "bars", "session_days", oracle=f"""
    WITH {parts.SCHEDULE}
    SELECT 'no_next_open' AS rule_id, s.code AS subject, s.signal_date AS date
    FROM snapshots s JOIN sched ON sched.signal_date = s.signal_date
    LEFT JOIN bars b ON b.code = s.code AND b.trade_date = sched.execution_date WHERE b.code IS NULL""")
def _(t):
    return rk.week_panel(schedule(t), t.snapshots, t.bars)[1].select("rule_id", "subject", "date")


@query("week_readiness", *parts.RANKING_TABLES, oracle=f"""
    WITH {parts.RANKING}
    SELECT s.signal_date, s.execution_date, count(r.code) AS ranked, count(r.code) >= 30 AS ready
    FROM sched s LEFT JOIN ranked r ON r.signal_date = s.signal_date GROUP BY s.signal_date, s.execution_date""")
def _(t):
    rules = RankingRules(minimum_ready=30)
    desk = inputs(t)
    return rk.week_readiness(schedule(t), weekly.rank_weeks(desk, rules)[0], rules)


@query("filings_used", *parts.RANKING_TABLES, oracle=f"""
    WITH {parts.RANKING} SELECT signal_date, code AS stock, year, basis, receipt, filed_at FROM ranked""")
def _(t):
    return rk.filings_used(weekly.rank_weeks(inputs(t))[0])


@query("readiness_report", *parts.RANKING_TABLES, "index_bars", oracle=f"""
    WITH {parts.RANKING},
    w AS (SELECT s.signal_date, count(r.code) >= 30 AS ready FROM sched s
          LEFT JOIN ranked r ON r.signal_date = s.signal_date
          WHERE s.signal_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND s.execution_date <= DATE '1999-12-31'
          GROUP BY s.signal_date),
    u AS (SELECT session_date FROM session_days WHERE session_date < DATE '1997-01-01'
          ORDER BY session_date DESC LIMIT 1 OFFSET 251)
    SELECT count(*) FILTER (ready) AS valid_weeks, count(*) FILTER (NOT ready) AS invalid_weeks,
           count(*) FILTER (NOT ready) > 0 AS blocking, (SELECT session_date FROM u) AS warmup_start,
           '' AS missing_inputs FROM w""")
def _(t):
    return weekly.readiness_report(
        inputs(t), t.index_bars, "1997-01-01", "1999-12-31", RankingRules(minimum_ready=30)
    ).drop("locks")


@query("blocking_actions", "actions", "session_days", oracle="""
    WITH s AS (SELECT min(session_date) AS a FROM (SELECT session_date FROM session_days
               WHERE session_date <= DATE '1998-01-02' ORDER BY session_date DESC LIMIT 252))
    SELECT code, effective_date, action_type, status,
           CASE WHEN status = 'validated' THEN 'not_applied' ELSE 'not_validated' END AS reason
    FROM actions, s WHERE cast(effective_date AS date) BETWEEN a AND DATE '1998-12-31'""")
def _(t):
    return rk.blocking_actions(t.actions, sessions(t), "1998-01-02", "1998-12-31")


@query("search_ranking", "snapshots", oracle="""
    SELECT signal_date, code, name, sector FROM snapshots
    WHERE (contains(name, '스팩') OR contains(code, '스팩')) AND sector <> ''""")
def _(t):
    return rk.search_ranking(t.snapshots, "스팩").filter("sector <> ''").select("signal_date", "code", "name", "sector")


@query("sector_counts", *parts.RANKING_TABLES, oracle=f"""
    WITH {parts.RANKING} SELECT signal_date, sector, count(*) AS names FROM ranked WHERE rank <= 20
    GROUP BY signal_date, sector""")
def _(t):
    ranked, _ = weekly.rank_weeks(inputs(t))
    return rk.sector_counts(ranked.filter("rank <= 20"), ["signal_date"])


@query("position_sheet", "snapshots", "holdings", "accounts", "bars", oracle=f"""
    WITH {parts.CANDIDATES},
    h AS (SELECT a.signal_date, h.code, sum(cast(trunc(h.quantity) AS bigint)) AS quantity
          FROM holdings h JOIN accounts a ON a.account = h.account GROUP BY a.signal_date, h.code),
    c AS (SELECT * FROM candidates WHERE signal_date IN (SELECT signal_date FROM accounts)),
    p AS (SELECT code, max_by(close, trade_date) AS price FROM bars WHERE trade_date <= DATE '2001-12-31' GROUP BY code)
    SELECT coalesce(c.signal_date, h.signal_date) AS signal_date, coalesce(c.code, h.code) AS code,
           coalesce(c.name, s.name, h.code) AS name, p.price, cast(coalesce(h.quantity, 0) AS bigint) AS quantity,
           c.code IS NOT NULL AS is_candidate
    FROM c FULL JOIN h ON h.signal_date = c.signal_date AND h.code = c.code
    LEFT JOIN snapshots s ON s.signal_date = h.signal_date AND s.code = h.code
    LEFT JOIN p ON p.code = coalesce(c.code, h.code)""")
def _(t):
    dates = t.accounts.select("signal_date").distinct()
    candidates = rk.candidate_universe(t.snapshots).join(dates, "signal_date", "left_semi")
    held = t.holdings.join(t.accounts, "account").groupBy("signal_date", "code").agg(
        F.sum(F.col("quantity").cast("long")).alias("quantity")
    )
    prices = rk.latest_prices(t.bars, "2001-12-31").select("code", "price")
    return rk.position_sheet(candidates, held, t.snapshots, prices)
