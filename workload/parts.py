"""Pieces of check SQL used by several queries."""

SCHEDULE = """sched AS (
    SELECT signal_date, execution_date FROM (
        SELECT session_date AS signal_date, lead(session_date) OVER (ORDER BY session_date) AS execution_date,
               max(session_date) OVER (PARTITION BY date_trunc('week', session_date + 2)) AS last_day
        FROM session_days) WHERE signal_date = last_day AND execution_date IS NOT NULL)"""

FACTORS = """bar_steps AS (
    SELECT code, trade_date, close, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS n,
           lag(close, 251) OVER w AS c0
    FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
bar_factors AS (
    SELECT *, stddev_samp(r) OVER (PARTITION BY code ORDER BY trade_date
                                   ROWS BETWEEN 250 PRECEDING AND CURRENT ROW) AS sd FROM bar_steps),
factors AS (
    SELECT g.code, g.signal_date, f.close AS price, CASE WHEN n >= 252 THEN (close / c0 - 1) * 100 END AS momentum,
           CASE WHEN n >= 252 THEN sd * sqrt(252) * 100 END AS volatility, f.trade_date AS price_date, f.n AS history,
           CASE WHEN n < 252 THEN 'short_history' END AS reason
    FROM (SELECT DISTINCT bars.code, sched.signal_date FROM bars, sched) g
    ASOF JOIN bar_factors f ON f.code = g.code AND g.signal_date >= f.trade_date)"""

CANDIDATES = """candidates AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY marcap DESC, code) AS cap_rank FROM snapshots
        WHERE market IN ('KOSPI', 'KOSDAQ') AND regexp_full_match(code, '[0-9]{6}') AND marcap > 0 AND amount > 0
              AND NOT regexp_matches(name, '(우$|우B$|스팩|리츠|REIT)', 'i')) WHERE cap_rank <= 100)"""

CHOSEN = """chosen AS (
    SELECT stock AS code, signal_date, year, basis, receipt, filed_at FROM (
        SELECT s.*, sched.signal_date,
               row_number() OVER (PARTITION BY stock, sched.signal_date
                                  ORDER BY year DESC, basis = 'CFS' DESC, filed_at DESC, receipt DESC) AS k
        FROM statements s JOIN sched ON s.filed_at <= sched.signal_date) WHERE k = 1)"""

METRICS = """acc AS (
    SELECT *, try_cast(replace(thstrm_amount, ',', '') AS decimal(38,10)) AS a1,
           try_cast(replace(frmtrm_amount, ',', '') AS decimal(38,10)) AS a2,
           CASE WHEN sj_div IN ('IS', 'CIS') AND account_id IN (
                    'ifrs-full_ProfitLoss' || CASE basis WHEN 'CFS' THEN 'AttributableToOwnersOfParent' ELSE '' END,
                    'ifrs_ProfitLoss' || CASE basis WHEN 'CFS' THEN 'AttributableToOwnersOfParent' ELSE '' END)
                THEN 'p'
                WHEN sj_div = 'BS' AND account_id IN (
                    'ifrs-full_Equity' || CASE basis WHEN 'CFS' THEN 'AttributableToOwnersOfParent' ELSE '' END,
                    'ifrs_Equity' || CASE basis WHEN 'CFS' THEN 'AttributableToOwnersOfParent' ELSE '' END)
                THEN 'e' END AS kind
    FROM statement_accounts),
filing_sums AS (
    SELECT stock, year, basis, receipt, min(nullif(corp_code, '')) AS c1, max(nullif(corp_code, '')) AS c2,
           count(*) FILTER (kind = 'p') AS pn, count(*) FILTER (kind = 'p' AND currency IS DISTINCT FROM 'KRW') AS pf,
           count(*) FILTER (kind = 'p' AND a1 IS NULL) AS pb, count(DISTINCT a1) FILTER (kind = 'p') AS pd,
           max(a1) FILTER (kind = 'p') AS profit,
           count(*) FILTER (kind = 'e') AS en, count(*) FILTER (kind = 'e' AND currency IS DISTINCT FROM 'KRW') AS ef,
           count(*) FILTER (kind = 'e' AND (a1 IS NULL OR a2 IS NULL)) AS eb,
           count(DISTINCT (a1, a2)) FILTER (kind = 'e') AS ed,
           max(a1) FILTER (kind = 'e') AS equity, max(a2) FILTER (kind = 'e') AS previous_equity
    FROM acc GROUP BY stock, year, basis, receipt),
filing_checks AS (
    SELECT *, CASE WHEN pn = 0 THEN 'profit_missing' WHEN pf > 0 THEN 'profit_not_krw'
                   WHEN pb > 0 THEN 'profit_not_numeric' WHEN pd > 1 THEN 'profit_ambiguous'
                   WHEN en = 0 THEN 'equity_missing' WHEN ef > 0 THEN 'equity_not_krw'
                   WHEN eb > 0 THEN 'equity_not_numeric' WHEN ed > 1 THEN 'equity_ambiguous'
                   WHEN equity <= 0 OR previous_equity <= 0 THEN 'equity_not_positive' END AS reason
    FROM filing_sums),
metrics AS (
    SELECT stock, year, basis, receipt, c1, c2, reason, CASE WHEN reason IS NULL THEN profit END AS profit,
           CASE WHEN reason IS NULL THEN equity END AS equity,
           CASE WHEN reason IS NULL THEN previous_equity END AS previous_equity,
           CASE WHEN reason IS NULL THEN cast(profit AS double)
                / (cast(equity + previous_equity AS double) / 2) * 100 END AS roe
    FROM filing_checks)"""

JOINED = """checked AS (
    SELECT c.signal_date, c.code, c.name, c.sector, c.marcap, c.amount, f.price, f.momentum, f.volatility,
           f.price_date, h.year, h.basis, h.receipt, h.filed_at, m.profit, m.roe,
           CASE WHEN f.price IS NULL OR f.reason IS NOT NULL THEN 'short_history'
                WHEN h.receipt IS NULL THEN 'no_visible_filing'
                WHEN k.stock IS NULL THEN 'company_missing'
                WHEN NOT coalesce(regexp_full_match(k.corp_code, '[0-9]{8}'), false) THEN 'corp_code_invalid'
                WHEN m.c1 <> k.corp_code OR m.c2 <> k.corp_code THEN 'issuer_mismatch'
                ELSE m.reason END AS reason
    FROM candidates c JOIN sched USING (signal_date) LEFT JOIN factors f ON f.code = c.code AND f.signal_date = c.signal_date
    LEFT JOIN chosen h ON h.code = c.code AND h.signal_date = c.signal_date
    LEFT JOIN metrics m ON m.stock = c.code AND m.year = h.year AND m.basis = h.basis AND m.receipt = h.receipt
    LEFT JOIN companies k ON k.stock = c.code)"""

RANKED = """usable AS (
    SELECT *, cast(profit AS double) / marcap * 100 AS value, roe AS quality FROM checked
    WHERE reason IS NULL AND marcap >= 1e11 AND amount >= 1e9 AND isfinite(momentum) AND isfinite(volatility)),
scores AS (
    SELECT *, (rank() OVER (g ORDER BY momentum) + count(*) OVER (g ORDER BY momentum)) / 2.0
                 / count(*) OVER g * 100 AS momentum_score,
           (rank() OVER (g ORDER BY value) + count(*) OVER (g ORDER BY value)) / 2.0
                 / count(*) OVER g * 100 AS value_score,
           (rank() OVER (g ORDER BY quality) + count(*) OVER (g ORDER BY quality)) / 2.0
                 / count(*) OVER g * 100 AS quality_score,
           (rank() OVER (g ORDER BY volatility DESC) + count(*) OVER (g ORDER BY volatility DESC)) / 2.0
                 / count(*) OVER g * 100 AS volatility_score
    FROM usable WINDOW g AS (PARTITION BY signal_date)),
totals AS (
    SELECT *, 0.0 + momentum_score * 45 / 100 + value_score * 20 / 100 + quality_score * 20 / 100
              + volatility_score * 15 / 100 AS score FROM scores),
ranked AS (
    SELECT *, cast(row_number() OVER (PARTITION BY signal_date ORDER BY score DESC, code) AS int) AS rank
    FROM totals)"""

RANKING_TABLES = ["session_days", "bars", "snapshots", "statements", "statement_accounts", "companies"]
RANKING = ", ".join([SCHEDULE, FACTORS, CANDIDATES, CHOSEN, METRICS, JOINED, RANKED])


# ---- fingerprints ---------------------------------------------------------------------------
COUNTED = "count(h)"
FINGERPRINT = "sha256(count(h) || " + " || ".join(
    f"':' || coalesce(sum(cast('0x' || substr(h, {1 + 15 * k}, 15) AS hugeint)), 0)" for k in range(4)) + ")"


def digests(table: str, columns: str) -> str:
    """Row digests ``h`` over columns named in alphabetical order, each value after its length."""
    texts = [f"'{c}' || coalesce('=' || length(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '~')" for c in columns.split()]
    return f"SELECT sha256({' || chr(31) || '.join(texts)}) AS h FROM {table}"


def model_fingerprint(tables: dict[str, str]) -> str:
    """One fingerprint over named digest queries."""
    parts = [f"SELECT '{name}=' || {FINGERPRINT} AS part FROM ({text})" for name, text in sorted(tables.items())]
    return f"SELECT sha256(string_agg(part, ';' ORDER BY part)) AS fingerprint FROM ({' UNION ALL '.join(parts)})"


def leaves(table: str, source: str, columns: str, day: str) -> str:
    """Digest tree leaves of a table: counts and sums by day and first hex digit of the row digest."""
    sums = ", ".join(f"sum(cast('0x' || substr(h, {1 + 15 * k}, 15) AS hugeint)) AS w{k}" for k in range(4))
    body = digests(source, columns).replace("SELECT sha256", f"SELECT {day} AS day, sha256", 1)
    return f"SELECT '{table}' AS table_name, day, left(h, 1) AS bucket, count(*) AS n, {sums} FROM ({body}) GROUP BY day, left(h, 1)"
