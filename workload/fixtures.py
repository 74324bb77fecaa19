"""Canonical tables derived from the driver tables, as SQL both engines read.

Each entry is one query over driver tables and earlier entries.  Spark and the
check engine derive the inputs from the same text; what is compared are the operators.
"""

from __future__ import annotations

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

TABLES: dict[str, tuple[list[str], str]] = {
    # ---- market -----------------------------------------------------------------------------
    "bars": (["lineitem"], """
        SELECT lpad(cast(l_suppkey AS string), 6, '0') AS code, cast(l_shipdate AS date) AS trade_date,
               floor((min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) * 5000) / 10000 AS open,
               floor(max(l_extendedprice / l_quantity) * 10000) / 10000 AS high,
               floor(min(l_extendedprice / l_quantity) * 10000) / 10000 AS low,
               floor(10000 * cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double)
                     / cast(sum(cast(l_quantity AS decimal(18,2))) AS double)) / 10000 AS close,
               cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS volume,
               cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS amount
        FROM lineitem GROUP BY l_suppkey, cast(l_shipdate AS date)"""),
    "session_days": (["lineitem"], "SELECT DISTINCT cast(l_shipdate AS date) AS session_date FROM lineitem"),
    "weeks": (["session_days"], """
        SELECT cast(date_trunc('week', session_date + 2) AS date) AS week_key, max(session_date) AS signal_date
        FROM session_days GROUP BY cast(date_trunc('week', session_date + 2) AS date)"""),
    "dim": (["supplier", "nation"], """
        SELECT lpad(cast(s_suppkey AS string), 6, '0') AS code,
               s_name || CASE WHEN s_suppkey % 17 = 3 THEN ' REIT' WHEN s_suppkey % 19 = 5 THEN '스팩'
                              WHEN s_suppkey % 23 = 7 THEN '우' ELSE '' END AS name,
               CASE WHEN n_regionkey < 2 THEN 'KOSPI' WHEN n_regionkey < 4 THEN 'KOSDAQ' ELSE 'KONEX' END AS market,
               n_name AS sector,
               cast(100000000 AS double) * (1 + s_suppkey % 7) AS shares
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "snapshots": (["bars", "weeks", "dim"], """
        SELECT w.signal_date, b.code, d.name, d.market, 'common' AS security_type, d.sector,
               max_by(b.close, b.trade_date) * d.shares AS marcap,
               max_by(b.amount, b.trade_date) * 100000 AS amount
        FROM bars b JOIN weeks w ON cast(date_trunc('week', b.trade_date + 2) AS date) = w.week_key
             JOIN dim d ON d.code = b.code
        GROUP BY w.signal_date, b.code, d.name, d.market, d.sector, d.shares"""),
    "index_bars": (["bars", "dim"], """
        SELECT d.market AS symbol, b.trade_date,
               cast(sum(cast(b.open AS decimal(18,4))) AS double) / count(*) AS open,
               cast(sum(cast(b.close AS decimal(18,4))) AS double) / count(*) AS close
        FROM bars b JOIN dim d ON d.code = b.code
        WHERE d.market IN ('KOSPI', 'KOSDAQ') GROUP BY d.market, b.trade_date"""),
    "daily_market": (["bars", "dim"], """
        SELECT b.trade_date, b.code, d.name, d.market, '' AS segment, b.open, b.high, b.low, b.close, b.volume,
               b.amount, b.close * d.shares AS marcap,
               CASE WHEN b.trade_date >= DATE '1998-06-01' AND b.amount > 60000 THEN d.shares * 1.25
                    ELSE d.shares END AS listed_shares,
               cast(year(b.trade_date) * 10000 + month(b.trade_date) * 100 + day(b.trade_date) AS bigint)
                   AS raw_version_id
        FROM bars b JOIN dim d ON d.code = b.code"""),
    "raw_daily": (["lineitem", "dim"], """
        SELECT cast(l_shipdate AS date) AS requested_date,
               replace(cast(cast(l_shipdate AS date) AS string), '-', '') AS basDt,
               cast(l_suppkey AS string) || CASE WHEN l_linenumber = 1 THEN '.0' ELSE '' END AS srtnCd,
               ' ' || d.name || ' ' AS itmsNm,
               lower(d.market) || CASE WHEN l_linenumber = 2 THEN ' global' ELSE '' END AS mrktCtg,
               CASE WHEN l_returnflag = 'R' THEN '' ELSE cast(cast(l_extendedprice AS decimal(18,2)) AS string) END
                   AS mkp,
               cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS hipr,
               cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS lopr,
               CASE WHEN l_tax = 0 THEN 'n/a' ELSE '1,' || lpad(cast(cast(l_quantity AS bigint) AS string), 3, '0') END
                   AS clpr,
               cast(cast(l_quantity AS bigint) AS string) AS trqu,
               cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS trPrc,
               cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS mrktTotAmt,
               '12,345,678' AS lstgStCnt
        FROM lineitem JOIN dim d ON d.code = lpad(cast(l_suppkey AS string), 6, '0')"""),
    "listing_days": (["lineitem", "dim"], """
        SELECT cast(l_shipdate AS date) AS day, d.code, d.name, d.market,
               CASE WHEN l_discount = 0.1 THEN NULL ELSE l_extendedprice END AS marcap,
               CASE WHEN l_tax = 0.08 AND l_quantity < 20 THEN 0.0 ELSE l_quantity END AS amount
        FROM lineitem JOIN dim d ON d.code = lpad(cast(l_suppkey AS string), 6, '0')"""),
    # ---- filings ----------------------------------------------------------------------------
    "companies": (["supplier"], """
        SELECT lpad(cast(s_suppkey AS string), 6, '0') AS stock,
               CASE WHEN s_suppkey % 31 = 12 THEN 'BAD' WHEN s_suppkey % 29 = 11 THEN NULL
                    ELSE lpad(cast(s_suppkey * 7 + 1 AS string), 8, '0') END AS corp_code,
               s_name AS name
        FROM supplier"""),
    "statements": (["lineitem", "orders"], """
        SELECT lpad(cast(l_suppkey AS string), 6, '0') AS stock, year(cast(o_orderdate AS date)) - 1 AS year,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CFS' ELSE 'OFS' END AS basis,
               lpad(cast(o_orderkey AS string), 14, '0') AS receipt, cast(o_orderdate AS date) AS filed_at,
               o_orderkey, l_suppkey, o_totalprice,
               sum(cast(floor(l_extendedprice * (1 - l_discount)) AS decimal(18,2))) AS profit
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_suppkey, o_orderkey, o_orderdate, o_orderpriority, o_totalprice"""),
    "statement_accounts": (["statements"], """
        SELECT stock, year, basis, receipt, filed_at,
               CASE WHEN o_orderkey % 59 = 0 THEN '99999999'
                    ELSE lpad(cast(l_suppkey * 7 + 1 AS string), 8, '0') END AS corp_code,
               CASE WHEN o_orderkey % 2 = 0 THEN 'ifrs-full_' ELSE 'ifrs_' END
               || CASE WHEN o_orderkey % 53 = 0 THEN 'Other' WHEN basis = 'CFS'
                       THEN 'ProfitLossAttributableToOwnersOfParent' ELSE 'ProfitLoss' END AS account_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'CIS' ELSE 'IS' END AS sj_div,
               cast(profit AS string) AS thstrm_amount, cast(NULL AS string) AS frmtrm_amount,
               CASE WHEN o_orderkey % 43 = 0 THEN 'USD' ELSE 'KRW' END AS currency
        FROM statements
        UNION ALL
        SELECT stock, year, basis, receipt, filed_at, lpad(cast(l_suppkey * 7 + 1 AS string), 8, '0'),
               CASE WHEN basis = 'CFS' THEN 'ifrs-full_EquityAttributableToOwnersOfParent'
                    ELSE 'ifrs-full_Equity' END,
               'BS',
               CASE WHEN o_orderkey % 61 = 0 THEN 'x' WHEN o_orderkey % 41 = 0 THEN '-1.00'
                    ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END,
               cast(cast(floor(o_totalprice * 0.95) AS decimal(18,2)) AS string), 'KRW'
        FROM statements
        UNION ALL
        SELECT stock, year, basis, receipt, filed_at, lpad(cast(l_suppkey * 7 + 1 AS string), 8, '0'),
               CASE WHEN basis = 'CFS' THEN 'ifrs-full_ProfitLossAttributableToOwnersOfParent'
                    ELSE 'ifrs-full_ProfitLoss' END,
               'IS', CASE WHEN o_orderkey % 47 = 0 THEN cast(profit + 1 AS string) WHEN o_orderkey % 37 = 5
                         THEN cast(profit AS string) || '001' ELSE cast(profit AS string) END,
               cast(NULL AS string), CASE WHEN o_orderkey % 43 = 0 THEN 'USD' ELSE 'KRW' END
        FROM statements WHERE o_orderkey % 53 <> 0 AND o_orderkey % 2 = 0"""),
    "candidates_listing": (["dim", "bars"], """
        SELECT d.code, d.name, d.market, d.sector, sum(b.volume) * 1e7 AS marcap, sum(b.volume) AS amount
        FROM dim d JOIN bars b ON b.code = d.code GROUP BY d.code, d.name, d.market, d.sector"""),
    # ---- corporate actions ------------------------------------------------------------------
    "split_events": (["orders", "lineitem"], """
        SELECT lpad(cast(l_suppkey AS string), 6, '0') AS code, cast(o_orderdate AS date) AS effective_date,
               cast(cast(o_orderdate AS date) + (CASE WHEN min(o_orderkey) % 11 = 0 THEN 1 ELSE -1 END) AS string)
                   || 'T08:00:00+09:00' AS published_at,
               CASE WHEN min(o_orderkey) % 2 = 0 THEN 'split' ELSE 'reverse_split' END AS action_type,
               cast(CASE WHEN min(o_orderkey) % 2 = 0 THEN 2 ELSE 0.5 END AS decimal(18,9)) AS ratio,
               'validated' AS status, 'src-' || cast(min(o_orderkey) AS string) AS source_fingerprint
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND l_returnflag = 'R' AND l_linenumber = 1
        GROUP BY l_suppkey, cast(o_orderdate AS date)"""),
    "raw_split_events": (["orders", "lineitem"], """
        SELECT lpad(cast(l_suppkey AS string), 6, '0') AS code,
               CASE WHEN o_orderkey % 71 = 0 THEN 'soon' ELSE cast(cast(o_orderdate AS date) AS string) END
                   AS effective_date,
               cast(cast(o_orderdate AS date) AS string)
                   || CASE WHEN o_orderkey % 37 = 0 THEN 'T08:00:00' ELSE 'T08:00:00+09:00' END AS published_at,
               CASE WHEN o_orderkey % 29 = 0 THEN 'merger' WHEN o_orderkey % 2 = 0 THEN 'split'
                    ELSE 'reverse_split' END AS action_type,
               CASE WHEN o_orderkey % 31 = 0 THEN '-1' WHEN o_orderkey % 67 = 0 THEN '0.3333333333333'
                    ELSE '2' END AS ratio,
               CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'validated' END AS status,
               CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'src-' || cast(o_orderkey AS string) END
                   AS source_fingerprint
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'"""),
    "price_basis": (["supplier"], """
        SELECT lpad(cast(s_suppkey AS string), 6, '0') AS code,
               CASE WHEN s_acctbal < 0 THEN 'adjusted' ELSE 'raw' END AS basis, 'provider' AS provider,
               '2024-01-01T00:00:00+09:00' AS retrieved_at, 'v1' AS source_version,
               'fp-' || cast(s_suppkey AS string) AS fingerprint
        FROM supplier"""),
    "actions": (["orders", "lineitem"], """
        SELECT cast(l_suppkey AS string) AS code, cast(cast(o_orderdate AS date) AS string) AS effective_date,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'split'
                    ELSE 'dividend' END AS action_type,
               cast(2 AS double) AS ratio, cast(NULL AS double) AS cash_amount,
               CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'validated' END AS status, 'exchange' AS source,
               o_orderkey * 10 + l_linenumber AS seq
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'"""),
    # ---- accounts ---------------------------------------------------------------------------
    "last_signals": (["weeks", "session_days"], """
        SELECT signal_date, cast(row_number() OVER (ORDER BY signal_date DESC) AS int) AS back
        FROM weeks WHERE signal_date < (SELECT max(session_date) FROM session_days)"""),
    "accounts": (["customer", "last_signals"], """
        SELECT cast(c_custkey AS string) AS account, s.signal_date,
               CASE WHEN c_custkey % 97 = 5 THEN cast(-1 AS double)
                    ELSE cast(cast(abs(c_acctbal) AS decimal(18,2)) * 10000 AS double) END AS cash
        FROM customer JOIN last_signals s ON s.back = 2 + c_custkey % 4"""),
    "holdings": (["customer", "orders", "lineitem"], """
        SELECT cast(c_custkey AS string) AS account, lpad(cast(l_suppkey AS string), 6, '0') AS code,
               cast(sum(cast(l_quantity AS decimal(18,2))) AS double)
               + CASE WHEN (c_custkey + l_suppkey) % 701 = 1 THEN 0.5 ELSE 0.0 END AS quantity
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY c_custkey, l_suppkey"""),
    # The signal of a bar's own week is the first that sees it; it then serves the later ones, too.
    "open_prices": (["bars", "weeks", "last_signals"], """
        SELECT s.signal_date, p.code, max_by(p.price, p.last_date) AS price
        FROM (SELECT code, price, last_date, unnest(generate_series(2, seen)) AS back
              FROM (SELECT b.code, least(l.back, 5) AS seen, max_by(b.open, b.trade_date) AS price, max(b.trade_date) AS last_date
                    FROM bars b JOIN weeks w ON cast(date_trunc('week', b.trade_date + 2) AS date) = w.week_key
                         JOIN last_signals l ON l.signal_date = w.signal_date
                    WHERE l.back >= 2 GROUP BY b.code, least(l.back, 5))) p
             JOIN last_signals s ON s.back = p.back
        GROUP BY s.signal_date, p.code"""),
    "board": (["snapshots", "open_prices"], """
        SELECT s.signal_date, s.code, s.name, s.sector, p.price,
               cast(row_number() OVER (PARTITION BY s.signal_date ORDER BY s.marcap DESC, s.code) AS int) AS rank
        FROM snapshots s JOIN open_prices p ON p.signal_date = s.signal_date AND p.code = s.code"""),
    "trades": (["customer", "orders", "lineitem"], """
        SELECT c_mktsegment AS portfolio, lpad(cast(l_suppkey AS string), 6, '0') AS code,
               cast(l_shipdate AS date) AS trade_date,
               CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
               cast(l_quantity AS double) AS quantity,
               floor(l_extendedprice / l_quantity * 100) / 100 AS price,
               o_orderkey * 10 + l_linenumber AS seq
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey"""),
    "cashflows": (["orders", "customer"], """
        SELECT c_mktsegment AS portfolio, CASE WHEN o_orderkey % 211 = 0 THEN 'soon'
                    ELSE replace(cast(cast(o_orderdate AS date) AS string), '-', '/') END AS date,
               CASE WHEN o_orderkey % 223 = 0 THEN 'NaN'
                    ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END AS amount,
               'deposit' AS kind, cast(NULL AS string) AS code
        FROM orders JOIN customer ON c_custkey = o_custkey"""),
    "nav_rows": (["orders", "customer"], """
        SELECT cast(c_nationkey AS string) AS portfolio, cast(o_orderdate AS date) AS date,
               cast(sum(cast(o_totalprice AS decimal(18,2))) AS double)
               - CASE WHEN c_nationkey = 3 AND min(o_orderkey) % 50 = 0 THEN 1e9 ELSE 0 END AS equity
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey, cast(o_orderdate AS date)"""),
    # ---- identity ---------------------------------------------------------------------------
    "first_orders": (["orders"], """
        SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date,
               min(o_orderkey) AS any_key FROM orders GROUP BY o_custkey"""),
    "raw_lifecycle": (["orders", "first_orders"], """
        SELECT o.o_orderkey AS source_row_number,
               CASE WHEN o.o_orderdate = f.first_date THEN 'security_master'
                    WHEN o.o_orderdate = f.last_date AND o.o_custkey % 5 = 0 THEN 'delistings'
                    WHEN o.o_orderstatus = 'F' THEN 'new_listings' ELSE 'identifier_changes' END AS dataset,
               'KR' || lpad(cast(o.o_custkey AS string), 10, '0') AS "표준코드",
               cast(CASE WHEN o.o_custkey % 10 = 9 THEN o.o_custkey - 1 ELSE o.o_custkey END AS string) AS "단축코드",
               ' corp ' || cast(o.o_custkey AS string) || '-' || cast(o.o_orderkey % 3 AS string) AS "종목명",
               CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'kospi'
                    WHEN o.o_orderpriority = '5-LOW' THEN 'KONEX' ELSE 'KOSDAQ GLOBAL' END AS "시장구분",
               CASE WHEN o.o_custkey % 13 = 1 THEN '우선주' WHEN o.o_custkey % 13 = 2 THEN '제1호스팩'
                    WHEN o.o_custkey % 13 = 3 THEN '' ELSE '보통주' END AS "주식종류",
               replace(cast(cast(f.first_date AS date) AS string), '-', '/') AS "상장일",
               CASE WHEN o.o_orderdate = f.last_date AND o.o_custkey % 5 = 0
                    THEN cast(cast(o.o_orderdate AS date) AS string) END AS "폐지일",
               CASE WHEN o.o_orderkey % 4 = 0 THEN 'I' || cast(o.o_custkey AS string) ELSE '' END AS "회사코드",
               CASE WHEN o.o_orderdate = f.first_date OR (o.o_orderdate = f.last_date AND o.o_custkey % 5 = 0) THEN ''
                    WHEN o.o_orderkey % 101 = 0 THEN 'merger' WHEN o.o_orderkey % 3 = 0 THEN 'name_change'
                    WHEN o.o_orderkey % 3 = 1 THEN 'market_transfer' ELSE '' END AS "변경구분",
               CASE WHEN o.o_orderdate = f.first_date OR (o.o_orderdate = f.last_date AND o.o_custkey % 5 = 0)
                    THEN '' ELSE replace(cast(cast(o.o_orderdate AS date) AS string), '-', '') END AS "변경일",
               CASE WHEN o.o_orderdate = f.first_date AND o.o_orderkey % 7 = 0
                    THEN 'old ' || cast(o.o_custkey AS string) END AS "이전종목명"
        FROM orders o JOIN first_orders f ON f.o_custkey = o.o_custkey"""),
    "lifecycle_rows": (["orders", "first_orders"], """
        SELECT CASE WHEN o.o_orderdate = f.first_date THEN 'security_master'
                    WHEN o.o_orderdate = f.last_date AND o.o_custkey % 5 = 0 THEN 'delistings'
                    WHEN o.o_orderstatus = 'F' THEN 'new_listings' ELSE 'identifier_changes' END AS dataset,
               cast(1 + o.o_orderkey % 4 AS bigint) AS raw_version_id, cast(o.o_orderkey AS bigint) AS source_row_number,
               'KR' || lpad(cast(o.o_custkey AS string), 10, '0') AS standard_code,
               lpad(cast(CASE WHEN o.o_custkey % 10 = 9 THEN o.o_custkey - 1 ELSE o.o_custkey END AS string), 6, '0')
                   AS short_code,
               'corp ' || cast(o.o_custkey AS string) || '-' || cast(o.o_orderkey % 3 AS string) AS name,
               CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'KOSPI'
                    WHEN o.o_orderpriority = '5-LOW' THEN 'KONEX' ELSE 'KOSDAQ' END AS market,
               CASE WHEN o.o_custkey % 13 = 1 THEN '우선주' WHEN o.o_custkey % 13 = 2 THEN '제1호스팩'
                    WHEN o.o_custkey % 13 = 3 THEN NULL ELSE '보통주' END AS stock_type,
               cast(f.first_date AS date) AS listing_date, cast(NULL AS date) AS last_trading_date,
               CASE WHEN o.o_orderdate = f.last_date AND o.o_custkey % 5 = 0 THEN cast(o.o_orderdate AS date) END
                   AS delisting_date,
               CASE WHEN o.o_orderkey % 4 = 0 THEN 'I' || cast(o.o_custkey AS string) END AS issuer_reference,
               CASE WHEN o.o_orderdate = f.first_date THEN 'listing'
                    WHEN o.o_orderdate = f.last_date AND o.o_custkey % 5 = 0 THEN 'delisting'
                    WHEN o.o_orderkey % 101 = 0 THEN 'merger' WHEN o.o_orderkey % 3 = 0 THEN 'name_change'
                    WHEN o.o_orderkey % 3 = 1 THEN 'market_transfer' ELSE 'identifier_change' END AS event_type,
               cast(o.o_orderdate AS date) AS effective_date, cast(NULL AS string) AS previous_code,
               CASE WHEN o.o_orderdate = f.first_date AND o.o_orderkey % 7 = 0
                    THEN 'old ' || cast(o.o_custkey AS string) END AS previous_name,
               cast(NULL AS string) AS previous_market, cast(NULL AS string) AS successor_standard_code
        FROM orders o JOIN first_orders f ON f.o_custkey = o.o_custkey"""),
    # ---- status -----------------------------------------------------------------------------
    "status_days": (["events"], "SELECT DISTINCT cast(ts AS date) AS session_date FROM events"),
    "raw_status": (["events"], """
        SELECT cast(ts AS date) AS requested_date, event_id AS source_row_number,
               cast(cast(ts AS date) AS string) AS "BAS_DD", cast(user_id AS string) AS "ISU_SRT_CD",
               'corp ' || cast(user_id AS string) AS "ISU_NM",
               CASE WHEN event_id % 3 = 0 THEN 'kospi' WHEN event_id % 31 = 1 THEN 'KONEX' ELSE 'KOSDAQ GLOBAL' END
                   AS "MKT_NM",
               CASE WHEN event_id % 5 = 0 THEN 'ETF' WHEN event_id % 5 = 1 THEN 'Preferred Stock'
                    ELSE 'common' END AS "KIND_STKCERT_TP_NM",
               CASE WHEN event_type = 'error' THEN 'Y' ELSE 'N' END AS "MANG_ITEM_YN",
               CASE WHEN event_type = 'signup' THEN '해당' WHEN event_id % 41 = 0 THEN '?' ELSE '미해당' END
                   AS "TRD_STOP_YN",
               CASE WHEN event_type = 'view' THEN '1' ELSE '0' END AS "CLSG_TRD_YN",
               CASE WHEN event_id % 7 = 0 THEN cast(cast(ts AS date) - 1 AS string) ELSE '' END AS "EFFECTIVE_DD"
        FROM events"""),
    "status_rows": (["events"], """
        SELECT 'daily_status' AS dataset,
               CASE WHEN day(cast(ts AS date)) IN (13, 21) THEN cast(ts AS date) + 1 ELSE cast(ts AS date) END
                   AS requested_date,
               cast(day(cast(ts AS date)) AS bigint) AS raw_version_id, event_id AS source_row_number,
               cast(ts AS timestamp) AS observed_at,
               CASE WHEN event_id % 2 = 0 THEN 'KR' || lpad(cast(user_id AS string), 10, '0') END AS standard_code,
               lpad(cast(user_id AS string), 6, '0') AS short_code,
               'KOSPI' AS market, 'common' AS security_kind,
               event_type = 'error' AS management_designation, event_type = 'signup' AS trading_suspension,
               event_type = 'purchase' AND event_id % 5 = 0 AS liquidation_trading,
               CASE WHEN event_id % 7 = 0 THEN cast(ts AS date) - 1 ELSE cast(ts AS date) END AS effective_date,
               CASE WHEN event_type <> 'view' THEN cast(ts AS timestamp) END AS published_at
        FROM events"""),
    "decision_requests": (["events"], """
        SELECT 'sec_' || left(sha256('lifecycle-v1:' || 'KR' || lpad(cast(user_id AS string), 10, '0')), 20)
                   AS security_id,
               cast(ts AS timestamp) AS as_of
        FROM events
        UNION
        SELECT 'sec_' || left(sha256('lifecycle-v1:' || 'KR' || lpad(cast(user_id AS string), 10, '0')), 20),
               cast(cast(cast(ts AS date) AS string) || ' 06:30:00' AS timestamp)
        FROM events"""),
    "state_log": (["events"], """
        SELECT user_id AS job_id, cast(ts AS date) AS trade_date, event_id AS seq, ts AS logged_at,
               CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'downloading'
                    WHEN 'view' THEN 'downloaded' WHEN 'purchase' THEN 'parsed' ELSE 'failed' END AS state,
               cast(1 + event_id % 4 AS int) AS attempts, 'k=' || props AS message
        FROM events"""),
    "designation_rows": (["events"], """
        SELECT 'file-' || lpad(cast(user_id AS string), 6, '0') AS file, lpad(cast(user_id AS string), 6, '0') AS code,
               'corp ' || cast(user_id AS string) AS name,
               CASE WHEN user_id % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market,
               cast(ts AS date) AS date,
               CASE max_by(event_type, event_id) WHEN 'error' THEN '지정' WHEN 'signup' THEN '해제' ELSE '-' END AS event,
               'reason' AS reason, max(event_id) AS source_row_number
        FROM events GROUP BY user_id, cast(ts AS date)"""),
    "halt_rows": (["events"], """
        SELECT 'file-' || lpad(cast(user_id AS string), 6, '0') AS file, lpad(cast(user_id AS string), 6, '0') AS code,
               'corp ' || cast(user_id AS string) AS name,
               CASE WHEN user_id % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market,
               min(cast(ts AS date)) AS halt_date,
               CASE WHEN week = 5 AND user_id % 4 = 0 THEN NULL
                    ELSE max(cast(ts AS date)) + cast(user_id % 3 AS int) END AS resume_date,
               min(event_id) AS source_row_number
        FROM (SELECT *, cast(floor((day(cast(ts AS date)) - 1) / 7.0) AS int) + 1 AS week FROM events) e
        GROUP BY user_id, week"""),
    # ---- landed payloads --------------------------------------------------------------------
    "landing": (["documents"], """
        SELECT doc_id AS landing_seq, source AS dataset, lang AS scope, text AS content FROM documents"""),
    "versions": (["documents"], """
        SELECT cast(row_number() OVER (ORDER BY min(doc_id)) AS bigint) AS raw_version_id, source AS dataset,
               lang AS scope, sha256(text) AS sha256, min(doc_id) AS first_seen
        FROM documents GROUP BY source, lang, sha256(text)"""),
    "selections": (["documents"], """
        SELECT source AS dataset, lang AS scope, min(doc_id) AS first_doc,
               CASE WHEN count(*) % 2 = 0 THEN ' ' ELSE 'reviewed' END AS reason
        FROM documents WHERE lang <> 'de' GROUP BY source, lang"""),
}

#: Spark's way to the same rows where the text above reads its inputs several times: one statement row gives all its account rows.
SPARK_TABLES: dict[str, str] = {
    "statement_accounts": """
        SELECT stock, year, basis, receipt, filed_at, a.corp_code, a.account_id, a.sj_div, a.thstrm_amount, a.frmtrm_amount, a.currency
        FROM (SELECT *, explode(array_compact(array(
            named_struct(
                'corp_code', CASE WHEN o_orderkey % 59 = 0 THEN '99999999' ELSE lpad(cast(l_suppkey * 7 + 1 AS string), 8, '0') END,
                'account_id', CASE WHEN o_orderkey % 2 = 0 THEN 'ifrs-full_' ELSE 'ifrs_' END
                    || CASE WHEN o_orderkey % 53 = 0 THEN 'Other' WHEN basis = 'CFS'
                            THEN 'ProfitLossAttributableToOwnersOfParent' ELSE 'ProfitLoss' END,
                'sj_div', CASE WHEN o_orderkey % 3 = 0 THEN 'CIS' ELSE 'IS' END,
                'thstrm_amount', cast(profit AS string), 'frmtrm_amount', cast(NULL AS string),
                'currency', CASE WHEN o_orderkey % 43 = 0 THEN 'USD' ELSE 'KRW' END),
            named_struct(
                'corp_code', lpad(cast(l_suppkey * 7 + 1 AS string), 8, '0'),
                'account_id', CASE WHEN basis = 'CFS' THEN 'ifrs-full_EquityAttributableToOwnersOfParent' ELSE 'ifrs-full_Equity' END,
                'sj_div', 'BS',
                'thstrm_amount', CASE WHEN o_orderkey % 61 = 0 THEN 'x' WHEN o_orderkey % 41 = 0 THEN '-1.00'
                                      ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END,
                'frmtrm_amount', cast(cast(floor(o_totalprice * 0.95) AS decimal(18,2)) AS string), 'currency', 'KRW'),
            CASE WHEN o_orderkey % 53 <> 0 AND o_orderkey % 2 = 0 THEN named_struct(
                'corp_code', lpad(cast(l_suppkey * 7 + 1 AS string), 8, '0'),
                'account_id', CASE WHEN basis = 'CFS' THEN 'ifrs-full_ProfitLossAttributableToOwnersOfParent'
                                   ELSE 'ifrs-full_ProfitLoss' END,
                'sj_div', 'IS',
                'thstrm_amount', CASE WHEN o_orderkey % 47 = 0 THEN cast(profit + 1 AS string) WHEN o_orderkey % 37 = 5
                                      THEN cast(profit AS string) || '001' ELSE cast(profit AS string) END,
                'frmtrm_amount', cast(NULL AS string), 'currency', CASE WHEN o_orderkey % 43 = 0 THEN 'USD' ELSE 'KRW' END) END
            ))) AS a FROM statements)""",
}


def closure(names: list[str]) -> list[str]:
    """The named tables and all they are made of, in order of definition, driver tables left out."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name in wanted or name in BASE:
            return
        for needed in TABLES[name][0]:
            visit(needed)
        wanted.add(name)

    for name in names:
        visit(name)
    return [name for name in TABLES if name in wanted]


def bases(names: list[str]) -> list[str]:
    found = {name for name in names if name in BASE}
    for name in closure(names):
        found.update(needed for needed in TABLES[name][0] if needed in BASE)
    return [name for name in BASE if name in found]


def ctes(names: list[str], own: dict[str, str] | None = None) -> list[str]:
    """The derived tables as named queries; ``own`` holds texts that take the place of the common ones."""
    return [f"{name} AS ({(own or {}).get(name, TABLES[name][1])})" for name in closure(names)]
