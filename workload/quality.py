"""Normalisation, validation, ingest state and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.functions import text as tx
from knownat.functions.hashing import table_fingerprint
from knownat.operators import normalize as nm
from knownat.operators import quality as qu
from knownat.session import scratch_folder
from knownat.sources import lookups as lk
from workload import parts
from workload.registry import Inputs, query

MARKET = """CASE WHEN upper(trim({c})) LIKE 'KOSPI%' THEN 'KOSPI' WHEN upper(trim({c})) LIKE 'KOSDAQ%' THEN 'KOSDAQ'
            ELSE upper(trim({c})) END"""
CODE = "lpad(regexp_replace(trim({c}), '^([0-9]+)\\.0$', '\\1'), 6, '0')"


def num(c: str) -> str:
    return f"try_cast(replace(trim({c}), ',', '') AS double)"


NORMALIZED = f"""normal AS (
    SELECT requested_date, strptime(basDt, '%Y%m%d')::date AS trade_date, {CODE.format(c='srtnCd')} AS code,
           trim(itmsNm) AS name, {MARKET.format(c='mrktCtg')} AS market, '' AS segment, {num('mkp')} AS open,
           {num('hipr')} AS high, {num('lopr')} AS low, {num('clpr')} AS close, {num('trqu')} AS volume,
           {num('trPrc')} AS amount, {num('mrktTotAmt')} AS marcap, {num('lstgStCnt')} AS listed_shares
    FROM raw_daily WHERE {MARKET.format(c='mrktCtg')} IN ('KOSPI', 'KOSDAQ'))"""


@query("normalize_daily_market", "raw_daily", oracle=f"WITH {NORMALIZED} SELECT * FROM normal")
def normalized(t: Inputs):
    return nm.normalize_daily_market(t.raw_daily, ("requested_date",))


@query("validate_days", "raw_daily", oracle=f"""WITH {NORMALIZED},
    d AS (SELECT requested_date, count(*) - count(DISTINCT code) AS dup,
                 cast(count(*) FILTER (market = 'KOSPI') = 0 AS int) + cast(count(*) FILTER (market = 'KOSDAQ') = 0 AS int)
                     AS mk, count(*) FILTER (close IS NULL OR close <= 0) AS cl FROM normal GROUP BY requested_date)
    SELECT requested_date, 3 AS ordinal, 'duplicate_code' AS rule_id, dup AS n FROM d WHERE dup > 0
    UNION ALL SELECT requested_date, 4, 'market_missing', mk FROM d WHERE mk > 0
    UNION ALL SELECT requested_date, 6, 'close_not_positive', cl FROM d WHERE cl > 0""")
def _(t):
    return qu.validate_days(normalized(t))


LIFE = f"""life AS (
    SELECT dataset, source_row_number, nullif(trim("표준코드"), '') AS standard_code, lpad(trim("단축코드"), 6, '0') AS short_code,
           nullif(trim("종목명"), '') AS name, {MARKET.format(c='"시장구분"')} AS market, nullif(trim("주식종류"), '') AS stock_type,
           cast(replace("상장일", '/', '-') AS date) AS listing_date, try_cast("폐지일" AS date) AS delisting_date,
           nullif(trim("회사코드"), '') AS issuer_reference,
           coalesce(nullif("변경구분", ''), CASE dataset WHEN 'delistings' THEN 'delisting'
                    WHEN 'identifier_changes' THEN 'identifier_change' ELSE 'listing' END) AS event_type,
           try_strptime("변경일", '%Y%m%d')::date AS changed, "이전종목명" AS previous_name FROM raw_lifecycle)"""
LIFE_COLUMNS = ["dataset", "source_row_number", "standard_code", "short_code", "name", "market", "stock_type",
                "listing_date", "delisting_date", "issuer_reference", "event_type", "effective_date", "previous_name"]


@query("normalize_lifecycle", "raw_lifecycle", oracle=f"""WITH {LIFE}
    SELECT dataset, source_row_number, standard_code, short_code, name, market, stock_type, listing_date, delisting_date,
           issuer_reference, event_type, coalesce(changed, CASE WHEN event_type = 'delisting' THEN delisting_date
                ELSE listing_date END) AS effective_date, previous_name FROM life""")
def _(t):
    return nm.normalize_lifecycle(t.raw_lifecycle)[0].select(*LIFE_COLUMNS)


STATUS = f"""st AS (
    SELECT requested_date, source_row_number, lpad(trim("ISU_SRT_CD"), 6, '0') AS short_code, trim("ISU_NM") AS name,
           {MARKET.format(c='"MKT_NM"')} AS market, CASE lower("KIND_STKCERT_TP_NM") WHEN 'etf' THEN 'etf'
                WHEN 'preferred stock' THEN 'preferred' ELSE 'common' END AS security_kind,
           "MANG_ITEM_YN" = 'Y' AS management_designation,
           CASE "TRD_STOP_YN" WHEN '해당' THEN true WHEN '미해당' THEN false END AS trading_suspension,
           "CLSG_TRD_YN" = '1' AS liquidation_trading,
           coalesce(try_cast(nullif("EFFECTIVE_DD", '') AS date), requested_date) AS effective_date FROM raw_status)"""


@query("normalize_status", "raw_status", oracle=f"""WITH {STATUS}
    SELECT * FROM st WHERE trading_suspension IS NOT NULL AND market IN ('KOSPI', 'KOSDAQ')""")
def _(t):
    columns = ["requested_date", "source_row_number", "short_code", "name", "market", "security_kind",
               "management_designation", "trading_suspension", "liquidation_trading", "effective_date"]
    return nm.normalize_status(t.raw_status)[0].select(*columns)


@query("status_row_findings", "raw_status", oracle=f"""WITH {STATUS}
    SELECT 'bad_trading_suspension' AS rule_id, short_code AS subject, requested_date AS date,
           cast(source_row_number AS varchar) AS observed FROM st WHERE trading_suspension IS NULL
    UNION ALL SELECT 'bad_market', short_code, requested_date, cast(source_row_number AS varchar) FROM st
    WHERE market NOT IN ('KOSPI', 'KOSDAQ')""")
def _(t):
    return nm.normalize_status(t.raw_status)[1].select("rule_id", "subject", "date", "observed")


@query("security_kind", "raw_lifecycle", "raw_status", oracle="""
    SELECT label, CASE WHEN label = '보통주' OR label = 'common' THEN 'common' WHEN label IN ('우선주', 'Preferred Stock')
        THEN 'preferred' WHEN label LIKE '%스팩%' THEN 'spac' WHEN label = 'ETF' THEN 'etf' ELSE 'unknown' END AS kind,
        count(*) AS n
    FROM (SELECT "주식종류" AS label FROM raw_lifecycle UNION ALL SELECT "KIND_STKCERT_TP_NM" FROM raw_status) GROUP BY ALL""")
def _(t):
    labels = t.raw_lifecycle.select(F.col("주식종류").alias("label")).unionByName(
        t.raw_status.select(F.col("KIND_STKCERT_TP_NM").alias("label")))
    return labels.withColumn("kind", tx.security_kind(F.col("label"), funds=True)).groupBy("label", "kind").agg(
        F.count(F.lit(1)).alias("n"))


BAR_ROWS = """raw_bars AS (
    SELECT cast(l_suppkey AS varchar) AS code, cast(cast(l_shipdate AS date) AS varchar) AS trade_date,
           l_extendedprice AS open, l_extendedprice AS high, l_extendedprice AS low,
           CASE WHEN l_tax = 0.08 THEN 0 ELSE l_extendedprice END AS close,
           CASE WHEN l_discount = 0.1 THEN NULL ELSE l_quantity END AS volume,
           ((l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000) * 100000 + cast(floor(l_extendedprice * 100) AS bigint)
               % 100000 AS ingest_seq FROM lineitem)"""


def raw_bars(t: Inputs):
    return t.sql(["lineitem"], ", " + BAR_ROWS.replace("varchar", "string").replace("0.08", "0.08D").replace("0.1 ", "0.1D ") + " SELECT * FROM raw_bars")


@query("normalize_bars", "lineitem", oracle=f"""WITH {BAR_ROWS}
    SELECT lpad(code, 6, '0') AS code, cast(trade_date AS date) AS trade_date, open, high, low, close, volume, ingest_seq
    FROM raw_bars WHERE close > 0 AND volume IS NOT NULL AND trade_date <= '2000-12-31'
    QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY ingest_seq DESC) = 1""")
def _(t):
    return nm.normalize_bars(raw_bars(t), "2000-12-31")[0]


@query("check_bars", "lineitem", oracle=f"""WITH {BAR_ROWS}, g AS (
    SELECT code, cast(trade_date AS date) AS d, count(*) AS n, count(*) FILTER (close <= 0) AS b FROM raw_bars GROUP BY ALL)
    SELECT 'duplicate_date' AS rule_id, code AS subject, d AS date, cast(n AS varchar) AS observed FROM g WHERE n > 1
    UNION ALL SELECT 'bad_price', code, d, cast(b AS varchar) FROM g WHERE b > 0""")
def _(t):
    rows = raw_bars(t).withColumn("trade_date", F.col("trade_date").cast("date"))
    return nm.check_series(rows, "code", "bars").select("rule_id", "subject", "date", "observed")


@query("check_index_bars", "daily_market", oracle="""
    WITH g AS (SELECT market, trade_date, count(*) AS n FROM daily_market GROUP BY ALL)
    SELECT 'duplicate_date' AS rule_id, market AS subject, trade_date AS date, cast(n AS varchar) AS observed
    FROM g WHERE n > 1""")
def _(t):
    found = nm.check_series(t.daily_market, "market", "index_bars")
    return found.select("rule_id", "subject", "date", "observed")


@query("check_snapshot", "listing_days", oracle="""
    WITH g AS (SELECT day, code, count(*) AS n, count(*) FILTER (NOT coalesce(marcap > 0 AND amount > 0, false)) AS b
               FROM listing_days GROUP BY ALL)
    SELECT 'duplicate_code' AS rule_id, code AS subject, day AS date FROM g WHERE n > 1
    UNION ALL SELECT 'value_not_positive', code, day FROM g WHERE b > 0""")
def _(t):
    found = nm.check_snapshot(t.listing_days.withColumnRenamed("day", "signal_date"))
    return found.select("rule_id", "subject", "date")


COMPLETE = """comp AS (
    SELECT day, count(*) AS total, count(*) FILTER (marcap > 0 AND amount > 0) AS valid,
           greatest(1, cast(floor(count(*) * 0.95::double) AS bigint)) AS needed FROM listing_days GROUP BY day)"""


@query("listing_completeness", "listing_days", oracle=f"""WITH {COMPLETE}
    SELECT day, total, valid, needed, valid >= needed AS complete FROM comp""")
def _(t):
    return nm.listing_completeness(t.listing_days)


@query("latest_complete_listing", "listing_days", oracle=f"""WITH {COMPLETE}
    SELECT * FROM listing_days WHERE day = (SELECT max(day) FROM comp WHERE valid >= needed)""")
def _(t):
    return nm.latest_complete_listing(t.listing_days)


@query("check_actions", "actions", oracle="""
    SELECT lpad(code, 6, '0') AS code, cast(effective_date AS date) AS effective_date, action_type, ratio, cash_amount,
           status, source, seq FROM actions WHERE action_type IS NOT NULL""")
def _(t):
    return nm.check_actions(t.actions)[0]


@query("action_findings", "actions", oracle="""
    SELECT 'action_type_missing' AS rule_id, lpad(code, 6, '0') AS subject, cast(seq AS varchar) AS observed
    FROM actions WHERE action_type IS NULL""")
def _(t):
    return nm.check_actions(t.actions)[1].select("rule_id", "subject", "observed")


@query("corporate_actions_between", "actions", oracle="""
    SELECT code, effective_date, action_type, seq FROM actions WHERE effective_date BETWEEN '1998-01-01' AND '1998-03-31'
    QUALIFY row_number() OVER (PARTITION BY code, effective_date, action_type ORDER BY seq DESC) = 1""")
def _(t):
    return lk.actions_between(t.actions, "1998-01-01", "1998-03-31").select("code", "effective_date", "action_type", "seq")


@query("prices_of_code", "bars", oracle="""
    SELECT * FROM bars WHERE code = '000007' AND trade_date BETWEEN '1994-02-01' AND '1997-11-30'""")
def _(t):
    stored = lk.store_sorted(t.bars, scratch_folder(t.spark, "bars"), ["code", "trade_date"])
    return lk.prices(stored, "000007", "1994-02-01", "1997-11-30")


@query("index_prices", "index_bars", oracle="SELECT trade_date, open, close FROM index_bars WHERE symbol = 'KOSDAQ'")
def _(t):
    return lk.index_prices(lk.store_sorted(t.index_bars, scratch_folder(t.spark, "index"), ["symbol", "trade_date"]), "KOSDAQ")


@query("historical_snapshot", "snapshots", oracle="""
    SELECT signal_date, code, name, market, round(marcap, 2) AS marcap FROM snapshots WHERE signal_date = '1997-06-20'""")
def _(t):
    return lk.historical_snapshot(t.snapshots, "1997-06-20").select(
        "signal_date", "code", "name", "market", F.round("marcap", 2).alias("marcap"))


@query("snapshot_before", "snapshots", oracle="""
    SELECT signal_date, code, name, market, round(marcap, 2) AS marcap FROM snapshots
    WHERE signal_date = (SELECT max(signal_date) FROM snapshots WHERE signal_date <= '1997-06-24')""")
def _(t):
    stored = lk.store_sorted(t.snapshots, scratch_folder(t.spark, "snapshots"), ["signal_date", "code"])
    return lk.snapshot_before(stored, "1997-06-24").select("signal_date", "code", "name", "market", F.round("marcap", 2).alias("marcap"))


@query("canonical_day", "daily_market", oracle="SELECT code, name, market, close, listed_shares FROM daily_market WHERE trade_date = '1997-06-20'")
def _(t):
    stored = lk.store_sorted(t.daily_market, scratch_folder(t.spark, "market"), ["trade_date", "code"])
    return lk.canonical_day(stored, "1997-06-20").select("code", "name", "market", "close", "listed_shares")


def asked_market(t: Inputs):
    return nm.market_for_days(t.daily_market, t.weeks.select(F.col("signal_date").alias("trade_date")))


@query("market_for_days", "daily_market", "weeks", oracle="""
    SELECT trade_date, code, close, raw_version_id FROM daily_market WHERE trade_date IN (SELECT signal_date FROM weeks)""")
def _(t):
    return asked_market(t)[0].select("trade_date", "code", "close", "raw_version_id")


@query("market_day_versions", "daily_market", "weeks", oracle="""
    SELECT DISTINCT raw_version_id FROM daily_market WHERE trade_date IN (SELECT signal_date FROM weeks)""")
def _(t):
    return asked_market(t)[1]


# ---- promotion ------------------------------------------------------------------------------
SUMMARIES = """days AS (SELECT trade_date, count(*) AS row_count,
    cast(sum(cast(marcap AS decimal(28,4))) AS double) AS total_marcap FROM daily_market GROUP BY trade_date)"""


@query("day_summaries", "daily_market", oracle=f"""WITH {SUMMARIES}
    SELECT trade_date, row_count, round(total_marcap, 0) AS total_marcap FROM days""")
def _(t):
    return qu.day_summaries(t.daily_market).withColumn("total_marcap", F.round("total_marcap", 0))


@query("row_count_anomaly", "daily_market", oracle=f"""WITH {SUMMARIES},
    w AS (SELECT *, median(row_count) OVER p AS expected, count(*) OVER p AS n FROM days
          WINDOW p AS (ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT trade_date, row_count, expected, round(row_count / expected, 9) AS ratio FROM w
    WHERE n >= 20 AND (row_count / expected < 0.9 OR row_count / expected > 1.1)""")
def _(t):
    return qu.row_count_anomaly(qu.day_summaries(t.daily_market)).withColumn("ratio", F.round("ratio", 9))


@query("marcap_anomaly", "daily_market", oracle=f"""WITH {SUMMARIES},
    w AS (SELECT *, lag(total_marcap) OVER (ORDER BY trade_date) AS previous FROM days)
    SELECT trade_date, round(abs(total_marcap / previous - 1), 9) AS change FROM w
    WHERE abs(total_marcap / previous - 1) >= 0.2 - 1e-12""")
def _(t):
    return qu.marcap_anomaly(qu.day_summaries(t.daily_market)).select("trade_date", F.round("change", 9).alias("change"))


@query("resolve_day_states", "daily_market", oracle=f"""WITH RECURSIVE {SUMMARIES},
    d AS MATERIALIZED (SELECT *, day(trade_date) = 31 AS empty, cast(month(trade_date) % 4 AS int) AS attempts,
                 CASE WHEN month(trade_date) = 5 THEN 'notice' ELSE ' ' END AS evidence,
                 CASE WHEN day(trade_date) = 30 THEN 1 ELSE 0 END AS hard, day(trade_date) = 29 AS changed,
                 row_number() OVER (ORDER BY trade_date) AS k FROM days),
    walk AS (
        SELECT cast(0 AS bigint) AS k, cast(NULL AS date) AS trade_date, cast(NULL AS varchar) AS state,
               cast([] AS double[]) AS counts, cast(NULL AS double) AS cap
        UNION ALL
        SELECT k, trade_date, state, CASE WHEN state = 'promoted'
                   THEN list_slice(list_append(counts, row_count), greatest(len(counts) + 1 - 19, 1), len(counts) + 1)
                   ELSE counts END, CASE WHEN state = 'promoted' THEN total_marcap ELSE cap END
        FROM (SELECT d.k, d.trade_date, d.row_count, d.total_marcap, w.counts, w.cap,
                     CASE WHEN d.empty AND trim(d.evidence) <> '' THEN 'non_session'
                          WHEN d.empty AND d.attempts >= 3 THEN 'calendar_unresolved'
                          WHEN d.empty OR d.hard > 0 THEN 'failed'
                          WHEN d.changed OR coalesce(abs(d.total_marcap / w.cap - 1) >= 0.2 - 1e-12, false)
                               OR (len(w.counts) >= 20 AND (d.row_count / list_median(w.counts) < 0.9
                                   OR d.row_count / list_median(w.counts) > 1.1)) THEN 'quarantined'
                          ELSE 'promoted' END AS state
              FROM walk w JOIN d ON d.k = w.k + 1))
    SELECT trade_date, state FROM walk WHERE k > 0""")
def _(t):
    day = F.dayofmonth("trade_date")
    days = qu.day_summaries(t.daily_market).withColumns({
        "empty": day == 31, "attempts": (F.month("trade_date") % 4).cast("int"),
        "evidence": F.when(F.month("trade_date") == 5, "notice").otherwise(" "),
        "hard_errors": F.when(day == 30, 1).otherwise(0), "changed": day == 29,
    })
    return qu.resolve_day_states(days).select("trade_date", "state")


@query("invalid_transitions", "state_log", oracle="""
    WITH s AS (SELECT *, lag(state) OVER (PARTITION BY job_id, trade_date ORDER BY seq) AS from_state FROM state_log)
    SELECT job_id, trade_date, seq, from_state, state AS to_state FROM s
    WHERE from_state IS NOT NULL AND (from_state, state) NOT IN (('pending', 'downloading'), ('downloading', 'downloaded'),
        ('downloading', 'failed'), ('downloaded', 'parsed'), ('downloaded', 'failed'), ('parsed', 'failed'),
        ('failed', 'downloading'))""")
def _(t):
    return qu.invalid_transitions(t.state_log, rows_per_bucket=500)


@query("latest_per_key", "state_log", oracle="""
    SELECT job_id, max(seq) AS seq, max_by(state, seq) AS state FROM state_log GROUP BY job_id""")
def _(t):
    return qu.latest_per_key(t.state_log, ["job_id"], "seq").select("job_id", "seq", "state")


@query("latest_entries", "state_log", oracle="SELECT seq, state, message FROM state_log ORDER BY seq DESC LIMIT 500")
def _(t):
    return qu.latest_entries(t.state_log, "seq").select("seq", "state", "message")


@query("ingest_summary", "state_log", oracle="""
    WITH s AS (SELECT job_id, trade_date, max_by(state, seq) AS state FROM state_log GROUP BY job_id, trade_date)
    SELECT job_id, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'failed') AS failed,
           count(*) AS total, count(*) AS remaining, false AS complete FROM s GROUP BY job_id""")
def _(t):
    states = qu.latest_per_key(t.state_log, ["job_id", "trade_date"], "seq")
    return qu.ingest_summary(states).select("job_id", "pending", "failed", "total", "remaining", "complete")


@query("processable_days", "state_log", oracle="""
    WITH s AS (SELECT job_id, trade_date, max_by(state, seq) AS state, max_by(attempts, seq) AS attempts
               FROM state_log GROUP BY job_id, trade_date)
    SELECT * FROM s WHERE state = 'pending' OR (state = 'failed' AND attempts < 3)""")
def _(t):
    states = qu.latest_per_key(t.state_log, ["job_id", "trade_date"], "seq")
    return qu.processable_days(states).select("job_id", "trade_date", "state", "attempts")


@query("bar_coverage", "bars", oracle="""
    SELECT code, min(trade_date) AS first_day, max(trade_date) AS last_day, count(*) AS days FROM bars GROUP BY code""")
def _(t):
    return qu.bar_coverage(t.bars)


# ---- selections -----------------------------------------------------------------------------
CHOSEN = """chosen AS (
    SELECT s.dataset, s.scope, s.reason, v.raw_version_id FROM selections s
    JOIN versions v ON v.dataset = s.dataset AND v.scope = s.scope AND v.first_seen = s.first_doc)"""
KEYS = ["dataset", "scope"]


def chosen(t: Inputs):
    return t.sql(["selections", "versions"], f", {CHOSEN} SELECT * FROM chosen")


@query("pending_revisions", "selections", "versions", oracle=f"""WITH {CHOSEN}
    SELECT v.dataset, v.scope, max(v.raw_version_id) AS latest_id, c.raw_version_id AS selected_id
    FROM versions v LEFT JOIN chosen c ON c.dataset = v.dataset AND c.scope = v.scope
    GROUP BY v.dataset, v.scope, c.raw_version_id HAVING latest_id <> selected_id OR selected_id IS NULL""")
def _(t):
    return qu.pending_revisions(t.versions, chosen(t), KEYS)


@query("check_selections", "selections", "versions", oracle=f"""WITH {CHOSEN}
    SELECT 'reason_missing' AS rule_id, dataset || '/' || scope AS subject FROM chosen WHERE trim(reason) = ''""")
def _(t):
    return qu.check_selections(chosen(t), t.versions, KEYS).select("rule_id", "subject")


@query("default_selection", "selections", "versions", oracle=f"""WITH {CHOSEN}
    SELECT dataset, scope, raw_version_id, reason FROM chosen
    UNION ALL SELECT dataset, scope, min(raw_version_id), 'first_seen' FROM versions
    WHERE (dataset, scope) NOT IN (SELECT (dataset, scope) FROM chosen) GROUP BY dataset, scope""")
def _(t):
    return qu.default_selection(t.versions, chosen(t), KEYS)


@query("selected_rows", "selections", "versions", oracle=f"""WITH {CHOSEN}
    SELECT raw_version_id, sha256 FROM versions WHERE raw_version_id IN (SELECT raw_version_id FROM chosen)""")
def _(t):
    return qu.selected_rows(t.versions, chosen(t)).select("raw_version_id", "sha256")


@query("missing_evidence", "lifecycle_rows", oracle="""
    SELECT 'events' AS table_name, raw_version_id, source_row_number, 'row_missing' AS reason FROM lifecycle_rows
    WHERE event_type = 'merger'
    UNION SELECT 'events', raw_version_id, source_row_number, 'version_not_selected' FROM lifecycle_rows
    WHERE event_type <> 'merger' AND raw_version_id = 4""")
def _(t):
    rows = t.lifecycle_rows
    kept = rows.filter("raw_version_id < 4").select("raw_version_id").distinct()
    return qu.missing_evidence({"events": rows}, rows.filter("event_type <> 'merger'"), kept)


@query("table_fingerprint", "orders", oracle=f"""
    WITH d AS ({parts.digests('orders', 'o_custkey o_orderkey o_orderpriority o_orderstatus o_totalprice')})
    SELECT {parts.COUNTED} AS row_count, {parts.FINGERPRINT} AS fingerprint FROM d""")
def _(t):
    return table_fingerprint(t.orders.drop("o_orderdate"))
