"""Security identity: intervals, events, overlaps, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.operators import lifecycle as lc
from workload.registry import Inputs, query

KIND = """CASE WHEN {c} = '보통주' THEN 'common' WHEN {c} = '우선주' THEN 'preferred' WHEN {c} LIKE '%스팩%' THEN 'spac'
          ELSE 'unknown' END"""
FACTS = f"""facts AS (
    SELECT standard_code, 'sec_' || left(sha256('lifecycle-v1:' || standard_code), 20) AS security_id,
           'iss_' || left(sha256('lifecycle-v1:' || arg_min(issuer_reference, (effective_date, raw_version_id,
               source_row_number)) FILTER (issuer_reference IS NOT NULL)), 20) AS issuer_id,
           min_by(issuer_reference, (effective_date, raw_version_id, source_row_number))
               FILTER (issuer_reference IS NOT NULL) AS issuer_reference,
           {KIND.format(c='''max_by(stock_type, (effective_date, raw_version_id, source_row_number))
               FILTER (stock_type IS NOT NULL)''')} AS security_kind,
           min(listing_date) AS listed_on, min(delisting_date) AS delisted_on,
           min(effective_date) FILTER (event_type = 'merger') AS unsupported_on,
           min_by(coalesce(previous_name, name), (effective_date, raw_version_id, source_row_number)) AS first_name,
           min_by(market, (effective_date, raw_version_id, source_row_number)) AS first_market,
           min_by(short_code, (effective_date, raw_version_id, source_row_number)) AS first_code,
           min_by(raw_version_id, (effective_date, raw_version_id, source_row_number)) AS raw_version_id,
           min_by(source_row_number, (effective_date, raw_version_id, source_row_number)) AS source_row_number
    FROM lifecycle_rows GROUP BY standard_code)"""
INTERVALS = f"""{FACTS},
changes AS (
    SELECT r.standard_code, r.effective_date AS valid_from, r.short_code, r.name, r.market,
           {KIND.format(c='r.stock_type')} AS security_kind, r.raw_version_id, r.source_row_number
    FROM lifecycle_rows r JOIN facts f ON f.standard_code = r.standard_code
    WHERE r.event_type <> 'delisting' AND r.effective_date > f.listed_on
    QUALIFY row_number() OVER (PARTITION BY r.standard_code, r.effective_date
                               ORDER BY r.raw_version_id DESC, r.source_row_number DESC) = 1),
points AS (
    SELECT standard_code, listed_on AS valid_from, first_code AS short_code, first_name AS name, first_market AS market,
           security_kind, raw_version_id, source_row_number FROM facts
    UNION ALL SELECT * FROM changes),
spans AS (
    SELECT f.security_id, f.issuer_id, p.*, coalesce(lead(p.valid_from) OVER (PARTITION BY p.standard_code ORDER BY p.valid_from),
               f.delisted_on) AS valid_to
    FROM points p JOIN facts f ON f.standard_code = p.standard_code),
intervals AS (SELECT * FROM spans WHERE valid_to IS NULL OR valid_to > valid_from)"""


def model(t: Inputs) -> lc.LifecycleModel:
    return lc.build_model(t.lifecycle_rows)


@query("stable_ids", "lifecycle_rows", oracle="""
    SELECT DISTINCT standard_code, 'sec_' || left(sha256('lifecycle-v1:' || standard_code), 20) AS security_id
    FROM lifecycle_rows""")
def _(t):
    return t.lifecycle_rows.select("standard_code").distinct().withColumn("security_id", lc.stable_id("sec", F.col("standard_code")))


@query("issuers", "lifecycle_rows", oracle=f"""WITH {FACTS}
    SELECT issuer_id, issuer_reference AS official_reference FROM facts WHERE issuer_id IS NOT NULL""")
def _(t):
    return model(t).issuers.select("issuer_id", "official_reference")


@query("securities", "lifecycle_rows", oracle=f"""WITH {FACTS}
    SELECT security_id, issuer_id, standard_code, security_kind, raw_version_id, source_row_number FROM facts""")
def _(t):
    return model(t).securities


@query("lifecycle_intervals", "lifecycle_rows", oracle=f"""WITH {INTERVALS}
    SELECT security_id, issuer_id, standard_code, short_code, name, market, security_kind, raw_version_id,
           source_row_number, valid_from, valid_to FROM intervals""")
def _(t):
    return model(t).intervals


@query("lifecycle_identifiers", "lifecycle_rows", oracle=f"""WITH {INTERVALS}
    SELECT security_id, standard_code, short_code, valid_from, valid_to, raw_version_id, source_row_number FROM intervals""")
def _(t):
    return model(t).identifiers


@query("lifecycle_names", "lifecycle_rows", oracle=f"""WITH {INTERVALS}
    SELECT security_id, name, valid_from, valid_to, raw_version_id, source_row_number FROM intervals""")
def _(t):
    return model(t).names


EVENTS = f"""{FACTS}, ev AS (
    SELECT f.security_id, r.event_type, r.effective_date, r.raw_version_id, r.source_row_number
    FROM lifecycle_rows r JOIN facts f ON f.standard_code = r.standard_code WHERE r.event_type <> 'listing'
    QUALIFY row_number() OVER (PARTITION BY f.security_id, r.event_type, r.effective_date
                               ORDER BY r.raw_version_id DESC, r.source_row_number DESC) = 1
    UNION ALL SELECT security_id, 'listing', listed_on, raw_version_id, source_row_number FROM facts)"""


@query("lifecycle_events", "lifecycle_rows", oracle=f"WITH {EVENTS} SELECT * FROM ev")
def _(t):
    return model(t).events.drop("last_trading_date", "successor_standard_code")


SWEEP = """ordered AS (
    SELECT *, coalesce(valid_to, DATE '9999-12-31') AS e,
           row_number() OVER (PARTITION BY short_code ORDER BY valid_from, security_id) AS k FROM intervals),
swept AS (
    SELECT o.*, max({'e': e, 'k': -k, 's': security_id}) OVER (PARTITION BY short_code ORDER BY k
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ordered o)"""


@query("lifecycle_findings", "lifecycle_rows", oracle=f"""WITH {INTERVALS}, {SWEEP}
    SELECT 'unknown_classification' AS rule_id, security_id AS subject, cast(NULL AS date) AS date FROM facts
    WHERE security_kind = 'unknown'
    UNION ALL SELECT 'unsupported_lineage', security_id, unsupported_on FROM facts WHERE unsupported_on IS NOT NULL
    UNION ALL SELECT 'invalid_interval', security_id, valid_from FROM spans WHERE valid_to <= valid_from
    UNION ALL SELECT 'overlapping_code', security_id, valid_from FROM swept
    WHERE before.s <> security_id AND valid_from < before.e""")
def _(t):
    return model(t).findings.select("rule_id", "subject", "date")


@query("overlapping_codes", "lifecycle_rows", oracle=f"""WITH {INTERVALS}, {SWEEP}
    SELECT security_id AS subject, valid_from AS date, short_code AS observed FROM swept
    WHERE before.s <> security_id AND valid_from < before.e""")
def _(t):
    return lc.overlapping_codes(model(t).intervals).select("subject", "date", "observed")


@query("listed_on", "lifecycle_rows", "status_days", "weeks", oracle=f"""WITH {INTERVALS}
    SELECT w.signal_date AS date, security_id, short_code, name, market FROM intervals
    JOIN weeks w ON valid_from <= w.signal_date AND (valid_to IS NULL OR valid_to > w.signal_date)""")
def _(t):
    found = lc.listed_on(model(t).intervals, t.weeks, "signal_date")
    return found.select("date", "security_id", "short_code", "name", "market")


@query("security_catalog", "lifecycle_rows", oracle=f"""WITH {INTERVALS}
    SELECT security_id, short_code, name, market FROM intervals
    QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY valid_from DESC) = 1""")
def _(t):
    return lc.security_catalog(model(t).intervals)


@query("timeline", "lifecycle_rows", oracle=f"""WITH {INTERVALS},
    {EVENTS[len(FACTS) + 2:]}
    SELECT security_id, 'event' AS entry, effective_date AS date, cast(NULL AS date) AS until, event_type AS detail,
           raw_version_id, source_row_number FROM ev
    UNION ALL SELECT security_id, 'interval', valid_from, valid_to, concat_ws('/', short_code, name, market),
           raw_version_id, source_row_number FROM intervals""")
def _(t):
    return lc.timeline(model(t))


VERSIONS = """versions_known AS (
    SELECT raw_version_id, 'source_' || cast(raw_version_id % 2 AS varchar) AS dataset, sha256(cast(raw_version_id AS varchar)) AS sha256
    FROM lifecycle_rows WHERE raw_version_id < 4 OR source_row_number % 5 > 0 GROUP BY raw_version_id)"""


@query("timeline_versions", "lifecycle_rows", oracle=f"""WITH {INTERVALS}, {VERSIONS},
    {EVENTS[len(FACTS) + 2:]}, entries AS (
    SELECT security_id, 'event' AS entry, effective_date AS date, cast(NULL AS date) AS until, event_type AS detail,
           raw_version_id, source_row_number FROM ev
    UNION ALL SELECT security_id, 'interval', valid_from, valid_to, concat_ws('/', short_code, name, market),
           raw_version_id, source_row_number FROM intervals)
    SELECT e.*, v.dataset, v.sha256, CASE WHEN v.dataset IS NULL THEN 'unknown' WHEN e.raw_version_id = 1 THEN 'selected'
           WHEN v.dataset = 'source_1' THEN 'pending' WHEN e.raw_version_id < 4 THEN 'superseded' ELSE 'selected' END AS state
    FROM entries e LEFT JOIN versions_known v USING (raw_version_id)""")
def _(t):
    """Of source 1 the first version is selected and the third pending; of source 0 the fourth replaced the second."""
    versions = t.sql(["lifecycle_rows"], f", {VERSIONS.replace('varchar', 'string')} SELECT * FROM versions_known")
    ends = F.when(F.col("dataset") == "source_1", F.min("raw_version_id")).otherwise(F.max("raw_version_id"))
    return lc.linked_versions(lc.timeline(model(t)), versions, versions.groupBy("dataset").agg(ends.alias("raw_version_id")))


MARKET_ROWS = """mk AS (
    SELECT w.signal_date AS trade_date, lpad(cast(o_custkey AS varchar), 6, '0') AS code,
           'corp ' || cast(o_custkey AS varchar) || '-' || cast(min(o_orderkey) % 3 AS varchar) AS name,
           CASE WHEN min(o_orderkey) % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, cast(1 AS bigint) AS raw_version_id
    FROM orders JOIN weeks w ON cast(date_trunc('week', cast(o_orderdate AS date) + 2) AS date) = w.week_key
    GROUP BY w.signal_date, o_custkey)"""


def market_rows(t: Inputs):
    """One market row per customer and week with an order, dated with the week's last session."""
    text = MARKET_ROWS.replace("varchar", "string")
    return t.sql(["orders", "weeks"], f", {text} SELECT * FROM mk")


@query("reconcile_market", "lifecycle_rows", "orders", "weeks", oracle=f"""WITH {INTERVALS}, {MARKET_ROWS},
    act AS (SELECT d.trade_date, i.* FROM intervals i JOIN (SELECT DISTINCT trade_date FROM mk) d
            ON valid_from <= d.trade_date AND (valid_to IS NULL OR valid_to > d.trade_date)
            QUALIFY row_number() OVER (PARTITION BY d.trade_date, short_code ORDER BY market DESC, security_id DESC) = 1),
    j AS (SELECT coalesce(a.trade_date, m.trade_date) AS trade_date, coalesce(a.short_code, m.code) AS code, a.security_id,
                 a.name AS ln, a.market AS lm, m.name AS mn, m.market AS mm
          FROM act a FULL JOIN mk m ON m.trade_date = a.trade_date AND m.code = a.short_code)
    SELECT trade_date, code, security_id, 'blocking' AS severity, 'market_without_lifecycle' AS rule_id, NULL AS listed,
           mn || '/' || mm AS seen FROM j WHERE security_id IS NULL
    UNION ALL SELECT trade_date, code, security_id, 'warning', 'name_conflict', ln, mn FROM j WHERE ln <> mn
    UNION ALL SELECT trade_date, code, security_id, 'warning', 'market_conflict', lm, mm FROM j WHERE lm <> mm
    UNION ALL SELECT trade_date, code, security_id, 'warning', 'active_security_missing', ln || '/' || lm, NULL FROM j
    WHERE mn IS NULL""")
def _(t):
    rows = market_rows(t)
    return lc.reconcile_market(model(t).intervals, rows, rows.select("trade_date"))


@query("market_coverage", "session_days", "daily_market", oracle="""
    SELECT market, (SELECT count(*) FROM session_days) AS landed, count(DISTINCT session_date) AS covered,
           count(DISTINCT session_date) / (SELECT count(*) FROM session_days) AS coverage
    FROM daily_market LEFT JOIN session_days ON session_date = trade_date GROUP BY market""")
def _(t):
    return lc.market_coverage(t.daily_market, t.session_days.select(F.col("session_date").alias("trade_date")), by="market")


@query("market_coverage_all_markets", "session_days", "daily_market", oracle="""
    SELECT count(*) AS landed, count(m.trade_date) AS covered, count(m.trade_date) / count(*) AS coverage
    FROM session_days s LEFT JOIN (SELECT DISTINCT trade_date FROM daily_market) m ON m.trade_date = s.session_date""")
def _(t):
    return lc.market_coverage(t.daily_market, t.session_days.select(F.col("session_date").alias("trade_date")))


@query("action_signals", "daily_market", oracle="""
    WITH s AS (SELECT *, lag(listed_shares) OVER w AS ps, lag(close) OVER w AS pc FROM daily_market
               WINDOW w AS (PARTITION BY code ORDER BY trade_date))
    SELECT trade_date, code, raw_version_id, 'listed_shares_jump' AS rule_id, ps AS before, listed_shares AS after FROM s
    WHERE ps > 0 AND abs(listed_shares - ps) / ps >= 0.2::double
    UNION ALL SELECT trade_date, code, raw_version_id, 'close_ratio_jump', pc, close FROM s
    WHERE pc > 0 AND (close / pc < 0.5 OR close / pc > 2)""")
def _(t):
    return lc.action_signals(t.daily_market)


@query("latest_run_findings", "events", oracle="""
    SELECT event_id, run_id FROM (SELECT *, user_id % 9 AS run_id FROM events) WHERE run_id = 7""")
def _(t):
    rows = t.events.withColumn("run_id", F.col("user_id") % 9)
    runs = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(
        "run_id", F.lit("2024-01-01").cast("date").alias("start_date"),
        F.when(F.col("run_id") == 8, "2024-01-31").otherwise("2024-02-29").cast("date").alias("end_date"))
    return lc.latest_run_findings(runs, rows, "2024-01-01", "2024-02-29").select("event_id", "run_id")


@query("lifecycle_readiness", "lifecycle_rows", "daily_market", oracle=f"""WITH {INTERVALS}, {SWEEP}
    SELECT false AS lifecycle_ready,
           'unreviewed_version,model_differs_from_selection,blocking_findings,corporate_action_pending' AS blocking_codes,
           2 AS model_revision, (SELECT count(*) FILTER (security_kind = 'unknown') + count(unsupported_on) FROM facts)
           + (SELECT count(*) FROM spans WHERE valid_to <= valid_from)
           + (SELECT count(*) FROM swept WHERE before.s <> security_id AND valid_from < before.e) AS blocking_count,
           cast(0 AS bigint) AS unresolved_days, true AS corporate_action_pending""")
def _(t):
    built = model(t)
    versions = t.lifecycle_rows.groupBy("dataset").agg(F.max("raw_version_id").alias("raw_version_id"))
    older = versions.withColumn("raw_version_id", F.when(F.col("dataset") == "delistings", 1).otherwise(F.col("raw_version_id")))
    meta = versions.withColumn("revision", F.lit(2))
    none = t.daily_market.filter("close < 0")
    rebuilds = versions.select(F.col("raw_version_id").alias("id"), F.lit("passed").alias("status"))
    return lc.lifecycle_readiness(versions, older, built.findings, none, lc.action_signals(t.daily_market), meta, rebuilds)
