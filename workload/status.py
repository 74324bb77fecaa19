"""Trading status: identity, knowledge times, decisions, reconciliation, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.operators import histories as hi
from knownat.operators import investability as iv
from knownat.session import scratch_folder
from knownat.sources.tables import store_tables
from knownat.streaming import status as st
from workload.lifecycle import INTERVALS, model as lifecycle_model
from workload.registry import Inputs, query

ASSERTIONS = f"""{INTERVALS},
cov AS MATERIALIZED (SELECT DISTINCT requested_date FROM status_rows),
listed AS MATERIALIZED (SELECT c.requested_date, i.* FROM intervals i JOIN cov c
           ON valid_from <= c.requested_date AND (valid_to IS NULL OR valid_to > c.requested_date)),
tagged AS (
    SELECT r.*, 'inv_' || left(sha256('investability-v1:' || dataset || ':' || requested_date || ':' || raw_version_id || ':'
                               || source_row_number), 20) AS evidence_id FROM status_rows r),
matched AS (
    SELECT t.*, l.security_id, l.market AS m, l.security_kind AS k, count(l.security_id) OVER (PARTITION BY t.source_row_number) AS n
    FROM tagged t LEFT JOIN listed l ON l.requested_date = t.requested_date
         AND CASE WHEN t.standard_code IS NOT NULL THEN l.standard_code = t.standard_code ELSE l.short_code = t.short_code END),
nexts AS (SELECT d.day, (SELECT min(session_date) FROM status_days WHERE session_date > d.day) AS next_day
          FROM (SELECT effective_date AS day FROM status_rows UNION SELECT requested_date FROM status_rows) d),
asserted AS MATERIALIZED (
    SELECT evidence_id, security_id, requested_date, effective_date AS effective_from,
           coalesce(published_at, cast(x.next_day AS timestamp) - INTERVAL 9 HOUR) AS known_at, m AS market, k AS security_kind,
           management_designation, trading_suspension, liquidation_trading, raw_version_id, source_row_number
    FROM matched LEFT JOIN nexts x ON x.day = effective_date WHERE n = 1)"""
TABLES = ["lifecycle_rows", "status_rows", "status_days"]


def built(t: Inputs) -> iv.StatusModel:
    return iv.build_model(t.status_rows, lifecycle_model(t).intervals, t.status_days)


def stored(t: Inputs) -> iv.StatusModel:
    """The model as its readers find it: built once and kept as tables."""
    parts = scratch_folder(t.spark, "status-parts")
    made = iv.build_model(t.status_rows, lifecycle_model(t).intervals, t.status_days, parts)
    return iv.stored_model(made, scratch_folder(t.spark, "status-model"))


@query("status_assertions", *TABLES, oracle=f"WITH {ASSERTIONS} SELECT * FROM asserted")
def _(t):
    return built(t).assertions.drop("observed_at")


@query("known_at", "status_rows", "status_days", oracle="""
    SELECT source_row_number, coalesce(published_at, cast((SELECT min(session_date) FROM status_days
               WHERE session_date > effective_date) AS timestamp) - INTERVAL 9 HOUR) AS known_at FROM status_rows""")
def _(t):
    return iv.with_known_at(t.status_rows, t.status_days).select("source_row_number", "known_at")


@query("evidence_ids", "status_rows", oracle="""
    SELECT source_row_number, 'inv_' || left(sha256('investability-v1:' || dataset || ':' || requested_date || ':'
        || raw_version_id || ':' || source_row_number), 20) AS evidence_id FROM status_rows""")
def _(t):
    return t.status_rows.select("source_row_number", iv.evidence_id(
        F.col("dataset"), F.col("requested_date"), F.col("raw_version_id"), F.col("source_row_number")).alias("evidence_id"))


@query("identity_findings", *TABLES, oracle=f"""WITH {ASSERTIONS}
    SELECT DISTINCT short_code AS subject, requested_date AS date, evidence_id, cast(n AS varchar) AS observed FROM matched
    WHERE n <> 1""")
def _(t):
    intervals = lifecycle_model(t).intervals
    found = iv.resolve_identity(t.status_rows, intervals, t.status_rows.select("requested_date").distinct())[1]
    return found.select("subject", "date", F.col("evidence")[0].alias("evidence_id"), "observed")


@query("contradictions", *TABLES, oracle=f"""WITH {ASSERTIONS}
    SELECT security_id AS subject, requested_date AS date, cast(effective_from AS varchar) AS observed,
           min_by(evidence_id, (raw_version_id, source_row_number)) AS evidence_id FROM asserted
    GROUP BY security_id, requested_date, effective_from
    HAVING count(DISTINCT (management_designation, trading_suspension, liquidation_trading)) > 1""")
def _(t):
    found = iv.contradictions(built(t).assertions)
    return found.select("subject", "date", "observed", F.col("evidence")[0].alias("evidence_id"))


@query("status_intervals", *TABLES, oracle=f"""WITH {ASSERTIONS}
    SELECT evidence_id, security_id, effective_from, x.next_day AS effective_to, known_at
    FROM asserted a LEFT JOIN nexts x ON x.day = a.requested_date""")
def _(t):
    return built(t).intervals.select("evidence_id", "security_id", "effective_from", "effective_to", "known_at")


@query("coverage_runs", "status_rows", "status_days", oracle="""
    WITH c AS (SELECT DISTINCT requested_date AS d FROM status_rows)
    SELECT s.session_date, c.d IS NOT NULL AS covered, count(*) FILTER (c.d IS NULL) OVER (ORDER BY s.session_date) AS gaps_to,
           count(*) FILTER (c.d IS NULL) OVER (ORDER BY s.session_date) - cast(c.d IS NULL AS bigint) AS gaps_before
    FROM status_days s LEFT JOIN c ON c.d = s.session_date""")
def _(t):
    found = cal.coverage_runs(t.status_days, t.status_rows.select("requested_date").distinct())
    return found.join(t.status_days, "session_date", "left_semi")


DECIDED = """asks AS (SELECT *, cast(as_of + INTERVAL 9 HOUR AS date) AS day FROM requests),
uncovered AS MATERIALIZED (SELECT session_date AS d FROM status_days WHERE session_date NOT IN (SELECT requested_date FROM cov)),
gaps_to AS MATERIALIZED (
    SELECT day, count(u.d) AS gaps FROM (SELECT DISTINCT day FROM asks) x LEFT JOIN uncovered u ON u.d <= x.day GROUP BY day),
gaps_before AS MATERIALIZED (
    SELECT requested_date, count(u.d) AS gaps FROM (SELECT DISTINCT requested_date FROM asserted) x
    LEFT JOIN uncovered u ON u.d < x.requested_date GROUP BY requested_date),
pairs AS MATERIALIZED (
    SELECT q.security_id AS sid, q.as_of, q.day, a.* EXCLUDE (security_id) FROM asks q
    JOIN gaps_to t ON t.day = q.day JOIN asserted a ON a.security_id = q.security_id
         AND a.effective_from <= q.day AND a.requested_date <= q.day AND a.known_at <= q.as_of
    JOIN gaps_before g ON g.requested_date = a.requested_date AND g.gaps = t.gaps),
best AS MATERIALIZED (
    SELECT * FROM pairs QUALIFY rank() OVER (PARTITION BY sid, as_of ORDER BY requested_date DESC, known_at DESC) = 1),
sums AS MATERIALIZED (
    SELECT sid, as_of, count(DISTINCT (management_designation, trading_suspension, liquidation_trading)) AS kinds,
           string_agg(evidence_id, ',' ORDER BY evidence_id) AS ids,
           max_by({'m': market, 'k': security_kind, 'a': management_designation, 'b': trading_suspension,
                   'c': liquidation_trading}, (raw_version_id, source_row_number)) AS w FROM best GROUP BY sid, as_of),
whys AS (
    SELECT q.security_id, q.as_of, q.day, CASE WHEN q.day NOT IN (SELECT requested_date FROM cov) THEN 'missing_daily_coverage'
            WHEN NOT EXISTS (SELECT 1 FROM listed l WHERE l.requested_date = q.day AND l.security_id = q.security_id) THEN 'not_listed'
            WHEN s.sid IS NULL THEN 'evidence_not_yet_known' WHEN s.kinds > 1 THEN 'contradictory_assertions' END AS stop,
           concat_ws(',', CASE WHEN w.m NOT IN ('KOSPI', 'KOSDAQ') THEN 'market_not_allowed' END,
                     CASE WHEN w.k <> 'common' THEN 'security_kind_not_allowed' END, CASE WHEN w.a THEN 'management_designation' END,
                     CASE WHEN w.b THEN 'trading_suspension' END, CASE WHEN w.c THEN 'liquidation_trading' END) AS against, s.ids
    FROM asks q LEFT JOIN sums s ON s.sid = q.security_id AND s.as_of = q.as_of),
decided AS MATERIALIZED (
    SELECT security_id, as_of, day, CASE WHEN stop = 'not_listed' THEN 'not_listed' WHEN stop IS NOT NULL THEN 'unknown'
           WHEN against <> '' THEN 'ineligible' ELSE 'eligible' END AS state, coalesce(stop, against) AS reasons,
           CASE WHEN stop IS NULL OR stop = 'contradictory_assertions' THEN ids ELSE '' END AS evidence FROM whys)"""
REQUESTS = "requests AS (SELECT * FROM decision_requests)"
SHEET = """requests AS (SELECT security_id, cast(requested_date AS timestamp) + INTERVAL 390 MINUTE AS as_of FROM listed)"""


def joined_text(df):
    return df.withColumns({"reasons": F.array_join("reason_codes", ","), "evidence": F.array_join("evidence_ids", ",")})


def stamps(t: Inputs):
    """15:30 in Seoul of every covered day."""
    days = t.status_rows.select(F.col("requested_date").alias("date")).distinct()
    return days.withColumn("as_of", cal.at_seoul(F.col("date"), cal.SIGNAL_TIME))


@query("decide", *TABLES, "decision_requests", oracle=f"""WITH {ASSERTIONS}, {REQUESTS}, {DECIDED}
    SELECT security_id, as_of, state, reasons, evidence FROM decided""")
def _(t):
    return joined_text(iv.decide(stored(t), t.decision_requests)).select("security_id", "as_of", "state", "reasons", "evidence")


BATCHES = """batches AS MATERIALIZED (
    SELECT *, CASE WHEN source_row_number % 11 = 0 THEN 2 WHEN raw_version_id <= 20 THEN 0 ELSE 1 END AS batch FROM status_rows),
first_seen AS MATERIALIZED (SELECT requested_date AS day, min(batch) AS k FROM batches GROUP BY requested_date),
opened AS MATERIALIZED (
    SELECT DISTINCT d.day, n.k FROM first_seen d JOIN first_seen n ON n.day <= d.day AND d.k <= n.k
    WHERE NOT EXISTS (SELECT 1 FROM status_days s LEFT JOIN first_seen c ON c.day = s.session_date
                      WHERE s.session_date BETWEEN n.day AND d.day AND (c.k IS NULL OR c.k > n.k))),
usable AS MATERIALIZED (
    SELECT a.security_id, b.batch AS k, min(greatest(a.known_at, cast(a.effective_from AS timestamp) - INTERVAL 9 HOUR,
                                                     cast(a.requested_date AS timestamp) - INTERVAL 9 HOUR)) AS since
    FROM asserted a JOIN batches b USING (source_row_number) WHERE a.known_at IS NOT NULL GROUP BY a.security_id, b.batch),
reached AS MATERIALIZED (
    SELECT security_id, as_of, max(k) AS batch_id FROM (
        SELECT q.security_id, q.as_of, u.k FROM asks q JOIN usable u ON u.security_id = q.security_id AND q.as_of >= u.since
        UNION ALL SELECT q.security_id, q.as_of, o.k FROM asks q JOIN opened o ON o.day = q.day) GROUP BY security_id, as_of)"""


@query("status_stream", *TABLES, "decision_requests", oracle=f"""WITH {ASSERTIONS}, {REQUESTS}, {DECIDED}, {BATCHES}
    SELECT d.security_id, d.as_of, state, reasons, evidence, cast(batch_id AS int) AS batch_id FROM decided d
    LEFT JOIN reached r ON r.security_id = d.security_id AND r.as_of = d.as_of""")
def _(t):
    root = scratch_folder(t.spark, "status")
    # What the batches stand on is made once and kept as tables.
    kept = store_tables({"lifecycle": lifecycle_model(t).intervals, "requests": t.decision_requests}, f"{root}-standing", ["security_id"])
    standing = st.Standing(kept["lifecycle"], t.status_days, kept["requests"])
    late = F.col("source_row_number") % 11 == 0
    for batch, rows in enumerate([~late & (F.col("raw_version_id") <= 20), ~late & (F.col("raw_version_id") > 20), late]):
        st.status_batch(t.status_rows.filter(rows), batch, root, standing)
    return joined_text(st.current_decisions(t.spark, root, standing)).select(
        "security_id", "as_of", "state", "reasons", "evidence", F.col("batch_id").cast("int").alias("batch_id"))


@query("decision_sheet", *TABLES, oracle=f"""WITH {ASSERTIONS}, {SHEET}, {DECIDED}
    SELECT d.day AS date, d.security_id, l.short_code, l.name, d.state, d.reasons FROM decided d
    JOIN listed l ON l.requested_date = d.day AND l.security_id = d.security_id""")
def _(t):
    return joined_text(iv.decision_sheet(stored(t), stamps(t))).select("date", "security_id", "short_code", "name", "state", "reasons")


@query("universe", *TABLES, oracle=f"""WITH {ASSERTIONS}, {SHEET}, {DECIDED}
    SELECT day AS date, security_id, evidence FROM decided WHERE state = 'eligible'""")
def _(t):
    return joined_text(iv.universe(stored(t), stamps(t))).select("date", "security_id", "evidence")


@query("execution_status", *TABLES, "decision_requests", oracle=f"""WITH {ASSERTIONS}, {REQUESTS}, {DECIDED}
    SELECT security_id, as_of, CASE WHEN day <> cast(as_of AS date) THEN 'unknown' ELSE state END AS state,
           CASE WHEN day <> cast(as_of AS date) THEN 'execution_date_mismatch' ELSE reasons END AS reasons FROM decided""")
def _(t):
    asked = t.decision_requests.withColumn("session_date", F.to_date("as_of"))
    return joined_text(iv.execution_status(stored(t), asked)).select("security_id", "as_of", "state", "reasons")


MARKET = """mkt AS (
    SELECT cast(ts AS date) AS trade_date, lpad(cast(user_id * 2 AS varchar), 6, '0') AS code,
           cast(1 AS bigint) AS raw_version_id, max(value) AS close FROM events GROUP BY cast(ts AS date), user_id)"""
RECONCILED = f"""{ASSERTIONS},
days AS (SELECT session_date AS requested_date FROM status_days),
open AS MATERIALIZED (SELECT d.requested_date, i.* FROM intervals i JOIN days d
         ON valid_from <= d.requested_date AND (valid_to IS NULL OR valid_to > d.requested_date)),
allowed AS MATERIALIZED (SELECT * FROM open WHERE market IN ('KOSPI', 'KOSDAQ') AND security_kind = 'common'),
said AS MATERIALIZED (SELECT DISTINCT requested_date, security_id FROM asserted),
requests AS (SELECT a.security_id, cast(a.requested_date AS timestamp) + INTERVAL 53999 SECOND AS as_of
             FROM allowed a SEMI JOIN said s ON s.requested_date = a.requested_date AND s.security_id = a.security_id),
{DECIDED},
results AS MATERIALIZED (
    SELECT day AS requested_date, security_id, state, reasons FROM decided
    UNION ALL SELECT a.requested_date, a.security_id, 'unknown', 'missing_selected_daily_status' FROM allowed a
    ANTI JOIN said s ON s.requested_date = a.requested_date AND s.security_id = a.security_id)"""
FOUND = f"""{MARKET},
ties AS MATERIALIZED (SELECT m.*, (SELECT count(*) FROM open o WHERE o.requested_date = m.trade_date AND o.short_code = m.code) AS n,
                close / nullif(lag(close) OVER (PARTITION BY code ORDER BY trade_date), 0) AS gap FROM mkt m),
found AS (
    SELECT 'missing_selected_daily_status' AS rule_id, 'blocking' AS severity, requested_date AS date, count(*) AS n FROM results
    WHERE reasons = 'missing_selected_daily_status' GROUP BY requested_date
    UNION ALL SELECT 'market_without_lifecycle', 'quarantine', trade_date, count(*) FROM ties WHERE n <> 1 GROUP BY trade_date
    UNION ALL SELECT 'price_gap', 'warning', trade_date, count(*) FROM ties WHERE gap < 0.5 OR gap > 2 GROUP BY trade_date)"""


def reconciled(t: Inputs):
    market = t.sql(["events"], f", {MARKET.replace('varchar', 'string')} SELECT * FROM mkt")
    return iv.reconcile(stored(t), market, "2024-01-01", "2024-12-31")


@query("reconcile_investability", *TABLES, "events", oracle=f"WITH {RECONCILED} SELECT * FROM results")
def _(t):
    return reconciled(t)[0].select("requested_date", "security_id", "state", F.array_join("reason_codes", ",").alias("reasons"))


@query("reconcile_findings", *TABLES, "events", oracle=f"WITH {RECONCILED}, {FOUND} SELECT * FROM found")
def _(t):
    return reconciled(t)[1].groupBy("rule_id", "severity", "date").agg(F.count(F.lit(1)).alias("n"))


@query("reconciliation_days", *TABLES, "events", oracle=f"""WITH {RECONCILED}, {FOUND}
    SELECT date, CASE max(l) WHEN 2 THEN 'blocked' WHEN 1 THEN 'unknown' ELSE 'passed' END AS status FROM (
        SELECT requested_date AS date, CASE state WHEN 'unknown' THEN 1 ELSE 0 END AS l FROM results
        UNION ALL SELECT date, CASE severity WHEN 'warning' THEN 0 ELSE 2 END FROM found) GROUP BY date""")
def _(t):
    return iv.reconciliation_days(*reconciled(t))


@query("latest_day_status", "events", oracle="""
    SELECT cast(ts AS date) AS date, max(event_id) AS run_id, max_by(event_type, event_id) AS status FROM events GROUP BY ALL""")
def _(t):
    rows = t.events.select(F.col("ts").cast("date").alias("date"), F.col("event_id").alias("run_id"), F.col("event_type").alias("status"))
    return iv.latest_day_status(rows)


@query("investability_readiness", *TABLES, oracle=f"""WITH {ASSERTIONS},
    c AS (SELECT 1 FROM asserted GROUP BY security_id, requested_date, effective_from
          HAVING count(DISTINCT (management_designation, trading_suspension, liquidation_trading)) > 1)
    SELECT false AS investability_ready, 'missing_daily_coverage,blocking_findings,unselected_revision' AS blocking_codes,
           (SELECT count(*) FROM status_days WHERE session_date NOT IN (SELECT requested_date FROM cov)) AS unknown_days,
           (SELECT count(DISTINCT evidence_id) FROM matched WHERE n <> 1) + (SELECT count(*) FROM c) AS blocking_count,
           (SELECT count(*) FROM cov) AS pending_days, cast(0 AS bigint) AS blocked_days""")
def _(t):
    made = built(t)
    pending = t.status_rows.groupBy("requested_date").agg(F.max("raw_version_id").alias("latest_id"))
    passed = pending.select(F.col("requested_date").alias("date"), F.lit("passed").alias("status"))
    rebuilds = pending.select(F.col("latest_id").alias("id"), F.lit("passed").alias("status"))
    return iv.readiness(made, pending, passed, rebuilds, "2024-01-01", "2024-01-30")


@query("all_findings", *TABLES, oracle=f"""WITH {ASSERTIONS}
    SELECT 'model' AS source, 'ambiguous_lifecycle_identity' AS rule_id, count(DISTINCT evidence_id) AS n FROM matched WHERE n <> 1
    UNION ALL SELECT 'reconciliation', 'contradictory_assertions', (SELECT count(*) FROM (SELECT 1 FROM asserted
        GROUP BY security_id, requested_date, effective_from
        HAVING count(DISTINCT (management_designation, trading_suspension, liquidation_trading)) > 1))""")
def _(t):
    made = built(t)
    ambiguous = made.findings.filter("rule_id = 'ambiguous_lifecycle_identity'")
    both = iv.all_findings(ambiguous, iv.contradictions(made.assertions))
    return both.groupBy("source", "rule_id").agg(F.count(F.lit(1)).alias("n"))


# ---- histories ------------------------------------------------------------------------------
LAST = """last_event AS (
    SELECT *, last_value(CASE WHEN event <> '-' THEN event END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date) AS e,
           lead(event) OVER (PARTITION BY code ORDER BY date) AS nx FROM designation_rows),
states AS (SELECT *, CASE e WHEN '지정' THEN 'designated' WHEN '해제' THEN 'released' ELSE 'unknown' END AS state FROM last_event)"""


@query("designation_history", "designation_rows", oracle="""
    SELECT file, code, date, event FROM designation_rows WHERE file IN (
        SELECT file FROM designation_rows GROUP BY file HAVING bool_or(event <> '-'))""")
def _(t):
    return hi.designation_history(t.designation_rows)[0].select("file", "code", "date", "event")


@query("designation_findings", "events", oracle="""
    WITH r AS (SELECT 'f' || user_id AS file, cast(ts AS date) AS date, event_type = 'error' AS ev FROM events),
    d AS (SELECT file, date, count(*) AS n, bool_or(ev) AS ev FROM r GROUP BY file, date)
    SELECT file AS subject, 'duplicate_date' AS rule_id FROM d GROUP BY file HAVING max(n) > 1
    UNION ALL SELECT file, 'no_event' FROM d GROUP BY file HAVING NOT bool_or(ev)""")
def _(t):
    rows = t.events.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"),
        F.lit("corp").alias("name"), F.lit("KOSPI").alias("market"), F.col("ts").cast("date").alias("date"),
        F.when(F.col("event_type") == "error", "지정").otherwise("-").alias("event"), F.lit("").alias("reason"),
        F.col("event_id").alias("source_row_number"),
    )
    return hi.designation_history(rows)[1].select("subject", "rule_id")


ASKED = "asked AS (SELECT c.code, d.session_date AS date FROM (SELECT DISTINCT code FROM {0}) c, status_days d)"


def asked(t: Inputs, rows):
    """Every code on every session of the month."""
    days = F.array_sort(F.collect_set("session_date"))
    listed = t.status_days.agg(days.alias("d"))
    codes = rows.select("code").distinct().withColumn("d", listed.scalar())
    return codes.select("code", F.explode("d").alias("date"))


@query("designation_state", "designation_rows", "status_days", oracle=f"""WITH {LAST}, {ASKED.format('designation_rows')}
    SELECT a.code, a.date, coalesce(s.state, 'unknown') AS state FROM asked a
    LEFT JOIN states s ON s.code = a.code AND s.date = a.date""")
def _(t):
    return hi.designation_state(t.designation_rows, asked(t, t.designation_rows))


@query("event_boundaries", "designation_rows", oracle=f"""WITH {LAST}
    SELECT code, date, event, state FROM states WHERE event <> '-' OR nx <> '-'""")
def _(t):
    return hi.event_boundaries(t.designation_rows)


OVERLAP = """o AS (SELECT *, lag(resume_date) OVER w AS r, lag(halt_date) OVER w AS h FROM halt_rows
          WINDOW w AS (PARTITION BY file ORDER BY halt_date)),
bad AS (SELECT DISTINCT file FROM o WHERE h IS NOT NULL AND (r IS NULL OR halt_date < r))"""


@query("halt_intervals", "halt_rows", oracle=f"""WITH {OVERLAP}
    SELECT file, code, halt_date, resume_date FROM halt_rows WHERE file NOT IN (SELECT file FROM bad)""")
def _(t):
    return hi.halt_intervals(t.halt_rows)[0].select("file", "code", "halt_date", "resume_date")


@query("halt_findings", "halt_rows", oracle=f"WITH {OVERLAP} SELECT file AS subject, 'overlapping_halts' AS rule_id FROM bad")
def _(t):
    return hi.halt_intervals(t.halt_rows)[1].select("subject", "rule_id")


@query("halt_state", "halt_rows", "status_days", oracle=f"""WITH {OVERLAP},
    g AS (SELECT * FROM halt_rows WHERE file NOT IN (SELECT file FROM bad) AND resume_date IS DISTINCT FROM halt_date),
    {ASKED.format('halt_rows WHERE file NOT IN (SELECT file FROM bad)')},
    m AS (SELECT a.code, a.date, CASE WHEN halt_date = date OR date < resume_date THEN 'suspended' ELSE 'resumption_event' END AS s,
                 row_number() OVER (PARTITION BY a.code, date ORDER BY halt_date) AS k
          FROM asked a JOIN g ON g.code = a.code AND halt_date <= date AND (halt_date = date OR date <= resume_date))
    SELECT a.code, a.date, coalesce(m.s, 'unknown') AS state FROM asked a
    LEFT JOIN m ON m.code = a.code AND m.date = a.date AND m.k = 1""")
def _(t):
    good, _ = hi.halt_intervals(t.halt_rows)
    return hi.halt_state(good, asked(t, good))


@query("compare_halt_timing", "halt_rows", oracle="""
    SELECT code, halt_date < resume_date AND source_row_number % 3 <> 0 AS effective_dates_match,
           halt_date + (source_row_number % 3 = 0)::int < resume_date AS calendar_order_valid,
           source_row_number % 2 = 0 AS publication_times_recorded, false AS publication_time_verified,
           CASE WHEN source_row_number % 7 = 0 THEN 'bad_clock' END AS reason
    FROM halt_rows WHERE resume_date IS NOT NULL""")
def _(t):
    key = F.col("source_row_number")
    shifted = F.when(key % 3 == 0, F.date_add("halt_date", 1)).otherwise(F.col("halt_date"))
    disclosures = t.halt_rows.filter("resume_date IS NOT NULL").select(
        "code", F.col("halt_date").alias("first_disclosed_on"), shifted.alias("first_effective_on"),
        F.when(key % 7 == 0, "25:00").otherwise("09:30").alias("first_disclosed_at"),
        F.col("resume_date").alias("second_disclosed_on"), F.col("resume_date").alias("second_effective_on"),
        F.when(key % 2 == 0, "10:00").otherwise("").alias("second_disclosed_at"),
    )
    return hi.compare_halt_timing(t.halt_rows, disclosures)


@query("compare_designation_timing", "designation_rows", oracle="""
    WITH d AS (SELECT code, min(date) FILTER (event = '지정') AS a, max(date) FILTER (event = '해제') AS b
               FROM designation_rows GROUP BY code HAVING a IS NOT NULL AND b IS NOT NULL)
    SELECT code, a < b AS effective_dates_match, a < b AS calendar_order_valid, true AS publication_times_recorded,
           false AS publication_time_verified, cast(NULL AS varchar) AS reason FROM d""")
def _(t):
    spans = t.designation_rows.groupBy("code").agg(
        F.min(F.when(F.col("event") == "지정", F.col("date"))).alias("a"), F.max(F.when(F.col("event") == "해제", F.col("date"))).alias("b")
    ).dropna()
    disclosures = spans.select(
        "code", F.col("a").alias("first_disclosed_on"), F.col("a").alias("first_effective_on"), F.lit("08:00").alias("first_disclosed_at"),
        F.col("b").alias("second_disclosed_on"), F.col("b").alias("second_effective_on"), F.lit("18:00").alias("second_disclosed_at"),
    )
    return hi.compare_designation_timing(t.designation_rows, disclosures)
