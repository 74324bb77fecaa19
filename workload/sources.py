"""Landed versions, envelopes, metadata and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from knownat.findings import union_all
from knownat.operators import lifecycle as lc
from knownat.operators import quality as qu
from knownat.functions.hashing import digest_tree, model_fingerprint
from knownat.schemas import DAILY_MARKET_API
from knownat.session import scratch_folder
from knownat.sources import landing as la
from knownat.sources import tables as tb
from knownat.streaming import ingest
from workload import parts
from workload.lifecycle import INTERVALS
from workload.quality import NORMALIZED, normalized
from workload.registry import Inputs, query


def manifest(t: Inputs):
    """A manifest that knows the English payloads already."""
    return t.versions.filter("scope = 'en'").select("raw_version_id", "dataset", "scope", "sha256")


@query("register_raw", "documents", "versions", oracle="""
    WITH m AS (SELECT * FROM versions WHERE scope = 'en'),
    f AS (SELECT source AS dataset, lang AS scope, sha256(text) AS sha256, min(doc_id) AS first_seen FROM documents GROUP BY ALL)
    SELECT (SELECT max(raw_version_id) FROM m) + row_number() OVER (ORDER BY first_seen) AS raw_version_id, f.*
    FROM f WHERE (dataset, scope, sha256) NOT IN (SELECT (dataset, scope, sha256) FROM m)""")
def _(t):
    return la.register_raw(t.landing, manifest(t))


@query("changed_versions", "versions", oracle="""
    SELECT raw_version_id, dataset, scope, sha256 FROM versions
    QUALIFY row_number() OVER (PARTITION BY dataset, scope ORDER BY raw_version_id) > 1""")
def _(t):
    return la.changed_versions(t.versions).select("raw_version_id", "dataset", "scope", "sha256")


@query("schema_drift", "events", oracle="""
    WITH v AS (SELECT event_type AS dataset, event_id AS raw_version_id, user_id % 3 AS k FROM events),
    s AS (SELECT *, lag(k) OVER (PARTITION BY dataset ORDER BY raw_version_id) AS b FROM v)
    SELECT dataset, raw_version_id, 'schema_drift' AS rule_id FROM s WHERE b <> k""")
def _(t):
    extra = F.array(F.lit("code"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")), F.lit("basDt"))
    return qu.schema_drift(t.events.select(F.col("event_type").alias("dataset"), F.col("event_id").alias("raw_version_id"), extra.alias("columns")))


@query("read_paged_json", "events", oracle="""
    SELECT event_id, 0 AS page, i AS item, CASE WHEN i = 0 THEN cast(user_id AS varchar) ELSE event_type END AS "srtnCd",
           CASE WHEN i = 0 THEN event_type END AS "itmsNm"
    FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_type <> 'error' AND (i = 0 OR event_id % 2 = 0)""")
def _(t):
    item = F.concat(F.lit('{"srtnCd":"'), F.col("user_id").cast("string"), F.lit('","itmsNm":"'), F.col("event_type"), F.lit('"}'))
    second = F.concat(F.lit(',{"srtnCd":"'), F.col("event_type"), F.lit('"}]'))
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), item, second)).otherwise(item)
    text = F.when(F.col("event_type") == "error", "<html>").otherwise(
        F.concat(F.lit('{"pages":[{"response":{"body":{"items":{"item":'), body, F.lit("}}}}]}")))
    rows, _ = la.read_paged_json(t.events.select("event_id", text.alias("content")), ["srtnCd", "itmsNm"])
    return rows


@query("redact_metadata", "pages", oracle="""
    SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, cast(NULL AS varchar) AS api_key, url AS note FROM pages""")
def _(t):
    raw = F.create_map(F.lit("URL"), F.col("url"), F.lit("Api_Key"), F.lit("x"), F.lit("note"), F.col("url"))
    safe = t.pages.select("page_id", la.redact_metadata(raw).alias("m"))
    return safe.select("page_id", F.col("m")["URL"].alias("url"), F.col("m")["Api_Key"].alias("api_key"), F.col("m")["note"].alias("note"))


@query("upsert", "orders", oracle="""
    SELECT o_custkey, max_by(o_orderkey, (o_orderstatus = 'P', o_orderkey)) AS seq FROM orders GROUP BY o_custkey""")
def _(t):
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("seq"), "o_orderstatus")
    old, new = rows.filter("o_orderstatus <> 'P'"), rows.filter("o_orderstatus = 'P'")
    return tb.upsert(old, new, ["o_custkey"]).select("o_custkey", "seq")


@query("append_new", "orders", oracle="""
    SELECT o_custkey, min(o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (
        SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_custkey""")
def _(t):
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_orderpriority")
    return tb.append_new(rows.filter("o_orderpriority = '1-URGENT'"), rows.filter("o_orderstatus = 'P'"), ["o_custkey"]).select("o_custkey", "seq")


#: What lands after the bars are stored: two versions of each late bar, and a code that is new.
LATE = """late AS (
    SELECT code, trade_date, close * 2 AS close, cast(1 AS bigint) AS seq FROM bars WHERE trade_date >= DATE '1998-06-01'
    UNION ALL SELECT code, trade_date, close * 3, cast(2 AS bigint) FROM bars WHERE trade_date >= DATE '1998-09-01'
    UNION ALL SELECT 'new', trade_date, max(close), cast(1 AS bigint) FROM bars WHERE trade_date >= DATE '1998-06-01' GROUP BY trade_date)"""


def stored_and_late(t: Inputs):
    """All bars but the last codes' in month partitions, and the rows that land later."""
    month = F.date_format("trade_date", "yyyy-MM").alias("month")
    bars = t.bars.select("code", "trade_date", "close", F.lit(0).cast("long").alias("seq"), month)
    root = scratch_folder(t.spark, "monthly")
    tb.upsert_into(bars.filter("code > '000003'"), root, ["code", "trade_date"], "month")
    return root, t.sql(["bars"], f", {LATE} SELECT * FROM late").select("code", "trade_date", "close", "seq", month)


@query("upsert_stored", "bars", oracle=f"""WITH {LATE}, rows_ AS (
        SELECT code, trade_date, close, cast(0 AS bigint) AS seq FROM bars WHERE code > '000003' UNION ALL SELECT * FROM late)
    SELECT code, trade_date, round(close, 6) AS close, seq FROM rows_
    QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY seq DESC) = 1""")
def _(t):
    root, late = stored_and_late(t)
    tb.upsert_into(late, root, ["code", "trade_date"], "month")
    return t.spark.read.schema(late.schema).parquet(root).select("code", "trade_date", F.round("close", 6).alias("close"), "seq")


@query("append_stored", "bars", oracle=f"""WITH {LATE}, rows_ AS (
        SELECT code, trade_date, close, cast(0 AS bigint) AS seq FROM bars WHERE code > '000003' UNION ALL SELECT * FROM late)
    SELECT code, trade_date, round(close, 6) AS close, seq FROM rows_
    QUALIFY row_number() OVER (PARTITION BY code, trade_date ORDER BY seq) = 1""")
def _(t):
    root, late = stored_and_late(t)
    tb.append_into(late, root, ["code", "trade_date"], "month")
    return t.spark.read.schema(late.schema).parquet(root).select("code", "trade_date", F.round("close", 6).alias("close"), "seq")


def stored_model(condition: str = "true") -> str:
    """SQL of the fingerprint of the identifiers and names of the lifecycle model."""
    return parts.model_fingerprint({
        "identifiers": parts.digests(
            "intervals", "raw_version_id security_id short_code source_row_number standard_code valid_from valid_to"),
        "names": parts.digests(
            f"intervals WHERE {condition}", "name raw_version_id security_id source_row_number valid_from valid_to")})


def model_tables(rows):
    model = lc.build_model(rows)
    return {"identifiers": model.identifiers, "names": model.names}


@query("model_fingerprint", "lifecycle_rows", oracle=f"WITH {INTERVALS} {stored_model()}")
def _(t):
    return model_fingerprint(model_tables(t.lifecycle_rows))


@query("verify_rebuild", "lifecycle_rows", oracle=f"""WITH {INTERVALS},
    whole AS ({stored_model()}), part AS ({stored_model('raw_version_id <> 4')})
    SELECT w.fingerprint AS expected, w.fingerprint AS actual, 'verified' AS status FROM whole w
    UNION ALL SELECT w.fingerprint, p.fingerprint, 'mismatch' FROM whole w, part p""")
def _(t):
    stored = model_fingerprint(model_tables(t.lifecycle_rows))
    again = model_tables(t.lifecycle_rows.repartition(7, "source_row_number"))
    lacking = again | {"names": again["names"].filter("raw_version_id <> 4")}
    return qu.verify_rebuild(again, stored).unionByName(qu.verify_rebuild(lacking, stored))


MODEL_COLUMNS = {
    "identifiers": "raw_version_id security_id short_code source_row_number standard_code valid_from valid_to",
    "intervals": "issuer_id market name raw_version_id security_id security_kind short_code source_row_number standard_code valid_from valid_to",
    "names": "name raw_version_id security_id source_row_number valid_from valid_to",
}
MODEL_DAYS = {name: "valid_from" for name in MODEL_COLUMNS}


def tree_sql(rows: str) -> str:
    """Leaves of the model built from the given table of source rows."""
    parts_ = " UNION ALL ".join(parts.leaves(name, "intervals", columns, "valid_from") for name, columns in MODEL_COLUMNS.items())
    return f"(WITH {INTERVALS.replace('lifecycle_rows', rows)} {parts_})"


PLACES = f"""chosen_rows AS MATERIALIZED (SELECT * FROM lifecycle_rows WHERE raw_version_id <> 4),
    e AS MATERIALIZED {tree_sql('lifecycle_rows')}, a AS MATERIALIZED {tree_sql('chosen_rows')},
    places AS MATERIALIZED (
        SELECT coalesce(e.table_name, a.table_name) AS table_name, coalesce(e.day, a.day) AS day, coalesce(e.bucket, a.bucket) AS bucket,
               coalesce(e.n, 0) AS expected_rows, coalesce(a.n, 0) AS actual_rows
        FROM e FULL JOIN a ON a.table_name = e.table_name AND a.day = e.day AND a.bucket = e.bucket
        WHERE (e.n, e.w0, e.w1, e.w2, e.w3) IS DISTINCT FROM (a.n, a.w0, a.w1, a.w2, a.w3))"""


class Archive:
    """Source rows and the stored digest tree of the model of all versions, each written once."""

    def __init__(self, t: Inputs):
        self.root = scratch_folder(t.spark, "rebuild")
        self.rows = tb.store_tables({"rows": t.lifecycle_rows}, self.root)["rows"]
        self.tree = tb.store_tables({"tree": digest_tree(self.build(self.rows), MODEL_DAYS)}, self.root)["tree"]
        self.known = self.rows.select("raw_version_id").distinct()

    @staticmethod
    def build(rows):
        made = lc.build_model(rows)
        return {"identifiers": made.identifiers, "intervals": made.intervals, "names": made.names}

    def rebuilt(self, versions):
        return qu.rebuild(self.rows, versions, self.build, MODEL_DAYS, self.tree)


@query("rebuild_places", "lifecycle_rows", oracle=f"WITH {PLACES} SELECT * FROM places")
def _(t):
    archive = Archive(t)
    return archive.rebuilt(archive.known.filter("raw_version_id <> 4"))[1]


@query("rebuild_verdicts", "lifecycle_rows", oracle=f"""WITH {PLACES}, names AS (SELECT unnest(['identifiers', 'intervals', 'names']) AS table_name)
    SELECT 'all' AS selection, table_name, 'verified' AS status, 0 AS differing_days, cast(NULL AS date) AS first_day FROM names
    UNION ALL SELECT 'less', n.table_name, CASE WHEN count(day) > 0 THEN 'mismatch' ELSE 'verified' END, count(DISTINCT day), min(day)
    FROM names n LEFT JOIN places p USING (table_name) GROUP BY n.table_name
    UNION ALL SELECT 'more', table_name, 'failed', 0, NULL FROM names""")
def _(t):
    archive = Archive(t)
    other = archive.known.limit(1).select(F.lit(99).cast("long").alias("raw_version_id"))
    ways = {"all": archive.known, "less": archive.known.filter("raw_version_id <> 4"), "more": archive.known.unionByName(other)}
    # Each rebuild is a job of its own, whose verdicts are kept.
    done = {name: archive.rebuilt(versions)[0].withColumn("selection", F.lit(name)) for name, versions in ways.items()}
    return union_all(list(tb.store_tables(done, archive.root).values()))


@query("stored_fingerprint", "daily_market", oracle=f"""
    SELECT count(h) AS row_count, {parts.FINGERPRINT} AS fingerprint FROM (
        {parts.digests('(SELECT trade_date, code, name, market, cast(listed_shares AS bigint) AS shares FROM daily_market)',
                       'code market name shares trade_date')})""")
def _(t):
    rows = t.daily_market.select("trade_date", "code", "name", "market", F.col("listed_shares").cast("long").alias("shares"))
    root = scratch_folder(t.spark, "promoted")
    # The rows are made once; each promotion reads them several times.
    rows = tb.store_tables({"rows": rows}, root)["rows"]
    # Every day is promoted without its last code first, then each day that had one anew.
    tail = F.col("code") == F.lit(rows.agg(F.max("code")).first()[0])
    tb.promote_days(rows.filter(~tail), f"{root}/market", sums=f"{root}/sums")
    again = rows.join(rows.filter(tail).select("trade_date"), "trade_date", "left_semi")
    tb.promote_days(again, f"{root}/market", sums=f"{root}/sums")
    return tb.stored_fingerprint(t.spark, f"{root}/sums")


@query("verify_archive", "documents", oracle="""
    SELECT 'raw/page-' || name || '.json' AS path, name AS expected, sha256(text) AS actual,
           CASE WHEN doc_id % 11 = 0 THEN 'bad_name' WHEN doc_id % 7 = 0 THEN 'checksum_mismatch' END AS reason
    FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'n' || doc_id WHEN doc_id % 7 = 0 THEN sha256('x' || text) ELSE sha256(text) END AS name
          FROM documents)""")
def _(t):
    name = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).when(
        F.col("doc_id") % 7 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.sha2("text", 256))
    path = F.concat(F.lit("raw/page-"), name, F.lit(".json"))
    return la.verify_archive(t.documents.select(path.alias("path"), F.encode("text", "UTF-8").alias("content")))


#: The word for a code, as a file in code page 949 writes it.
CODE_949 = bytes.fromhex("c1beb8f1c4dab5e5")


def order_files(t: Inputs):
    """A file of orders per customer and ten thousand order keys: plain, marked, in code page 949, ragged, or an error page."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\r\n")
    text = t.orders.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 10_000).alias("block")).agg(lines.alias("lines"))
    kind = F.col("o_custkey") % 5
    body = F.encode(F.concat(F.lit(",note\r\n"), F.col("lines"), F.when(kind == 3, "\r\nx").otherwise("")), "UTF-8")
    head = F.when(kind == 1, F.lit(CODE_949)).when(kind == 2, F.encode(F.lit("\ufeff종목코드"), "UTF-8")).otherwise(
        F.encode(F.lit("종목코드"), "UTF-8"))
    content = F.when(kind == 0, F.encode(F.lit("<html>busy</html>"), "UTF-8")).otherwise(F.concat(head, body))
    return text.select(F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("block").cast("string")).alias("path"), content.alias("content"))


@query("read_official_csv", "orders", oracle="""
    SELECT o_custkey || '-' || o_orderkey // 10000 AS path,
           row_number() OVER (PARTITION BY o_custkey, o_orderkey // 10000 ORDER BY o_orderkey) AS source_row_number,
           cast(o_orderkey AS varchar) AS code, o_orderpriority AS note FROM orders WHERE o_custkey % 5 NOT IN (0, 3)""")
def _(t):
    return la.read_official_csv(order_files(t), ["종목코드", "note"])[0].withColumnRenamed("종목코드", "code")


@query("unusable_files", "orders", oracle="""
    SELECT DISTINCT o_custkey || '-' || o_orderkey // 10000 AS path, CASE o_custkey % 5 WHEN 0 THEN 'html_response' ELSE 'ragged_row' END AS rule_id
    FROM orders WHERE o_custkey % 5 IN (0, 3)""")
def _(t):
    return la.read_official_csv(order_files(t), ["종목코드", "note"])[1]


@query("company_master", "customer", oracle="""
    SELECT stock, lpad(cast(max(c_custkey) AS varchar), 8, '0') AS corp_code, max_by(c_name, c_custkey) AS name
    FROM (SELECT *, lpad(cast(c_custkey // 2 AS varchar), 6, '0') AS stock FROM customer) WHERE c_custkey % 13 <> 0 GROUP BY stock""")
def _(t):
    key = F.col("c_custkey")
    stock = F.lpad(F.floor(key / 2).cast("string"), 6, "0")
    code = F.when(key % 13 == 0, "none").otherwise(F.lpad(key.cast("string"), 8, "0"))
    entry = F.concat(F.lit("<list><corp_code> "), code, F.lit("</corp_code><corp_name>"), F.col("c_name"),
                     F.lit("</corp_name><stock_code>"), stock, F.lit(" </stock_code></list>"))
    # A file for each hundred customers.
    files = t.customer.groupBy(F.floor(key / 100).alias("file")).agg(
        F.array_sort(F.collect_list(F.struct(key.alias("k"), entry.alias("e")))).alias("entries"))
    body = F.array_join(F.transform("entries", lambda x: x["e"]), "")
    return la.parse_company_master(files.select("file", F.concat(F.lit("<result>"), body, F.lit("</result>")).alias("content")), "file")


@query("judge_landed_days", "raw_daily", oracle=f"""WITH RECURSIVE {NORMALIZED},
    d AS MATERIALIZED (
        SELECT requested_date AS trade_date, count(*) AS n, sum(marcap) AS cap, row_number() OVER (ORDER BY requested_date) AS k,
               count(*) > count(DISTINCT code) OR count(*) FILTER (close IS NULL) > 0 OR count(DISTINCT market) < 2 AS hard
        FROM normal GROUP BY requested_date),
    walk AS (
        SELECT cast(0 AS bigint) AS k, cast(NULL AS date) AS trade_date, '' AS state, false AS row_anomaly, false AS cap_anomaly,
               cast([] AS double[]) AS counts, cast(NULL AS double) AS cap
        UNION ALL
        SELECT k, trade_date, CASE WHEN hard THEN 'failed' WHEN odd OR jump THEN 'quarantined' ELSE 'promoted' END, odd, jump,
               CASE WHEN hard OR odd OR jump THEN counts
                    ELSE list_slice(list_append(counts, n), greatest(len(counts) - 18, 1), len(counts) + 1) END,
               CASE WHEN hard OR odd OR jump THEN before ELSE cap END
        FROM (SELECT d.*, w.counts, w.cap AS before, coalesce(abs(d.cap / w.cap - 1) >= 0.2 - 1e-12, false) AS jump,
                     len(w.counts) >= 20 AND (d.n / list_median(w.counts) < 0.9 OR d.n / list_median(w.counts) > 1.1) AS odd
              FROM walk w JOIN d ON d.k = w.k + 1))
    SELECT trade_date, state, row_anomaly, cap_anomaly FROM walk WHERE k > 0""")
def _(t):
    return ingest.judge_days(normalized(t), None)


LANDED = """item AS (
    SELECT trade_date, code, name, market, CASE WHEN day(trade_date) = 30 THEN 'n/a' ELSE cast(close AS string) END AS clpr
    FROM daily_market)"""


def landed_files(t: Inputs):
    """One payload a day: paged JSON, CSV on the 28th, no rows on the 31st (delivered three times), another header on the 20th, a bad
    price on the 30th; the 15th and 16th land again in the last batch, the former with other content."""
    items = t.sql(["daily_market"], f", {LANDED} SELECT * FROM item")
    day, stamp = F.dayofmonth("trade_date"), F.date_format("trade_date", "yyyyMMdd")
    value = {"basDt": stamp, "srtnCd": F.col("code"), "itmsNm": F.col("name"), "mrktCtg": F.col("market"), "clpr": F.col("clpr")}
    one = F.lit("1")

    def line(cap: str):
        full = {h: value.get(h, F.lit(cap) if h == "mrktTotAmt" else one) for h in DAILY_MARKET_API}
        return F.to_json(F.struct(*[c.alias(h) for h, c in full.items()]))

    # Of a day only the texts that its deliveries hold are made.
    made, csv, other = ~day.isin(28, 31), day == 28, day == 15
    cells = [stamp, "code", "name", "market", one, one, one, "clpr", one, one, F.lit("1000000"), one]
    row = F.struct("code", F.when(made, line("1000000")).alias("json"), F.when(other, line("1000001")).alias("other"),
                   F.when(csv, F.concat_ws(",", *cells)).alias("csv"))
    days = items.groupBy("trade_date").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def page(field: str):
        text = F.array_join(F.transform("rows", lambda r: r[field]), ",")
        text = F.when(day == 20, F.replace(text, F.lit('"basDt"'), F.lit('"note":"x","basDt"'))).otherwise(text)
        text = F.when(day == 31, "").otherwise(text)
        return F.concat(F.lit('{"pages":[{"response":{"body":{"items":{"item":['), text, F.lit("]}}}}]}"))

    head = "기준일자,종목코드,종목명,시장구분,시가,고가,저가,종가,거래량,거래대금,시가총액,상장주식수\n"
    table = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["csv"]), "\n"))
    own = F.when(F.year("trade_date") < 1995, 0).otherwise(1)

    def delivery(k: int, batch):
        return F.struct(F.lit(k).alias("k"), batch.alias("batch"))

    delivered = F.array_compact(F.array(
        delivery(1, own), F.when(day == 31, delivery(2, own)), F.when(day.isin(15, 16, 31), delivery(3, F.lit(2)))))
    text = F.when(csv, table).when(other & (F.col("d.k") == 3), page("other")).otherwise(page("json"))
    every = days.withColumn("d", F.explode(delivered)).select("trade_date", "d", text.alias("text"))
    path = F.concat(F.lit("/landing/"), F.when(csv, "csv").otherwise("api"), F.lit("/"), F.col("trade_date").cast("string"), F.lit("/"),
                    F.col("d.k").cast("string"), F.when(csv, ".csv").otherwise(".json"))
    return every.select(
        path.alias("path"), (F.col("trade_date").cast("timestamp") + F.make_dt_interval(mins=F.col("d.k"))).alias("modificationTime"),
        F.encode("text", "UTF-8").alias("content"), F.col("d.batch").alias("batch"))


@query("ingest_landing", "daily_market", oracle="""WITH RECURSIVE d AS MATERIALIZED (
        SELECT trade_date, day(trade_date) AS dom, CASE WHEN day(trade_date) = 28 THEN 'csv' ELSE 'api' END AS dataset,
               CASE WHEN year(trade_date) < 1995 THEN 0 ELSE 1 END AS batch,
               CASE WHEN day(trade_date) = 31 THEN 0 ELSE count(*) FILTER (market IN ('KOSPI', 'KOSDAQ')) END AS n,
               count(DISTINCT market) FILTER (market IN ('KOSPI', 'KOSDAQ')) < 2 OR day(trade_date) = 30 AS hard,
               row_number() OVER (ORDER BY trade_date) AS k FROM daily_market GROUP BY trade_date),
    told AS (SELECT *, coalesce((dom = 20) <> lag(dom = 20) OVER (PARTITION BY dataset ORDER BY k), false) AS drift FROM d WHERE dom <> 31),
    f AS MATERIALIZED (SELECT d.*, coalesce(told.drift, false) AS drift FROM d LEFT JOIN told USING (trade_date)),
    walk AS (
        SELECT cast(0 AS bigint) AS k, cast(NULL AS date) AS trade_date, '' AS state, cast([] AS double[]) AS counts, cast(NULL AS double) AS cap
        UNION ALL
        SELECT k, trade_date, state, CASE WHEN state = 'promoted'
                   THEN list_slice(list_append(counts, n), greatest(len(counts) - 18, 1), len(counts) + 1) ELSE counts END,
               CASE WHEN state = 'promoted' THEN n ELSE cap END
        FROM (SELECT f.*, w.counts, w.cap,
                     CASE WHEN dom = 31 OR hard THEN 'failed'
                          WHEN drift OR coalesce(abs(n / w.cap - 1) >= 0.2 - 1e-12, false)
                               OR (len(w.counts) >= 20 AND (n / list_median(w.counts) < 0.9 OR n / list_median(w.counts) > 1.1))
                          THEN 'quarantined' ELSE 'promoted' END AS state
              FROM walk w JOIN f ON f.k = w.k + 1)),
    j AS MATERIALIZED (SELECT f.*, w.state FROM f JOIN walk w USING (k)),
    turns AS (
        SELECT *, batch AS b, 1 AS turn, state AS s, false AS changed, drift AS moved, 1 AS attempts FROM j
        UNION ALL SELECT *, batch, 2, 'failed', false, false, 2 FROM j WHERE dom = 31
        UNION ALL SELECT *, 2, 1, 'calendar_unresolved', false, false, 3 FROM j WHERE dom = 31
        UNION ALL SELECT *, 2, 1, state, false, false, 2 FROM j WHERE dom = 16
        UNION ALL SELECT *, 2, 1, CASE WHEN state = 'failed' THEN 'failed' ELSE 'quarantined' END, true, false, 2 FROM j WHERE dom = 15)
    SELECT cast(b AS int) AS batch_id, turn, trade_date, dataset, s AS state, changed, moved AS drift, attempts,
           CASE WHEN s <> 'promoted' THEN 0 ELSE n END AS stored_rows FROM turns""")
def _(t):
    root = scratch_folder(t.spark, "ingest")
    landed_files(t).write.parquet(f"{root}/landing")
    files = t.spark.read.parquet(f"{root}/landing")
    for batch in range(3):
        ingest.ingest_files(files.filter(F.col("batch") == batch), batch, root)
    stored = t.spark.read.parquet(f"{root}/market").groupBy("trade_date", "raw_version_id").agg(F.count("*").alias("stored_rows"))
    return t.spark.read.parquet(f"{root}/verdicts").join(stored, ["trade_date", "raw_version_id"], "left").select(
        "batch_id", "turn", "trade_date", "dataset", "state", "changed", "drift", "attempts", F.coalesce("stored_rows", F.lit(0)).alias("stored_rows"))
