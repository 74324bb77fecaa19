"""File-driven ingest and streamed status assertions: verdicts, replays, late knowledge."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from knownat.functions import calendar as cal
from knownat.operators import investability as iv
from knownat.operators import quality as qu
from knownat.schemas import DAILY_MARKET_API
from knownat.sources import landing as la
from knownat.streaming import ingest
from knownat.streaming import status as st
from workload.registry import Inputs
from workload.sources import landed_files

D = dt.date
UTF8_HEAD = "기준일자,종목코드,종목명,시장구분,시가,고가,저가,종가,거래량,거래대금,시가총액,상장주식수"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def item(day, code, market, close="1,000", cap="10", **more):
    values = [day.replace("-", ""), code, " A ", market, "", "1", "1", close, "0", "0", cap, "5"]
    return dict(zip(DAILY_MARKET_API, values)) | more


def page(*items):
    return json.dumps({"pages": [{"response": {"body": {"items": {"item": list(items)}}}}]}).encode()


def day(text, close="1,000", cap="10", **more):
    return page(item(text, "660", "kospi", close, cap, **more), item(text, "1.0", "KOSDAQ GLOBAL", "2", cap, **more), item(text, "2", "KONEX"))


class Landing:
    """Lands files in a folder and takes them in as the stream does."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.root, self.batches = spark, folder, str(folder / "tables"), 0

    def land(self, **files):
        """Each name is ``source_yyyy_mm_dd_name``; returns states by day and turn of this batch."""
        for place, content in files.items():
            source, y, m, d, name = place.split("_")
            path = self.folder / "in" / source / f"{y}-{m}-{d}" / name.replace("xj", ".json").replace("xc", ".csv")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
        ingest.ingest_stream(self.spark, str(self.folder / "in"), self.root, str(self.folder / "check")).awaitTermination(170)
        self.batches += 1
        rows = self.table("verdicts").filter(F.col("batch_id") == self.batches - 1).collect()
        return {(r["trade_date"].day, r["turn"]): r["state"] for r in rows}

    def table(self, name):
        return self.spark.read.parquet(f"{self.root}/{name}")

    def market(self):
        return sorted((r["trade_date"].day, r["code"], r["close"], r["raw_version_id"]) for r in self.table("market").collect())

    def rules(self):
        return sorted((r["batch_id"], r["date"].day, r["rule_id"]) for r in self.table("findings").collect())


def test_landed_files_are_versions_judged_once(spark, tmp_path):
    box = Landing(spark, tmp_path)
    csv = f"{UTF8_HEAD}\n20250106,000660,A,KOSPI,,1,1,5,0,0,10,5\n20250106,1,B,KOSDAQ,,1,1,6,0,0,10,5\n".encode("cp949")
    assert box.land(
        api_2025_01_02_axj=day("2025-01-02"), api_2025_01_03_axj=day("2025-01-03", "0"), csv_2025_01_06_axc=csv,
        api_2025_01_07_axj=page(), api_2025_01_08_axj=b"<html>", api_2025_01_09_axj=day("2025-01-09", cap="13"),
    ) == {(2, 1): "promoted", (3, 1): "failed", (6, 1): "promoted", (7, 1): "failed", (8, 1): "failed", (9, 1): "quarantined"}
    assert [row[:3] for row in box.market()] == [(2, "000001", 2.0), (2, "000660", 1000.0), (6, "000001", 6.0), (6, "000660", 5.0)]
    assert box.rules() == [(0, 3, "close_not_positive"), (0, 7, "no_rows"), (0, 8, "unreadable_envelope"), (0, 9, "marcap_anomaly")]
    before = box.market()
    # The same content again is no news; other content of a promoted day or a failed one is held; two empty deliveries exhaust the day.
    assert box.land(
        api_2025_01_02_bxj=day("2025-01-02"), csv_2025_01_06_bxc=csv.replace(b",5,0,0", b",7,0,0"), api_2025_01_03_bxj=day("2025-01-03"),
        api_2025_01_07_bxj=page(), api_2025_01_07_cxj=page(),
    ) == {(2, 1): "promoted", (6, 1): "quarantined", (3, 1): "quarantined", (7, 1): "failed", (7, 2): "calendar_unresolved"}
    assert box.market() == before
    assert {r for r in box.rules() if r[0] == 1} == {(1, 3, "changed_checksum"), (1, 6, "changed_checksum"), (1, 7, "no_rows")}
    assert box.table("ledger").select("raw_version_id").distinct().count() == 8
    # A replay of the last batch writes the same tables.
    tables = {n: sorted(map(str, box.table(n).collect())) for n in ("ledger", "verdicts", "findings", "summaries", "market")}
    again = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in"))
    ingest.ingest_files(again.filter(F.regexp_like("path", F.lit(r"/[bc]\.(json|csv)$"))), 1, box.root)
    assert tables == {n: sorted(map(str, box.table(n).collect())) for n in tables}


def test_contents_are_read_once_for_the_ledger(spark, tmp_path, monkeypatch):
    written, own = [], ingest._write
    monkeypatch.setattr(ingest, "_write", lambda df, *rest: written.append(plan(df)) or own(df, *rest))
    text = day("2024-01-02")
    files = spark.createDataFrame(
        [(f"/l/api/2024-01-02/{k}.json", dt.datetime(2024, 1, 2, k), text) for k in (1, 2)], "path string, modificationTime timestamp, content binary")
    ledger = ingest.register_files(files, 0, str(tmp_path))
    assert {(r["delivery"], r["fresh"], r["changed"]) for r in ledger.collect()} == {(1, True, False), (2, True, False)}
    assert len(written) == 1 and "sha2(" not in written[0] and "content#" not in written[0]


def test_pages_are_parsed_once_and_single_items_found(spark):
    one, two, none = '{"a":"1"}', '[{"a":"2"},null,{"a":"3"},{}]', '[]'
    pages = [f'{{"response":{{"body":{{"items":{{"item":{text}}}}}}}}}' for text in (two, one, none)] + ['{"response":null}']
    texts = [f'{{"pages":[{",".join(pages)}]}}', f'{{"pages":[{pages[0]}]}}', f'{{"pages":[{pages[1]}]}}', '{"pages":[]}', '{"other":1}', "<html>", None]
    rows, broken = la.read_paged_json(spark.createDataFrame(list(enumerate(texts)), "k int, content string"), ["a", "b"])
    assert sorted((r["k"], r["page"], r["item"], r["a"]) for r in rows.collect()) == [
        (0, 0, 0, "2"), (0, 0, 1, "3"), (0, 1, 0, "1"), (1, 0, 0, "2"), (1, 0, 1, "3"), (2, 0, 0, "1")]
    assert sorted(r["k"] for r in broken.collect()) == [4, 5, 6]
    lines = plan(rows).splitlines()
    assert not any("Filter" in line and "from_json" in line for line in lines)
    assert sum(line.count("from_json") for line in lines) == 2


def test_landed_files_come_from_one_pass(spark, tmp_path):
    stamps = [dt.datetime(1994 + k % 2, 1, d) for k, d in enumerate((15, 16, 20, 28, 30, 31))]
    tables = {
        "lineitem": ([(s, 100.0 * s, 2.0, t) for t in stamps for s in (1, 2)],
                     "l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp"),
        "supplier": ([(1, "one", 0), (2, "two", 1)], "s_suppkey long, s_name string, s_nationkey long"),
        "nation": ([(0, "a", 0), (1, "b", 2)], "n_nationkey long, n_name string, n_regionkey long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    files = landed_files(Inputs(spark, str(tmp_path)))
    # The lines are scanned once, not once for each delivery.
    assert sum("Relation [" in line and "l_shipdate" in line for line in plan(files).splitlines()) == 1
    found = {(r["path"].split("/")[3][-2:], r["path"][-6:], r["batch"]): bytes(r["content"]).decode() for r in files.collect()}
    assert sorted((d, name[0], batch) for d, name, batch in found) == [
        ("15", "1", 0), ("15", "3", 2), ("16", "1", 1), ("16", "3", 2), ("20", "1", 0), ("28", "/", 1), ("30", "1", 0),
        ("31", "1", 1), ("31", "2", 1), ("31", "3", 2)]
    caps = {key[0] + key[1][0]: text.count('"mrktTotAmt":"1000000"') - text.count('"mrktTotAmt":"1000001"') for key, text in found.items()}
    assert caps == {"151": 2, "153": -2, "161": 2, "163": 2, "201": 2, "28/": 0, "301": 2, "311": 0, "312": 0, "313": 0}


def test_drift_late_days_and_notices(spark, tmp_path):
    box = Landing(spark, tmp_path)
    assert box.land(api_2025_01_06_axj=day("2025-01-06")) == {(6, 1): "promoted"}
    # An earlier day that lands late is judged by the days before it, here none.
    assert box.land(api_2025_01_03_axj=day("2025-01-03", cap="99")) == {(3, 1): "promoted"}
    assert box.land(api_2025_01_07_axj=day("2025-01-07", note="x")) == {(7, 1): "quarantined"}
    assert box.rules() == [(2, 7, "schema_drift")]
    files = spark.createDataFrame([("/in/api/2025-01-08/a.json", dt.datetime(2025, 1, 8), bytearray(page())), ("/in/stray.json", dt.datetime(2025, 1, 8), bytearray(b""))],
                                  "path string, modificationTime timestamp, content binary")
    notices = spark.createDataFrame([(D(2025, 1, 8), "holiday notice")], "trade_date date, evidence string")
    ingest.ingest_files(files, 3, box.root, notices)
    assert [r["state"] for r in box.table("verdicts").filter("batch_id = 3").collect()] == ["non_session"]
    ingest.ingest_files(files.limit(0), 4, box.root)
    assert box.table("ledger").filter("batch_id = 4").count() == 0


def test_sources_are_folded_side_by_side_in_linear_time(spark):
    def days(source, count, jump):
        return [(source, D(1800, 1, 1) + dt.timedelta(k), 100, 10.0 if k != jump else 20.0, 0, False, False, 1, None) for k in range(count)]

    schema = ("source string, trade_date date, row_count long, total_marcap double, hard_errors long, changed boolean, empty boolean, "
              "attempts int, evidence string")
    table = spark.createDataFrame(days("a", 60, 30) + days("b", 60, 99), schema)
    held = qu.resolve_day_states(table, ["source"]).filter("state <> 'promoted'").collect()
    assert [(r["source"], r["trade_date"]) for r in held] == [("a", D(1800, 1, 31))]
    many = spark.range(100_000).select(
        F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"), F.lit(100).cast("long").alias("row_count"),
        F.lit(10.0).alias("total_marcap"), F.lit(0).cast("long").alias("hard_errors"), F.lit(False).alias("changed"), F.lit(False).alias("empty"),
        F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("evidence"))
    started = dt.datetime.now()
    assert qu.resolve_day_states(many).filter("state = 'promoted'").count() == 100_000
    assert dt.datetime.now() - started < dt.timedelta(seconds=60)


# Status.

ROW = ("dataset string, requested_date date, raw_version_id long, source_row_number long, observed_at timestamp, standard_code string, short_code string, "
       "name string, market string, security_kind string, management_designation boolean, trading_suspension boolean, "
       "liquidation_trading boolean, effective_date date, published_at timestamp")
SPAN = "security_id string, issuer_id string, standard_code string, short_code string, name string, market string, security_kind string, valid_from date, valid_to date"


def said(day_, number, code="000001", halted=False, published=None, effective=None):
    return ("daily", day_, 1, number, dt.datetime(2025, 1, 6), None, code, "A", "KOSPI", "common", False, halted, False, effective or day_, published)


@pytest.fixture
def standing(spark):
    spans = [(f"s{k}", "i", f"KR{k}", f"00000{k}", "A", "KOSPI", "common", D(2025, 1, 1), None) for k in (1, 2)]
    days = [D(2025, 1, d) for d in (6, 7, 8, 9, 10)]
    asked = [(s, dt.datetime(2025, 1, d, hour)) for s in ("s1", "s2") for d in (6, 7, 8, 9) for hour in (3, 12)]
    return st.Standing(spark.createDataFrame(spans, SPAN), spark.createDataFrame([(d,) for d in days], "session_date date"),
                       spark.createDataFrame(asked, "security_id string, as_of timestamp"))


def decisions(spark, root, standing, with_batch=False):
    rows = st.current_decisions(spark, root, standing).collect()
    return {(r["security_id"], r["as_of"].day, r["as_of"].hour): (r["state"], r["batch_id"]) if with_batch else r["state"] for r in rows}


def test_late_knowledge_changes_later_decisions_only(spark, tmp_path, standing):
    root = str(tmp_path / "t")
    early = [said(D(2025, 1, d), 10 * d + k, f"00000{k}", published=dt.datetime(2025, 1, d, 1)) for d in (6, 7) for k in (1, 2)]
    st.status_batch(spark.createDataFrame(early, ROW), 0, root, standing)
    first = decisions(spark, root, standing)
    assert first["s1", 6, 3] == first["s2", 7, 12] == "eligible" and first["s1", 8, 3] == first["s1", 9, 12] == "unknown"
    # A halt in force since the sixth becomes known on the seventh at 06:00 UTC.
    late = [said(D(2025, 1, 7), 99, halted=True, published=dt.datetime(2025, 1, 7, 6), effective=D(2025, 1, 6))]
    st.status_batch(spark.createDataFrame(late, ROW), 1, root, standing)
    second = decisions(spark, root, standing, True)
    changed = {k for k in first if first[k] != second[k][0]}
    assert changed == {("s1", 7, 12)} and second["s1", 7, 12] == ("ineligible", 1)
    assert {k for k, (_, batch) in second.items() if batch == 1} <= {k for k in first if k[0] == "s1" and k[1:] >= (7, 12)}
    # Day nine is covered before day eight: evidence of the seventh reaches it only when the gap closes.
    st.status_batch(spark.createDataFrame([said(D(2025, 1, 9), 91, "000002", published=dt.datetime(2025, 1, 9, 1))], ROW), 2, root, standing)
    assert decisions(spark, root, standing)["s1", 9, 12] == "unknown"
    gap = spark.createDataFrame([said(D(2025, 1, 8), 82, "000002", published=dt.datetime(2025, 1, 8, 1))], ROW)
    st.status_batch(gap, 3, root, standing)
    closed = decisions(spark, root, standing, True)
    assert closed["s1", 9, 12] == ("ineligible", 3) and closed["s1", 7, 12] == ("ineligible", 1)
    # The whole model in one batch says the same, and a replay changes nothing.
    whole = iv.build_model(spark.createDataFrame(early + late, ROW).unionByName(gap).unionByName(
        spark.createDataFrame([said(D(2025, 1, 9), 91, "000002", published=dt.datetime(2025, 1, 9, 1))], ROW)), standing.lifecycle, standing.sessions)
    expected = {(r["security_id"], r["as_of"].day, r["as_of"].hour): r["state"] for r in iv.decide(whole, standing.requests).collect()}
    assert {k: v for k, (v, _) in closed.items()} == expected
    st.status_batch(gap, 3, root, standing)
    assert decisions(spark, root, standing, True) == closed
    assert st.all_assertions(spark, root).count() == 7


def test_rows_wait_for_the_next_session(spark, tmp_path, standing):
    root = str(tmp_path / "t")
    short = st.Standing(standing.lifecycle, standing.sessions.filter("session_date <= '2025-01-06'"), standing.requests)
    row = spark.createDataFrame([said(D(2025, 1, 6), 1)], ROW)
    st.status_batch(row, 0, root, short)
    assert [r["known_at"] for r in st.all_assertions(spark, root).collect()] == [None]
    st.status_batch(spark.createDataFrame([said(D(2025, 1, 7), 2, "000002")], ROW), 1, root, standing)
    known = {r["source_row_number"]: r["known_at"] for r in st.all_assertions(spark, root).collect()}
    midnight = spark.range(1).select(cal.at_seoul(F.lit("2025-01-07").cast("date"))).first()[0]
    assert known[1] == midnight and decisions(spark, root, standing)["s1", 7, 3] == "eligible"
    # The row that landed before is not an assertion twice.
    st.status_batch(row, 2, root, standing)
    assert st.all_assertions(spark, root).count() == 2


def test_status_files_are_streamed(spark, tmp_path, standing):
    landing, root = str(tmp_path / "in"), str(tmp_path / "t")
    for number, d in enumerate((6, 7)):
        spark.createDataFrame([said(D(2025, 1, d), number, published=dt.datetime(2025, 1, d, 1))], ROW).write.mode("append").parquet(landing)
        for _ in range(2):
            st.status_stream(spark, landing, ROW, root, str(tmp_path / "c"), standing).awaitTermination(170)
    assert st.all_assertions(spark, root).count() == 2 and decisions(spark, root, standing)["s1", 7, 12] == "eligible"
