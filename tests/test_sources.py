"""Files, published tables and streaming ingest, in a temporary folder."""

import csv
import gzip
import hashlib
import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from knownat.findings import BlockingFindings, findings, require_clean
from knownat.operators.normalize import MissingColumns, normalize_daily_market
from knownat.sources import landing as la
from knownat.sources import lookups as lk
from knownat.sources import tables as tb


def test_csv_in_both_encodings_and_unusable_files(spark, tmp_path):
    body = "종목코드,종목명\n000660,하이닉스\n005930,삼성\n"
    (tmp_path / "a.csv").write_bytes(body.encode("cp949"))
    (tmp_path / "b.csv").write_bytes(body.encode("utf-8-sig"))
    (tmp_path / "c.csv").write_bytes(b"<html>busy</html>")
    (tmp_path / "d.csv").write_bytes(b"x,y\n1\n")
    (tmp_path / "e.csv").write_bytes(b"\xff\xff,\xff\n")
    rows, bad = la.read_official_csv(la.read_landing(spark, str(tmp_path), "*.csv"), ["종목코드", "종목명"])
    assert sorted((r["source_row_number"], r["종목코드"], r["종목명"]) for r in rows.collect()) == sorted(
        [(1, "000660", "하이닉스"), (2, "005930", "삼성")] * 2)
    assert {(r["path"][-5], r["rule_id"]) for r in bad.collect()} == {("c", "html_response"), ("d", "ragged_row"), ("e", "unknown_encoding")}


def test_csv_pieces_equal_a_plain_reader(spark):
    """Records with quoted commas, quotes and line ends, blank lines and repeated headers; a long file is cut into many pieces."""
    rows = [[str(i), f'say "{i}", twice\r\nor\nmore' if i % 3 else "", f"x{i}", f'mid"{i}'] for i in range(60_000)]
    out = io.StringIO()
    csv.writer(out).writerows([["id", "note", "same", "same"], *rows])
    body = out.getvalue().replace("\r\n7,", "\r\n\r\n7,")
    bare = 'a,b\n1,x"y\n2,"z"w\n\n'
    contents = {"long": body.encode("cp949"), "bare": bare.encode(), "late": (body + "one,two\r\n").encode(), "none": b"a,b\n\n",
                "thin": b"a\n1\n", "void": None, "blank": b""}
    files = spark.createDataFrame(list(contents.items()), "path string, content binary")
    # Three pieces are little: adaptive execution would put them together again or broadcast them.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert la.decode_files(files)[0].filter("path = 'long'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got, bad = la.read_official_csv(files, ["id", "note", "same", "lacking"])
    expected = [tuple(r) for r in list(csv.reader(io.StringIO(body)))[1:] if r]
    found = {r["source_row_number"]: (r["id"], r["note"], r["same"], r["lacking"]) for r in got.filter("path = 'long'").collect()}
    assert found == {n: (r[0], r[1], r[3], None) for n, r in enumerate(expected, 1)}
    two, _ = la.read_official_csv(files.filter("path = 'bare'"), ["a", "b"])
    assert sorted((r["a"], r["b"]) for r in two.collect()) == [("1", 'x"y'), ("2", "zw")]
    assert {r["path"]: r["rule_id"] for r in bad.collect()} == {
        "late": "ragged_row", "none": "no_rows", "thin": "too_few_columns", "void": "empty_file", "blank": "empty_file"}
    assert la.decode_files(files.limit(0))[0].count() == 0


def test_small_files_leave_the_cutter_together():
    """A frame for each small file took most of the time of a folder of many files."""
    contents = [f"a,b\n{i},x\n".encode() for i in range(3_000)]
    files = pd.DataFrame({"path": [str(i) for i in range(3_000)], "content": contents})
    frames = list(la._cut_files(iter([files[:2_000], files[2_000:], files[:0]])))
    assert len(frames) <= 3
    made = pd.concat(frames)
    assert list(made["path"]) == list(files["path"])
    assert [list(r) for r in made["records"]] == [[f"{i},x"] for i in range(3_000)]


def test_archive_names_are_checked_against_unpacked_content(spark, tmp_path):
    good = b"payload"
    digest = hashlib.sha256(good).hexdigest()
    (tmp_path / f"20250101T000000Z-{digest}.daily.gz").write_bytes(gzip.compress(good))
    (tmp_path / f"20250102T000000Z-{digest}.daily.gz").write_bytes(gzip.compress(b"tampered"))
    (tmp_path / "20250103T000000Z-short.daily.gz").write_bytes(gzip.compress(good))
    checked = la.verify_archive(la.read_landing(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1][:8]: r["reason"] for r in checked.collect()}
    assert got == {"20250101": None, "20250102": "checksum_mismatch", "20250103": "bad_name"}


def test_company_master_keeps_the_last_duplicate(spark, tmp_path):
    entries = [("000660", "00164779", "old"), ("000660", "00164779", "new"), ("bad", "00000001", "x"), ("005930", "12", "y")]
    text = "".join(f"<list><stock_code>{s}</stock_code><corp_code>{c}</corp_code><corp_name>{n}</corp_name></list>" for s, c, n in entries)
    (tmp_path / "master.xml").write_text(f"<result>{text}</result>", encoding="utf-8")
    assert [tuple(r) for r in la.read_company_master(spark, str(tmp_path / "master.xml")).collect()] == [("000660", "00164779", "new")]


def test_registering_the_same_content_again_adds_nothing(spark):
    landed = spark.createDataFrame([(1, "d", "s", "x"), (2, "d", "s", "y"), (3, "d", "s", "x")], "landing_seq long, dataset string, scope string, content string")
    empty = spark.createDataFrame([], "raw_version_id long, dataset string, scope string, sha256 string")
    first = la.register_raw(landed, empty)
    assert [r["raw_version_id"] for r in first.orderBy("raw_version_id").collect()] == [1, 2]
    assert la.register_raw(landed, first).count() == 0
    assert [r["raw_version_id"] for r in la.changed_versions(first).collect()] == [2]


def market(spark, rows):
    return spark.createDataFrame(rows, "trade_date date, code string, close double")


def test_promotion_replaces_only_its_own_day(spark, tmp_path):
    import datetime as dt

    path, one, two = str(tmp_path / "t"), dt.date(2025, 1, 2), dt.date(2025, 1, 3)
    tb.promote_days(market(spark, [(one, "a", 1.0), (two, "a", 2.0)]), path)
    tb.promote_days(market(spark, [(two, "b", 3.0)]), path)
    assert {(r["trade_date"], r["code"]) for r in spark.read.parquet(path).collect()} == {(one, "a"), (two, "b")}
    states = spark.createDataFrame([(one, "parsed")], "trade_date date, state string")
    tb.promote_days(market(spark, [(one, "z", 9.0)]), path, states)
    assert spark.read.parquet(path).filter("code = 'z'").count() == 0


def test_failed_promotion_keeps_the_earlier_revision(spark, tmp_path):
    path = str(tmp_path / "m")
    chosen = spark.createDataFrame([("d", 1)], "dataset string, raw_version_id long")
    good = spark.range(3).toDF("x")
    assert tb.promote_model(spark, path, {"t": good}, chosen) == 1
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception):
        tb.promote_model(spark, path, {"t": broken}, chosen)
    assert tb.current_revision(spark, path) == 1 and tb.load_model(spark, path, ["t"])["t"].count() == 3
    assert tb.promote_model(spark, path, {"t": good.limit(2)}, chosen) == 2
    assert tb.load_model(spark, path, ["t"])["t"].count() == 2


def test_runs_journal_and_export(spark, tmp_path):
    path = str(tmp_path / "r")
    for run in (1, 2):
        tb.save_run(spark, path, run, {"status": "complete"}, {"nav": spark.range(run).toDF("x")})
    assert [r["run_id"] for r in tb.runs(spark, path).collect()] == [2, 1]
    assert tb.load_run(spark, path, 2, ["nav"])["nav"].count() == 2
    with pytest.raises(KeyError):
        tb.load_run(spark, path, 3, ["nav"])
    with pytest.raises(FileExistsError):
        tb.save_run(spark, path, 2, {"status": "complete"}, {"nav": spark.range(9).toDF("x")})
    for note in ("first", "second"):
        tb.append_journal(spark.range(1).toDF("x"), str(tmp_path / "j"), note, "{}")
    assert [r["note"] for r in tb.journal(spark, str(tmp_path / "j")).collect()] == ["second", "first"]
    tb.export_csv(spark.range(1).toDF("code"), str(tmp_path / "c"), {"code": "종목코드"})
    part = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert part.decode("utf-8").splitlines()[0] == "\ufeff종목코드"


def test_missing_headers_and_strict_mode(spark):
    with pytest.raises(MissingColumns):
        normalize_daily_market(spark.range(1).toDF("basDt"))
    found = findings(spark.range(1), source="s", severity="blocking", rule="r")
    with pytest.raises(BlockingFindings):
        require_clean(found)
    require_clean(found.filter("false"))


def test_upserts_and_appends_touch_only_their_partitions(spark, tmp_path):
    path = str(tmp_path / "prices")

    def rows(*values):
        return spark.createDataFrame(values, "code string, trade_date string, close double, seq long, month string")

    def files(month):
        return sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "prices" / f"month={month}").glob("*.parquet"))

    def stored():
        return sorted(tuple(r) for r in spark.read.parquet(path).select("code", "trade_date", "close", "seq").collect())

    keys = ["code", "trade_date"]
    tb.upsert_into(rows(("a", "2025-01-02", 1.0, 1, "01"), ("a", "2025-01-02", 2.0, 2, "01"), ("b", "2025-02-03", 3.0, 1, "02")), path, keys, "month")
    assert stored() == [("a", "2025-01-02", 2.0, 2), ("b", "2025-02-03", 3.0, 1)]
    before = files("01")
    late = rows(("b", "2025-02-03", 4.0, 1, "02"), ("c", "2025-02-04", 5.0, 1, "02"), ("c", "2025-03-04", 6.0, 1, "03"))
    for _ in range(2):
        tb.upsert_into(late, path, keys, "month")
        assert files("01") == before
        assert stored() == [("a", "2025-01-02", 2.0, 2), ("b", "2025-02-03", 4.0, 1), ("c", "2025-02-04", 5.0, 1), ("c", "2025-03-04", 6.0, 1)]
    kept = {m: files(m) for m in ("01", "02", "03")}
    for _ in range(2):
        tb.append_into(rows(("c", "2025-03-04", 9.0, 1, "03"), ("d", "2025-03-05", 8.0, 2, "03"), ("d", "2025-03-05", 7.0, 1, "03")), path, keys, "month")
        assert ("c", "2025-03-04", 6.0, 1) in stored() and ("d", "2025-03-05", 7.0, 1) in stored() and len(stored()) == 5
        assert files("01") == kept["01"] and files("02") == kept["02"] and set(kept["03"]) <= set(files("03"))
    tb.upsert_into(rows().filter("false"), path, keys, "month")
    assert len(stored()) == 5
    plan = tb.touched_partitions(path, late, "month")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan
    many = tb.touched_partitions(path, late, "month", most=1)
    assert {r["month"] for r in many.collect()} == {"02", "03"} and tb.touched_partitions(str(tmp_path / "none"), late, "month") is None


def test_point_reads_skip_most_of_a_sorted_table(spark, tmp_path):
    days = spark.range(200).selectExpr("date_add(DATE '2020-01-01', cast(id AS int)) AS trade_date")
    bars = spark.range(300).selectExpr("lpad(cast(id AS string), 6, '0') AS code").crossJoin(days).withColumn("close", F.rand(3))
    stored = lk.store_sorted(bars, str(tmp_path / "bars"), ["code", "trade_date"], group_bytes=1 << 14, page_rows=500)

    def scanned(df):
        plan = df._jdf.queryExecution().executedPlan()
        df.collect()
        leaf = plan.collectLeaves().head()
        return leaf.metrics().get("numOutputRows").get().value()

    one = lk.prices(stored, "000123", "2020-02-01", "2020-02-10")
    assert one.count() == 10 and lk.prices(stored, "000123").count() == 200 and lk.prices(stored, "none").count() == 0
    assert 10 <= scanned(lk.prices(stored, "000123", "2020-02-01", "2020-02-10")) < 60_000 / 20
    assert lk.prices(stored, "000123", start="2020-07-01").count() == lk.prices(stored, "000123", end="2020-01-18").count()
    assert stored.count() == bars.count()


def test_lookups_by_date(spark):
    snapshots = spark.createDataFrame([("2025-01-03", "a"), ("2025-01-10", "a"), ("2025-01-10", "b")], "d string, code string").select(
        F.to_date("d").alias("signal_date"), "code")
    assert [r["code"] for r in lk.historical_snapshot(snapshots, "2025-01-03").collect()] == ["a"]
    assert sorted(r["code"] for r in lk.snapshot_before(snapshots, "2025-01-12").collect()) == ["a", "b"]
    assert lk.snapshot_before(snapshots, "2025-01-01").count() == 0 and lk.historical_snapshot(snapshots, "2025-01-04").count() == 0
    actions = spark.createDataFrame([("a", "2025-01-02", "split", 1), ("a", "2025-01-02", "split", 2), ("a", "2025-01-09", "split", 3)],
                                    "code string, effective_date string, action_type string, seq long")
    assert [r["seq"] for r in lk.actions_between(actions, "2025-01-01", "2025-01-02").collect()] == [2]
    typed = actions.withColumn("effective_date", F.to_date("effective_date"))
    assert sorted(r["seq"] for r in lk.actions_between(typed, "2025-01-02", "2025-01-09").collect()) == [2, 3]
