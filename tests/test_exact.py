"""Values and places that must be exact: amounts, refused orders, stored fingerprints, rebuilds."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from knownat.functions import hashing as ha
from knownat.functions.text import amount
from knownat.operators import fundamentals as fu
from knownat.operators import orders as od
from knownat.operators import quality as qu
from knownat.sources import tables as tb

D = dt.date


def test_amounts_are_exact_or_refused(spark):
    texts = ["1.00001", "1.00002", "1,234.50", "0.0000000001", "0.00000000001", "1.000000000000", "1e3", "5e-10", "5e-11", "-7", "x", "", "NaN", "Infinity", None,
             "1" * 28, "1" * 29]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = [None if r["a"] is None else r["a"].normalize() for r in table.select("k", amount(F.col("t")).alias("a")).orderBy("k").collect()]
    shown = [None if a is None else f"{a:f}" for a in found]
    assert shown == ["1.00001", "1.00002", "1234.5", "0.0000000001", None, "1", "1000", "0.0000000005", None, "-7", None, None, None, None, None, "1" * 28, None]


def test_amounts_that_differ_late_are_ambiguous(spark):
    rows = [("a", 2024, "OFS", "r", "ifrs_ProfitLoss", "IS", v, "KRW") for v in ("1.00001", "1.00002")]
    rows += [("b", 2024, "OFS", "r", "ifrs_ProfitLoss", "IS", v, "KRW") for v in ("1.00001", "1.0000100")]
    rows += [("c", 2024, "OFS", "r", "ifrs_ProfitLoss", "IS", "0.00000000001", "KRW")]
    table = spark.createDataFrame(rows, "stock string, year int, basis string, receipt string, account_id string, sj_div string, thstrm_amount string, currency string")
    found = {r["stock"]: r["reason"] for r in fu.pick_account(table, "profit", fu.PROFIT, fu.PROFIT_SECTIONS, ["thstrm_amount"]).collect()}
    assert found == {"a": "profit_ambiguous", "b": None, "c": "profit_not_numeric"}


@pytest.mark.parametrize("execution", [True, False])
def test_a_target_too_dear_for_its_share_is_sold_and_refused(spark, execution):
    day = D(2025, 1, 3)
    accounts = spark.createDataFrame([("p", day, 100_000.0)], "account string, signal_date date, cash double")
    held = spark.createDataFrame([("p", "000001", 1.0)], "account string, code string, quantity double")
    ranked = spark.createDataFrame([(day, "000001", 1, "A", 400_000.0)], "signal_date date, code string, rank int, name string, price double")
    found = od.rebalance(accounts, held, ranked, ranked.select("signal_date", "code", "price"), execution=execution)
    assert [(r["side"], r["quantity"]) for r in found.orders().collect()] == [("sell", 1)]
    refused = [(r["code"], r["side"], r["reason"]) for r in found.unfilled().collect()]
    assert refused == ([("000001", "buy", "allocation_too_small")] if execution else [])


def test_digest_words_are_summed_as_whole_numbers(spark):
    digests = [None, "f" * 64, "f" * 64, "0" * 64] + [hashlib.sha256(str(k).encode()).hexdigest() for k in range(50)]
    table = spark.createDataFrame([(k % 2, d) for k, d in enumerate(digests)], "k int, digest string")
    sums = ha.digest_sums(table, "k")
    for row in sums.collect():
        own = [d for k, d in enumerate(digests) if k % 2 == row["k"] and d]
        assert row["row_count"] == len(own)
        assert [int(row[w]) for w in ha.WORDS] == [sum(int(d[15 * n:15 * n + 15], 16) for d in own) for n in range(4)]
    # Decimals come in after the aggregation of longs.
    assert "as bigint" in sums._jdf.queryExecution().optimizedPlan().toString()
    assert [int(v) for v in ha.digest_sums(table.limit(0)).first()] == [0] * 5


def test_days_are_digested_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(D(2024, 1, 1 + k % 5), f"{k:06d}") for k in range(50)], "trade_date date, code string")
    joined, own = [], type(rows).join
    monkeypatch.setattr(type(rows), "coalesce", lambda *_: pytest.fail("one task would digest all rows"))
    monkeypatch.setattr(type(rows), "join", lambda self, *rest: joined.append(own(self, *rest)) or joined[-1])
    tb.promote_days(rows, f"{tmp_path}/market", sums=f"{tmp_path}/sums")
    assert any("broadcast" in found._jdf.queryExecution().analyzed().toString() for found in joined)
    assert tb.stored_fingerprint(spark, f"{tmp_path}/sums").first() == ha.table_fingerprint(rows).first()


def test_stored_fingerprint_equals_the_full_one_after_replacements(spark, tmp_path):
    random_ = random.Random(8)
    path, sums, rows = str(tmp_path / "m"), str(tmp_path / "s"), {}
    for _ in range(4):
        batch = {D(2025, 1, random_.randrange(1, 9)): [(f"{k:06d}", random_.random()) for k in range(random_.randrange(1, 5))] for _ in range(3)}
        rows |= batch
        table = spark.createDataFrame([(day, *r) for day, own in batch.items() for r in own], "trade_date date, code string, close double")
        tb.promote_days(table, path, sums=sums)
        whole = spark.createDataFrame([(day, *r) for day, own in rows.items() for r in own], table.schema)
        assert tb.stored_fingerprint(spark, sums).first() == ha.table_fingerprint(whole).first()


def test_rebuilds_name_the_places_that_differ(spark):
    schema = "raw_version_id long, valid_from date, name string"
    rows = spark.createDataFrame([(k % 3, D(2025, 1, 1 + k % 7), f"n{k}") for k in range(200)] + [(0, None, "undated")] * 2, schema)
    chosen = spark.createDataFrame([(k,) for k in range(3)], "raw_version_id long")

    def build(own):
        return {"names": own, "codes": own.select("raw_version_id", "valid_from").filter("raw_version_id < 2")}

    days = {"names": "valid_from", "codes": "valid_from"}
    stored = ha.digest_tree(build(rows), days)
    assert ha.tree_fingerprint(stored).first() == ha.model_fingerprint(build(rows)).first()
    verdicts, places = qu.rebuild(rows.repartition(5), chosen, build, days, stored)
    assert {(r["table_name"], r["status"]) for r in verdicts.collect()} == {("names", "verified"), ("codes", "verified")} and places.count() == 0
    other = rows.withColumn("name", F.when(F.col("name") == "n10", "m10").otherwise(F.col("name")))
    verdicts, places = qu.rebuild(other, chosen, build, days, stored)
    assert {(r["table_name"], r["status"], r["first_day"]) for r in verdicts.collect()} == {("names", "mismatch", D(2025, 1, 4)), ("codes", "verified", None)}
    found = places.collect()
    assert {r["day"] for r in found} == {D(2025, 1, 4)} and len(found) in (1, 2) and sum(r["expected_rows"] - r["actual_rows"] for r in found) == 0
    verdicts, _ = qu.rebuild(rows.filter("raw_version_id > 0"), chosen, build, days, stored)
    assert {r["status"] for r in verdicts.collect()} == {"failed"}
