"""Archive, vectors, components and the pipeline on small tables."""

import base64
import hashlib
import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from knownat.llm import components, forest, warc
from knownat.llm.queries import ORACLES, QUERIES

PAGES = [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, "a\r\nb", None), (4, None, ""), (5, "u5", "x" * 70_000), (5, "u5", "x" * 70_000),
         (6, "u6", "WARC-Type: response\r\nPage-ID: 9\r\n\r\nx"), (None, "u7", "<p>é</p>"), (None, None, "alone")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "hex", b"0") for p in PAGES], "page_id long, url string, html string, content string, payload binary")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("minimum", [0, 20])
def test_archive(spark, pages, tmp_path, minimum):
    folder = str(tmp_path / "archive")
    warc.write_archive(pages.repartition(3), folder, minimum)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in PAGES})
    rows = [tuple(r) for r in warc.describe(warc.read_records(spark, folder)).drop("record_sha256").collect()]
    wanted = []
    for k, (page, _, html) in enumerate(PAGES):
        size = len((html or "").encode())
        same = [(p or -1, -j, p) for j, (p, _, h) in enumerate(PAGES) if (h or "") == (html or "")]
        first = max(same)
        response = first[1] == -k or size < minimum
        wanted.append((page, size, digest(html), "response" if response else "revisit", None if response else first[2]))
    assert sorted(map(str, rows)) == sorted(map(str, wanted))


def test_records_are_rebuilt_byte_for_byte(spark, pages, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    for row in warc.read_records(spark, folder).collect():
        head, body = bytes(row["record"]).split(b"\r\n\r\n", 1)
        size = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length")).split()[1])
        assert head.startswith(b"WARC/1.1\r\n") and body[size:] == b"\r\n\r\n" and bytes(row["header"]) == head + b"\r\n\r\n"
        assert body[:size] in (bytes(row["payload"]), b"")


def test_damaged_payloads_are_found(spark, pages, tmp_path):
    folder, bad = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_archive(pages, folder)
    spark.read.parquet(f"{folder}/records").write.parquet(f"{bad}/records")
    spark.read.parquet(f"{folder}/payloads").selectExpr("content", "payload_digest", "payload_bytes", "encode('x', 'utf-8') payload").write.parquet(
        f"{bad}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(spark, bad).collect()


def test_archive_of_nothing(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), str(tmp_path / "a"))
    assert warc.read_records(spark, str(tmp_path / "a")).count() == 0


def vector_rows():
    random_ = np.random.default_rng(4)
    rows, number = [], 0
    for cluster in range(40):
        center = random_.normal(size=16)
        for _ in range(random_.integers(1, 30)):
            rows.append((number, int(cluster % 3), (center + 0.06 * random_.normal(size=16)).astype(np.float32).tolist()))
            number += 1
    rows += [(number + k, 0, rows[0][2]) for k in range(5)]
    return rows


def brute_links(rows, least=0.93):
    union, links = brute.Union(), {i: 0 for i, _, _ in rows}
    for k, (i, label, a) in enumerate(rows):
        for j, other, b in rows[:k]:
            if label == other and len(a) == len(b):
                x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
    return links, {i: union.root(i) for i in links}


@pytest.mark.parametrize("leaf,block", [(512, 2048), (24, 10)])
def test_forest_finds_links(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "BLOCK", block)
    rows = vector_rows()
    links, component = brute_links(rows)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, cid int, leaf int")
    found = {r["vec_id"]: r for r in forest.near_vectors(table.repartition(3)).collect()}
    assert len(found) == len(rows) and all(found[i]["n_links"] <= n for i, n in links.items())
    assert sum(r["n_links"] for r in found.values()) >= 0.98 * sum(links.values())
    assert sum(found[i]["component_id"] == c for i, c in component.items()) >= 0.98 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, None, [1.0, 0.0]), (4, 0, None), (5, 0, [0.0, 0.0]), (6, 0, [nan, 1.0]),
            (7, 0, [inf, 1.0]), (8, 0, [1.0, None]), (9, 1, [1.0, 0.0]), (10, 0, [1.0, 0.0, 0.0]), (11, 0, []), (None, 0, [1.0, 0.0]),
            (12, 0, [2.0, 0.0]), (12, 0, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = sorted(map(str, (tuple(r) for r in forest.near_vectors(table).collect())))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)] + [(None, 0, None, False)]
    assert found == sorted(map(str, [(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False), *alone]))
    assert forest.near_vectors(table.limit(0)).count() == 0


def test_components(spark):
    random_ = random.Random(6)
    links = [(random_.randrange(300), random_.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1080)] + [
        (5, 5), (5, 5), (None, 3)]
    union = brute.Union()
    for a, b in links:
        if a is not None and a != b:
            union.join(a, b)
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    found = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in found) == sorted((x, union.root(x)) for x in nodes)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "near_dedup":
            assert ids == {i for i, c in brute.near_components(rows)[0].items() if i == c}
        assert ids <= {i for i, _ in rows} and len(ids) > 0.5 * len(rows)


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
