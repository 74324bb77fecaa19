"""Pairs a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knownat.session import prepare, size_tasks
from workload import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Canonical tables of one data folder: ``tables.bars`` is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = size_tasks(prepare(spark))
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in fixtures.TABLES:
            raise AttributeError(name)
        return self.sql([name], f"SELECT * FROM {name}")

    def sql(self, names: list[str], body: str) -> DataFrame:
        parts = [
            f"{base} AS (SELECT * FROM parquet.`{self.folder}/{base}.parquet`)" for base in fixtures.bases(names)
        ]
        text = "WITH " + ", ".join(parts + fixtures.ctes(names, fixtures.SPARK_TABLES)) + " " + body
        return self.spark.sql(spark_text(text))


def spark_text(text: str) -> str:
    """Spark spellings of the few functions whose names differ."""
    text = re.sub(r"\bsha256\(([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*)\)", r"sha2(\1, 256)", text)
    text = text.replace("unnest(generate_series(", "explode(sequence(")
    return re.sub(r'"([^"]+)"', r"`\1`", text)


def oracle_text(names: list[str], body: str) -> str:
    """One statement for the check engine: derived tables first, then the body."""
    parts = fixtures.ctes(names)
    body = body.strip()
    if not parts:
        return body
    head = "WITH "
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            head, body = opening, ", " + body[len(opening):]
            break
    return head + ", ".join(parts) + " " + body


def query(name: str, *names: str, oracle: str | None = None):
    """Register ``function(tables) -> DataFrame``; ``names`` are the tables the SQL reads."""

    def register(function: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, folder: function(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle_text(list(names), oracle)
        return function

    return register
