"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

#: Settings that change results (time zone) or keep skewed keys cheap (adaptive execution).
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


#: How shuffles are cut where the session does not say: into many small pieces that adaptive execution joins again up to a
#: size, so that what one task holds depends on that size and not on the input.
SIZED = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}
#: HotSpot only interprets methods of more bytes than this: plans with longer ones run by their parts, which it compiles.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def ship_package(context: SparkContext) -> None:
    """Send this package to the executors once, so that functions in tasks can import it whatever their path is."""
    if getattr(context, "_knownat_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="knownat-package-")
    path = os.path.join(folder, "knownat-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for place, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._knownat_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings; safe to call for every query."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark.sparkContext)
    return spark


def size_tasks(spark: SparkSession) -> SparkSession:
    """Bound what a task of a shuffle holds and what generated methods hold; a value that the session has been given stays."""
    for key, value in (SIZED | COMPILED).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new place for tables of one job, in the folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine may lack that setting; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="knownat-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
