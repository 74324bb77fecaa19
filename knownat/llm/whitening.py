"""Whitening of vectors with distributed block matrices.

Vectors become integers, are centred exactly and laid row by row into blocks of some rows (short blocks are filled with zero
rows, which add nothing to a centred product).  The scatter matrix is the transposed block matrix times itself, its eigenvectors are
found locally, and the block matrix times the whitening matrix projects all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.llm.common import stored

#: Rows of a block.
BLOCK = 1024
#: Blocks that one task of a product holds, besides those of the other factor.
BLOCKS_A_TASK = 64
SCALE, SHIFT = 1024, 100_000
#: Entries are smaller than this, so that their integers are exact.
LARGEST = float(1 << 40)
#: Components whose variance is not above this share of the largest are rounding only.
LEAST = 1e-12


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Rows ``vec_id, dim, values`` of the vectors without null or non-finite entries."""
    values = F.col("embedding").cast("array<double>")
    sound = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.select("vec_id", F.size(values).alias("dim"), values.alias("values")).where(
        values.isNotNull() & (F.col("dim") > 0) & sound)


def integers(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    if flat.size and np.abs(flat).max() >= LARGEST:
        raise ValueError("an entry is too large for exact integers")
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def column_sums(rows: DataFrame, dim: int) -> tuple[int, list[int], bool]:
    """Number of rows, exact sum of each column, and whether deviations fit into 64 bits; tasks send one row a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, [0] * dim, None, None
        for batch in batches:
            x = integers(batch.column("values"), dim)
            if len(x):
                n, sums = n + len(x), [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({
                "place": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "low": pa.array(low), "high": pa.array(high),
                "total": pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))})

    found = rows.select("values").mapInArrow(run, "place int, n long, low long, high long, total decimal(38,0)").groupBy("place").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")).orderBy("place").collect()
    n = int(found[0]["n"])
    spread, largest = max(r["high"] - r["low"] for r in found), max(max(abs(r["low"]), abs(r["high"])) for r in found)
    return n, [int(r["total"]) for r in found], dim * (n * spread) ** 2 < 1 << 62 and n * largest < 1 << 62


def centred_blocks(rows: DataFrame, dim: int, n: int, sums: list[int], narrow: bool, height: int) -> DataFrame:
    """``part, place, ids, deviations, block``: up to ``height`` rows each, the block in column order with zero rows at its end."""
    total = np.array(sums, dtype=np.int64 if narrow else object)

    def block(ids: list, parts: list[np.ndarray], part: int, place: int) -> pa.RecordBatch:
        x = np.concatenate(parts)
        shifted = (x if narrow else x.astype(object)) * n - total
        deviations = [Decimal(int(d)) for d in (shifted * shifted).sum(axis=1)]
        centred = np.zeros((height, dim))
        centred[:len(x)] = (shifted / n).astype(np.float64)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "place": pa.array([place], pa.int64()), "ids": pa.array([ids], pa.list_(key)),
            "deviations": pa.array([deviations], pa.list_(pa.decimal128(38, 0))), "block": pa.array([centred.tobytes("F")], pa.binary())})

    key: pa.DataType = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal key
        part, place, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            key = batch.schema.field("vec_id").type
            x, own = integers(batch.column("values"), dim), batch.column("vec_id").to_pylist()
            at = 0
            while at < len(x):
                step = min(height - size, len(x) - at)
                held.append(x[at:at + step])
                ids += own[at:at + step]
                at, size = at + step, size + step
                if size == height:
                    yield block(ids, held, part, place)
                    place, ids, held, size = place + 1, [], [], 0
        if size:
            yield block(ids, held, part, place)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "values").mapInArrow(
        run, f"part long, place long, ids array<{kind}>, deviations array<decimal(38,0)>, block binary")


def numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks numbered without gaps, and their count; the carry has one row per task that made them, so it may be broadcast."""
    parts = blocks.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for row in parts:
        starts[row["part"]] = total
        total += row["n"]
    spark = blocks.sparkSession
    carry = spark.createDataFrame(list(starts.items()), "part long, first long")
    return blocks.join(F.broadcast(carry), "part").withColumn("number", F.col("first") + F.col("place")).drop("part", "place", "first"), total


def block_matrix(blocks: DataFrame, count: int, dim: int, height: int) -> BlockMatrix:
    """A block matrix from rows ``number`` and bytes of a block in column order."""
    cells = blocks.select("number", "block").rdd.map(
        lambda row: ((row[0], 0), DenseMatrix(height, dim, np.frombuffer(row[1], np.float64))))
    return BlockMatrix(cells, height, dim, count * height, dim)


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with its middle dimension dealt to ``splits`` tasks, which the Scala method offers and Python's does not."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def gram(matrix: BlockMatrix, count: int) -> np.ndarray:
    """The transpose times the matrix itself, a local square matrix of the row length."""
    product = times(matrix.transpose(), matrix, max(1, -(-count // BLOCKS_A_TASK)))
    return product.toLocalMatrix().toArray()


def rows_of(projected: BlockMatrix, spark: SparkSession) -> DataFrame:
    """``number, whitened``: the bytes of each block of the product, in column order."""
    cells = projected.blocks.map(lambda cell: (int(cell[0][0]), bytearray(np.asarray(cell[1].toArray(), np.float64).tobytes("F"))))
    return spark.createDataFrame(cells, "number long, whitened binary")


def covariance_error(blocks: DataFrame, count: int, n: int, width: int, height: int) -> float:
    """The largest entry, in absolute value, of the whitened rows' covariance minus the identity; rows are centred first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width)
        for batch in batches:
            for cell in batch.column("whitened"):
                found += np.frombuffer(cell.as_py(), np.float64).reshape(height, width, order="F").sum(axis=0)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([found.tolist()], pa.list_(pa.float64()))})

    parts = blocks.select("whitened").mapInArrow(sums, "sums array<double>").collect()
    mean = np.sum([r["sums"] for r in parts], axis=0) / n

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for number, size, cell in zip(*(batch.column(c).to_pylist() for c in ("number", "size", "whitened"))):
                x = np.frombuffer(cell, np.float64).reshape(height, width, order="F").copy()
                x[:size] -= mean
                found.append(x.tobytes("F"))
            yield pa.RecordBatch.from_pydict({"number": batch.column("number"), "block": pa.array(found, pa.binary())})

    even = blocks.select("number", F.size("ids").alias("size"), "whitened").mapInArrow(centred, "number long, block binary")
    covariance = gram(block_matrix(even, count, width, height), count) / n
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = 8, height: int = BLOCK) -> DataFrame:
    """``vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error`` per vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out; so are those of another length than the commonest
    (of equally common lengths the greatest stays).  Rows that repeat an id and null ids are rows of their own.  Components
    without variance are left out, so a table of fewer than two different vectors gives no rows, as an empty one does.  Entries of
    2^40 or more raise an error.  Other columns are not read.  Sums, scatter and eigenvectors are found while the result is built:
    the driver holds matrices of the row length only.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    nothing = spark.createDataFrame([], schema)
    rows = whole_vectors(vectors)
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return nothing
    dim = common["dim"]
    rows = rows.where(F.col("dim") == dim)
    n, sums, narrow = column_sums(rows, dim)
    blocks, count = numbered(stored(centred_blocks(rows, dim, n, sums, narrow, height), "centred"))
    values, columns = np.linalg.eigh(gram(block_matrix(blocks, count, dim, height), count) / n)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST * max(values.max(), 0.0)] if values.max() > 0 else order[:0]
    if not len(order):
        return nothing
    whitening = columns[:, order] / np.sqrt(values[order])
    explained = (values[order] / values.sum()).tolist()
    width = len(order)
    square = BlockMatrix(spark.sparkContext.parallelize(
        [((0, 0), DenseMatrix(dim, width, whitening.ravel(order="F")))], 1), dim, width, dim, width)
    projected = rows_of(times(block_matrix(blocks, count, dim, height), square, 1), spark)
    whole = stored(blocks.select("number", "ids", "deviations").join(projected, "number"), "whitened")
    error = covariance_error(whole, count, n, width, height)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, deviations = batch.column("ids")[k].values, batch.column("deviations")[k].values
                size = len(ids)
                x = np.frombuffer(batch.column("whitened")[k].as_py(), np.float64).reshape(height, width, order="F")[:size]
                again = pa.array(np.repeat(np.arange(size), width))
                yield pa.RecordBatch.from_arrays([
                    ids.take(again), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), size)), pa.array(np.full(size * width, n, np.int64)),
                    deviations.take(again), pa.array(x.ravel()), pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * width, error))], schema.names)

    return whole.select("ids", "deviations", "whitened").mapInArrow(unpack, schema)
