"""Ordered computations that stay distributed when one key holds much of the data.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  That is fine
where the rows per key are bounded (one row per trading day, say), and the
operators use it there after reducing the data to that bound.  Elsewhere the helpers
below split each key into time buckets, scan each bucket on its own, and pass only
one summary row per bucket along the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a lookup side may have and still be broadcast.  Calendars (one row per day)
#: and schedules stay far below; beyond it the join is left to shuffle on its key.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a count of at most ``max_rows + 1`` rows shows it is small.

    A larger side is returned as it is: Spark then plans a shuffled join, which
    adaptive execution splits on hot keys.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``.

    Spark limits the groups before the shuffle (``WindowGroupLimit``), so every
    task sends at most one row per key however hot the key is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pick", F.row_number().over(window)).filter("_pick = 1").drop("_pick")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str) -> DataFrame:
    """The first ``limit`` rows per key with their 1-based position in column ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add running values per key, computed bucket by bucket.

    ``values`` maps a new column to ``(how, expression)`` with ``how`` one of
    ``last`` (last non-null so far) and ``max`` (greatest so far).  ``bucket`` must not
    decrease along ``order``; ``inclusive`` says whether a row sees itself.

    Two exchanges carry data: the rows on (keys, bucket), and one summary row per
    (keys, bucket).  No task receives a whole key.

    With ``hot_rows`` only keys of more rows are cut, which one count of rows per key finds; a key of fewer is one bucket and
    has no summary row, so that where no key is hot the rows are exchanged once and nothing else is.
    """
    keys = list(keys)
    parts = keys + ["_bucket"]
    staged = df.withColumn("_bucket", bucket)
    hot = None
    if hot_rows is not None:
        # At most one key per ``hot_rows`` rows comes here.
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
        hot = counted.collect()
        if hot:
            marks = df.sparkSession.createDataFrame(hot, counted.schema).withColumnsRenamed({key: f"_hot_{key}" for key in keys})
            same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_hot_{key}")) for key in keys])
            staged = staged.join(F.broadcast(marks.withColumn("_hot", F.lit(True))), same, "left")
            staged = staged.withColumn("_bucket", F.when(F.col("_hot"), F.col("_bucket")))
        else:
            parts = keys
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)

    summaries, carries, locals_ = [], [], {}
    for name, (how, expression) in values.items():
        if how == "last":
            position = F.when(expression.isNotNull(), F.struct(*order))
            summaries.append(F.max_by(expression, position).alias(f"_sum_{name}"))
            carries.append(F.last(f"_sum_{name}", ignorenulls=True).over(earlier).alias(f"_carry_{name}"))
            locals_[f"_in_{name}"] = F.last(expression, ignorenulls=True).over(inside)
        elif how == "max":
            summaries.append(F.max(expression).alias(f"_sum_{name}"))
            carries.append(F.max(f"_sum_{name}").over(earlier).alias(f"_carry_{name}"))
            locals_[f"_in_{name}"] = F.max(expression).over(inside)
        else:
            raise ValueError(f"unknown running value {how!r}")

    scanned = staged.withColumns(locals_)
    if hot == []:
        return scanned.select(*df.columns, *[F.col(f"_in_{name}").alias(name) for name in values])
    cut = staged if hot is None else staged.filter("_hot")
    carried = cut.groupBy(*parts).agg(*summaries).select(*parts, *carries)
    scanned = scanned.join(carried, parts, "left")
    result = {}
    for name, (how, _) in values.items():
        pick = F.coalesce if how == "last" else F.greatest
        result[name] = pick(F.col(f"_in_{name}"), F.col(f"_carry_{name}"))
    return scanned.select(*df.columns, *[column.alias(name) for name, column in result.items()])


def previous_row(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], columns: Sequence[str], name: str
) -> DataFrame:
    """Add the struct ``name`` of ``columns`` taken from the row before, per key."""
    return running(df, keys, bucket, order, {name: ("last", F.struct(*columns))}, inclusive=False)
