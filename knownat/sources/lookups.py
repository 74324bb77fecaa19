"""Point and range reads of published tables, and the layout that lets them skip most of a table.

Each function is a filter that reaches the scan.  On a table written by ``store_sorted`` the footers of the files give the
ranges of the sort keys, so only the row groups and pages that may hold the asked rows are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.functions.ordered import latest_by


def store_sorted(df: DataFrame, path: str, keys: Sequence[str], group_bytes: int = 16 << 20, page_rows: int = 20_000) -> DataFrame:
    """Write ``df`` in ranges of ``keys``, sorted by them, and read it back.

    Ranges are cut over all keys together, so a first key with very many rows is spread over several files.  Row groups of about
    ``group_bytes`` carry Bloom filters of the keys, and pages of at most ``page_rows`` rows the page index.
    """
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", True)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prices(bars: DataFrame, code: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of one code, from ``start`` to ``end`` (both inclusive) where given."""
    rows = bars.filter(F.col("code") == code)
    if start is not None:
        rows = rows.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    return rows if end is None else rows.filter(F.col("trade_date") <= F.lit(end).cast("date"))


def index_prices(index_bars: DataFrame, symbol: str) -> DataFrame:
    """Days of one index."""
    return index_bars.filter(F.col("symbol") == symbol).select("trade_date", "open", "close")


def historical_snapshot(snapshots: DataFrame, day: str) -> DataFrame:
    """The listing of one signal date."""
    return snapshots.filter(F.col("signal_date") == F.lit(day).cast("date"))


def snapshot_before(snapshots: DataFrame, day: str) -> DataFrame:
    """The newest listing up to ``day``: every code's row of the last signal date not after it."""
    past = snapshots.filter(F.col("signal_date") <= F.lit(day).cast("date"))
    return past.filter(F.col("signal_date") == past.agg(F.max("signal_date")).scalar())


def canonical_day(daily_market: DataFrame, day: str) -> DataFrame:
    """Promoted market rows of one day; on a table partitioned by day only that partition is read."""
    return daily_market.filter(F.col("trade_date") == F.lit(day).cast("date"))


def actions_between(actions: DataFrame, start: str, end: str) -> DataFrame:
    """Corporate actions that take effect from ``start`` to ``end``, both inclusive; of one (code, date, type) the last stored.

    ``effective_date`` may be a date or its ISO text.
    """
    kind = actions.schema["effective_date"].dataType
    inside = actions.filter(F.col("effective_date").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    return latest_by(inside, ["code", "effective_date", "action_type"], [F.col("seq").desc()])
