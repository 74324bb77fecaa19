"""Session calendars and lookups of dates against a list of dates.

A calendar has one row per day, so it is bounded by the years covered; the
windows below that run over a whole calendar are small for that reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions.ordered import BROADCAST_ROWS

SEOUL = "Asia/Seoul"
SIGNAL_TIME = "15:30:00"
OPEN_TIME = "09:00:00"
DAY_END = "23:59:59"


def at_seoul(day: Column, clock: str = "00:00:00") -> Column:
    """Instant of a wall-clock time in Seoul on ``day``."""
    return F.concat(day.cast("string"), F.lit(f" {clock}+09:00")).cast("timestamp")


def seoul_day(stamp: Column) -> Column:
    """Calendar day in Seoul of an instant (the session time zone is pinned to UTC)."""
    return F.from_utc_timestamp(stamp, SEOUL).cast("date")


def numbered(dates: DataFrame, column: str) -> DataFrame:
    """Distinct dates as ``(session_date, session_no)``, numbered from 1."""
    order = Window.orderBy("session_date")
    return (
        dates.select(F.col(column).alias("session_date"))
        .filter(F.col("session_date").isNotNull())
        .distinct()
        .withColumn("session_no", F.row_number().over(order))
    )


class DateList:
    """A list of dates to look others up in: sessions, signal dates, covered days.

    Building it runs one small aggregation for first date, last date and number of dates.
    Those three values bound the size of both look-up tables (one row per date, one per
    calendar day), so they are broadcast when that bound is low and joined by shuffle otherwise.
    """

    def __init__(self, dates: DataFrame, column: str):
        self.table = numbered(dates, column)
        self.first, self.last, self.count = self.table.agg(
            F.min("session_date"), F.max("session_date"), F.count(F.lit(1))
        ).first()

    @classmethod
    def of(cls, dates: DataFrame | DateList, column: str) -> DateList:
        return dates if isinstance(dates, cls) else cls(dates, column)

    def _sized(self, df: DataFrame) -> DataFrame:
        span = (self.last - self.first).days + 2 if self.count else 0
        return F.broadcast(df) if span <= BROADCAST_ROWS else df

    def low(self) -> Column:
        return F.lit(self.first).cast("date")

    def past_end(self) -> Column:
        return F.date_add(F.lit(self.last).cast("date"), 1)

    def days(self) -> DataFrame:
        """Every calendar day from the first to one past the last date.

        ``(day, next_no, next_date)``: number and value of the first listed date on or after
        the day.  The day past the end has the number after the last and no date.
        """
        order = Window.orderBy("session_date")
        table = self.table.withColumns(
            {"_before": F.lag("session_date").over(order), "_last": F.lead("session_date").over(order).isNull()}
        )
        first_day = F.coalesce(F.date_add("_before", 1), F.col("session_date"))
        end_day = F.when(F.col("_last"), F.date_add("session_date", 1)).otherwise(F.col("session_date"))
        inside = F.col("day") <= F.col("session_date")
        return table.withColumn("day", F.explode(F.sequence(first_day, end_day))).select(
            "day",
            F.when(inside, F.col("session_no")).otherwise(F.col("session_no") + 1).alias("next_no"),
            F.when(inside, F.col("session_date")).alias("next_date"),
        )

    def with_next_no(self, df: DataFrame, date: Column, name: str) -> DataFrame:
        """Add the number of the first listed date on or after ``date``; past the end, the number after the last."""
        lookup = self._sized(self.days().select(F.col("day").alias("_day"), F.col("next_no").alias(name)))
        clamped = F.when(date.isNotNull(), F.least(F.greatest(date, self.low()), self.past_end()))
        return df.withColumn("_day", clamped).join(lookup, "_day", "left").drop("_day")

    def with_date(self, df: DataFrame, number: str, name: str) -> DataFrame:
        """Replace a date number by the date."""
        listed = self.table.select(F.col("session_no").alias(number), F.col("session_date").alias(name))
        return df.join(self._sized(listed), number).drop(number)

    def numbers_per_key(self, df: DataFrame, keys: list[str], date: Column, name: str) -> DataFrame:
        """One row per key with the sorted numbers of its listed dates: at most one entry a listed date, however many rows there are."""
        listed = self.table.select(F.col("session_date").alias("_date"), "session_no")
        found = df.select(*keys, date.alias("_date")).join(self._sized(listed), "_date")
        return found.groupBy(*keys).agg(F.sort_array(F.collect_set("session_no")).alias(name))

    def carry_forward(self, df: DataFrame, keys: list[str], from_no: str, name: str) -> DataFrame:
        """One row per listed date from each row's number up to the next row of the same key.

        Rows per key must be few per date number; only the last row before a date yields anything.
        """
        order = Window.partitionBy(*keys).orderBy(from_no)
        until = F.coalesce(F.lead(from_no).over(order), F.lit(self.count + 1))
        spread = df.withColumn("_until", until).filter(F.col(from_no) < F.col("_until"))
        numbers = F.sequence(F.col(from_no), F.col("_until") - 1)
        return self.with_date(spread.withColumn("_no", F.explode(numbers)).drop("_until"), "_no", name)


def with_next_session(df: DataFrame, date: Column, sessions: DataFrame | DateList, name: str) -> DataFrame:
    """Add the first session strictly after ``date``, null when there is none."""
    listed = DateList.of(sessions, "session_date")
    lookup = listed._sized(listed.days().select(F.col("day").alias("_day"), F.col("next_date").alias(name)))
    day = F.when(date.isNotNull(), F.greatest(F.date_add(date, 1), listed.low()))
    return df.withColumn("_day", day).join(lookup, "_day", "left").drop("_day")


def numbered_intervals(intervals: DataFrame, start: Column, end: Column, dates: DateList) -> DataFrame:
    """Intervals that hold a listed date, with its first number ``_from_no`` and the number ``_to_no`` after its last; a null end is open."""
    staged = dates.with_next_no(intervals.filter(start.isNotNull()), start, "_from_no")
    return dates.with_next_no(staged, F.coalesce(end, dates.past_end()), "_to_no").filter("_from_no < _to_no")


def expand_intervals(
    intervals: DataFrame, start: Column, end: Column, dates: DateList, name: str, *, only: str | None = None, without: str | None = None,
) -> DataFrame:
    """One row per interval and listed date with ``start <= date < end``; a null end is open.

    Both ends are turned into date numbers by equality look-ups and the numbers
    between are generated, so no range join runs and only result rows are made.
    ``only`` and ``without`` name columns of date numbers (``DateList.numbers_per_key``) that are kept or left out.
    """
    numbers = F.sequence(F.col("_from_no"), F.col("_to_no") - 1)
    if only is not None:
        numbers = F.filter(only, lambda no: (no >= F.col("_from_no")) & (no < F.col("_to_no")))
    if without is not None:
        numbers = F.array_except(numbers, F.coalesce(without, F.array().cast("array<int>")))
    spread = numbered_intervals(intervals, start, end, dates).withColumn("_no", F.explode(numbers))
    return dates.with_date(spread.drop("_from_no", "_to_no", *[c for c in (only, without) if c]), "_no", name)


def weekly_schedule(sessions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``(signal_date, execution_date)``: last session of each Saturday-to-Friday week, and the session after.

    The last week of the calendar has no following session and is left out.
    """
    week = F.date_trunc("week", F.date_add("session_date", 2))
    after = Window.orderBy("session_date")
    last = Window.partitionBy(week)
    schedule = (
        sessions.withColumn("execution_date", F.lead("session_date").over(after))
        .withColumn("_last", F.max("session_date").over(last))
        .filter("session_date = _last AND execution_date IS NOT NULL")
        .select(F.col("session_date").alias("signal_date"), "execution_date")
    )
    if start is not None:
        schedule = schedule.filter(F.col("signal_date") >= F.lit(start).cast("date"))
    if end is not None:
        schedule = schedule.filter(F.col("signal_date") <= F.lit(end).cast("date"))
    return schedule


def requested_days(days: DataFrame, start: str, end: str) -> DataFrame:
    """Weekdays from ``start`` to ``end`` as ``(trade_date)``; ``days`` is any one-row frame."""
    every = days.limit(1).select(
        F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("trade_date")
    )
    return every.filter(F.weekday("trade_date") < 5)


def coverage_runs(sessions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per session date ``(session_date, covered, gaps_to, gaps_before)``.

    ``gaps_to`` counts uncovered sessions up to the date, ``gaps_before`` those before it:
    dates a <= b are continuously covered exactly when gaps_to(b) = gaps_before(a).
    Covered dates that are no sessions are listed as well and count as no gap.
    """
    days = sessions.select(F.col("session_date"), F.lit(1).alias("_session"))
    seen = coverage.select(F.col("requested_date").alias("session_date")).distinct().withColumn("_covered", F.lit(True))
    table = days.join(seen, "session_date", "full_outer").withColumns(
        {
            "covered": F.coalesce("_covered", F.lit(False)),
            "_gap": F.when(F.col("_session").isNotNull() & F.col("_covered").isNull(), 1).otherwise(0),
        }
    )
    order = Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("gaps_to", F.sum("_gap").over(order)).select(
        "session_date", "covered", "gaps_to", (F.col("gaps_to") - F.col("_gap")).alias("gaps_before")
    )
