"""Positions from ledgers, daily valuation, performance and comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.findings import findings
from knownat.functions import calendar as cal
from knownat.functions.text import finite, parse_date

DAYS_PER_YEAR = 365.2425
TRADING_DAYS = 252
MONEY = "decimal(38,10)"


def normalize_cashflows(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows with a readable date and a finite amount, and the rows without."""
    typed = flows.withColumns({"_day": parse_date(F.col("date")), "_sum": F.col("amount").cast("string").try_cast("double")})
    good = F.col("_day").isNotNull() & finite(F.col("_sum"))
    accepted = typed.filter(good).select("portfolio", F.col("_day").alias("date"), F.col("_sum").alias("amount"), "kind", "code")
    refused = findings(
        typed.filter(~good), source="cashflows", severity="blocking", rule="bad_cashflow", subject=F.col("portfolio"),
        date=F.col("_day"), observed=F.col("amount"),
    )
    return accepted, refused


def positions(trades: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Quantities per portfolio and code as intervals ``[from_date, to_date)``.

    ``trades`` (portfolio, code, trade_date, side, quantity) are summed per day first, so a series has at most one row
    per calendar day.  Splits multiply what is held at the start of their day: with G the
    running product of ratios, the quantity is G times the running sum of trades over G.
    """
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    daily = trades.groupBy("portfolio", "code", F.col("trade_date").alias("from_date")).agg(F.sum(signed).alias("_change"))
    series = daily.withColumns({"_ratio": F.lit(1.0), "_side": F.lit(1)})
    if splits is not None:
        pairs = daily.groupBy("portfolio", "code").agg(F.min("from_date").alias("_first"))
        ratios = splits.groupBy("code", "effective_date").agg(F.product(F.col("ratio").cast("double")).alias("_ratio"))
        events = pairs.join(ratios, "code").filter(F.col("effective_date") > F.col("_first"))
        series = series.unionByName(
            events.select(
                "portfolio", "code", F.col("effective_date").alias("from_date"), F.lit(0.0).alias("_change"), "_ratio",
                F.lit(0).alias("_side"),
            )
        )
    # One sort serves the running sums, the choice of a day's last row and the end of its interval.
    order = Window.partitionBy("portfolio", "code").orderBy("from_date", "_side")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    tracked = series.withColumns({"_growth": F.product("_ratio").over(upto), "to_date": F.lead("from_date").over(order)}).withColumn(
        "quantity", F.sum(F.col("_change") / F.col("_growth")).over(upto) * F.col("_growth")
    )
    ends_day = ~F.coalesce(F.col("to_date") == F.col("from_date"), F.lit(False))
    return tracked.filter(ends_day & (F.col("quantity") != 0)).select("portfolio", "code", "from_date", "to_date", "quantity")


def cash_balances(trades: DataFrame, flows: DataFrame, opening: DataFrame) -> DataFrame:
    """Cash per portfolio as intervals: opening cash, cash changes of trades, external flows on their date.

    Sums run in decimals, per portfolio over one row per day.
    """
    changes = (
        trades.select("portfolio", F.col("trade_date").alias("from_date"), F.col("cash_delta").cast(MONEY).alias("_cash"))
        .withColumn("_flow", F.lit(0).cast(MONEY))
        .unionByName(
            flows.select("portfolio", F.col("date").alias("from_date"), F.col("amount").cast(MONEY).alias("_cash"),
                         F.col("amount").cast(MONEY).alias("_flow"))
        )
    )
    daily = changes.groupBy("portfolio", "from_date").agg(F.sum("_cash").alias("_cash"), F.sum("_flow").alias("_flow"))
    order = Window.partitionBy("portfolio").orderBy("from_date")
    running = F.sum("_cash").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        daily.withColumns({"_sum": running, "to_date": F.lead("from_date").over(order)})
        .join(opening.select("portfolio", F.col("cash").cast(MONEY).alias("_opening")), "portfolio")
        .select(
            "portfolio", "from_date", "to_date", (F.col("_opening") + F.col("_sum")).cast("double").alias("cash"),
            F.col("_cash").cast("double").alias("cash_change"), F.col("_flow").cast("double").alias("external_flow"),
        )
    )


def price_spans(bars: DataFrame, splits: DataFrame | None, dates: cal.DateList) -> DataFrame:
    """Which close holds from session ``_at`` to before session ``_end``: ``(code, _at, _end, close, price_date)``.

    The last valid close is carried, but not across a split.  The spans of a code cover every session; those without a
    usable close have a null one.
    """
    valid = bars.filter(finite(F.col("close")) & (F.col("close") > 0)).select(
        "code", F.col("trade_date").alias("_on"), F.col("close").cast("double").alias("close"), F.col("trade_date").alias("_priced"),
        F.lit(None).cast("date").alias("_split"),
    )
    if splits is not None:
        none = F.lit(None)
        valid = valid.unionByName(splits.select(
            "code", F.col("effective_date").alias("_on"), none.cast("double").alias("close"), none.cast("date").alias("_priced"),
            F.col("effective_date").alias("_split"),
        ))
    placed = dates.with_next_no(valid, F.col("_on"), "_from_no").filter(F.col("_from_no") <= dates.count)
    steps = placed.groupBy("code", "_from_no").agg(
        F.max_by("close", "_priced").alias("close"), F.max("_priced").alias("_priced"), F.max("_split").alias("_split"))
    order = Window.partitionBy("code").orderBy("_from_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = {c: F.last(c, ignorenulls=True).over(so_far) for c in ("close", "_priced", "_split")}
    known = steps.select(
        "code", "_from_no", F.coalesce(F.lead("_from_no").over(order), F.lit(dates.count + 1)).alias("_end"),
        F.lag("_from_no").over(order).isNull().alias("_opens"), *[column.alias(c) for c, column in last.items()])
    close = F.when(F.col("_split").isNull() | (F.col("_priced") >= F.col("_split")), F.col("close"))
    span = F.struct(F.col("_from_no").alias("_at"), "_end", close.alias("close"), F.col("_priced").alias("price_date"))
    unknown = F.when(F.col("_opens") & (F.col("_from_no") > 1), F.struct(
        F.lit(1).alias("_at"), F.col("_from_no").alias("_end"), F.lit(None).cast("double").alias("close"),
        F.lit(None).cast("date").alias("price_date")))
    return known.select("code", F.explode(F.array_compact(F.array(span, unknown))).alias("_span")).select("code", "_span.*")


#: Sessions of a block in which holdings and prices of a code meet.
BLOCK = 16


def in_blocks(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Spans of session numbers, the end exclusive, cut where a block of sessions ends, with the number of their ``_block``."""
    first, last = F.floor(F.col(start) / BLOCK), F.floor((F.col(end) - 1) / BLOCK)
    return spans.withColumn("_block", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumns({
        start: F.greatest(F.col(start), F.col("_block") * BLOCK), end: F.least(F.col(end), (F.col("_block") + 1) * BLOCK)})


def priced_spans(holdings: DataFrame, prices: DataFrame, dates: cal.DateList) -> DataFrame:
    """Stretches of sessions ``_at`` to before ``_end`` in which a holding has one close, or a null one where none is known.

    Holdings and prices meet per code and block of sessions, so days are made only after the last shuffle.
    """
    kept = [c for c in ("portfolio", "code", "quantity", "seed_date") if c in holdings.columns]
    held = cal.numbered_intervals(holdings, F.col("from_date"), F.col("to_date"), dates).select(*kept, "_from_no", "_to_no")
    left, right = in_blocks(held, "_from_no", "_to_no").alias("h"), in_blocks(prices, "_at", "_end").alias("p")
    meets = (F.col("h.code") == F.col("p.code")) & (F.col("h._block") == F.col("p._block")) & (
        F.col("p._at") < F.col("h._to_no")) & (F.col("h._from_no") < F.col("p._end"))
    # Prices cover all sessions of their code: a holding without any keeps its whole stretch.
    return left.join(right, meets, "left").select(
        *[F.col(f"h.{c}") for c in kept], F.greatest("h._from_no", "p._at").alias("_at"), F.least("h._to_no", "p._end").alias("_end"),
        "p.close", "p.price_date")


def value_positions(
    holdings: DataFrame,
    cash: DataFrame,
    bars: DataFrame,
    sessions: DataFrame,
    splits: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Daily cash, position value and equity per portfolio, and positions no price can be found for.

    The close of the day counts, else the last valid close.  Carrying runs once per
    code, not per portfolio, and holdings meet prices as spans of sessions.  A close from before a split is not carried across it,
    nor is one older than ``seed_date`` where the positions have that column.
    """
    dates = cal.DateList.of(sessions, "session_date")
    spans = priced_spans(holdings, price_spans(bars, splits, dates), dates)
    if "seed_date" in holdings.columns:
        stale = F.col("price_date") < F.col("seed_date")
        spans = spans.withColumn("close", F.when(~F.coalesce(stale, F.lit(False)), F.col("close")))

    def daily(some: DataFrame) -> DataFrame:
        return dates.with_date(some.withColumn("_no", F.explode(F.sequence(F.col("_at"), F.col("_end") - 1))), "_no", "date")

    priced = daily(spans)
    worth = priced.groupBy("portfolio", "date").agg(
        F.sum(F.col("quantity") * F.col("close")).alias("positions_value"),
        F.count_if(F.col("close").isNotNull() & (F.col("price_date") < F.col("date"))).alias("carried_prices"),
        F.count_if(F.col("close").isNull()).alias("_unpriced"),
    )
    balance = cal.expand_intervals(cash, F.col("from_date"), F.col("to_date"), dates, "date")
    nav = balance.join(worth, ["portfolio", "date"], "left").withColumn(
        "positions_value", F.coalesce("positions_value", F.lit(0.0))
    )
    bad_cash = ~finite(F.col("cash")) | (F.col("cash") < 0)
    complete = nav.filter((F.coalesce("_unpriced", F.lit(0)) == 0) & ~F.coalesce(bad_cash, F.lit(True))).select(
        "portfolio", "date", "cash", "positions_value", (F.col("cash") + F.col("positions_value")).alias("equity"),
        F.when(F.col("date") == F.col("from_date"), F.col("external_flow")).otherwise(0.0).alias("external_flow"),
        F.coalesce("carried_prices", F.lit(0)).alias("carried_prices"),
    )
    missing = findings(
        daily(spans.filter("close IS NULL")), source="valuation", severity="blocking", rule="no_close", subject=F.col("code"),
        date=F.col("date"), observed=F.col("portfolio"),
    )
    negative = findings(
        nav.filter(F.coalesce(bad_cash, F.lit(True))), source="valuation", severity="blocking", rule="bad_cash", subject=F.col("portfolio"),
        date=F.col("date"), observed=F.col("cash"),
    )
    return complete, missing.unionByName(negative)


def performance(nav: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Return, growth, drawdown, volatility and Sharpe ratio per portfolio, or the reason there is none.

    One row per portfolio and day is required, so the windows are bounded by the calendar.
    """
    if not math.isfinite(risk_free):
        raise ValueError("risk-free rate must be finite")
    order = Window.partitionBy("portfolio").orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    equity = F.col("equity")
    days = nav.groupBy("portfolio", "date").agg(
        F.max("equity").alias("equity"), F.count(F.lit(1)).alias("_n"),
        F.max((F.col("equity").isNull() | ~finite(F.col("equity")) | (F.col("equity") <= 0)).cast("int")).alias("_bad"),
    )
    steps = days.withColumns(
        {"_return": equity / F.nullif(F.lag("equity").over(order), F.lit(0.0)) - 1, "_peak": F.max("equity").over(upto)}
    )
    sums = steps.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("observations"), F.max("_n").alias("_copies"), F.max("_bad").alias("_bad"),
        F.min_by("equity", "date").alias("_first"), F.max_by("equity", "date").alias("_last"),
        F.datediff(F.max("date"), F.min("date")).alias("_days"),
        F.min(equity / F.nullif("_peak", F.lit(0.0)) - 1).alias("_drawdown"),
        (F.stddev_samp("_return") * math.sqrt(TRADING_DAYS)).alias("_volatility"), F.avg("_return").alias("_mean"),
    )
    reason = (
        F.when(F.col("observations") < 2, "too_few_observations")
        .when(F.col("_copies") > 1, "duplicate_date")
        .when(F.col("_bad") > 0, "equity_not_positive")
        .when((F.col("_days") <= 0) | ~finite(F.col("_volatility")) | (F.col("_volatility") <= 0), "no_variation")
    )
    usable = reason.isNull()
    growth = F.col("_last") / F.col("_first")
    values = {
        "cumulative_return": growth - 1,
        "cagr": F.pow(growth, F.lit(DAYS_PER_YEAR) / F.col("_days")) - 1,
        "max_drawdown": F.col("_drawdown"),
        "annual_volatility": F.col("_volatility"),
        "sharpe": (F.col("_mean") * TRADING_DAYS - risk_free) / F.col("_volatility"),
    }
    return sums.select(
        "portfolio", "observations", *[F.when(usable, column).alias(name) for name, column in values.items()],
        F.lit(float(risk_free)).alias("risk_free_rate"), reason.alias("reason"),
    )


def compare(nav: DataFrame, benchmark: DataFrame, indices: DataFrame) -> DataFrame:
    """Returns since the start per strategy day, beside benchmark and indices.

    ``nav`` (portfolio, date, equity), ``benchmark`` (date, equity), ``indices`` (symbol, trade_date, close).  An index is aligned
    backward to each strategy day and rebased to its first aligned value.  A portfolio with a repeated day or with an equity that
    is missing or not positive has no comparison.
    """
    sound = finite(F.col("equity")) & (F.col("equity") > 0)
    per_day = nav.groupBy("portfolio", "date").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("_bad"))
    nav = nav.join(per_day.filter((F.col("_n") > 1) | (F.col("_bad") > 0)).select("portfolio").distinct(), "portfolio", "left_anti")
    order = Window.partitionBy("portfolio").orderBy("date")
    strategy = nav.select("portfolio", "date", (F.col("equity") / F.first("equity").over(order) - 1).alias("strategy"))
    base = benchmark.agg(F.min_by("equity", "date")).scalar()
    other = benchmark.select("date", (F.col("equity") / base - 1).alias("benchmark"))
    dates = cal.DateList(nav, "date")
    placed = dates.with_next_no(indices.filter(F.col("close").isNotNull()), F.col("trade_date"), "_from_no")
    level = placed.filter(F.col("_from_no") <= dates.count).groupBy("symbol", "_from_no").agg(
        F.max_by("close", "trade_date").alias("close")
    )
    aligned = dates.carry_forward(level, ["symbol"], "_from_no", "date")
    start = Window.partitionBy("portfolio", "symbol").orderBy("date")
    long = strategy.select("portfolio", "date").join(aligned, "date")
    rebased = long.withColumn("_return", F.col("close") / F.first("close").over(start) - 1)
    wide = rebased.groupBy("portfolio", "date").agg(
        F.max(F.when(F.col("symbol") == "KOSPI", F.col("_return"))).alias("kospi"),
        F.max(F.when(F.col("symbol") == "KOSDAQ", F.col("_return"))).alias("kosdaq"),
    )
    return strategy.join(other, "date", "left").join(wide, ["portfolio", "date"], "left").select(
        "portfolio", "date", "strategy", "benchmark", "kospi", "kosdaq"
    )


def price_states(bars: DataFrame, splits: DataFrame | None, dates: cal.DateList) -> DataFrame:
    """State of each code at every session from its first bar or split on, in one pass over the bars.

    ``(code, date, open, close, factor, bad_splits)``: the open of that very day, the last valid close that no later split has
    made stale, the product of all split ratios so far, and the number of splits so far that were published after 09:00 Seoul
    on their day or whose day has not exactly one bar with valid prices.  Of repeated bars of a day the highest prices count.
    """
    valid = {c: F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c).cast("double")) for c in ("open", "close")}
    facts = bars.select("code", F.col("trade_date").alias("_on"), F.lit(1).alias("_bar"), valid["open"].alias("open"),
                        valid["close"].alias("close"))
    empty = {"_ratio": "double", "_late": "boolean"}
    facts = facts.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()])
    if splits is not None:
        late = F.col("published_at") > cal.at_seoul(F.col("effective_date"), cal.OPEN_TIME)
        facts = facts.unionByName(splits.select(
            "code", F.col("effective_date").alias("_on"), F.col("ratio").cast("double").alias("_ratio"), late.alias("_late"),
        ), allowMissingColumns=True)
    days = facts.groupBy("code", "_on").agg(
        F.count("_bar").alias("_bars"), F.max("open").alias("open"), F.max("close").alias("close"),
        F.product("_ratio").alias("_ratio"), F.bool_or("_late").alias("_late"))
    sound = (F.col("_bars") == 1) & F.col("open").isNotNull() & F.col("close").isNotNull() & ~F.col("_late")
    marked = days.withColumns({
        "_bad": F.when(F.col("_ratio").isNotNull(), (~sound).cast("int")).otherwise(0),
        "_split": F.when(F.col("_ratio").isNotNull(), F.col("_on")),
        "_priced": F.when(F.col("close").isNotNull(), F.col("_on")),
    })
    # Days between sessions count for the session after them.
    placed = dates.with_next_no(marked, F.col("_on"), "_from_no").filter(F.col("_from_no") <= dates.count)
    steps = placed.groupBy("code", "_from_no").agg(
        F.max_by("open", "_on").alias("open"), F.max("_on").alias("_opened"), F.max_by("close", "_priced").alias("close"),
        F.max("_priced").alias("_priced"), F.max("_split").alias("_split"), F.product("_ratio").alias("_ratio"), F.sum("_bad").alias("_bad"))
    so_far = Window.partitionBy("code").orderBy("_from_no").rowsBetween(Window.unboundedPreceding, 0)
    last = {c: F.last(c, ignorenulls=True).over(so_far) for c in ("close", "_priced", "_split")}
    states = steps.select(
        "code", "_from_no", "open", "_opened",
        F.when(last["_split"].isNull() | (last["_priced"] >= last["_split"]), last["close"]).alias("close"),
        F.coalesce(F.product("_ratio").over(so_far), F.lit(1.0)).alias("factor"), F.sum("_bad").over(so_far).alias("bad_splits"))
    return dates.carry_forward(states, ["code"], "_from_no", "date").select(
        "code", "date", F.when(F.col("_opened") == F.col("date"), F.col("open")).alias("open"), "close", "factor", "bad_splits")


def equal_weight_runs(
    universe: DataFrame, bars: DataFrame, schedule: DataFrame, sessions: DataFrame, initial: float, splits: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Zero-cost equal-weight indices of many weekly universes at once, and the weeks that block them.

    ``universe`` (portfolio, signal_date, code); ``splits`` validated events.  A run goes from a portfolio's first week to its last
    one: ``(portfolio, date, equity)``.  Value at an execution multiplies by the mean open-to-open growth of the names held; between
    executions by the mean of close over entry open, the last valid close being carried.  A split inside a holding week multiplies
    the quantity from its day on, and no close is carried across it.  A run stops before the first day on which a name to be bought
    or sold has no open, a split of a held name is unusable, or a week is left out.  A day on which a name has no price has no value.
    ``blocked`` (portfolio, signal_date, execution_date, missing_opens, bad_splits, left_out) counts names, whether or not the run
    still went on then.
    """
    dates = cal.DateList.of(sessions, "session_date")
    weeks = schedule.withColumn("next_execution", F.lead("execution_date").over(Window.orderBy("signal_date")))
    held = universe.select("portfolio", "signal_date", "code").distinct().join(
        weeks.select("signal_date", "execution_date", "next_execution"), "signal_date")
    # The day of the next execution closes the week as well.
    daily = cal.expand_intervals(held, F.col("execution_date"), F.date_add("next_execution", 1), dates, "date")
    week = ["portfolio", "signal_date"]
    span = Window.partitionBy(*week, "code")
    entering, leaving = F.col("date") == F.col("execution_date"), F.coalesce(F.col("date") == F.col("next_execution"), F.lit(False))

    def at_entry(column: str):
        return F.max(F.when(entering, F.col(column))).over(span)

    # Only names that some week holds need prices: the bars of all others are left out before any of them is moved or carried.
    names = held.select("code").distinct()
    bars = bars.join(names, "code", "left_semi")
    if splits is not None:
        splits = splits.join(names, "code", "left_semi")
    priced = daily.join(price_states(bars, splits, dates), ["code", "date"], "left").withColumns({
        "_entry": at_entry("open"), "_factor": F.col("factor") / at_entry("factor"),
        "_bad": F.coalesce(F.col("bad_splits"), F.lit(0)) > F.coalesce(at_entry("bad_splits"), F.lit(0)),
    })
    worth = F.when(leaving, F.col("open")).otherwise(F.col("close")) * F.col("_factor") / F.col("_entry")
    rows = priced.groupBy(*week, "execution_date", "date", entering.alias("_enters"), leaving.alias("_leaves")).agg(
        F.avg(worth).alias("_move"), F.count_if(worth.isNull()).alias("_unpriced"),
        F.count_if((entering | leaving) & F.col("open").isNull()).alias("_no_open"), F.count_if("_bad").alias("_bad"))
    # One row per portfolio and session, and one more per week: the closing day stands before the entry of the same day.
    order = Window.partitionBy("portfolio").orderBy("date", "signal_date")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("_leaves") & ~F.coalesce(F.lead("date").over(order) == F.col("date"), F.lit(False))
    chain = rows.withColumns({
        "_left_out": F.col("_enters") & F.coalesce(F.lag("date").over(order) < F.col("date"), F.lit(False)), "_ends": ends,
        "_level": F.exp(F.coalesce(F.sum(F.when(F.col("_leaves"), F.ln("_move"))).over(before), F.lit(0.0))) * float(initial),
    })
    chain = chain.withColumns({c: F.when(F.col("_ends"), 0).otherwise(F.col(c)) for c in ("_no_open", "_bad")})
    stopped = F.sum(F.col("_no_open") + F.col("_bad") + F.col("_left_out").cast("int")).over(upto)
    index = chain.withColumn("_stopped", stopped).filter("_stopped = 0 AND _unpriced = 0 AND NOT _leaves").select(
        "portfolio", "date", (F.col("_level") * F.col("_move")).alias("equity"))
    blocked = chain.groupBy(*week, "execution_date").agg(
        F.sum("_no_open").alias("missing_opens"), F.max("_bad").alias("bad_splits"), F.bool_or("_left_out").alias("left_out"),
    ).filter("missing_opens > 0 OR bad_splits > 0 OR left_out")
    return index, blocked


def equal_weight_index(
    universe: DataFrame, bars: DataFrame, schedule: DataFrame, sessions: DataFrame, initial: float, start: str,
    splits: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The run of one universe: ``(date, equity)`` with an opening row at ``start``, and the weeks that block it.

    See ``equal_weight_runs``, whose rules hold.
    """
    named = universe.select(F.lit("").alias("portfolio"), "signal_date", "code")
    valued, blocked = equal_weight_runs(named, bars, schedule, sessions, initial, splits)
    first = F.lit(start).cast("date")
    opening = valued.sparkSession.range(1).select(first.alias("date"), F.lit(float(initial)).alias("equity"))
    # A value of the starting day itself takes the place of the opening row.
    rows = valued.select("date", "equity", F.lit(1).alias("_own")).unionByName(opening.withColumn("_own", F.lit(0)))
    index = rows.groupBy("date").agg(F.max_by("equity", "_own").alias("equity"))
    return index, blocked.drop("portfolio")


def official_metrics(metrics: DataFrame, readiness: DataFrame, research: bool = False) -> DataFrame:
    """Withhold metrics where the input is incomplete or any lock is closed.

    ``readiness`` (portfolio, complete, lifecycle_ready, investability_ready, corporate_action_ready, official_backtest_ready).
    """
    locks = ["lifecycle_ready", "investability_ready", "corporate_action_ready", "official_backtest_ready"]
    open_ = F.coalesce(F.col("complete"), F.lit(False)) & F.lit(not research)
    for lock in locks:
        open_ = open_ & F.coalesce(F.col(lock), F.lit(False))
    closed = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("complete"), F.lit(False)), "input_incomplete"),
            *[F.when(~F.coalesce(F.col(lock), F.lit(False)), lock.replace("_ready", "_locked")) for lock in locks],
            F.when(F.lit(research), "research_only"),
        )
    )
    kept = [c for c in metrics.columns if c not in ("portfolio", "reason", "observations", "risk_free_rate")]
    return metrics.join(readiness, "portfolio", "left").select(
        "portfolio", *[F.when(open_, F.col(c)).alias(c) for c in kept], F.array_join(closed, ",").alias("withheld")
    )


def reconcile_nav(nav: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Days whose equity is not cash plus positions, or whose cash change is unexplained.

    ``nav`` (portfolio, date, cash, positions_value, equity, cash_change).
    """
    order = Window.partitionBy("portfolio").orderBy("date")
    stepped = nav.withColumn("_before", F.lag("cash").over(order))
    gap = F.abs(F.col("equity") - F.col("cash") - F.col("positions_value"))
    drift = F.abs(F.col("cash") - F.col("_before") - F.col("cash_change"))
    whole = finite(F.col("equity")) & finite(F.col("cash")) & finite(F.col("positions_value"))
    rule = F.when(~F.coalesce(whole, F.lit(False)), "value_missing").when(gap > tolerance, "equity_mismatch").when(drift > tolerance, "cash_mismatch")
    return findings(
        stepped.withColumn("_rule", rule).filter("_rule IS NOT NULL"), source="nav", severity="blocking",
        rule=F.col("_rule"), subject=F.col("portfolio"), date=F.col("date"), observed=F.col("equity"),
    )
