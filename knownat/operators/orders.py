"""Targets, whole-share orders and costs, for many accounts in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.findings import explode_reasons
from knownat.functions.text import finite
from knownat.schemas import TradingRules

RULES = TradingRules()
CASH_SLACK = 1e-8


@dataclass(frozen=True)
class Proposal:
    """Lazy results of one rebalance.

    ``book`` has one row per account with its lines in an array; every other table is read
    off it.  Persist ``book`` when several of them are wanted.
    """

    book: DataFrame
    rules: TradingRules
    execution: bool = False

    def _sound(self) -> DataFrame:
        return self.book.filter(F.size("reasons") == 0)

    def rejected(self) -> DataFrame:
        return self.book.select("account", F.explode("reasons").alias("reason"))

    def fills(self) -> DataFrame:
        """One row per account and name held or targeted."""
        # explode_outer: the plain form adds a size filter that Spark would evaluate below the array pipeline again.
        lines = self._sound().select("account", "signal_date", "equity", F.explode_outer("fills").alias("_f"))
        return lines.filter("_f.code IS NOT NULL").select("account", "signal_date", "equity", "_f.*")

    def orders(self) -> DataFrame:
        amount = F.col("filled") * F.col("price")
        return with_costs(
            self.fills().filter("filled > 0").select(
                "account", "signal_date", "code", "name", "side", F.col("filled").alias("quantity"), "price",
                amount.alias("gross_amount"),
            ),
            self.rules,
        )

    def unfilled(self) -> DataFrame:
        """What was refused and why.

        At execution a held target whose share of the account buys no whole share is sold and listed as a refused buy as well.
        """
        refused = F.when(F.col("reason").isNotNull(), F.struct("side", "reason"))
        if self.execution:
            sold_out = F.col("position").isNotNull() & (F.col("desired") == 0) & (F.col("gap") < 0)
            small = F.struct(F.lit("buy").alias("side"), F.lit("allocation_too_small").alias("reason"))
            lines = F.array_compact(F.array(refused, F.when(sold_out, small)))
        else:
            lines = F.array_compact(F.array(refused))
        return self.fills().select("account", "signal_date", "code", F.explode(lines).alias("_r")).select(
            "account", "signal_date", "code", "_r.*")

    def holdings_after(self) -> DataFrame:
        return self.fills().filter("after > 0").select(
            "account", "signal_date", "code", F.col("after").alias("quantity"), "price"
        )

    def target_sheet(self) -> DataFrame:
        worth = F.col("price") * F.col("after")
        return self.fills().filter("position IS NOT NULL").select(
            "account", "signal_date", "position", "rank", "code", "name", "price", F.col("after").alias("quantity"),
            worth.alias("amount"), F.lit(100.0 / self.rules.slots).alias("target_weight"),
            F.when(F.col("equity") != 0, worth / F.col("equity") * 100).otherwise(0.0).alias("actual_weight"),
        )

    def unfunded_targets(self) -> DataFrame:
        return self.fills().filter("position IS NOT NULL AND desired = 0").select("account", "signal_date", "code")

    def summary(self) -> DataFrame:
        """Equity, cash and invested value after, turnover and costs per account, without unpacking the lines."""
        rules, zero = self.rules, F.lit(0.0)

        def total(value) -> Column:
            return F.aggregate("fills", F.lit(0.0), lambda acc, f: acc + F.coalesce(value(f), F.lit(0.0)))

        def gross(f: Column) -> Column:
            return f["filled"] * f["price"]

        sold = total(lambda f: F.when(f["side"] == "sell", gross(f)))
        turnover = total(gross)
        cost = turnover * (rules.fee + rules.slippage) + sold * rules.tax
        return self._sound().select(
            "account", "signal_date", "equity",
            F.greatest(F.col("cash") + sold - (turnover - sold) - cost, zero).alias("cash_after"),
            total(lambda f: f["after"] * f["price"]).alias("invested_after"),
            turnover.alias("turnover_amount"),
            F.when(F.col("equity") != 0, turnover / F.col("equity") * 100).otherwise(zero).alias("turnover"),
            cost.alias("cost_total"),
            F.size(F.filter("fills", lambda f: f["filled"] > 0)).cast("long").alias("order_count"),
        )


def with_costs(trades: DataFrame, rules: TradingRules = RULES) -> DataFrame:
    """Add fee, tax (sells only), slippage, their total and the cash change of each trade."""
    gross = F.col("gross_amount")
    sell = F.col("side") == "sell"
    priced = trades.withColumns(
        {
            "fee": gross * rules.fee,
            "tax": F.when(sell, gross * rules.tax).otherwise(0.0),
            "slippage": gross * rules.slippage,
        }
    ).withColumn("cost_total", F.col("fee") + F.col("tax") + F.col("slippage"))
    return priced.withColumn(
        "cash_delta", F.when(sell, gross - F.col("cost_total")).otherwise(-gross - F.col("cost_total"))
    )


def check_accounts(accounts: DataFrame, holdings: DataFrame, prices: DataFrame) -> DataFrame:
    """``(account, reason)`` for accounts that cannot be rebalanced.

    ``holdings`` must carry the account's signal date.  Each reason appears once per account.
    """
    cash = explode_reasons(
        accounts, {"bad_cash": ~finite(F.col("cash")) | (F.col("cash") < 0)}
    ).select("account", F.col("rule_id").alias("reason"))
    quantity = F.col("quantity").cast("double")
    held = holdings.join(prices.select("signal_date", "code", "price"), ["signal_date", "code"], "left")
    bad_number = ~finite(quantity) | (quantity < 0) | (quantity != F.floor(quantity))
    no_price = (quantity > 0) & ~F.coalesce(finite(F.col("price")) & (F.col("price") > 0), F.lit(False))
    found = explode_reasons(
        held, {"bad_quantity": F.coalesce(bad_number, F.lit(True)), "held_without_price": no_price}
    )
    return cash.unionByName(found.select("account", F.col("rule_id").alias("reason"))).distinct()


def select_targets(
    ranked: DataFrame, accounts: DataFrame, holdings: DataFrame, rules: TradingRules = RULES
) -> DataFrame:
    """Targets per account: held names ranked within ``keep_rank`` stay, the rest is filled from the top.

    ``(account, signal_date, position, code, rank, kept)``.  Only ranks up to the larger of the two limits
    can matter, so the board of a date is one short array and no account is joined row by row
    with a ranking.
    """
    reach = max(rules.targets, rules.keep_rank)
    entry = F.struct(F.col("rank"), F.col("code"))
    top = ranked.filter(F.col("rank") <= reach).select("signal_date", "rank", "code")
    board = top.groupBy("signal_date").agg(F.sort_array(F.collect_list(entry)).alias("_board"))
    owned = (
        holdings.filter("quantity > 0").select("account", "code").distinct()
        .join(accounts.select("account", "signal_date"), "account")
        .join(top.filter(F.col("rank") <= rules.keep_rank), ["signal_date", "code"])
        .groupBy("account")
        .agg(F.slice(F.sort_array(F.collect_list(entry)), 1, max(rules.targets, 1)).alias("_kept"))
    )
    empty = F.array().cast("array<struct<rank:int,code:string>>")
    kept = F.coalesce("_kept", empty) if rules.targets else empty
    fill = F.filter("_board", lambda item: ~F.array_contains(F.transform("_keep", lambda k: k["code"]), item["code"]))
    free = F.lit(rules.targets) - F.size("_keep")
    chosen = (
        accounts.select("account", "signal_date")
        .join(owned, "account", "left")
        .join(board, "signal_date")
        .withColumn("_keep", kept)
        .withColumn("_fill", F.when(free > 0, F.slice(fill, F.lit(1), F.greatest(free, F.lit(0)))).otherwise(empty))
    )
    return chosen.select(
        "account", "signal_date", F.size("_keep").alias("_n"), F.posexplode_outer(F.concat("_keep", "_fill"))
    ).filter("pos IS NOT NULL").select(
        "account", "signal_date", (F.col("pos") + 1).alias("position"), F.col("col.code").alias("code"),
        F.col("col.rank").alias("rank"), (F.col("pos") < F.col("_n")).alias("kept"),
    )


LINE = (
    "struct<code:string,name:string,quantity:double,position:int,rank:int,price:double,stopped:boolean,"
    "desired:bigint,gap:bigint,sold:bigint,reason:string>"
)
WALK = "struct<cash:double,done:map<string,struct<filled:bigint,reason:string>>>"


def _desired(line: Column, rules: TradingRules, execution: bool) -> Column:
    """Whole shares of one slot: live proposals set costs aside first, executions price them in."""
    slot = F.col("equity") / rules.slots
    if execution:
        return F.floor(slot / (line["price"] * (1 + (rules.fee + rules.slippage))))
    return F.floor(slot / (1 + rules.fee) / line["price"])


def _plan_line(line: Column, rules: TradingRules, execution: bool) -> Column:
    """Desired quantity and sell decision of one line; buys wait for the cash walk."""
    target = line["position"].isNotNull()
    held = line["quantity"].cast("long")
    desired = (
        F.when(target & line["stopped"], held)
        .when(target & line["price"].isNull(), F.lit(None).cast("long"))
        .when(target, _desired(line, rules, execution))
        .otherwise(F.lit(0))
    )
    gap = F.coalesce(desired, F.lit(0)) - held
    selling = gap < 0
    refused = F.when(line["stopped"], "blocked").when(-gap * line["price"] < rules.min_trade, "below_minimum")
    short = F.when(target & line["stopped"], "blocked")
    if execution:
        short = F.coalesce(
            short,
            F.when(target & line["price"].isNull(), "no_open"),
            F.when(target & (desired == 0) & ~selling, "allocation_too_small"),
        )
    return F.struct(
        *[line[name].alias(name) for name in ("code", "name", "quantity", "position", "rank", "price", "stopped")],
        desired.alias("desired"),
        gap.alias("gap"),
        F.when(selling & refused.isNull(), -gap).otherwise(F.lit(0)).alias("sold"),
        F.when(selling, refused).otherwise(short).alias("reason"),
    ).cast(LINE)


def _walk_buys(rules: TradingRules, execution: bool) -> Column:
    """Walk the buys of one account in order, spending the cash that is left.

    A skipped name leaves its cash to the next, which a running sum cannot express.
    At most ``targets`` lines are walked.
    """
    rate = 1 + (rules.fee + rules.slippage)
    order = "rank" if execution else "position"
    buys = F.filter("_lines", lambda line: line["position"].isNotNull() & (line["gap"] > 0))
    queue = F.sort_array(F.transform(buys, lambda b: F.struct(b[order].alias("turn"), b["code"].alias("code"),
                                                              b["gap"].alias("need"), b["price"].alias("price"))))

    def kept(line: Column) -> Column:
        gross = line["sold"] * F.coalesce(line["price"], F.lit(0.0))
        return gross - (gross * rules.fee + gross * rules.tax + gross * rules.slippage)

    cash = F.aggregate("_lines", F.col("cash"), lambda acc, line: acc + kept(line))
    start = F.struct(cash.alias("cash"), F.create_map().alias("done")).cast(WALK)

    def step(state: Column, buy: Column) -> Column:
        affordable = F.floor((state["cash"] + CASH_SLACK) / (buy["price"] * rate))
        quantity = F.greatest(F.least(buy["need"], affordable), F.lit(0))
        reason = F.when(quantity == 0, "no_cash").when(quantity * buy["price"] < rules.min_trade, "below_minimum")
        filled = F.when(reason.isNull(), quantity).otherwise(F.lit(0))
        spent = filled * buy["price"]
        entry = F.struct(filled.cast("long").alias("filled"), reason.alias("reason"))
        return F.struct(
            (state["cash"] - spent - (spent * rules.fee + spent * rules.slippage)).alias("cash"),
            F.map_concat(state["done"], F.create_map(buy["code"], entry)).alias("done"),
        ).cast(WALK)

    return F.aggregate(queue, start, step, lambda state: state["done"])


def _finish_line(line: Column) -> Column:
    bought = F.element_at("_bought", line["code"])
    filled = F.when(line["sold"] > 0, line["sold"]).otherwise(F.coalesce(bought["filled"], F.lit(0)))
    selling = line["gap"] < 0
    held = line["quantity"].cast("long")
    return F.struct(
        *[line[name].alias(name) for name in ("code", "name", "position", "rank", "price", "desired", "gap")],
        held.alias("quantity"),
        F.when(selling, "sell").otherwise("buy").alias("side"),
        filled.alias("filled"),
        F.when(selling, held - filled).otherwise(held + filled).alias("after"),
        F.coalesce(line["reason"], bought["reason"]).alias("reason"),
    )


def rebalance(
    accounts: DataFrame,
    holdings: DataFrame,
    ranked: DataFrame,
    prices: DataFrame,
    rules: TradingRules = RULES,
    *,
    execution: bool = False,
    blocked: DataFrame | None = None,
) -> Proposal:
    """Orders of every account at its signal date.

    ``accounts`` (account, signal_date, cash); ``holdings`` (account, code, quantity), one row per name, so an
    account has at most as many lines as there are listed names; ``prices`` (signal_date, code,
    price).  Live proposals take a ranked name's price from the ranking and buy in target order;
    executions use the given opens only and buy by rank.  ``blocked`` (signal_date, code) names are refused
    at execution.

    The lines of an account are gathered once and everything after that is column
    arithmetic on the array: one exchange for the whole rebalance besides the joins.
    """
    reach = max(rules.targets, rules.keep_rank)
    key = ["signal_date", "code"]
    quoted = prices.select(*key, "price")
    listed = ranked.select(*key, "rank", "name", F.col("price").alias("_own"))
    quoted = quoted.join(listed, key, "full_outer")
    price = F.col("price") if execution else F.coalesce("_own", "price")
    quoted = quoted.withColumn("price", F.when(finite(price) & (price > 0), price))
    if blocked is None:
        quoted = quoted.withColumn("stopped", F.lit(False))
    else:
        stops = blocked.select(*key).distinct().withColumn("_stop", F.lit(True))
        quoted = quoted.join(stops, key, "left").withColumn("stopped", F.coalesce("_stop", F.lit(False)))
    entry = F.struct(F.col("rank"), F.col("code"), F.col("name"), F.col("price"), F.col("stopped"))
    board = quoted.filter(F.col("rank") <= reach).groupBy("signal_date").agg(
        F.sort_array(F.collect_list(entry)).alias("_board")
    )

    line = F.struct(
        F.col("code"), F.coalesce("name", "code").alias("name"), F.col("quantity").cast("double").alias("quantity"),
        F.col("rank").cast("int").alias("rank"), F.col("price"), F.coalesce("stopped", F.lit(False)).alias("stopped"),
    )
    held = (
        holdings.filter("quantity <> 0 OR quantity IS NULL")
        .join(accounts.select("account", "signal_date"), "account")
        .join(quoted, key, "left")
        .groupBy("account")
        .agg(F.collect_list(line).alias("_held"))
    )
    book = accounts.join(held, "account", "left").join(board, "signal_date", "left").withColumns(
        {
            "_held": F.coalesce("_held", F.array()),
            "_board": F.coalesce("_board", F.array()),
        }
    )
    number_ok = lambda h: F.coalesce(finite(h["quantity"]) & (h["quantity"] >= 0) & (h["quantity"] == F.floor(h["quantity"])), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~finite(F.col("cash")) | (F.col("cash") < 0), "bad_cash"),
            F.when(F.exists("_held", lambda h: ~number_ok(h)), "bad_quantity"),
            F.when(F.exists("_held", lambda h: (h["quantity"] > 0) & h["price"].isNull()), "held_without_price"),
        )
    )
    worth = F.aggregate(
        "_held", F.col("cash"), lambda acc, h: acc + F.coalesce(h["quantity"] * h["price"], F.lit(0.0))
    )
    # Held names within the keep rank come first, the board fills the rest.
    keepers = F.filter("_held", lambda h: (h["rank"] <= rules.keep_rank) & (h["quantity"] > 0))
    kept = F.slice(F.sort_array(F.transform(keepers, lambda h: F.struct(h["rank"].alias("rank"), h["code"].alias("code")))),
                   1, rules.targets) if rules.targets else F.array().cast("array<struct<rank:int,code:string>>")
    free = F.greatest(F.lit(rules.targets) - F.size("_kept"), F.lit(0))
    kept_codes = F.transform("_kept", lambda k: k["code"])
    fill = F.slice(F.filter("_board", lambda b: ~F.array_contains("_kept_codes", b["code"])), F.lit(1), free)
    held_lines = F.transform(
        "_held",
        lambda h: F.struct(
            h["code"].alias("code"), h["name"].alias("name"), h["quantity"].alias("quantity"),
            F.nullif(F.array_position("_targets", h["code"]), F.lit(0)).cast("int").alias("position"),
            h["rank"].alias("rank"), h["price"].alias("price"), h["stopped"].alias("stopped"),
        ),
    )
    owned_codes = F.transform("_held", lambda h: h["code"])
    new_lines = F.transform(
        F.filter("_fill", lambda b: ~F.array_contains("_owned", b["code"])),
        lambda b: F.struct(
            b["code"].alias("code"), b["name"].alias("name"), F.lit(0.0).alias("quantity"),
            F.array_position("_targets", b["code"]).cast("int").alias("position"),
            b["rank"].cast("int").alias("rank"), b["price"].alias("price"), b["stopped"].alias("stopped"),
        ),
    )
    planned = F.transform("_all", lambda line: _plan_line(line, rules, execution))
    book = (
        book.withColumns({"reasons": reasons, "equity": worth, "_kept": kept})
        .withColumns({"_kept_codes": kept_codes, "_owned": owned_codes})
        .withColumn("_fill", fill)
        .withColumn("_targets", F.concat("_kept_codes", F.transform("_fill", lambda b: b["code"])))
        .withColumn("_all", F.concat(held_lines, new_lines))
        .withColumn("_lines", planned)
        .withColumn("_bought", _walk_buys(rules, execution))
        .withColumn("fills", F.transform("_lines", _finish_line))
    )
    return Proposal(book.select("account", "signal_date", "cash", "equity", "reasons", "fills"), rules, execution)


def execution_rejections(
    targets: DataFrame, holdings: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Targets and held names whose decision at execution is anything but eligible, with its evidence.

    ``targets`` and ``holdings`` (account, signal_date, code); ``decisions`` (signal_date, code, state, reason_codes,
    evidence_ids).  A name without a decision counts as unknown.
    """
    key = ["account", "signal_date", "code"]
    touched = targets.select(*key).unionByName(holdings.select(*key)).distinct()
    return (
        touched.join(decisions, ["signal_date", "code"], "left")
        .withColumn("reason_codes", F.when(F.col("state").isNull(), F.array(F.lit("missing_security_identity")))
                    .otherwise(F.col("reason_codes")))
        .withColumn("state", F.coalesce("state", F.lit("unknown")))
        .filter("state <> 'eligible'")
    )


def weekly_summary(orders: DataFrame, keys: tuple[str, ...] = ("account", "signal_date")) -> DataFrame:
    """Turnover and cost components per key."""
    return orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("gross_amount").alias("turnover_amount"),
        F.sum("fee").alias("fee"),
        F.sum("tax").alias("tax"),
        F.sum("slippage").alias("slippage"),
        F.sum("cost_total").alias("cost_total"),
    )
