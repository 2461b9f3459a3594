"""Set-based accounting of equal-weight cohorts: orders, trades, positions, daily results.

A cohort of each signal day gets 1/H of the capital for H days, each of its N names an equal part. There is no cash
account and no fill capacity, which are path-dependent; where an exit is delayed or H > 1 a sequential ledger differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import identity_key, portfolio_identity

BUY_COST, SELL_COST = 0.0005, 0.0015


def grid(universes: DataFrame, strategies: DataFrame, top_ns: DataFrame, trade_time: str = "1500") -> DataFrame:
    """Every universe, strategy and size, once, with identity and key: configuration tables of a few rows each."""
    g = universes.distinct().crossJoin(F.broadcast(strategies.distinct())).crossJoin(F.broadcast(top_ns.distinct()))
    g = g.withColumn("identity", portfolio_identity(F.col("universe"), F.col("score_selection"), F.col("strategy"), F.col("top_n"), F.lit(trade_time)))
    return g.withColumns({"portfolio_key": identity_key(F.col("identity")), "ensemble_key": identity_key(F.col("identity"), ("score_selection",))}).dropDuplicates(["portfolio_key"])


def order_outcomes(targets: DataFrame, market: DataFrame) -> DataFrame:
    """Adds entry_price (adjusted), outcome and reason: filled, or unfilled for missing_data, the market's state or not_buyable."""
    m = market.select("trade_date", "ts_code", (F.col("price") * F.col("adjustment_factor")).alias("entry_price"), "can_buy", "market_status")
    t = targets.join(m, ["trade_date", "ts_code"], "left")
    status = F.coalesce("market_status", F.lit("missing_data"))
    reason = F.when(status != "quoted", status).when(~F.coalesce("can_buy", F.lit(False)), "not_buyable")
    return t.withColumns({"reason": reason, "outcome": F.when(reason.isNull(), "filled").otherwise("unfilled")}).drop("can_buy", "market_status")


def market_of(targets: DataFrame, market: DataFrame) -> DataFrame:
    """The market of the symbols that are ever a target, which is all that orders, trades and positions read of it. Of a few
    targets a day these are few beside the market, however many symbols it has."""
    return market.join(targets.select("ts_code").distinct(), "ts_code", "left_semi")


def planned_exits(orders: DataFrame, days: DataFrame, holding: int) -> DataFrame:
    """Adds planned_exit, so many market days after the entry; null past the last day."""
    later = days.select(F.col("trade_date").alias("planned_exit"), (F.col("_trade_index") - holding).alias("_i"))
    at = days.select("trade_date", F.col("_trade_index").alias("_i")).join(later, "_i", "left").select("trade_date", "planned_exit")
    return orders.join(F.broadcast(at), "trade_date", "left")


def next_sale(market: DataFrame) -> DataFrame:
    """(ts_code, planned_exit, exit_date, exit_price): for every day the first from it on when the symbol is quoted and can be sold."""
    w = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(0, Window.unboundedFollowing)
    can = F.col("can_sell") & (F.col("market_status") == "quoted")
    sale = F.first(F.when(can, F.struct(F.col("trade_date").alias("d"), (F.col("price") * F.col("adjustment_factor")).alias("p"))), ignorenulls=True).over(w)
    return market.select("ts_code", F.col("trade_date").alias("planned_exit"), sale.alias("s")).select("ts_code", "planned_exit", F.col("s.d").alias("exit_date"), F.col("s.p").alias("exit_price"))


def trade_log(orders: DataFrame, market: DataFrame, days: DataFrame, holding: int, buy_cost: float = BUY_COST, sell_cost: float = SELL_COST) -> DataFrame:
    """A row per filled order: entry, exit (null while open), principal, realised return, fee, delayed."""
    filled = planned_exits(orders.where("outcome = 'filled'"), days, holding)
    t = filled.join(next_sale(market), ["ts_code", "planned_exit"], "left")
    growth = F.try_divide("exit_price", "entry_price")
    principal = F.col("weight") / holding
    return t.select(
        "ts_code", F.col("trade_date").alias("entry_date"), "planned_exit", "exit_date", "entry_price", "exit_price", principal.alias("principal"),
        (growth - 1).alias("realised_return"), (principal * buy_cost + F.coalesce(principal * growth * sell_cost, F.lit(0.0))).alias("fee"),
        F.coalesce(F.col("exit_date") > F.col("planned_exit"), F.lit(False)).alias("delayed"),
    )


def positions(trades: DataFrame, market: DataFrame, days: DataFrame) -> DataFrame:
    """A row per trade and day held, the exit's day included, with the adjusted mark, carried through days without a quote.

    A trade meets the few days it is held by an explode of its calendar places, not by a range join.
    """
    at = lambda name: days.select(F.col("trade_date").alias(name), F.col("_trade_index").alias(f"_{name}"))
    last = F.broadcast(days.agg(F.max("_trade_index").alias("_last")))
    t = trades.join(F.broadcast(at("entry_date")), "entry_date").join(F.broadcast(at("exit_date")), "exit_date", "left").join(last)
    t = t.withColumn("_trade_index", F.explode(F.sequence("_entry_date", F.coalesce("_exit_date", "_last"))))
    t = t.join(F.broadcast(days), "_trade_index")
    marks = market.where("market_status = 'quoted'").select("trade_date", "ts_code", (F.col("price") * F.col("adjustment_factor")).alias("_m"))
    p = t.join(marks, ["trade_date", "ts_code"], "left")
    w = Window.partitionBy("ts_code", "entry_date").orderBy("_trade_index")
    mark = F.when(F.col("trade_date") == F.col("entry_date"), F.col("entry_price")).when(F.col("trade_date") == F.col("exit_date"), F.col("exit_price")).otherwise(F.col("_m"))
    p = p.withColumn("mark", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.withColumn("previous_mark", F.lag("mark").over(w)).select("trade_date", "ts_code", "entry_date", "exit_date", "principal", "entry_price", "mark", "previous_mark", "delayed", F.col("_m").isNull().alias("mark_carried"))


def daily_results(held: DataFrame, orders: DataFrame, days: DataFrame, events: DataFrame | None = None, buy_cost: float = BUY_COST, sell_cost: float = SELL_COST) -> DataFrame:
    """(trade_date, equity, net_return, gross_return, cost, turnover, positions, delayed, unfilled) of every market day.

    Cost and turnover are over the equity before the day. events (trade_date, pending_cash, cost, notional): receivables
    count in equity while pending, their cost and notional as trading.
    """
    value = F.col("principal") * F.col("mark") / F.col("entry_price")
    gain = F.col("principal") * (F.col("mark") - F.col("previous_mark")) / F.col("entry_price")
    buys, sells = F.when(F.col("trade_date") == F.col("entry_date"), F.col("principal")), F.when(F.col("trade_date") == F.col("exit_date"), value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = lambda c: zero(F.sum(c))
    d = held.groupBy("trade_date").agg(total(gain).alias("_gain"), (total(buys) * buy_cost + total(sells) * sell_cost).alias("_fee"), (total(buys) + total(sells)).alias("_traded"), F.count_if(~F.coalesce(F.col("trade_date") == F.col("exit_date"), F.lit(False))).alias("_n"), F.count_if(F.col("delayed") & (F.col("trade_date") == F.col("exit_date"))).alias("_d"))
    u = orders.groupBy("trade_date").agg(F.count_if(F.col("outcome") == "unfilled").alias("_u"))
    j = days.select("trade_date").join(d, "trade_date", "left").join(u, "trade_date", "left")
    if events is None:
        j = j.withColumns({"_pending": F.lit(0.0), "_ecost": F.lit(0.0), "_notional": F.lit(0.0)})
    else:
        e = events.groupBy("trade_date").agg(F.sum("pending_cash").alias("_pending"), F.sum("cost").alias("_ecost"), F.sum("notional").alias("_notional"))
        j = j.join(F.broadcast(e), "trade_date", "left")
    w = Window.orderBy("trade_date")  # a row a day
    j = j.withColumn("_c", zero("_fee") + zero("_ecost"))
    j = j.withColumn("equity", 1 + F.sum(zero("_gain") - F.col("_c")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + zero("_pending"))
    j = j.withColumns({"_before": F.coalesce(F.lag("equity").over(w), F.lit(1.0)), "_change": zero("_gain") - F.col("_c") + zero("_pending") - F.coalesce(F.lag(zero("_pending")).over(w), F.lit(0.0))})
    cost, net = F.col("_c") / F.col("_before"), F.col("_change") / F.col("_before")  # not of two equities: a day without trade is 0
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select("trade_date", "equity", net.alias("net_return"), (net + cost).alias("gross_return"), cost.alias("cost"), ((zero("_traded") + zero("_notional")) / F.col("_before")).alias("turnover"), n("_n").alias("positions"), n("_d").alias("delayed"), n("_u").alias("unfilled"))


def cohort_results(targets: DataFrame, market: DataFrame, days: DataFrame, holding: int = 1, events: DataFrame | None = None) -> DataFrame:
    """Targets to daily results: orders, trades, positions, sums."""
    orders = order_outcomes(targets, market)
    return daily_results(positions(trade_log(orders, market, days, holding), market, days), orders, days, events)


def rank_band(ranked: DataFrame, n: int, buffer: float = 1.0) -> DataFrame:
    """Adds member: in from a rank of n or better, out from a rank past ceil(n * buffer) or none, else as before.

    ranked has a row for each symbol and day.
    """
    leave = -int(-(n * buffer) // 1)
    event = F.when(F.col("target_rank") <= n, 1).when(F.col("target_rank").isNull() | (F.col("target_rank") > leave), 0)
    w = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("member", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0)) == 1)


def replacements(banded: DataFrame, n: int, fraction: float = 0.2) -> DataFrame:
    """(trade_date, entries, exits, cap, breach): members that came and went since the day before, against the cap."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    b = banded.withColumn("_was", F.coalesce(F.lag("member").over(w), F.lit(False)))
    cap = max(1, int(n * fraction + 1e-12))
    d = b.groupBy("trade_date").agg(F.count_if(F.col("member") & ~F.col("_was")).alias("entries"), F.count_if(~F.col("member") & F.col("_was")).alias("exits"))
    return d.withColumns({"cap": F.lit(cap).cast("long"), "breach": F.col("exits") > cap})


def evaluation_status(held: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: incomplete_market_data if a held day had no quote or a target no data, else done."""
    flags = held.select(F.col("mark_carried").alias("f")).unionByName(orders.select(F.coalesce(F.col("reason") == "missing_data", F.lit(False)).alias("f")))
    return flags.agg(F.when(F.coalesce(F.max("f"), F.lit(False)), "incomplete_market_data").otherwise("done").alias("status"))
