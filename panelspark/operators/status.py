"""Price limits, names' marks, history, and what may be traded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import is_finite, symbol_window

TICK = 1e-6
#: Fixed values of the market's rules: limit rates, prefixes of the wider boards, and the day the marked names' rate changes.
RATE, WIDE_RATE, MARKED_RATE = 0.10, 0.20, 0.05
WIDE_PREFIXES = ("300", "301", "688", "689")
MARKED_UNTIL = "20260706"
MARKED_NAME = r"^(S\*?ST|\*ST|ST)"
DELISTING = "退"


def price_limits(panel: DataFrame, marked_until: str = MARKED_UNTIL) -> DataFrame:
    """Adds up_limit_, down_limit_ and fallback: the official limits where both are finite and up > down, else from the
    previous close and the board's rate, rounded to cents half away from zero."""
    up, down = F.col("up_limit"), F.col("down_limit")
    official = F.coalesce(is_finite(up) & is_finite(down) & (up > down), F.lit(False))
    wide = F.lit(False)
    for p in WIDE_PREFIXES:
        wide = wide | F.col("ts_code").startswith(p)
    rate = F.when(F.upper("name").contains("ST") & (F.col("trade_date") < marked_until), MARKED_RATE).when(wide, WIDE_RATE).otherwise(RATE)
    own = lambda sign: F.round(F.round(F.col("pre_close") * (1 + sign * rate), 6), 2)  # noqa: E731  first past binary noise
    return panel.withColumns({"up_limit_": F.when(official, up).otherwise(own(1)), "down_limit_": F.when(official, down).otherwise(own(-1)), "fallback": ~official})


def market_flags(panel: DataFrame, history_days: int = 60, min_coverage: float = 0.8) -> DataFrame:
    """Adds is_st, is_delisting, at_up_limit, at_down_limit, history_short and buyable, for a panel with price limits.

    History is short with fewer market days since the first than history_days, or too few of them quoted.
    """
    # whole numbers, so what stood before the frame can be taken away
    so_far = F.sum(F.col("_has_market_data").cast("int")).over(symbol_window().rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum(F.col("_has_market_data").cast("int")).over(symbol_window().rowsBetween(Window.unboundedPreceding, -history_days))
    quoted = so_far - F.coalesce(before, F.lit(0))
    span = F.col("_trade_index") - F.min("_trade_index").over(symbol_window().rowsBetween(Window.unboundedPreceding, 0)) + 1
    # upper case is dear, and only of a first S or *, or of a letter beyond ASCII, does a mark come
    may = F.ascii("name").isin(42, 83, 115) | (F.ascii("name") > 127)
    p = panel.withColumns({
        "is_st": F.coalesce(F.when(may, F.upper("name").rlike(MARKED_NAME)), F.lit(False)), "is_delisting": F.coalesce(F.col("name").startswith(DELISTING) | F.col("name").endswith(DELISTING), F.lit(False)),
        "at_up_limit": F.coalesce(F.col("close") >= F.col("up_limit_") - TICK, F.lit(False)), "at_down_limit": F.coalesce(F.col("close") <= F.col("down_limit_") + TICK, F.lit(False)),
        "history_short": (span < history_days) | (quoted / history_days < min_coverage),
    })
    limits = F.coalesce(is_finite(F.col("up_limit_")) & is_finite(F.col("down_limit_")), F.lit(False))
    bad = F.col("is_st") | F.col("is_delisting") | F.col("at_up_limit") | F.col("at_down_limit") | F.col("history_short")
    return p.withColumn("buyable", F.col("_has_market_data") & limits & ~bad)


def execution_flags(panel: DataFrame) -> DataFrame:
    """can_buy, can_sell and market_status (quoted or missing_data) of each row; unknown is no."""
    close = F.col("close")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return panel.withColumns({
        "can_buy": yes(~F.col("is_st") & ~F.col("is_delisting") & (close < F.col("up_limit_") - TICK)), "can_sell": yes(close > F.col("down_limit_") + TICK),
        "market_status": F.when(F.col("_has_market_data"), "quoted").otherwise("missing_data"),
    })


def merge_status(market: DataFrame, status: DataFrame) -> DataFrame:
    """Explicit states override a market table's, may add rows that it lacks, and take away buying and selling."""
    keys = ["ts_code", "trade_date"]
    told = status.select(*keys, F.col("market_status").alias("_told"))
    both = market.join(told, keys, "full")
    free = F.col("_told").isNull()
    merged = both.withColumns({"market_status": F.coalesce("_told", "market_status"), "can_buy": F.coalesce(free & F.col("can_buy"), F.lit(False)), "can_sell": F.coalesce(free & F.col("can_sell"), F.lit(False))})
    return merged.select("trade_date", "ts_code", *[c for c in market.columns if c not in keys])


def buyable_at_signal(panel: DataFrame, market: DataFrame) -> DataFrame:
    """The panel's flag and, after explicit states, the market's."""
    m = market.select("trade_date", "ts_code", F.col("can_buy").alias("_can"))
    return panel.join(m, ["ts_code", "trade_date"], "left").withColumn("is_buyable_at_signal", F.col("buyable") & F.coalesce("_can", F.lit(False))).drop("_can")


def missing_as_suspended(market: DataFrame, on: bool = True) -> DataFrame:
    """Recodes missing_data as suspended."""
    return market.withColumn("market_status", F.when(F.col("market_status") == "missing_data", "suspended").otherwise(F.col("market_status"))) if on else market


def quality_counters(panel: DataFrame, master: DataFrame) -> DataFrame:
    """One row: rows without limits, rows on fallback limits, symbols that the master lacks."""
    counts = panel.where("_has_market_data").agg(F.count_if(F.col("up_limit").isNull() | F.col("down_limit").isNull()).alias("missing_limit_rows"), F.count_if("fallback").alias("fallback_limit_rows"))
    lacking = panel.select("ts_code").distinct().join(master.select("ts_code").distinct(), "ts_code", "left_anti").agg(F.count(F.lit(1)).alias("symbols_not_in_master"))
    return counts.crossJoin(F.broadcast(lacking))  # one row each
