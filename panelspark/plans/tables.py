"""The operators chained from source tables to signals, market and labels, as the queries share them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import dealt, stored
from ..operators import context, features, labels, panel, portfolio, signals, status
from ..sources import bars


#: What market, signals and labels need of the flagged panel.
TRADED = ("ts_code", "trade_date", "_trade_index", "close", "adj_factor", "_close", "_high", "_low", "_has_market_data", "buyable", "can_buy", "can_sell", "market_status")

#: Places of a day that portfolios of the queries hold at most.
MOST_HELD = 5


class Tables:
    """Tables of one folder: daily bars of events or weekly bars of orders, and all that follows from them.

    Bars, calendar, what can be traded, its market and the signals, which many tables share, are written once, each with the
    columns that others read, and read again. All but the calendar are dealt by symbol to as many files, so that what follows
    joins and orders them by symbol without a shuffle, whatever their size.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, weekly: bool = True) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.weekly = weekly
        # joins by symbol and day, too, are to take rows as they are dealt by symbol: symbols are many and alike in size
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # a bucket of theirs is one file, so it comes in the order in which it was written, and isn't sorted again
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    @cached_property
    def source(self) -> DataFrame:
        return bars.load(bars.source(self.spark, self.sf_dir, self.weekly), self.weekly)

    @cached_property
    def files(self) -> int:
        return bars.files_of(bars.source(self.spark, self.sf_dir, self.weekly))

    def dealt(self, df: DataFrame, name: str, order: str = "trade_date") -> DataFrame:
        return dealt(df, name, "ts_code", self.files, order)

    @cached_property
    def bars(self) -> DataFrame:
        return self.dealt(bars.load(bars.source(self.spark, self.sf_dir, self.weekly), self.weekly, self.files), "bars")

    @cached_property
    def days(self) -> DataFrame:
        return stored(panel.calendar(self.bars), "days")

    @cached_property
    def master(self) -> DataFrame:
        return bars.master(self.bars)

    @cached_property
    def quotes(self) -> DataFrame:
        return panel.market_quotes(self.bars, bars.factors(self.bars, self.days))

    @cached_property
    def bounds(self) -> DataFrame:
        return panel.lifecycle_bounds(self.quotes, self.master)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.dense_panel(self.quotes, self.bounds, self.days)

    @cached_property
    def returns(self) -> DataFrame:
        """Returns of the panel over the context's horizons."""
        r = context.horizon_returns(self.panel)
        return self.dealt(r.select("ts_code", "trade_date", "_trade_index", "_ok", *[c for c in r.columns if c not in self.panel.columns and c != "_ok"]), "returns", "_trade_index")

    @cached_property
    def lagged(self) -> DataFrame:
        return features.lag_inputs(self.panel)

    @cached_property
    def named(self) -> DataFrame:
        return panel.historical_names(self.panel, bars.names(self.bars, self.days))

    @cached_property
    def limited(self) -> DataFrame:
        return status.price_limits(bars.limits(self.named))

    @cached_property
    def flagged(self) -> DataFrame:
        return status.execution_flags(status.market_flags(self.limited))

    @cached_property
    def traded(self) -> DataFrame:
        """The flagged panel without what only features read."""
        return self.dealt(self.flagged.select(*TRADED), "traded", "_trade_index")

    def market_of(self, flagged: DataFrame) -> DataFrame:
        m = flagged.select("trade_date", "ts_code", F.col("close").alias("price"), F.col("adj_factor").alias("adjustment_factor"), "can_buy", "can_sell", "market_status")
        return status.merge_status(m, bars.status(flagged))

    @cached_property
    def market(self) -> DataFrame:
        return self.dealt(self.market_of(self.traded), "market")

    @cached_property
    def signals(self) -> DataFrame:
        """Every quoted row with a score, which is the return over five days."""
        f = self.traded
        f = features.rolling(f, ("price",), (5,)).where("_has_market_data and roc5 is not null")
        s = status.buyable_at_signal(f, self.market)
        s = s.select("trade_date", F.lit("1500").alias("trade_time"), "ts_code", (-F.col("roc5")).alias("pred"), F.lit(True).alias("is_model_candidate"), "is_buyable_at_signal", F.col("close").alias("signal_price"), F.col("adj_factor").alias("signal_adjustment_factor"))
        return self.dealt(s, "signals")

    @cached_property
    def labels(self) -> DataFrame:
        return labels.next_day_labels(self.signals, self.market, self.days)

    @cached_property
    def scored_labels(self) -> DataFrame:
        """Labels beside the scores they are of."""
        return labels.next_day_labels(self.signals, self.market, self.days, "pred")

    @cached_property
    def top(self) -> DataFrame:
        """The best of each day, as many as portfolios hold; a calendar-sized table."""
        return stored(signals.best(self.signals, MOST_HELD), "top")

    @cached_property
    def top_market(self) -> DataFrame:
        """The market of the symbols that are ever among the best."""
        return stored(portfolio.market_of(self.top, self.market), "top_market")

    @cached_property
    def ranked(self) -> DataFrame:
        return signals.target_ranks(signals.rank_signals(self.signals))
