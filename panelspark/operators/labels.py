"""Forward labels and training samples, without look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import avg_rank, clip, is_finite, symbol_window, with_quantiles


def next_day_labels(signals: DataFrame, market: DataFrame, days: DataFrame, *keep: str) -> DataFrame:
    """(keys, label_target_date, label_return, label_valid, label_status, and what to keep of it) for each signal.

    The target is the next market day, never the next day the symbol trades; the return is of adjusted prices.
    Status: valid, the entry's own state, pending past the last day, the target's state, or missing_data. The market has a row
    for each symbol and day, so a target's row, if there is one, is the next of the symbol, and one join brings both.
    """
    nxt = days.select("trade_date", F.lead("trade_date").over(Window.orderBy("trade_date")).alias("label_target_date"))  # calendar-sized
    s = signals.join(F.broadcast(nxt), "trade_date", "left")
    state = F.struct(F.col("trade_date").alias("day"), (F.col("price") * F.col("adjustment_factor")).alias("price"), F.col("market_status").alias("status"))
    m = market.select("ts_code", "trade_date", F.col("market_status").alias("_entry_status"), F.lead(state).over(symbol_window(order="trade_date")).alias("_next"))
    j = s.join(m, ["ts_code", "trade_date"], "left")
    there = F.col("_next.day") == F.col("label_target_date")
    j = j.withColumns({"_exit": F.when(there, F.col("_next.price")), "_exit_status": F.when(there, F.col("_next.status"))})
    ret = F.try_divide("_exit", F.col("signal_price") * F.col("signal_adjustment_factor")) - 1
    entry = F.coalesce("_entry_status", F.lit("missing_data"))
    status = F.when(entry != "quoted", entry).when(F.col("label_target_date").isNull(), "pending").when(F.coalesce("_exit_status", F.lit("missing_data")) != "quoted", F.coalesce("_exit_status", F.lit("missing_data")))
    status = status.when(F.coalesce(is_finite(ret), F.lit(False)), "valid").otherwise("missing_data")
    j = j.withColumn("label_status", status)
    return j.select("trade_date", "ts_code", "label_target_date", F.when(F.col("label_status") == "valid", ret).alias("label_return"), (F.col("label_status") == "valid").alias("label_valid"), "label_status", *keep)


def training_rows(dataset: DataFrame, labels: DataFrame, start: str, end: str, label: str = "label_return") -> DataFrame:
    """Rows of [start, end) whose label was known before end, valid, buyable and finite."""
    d = dataset.where((F.col("trade_date") >= start) & (F.col("trade_date") < end) & F.col("buyable"))
    y = labels.where(F.col("label_valid") & (F.col("label_target_date") < end) & is_finite(F.col(label)))
    return d.join(y, ["trade_date", "ts_code"])


def tail_trim(df: DataFrame, label: str, tail: float) -> DataFrame:
    """Rows within the day's linear quantiles tail and 1 - tail, ends included."""
    q = with_quantiles(df, label, {"_low": tail, "_high": 1 - tail}, "trade_date")
    return q.where(F.col(label).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def label_transforms(df: DataFrame, label: str = "label_return", tail: float = 0.025) -> DataFrame:
    """Adds label_return_rank, the average rank on [0, 1] (0.5 alone), and label_return_csz, the clipped day z-score (0 without spread)."""
    day = Window.partitionBy("trade_date")
    n = F.count(F.lit(1)).over(day)
    rank = F.when(n > 1, (F.col("_k") - 1) / (n - 1)).otherwise(0.5)
    d = df.where("trade_date is not null").withColumn("_k", avg_rank(label, "trade_date")).withColumn("label_return_rank", rank)  # the order first
    q = with_quantiles(d.drop("_k"), label, {"_low": tail, "_high": 1 - tail}, "trade_date")
    d = q.withColumn("_x", clip(F.col(label), F.col("_low"), F.col("_high")))
    sd = F.stddev_pop("_x").over(day)
    return d.withColumn("label_return_csz", F.when(sd > 1e-12, (F.col("_x") - F.avg("_x").over(day)) / sd).otherwise(0.0)).drop("_x", "_low", "_high")


def purged_split(df: DataFrame, ratio: float) -> DataFrame:
    """Adds part: valid for the last ceil(ratio * days) days (one at least, not all), fit for earlier rows whose label
    was known before them, purged for the rest."""
    days = df.select("trade_date").distinct()
    n = days.count()
    take = max(1, min(n - 1, -int(-(ratio * n) // 1)))
    start = days.orderBy(F.desc("trade_date")).limit(take).agg(F.min("trade_date").alias("_start"))
    part = F.when(F.col("trade_date") >= F.col("_start"), "valid").when(F.col("label_target_date") < F.col("_start"), "fit").otherwise("purged")
    return df.join(F.broadcast(start)).withColumn("part", part).drop("_start")
