"""Ranks of scores and frozen targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .analysis import exact_quantiles
from .checks import missing_keys

KEYS = ["trade_date", "trade_time", "ts_code"]


def rank_signals(signals: DataFrame) -> DataFrame:
    """Adds rank by score, the symbol breaking ties, and buyable_rank, its running count among buyable rows."""
    w = Window.partitionBy("trade_date", "trade_time").orderBy(F.desc("pred"), "ts_code")
    ok = F.col("is_buyable_at_signal")
    s = signals.withColumn("rank", F.row_number().over(w).cast("long"))
    return s.withColumn("buyable_rank", F.when(ok, F.sum(ok.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def _wanted() -> Column:
    return F.coalesce(F.col("is_model_candidate") & F.col("is_buyable_at_signal"), F.lit(False))


def target_ranks(signals: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Adds target_rank among candidates that are buyable (and in the universe's keys); null for others.

    A rank is the running count of such rows in the order of rank_signals, so both take one pass over a day.
    """
    s, wanted = signals, _wanted()
    if universe is not None:
        s, wanted = s.join(universe.select(*KEYS, F.lit(True).alias("_in")).distinct(), KEYS, "left"), wanted & F.coalesce("_in", F.lit(False))
    w = Window.partitionBy("trade_date", "trade_time").orderBy(F.desc("pred"), "ts_code").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("target_rank", F.when(wanted, F.count(F.when(wanted, 1)).over(w))).select(*signals.columns, "target_rank")


def universe_of(signals: DataFrame, name: str = "all", weight: str = "index_weight") -> DataFrame:
    """All rows, or the index's members."""
    return signals if name == "all" else signals.where(F.col(weight) > 0)


def best(signals: DataFrame, n: int) -> DataFrame:
    """The rows of target_ranks that rank n or better. Each task keeps its own n best of a day, so no more are dealt and ranked."""
    w = Window.partitionBy("trade_date", "trade_time").orderBy(F.desc("pred"), "ts_code")
    b = signals.where(_wanted()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return b.select(*signals.columns, F.col("_k").cast("long").alias("target_rank"))


def targets(ranked: DataFrame, n: int) -> DataFrame:
    """The n best of each day at equal weight; of ranked those that rank so are read (target_ranks, or best for few)."""
    return ranked.where(F.col("target_rank") <= n).withColumn("weight", F.lit(1.0 / n))


def restore(predictions: DataFrame, rankings: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Predictions with frozen ranks; candidates are the ranked. Scores, if given, must cover the keys and replace pred."""
    out = predictions.drop("is_model_candidate").join(rankings.select(*KEYS, "target_rank"), KEYS, "left").withColumn("is_model_candidate", F.col("target_rank").isNotNull())
    if scores is not None:
        if missing_keys(predictions, scores, KEYS).limit(1).count():
            raise ValueError("scores lack keys of the predictions")
        out = out.drop("pred").join(scores.select(*KEYS, "pred"), KEYS)
    return out


def in_model_window(days: DataFrame, windows: DataFrame) -> DataFrame:
    """Each day with the half-open window [start, end) that holds it; windows are few and don't overlap."""
    return days.join(F.broadcast(windows), (F.col("trade_date") >= F.col("start")) & (F.col("trade_date") < F.col("end")), "left")


def window_faults(windows: DataFrame) -> DataFrame:
    """Windows that overlap the one before or leave a gap to it."""
    prev = F.lag("end").over(Window.orderBy("start"))  # a handful of rows
    w = windows.withColumn("fault", F.when(F.col("start") >= F.col("end"), "empty").when(F.col("start") < prev, "overlap").when(F.col("start") > prev, "gap"))
    return w.where("fault is not null")


def prediction_range(predictions: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from start to the earlier of end and the last day there is."""
    return predictions.where(F.col("trade_date").between(start, end))


def prediction_statistics(p: DataFrame) -> DataFrame:
    """One row: days, symbols, spread of scores, and counts of flags. The median is exact, and no task holds all scores."""
    plain = p.agg(F.min("pred").alias("pred_min"), F.avg("pred").alias("pred_mean"), F.max("pred").alias("pred_max"), F.count_if("is_buyable_at_signal").alias("buyable_rows"), F.count_if("is_model_candidate").alias("candidate_rows"))
    count = lambda c, name: p.agg(F.countDistinct(c).alias(name))
    middle = exact_quantiles(p.where("pred is not null").select(F.lit("pred").alias("factor"), (F.col("pred") + 0.0).alias("value")), {"pred_median": 0.5})
    one = plain.crossJoin(F.broadcast(count("trade_date", "days"))).crossJoin(F.broadcast(count("ts_code", "symbols")))  # one row each
    one = one.join(F.broadcast(middle.select("pred_median")), how="left")
    return one.select("days", "symbols", "pred_min", "pred_mean", "pred_median", "pred_max", "buyable_rows", "candidate_rows")


def compare_predictions(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per key: consistent, different (by more than the tolerance), missing in either, or protocol_mismatch where protocols differ."""
    has = lambda d, n: d.select(*KEYS, F.col("pred").alias(f"pred_{n}"), F.col("protocol").alias(f"protocol_{n}"), F.lit(True).alias(f"has_{n}"))
    j = has(a, "a").join(has(b, "b"), KEYS, "full")
    out = F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), "missing").when(~F.col("protocol_a").eqNullSafe(F.col("protocol_b")), "protocol_mismatch")
    out = out.when(F.col("pred_a").isNull() | F.col("pred_b").isNull(), "error").when(F.abs(F.col("pred_a") - F.col("pred_b")) > tolerance, "different").otherwise("consistent")
    return j.select(*KEYS, "pred_a", "pred_b", out.alias("outcome"))
