"""Execution windows, commits and daily slices as streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import path_exists
from ..operators.report import online_slice


def stream_outcomes(windows: DataFrame, attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(window_id, outcome, fault) of streams of windows (window_id, start, stop) and attempts (window_id, started_at, ended_at,
    state, committed_at), as runs.window_outcomes() has them, each once the watermark has passed the window's stop.

    An outer join over the window's span: a window that no attempt meets in time is skipped when its stop has passed the
    watermark, and only windows and attempts that may still meet are kept.
    """
    w = windows.withWatermark("start", delay).alias("w")
    a = attempts.withWatermark("started_at", delay).alias("a")
    inside = F.expr("w.window_id = a.window_id and a.started_at >= w.start and a.started_at <= w.stop and a.started_at <= w.start + interval 1 day")
    met = w.join(a, inside, "left_outer").select(F.col("w.window_id").alias("window_id"), "w.start", "w.stop", "a.started_at", "a.ended_at", "a.state", "a.committed_at")
    last = F.max_by(F.struct("ended_at", "state", "committed_at"), F.when(F.col("started_at").isNotNull(), F.struct("started_at", "state", "ended_at")))
    return met.groupBy("window_id", "start", "stop").agg(last.alias("l")).select("window_id", *outcome_columns())


def outcome_columns() -> tuple:
    """outcome and fault of a window (stop) and its last attempt l: skipped without one, failed, incomplete after the stop, else done;
    a commit of an attempt that isn't done, or outside the window, is a fault."""
    attempt, committed = F.col("l"), F.col("l.committed_at")
    outcome = F.when(attempt.isNull(), "skipped").when(F.col("l.state") == "failed", "failed").when(F.col("l.ended_at").isNull() | (F.col("l.ended_at") > F.col("stop")), "incomplete").otherwise("done")
    wrong = committed.isNotNull() & ((outcome != "done") | ~committed.between(F.col("start"), F.col("stop")))
    return outcome.alias("outcome"), F.when(wrong, "invalid commit").alias("fault")


def commit_sink(path: str, strategy: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: commits (trade_date, trade_time, commit_id, strategy, ...) into a table by day and time.

    A batch that runs again replaces its own partitions with the same rows. Another id for a day and time, an id that is
    used twice, and another strategy than the table's (or the wished one) are refused before anything is written. Only the
    days of the batch are compared, but for ids and strategies, of which a row each is read.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates().persist()
        both = new.select("trade_date", "trade_time", "commit_id", "strategy")
        if path_exists(spark, path):
            both = both.unionByName(spark.read.schema(new.schema).parquet(path).select("trade_date", "trade_time", "commit_id", "strategy")).distinct()
        for keys, of, fault in ((["trade_date", "trade_time"], "commit_id", "duplicate daily signal"), (["commit_id"], "trade_date", "duplicate commit")):
            if both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                raise ValueError(f"{fault} ({of})")
        known = both.select("strategy").distinct() if strategy is None else both.where(F.col("strategy") != strategy).select("strategy")
        if known.limit(2).count() > (strategy is None):
            raise ValueError("a commit's strategy differs from its history")
        new.repartition("trade_date", "trade_time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date", "trade_time").parquet(path)
        new.unpersist()

    return write


def slice_sink(path: str, portfolios: dict[str, int]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: wide daily rows into a table of slices by day and portfolio, a portfolio's columns without their prefix.

    portfolios: key and size. A day comes whole in one batch; its partitions are replaced, so a batch that runs again, or a
    day that is published anew, leaves one version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        parts = [online_slice(batch, None, n, key) for key, n in portfolios.items()]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        out.repartition("trade_date", "portfolio_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date", "portfolio_key").parquet(path)

    return write
