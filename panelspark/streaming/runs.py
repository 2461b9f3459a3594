"""Run events as streams: journal, latest state, terminal records, change feed, windows, commits, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_path
from ..sources.files import land

EVENT = "run_id string, step string, ts timestamp, percentage double, state string"


def journal(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the folder's new JSON lines: raw, event (null if malformed), malformed. Files are to appear whole."""
    fields = spark.createDataFrame([], schema).schema
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).where("trim(value) <> ''")
    e = F.from_json("value", fields, {"mode": "PERMISSIVE"})
    known = F.to_json(e) != "{}"
    return lines.select(F.col("value").alias("raw"), F.when(known, e).alias("event"), (~F.coalesce(known, F.lit(False))).alias("malformed"))


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each run and step, for batch tables and, in update mode, for streams."""
    last = F.max_by(F.struct("percentage", "state"), F.struct("ts", "event_id" if "event_id" in events.columns else "state"))
    return events.groupBy("run_id", "step").agg(last.alias("_s"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("events")).select("run_id", "step", "ts", "_s.percentage", "_s.state", "events")


def terminal_records(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """One terminal record of each run, however often it is delivered within the delay; for streams."""
    return events.where(F.col("state").isin("succeeded", "failed")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id"])


def window_counts(events: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Events by tumbling window and state; a stream appends a window once the watermark has passed it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "state").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "state", "events")


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote; keys: of rows that were updated, the last.

    Batches go to numbered folders, so that one that is run again replaces itself.
    """
    spark = stream.sparkSession
    out = new_path(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = spark.createDataFrame([], stream.schema).schema.add("_epoch", "long")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r")).select(*keys, "_r.*")
        return rows.select(*stream.columns)
    return rows.drop("_epoch")


def change_feed(before: DataFrame, after: DataFrame, key: str = "run_id", version: str = "version") -> DataFrame:
    """(key, change): add, change or remove between two snapshots."""
    j = before.select(key, F.col(version).alias("_a"), F.lit(True).alias("_in_a")).join(after.select(key, F.col(version).alias("_b"), F.lit(True).alias("_in_b")), key, "full")
    change = F.when(F.col("_in_a").isNull(), "add").when(F.col("_in_b").isNull(), "remove").when(~F.col("_a").eqNullSafe(F.col("_b")), "change")
    return j.select(key, change.alias("change")).where("change is not null")


def window_outcomes(windows: DataFrame, attempts: DataFrame) -> DataFrame:
    """(window_id, outcome) of ordered windows (window_id, start, stop): skipped without an attempt that started inside,
    failed if the last ended so, incomplete if it ended after the stop or not at all, else done. Windows are few; their
    attempts (window_id, started_at, ended_at, state) join by id."""
    inside = attempts.join(F.broadcast(windows), "window_id").where(F.col("started_at").between(F.col("start"), F.col("stop")))
    last = inside.groupBy("window_id").agg(F.max_by(F.struct("ended_at", "state"), F.struct("started_at", "state", "ended_at")).alias("l"))
    out = F.when(F.col("l").isNull(), "skipped").when(F.col("l.state") == "failed", "failed").when(F.col("l.ended_at").isNull() | (F.col("l.ended_at") > F.col("stop")), "incomplete").otherwise("done")
    return windows.join(last, "window_id", "left").select("window_id", out.alias("outcome"))


def unique_commits(commits: DataFrame) -> DataFrame:
    """The first commit of each (trade_date, trade_time); of one strategy each, else an error in column fault."""
    g = commits.groupBy("trade_date", "trade_time").agg(F.min_by(F.struct("commit_id", "strategy"), F.struct("committed_at", "commit_id")).alias("c"), F.count_distinct("strategy").alias("_n"))
    return g.select("trade_date", "trade_time", "c.*", F.when(F.col("_n") > 1, "several strategies").alias("fault"))


def reland(df: DataFrame, path: str, today: str, days: int = 7) -> None:
    """Lands the last natural days again, replacing their partitions; older ones stay."""
    start = F.date_format(F.date_sub(F.to_date(F.lit(today), "yyyyMMdd"), days - 1), "yyyyMMdd")
    recent = df.where((F.col("trade_date") >= start) & (F.col("trade_date") <= today))
    land(recent, path, list(df.columns))
