"""Bars and their companion tables from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a source to a file of the tables that are dealt by symbol, and their fewest files.
FILE_ROWS, FEWEST = 200_000, 8


def files_of(source: DataFrame) -> int:
    """The number of files that tables made of a source are dealt to, so that a file has about as many rows at any size."""
    return max(FEWEST, source.count() // FILE_ROWS)


def by_symbol(d: DataFrame, files: int | None) -> DataFrame:
    return d.repartition(files, "ts_code") if files else d.repartition("ts_code")


def bars_daily(events: DataFrame, files: int | None = None) -> DataFrame:
    """Open, high, low, close, count and sum of value by user and day."""
    at = F.struct("ts", "event_id")
    d = events.withColumns({"ts_code": F.col("user_id").cast("string"), "trade_date": F.date_format("ts", "yyyyMMdd")})
    return by_symbol(d, files).groupBy("ts_code", "trade_date").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("vol"), F.sum("value").alias("amount"))


def bars_weekly(lineitem: DataFrame, files: int | None = None) -> DataFrame:
    """The same by supplier and week (from Monday) of unit prices, quantities and extended prices.

    Firsts and lasts by eight columns make wide buffers, which sort rather than hash, and a supplier's week has few rows; so
    plain rows are dealt by the symbol, sorted once, and their weeks written as text after they are grouped.
    """
    d = lineitem.withColumns({"_p": F.col("l_extendedprice") / F.col("l_quantity"), "_week": F.date_trunc("week", "l_shipdate"), "ts_code": F.col("l_suppkey").cast("string")})
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    g = by_symbol(d, files).groupBy("ts_code", "_week").agg(
        F.min_by("_p", at).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", at).alias("close"), F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("amount"))
    return g.select("ts_code", F.date_format("_week", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", "vol", "amount")


def source(spark: SparkSession, sf_dir: str, weekly: bool) -> DataFrame:
    name = "lineitem" if weekly else "events"
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(source: DataFrame, weekly: bool, files: int | None = None) -> DataFrame:
    return (bars_weekly if weekly else bars_daily)(source, files)


def master(bars: DataFrame) -> DataFrame:
    """Symbols but those divisible by 7, listed from their first bar."""
    first = bars.groupBy("ts_code").agg(F.min("trade_date").alias("list_date")).where(F.col("ts_code").cast("long") % 7 != 0)
    return first.select("ts_code", F.concat(F.lit("N"), "ts_code").alias("name"), "list_date", F.lit(None).cast("string").alias("delist_date"))


def factors(bars: DataFrame, days: DataFrame) -> DataFrame:
    f = bars.select("ts_code", "trade_date").join(F.broadcast(days), "trade_date")
    return f.select("ts_code", "trade_date", (1.0 + 0.1 * F.floor(F.col("_trade_index") / 100)).cast("double").alias("adj_factor"))


def names(bars: DataFrame, days: DataFrame) -> DataFrame:
    """A name for each symbol every 60 days; each fifth starts with ST; announced a day before or after its start."""
    s = bars.select("ts_code").distinct().join(F.broadcast(days.where("_trade_index % 60 = 0")))
    k = F.floor(F.col("_trade_index") / 60)
    code = F.col("ts_code").cast("long")
    s = s.withColumns({"name": F.concat(F.when((code + k) % 5 == 0, "ST").otherwise("N"), "ts_code", F.lit("v"), k.cast("string")), "_a": F.greatest(F.col("_trade_index") + F.when(code % 2 == 0, 1).otherwise(-1), F.lit(0))})
    ann = days.select(F.col("trade_date").alias("ann_date"), F.col("_trade_index").alias("_a"))
    return s.join(F.broadcast(ann), "_a").select("ts_code", "name", F.col("trade_date").alias("start_date"), "ann_date")


def limits(panel: DataFrame) -> DataFrame:
    """Adds pre_close, up_limit and down_limit: a tenth from the previous close; none where (symbol + index) mod 11 is 0, crossed where mod 13 is 0."""
    w = Window.partitionBy("ts_code").orderBy("_trade_index")
    p = panel.withColumn("pre_close", F.coalesce(F.lag("close").over(w), F.col("close")))
    k = F.col("ts_code").cast("long") + F.col("_trade_index")
    up, down = F.round(F.round(F.col("pre_close") * 1.1, 6), 2), F.round(F.round(F.col("pre_close") * 0.9, 6), 2)
    cross = k % 13 == 0
    return p.withColumns({"up_limit": F.when(k % 11 != 0, F.when(cross, down).otherwise(up)), "down_limit": F.when(k % 11 != 0, F.when(cross, up).otherwise(down))})


def weights(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Every 20th day the first 30 symbols by code, at equal weights of 100 in all."""
    first = bars.select("ts_code").distinct().orderBy("ts_code").limit(30)
    return first.join(F.broadcast(days.where("_trade_index % 20 = 0"))).select(F.col("ts_code").alias("con_code"), "trade_date", F.lit(100.0 / 30).alias("weight"))


def status(panel: DataFrame) -> DataFrame:
    """suspended where (symbol + index) mod 17 is 0, missing_data where mod 19 is 0."""
    k = F.col("ts_code").cast("long") + F.col("_trade_index")
    s = F.when(k % 17 == 0, "suspended").when(k % 19 == 0, "missing_data")
    return panel.select("trade_date", "ts_code", s.alias("market_status")).where("market_status is not null")
