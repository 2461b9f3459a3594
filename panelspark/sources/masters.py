"""Loaders of the tables that a panel rests on: open days, the list of symbols, and the history of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_days(raw: DataFrame) -> DataFrame:
    """(trade_date) of the rows (cal_date, is_open) that are open, each once. is_open counts as open where it is 1 as a number."""
    return raw.where(F.col("is_open").try_cast("int") == 1).select(F.col("cal_date").cast("string").alias("trade_date")).distinct()


def symbols(raw: DataFrame) -> DataFrame:
    """(ts_code, name, list_date, delist_date) as text; an empty delist_date is none."""
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in ("ts_code", "name", "list_date", "delist_date")])
    return text.withColumn("delist_date", F.nullif("delist_date", F.lit("")))


def name_history(raw: DataFrame) -> DataFrame:
    """(ts_code, _known_date, name, start_date, ann_date): a name is known from the later of its start and its announcement
    (from the one that isn't null). Of names of a symbol known from one day the last to start counts, then the greatest name."""
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in ("ts_code", "name", "start_date", "ann_date")])
    last = F.max(F.struct("start_date", "name", "ann_date")).alias("_last")
    by_day = text.groupBy("ts_code", F.greatest("start_date", "ann_date").alias("_known_date")).agg(last)
    return by_day.select("ts_code", "_known_date", "_last.name", "_last.start_date", "_last.ann_date")


def load_masters(spark: SparkSession, calendar: str, listed: str, names: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open days, symbols and names of three Parquet paths; other columns aren't read. No open day, no symbol, a null or a
    repeated ts_code among the symbols is an error, found by counts."""
    days, stocks = open_days(spark.read.parquet(calendar)), symbols(spark.read.parquet(listed))
    codes = stocks.groupBy("ts_code").count().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("count") > 1).alias("repeated"), F.count_if(F.col("ts_code").isNull()).alias("unnamed")).first()
    if days.isEmpty() or not codes["n"]:
        raise ValueError("no open day or no symbol")
    if codes["repeated"] or codes["unnamed"]:
        raise ValueError(f"symbols repeated: {codes['repeated']}, without a code: {codes['unnamed']}")
    return days, stocks, name_history(spark.read.parquet(names))
