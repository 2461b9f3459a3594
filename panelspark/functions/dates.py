"""Dates and times as text: YYYYMMDD and HHMM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def valid_date(x: Column) -> Column:
    """Whether x is a real YYYYMMDD day; null is not."""
    return F.coalesce(x.rlike(r"^\d{8}$") & F.try_to_date(x, "yyyyMMdd").isNotNull(), F.lit(False))


def valid_time(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^([01]\d|2[0-3])[0-5]\d$"), F.lit(False))


def as_date(x: Column) -> Column:
    return F.try_to_date(x, "yyyyMMdd")


def trade_day(x: Column) -> Column:
    """Dashes stripped."""
    return F.regexp_replace(x.cast("string"), "-", "")


def period(kind: str, day: Column) -> Column:
    """A day's period: all, year (YYYY), quarter (YYYYQn) or month (YYYY-MM)."""
    year, month = F.substring(day, 1, 4), F.substring(day, 5, 2)
    return {"overall": F.lit("all"), "year": year, "quarter": F.concat(year, F.lit("Q"), F.ceil(month.cast("int") / 3).cast("string")), "month": F.concat(year, F.lit("-"), month)}[kind]


def month_windows(spark: SparkSession, start: str, end: str, months: int) -> DataFrame:
    """Half-open windows [start, end) of so many months from start, a start's day held to its month's end; 0: one window."""
    span = spark.range(1).select(F.to_date(F.lit(start), "yyyyMMdd").alias("a"), F.to_date(F.lit(end), "yyyyMMdd").alias("z"))
    if months <= 0:
        return span.select(F.lit(0).cast("long").alias("window"), F.date_format("a", "yyyyMMdd").alias("start"), F.date_format("z", "yyyyMMdd").alias("end"))
    count = F.greatest(F.ceil(F.months_between("z", "a") / months).cast("int"), F.lit(0))
    k = span.select("a", "z", F.explode(F.sequence(F.lit(0), count)).alias("k"))
    w = k.select(F.col("k").cast("long").alias("window"), F.add_months("a", F.col("k") * months).alias("s"), F.least(F.add_months("a", (F.col("k") + 1) * months), "z").alias("e"))
    return w.where("s < e").select("window", F.date_format("s", "yyyyMMdd").alias("start"), F.date_format("e", "yyyyMMdd").alias("end"))


def landing_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Each day of the range, with the first and last day of its month inside the range."""
    a, z = F.to_date(F.lit(start), "yyyyMMdd"), F.to_date(F.lit(end), "yyyyMMdd")
    days = spark.range(1).select(F.explode(F.sequence(a, z)).alias("d"))
    text = lambda c: F.date_format(c, "yyyyMMdd")
    return days.select(text("d").alias("day"), text(F.greatest(F.trunc("d", "month"), a)).alias("month_start"), text(F.least(F.last_day("d"), z)).alias("month_end"))
