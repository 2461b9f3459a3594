"""Comparison of two strategies over their common days, and of parameter sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import period
from ..functions.stats import growth, is_finite

YEAR = 252


def paired_days(a: DataFrame, b: DataFrame, value: str = "net_return") -> DataFrame:
    """Days where both values are finite; the other columns come with suffixes _a and _b."""
    side = lambda d, s: d.select("trade_date", *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c != "trade_date"])
    j = side(a, "a").join(side(b, "b"), "trade_date")
    return j.where(is_finite(F.col(f"{value}_a")) & is_finite(F.col(f"{value}_b")))


def _stats(s: str) -> list[Column]:
    r, t = F.col(f"net_return_{s}"), F.col(f"turnover_{s}")
    n, total = F.count(r), growth(r)
    return [
        total.alias(f"total_{s}"), F.when(1 + total <= 0, -1.0).otherwise(F.pow(1 + total, F.lit(float(YEAR)) / n) - 1).alias(f"annualised_{s}"), (F.stddev_samp(r) * YEAR**0.5).alias(f"volatility_{s}"),
        F.min(f"_dd_{s}").alias(f"max_drawdown_{s}"), F.avg((r > 0).cast("double")).alias(f"win_rate_{s}"), F.avg(F.when(is_finite(t), t)).alias(f"turnover_{s}"),
    ]


def paired_ratio(x: Column) -> Column:
    """Annualised mean over deviation; null for under two values or no spread."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) > 1) & (sd > 0), F.avg(x) / sd * YEAR**0.5)


def strategy_stats(pairs: DataFrame) -> DataFrame:
    """One row: both strategies over their common days, and the ratio of their difference."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    for s in "ab":
        equity = F.product(1 + F.col(f"net_return_{s}")).over(w)
        pairs = pairs.withColumn(f"_e_{s}", equity).withColumn(f"_dd_{s}", F.col(f"_e_{s}") / F.greatest(F.lit(1.0), F.max(f"_e_{s}").over(w)) - 1)
    return pairs.agg(F.count(F.lit(1)).alias("days"), *_stats("a"), *_stats("b"), paired_ratio(F.col("net_return_a") - F.col("net_return_b")).alias("difference_ratio"))


def period_comparison(pairs: DataFrame) -> DataFrame:
    """(period_type, period, a, b, difference): compounded by year, quarter and month."""
    p = pairs.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("period_type"), period(k, F.col("trade_date")).alias("period")) for k in ("year", "quarter", "month")]))).select("*", "_p.*")
    g = p.groupBy("period_type", "period").agg(growth(F.col("net_return_a")).alias("a"), growth(F.col("net_return_b")).alias("b"))
    return g.withColumn("difference", F.col("b") - F.col("a"))


def paired_means(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, days, a, b): means over days where both are finite."""
    both = {c: is_finite(F.col(f"{c}_a")) & is_finite(F.col(f"{c}_b")) for c in columns}
    aggs = [x for c in columns for x in (F.count_if(both[c]).alias(f"n_{c}"), F.avg(F.when(both[c], F.col(f"{c}_a"))).alias(f"a_{c}"), F.avg(F.when(both[c], F.col(f"{c}_b"))).alias(f"b_{c}"))]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").alias("days"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns]))
    return pairs.agg(*aggs).select(rows.alias("r")).select("r.*")


def holding_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(trade_date, shared, only_a, only_b, jaccard) of two tables of holdings (trade_date, ts_code)."""
    held = lambda d, n: d.groupBy("trade_date").agg(F.collect_set("ts_code").alias(n))
    j = held(a, "x").join(held(b, "y"), "trade_date")
    shared, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return j.select("trade_date", shared.cast("long").alias("shared"), F.size(F.array_except("x", "y")).cast("long").alias("only_a"), F.size(F.array_except("y", "x")).cast("long").alias("only_b"), F.try_divide(shared, union).alias("jaccard"))


def moving_average(daily: DataFrame, columns: list[str], days: int = 20) -> DataFrame:
    """Adds ma_column: the mean of what is known of the last days. A row a day."""
    w = Window.orderBy("trade_date").rowsBetween(-(days - 1), 0)
    return daily.withColumns({f"ma_{c}": F.avg(c).over(w) for c in columns})


def cumulative_curve(daily: DataFrame, column: str = "net_return", additive: bool = False, keep_total: bool = False) -> DataFrame:
    """(trade_date, cumulative) from a start row of 0 (trade_date 'start'): compounded, or added; a missing day keeps the
    total and shows null, or with keep_total the total."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    x = F.when(is_finite(F.col(column)), F.col(column))
    total = F.coalesce(F.sum(x).over(w), F.lit(0.0)) if additive else F.coalesce(F.product(1 + x).over(w), F.lit(1.0)) - 1
    c = daily.select("trade_date", (total if keep_total else F.when(x.isNotNull(), total)).alias("cumulative"))
    return daily.sparkSession.createDataFrame([("start", 0.0)], "trade_date string, cumulative double").unionByName(c)


def last_on_or_before(daily: DataFrame, day: str) -> DataFrame:
    """The last row on or before a day."""
    return daily.where(F.col("trade_date") <= day).orderBy(F.desc("trade_date")).limit(1)


def column_sort(df: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Sorted by a column, what isn't finite last in either direction."""
    c = F.when(is_finite(F.col(column)), F.col(column))
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def parameter_report(summaries: dict[tuple[str, str, str], DataFrame], revisions: DataFrame) -> DataFrame:
    """Summaries of (preset, label, portfolio) in one table; the runs' input revisions must be one."""
    if revisions.select("revision").distinct().limit(2).count() > 1:
        raise ValueError("the runs read different inputs")
    tagged = [d.select(F.lit(p).alias("preset"), F.lit(y).alias("label"), F.lit(k).alias("portfolio"), "*") for (p, y, k), d in summaries.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
