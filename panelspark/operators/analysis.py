"""Factor diagnostics, for all factors in one scan: columns become rows, then group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import avg_rank, finite, is_finite, lenient, safe_corr
from ..functions.storage import stored


def long_factors(df: DataFrame, factors: list[str], *keep: str) -> DataFrame:
    """(keep, factor, value): a row for each factor of each row."""
    values = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors])
    return df.select(*keep, F.explode(values).alias("f")).select(*keep, "f.*")


def exact_quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(factor, distinct, and a column for each share): the number of different values and exact, linearly interpolated
    quantiles of values (factor, value), which have no nulls.

    Equal values are counted first, so a value that many rows share is one row. The counts are dealt by ranges of factor and
    value; counts of ranges, a row for each factor and task, tell how many rows stand before a range. So no task sorts more
    than its range, and none holds a factor.
    """
    counts = values.groupBy("factor", "value").agg(F.count(F.lit(1)).alias("n"))
    dealt = stored(counts.repartitionByRange("factor", "value").sortWithinPartitions("factor", "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("factor", "part").agg(F.sum("n").alias("n"))
    ranges = Window.partitionBy("factor")
    before = sums.select("factor", "part", F.coalesce(F.sum("n").over(ranges.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(ranges).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("factor", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.join(before, ["factor", "part"]).withColumn("stop", F.col("before") + upto).withColumn("start", F.col("stop") - F.col("n"))
    out = [F.count(F.lit(1)).alias("distinct")]
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(share)
        low = F.floor(at)
        holds = lambda k: F.max(F.when((F.col("start") <= k) & (k < F.col("stop")), F.col("value")))
        first, second = holds(low), holds(F.least(low + 1, F.col("total") - 1))
        out.append((first + (second - first) * F.max(at - low)).alias(name))
    return placed.groupBy("factor").agg(*out)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: counts and rates of null, NaN, infinite, finite, zero; statistics of the finite values alone."""
    x = F.col("value")
    ok = finite(x)
    rate = lambda c: c / F.count(F.lit(1))
    nan, inf = F.count_if(F.isnan(x)), F.count_if(F.abs(x) == float("inf"))
    rows = long_factors(df, columns)
    plain = rows.groupBy("factor").agg(
        F.count(F.lit(1)).alias("total"), F.count(x).alias("non_null"), nan.alias("nan"), inf.alias("inf"), F.count(ok).alias("finite"), F.count_if(ok == 0).alias("zero"),
        rate(F.count(ok)).alias("finite_rate"), rate(F.count_if(ok == 0)).alias("zero_rate"), F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"),
    )
    ordered = exact_quantiles(rows.select("factor", (ok + 0.0).alias("value")).where("value is not null"), {"p03": 0.03, "p50": 0.5, "p97": 0.97})
    names = ["total", "non_null", "nan", "inf", "finite", "zero", "finite_rate", "zero_rate", "min", "p03", "p50", "p97", "max", "mean", "std"]
    return plain.join(ordered, "factor", "left").select("factor", *names, F.coalesce("distinct", F.lit(0).cast("long")).alias("distinct"))


def analysis_rows(features: DataFrame, labels: DataFrame, tradable_only: bool = True) -> DataFrame:
    """Features with valid labels, by default of buyable rows."""
    d = features.join(labels, ["trade_date", "ts_code"], "left").where("label_valid")
    return d.where("buyable") if tradable_only else d


def factor_pairs(df: DataFrame, factors: list[str], label: str) -> DataFrame:
    """(factor, trade_date, value, label, value_rank, label_rank) of rows where both are finite."""
    pairs = long_factors(df.withColumn("label", F.col(label)), factors, "trade_date", "label")
    pairs = pairs.where(is_finite(F.col("value")) & is_finite(F.col("label")))
    return pairs.withColumns({"value_rank": avg_rank("value", "factor", "trade_date"), "label_rank": avg_rank("label", "factor", "trade_date")})


def daily_ic(pairs: DataFrame, min_samples: int = 20) -> DataFrame:
    """(factor, trade_date, samples, ic, rank_ic) of days with enough samples: Pearson of values, and of average ranks."""
    g = pairs.groupBy("factor", "trade_date").agg(F.count(F.lit(1)).alias("samples"), safe_corr(F.col("value"), F.col("label")).alias("ic"), safe_corr(F.col("value_rank"), F.col("label_rank")).alias("rank_ic"))
    return g.where(F.col("samples") >= min_samples)


def ic_summary(daily: DataFrame) -> DataFrame:
    """Per factor: days, and mean, deviation, share of positive days, ratio and t of both correlations; quantiles of rank_ic."""
    cols = [F.count(F.lit(1)).alias("days")]
    for c, name in (("ic", "ic"), ("rank_ic", "rankic")):
        x = F.col(c)
        sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
        ir = F.when(sd > 0, F.avg(x) / sd).otherwise(0.0)
        cols += [F.avg(x).alias(f"{name}_mean"), sd.alias(f"{name}_std"), F.avg((x > 0).cast("double")).alias(f"{name}_positive"), ir.alias(f"{name}ir"), (ir * F.sqrt(F.count(x))).alias(f"{name}_t")]
    cols += [F.percentile("rank_ic", F.lit(p)).alias(f"rankic_p{round(100 * p):02d}") for p in (0.05, 0.5, 0.95)]
    return daily.groupBy("factor").agg(*cols)


def quantile_returns(pairs: DataFrame, quantiles: int = 10, min_samples: int = 20) -> DataFrame:
    """(factor, quantile, mean_return, std_return, samples, days): mean label by day and bucket, then over days.

    A bucket follows the average rank, so equal values share one (unlike ntile).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("factor", "trade_date"))
    bucket = F.least(F.greatest(F.floor((F.col("value_rank") - 1) / n * quantiles), F.lit(0)), F.lit(quantiles - 1)) + 1
    b = pairs.withColumns({"_n": n, "quantile": bucket.cast("long")}).where(F.col("_n") >= min_samples)
    daily = b.groupBy("factor", "trade_date", "quantile").agg(F.avg("label").alias("r"), F.count(F.lit(1)).alias("k"))
    return daily.groupBy("factor", "quantile").agg(F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("std_return"), F.sum("k").alias("samples"), F.count(F.lit(1)).alias("days"))


def spread_and_monotonicity(buckets: DataFrame, quantiles: int = 10) -> DataFrame:
    """Per factor: the top bucket's mean return less the bottom's, and the rank correlation of bucket and mean return."""
    b = buckets.withColumns({"_r": avg_rank("mean_return", "factor"), "_q": avg_rank("quantile", "factor")})
    at = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean_return")))
    return b.groupBy("factor").agg((at(quantiles) - at(1)).alias("spread"), safe_corr(F.col("_q"), F.col("_r")).alias("monotonicity"))


def factor_table(df: DataFrame, factors: list[str], label: str, quantiles: int = 10, min_samples: int = 20) -> DataFrame:
    """The factor report: coverage, IC summary, spread, monotonicity, direction and rank by mean of the orders of strength."""
    pairs = stored(factor_pairs(df, factors, label), "pairs")  # two reports read them
    total = long_factors(df, factors).groupBy("factor").agg(F.count(F.lit(1)).alias("total"), F.count(finite(F.col("value"))).alias("valid"))
    s = ic_summary(daily_ic(pairs, min_samples)).join(spread_and_monotonicity(quantile_returns(pairs, quantiles, min_samples), quantiles), "factor").join(total, "factor")
    s = s.withColumns({"coverage": F.try_divide("valid", "total"), "direction": F.when(F.col("rankic_mean") > 0, "positive").when(F.col("rankic_mean") < 0, "negative").otherwise("unknown")})
    return rank_factors(s)


def rank_factors(summary: DataFrame) -> DataFrame:
    """Adds score_rank: the mean of the average ranks of |rankic_mean| and |rankicir|, the strongest first. A row per factor."""
    s = summary.withColumns({"_a": -F.abs("rankic_mean"), "_b": -F.abs("rankicir"), "_all": F.lit(1)})
    return s.withColumn("score_rank", (avg_rank("_a", "_all") + avg_rank("_b", "_all")) / 2).drop("_a", "_b", "_all")


def by_strength(summary: DataFrame, score: str = "rankic_mean") -> DataFrame:
    return summary.orderBy(F.desc(F.abs(score)), "factor")


def feature_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """The features in order as doubles; text, NaN and infinite values become null."""
    return df.select(*[lenient(F.col(f)).alias(f) for f in features])
