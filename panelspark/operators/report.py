"""Daily diagnostics and period reports, long by portfolio size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import period
from ..functions.stats import avg_rank, finite, growth, is_finite, mean_over_std, safe_corr

PERIODS = ("overall", "year", "quarter", "month")


def matured(candidates: DataFrame, labels: DataFrame, as_of: str) -> DataFrame:
    """Ranked candidates with labels that were valid and known on the day as_of."""
    y = labels.select("trade_date", "ts_code", "label_target_date", "label_return", "label_valid")
    return known(candidates.join(y, ["trade_date", "ts_code"]), as_of)


def known(labelled: DataFrame, as_of: str) -> DataFrame:
    """The same of candidates that carry their labels."""
    return labelled.where(F.col("target_rank").isNotNull() & F.col("label_valid") & (F.col("label_target_date") <= as_of)).drop("label_valid")


def daily_diagnostics(m: DataFrame) -> DataFrame:
    """(trade_date, candidates, ic, rank_ic) of matured candidates."""
    r = m.withColumns({"_p": avg_rank("pred", "trade_date"), "_y": avg_rank("label_return", "trade_date")})
    return r.groupBy("trade_date").agg(F.count(F.lit(1)).alias("candidates"), finite(safe_corr(F.col("pred"), F.col("label_return"))).alias("ic"), finite(safe_corr(F.col("_p"), F.col("_y"))).alias("rank_ic"))


def ndcg(m: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(trade_date, top_n, ndcg): gains 2^relevance - 1 of the average rank's share, discounted by log2(rank + 1); null without gain."""
    day = Window.partitionBy("trade_date")
    r = m.withColumn("_rel", avg_rank("label_return", "trade_date") / F.count(F.lit(1)).over(day))
    r = r.withColumns({"_pos": F.row_number().over(day.orderBy("target_rank", "ts_code")), "_best": F.row_number().over(day.orderBy(F.desc("_rel"), "ts_code"))})
    gain = lambda at: (F.pow(F.lit(2.0), "_rel") - 1) / F.log2(F.col(at) + 1)
    r = r.withColumns({"_g": gain("_pos"), "_i": gain("_best")})
    each = r.withColumn("top_n", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])))
    s = lambda g, at: F.sum(F.when(F.col(at) <= F.col("top_n"), F.col(g)))
    return each.groupBy("trade_date", "top_n").agg(F.try_divide(s("_g", "_pos"), F.nullif(s("_i", "_best"), F.lit(0.0))).alias("ndcg"))


def benchmarks(labels: DataFrame, weights: DataFrame, coverage: float = 0.98) -> DataFrame:
    """weighted_returns of labels whose weights stand in another table."""
    return weighted_returns(labels.join(weights.select("trade_date", "ts_code", "index_weight"), ["trade_date", "ts_code"], "left"), coverage)


def weighted_returns(labels: DataFrame, coverage: float = 0.98) -> DataFrame:
    """(trade_date, universe_return, index_return) by label_target_date; the weighted mean only where the weights reach the coverage.

    Returns are summed by day and weight first, as all that are no members share one. Whether they do is told by one sum in order of size, so that it hangs on no order of rows: six thirtieths are a last digit
    above or below a fifth, as they happen to be added. Listed are a day's members, not the rows that weigh nothing.
    """
    weight = F.col("index_weight")
    alike = labels.where("label_valid").groupBy(F.col("label_target_date").alias("trade_date"), weight).agg(F.sum("label_return").alias("_r"), F.count("label_return").alias("_k"), F.count(F.lit(1)).alias("_n"))
    members = F.sort_array(F.flatten(F.collect_list(F.when(weight != 0, F.array_repeat(weight, F.col("_n").cast("int"))))))
    w = F.when(F.count(weight) > 0, F.aggregate(members, F.lit(0.0), lambda total, x: total + x))
    return alike.groupBy("trade_date").agg(F.try_divide(F.sum("_r"), F.sum("_k")).alias("universe_return"), F.when(w >= coverage, F.sum(weight * F.col("_r")) / w).alias("index_return"))


def top_detail(ranked: DataFrame, labels: DataFrame, n: int = 30) -> DataFrame:
    """(trade_date, candidate_count, holdings): the n best as an array of structs in rank order."""
    y = ranked.where("target_rank is not null").join(labels.select("trade_date", "ts_code", "label_return"), ["trade_date", "ts_code"], "left")
    count = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    y = y.withColumn("_n", count)
    item = F.struct(F.col("target_rank").alias("rank"), F.col("ts_code").alias("code"), F.col("pred").alias("prediction"), F.col("label_return").alias("daily_return"), (1 / F.least(F.col("_n"), F.lit(n)).cast("double")).alias("weight"))
    return y.groupBy("trade_date").agg(F.max("_n").alias("candidate_count"), F.sort_array(F.collect_list(F.when(F.col("target_rank") <= n, item))).alias("holdings"))


def attach_benchmarks(daily: DataFrame, bench: DataFrame) -> DataFrame:
    return daily.join(F.broadcast(bench), "trade_date", "left")  # a row a day


def by_period(daily: DataFrame) -> DataFrame:
    """A row per day and period it belongs to: period_type, period."""
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("period_type"), period(k, F.col("trade_date")).alias("period")) for k in PERIODS]))
    return daily.withColumn("_p", p).select("*", "_p.*").drop("_p")


def with_drawdown(p: DataFrame, returns: str, name: str, *keys: str) -> DataFrame:
    """Adds name_equity, the compounded returns so far (a null adds nothing), and name, its place below the peak (1 at least)."""
    w = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn(f"{name}_equity", F.coalesce(F.product(1 + F.col(returns)).over(w), F.lit(1.0)))
    return p.withColumn(name, F.col(f"{name}_equity") / F.greatest(F.lit(1.0), F.max(f"{name}_equity").over(w)) - 1)


def period_summary(daily: DataFrame, risk_free: float = 0.012, year: int = 252, bench: tuple[str, ...] = ("universe_return",)) -> DataFrame:
    """(period_type, period, top_n, ...) of a long daily table (trade_date, top_n, net_return, gross_return, turnover, delayed, positions, benchmarks)."""
    keys = ("period_type", "period", "top_n")
    p = with_drawdown(by_period(daily), "net_return", "drawdown", *keys)
    for b in bench:
        active = F.when(is_finite(F.col("gross_return")) & is_finite(F.col(b)), F.col("gross_return") - F.col(b))
        p = with_drawdown(p.withColumn(f"active_{b}", active), f"active_{b}", f"reldd_{b}", *keys)
    n = F.count("net_return")
    total = growth(F.col("net_return"))
    rf = (1 + risk_free) ** (1 / year) - 1
    root = float(year) ** 0.5
    cols = [
        F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), n.alias("days"), total.alias("net_total"), growth(F.col("gross_return")).alias("gross_total"),
        F.when(1 + total <= 0, -1.0).otherwise(F.pow(1 + total, F.lit(float(year)) / n) - 1).alias("net_annualised"), (F.stddev_samp("net_return") * root).alias("net_volatility"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.avg("turnover").alias("turnover"), F.sum("delayed").alias("delayed"), F.max_by("positions", "trade_date").alias("open_positions"),
        (mean_over_std(F.col("gross_return") - rf) * root).alias("sharpe"), mean_over_std(F.col("net_return")).alias("return_ir"),
    ]
    for b in bench:
        cols += [(mean_over_std(F.col(f"active_{b}")) * root).alias(f"ir_{b}"), growth(F.col(f"active_{b}")).alias(f"active_total_{b}"), F.min(f"reldd_{b}").alias(f"max_reldd_{b}")]
    return p.groupBy(*keys).agg(*cols)


def online_slice(daily: DataFrame, day: str | None, top_n: int, key: str) -> DataFrame:
    """One day's (or with None every day's) columns of one size without their topN_ prefix, tagged; nested columns are left out."""
    flat = [c for c, t in daily.dtypes if not t.startswith(("array", "struct", "map"))]
    prefix = f"top{top_n}_"
    keep = [F.col(c).alias(c.removeprefix(prefix)) for c in flat if c.startswith(prefix) or not c.startswith("top")]
    rows = daily if day is None else daily.where(F.col("trade_date") == day)
    return rows.select(F.lit(key).alias("portfolio_key"), *keep)


def widened(long: DataFrame, sizes: tuple[int, ...], values: tuple[str, ...]) -> DataFrame:
    """The wide form: a column topN_value for each size."""
    return long.groupBy("trade_date").agg(*[F.max(F.when(F.col("top_n") == n, F.col(v))).alias(f"top{n}_{v}") for n in sizes for v in values])


def renamed_size(wide: DataFrame, a: int, b: int) -> DataFrame:
    return wide.withColumnsRenamed({c: f"top{b}_" + c.removeprefix(f"top{a}_") for c in wide.columns if c.startswith(f"top{a}_")})
