"""Column helpers whose null, NaN and tie rules the operators share. NULL is published, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

INF = float("inf")


def is_finite(x: Column) -> Column:
    """Null stays null."""
    return ~F.isnan(x) & (F.abs(x) < INF)


def finite(x: Column) -> Column:
    """x as a double, null where it isn't finite."""
    x = x.cast("double")
    return F.when(is_finite(x), x)


def lenient(x: Column) -> Column:
    """As finite, for text too: what is no number is null."""
    return finite(x.try_cast("double"))


def symbol_window(rows: int | None = None, key: str = "ts_code", order: str = "_trade_index") -> WindowSpec:
    """A symbol's rows by market day; rows: the last so many, the current one included."""
    w = Window.partitionBy(key).orderBy(order)
    return w if rows is None else w.rowsBetween(-(rows - 1), 0)


def over(x: Column, w: WindowSpec | None) -> Column:
    return x if w is None else x.over(w)


def safe_corr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation of the rows where both are finite; null where either doesn't vary."""
    both = is_finite(x) & is_finite(y)
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(over(F.covar_samp(px, py), w), over(F.stddev_samp(px), w) * over(F.stddev_samp(py), w))


def avg_rank(value: str, *partition: str, descending: bool = False) -> Column:
    """Rank from 1 within the partition; equal values share their mean rank. Ties are counted in the same order, so the rows are
    dealt and sorted once."""
    w = Window.partitionBy(*partition).orderBy(F.col(value).desc() if descending else F.col(value).asc())
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w) + (ties - 1) / 2.0


def with_quantiles(df: DataFrame, value: str, shares: dict[str, float], *partition: str) -> DataFrame:
    """Adds exact, linearly interpolated quantiles of a column's known values within the partition, by share.

    Places in one order tell where a share lies, so rows are dealt by the partition alone and sorted on disk where they must
    be; an aggregate by percentile keeps all different values of all partitions in the memory of each task. Nulls stand first, as
    in avg_rank, so that both take one order.
    """
    part = Window.partitionBy(*partition)
    d = df.withColumn("_i", F.row_number().over(part.orderBy(F.col(value).asc())))  # first, as what needs no order follows in this
    d = d.withColumns({"_i": F.col("_i") - 1 - F.count(F.lit(1)).over(part) + F.count(value).over(part), "_n": F.count(value).over(part) - 1})
    ends, out = {}, {}
    for name, share in shares.items():
        at = F.col("_n") * F.lit(share)
        low, high = f"_{name}_below", f"_{name}_above"
        ends |= {low: F.max(F.when(F.col("_i") == F.floor(at), F.col(value))).over(part), high: F.max(F.when(F.col("_i") == F.ceil(at), F.col(value))).over(part)}
        out[name] = F.when(F.col(low) == F.col(high), F.col(low)).otherwise(F.col(low) + (F.col(high) - F.col(low)) * (at - F.floor(at)))
    return d.withColumns(ends).withColumns(out).drop("_i", "_n", *ends)


def clip(x: Column, low: Column, high: Column) -> Column:
    """Null stays null (least and greatest skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def at_least(n: int, counted: Column, value: Column, w: WindowSpec) -> Column:
    """value where the frame has n rows of counted."""
    return F.when(F.count(counted).over(w) >= n, value)


def mean_over_std(x: Column, default: float | None = 0.0) -> Column:
    """mean / sample deviation of a group; the default for under two values or no spread."""
    sd = F.stddev_samp(x)
    out = F.when((F.count(x) > 1) & (sd > 0), F.avg(x) / sd)
    return out if default is None else out.otherwise(default)


def growth(r: Column) -> Column:
    """Compounded return of a group."""
    return F.product(1 + r) - 1


def rounded(df: DataFrame, *keep: str, places: int = 6, digits: int = 9) -> DataFrame:
    """Doubles rounded for reports and comparison, from 100,000 on to so many digits; no negative zero, no NaN."""

    def short(c: Column) -> Column:
        x = finite(c)
        return F.when(F.abs(x) < 1e5, F.round(x, places) + 0.0).otherwise(F.format_string(f"%.{digits - 1}e", x).cast("double"))

    return df.select(*[F.when(is_finite(F.col(c)), short(F.col(c))).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])
