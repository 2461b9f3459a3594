"""Market context: moments of winsorised returns, prior beta and risk features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import at_least, clip, finite, is_finite, symbol_window, with_quantiles

HORIZONS = (1, 3, 5, 10)
TAIL, BETA_ROWS, BETA_MIN, RISK_ROWS, RISK_MIN = 0.02, 60, 30, 20, 16


def _quoted() -> Column:
    return F.col("_has_market_data") & F.coalesce(is_finite(F.col("_close")) & (F.col("_close") > 0), F.lit(False))


def horizon_returns(panel: DataFrame, horizons: tuple[int, ...] = (*HORIZONS, 20)) -> DataFrame:
    """Adds r1, r3...: the close over that of so many market days before, less 1, where both days have a valid quote."""
    w = symbol_window()
    p = panel.withColumn("_ok", _quoted())
    ret = lambda h: F.when(F.col("_ok") & F.lag("_ok", h).over(w), F.try_divide(F.col("_close"), F.lag("_close", h).over(w)) - 1)
    return p.withColumns({f"r{h}": finite(ret(h)) for h in horizons})


def market_moments(returns: DataFrame, horizons: tuple[int, ...] = HORIZONS, tail: float = TAIL) -> DataFrame:
    """(trade_date, n1, mean1, var1, n3, ...): of each day's returns, clipped to their own linear tail quantiles."""
    c = returns.where("trade_date is not null").select("trade_date", *[f"r{h}" for h in horizons])
    for h in horizons:
        c = with_quantiles(c, f"r{h}", {f"low{h}": tail, f"high{h}": 1 - tail}, "trade_date")
    x = {h: clip(F.col(f"r{h}"), F.col(f"low{h}"), F.col(f"high{h}")) for h in horizons}
    return c.groupBy("trade_date").agg(*[f.alias(f"{n}{h}") for h in horizons for n, f in (("n", F.count(x[h])), ("mean", F.avg(x[h])), ("var", F.var_samp(x[h])))])


def market_cumulative(daily: DataFrame, spans: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Adds cum5, ...: the compounded mean return of the last days, all of them known. A row a day."""
    out = {}
    for n in spans:
        w = Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)  # calendar-sized
        out[f"cum{n}"] = F.when(F.count("mean1").over(w) == n, F.exp(F.sum(F.log1p("mean1")).over(w)) - 1)
    return daily.withColumns(out)


def stock_features(returns: DataFrame, daily: DataFrame) -> DataFrame:
    """Adds beta (of the 60 days before, at least 30 paired, within [-3, 3]), market-neutral momentum over 5, 10 and 20 days,
    residual volatility and downside risk over 20 (at least 16); null where the row has no valid quote."""
    d = market_cumulative(daily).select("trade_date", F.col("mean1").alias("_m"), "cum5", "cum10", "cum20")
    p = returns.join(F.broadcast(d), "trade_date", "left")
    both = F.col("r1").isNotNull() & F.col("_m").isNotNull()
    p = p.withColumns({"_x": F.when(both, F.col("_m")), "_y": F.when(both, F.col("r1"))})
    before = symbol_window().rowsBetween(-BETA_ROWS, -1)
    x, y = F.col("_x"), F.col("_y")
    # x and y are known together, so four sums share one count: an average would count again for each row of each frame
    p = p.withColumns({"_k": F.count(x).over(before)} | {n: F.sum(c).over(before) for n, c in (("_sx", x), ("_sy", y), ("_sxx", x * x), ("_sxy", x * y))})
    mean = lambda c: F.try_divide(c, F.col("_k").cast("double"))
    var = mean(F.col("_sxx")) - mean(F.col("_sx")) * mean(F.col("_sx"))
    cov = mean(F.col("_sxy")) - mean(F.col("_sx")) * mean(F.col("_sy"))
    beta = F.when((F.col("_k") >= BETA_MIN) & (var > 1e-12), cov / var)
    p = p.withColumn("beta", clip(beta, F.lit(-3.0), F.lit(3.0)))
    p = p.withColumn("_res", F.col("r1") - F.col("beta") * F.col("_m"))
    w = symbol_window(RISK_ROWS)
    out = {f"momentum{h}": F.col(f"r{h}") - F.col("beta") * F.col(f"cum{h}") for h in (5, 10, 20)}
    out["residual_vol"] = at_least(RISK_MIN, F.col("_res"), F.stddev_samp("_res").over(w), w)
    out["downside"] = at_least(RISK_MIN, F.col("r1"), F.sqrt(F.avg(F.when(F.col("r1").isNotNull(), F.pow(F.least("r1", F.lit(0.0)), 2))).over(w)), w)
    p = p.withColumns(out)
    return p.withColumns({c: F.when(F.col("_ok"), finite(F.col(c))) for c in ("beta", *out)}).drop("_x", "_y", "_res", "_k", "_sx", "_sy", "_sxx", "_sxy")


def context(panel: DataFrame) -> DataFrame:
    """All context features of a panel: the day's moments on each row, and the stock's own."""
    return of_returns(horizon_returns(panel))


def of_returns(r: DataFrame) -> DataFrame:
    """context, of horizon_returns."""
    daily = market_moments(r)
    return stock_features(r, daily).join(F.broadcast(daily), "trade_date", "left")
