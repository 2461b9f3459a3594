"""The dense trading panel: calendar, lifecycles, adjustment, point-in-time state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def market_quotes(daily: DataFrame, factor: DataFrame, drop_suffix: str = ".BJ") -> DataFrame:
    """Quotes with their adjustment factors; symbols of the suffix are left out."""
    kept = daily.where(~F.col("ts_code").endswith(drop_suffix))
    return kept.join(factor.select("ts_code", "trade_date", F.col("adj_factor").cast("double").alias("adj_factor")), ["ts_code", "trade_date"], "left")


def calendar(quotes: DataFrame) -> DataFrame:
    """Distinct days with their place from 0; a calendar-sized table."""
    days = quotes.select("trade_date").distinct()
    return days.withColumn("_trade_index", (F.row_number().over(Window.orderBy("trade_date")) - 1).cast("long"))


def align_calendar(quotes: DataFrame, open_days: DataFrame) -> DataFrame:
    """Open days within the quotes' range, with their place; fails if quotes lie on another day."""
    span = quotes.agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    days = open_days.select("trade_date").distinct().join(F.broadcast(span), F.col("trade_date").between(F.col("first"), F.col("last"))).select("trade_date")
    if quotes.select("trade_date").distinct().join(days, "trade_date", "left_anti").limit(1).count():
        raise ValueError("quotes lie on days that aren't open")
    return calendar(days)


def lifecycle_bounds(quotes: DataFrame, master: DataFrame) -> DataFrame:
    """(ts_code, name, list_date, panel_end): a symbol that the master lacks lives from its first to its last quote; of
    others the list date stands, their first quote where it is null, and the delist date, null while listed."""
    seen = quotes.groupBy("ts_code").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    m = master.select("ts_code", "name", "list_date", F.nullif(F.col("delist_date"), F.lit("")).alias("delist_date"), F.lit(True).alias("known"))
    return seen.join(m, "ts_code", "left").select(
        "ts_code", F.coalesce("name", "ts_code").alias("name"), F.coalesce("list_date", "first").alias("list_date"),
        F.when(F.col("known").isNull(), F.col("last")).otherwise(F.col("delist_date")).alias("panel_end"),
    )


def dense_panel(quotes: DataFrame, bounds: DataFrame, days: DataFrame) -> DataFrame:
    """Each symbol on each market day of its life, with its quote if it has one, and adjusted prices.

    days is the calendar, thousands of rows however many symbols there are, and so is broadcast; the quotes then join
    on both keys.
    """
    grid = bounds.join(F.broadcast(days), (F.col("trade_date") >= F.col("list_date")) & (F.col("panel_end").isNull() | (F.col("trade_date") <= F.col("panel_end"))))
    grid = grid.select("ts_code", "name", "trade_date", "_trade_index")
    p = grid.join(quotes.withColumn("_has", F.lit(True)), ["ts_code", "trade_date"], "left")
    return adjusted(p.withColumn("_has_market_data", F.coalesce("_has", F.lit(False))).drop("_has"))


def adjusted(p: DataFrame) -> DataFrame:
    """Prices times the factor, volume by the factor, and the volume-weighted price (the close without volume)."""
    f = F.col("adj_factor")
    cols = {f"_{c}": F.col(c) * f for c in ("open", "high", "low", "close")}
    cols["_volume"] = F.try_divide(F.col("vol"), f)
    cols["_vwap"] = F.when(F.col("vol") > 0, F.col("amount") * 10 / F.col("vol") * f).otherwise(F.col("close") * f)
    return p.withColumns(cols)


def asof(left: DataFrame, right: DataFrame, value: str, left_order: str, right_order: str, key: str | None = None, strict: bool = False, tie: str | None = None) -> DataFrame:
    """left with the right's last value on or before (strict: before) each row's date, by key; null where there is none.

    Both sides are ordered in one window. Of right rows of one date the last by tie counts; a null value is skipped. Without
    a key only dates meet, each once with the last value of its right rows, and left takes them by an equi join.
    """
    if key is None and left.columns != [left_order]:
        last = right.where(F.col(value).isNotNull()).groupBy(F.col(right_order).alias("_o")).agg(F.max_by(value, tie or value).alias(value))
        days = asof(left.select(left_order).distinct(), last, value, left_order, "_o", strict=strict).withColumnRenamed(left_order, "_day")
        return left.join(days, left[left_order].eqNullSafe(days["_day"]), "left").select(*[left[c] for c in left.columns], value)
    # columns of their own, not a struct of them, so that only those wanted later are dealt and sorted
    cols = {f"_l{i}": c for i, c in enumerate(left.columns)}
    none = F.lit(None)
    mine = left.select(*[left[c].alias(n) for n, c in cols.items()], F.lit(True).alias("_mine"), *([F.col(key).alias("_k")] if key else []), F.col(left_order).alias("_o"), F.lit(0 if strict else 1).alias("_s"), none.cast(right.schema[value].dataType).alias("_v"), none.cast("string").alias("_t"))
    other = right.select(*[none.cast(left.schema[c].dataType).alias(n) for n, c in cols.items()], F.lit(False).alias("_mine"), *([F.col(key).alias("_k")] if key else []), F.col(right_order).alias("_o"), F.lit(1 if strict else 0).alias("_s"), F.col(value).alias("_v"), (F.col(tie).cast("string") if tie else none.cast("string")).alias("_t"))
    w = (Window.partitionBy("_k") if key else Window.partitionBy(F.lit(0))).orderBy("_o", "_s", "_t").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(other).withColumn("_found", F.last("_v", ignorenulls=True).over(w))
    # the key under its own name, by which later windows see how the rows were dealt
    return both.where("_mine").select(*[F.col("_k" if c == key else n).alias(c) for n, c in cols.items()], F.col("_found").alias(value))


def historical_names(panel: DataFrame, names: DataFrame) -> DataFrame:
    """The name known strictly before each day (from the later of its start and announcement), else the current one."""
    known = names.select("ts_code", F.col("name").alias("known_name"), F.greatest("start_date", "ann_date").alias("_known"), "start_date")
    last = known.withColumn("_n", F.row_number().over(Window.partitionBy("ts_code", "_known").orderBy(F.desc("start_date"), F.desc("known_name")))).where("_n = 1").drop("_n")
    return asof(panel, last, "known_name", "trade_date", "_known", "ts_code", strict=True).withColumn("name", F.coalesce("known_name", "name")).drop("known_name")


def index_weights(panel: DataFrame, weights: DataFrame, column: str = "index_weight", calendar: DataFrame | None = None) -> DataFrame:
    """Each row's weight in the latest snapshot on or before its day: null before any snapshot, 0 for others than members.

    Snapshots and days are few; rows meet their weight by an equi join. A calendar of the panel's days saves reading it for them.
    """
    snaps = weights.select(F.col("trade_date").alias("snapshot")).distinct()
    days = asof((panel if calendar is None else calendar).select("trade_date").distinct(), snaps.withColumn("snap", F.col("snapshot")), "snap", "trade_date", "snapshot")
    w = weights.select(F.col("trade_date").alias("snap"), F.col("con_code").alias("ts_code"), F.col("weight").cast("double").alias("_w"))
    joined = panel.join(F.broadcast(days), "trade_date").join(w, ["snap", "ts_code"], "left")
    return joined.withColumn(column, F.when(F.col("snap").isNotNull(), F.coalesce(F.col("_w") / 100, F.lit(0.0)))).drop("snap", "_w")


def last_open_days(days: DataFrame, n: int, before: Column | None = None) -> DataFrame:
    """The last n days, of those before a day if given."""
    d = days if before is None else days.where(F.col("trade_date") < before)
    return d.orderBy(F.desc("trade_date")).limit(n)


def finalize(frame: DataFrame, public: dict[str, str], state: list[str], more: list[str] = [], start: str | None = None, end: str | None = None) -> DataFrame:  # noqa: B006
    """The published table: rows with a quote from start to end (both included, each optional), its columns in this order:
    trade_date, ts_code, state, the features under their public names, more. Other columns go. Rows are told apart by their
    keys, so the writer sorts them (files.write_ordered); no row in the range is an error, found by a read of one row."""
    d = frame.where("_has_market_data")
    if start is not None:
        d = d.where(F.col("trade_date") >= start)
    if end is not None:
        d = d.where(F.col("trade_date") <= end)
    out = d.select("trade_date", "ts_code", *state, *[F.col(raw).alias(name) for raw, name in public.items()], *more)
    if out.isEmpty():
        raise ValueError("no row with a quote in the range of dates")
    return out
