"""Key, market and signal validation: counts of violations, as rows or as an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import valid_date, valid_time
from ..functions.stats import is_finite

KEYS = ("trade_date", "trade_time", "ts_code")


def normalize_keys(df: DataFrame) -> DataFrame:
    """Keys as text."""
    return df.withColumns({k: F.col(k).cast("string") for k in KEYS if k in df.columns})


def _report(df: DataFrame, rules: dict[str, Column], **extra: Column) -> DataFrame:
    """One row per rule (rule, violations), in one pass; a rule that is null counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()], *[c.alias(n) for n, c in extra.items()])
    names = [*rules, *extra]
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in names])).alias("r")).select("r.*")


def key_violations(df: DataFrame, keys: tuple[str, ...] = ("trade_date", "ts_code")) -> DataFrame:
    """Nulls, repeated keys, unreal days and times. Repeated: rows beyond the first of each key."""
    missing = set(keys) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rules = {"null_key": known}
    if "trade_date" in keys:
        rules["bad_date"] = valid_date(F.col("trade_date"))
    if "trade_time" in keys:
        rules["bad_time"] = valid_time(F.col("trade_time"))
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return _report(df, rules).unionByName(once.select(F.lit("repeated_key").alias("rule"), F.col("violations").cast("long").alias("violations")))


def market_violations(df: DataFrame) -> DataFrame:
    """Prices and factor are to be finite and positive, volume and amount finite and not negative, keys single."""
    rules = {f"bad_{c}": is_finite(F.col(c)) & (F.col(c) > 0) for c in ("open", "high", "low", "close", "adj_factor") if c in df.columns}
    rules |= {f"bad_{c}": is_finite(F.col(c)) & (F.col(c) >= 0) for c in ("vol", "amount") if c in df.columns}
    return _report(df, rules).unionByName(key_violations(df).where("rule = 'repeated_key'"))


def signal_violations(signals: DataFrame) -> DataFrame:
    """Finite scores, flags that aren't null, one trade time, ranks that agree with the flag and run from 1 each day."""
    day = Window.partitionBy("trade_date")
    # days first, as ranks of a day then need no further exchange; times differ where the least and the greatest do
    s = signals.withColumn("_once", F.min("trade_time").over(day).eqNullSafe(F.max("trade_time").over(day)))
    s = s.withColumn("_row", F.when(F.col("target_rank").isNotNull(), F.row_number().over(Window.partitionBy("trade_date", F.col("target_rank").isNotNull()).orderBy("target_rank", "ts_code"))))
    candidate = F.col("is_model_candidate") & F.col("is_buyable_at_signal")
    return _report(s, {
        "score_not_finite": is_finite(F.col("pred")), "flag_null": F.col("is_model_candidate").isNotNull() & F.col("is_buyable_at_signal").isNotNull(),
        "several_times": F.col("_once"), "rank_without_candidate": F.col("target_rank").isNull() | candidate,
        "rank_gap": F.col("target_rank").isNull() | (F.col("target_rank") == F.col("_row")),
    })


def assert_clean(report: DataFrame) -> None:
    """Raises if any rule of a report has violations."""
    if bad := [(r["rule"], r["violations"]) for r in report.where("violations > 0").collect()]:
        raise ValueError(f"violations: {bad}")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join that fails if a side that is to be single (1) repeats a key."""
    sides = validate.split(":")
    for side, df in zip(sides, (left, right), strict=True):
        if side == "1" and repeated_keys(df.select(*on), *on).limit(1).count():
            raise ValueError(f"{validate} join: keys {on} repeat")
    return left.join(right, on, how)


def missing_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def same_keys(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    """Whether both have the same set of keys."""
    return not missing_keys(left, right, on).limit(1).count() and not missing_keys(right, left, on).limit(1).count()
