"""Panel operators on small tables: semantics, edges, and that the future never moves the past."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import dates, identity
from panelspark.operators import analysis, checks, context, features, labels, panel, status

DAYS = [(date(2024, 1, 1) + timedelta(days=i)).strftime("%Y%m%d") for i in range(80)]


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(4):
        price = 10.0 + s
        for i, d in enumerate(DAYS):
            if (s, i) in {(1, 5), (1, 40), (2, 79)} or (s == 3 and i < 30):
                continue
            price *= float(np.exp(rng.normal(0, 0.02)))
            flat = s == 0 and 60 <= i < 70
            close = 9.0 if flat else round(price, 4)
            rows.append((f"{600000 + s}", d, close * 0.99, close * 1.01, close * 0.98, close, 0.0 if i == 20 else 100.0 + 7 * (i % 5), close * 10))
    return spark.createDataFrame(rows, "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double").persist()


@pytest.fixture(scope="module")
def dense(spark, bars):
    days = panel.calendar(bars)
    factor = bars.select("ts_code", "trade_date", F.lit(1.0).alias("adj_factor"))
    quotes = panel.market_quotes(bars, factor)
    master = spark.createDataFrame([("600000", "A", "20240101", None), ("600001", "ST B", "20240101", ""), ("600003", "C退", "20240101", "20240310")], "ts_code string, name string, list_date string, delist_date string")
    return panel.dense_panel(quotes, panel.lifecycle_bounds(quotes, master), days).persist()


def test_panel_lives(dense):
    n = {r["ts_code"]: r["count"] for r in dense.groupBy("ts_code").count().collect()}
    assert n["600000"] == n["600001"] == 80 and n["600002"] == 79  # unknown symbols end at their last quote
    assert n["600003"] == sum(d <= "20240310" for d in DAYS)
    assert dense.where("ts_code = '600001' and not _has_market_data").count() == 2


def test_features_match_numpy(dense):
    out = features.rolling(features.lag_inputs(dense), widths=(5, 20)).orderBy("_trade_index").where("ts_code = '600000'").toPandas()
    close, x = out["_close"].to_numpy(), out["_trade_index"].to_numpy(float)
    for i in (0, 7, 30, 65, 79):
        for n in (5, 20):
            c, t = close[max(0, i - n + 1) : i + 1], x[max(0, i - n + 1) : i + 1]
            assert out[f"ma{n}"][i] == pytest.approx(c.mean() / close[i])
            assert out[f"qtlu{n}"][i] == pytest.approx(np.quantile(c, 0.8) / close[i])
            assert out[f"rank{n}"][i] == pytest.approx(((c < c[-1]).sum() + ((c == c[-1]).sum() + 1) / 2) / len(c))
            high = out["_high"].to_numpy()[max(0, i - n + 1) : i + 1]
            assert out[f"imax{n}"][i] == pytest.approx((int(high.argmax()) + 1) / n)  # the oldest of equals
            if len(c) > 1:
                slope = np.polyfit(t, c, 1)[0]
                assert out[f"beta{n}"][i] == pytest.approx(slope / close[i], abs=1e-9)
                assert out[f"resi{n}"][i] == pytest.approx((c[-1] - np.polyval(np.polyfit(t, c, 1), t[-1])) / close[i], abs=1e-9)
    assert np.isnan(out["rsqr5"][68]) and np.isnan(out["corr5"][68])  # a flat series has no correlation


def test_the_future_does_not_move_the_past(dense):
    cut = DAYS[60]
    cols = ["ts_code", "trade_date", *[f"{c}10" for c in ("roc", "beta", "rank", "imax", "cord", "sumd", "wvma")]]
    make = lambda p: features.rolling(features.lag_inputs(p), widths=(10,)).where(F.col("trade_date") <= cut).select(*cols)
    changed = dense.withColumns({c: F.when(F.col("trade_date") > cut, F.col(c) * 3).otherwise(F.col(c)) for c in ("_close", "_high", "_low", "_volume")})
    assert make(dense).exceptAll(make(changed)).count() == 0
    full, late = context.context(dense), context.context(changed)
    keep = ["ts_code", "trade_date", "beta", "momentum5", "downside"]
    assert full.where(F.col("trade_date") <= cut).select(*keep).exceptAll(late.where(F.col("trade_date") <= cut).select(*keep)).count() == 0


def test_asof_strict_and_inclusive(spark):
    left = spark.createDataFrame([("a", "20240103"), ("a", "20240101"), ("b", "20240105")], "ts_code string, trade_date string")
    right = spark.createDataFrame([("a", "20240101", "one"), ("a", "20240103", "two")], "ts_code string, d string, v string")
    get = lambda strict: {(r["ts_code"], r["trade_date"]): r["v"] for r in panel.asof(left, right, "v", "trade_date", "d", "ts_code", strict).collect()}
    assert get(True) == {("a", "20240103"): "one", ("a", "20240101"): None, ("b", "20240105"): None}
    assert get(False) == {("a", "20240103"): "two", ("a", "20240101"): "one", ("b", "20240105"): None}
    assert panel.asof(left, right.limit(0), "v", "trade_date", "d", "ts_code").where("v is not null").count() == 0


def test_flags_and_limits(dense):
    p = dense.withColumns({"pre_close": F.lit(2.345 / 1.1), "up_limit": F.lit(None).cast("double"), "down_limit": F.lit(float("nan"))})
    f = status.market_flags(status.price_limits(p)).persist()
    assert f.where("ts_code = '600000'").select("up_limit_").first()[0] == 2.35
    assert f.where("ts_code = '600001' and not is_st").count() == 0 and f.where("ts_code = '600003' and not is_delisting").count() == 0
    assert f.where("ts_code = '600000' and not history_short").agg(F.min("trade_date")).first()[0] == DAYS[59]


def test_labels(spark):
    days = spark.createDataFrame([("20240101",), ("20240102",), ("20240103",)], "trade_date string")
    m = spark.createDataFrame([("20240101", "a", 10.0, 1.0, "quoted"), ("20240102", "a", 11.0, 1.0, "quoted"), ("20240103", "a", None, 1.0, "suspended"), ("20240101", "b", 5.0, 1.0, "missing_data"), ("20240102", "b", 5.0, 1.0, "quoted")], "trade_date string, ts_code string, price double, adjustment_factor double, market_status string")
    s = m.where("price is not null").select("trade_date", "ts_code", F.col("price").alias("signal_price"), F.lit(1.0).alias("signal_adjustment_factor"))
    got = {(r.trade_date, r.ts_code): (r.label_status, r.label_return) for r in labels.next_day_labels(s, m, days).collect()}
    assert got[("20240101", "a")] == ("valid", pytest.approx(0.1))
    assert got[("20240102", "a")][0] == "suspended" and got[("20240101", "b")][0] == "missing_data" and got[("20240102", "b")][0] == "missing_data"


def test_label_transforms_ties_and_single(spark):
    d = spark.createDataFrame([("d1", "a", 1.0), ("d1", "b", 1.0), ("d1", "c", 2.0), ("d2", "a", 5.0)], "trade_date string, ts_code string, label_return double")
    got = {(r.trade_date, r.ts_code): (r.label_return_rank, r.label_return_csz) for r in labels.label_transforms(d, tail=0.0).collect()}
    assert got[("d1", "a")][0] == got[("d1", "b")][0] == 0.25 and got[("d1", "c")][0] == 1.0
    assert got[("d2", "a")] == (0.5, 0.0)


def test_checks(spark):
    d = spark.createDataFrame([("20240230", "a"), ("20240101", "a"), ("20240101", "a"), (None, "b"), ("20240102", None)], "trade_date string, ts_code string")
    got = {r.rule: r.violations for r in checks.key_violations(d).collect()}
    assert got == {"null_key": 2, "bad_date": 2, "repeated_key": 1}
    with pytest.raises(ValueError, match="repeated_key"):
        checks.assert_clean(checks.key_violations(d))
    with pytest.raises(ValueError, match="repeat"):
        checks.join_checked(d, d, ["trade_date", "ts_code"])


def test_matrix_and_profile(spark):
    d = spark.createDataFrame([("x", 1.0, True), ("1.5", float("inf"), False), ("NaN", float("nan"), True), (None, None, None)], "first string, second double, flag boolean")
    m = analysis.feature_matrix(d, ["second", "first", "flag"])
    assert m.columns == ["second", "first", "flag"] and [tuple(r) for r in m.collect()] == [(1.0, None, 1.0), (None, 1.5, 0.0), (None, None, 1.0), (None, None, None)]
    p = analysis.column_profile(d, ["second"]).first()
    assert (p["total"], p["non_null"], p["nan"], p["inf"], p["finite"], p["mean"]) == (4, 3, 1, 1, 1, 1.0)


def test_buckets_follow_average_rank(spark):
    rows = [("d", f"{i}", v, float(i)) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "trade_date string, ts_code string, f double, y double")
    b = analysis.quantile_returns(analysis.factor_pairs(d, ["f"], "y"), 3, 2)
    assert sorted((r["quantile"], r["samples"]) for r in b.collect()) == [(1, 4), (3, 2)]


def test_dates(spark):
    w = dates.month_windows(spark, "20240131", "20240430", 1)
    assert [(r["start"], r["end"]) for r in w.orderBy("window").collect()] == [("20240131", "20240229"), ("20240229", "20240331"), ("20240331", "20240430")]
    assert dates.month_windows(spark, "20240131", "20240430", 0).count() == 1
    t = spark.createDataFrame([("0930",), ("2460",), ("2400",), (None,)], "t string")
    assert [r[0] for r in t.select(dates.valid_time(F.col("t"))).collect()] == [True, False, False, False]
    one = spark.range(1).select(identity.fingerprint(b=F.lit(1), a=F.lit("x")).alias("f")).first()[0]
    assert one == spark.range(1).select(identity.fingerprint(a=F.lit("x"), b=F.lit(1)).alias("f")).first()[0]


def test_lineitem_is_read_once(spark):
    """What follows from bars reads them as they were written, not the items again for each use; an as-of join deals only wanted columns."""
    from panelspark.plans.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for d in (t.panel, t.market, t.labels):
        assert "l_suppkey" not in plan(d)
    last = t.quotes.select("ts_code", "trade_date", F.col("close").alias("c"))
    assert " AS _l" not in plan(panel.asof(t.quotes, last, "c", "trade_date", "trade_date", "ts_code").select("ts_code", "c"))
