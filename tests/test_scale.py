"""Operators whose work must not grow with depth or with one column's values: long chains, cycles, many equal values."""

import random

import numpy as np
import pytest
import math

from pyspark.sql import functions as F

from panelspark.operators import analysis, features, lineage
from panelspark.sources import files


def _runs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, upstream_ids array<long>, state string, created_at long")


def test_component_of_a_shuffled_chain(spark):
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    rows = [(ids[k], [ids[k - 1]] if k else [], "succeeded", k) for k in range(len(ids))] + [(9000, [], "failed", 1), (9001, [9002], "failed", 1)]
    runs = _runs(spark, rows)
    e = lineage.edges(runs)
    labels = lineage.components(e, runs)
    got = {r.run_id: r.component for r in labels.collect()}
    assert got == {i: 0 for i in ids} | {9000: 9000, 9001: 9001, 9002: 9001}
    roots = {r.component: r.root for r in lineage.component_roots(labels, runs, e).collect()}
    assert roots == {0: ids[0], 9000: 9000, 9001: None}  # 9002 is missing, so its component has no run without upstream


def test_component_edges(spark):
    runs = _runs(spark, [(1, [2], "s", 1), (2, [1], "s", 2), (3, None, "s", 3), (4, [4], "s", 4), (5, [3, 3, None], "s", 5)])
    e = lineage.edges(runs)
    labels = lineage.components(e, runs)
    assert {r.run_id: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}
    assert {r.component: r.root for r in lineage.component_roots(labels, runs, e).collect()} == {1: None, 3: 3, 4: 4}
    assert lineage.components(e.limit(0), runs.limit(0)).count() == 0


def test_upstream_of_a_long_chain_and_of_cycles(spark):
    n = 1500
    chain = _runs(spark, [(k, [k - 1] if k else [], "succeeded", k) for k in range(n)])
    up = lineage.all_upstream(lineage.edges(chain)).groupBy("run_id").count()
    assert up.where(F.col("count") != F.col("run_id")).count() == 0 and up.count() == n - 1
    ring = lineage.all_upstream(lineage.edges(_runs(spark, [(k, [(k + 1) % 7], "s", k) for k in range(7)])))
    assert ring.count() == 49


def test_profile_of_repeated_and_odd_values(spark):
    rng = np.random.default_rng(1)
    a = [0.0] * 500 + [float(v) for v in rng.normal(size=301)] + [float("nan"), float("inf"), None, -0.0]
    d = spark.createDataFrame([(x, None, 7.0) for x in a], "a double, b double, c double").repartition(5)
    by = {r.factor: r for r in analysis.column_profile(d, ["a", "b", "c"]).collect()}
    ok = np.array([x for x in a if x is not None and np.isfinite(x)])
    for name, q in (("p03", 0.03), ("p50", 0.5), ("p97", 0.97)):
        assert by["a"][name] == pytest.approx(np.quantile(ok, q)) and by["b"][name] is None and by["c"][name] == 7.0
    assert (by["a"].distinct, by["b"].distinct, by["c"].distinct, by["a"].zero, by["a"].total) == (len(np.unique(ok)), 0, 1, 501, len(a))
    assert analysis.column_profile(d.limit(0), ["a"]).count() == 0
    plan = analysis.column_profile(d, ["a", "c"])._jdf.queryExecution().toString()
    assert "percentile" not in plan


def _window(v, n):
    return [v[max(0, k - n + 1) : k + 1] for k in range(len(v))]


def test_frames_against_numpy(spark):
    """Moments and sums of frames that cross blocks, with missing values, jumps and flat stretches."""
    rng = np.random.default_rng(6)
    rows, by = [], {}
    for code in ("a", "b", "c"):
        x = rng.normal(100, 5, 83) + (np.arange(83) > 40) * 1e3
        y = x * 2 + rng.normal(0, 1, 83)
        x[50:60] = 1_100.25  # flat
        gone = rng.random(83) < (0.9 if code == "c" else 0.2)
        by[code] = np.where(gone, np.nan, x), y
        rows += [(code, k, None if gone[k] else float(x[k]), float(y[k])) for k in range(83)]
    d = spark.createDataFrame(rows, "ts_code string, _trade_index int, x double, y double").repartition(3)
    widths = (2, 5, 12)
    got = features.framed(d, {"one": (F.col("x"),), "two": (F.col("x"), F.col("y"))}, {"all": F.floor("y").cast("long")}, widths).orderBy("ts_code", "_trade_index").toPandas()
    for code, (x, y) in by.items():
        mine = got[got.ts_code == code].reset_index()
        for n in widths:
            for k, (u, v) in enumerate(zip(_window(x, n), _window(y, n), strict=True)):
                ok = ~np.isnan(u)
                assert mine[f"_one_n{n}"][k] == ok.sum() and mine[f"_all{n}"][k] == np.floor(v).sum()
                if not ok.any():
                    assert np.isnan(mine[f"_one_mx{n}"][k]) and np.isnan(mine[f"_two_xy{n}"][k])
                    continue
                u, v = u[ok], v[ok]
                assert mine[f"_one_mx{n}"][k] == pytest.approx(u.mean(), rel=1e-12)
                for name, want in (("_one_xx", ((u - u.mean()) ** 2).sum()), ("_two_yy", ((v - v.mean()) ** 2).sum()), ("_two_xy", ((u - u.mean()) * (v - v.mean())).sum())):
                    assert mine[f"{name}{n}"][k] == pytest.approx(want, rel=1e-9, abs=1e-7)
                if np.ptp(u) == 0:
                    assert mine[f"_one_xx{n}"][k] == 0
    assert features.framed(d.limit(0), {"one": (F.col("x"),)}, {}, (5,)).count() == 0


def test_files_of_differing_types_are_cast(spark, tmp_path):
    for day, schema, rows in (("1", "code string, x int", [("a", 1)]), ("2", "code string, x double, extra int", [("b", 2.5, 1)]), ("3", "code string", [("c",)]), ("4", "x string, code string", [("7", "d"), ("many", "e")])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/t/day={day}")
    got = files.scan(spark, f"{tmp_path}/t", "day int, code string, x double, gone date")
    assert sorted((r.day, r.code, r.x, r.gone) for r in got.collect()) == [(1, "a", 1.0, None), (2, "b", 2.5, None), (3, "c", None, None), (4, "d", 7.0, None), (4, "e", None, None)]
    assert [r.code for r in files.scan(spark, f"{tmp_path}/t", "code string, x int", since="4").orderBy("code").collect()] == ["d", "e"]
    (tmp_path / "none").mkdir()
    assert files.scan(spark, f"{tmp_path}/none", "x int").count() == 0


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    files.write_parquet(spark.range(5), path)
    with pytest.raises(Exception, match="no good"):
        files.write_parquet(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("no good")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["table"]
    files.write_parquet(spark.read.parquet(path).where("id > 2"), path)  # of itself
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_ordered_files(spark, tmp_path):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(6)
    path = f"{tmp_path}/sorted"
    files.write_ordered(d, path, "k", ranges=5)
    assert files.order_faults(spark, path, "k").count() == 0
    rows = [r.k for f in sorted((tmp_path / "sorted").glob("part*")) for r in spark.read.parquet(str(f)).collect()]
    assert rows == list(range(1000)) and len(list((tmp_path / "sorted").glob("part*"))) > 1
    d.write.parquet(f"{tmp_path}/mixed")
    assert files.order_faults(spark, f"{tmp_path}/mixed", "k").count() > 0


def test_frames_lose_no_digits_to_rows_outside(spark):
    """Two values that hardly differ, alone in their frame, after values far from them: their correlation is whole."""
    rows = [("A", i, 40.0 * (i % 3), 9.0 - i % 7) for i in range(30)] + [("A", 30 + i, None, None) for i in range(6)] + [("A", 36, 1.0, 2.0), ("A", 37, 1.0001, 1.5)]
    d = spark.createDataFrame(rows, "ts_code string, _trade_index long, x double, y double")
    r = features.framed(d, {"two": (F.col("x"), F.col("y"))}, {}, (5, 60)).where("_trade_index = 37").first()
    assert abs(r["_two_xy5"] / math.sqrt(r["_two_xx5"] * r["_two_yy5"]) + 1) < 1e-9


def test_tables_by_symbol_are_joined_without_a_shuffle(spark):
    """What can be traded, its market, labels and returns follow from bars as they are dealt; ranks of a day are one exchange."""
    from panelspark.operators import context, labels
    from panelspark.plans import queries
    from panelspark.plans.tables import TRADED, Tables

    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        deals = lambda d: plan(d).count("Exchange hashpartitioning(")
        symbol = "Exchange hashpartitioning(ts_code"
        assert symbol not in plan(t.flagged.select(*TRADED)) and symbol not in plan(t.market_of(t.traded)) and symbol not in plan(context.horizon_returns(t.panel))
        assert symbol not in plan(t.labels) and deals(t.ranked) == 1
        rows = spark.createDataFrame([("20240101", "A", 1.0, 0.5)], "trade_date string, ts_code string, pred double, label_return double")
        assert deals(labels.label_transforms(labels.tail_trim(rows, "label_return", 0.1))) == 1 and deals(context.market_moments(t.returns)) == 1
        assert symbol not in plan(queries._pairs(t)) and plan(queries._pairs(t)).count("Exchange hashpartitioning(factor") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_quantiles_within_days_against_numpy(spark):
    from panelspark.functions.stats import with_quantiles

    rng = np.random.default_rng(3)
    days = {"a": rng.normal(size=101), "b": np.repeat([1.0, 2.0], 30), "c": np.array([5.0]), "d": np.array([]), "e": np.array([float("inf"), 1.0, 2.0])}
    rows = [(k, float(x)) for k, v in days.items() for x in v] + [("a", None), ("d", None)]
    d = with_quantiles(spark.createDataFrame(rows, "day string, x double").repartition(3), "x", {"low": 0.025, "mid": 0.5, "top": 1.0}, "day")
    got = {r.day: r for r in d.collect()}
    assert d.count() == len(rows) and got["d"].low is None and got["e"].mid == 2.0 and got["e"].top == float("inf")
    for k in "abc":
        assert [got[k].low, got[k].mid, got[k].top] == pytest.approx(list(np.quantile(days[k], [0.025, 0.5, 1.0])), rel=1e-12)
    assert "percentile" not in d._jdf.queryExecution().toString()


def test_average_ranks_and_targets_in_one_order(spark):
    from panelspark.functions.stats import avg_rank
    from panelspark.operators import signals

    d = spark.createDataFrame([("d", x) for x in (3.0, 1.0, 3.0, None, 0.0, -0.0, float("nan"))], "day string, x double")
    assert sorted((str(r.x), r.k) for r in d.select("x", avg_rank("x", "day").alias("k")).collect()) == [("-0.0", 2.5), ("0.0", 2.5), ("1.0", 4.0), ("3.0", 5.5), ("3.0", 5.5), ("None", 1.0), ("nan", 7.0)]
    s = spark.createDataFrame([("d", "t", c, p, m, b) for c, p, m, b in (("A", 1.0, True, True), ("B", 2.0, True, True), ("C", 3.0, False, True), ("D", 3.0, None, True), ("E", 2.0, True, None), ("F", 2.0, True, True))], "trade_date string, trade_time string, ts_code string, pred double, is_model_candidate boolean, is_buyable_at_signal boolean")
    ranks = lambda d: {r.ts_code: r.target_rank for r in d.collect() if r.target_rank}
    assert ranks(signals.target_ranks(s)) == {"B": 1, "F": 2, "A": 3}
    assert ranks(signals.target_ranks(s, s.where("ts_code <> 'B'").union(s.where("ts_code = 'A'")))) == {"F": 1, "A": 2}
    assert signals.target_ranks(signals.rank_signals(s))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1


def test_statistics_of_predictions_hold_no_column_in_a_task(spark):
    from panelspark.operators import signals

    p = spark.createDataFrame([("d1", "A", 3.0, True), ("d1", "B", None, False), ("d2", "A", 1.0, True), ("d2", "C", 2.5, None), ("d2", "D", 9.0, True)], "trade_date string, ts_code string, pred double, is_buyable_at_signal boolean").withColumn("is_model_candidate", F.lit(True))
    d = signals.prediction_statistics(p)
    assert tuple(d.first()) == (2, 4, 1.0, 15.5 / 4, 2.75, 9.0, 3, 5) and "median" not in d._jdf.queryExecution().analyzed().toString().replace("pred_median", "")
    assert tuple(signals.prediction_statistics(p.limit(0)).first()) == (0, 0, None, None, None, None, 0, 0)


def test_boosting_keeps_no_copies_of_its_vectors(spark):
    """One table of predictions at a time, none after, and nothing cached."""
    import glob

    from pyspark.ml.feature import VectorAssembler

    from panelspark.functions.storage import shared_folder
    from panelspark.operators import ml

    d = spark.range(400).selectExpr("cast(id % 37 as double) as a", "cast(id % 37 % 5 as double) + id / 4000 as label", "id % 10 = 0 as valid")
    v = VectorAssembler(inputCols=["a"], outputCol="vector").transform(d).select("vector", "label", "valid")
    tables = lambda: set(glob.glob(shared_folder(spark).removeprefix("file:") + "/panelspark/boosted-*"))
    before, cached = tables(), len(spark.sparkContext._jsc.getPersistentRDDs())
    trees, curve = ml.boost(v, 2 * ml.CUT + 1, 0.3, 2, None, 7)
    assert len(trees) == 2 * ml.CUT + 1 and curve[-1][1] < curve[0][1]
    assert tables() == before and len(spark.sparkContext._jsc.getPersistentRDDs()) == cached


def _signals(spark):
    rows = [(day, "1500", f"{c:03d}", None if c == 7 else float(c * 37 % 11), c % 5 != 0, None if c == 9 else True) for day in ("20240101", "20240102", "20240103") for c in range(1, 40)]
    return spark.createDataFrame(rows, "trade_date string, trade_time string, ts_code string, pred double, is_model_candidate boolean, is_buyable_at_signal boolean").repartition(4)


def test_best_of_a_day_is_cut_before_it_is_dealt(spark):
    from panelspark.operators import signals

    s = _signals(spark)
    best = signals.best(s, 5)
    assert best._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # of each task, then of a day
    assert sorted(best.collect()) == sorted(signals.target_ranks(s).where("target_rank <= 5").select(best.columns).collect())
    assert [r.ts_code for r in signals.best(s, 0).collect()] == []


def test_accounting_reads_the_market_of_targets_alone(spark):
    from panelspark.operators import portfolio
    from panelspark.plans.tables import Tables

    market = spark.createDataFrame([(c, d, 2.0, 1.0, True, True, "quoted") for c in ("A", "B", "C") for d in ("1", "2", "3")], "ts_code string, trade_date string, price double, adjustment_factor double, can_buy boolean, can_sell boolean, market_status string")
    targets = spark.createDataFrame([("1", "A", 1), ("3", "A", 1), ("2", "D", 1)], "trade_date string, ts_code string, target_rank int")
    assert sorted((r.ts_code, r.trade_date) for r in portfolio.market_of(targets, market).collect()) == [("A", "1"), ("A", "2"), ("A", "3")]
    t = Tables(spark, "/root/testdata/sf0.001")
    whole = portfolio.cohort_results(t.ranked.where("target_rank <= 3").selectExpr("*", "1 / 3d as weight"), t.market, t.days, 1)
    from panelspark.plans.queries import _daily

    digits = lambda d: [[round(x, 9) if isinstance(x, float) else x for x in r] for r in d.orderBy("trade_date").collect()]  # noqa: E731  sums in any order
    assert digits(whole) == digits(_daily(t, 3, 1))
    plan = _daily(t, 3, 1)._jdf.queryExecution().analyzed().toString()
    assert "panelspark_market" not in plan and "panelspark_signals" not in plan


def test_labels_take_one_join_and_no_sort(spark):
    from panelspark.operators import labels
    from panelspark.plans import queries
    from panelspark.plans.tables import Tables

    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, "/root/testdata/sf0.001")
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        assert plan(queries._training(t)).count("SortMergeJoin") == 1 and "Sort [ts_code" not in plan(t.labels)
        assert plan(queries._factor_rows(t)).count("SortMergeJoin") == 2  # scores with the market, then with features
        rows = spark.createDataFrame([("20240101", "A", 1.0, 0.5)], "trade_date string, ts_code string, pred double, label_return double")
        assert plan(labels.label_transforms(rows)).count("Sort [") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    days = spark.createDataFrame([("1", 0), ("2", 1), ("3", 2)], "trade_date string, _trade_index long")
    market = spark.createDataFrame([("A", "1", 2.0, 1.0, "quoted"), ("A", "3", 4.0, 1.0, "quoted")], "ts_code string, trade_date string, price double, adjustment_factor double, market_status string")
    s = spark.createDataFrame([("1", "A", 2.0, 1.0, 7.0), ("2", "A", 2.0, 1.0, 8.0), ("3", "A", 2.0, 1.0, 9.0)], "trade_date string, ts_code string, signal_price double, signal_adjustment_factor double, pred double")
    got = {r.trade_date: (r.label_target_date, r.label_return, r.label_status, r.pred) for r in labels.next_day_labels(s, market, days, "pred").collect()}
    # the symbol's next row is of the day after next, which is no target
    assert got == {"1": ("2", None, "missing_data", 7.0), "2": ("3", None, "missing_data", 8.0), "3": (None, None, "pending", 9.0)}


def test_benchmarks_list_no_row_of_a_day(spark):
    from panelspark.operators import panel, report

    rows = [("2", f"{d}", w, r) for d, (w, r) in enumerate([(0.25, 0.1), (0.25, 0.3), (0.0, 0.5), (None, 0.7), (0.1, -0.2)])] + [("3", "9", None, 0.4)]
    d = spark.createDataFrame([(t, "1", c, w, r, True) for t, c, w, r in rows], "label_target_date string, trade_date string, ts_code string, index_weight double, label_return double, label_valid boolean")
    got = {r.trade_date: (r.universe_return, r.index_return) for r in report.weighted_returns(d, 0.5).collect()}
    assert got["2"] == pytest.approx((1.4 / 5, (0.25 * 0.4 - 0.02) / 0.6)) and got["3"] == (0.4, None)
    p = spark.createDataFrame([("A", "1"), ("A", "3"), ("B", "3")], "ts_code string, trade_date string")
    w = spark.createDataFrame([("A", "2", 40.0)], "con_code string, trade_date string, weight double")
    calendar = spark.createDataFrame([("1",), ("2",), ("3",)], "trade_date string")
    weighed = [{(r.ts_code, r.trade_date): r.index_weight for r in panel.index_weights(p, w, calendar=c).collect()} for c in (None, calendar)]
    assert weighed[0] == weighed[1] == {("A", "1"): None, ("A", "3"): 0.4, ("B", "3"): 0.0}


def test_violations_of_ranks_take_one_exchange(spark):
    from panelspark.operators import checks, signals

    s = signals.target_ranks(_signals(spark))
    d = checks.signal_violations(spark.createDataFrame(s.collect(), s.schema).withColumn("trade_time", F.when(F.col("ts_code") == "003", None).when((F.col("ts_code") == "004") & (F.col("trade_date") == "20240102"), "1400").otherwise("1500")))
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(trade_date") == 1
    assert {r.rule: r.violations for r in d.collect()}["several_times"] == 39


def test_marked_names_in_any_case(spark):
    from panelspark.operators import status

    names = ["ST1", "st1", "*St2", "s*sT3", "NST", "ſt4", "ﬆ5", "ß6", "s6", "*7", "", None, "sst"]
    d = spark.createDataFrame([(n, "A", i, True, 1.0, 2.0, 0.5) for i, n in enumerate(names)], "name string, ts_code string, _trade_index int, _has_market_data boolean, close double, up_limit_ double, down_limit_ double")
    got = {r.name for r in status.market_flags(d).where("is_st").collect()}
    want = {r.name for r in d.where(F.coalesce(F.upper("name").rlike(status.MARKED_NAME), F.lit(False))).collect()}
    assert got == want and {"ST1", "st1", "*St2", "s*sT3", "ſt4", "ﬆ5"} <= got
