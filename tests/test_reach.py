"""Sources, sinks, small operators and the model functions that no registered query reaches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import dates, identity
from panelspark.operators import analysis, checks, compare, features, lineage, ml, panel, portfolio, report, signals
from panelspark.sources import files, masters
from panelspark.streaming import runs


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("20240101", "a", 1.5), ("20240102", "b", float("nan")), ("20240103", None, None)], "trade_date string, ts_code string, x double")
    files.write_parquet(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3
    files.write_csv(df, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", "trade_date string, ts_code string, x double")
    assert sorted(r.trade_date for r in back.collect()) == ["20240101", "20240102", "20240103"]
    safe = {r.trade_date: r.x for r in files.json_safe(df).collect()}
    assert safe == {"20240101": 1.5, "20240102": None, "20240103": None}
    assert files.json_safe(df.select(F.lit("2024-02-03").cast("date").alias("d"))).first().d == "2024-02-03"


def test_pruning_by_lookback(spark, tmp_path):
    days = [f"2024010{k}" for k in range(1, 9)]
    df = spark.createDataFrame([(d, s) for d in days for s in "ab"], "trade_date string, ts_code string")
    files.land(df, f"{tmp_path}/l", ["trade_date", "ts_code"])
    start = files.lookback_start(df.select("trade_date").distinct(), "20240106", 3)
    assert start == "20240103"
    got = files.scan(spark, f"{tmp_path}/l", "trade_date string, ts_code string, extra double", since=start)
    assert got.count() == 12 and got.where("extra is not null").count() == 0
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()
    runs.reland(df.where("trade_date = '20240108'").withColumn("ts_code", F.lit("z")), f"{tmp_path}/l", "20240108", 3)
    again = files.scan(spark, f"{tmp_path}/l", "trade_date string, ts_code string")
    assert again.where("trade_date = '20240108'").select("ts_code").distinct().first()[0] == "z" and again.where("trade_date < '20240108'").count() == 14
    assert [r.trade_date for r in panel.last_open_days(df.select("trade_date").distinct(), 2, F.lit("20240105")).collect()] == ["20240104", "20240103"]


def test_index_weights_source(spark):
    raw = spark.createDataFrame([("I", "20240101", "a", 60.0), ("I", "20240101", "b", 40.0), ("J", "20240101", "a", 100.0)], "index_code string, trade_date string, con_code string, weight double")
    w, snaps = files.index_weight_source(raw, "I")
    assert {r.ts_code: r.weight for r in w.collect()} == {"a": 0.6, "b": 0.4} and snaps.count() == 1
    with pytest.raises(ValueError, match="repeats"):
        files.index_weight_source(raw.union(raw), "I")


def test_dates(spark):
    cal = dates.landing_calendar(spark, "20240130", "20240202").collect()
    assert [tuple(r) for r in cal] == [("20240130", "20240130", "20240131"), ("20240131", "20240130", "20240131"), ("20240201", "20240201", "20240202"), ("20240202", "20240201", "20240202")]
    assert spark.range(1).select(dates.trade_day(F.lit("2024-01-02"))).first()[0] == "20240102"


def test_keys(spark):
    a = spark.createDataFrame([(20240101, 1), (20240102, 2)], "trade_date int, ts_code int")
    n = checks.normalize_keys(a)
    assert n.dtypes == [("trade_date", "string"), ("ts_code", "string")]
    assert checks.same_keys(a, a.union(a), ["trade_date"]) and not checks.same_keys(a, a.limit(1), ["trade_date"])


def test_runs(spark):
    inv = spark.createDataFrame([("r", "c", 1, 1), ("r", "c", 2, 2), ("r", "d", 1, 1)], "run_id string, child_id string, started_at int, attempt int")
    assert {(r.child_id, r.attempt, r.attempts) for r in lineage.latest_children(inv).collect()} == {("c", 2, 2), ("d", 1, 1)}
    rec = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", 1, "x"), ("d", 1, "x")], "source_id string, started_at int, revision string")
    now = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("c", 2, "x")], "source_id string, started_at int, revision string")
    assert {r.source_id for r in lineage.changed_inputs(rec, now).collect()} == {"c", "d"}
    when = spark.createDataFrame([("a", 1), ("b", None), ("c", 2)], "run_id string, created_at int")
    assert [r.run_id for r in lineage.newest_first(when).collect()] == ["c", "a", "b"]
    long = spark.createDataFrame([("e" * 2000, "n" * 400)], "error string, name string")
    assert [len(x) for x in long.select(*lineage.summary_text(F.col("error"), F.col("name"))).first()] == [1000, 256]


def test_reports(spark):
    daily = spark.createDataFrame([("20240101", 0.1, 0.2, [1]), ("20240103", float("nan"), 0.4, [2])], "trade_date string, top20_net double, top30_net double, top20_rows array<int>")
    one = report.online_slice(daily, "20240101", 20, "k").first().asDict()
    assert one == {"portfolio_key": "k", "trade_date": "20240101", "net": 0.1}
    assert report.renamed_size(daily.select("top20_net"), 20, 50).columns == ["top50_net"]
    assert compare.last_on_or_before(daily, "20240102").first().trade_date == "20240101"
    assert [r.trade_date for r in compare.column_sort(daily, "top20_net", False).collect()] == ["20240101", "20240103"]
    same = spark.createDataFrame([("r1", "x"), ("r2", "x")], "run string, revision string")
    table = compare.parameter_report({("base", "rank", "p"): daily.select("top20_net"), ("risk", "rank", "p"): daily.select("top30_net")}, same)
    assert table.count() == 4 and {"preset", "label", "portfolio", "top20_net", "top30_net"} <= set(table.columns)
    with pytest.raises(ValueError, match="different inputs"):
        compare.parameter_report({}, same.union(spark.createDataFrame([("r3", "y")], same.schema)))


def test_signals_and_samples(spark):
    w = spark.createDataFrame([("20240101", "20240201"), ("20240115", "20240301"), ("20240401", "20240501")], "start string, end string")
    assert {(r.start, r.fault) for r in signals.window_faults(w).collect()} == {("20240115", "overlap"), ("20240401", "gap")}
    p = spark.createDataFrame([("20240101",), ("20240105",), ("20240109",)], "trade_date string")
    assert signals.prediction_range(p, "20240102", "20240108").count() == 1
    f = spark.createDataFrame([("d", "a", True), ("d", "b", False), ("d", "c", True)], "trade_date string, ts_code string, buyable boolean")
    y = spark.createDataFrame([("d", "a", True), ("d", "b", True), ("d", "c", False)], "trade_date string, ts_code string, label_valid boolean")
    assert analysis.analysis_rows(f, y).count() == 1 and analysis.analysis_rows(f, y, False).count() == 2
    groups = {"bar": ["kmid"], "roll": ["ma5", "kmid"]}
    df = spark.createDataFrame([(1, 2)], "kmid int, ma5 int")
    assert features.selected(df, groups, ["roll", "bar"]) == ["ma5", "kmid"]
    for wanted, columns in ((["none"], df), (["roll"], df.drop("ma5"))):
        with pytest.raises(ValueError):
            features.selected(columns, groups, wanted)


def test_portfolio_keys(spark):
    col = lambda u, s, n: identity.portfolio_identity(F.lit(u), F.lit(s), F.lit("hold"), F.lit(n), F.lit("1500"))
    a, b, c = col("all", "s1", 20), col("all", "s2", 20), col("all", "s1", 30)
    keys = spark.range(1).select(*[identity.identity_key(x) for x in (a, b, c)], *[identity.identity_key(x, ("score_selection",)) for x in (a, b, c)]).first()
    assert len(set(keys[:3])) == 3 and keys[3] == keys[4] != keys[5] and all(len(k) == 64 for k in keys)


def test_event_cash(spark):
    """A receivable counts as equity while it is pending; its cost and notional are trading."""
    days = spark.createDataFrame([("20240101", 0), ("20240102", 1), ("20240103", 2)], "trade_date string, _trade_index long")
    held = spark.createDataFrame([], "trade_date string, principal double, mark double, previous_mark double, entry_price double, entry_date string, exit_date string, delayed boolean")
    orders = spark.createDataFrame([], "trade_date string, outcome string")
    events = spark.createDataFrame([("20240102", 0.25, 0.01, 0.5)], "trade_date string, pending_cash double, cost double, notional double")
    got = {r.trade_date: r for r in portfolio.daily_results(held, orders, days, events).collect()}
    assert math.isclose(got["20240102"].equity, 1.24) and math.isclose(got["20240102"].turnover, 0.5) and math.isclose(got["20240102"].cost, 0.01)
    assert math.isclose(got["20240103"].equity, 0.99) and math.isclose(got["20240103"].net_return, -0.25 / 1.24)
    assert [r.equity for r in portfolio.daily_results(held, orders, days).collect()] == [1.0] * 3


def test_model(spark):
    """Trees learn a monotone rank, missing features are imputed, and scores rank every row."""
    rows = [(f"202401{d:02d}", f"s{k}", float(k), None if k == 3 else float(-k), "1500", True, True, f"202401{d + 1:02d}", 0.01 * k) for d in range(1, 25) for k in range(12)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, x double, z double, trade_time string, is_model_candidate boolean, is_buyable_at_signal boolean, label_target_date string, label_return double")
    t, curve = ml.train(df, ["x", "z"], rounds=4, depth=3, ratio=0.2)
    assert [f for f, _ in curve.dtypes] == ["round", "train_l2", "train_l1", "valid_l2", "valid_l1"] and curve.where("train_l2 > 0 and valid_l1 > 0").count() == 4
    assert curve.count() == 4 and 1 <= t.rounds <= 4
    assert math.isclose(sum(r.gain for r in ml.importance(spark, t).collect()), 1.0)
    scored = ml.score(df, t)
    assert scored.count() == len(rows) and scored.where("pred is null or rank is null").count() == 0
    m = ml.validation_metrics(scored.withColumn("y", F.col("label_return")), "y").first()
    assert m.rank_ic > 0.9 and m.ic > 0.9


def test_boosting_stops_and_tells_its_splits(spark):
    rng = np.random.default_rng(2)
    rows = [(f"202401{d:02d}", f"s{k}", float(x[0]), float(x[1]), float(x[0] > 0) + float(rng.normal()) * 0.2) for d in range(1, 29) for k, x in enumerate(rng.normal(size=(12, 2)))]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, x double, z double, label_return double").withColumn("label_target_date", F.col("trade_date"))
    df = df.withColumn("is_buyable_at_signal", F.lit(True)).withColumn("trade_time", F.lit("1500")).withColumn("is_model_candidate", F.lit(True))
    t, curve = ml.train(df, ["x", "z"], rounds=40, depth=2, rate=0.5, ratio=0.2, patience=3)
    c = {r["round"]: r for r in curve.collect()}
    best = min(c, key=lambda k: c[k].valid_l2)
    assert t.rounds == best == t.model.getNumTrees and len(c) == best + 3 < 40  # noise: it stops before the limit
    text = t.model.toDebugString
    got = ml.importance(spark, t).collect()
    assert {r.feature: r.splits for r in got} == {f: text.count(f"If (feature {k} ") for k, f in enumerate(["x", "z"])}
    assert [r.place for r in got] == [1, 2] and got[0].feature == "x" and got[0].gain >= got[1].gain
    nodes = ml.tree_nodes(spark, t)
    assert nodes.where("is_leaf").count() == nodes.where("not is_leaf").count() + t.rounds
    by_hand = sum((1.0 if k == 0 else 0.5) * tree.predict(ml.assembled(df.limit(1), ["x", "z"], t.imputer)[0].first()["vector"]) for k, tree in enumerate(t.model.trees))
    assert math.isclose(ml.score(df, t).where("true").join(df.limit(1).select("trade_date", "ts_code"), ["trade_date", "ts_code"]).first()["pred"], by_hand)
    broken = ml.Trained(type("Endless", (), {"transform": lambda self, v: v.withColumn("prediction", F.lit(float("nan")))})(), t.imputer, t.features, 1, t.label)
    with pytest.raises(Exception, match="not finite"):
        ml.score(df, broken).collect()


def test_run_progress(spark):
    """Seconds run, and the first step that isn't done; null while a run has no end, no step, or only done ones."""
    rows = [
        (1, "2024-01-01 00:00:00", "2024-01-01 00:01:30", [("a", "succeeded", 100.0), ("b", "running", 40.0), ("c", "pending", None)]),
        (2, "2024-01-01 00:00:00", None, [("a", "succeeded", 100.0)]), (3, None, None, []), (4, "2024-01-01 00:00:00", "2024-01-01 00:00:00", None), (5, "2024-01-01 00:00:00", None, [("a", "failed", 7.0)]),
    ]
    runs_ = spark.createDataFrame(rows, "run_id int, started_at string, ended_at string, steps array<struct<name:string,state:string,percentage:double>>").withColumns({c: F.to_timestamp(c) for c in ("started_at", "ended_at")})
    got = {r.run_id: (r.seconds, r.current_step, r.percentage) for r in lineage.progress(runs_).collect()}
    assert got == {1: (90, "b", 40.0), 2: (None, None, None), 3: (None, None, None), 4: (0, None, None), 5: (None, "a", 7.0)}
    assert lineage.progress(runs_.limit(0)).count() == 0


def test_masters(spark, tmp_path):
    """Closed and repeated days, numbers for text, empty last days, ties of names; what is no list of symbols is refused."""
    cal, listed, names = (str(tmp_path / n) for n in ("cal", "listed", "names"))
    spark.createDataFrame([(20200102, "1", "x"), (20200102, "1", "y"), (20200103, "0", "x"), (20200106, None, "x"), (20200107, "shut", "x"), (20200108, "1", None)], "cal_date int, is_open string, exchange string").write.parquet(cal)
    spark.createDataFrame([("1", "a", "20200101", ""), ("2", None, None, None), ("3", "c", "20200101", "20200601")], "ts_code string, name string, list_date string, delist_date string").write.parquet(listed)
    history = [("1", "old", "20200101", "20191201"), ("1", "new", "20191215", "20200101"), ("1", "tie", "20200101", "20200101"), ("1", "open", None, None), ("2", "told", None, "20200301"), ("2", "kept", "20200302", None)]
    spark.createDataFrame(history, "ts_code string, name string, start_date string, ann_date string").write.parquet(names)
    days, stocks, known = masters.load_masters(spark, cal, listed, names)
    assert sorted(r[0] for r in days.collect()) == ["20200102", "20200108"]
    assert {r.ts_code: r.delist_date for r in stocks.collect()} == {"1": None, "2": None, "3": "20200601"}
    assert {(r.ts_code, r._known_date): r.name for r in known.collect()} == {("1", "20200101"): "tie", ("1", None): "open", ("2", "20200301"): "told", ("2", "20200302"): "kept"}
    for k, bad in enumerate(([("1", "a", "x", ""), ("1", "b", "x", "")], [(None, "a", "x", "")], [])):
        spark.createDataFrame(bad, "ts_code string, name string, list_date string, delist_date string").write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(ValueError):
            masters.load_masters(spark, cal, str(tmp_path / f"bad{k}"), names)


def test_final_dataset(spark):
    rows = [("20200102", "1", True, 1.0, 9), ("20200103", "1", False, 2.0, 9), ("20200106", "1", True, None, 9), ("20200107", None, True, 4.0, 9), (None, "1", True, 5.0, 9), ("20200108", "2", None, 6.0, 9)]
    frame = spark.createDataFrame(rows, "trade_date string, ts_code string, _has_market_data boolean, raw double, buyable int")
    out = panel.finalize(frame, {"raw": "RAW"}, ["buyable"], start="20200103", end="20200107")
    assert out.columns == ["trade_date", "ts_code", "buyable", "RAW"] and sorted(out.collect(), key=str) == [("20200106", "1", 9, None), ("20200107", None, 9, 4.0)]
    assert panel.finalize(frame, {}, []).count() == 4
    with pytest.raises(ValueError):
        panel.finalize(frame, {"raw": "RAW"}, [], start="20210101")
