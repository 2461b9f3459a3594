"""Accounting identities, reports, comparison, lineage, files and streams on small tables."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelspark.functions.storage import new_path
from panelspark.operators import compare, lineage, portfolio, report, signals
from panelspark.sources import files
from panelspark.streaming import runs as streams

DAYS = [(date(2024, 1, 1) + timedelta(days=i)).strftime("%Y%m%d") for i in range(6)]


@pytest.fixture(scope="module")
def market(spark):
    prices = {"A": [1.0, 1.1, 1.2, 1.3, 1.4, 1.5], "B": [2.0, 2.0, None, 2.2, 2.2, 2.1]}
    rows = [(d, s, p, 1.0, p is not None, p is not None and (s, i) != ("A", 2), "quoted" if p else "suspended") for s, ps in prices.items() for i, (d, p) in enumerate(zip(DAYS, ps, strict=True))]
    return spark.createDataFrame(rows, "trade_date string, ts_code string, price double, adjustment_factor double, can_buy boolean, can_sell boolean, market_status string").persist()


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame(list(zip(DAYS, range(6), strict=True)), "trade_date string, _trade_index long").persist()


def _orders(spark, market, rows):
    t = spark.createDataFrame([(d, s, 0.5) for d, s in rows], "trade_date string, ts_code string, weight double")
    return portfolio.order_outcomes(t, market)


def test_delayed_exit_and_carried_mark(spark, market, days):
    orders = _orders(spark, market, [(DAYS[1], "A"), (DAYS[1], "B"), (DAYS[2], "B")])
    assert {(r.trade_date, r.ts_code): r.reason for r in orders.collect()} == {(DAYS[1], "A"): None, (DAYS[1], "B"): None, (DAYS[2], "B"): "suspended"}
    t = {r.ts_code: r for r in portfolio.trade_log(orders, market, days, 1).collect()}
    assert t["A"].planned_exit == DAYS[2] and t["A"].exit_date == DAYS[3] and t["A"].delayed and t["A"].realised_return == pytest.approx(1.3 / 1.1 - 1)
    p = portfolio.positions(portfolio.trade_log(orders, market, days, 1), market, days)
    assert {r.trade_date: r.mark for r in p.where("ts_code = 'B'").collect()} == {DAYS[1]: 2.0, DAYS[2]: 2.0, DAYS[3]: 2.2}


def test_identities(spark, market, days):
    orders = _orders(spark, market, [(d, s) for d in DAYS[:4] for s in "AB"])
    trades = portfolio.trade_log(orders, market, days, 1).persist()
    d = portfolio.daily_results(portfolio.positions(trades, market, days), orders, days).orderBy("trade_date").toPandas()
    won = trades.where("exit_date is not null").agg(F.sum(F.col("principal") * F.col("realised_return") - F.col("fee"))).first()[0]
    assert d["equity"].iloc[-1] == pytest.approx(1 + won)  # all trades are closed by the last day
    assert (d["gross_return"] - d["cost"] - d["net_return"]).abs().max() < 1e-12
    e = spark.createDataFrame([(DAYS[2], 0.1, 0.01, 1.0)], "trade_date string, pending_cash double, cost double, notional double")
    x = portfolio.daily_results(portfolio.positions(trades, market, days), orders, days, e).orderBy("trade_date").toPandas()
    assert x["equity"][2] - d["equity"][2] == pytest.approx(0.1 - 0.01) and x["equity"][3] - d["equity"][3] == pytest.approx(-0.01)


def test_rank_band(spark):
    ranks = {"A": [1, 2, 3, 4], "B": [2, None, 1, 1]}
    d = spark.createDataFrame([(s, DAYS[i], r) for s, rs in ranks.items() for i, r in enumerate(rs)], "ts_code string, trade_date string, target_rank long")
    b = portfolio.rank_band(d, 2, 1.5)
    assert {(r.ts_code, r.trade_date): r.member for r in b.collect()} == {("A", DAYS[0]): True, ("A", DAYS[1]): True, ("A", DAYS[2]): True, ("A", DAYS[3]): False, ("B", DAYS[0]): True, ("B", DAYS[1]): False, ("B", DAYS[2]): True, ("B", DAYS[3]): True}
    assert portfolio.replacements(b, 2).where(F.col("trade_date") == DAYS[1]).first()["exits"] == 1


def test_ranks_ignore_labels_and_break_ties(spark):
    s = spark.createDataFrame([("d", "1500", "B", 1.0, True, True), ("d", "1500", "A", 1.0, True, True), ("d", "1500", "C", 2.0, True, False)], "trade_date string, trade_time string, ts_code string, pred double, is_model_candidate boolean, is_buyable_at_signal boolean")
    r = {x.ts_code: (x.rank, x.buyable_rank, x.target_rank) for x in signals.target_ranks(signals.rank_signals(s)).collect()}
    assert r == {"C": (1, None, None), "A": (2, 1, 1), "B": (3, 2, 2)}
    restored = signals.restore(s, signals.target_ranks(s).where("target_rank is not null"))
    assert restored.where("is_model_candidate").count() == 2


def test_summary_and_comparison(spark):
    rows = [("20240131", 3, 0.1, 0.12, 0.5, 0, 1, 0.01), ("20240201", 3, -0.2, -0.18, 0.5, 1, 2, None), ("20240202", 3, 0.05, 0.06, 0.5, 0, 2, 0.02)]
    d = spark.createDataFrame(rows, "trade_date string, top_n long, net_return double, gross_return double, turnover double, delayed long, positions long, universe_return double")
    s = {(r.period_type, r.period): r for r in report.period_summary(d).collect()}
    assert s[("overall", "all")].net_total == pytest.approx(1.1 * 0.8 * 1.05 - 1) and s[("overall", "all")].max_drawdown == pytest.approx(-0.2)
    assert s[("month", "2024-01")].sharpe == 0.0 and s[("month", "2024-02")].max_drawdown == pytest.approx(-0.2) and s[("quarter", "2024Q1")].open_positions == 2
    pairs = compare.paired_days(d, d.where("trade_date <> '20240201'"))
    assert pairs.count() == 2 and compare.strategy_stats(pairs).first()["difference_ratio"] is None
    c = compare.cumulative_curve(d.withColumn("net_return", F.when(F.col("delayed") == 0, F.col("net_return"))))
    assert [r.cumulative for r in c.orderBy(F.desc(F.col("trade_date") == "start"), "trade_date").collect()] == [0.0, pytest.approx(0.1), None, pytest.approx(0.155)]


def test_lineage_cycles_and_missing(spark):
    runs = spark.createDataFrame([("a", ["b", "a"], "succeeded", 1), ("b", ["c"], "succeeded", 2), ("c", ["a"], "failed", 3), ("d", ["gone"], "running", 4), ("e", None, "succeeded", 5)], "run_id string, upstream_ids array<string>, state string, created_at long")
    e = lineage.edges(runs)
    assert e.count() == 4 and lineage.nodes(runs).where("missing").first()["run_id"] == "gone"
    up = lineage.all_upstream(e)
    assert {r.ancestor for r in up.where("run_id = 'a'").collect()} == {"a", "b", "c"}
    comp = {r.run_id: r.component for r in lineage.components(e, runs).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "d", "gone": "d", "e": "e"}
    r = {x.run_id: x for x in lineage.relations(runs).collect()}
    assert (r["a"].all_upstream, r["a"].provisional_upstream, r["d"].missing_upstream, r["e"].downstream) == (2, 1, 1, 0)


def test_files(spark):
    d = spark.createDataFrame([("20240101", "a", 1.0), ("20240101", "a", 1.0), ("20240102", "b", 2.0)], "trade_date string, ts_code string, x double")
    path = new_path(spark, "landing")
    files.land(d, path, ["trade_date", "ts_code", "x"])
    files.land(d.where("trade_date = '20240102'").withColumn("x", F.lit(9.0)), path, ["trade_date", "ts_code", "x"])
    got = files.scan(spark, path, "trade_date string, ts_code string, x double, extra int", since="20240101")
    assert sorted((r.trade_date, r.x) for r in got.collect()) == [("20240101", 1.0), ("20240101", 1.0), ("20240102", 9.0)]
    assert files.scan(spark, path + "-none", "a int").count() == 0
    lines = new_path(spark, "lines")
    spark.createDataFrame([(json.dumps({"a": 1}),), ("{bad",), (" ",)], "value string").write.text(lines)
    assert sorted((r.parsed is not None, r.error) for r in files.read_jsonl(spark, lines, "a int").collect()) == [(False, "malformed JSON"), (True, None)]
    assert files.latest_days(d, 1).count() == 1 and files.latest_days(d, 100).count() == 3


def test_streams(spark):
    folder = new_path(spark, "journal")
    rows = [json.dumps({"run_id": "r", "step": "s", "ts": f"2024-01-01 00:00:0{i}", "percentage": i * 10.0, "state": "succeeded" if i == 3 else "running"}) for i in range(4)] + ["{half"]
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(folder)
    j = streams.journal(spark, folder)
    out = streams.drain(j, "append")
    assert out.where("malformed").count() == 1 and out.where("not malformed").count() == 4
    e = streams.latest_state(j.where("not malformed").select("event.*"))
    r = streams.drain(e, "update", ["run_id", "step"]).first()
    assert (r.state, r.percentage, r.events) == ("succeeded", 30.0, 4)
    before = spark.createDataFrame([("a", 1), ("b", 1)], "run_id string, version int")
    after = spark.createDataFrame([("b", 2), ("c", 1)], "run_id string, version int")
    assert {(x.run_id, x.change) for x in streams.change_feed(before, after).collect()} == {("a", "remove"), ("b", "change"), ("c", "add")}


def test_benchmark_coverage_hangs_on_no_order(spark):
    """Six members of a thirtieth each, dealt over one task or several, reach a fifth or don't, but always the same."""
    w = 100.0 / 30 / 100
    rows = [(DAYS[0], DAYS[1], str(i), 0.1 * i, True, w if i % 7 == 0 else 0.0) for i in range(42)]
    schema = "trade_date string, label_target_date string, ts_code string, label_return double, label_valid boolean, index_weight double"
    got = set()
    for parts in (1, 2, 3, 6):
        d = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), schema).persist()
        weights = F.broadcast(d.select("trade_date", "ts_code", "index_weight"))
        got.add(report.benchmarks(d.drop("index_weight"), weights, 0.2).first()["index_return"])
        d.unpersist()
    assert got == {None}
