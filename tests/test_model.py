"""The model queries: their rounds, and passes and shuffles that must not grow."""

import re

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from panelspark.operators import features, ml
from panelspark.plans import queries
from panelspark.plans.tables import Tables


def _vectors(spark, n=600):
    d = spark.range(n).selectExpr("cast(id % 37 as double) as a", "cast(id * id % 101 as double) as b", "cast(id % 37 % 5 as double) + id / 4000 as label", "id % 10 = 0 as valid")
    return VectorAssembler(inputCols=["a", "b"], outputCol="vector").transform(d).select("vector", "label", "valid")


def test_model_queries_train_with_the_rounds_and_patience_of_the_operator(spark, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def boost(v, rounds, rate, depth, patience, seed):
        asked.append((rounds, patience, depth))
        raise Asked

    monkeypatch.setattr(ml, "boost", boost)
    for name in ("gbt_scores", "gbt_validation"):
        try:
            queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        except Asked:
            pass
    assert asked == [(100, 10, 5)] * 2


def test_boosting_reads_its_vectors_as_often_for_many_rounds_as_for_few(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    v = _vectors(spark).withColumn("label", F.udf(seen, "double")("label"))
    passes = []
    for rounds in (2, 12):
        before = read.value
        ml.boost(v, rounds, 0.3, 3, None, 7)
        passes.append(read.value - before)
    assert passes[0] == passes[1]


def test_trees_fit_what_those_before_left_of_the_label(spark):
    v = _vectors(spark)
    rate, fit = 0.3, [(r.vector, r.label) for r in v.where("not valid").collect()]
    trees, curve = ml.boost(v, 4, rate, 3, None, 7)
    pred = np.zeros(len(fit))
    for k, tree in enumerate(trees):
        rest = np.array([y for _, y in fit]) - pred
        alone = DecisionTreeRegressor(featuresCol="vector", labelCol="rest", maxDepth=3, seed=7).fit(spark.createDataFrame([(x, float(r)) for (x, _), r in zip(fit, rest)], ["vector", "rest"]))
        step = np.array([tree.predict(x) for x, _ in fit])
        assert np.allclose(step, [alone.predict(x) for x, _ in fit]) and np.isclose(alone._call_java("rootNode").gain(), tree._call_java("rootNode").gain())
        pred = pred + (1.0 if k == 0 else rate) * step
        gap = np.array([y for _, y in fit]) - pred
        assert np.allclose(curve[k][1:3], [(gap**2).mean(), np.abs(gap).mean()])
    assert len(trees) == len(curve) == 4


def test_half_of_the_rounds_end_as_all_of_them_do(spark, monkeypatch):
    grown, asked = ml.grown, []
    monkeypatch.setattr(ml, "grown", lambda v, n, *rest: asked.append(n) or grown(v, n, *rest))
    v = _vectors(spark)
    _, whole = ml.boost(v, 12, 0.3, 3, None, 7)
    _, late = ml.boost(v, 12, 0.3, 3, 5, 7)
    noise = v.withColumn("label", F.when(F.col("valid"), -F.col("label")).otherwise(F.col("label")))  # the better learned, the worse
    trees, early = ml.boost(noise, 12, 0.3, 3, 2, 7)
    assert asked == [12, 6, 12, 6] and np.allclose(late, whole[: len(late)]) and len(late) > 6
    assert len(trees) == len(early) == min(early, key=lambda c: c[3])[0] + 2 <= 6


def test_features_stay_where_their_symbol_is(spark):
    """No shuffle of features: neither for windows, nor for labels, nor of what goes through numpy."""
    t = Tables(spark, "/root/testdata/sf0.001")
    rows, names = queries._model_rows(t)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(names) == 158 and plan.count("FlatMapGroupsInArrow") == 1 and not re.search(r"Exchange (hash|range)partitioning", plan)
    lists = [f for f in plan.splitlines() if "FlatMapGroupsInArrow" in f and "_closes" in f]
    assert not lists
    whole = features.rolling(t.lagged)
    parts = {f: features.rolling(t.lagged, (f,)) for f in features.FAMILIES}
    assert whole.columns == [*t.lagged.columns, *[c for p in parts.values() for c in p.columns[len(t.lagged.columns) :]]]
