"""Softmax boosting against a plain Python version of the same rounds."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from tidewater.operators.boosting import SoftmaxBoosting, tree_values


def plain_tree(x, t, w, depth):
    """Weighted regression tree: greedy, cuts half way between neighbouring values."""
    mean = (t * w).sum() / w.sum()
    best = None
    if depth:
        base = (w * (t - mean) ** 2).sum()
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                loss = sum((w[s] * (t[s] - (t[s] * w[s]).sum() / w[s].sum()) ** 2).sum() for s in (left, ~left))
                if base - loss > 1e-9 and (best is None or loss < best[0] - 1e-12):
                    best = (loss, f, cut, left)
    if best is None:
        return lambda q: np.full(len(q), mean)
    _, f, cut, left = best
    a, b = plain_tree(x[left], t[left], w[left], depth - 1), plain_tree(x[~left], t[~left], w[~left], depth - 1)
    return lambda q: np.where(q[:, f] <= cut, a(q), b(q))


def plain_boosting(x, y, rounds, depth, rate):
    classes = int(y.max()) + 1
    m = np.tile([math.log((y == k).mean()) for k in range(classes)], (len(x), 1))
    for _ in range(rounds):
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = []
        for k in range(classes):
            w = np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            step.append(plain_tree(x, np.clip(((y == k) - p[:, k]) / w, -20, 20), w, depth)(x))
        m = m + rate * np.column_stack(step)
    p = np.exp(m - m.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def data(spark, n=120):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.permutation(n) % 29, rng.permutation(n) % 23, rng.permutation(n) % 31]).astype(float)
    y = ((x[:, 0] > 14).astype(int) + (x[:, 1] + 0.3 * x[:, 2] > 20)).astype(int)
    y = np.where(rng.random(n) < 0.1, 1, y)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "i int, a double, b double, c double, label int")
    return x, y, df


def test_same_as_plain_python(spark, scratch):
    x, y, df = data(spark)
    stages = [VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), SoftmaxBoosting(maxIter=3, maxDepth=2, stepSize=0.3)]
    model = Pipeline(stages=stages).fit(df)
    want = plain_boosting(x, y, 3, 2, 0.3)
    rows = model.transform(df).orderBy("i").collect()
    got = np.array([r["probability"].toArray() for r in rows])
    assert np.allclose(got, want, atol=1e-6) and np.allclose(got.sum(1), 1)
    assert [int(r["prediction"]) for r in rows] == want.argmax(1).tolist()
    model.write().overwrite().save(scratch)
    again = PipelineModel.load(scratch).transform(df).orderBy("i").collect()
    assert [r["prediction"] for r in again] == [r["prediction"] for r in rows]


def test_tree_values():
    tree = {"feature": [1, -1, 0, -1, -1], "threshold": [2.0, 0, 5.0, 0, 0], "left": [1, 1, 3, 3, 4], "right": [2, 1, 4, 3, 4], "value": [0, 1.0, 0, 2.0, 3.0]}
    assert tree_values(tree, np.array([[9.0, 2.0], [5.0, 3.0], [6.0, 3.0]])).tolist() == [1.0, 2.0, 3.0]


def test_no_rows_and_one_class(spark):
    _, _, df = data(spark, 40)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    one = SoftmaxBoosting(maxIter=2).fit(df.where("label = 0"))
    assert {(r["prediction"], tuple(r["probability"])) for r in one.transform(df).collect()} == {(0.0, (1.0,))}
    assert SoftmaxBoosting(maxIter=2).fit(df.where("false")).transform(df.where("false")).collect() == []


def test_no_fit_plans_the_lineage_of_its_rows_again(spark, monkeypatch):
    """A fit takes hundreds of jobs and the driver keeps the plan of each: they read written rows, not what made them."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    plans, fit = [], DecisionTreeRegressor.fit

    def spy(self, data, *args):
        plans.append(data._jdf.queryExecution().toString())
        return fit(self, data, *args)

    monkeypatch.setattr(DecisionTreeRegressor, "fit", spy)
    rows = spark.range(200).selectExpr("id % 3 AS label", "cast(id % 7 AS double) AS a", "id AS lineage_mark").where("lineage_mark >= 0")
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows).persist()
    SoftmaxBoosting(featuresCol="features", labelCol="label", maxIter=12, maxDepth=2).fit(data)
    data.unpersist()
    assert len(plans) == 36
    assert not any("lineage_mark" in p for p in plans)
    assert max(map(len, plans)) < 4 * min(map(len, plans))


def test_candidates_and_splits_are_read_from_written_rows(spark, monkeypatch):
    from tidewater.operators import ml as ML
    from tidewater.plans import ml as P
    seen = []

    def rows(s, sf):
        return s.range(3).selectExpr("'train' AS dataset_split", "id AS lineage_mark").where("lineage_mark >= 0")

    monkeypatch.setattr(P, "model_rows", rows)
    for part in P._splits(spark, "unused"):
        assert "Range" not in part._jdf.queryExecution().toString()

    def weights(df, *args):
        seen.append(df._jdf.queryExecution().toString())
        raise StopIteration

    monkeypatch.setattr(ML, "with_class_weights", weights)
    monkeypatch.setattr(ML, "feature_stages", lambda **kw: [])
    table = spark.range(30).selectExpr("cast(id % 3 AS int) AS traffic_level_numeric", "'Bergen' AS study_area")
    with pytest.raises(StopIteration):
        ML.train_and_validate(table, table, [ML.Candidate("t", "tree")])
    assert seen and not any("Range" in p for p in seen)
