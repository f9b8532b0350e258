"""Multinomial gradient boosting (softmax) on MLlib regression trees.

A round fits one tree for each class, all to the same probabilities: with p the softmax of the margins, the target of
class k is (y - p) / (p (1 - p)) with weight p (1 - p).  The weighted mean in a leaf is then the sum of gradients over
the sum of second derivatives, the Newton step of the multinomial loss, and the split gain (less weighted variance) is
the usual gain of second-order boosting without a penalty.  Probabilities sum to 1 by construction; nothing is scaled
afterwards, as in one binary model per class.

The trees of a round do not depend on each other and are fitted at the same time.  Features and margins go through
``checkpoint()`` (the shared folder) at the start and every ``CHECKPOINT`` rounds; the margins of a round are those of
the last checkpoint with the trees since then added in one step, so no plan holds the input's lineage or the rounds
before, however many jobs a fit takes.  The model is a list of flat trees and is applied to Arrow batches.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CHECKPOINT = 10
LEAST_WEIGHT = 1e-6     # of a row: keeps the target finite where a probability is 0 or 1
MOST_TARGET = 20.0


def flat_tree(root) -> dict[str, list]:
    """A fitted tree as lists by node: feature (-1 at a leaf), threshold, left, right, value."""
    out: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    todo, at = [root], 0
    while at < len(todo):
        node = todo[at]
        inner = node.subtreeDepth() > 0
        split = node.split() if inner else None
        for name, v in (("feature", split.featureIndex() if inner else -1), ("threshold", split.threshold() if inner else 0.0),
                        ("left", len(todo) if inner else at), ("right", len(todo) + 1 if inner else at), ("value", node.prediction())):
            out[name].append(v)
        if inner:
            todo += [node.leftChild(), node.rightChild()]
        at += 1
    return out


def tree_values(tree: dict[str, list], x: np.ndarray) -> np.ndarray:
    feature, threshold = np.array(tree["feature"]), np.array(tree["threshold"])
    left, right, value = np.array(tree["left"]), np.array(tree["right"]), np.array(tree["value"])
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while (feature[at] >= 0).any():
        goes_left = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(feature[at] < 0, at, np.where(goes_left, left[at], right[at]))
    return value[at]


def _margins(rounds: list[list[dict]], rate: float):
    """A column function: (margins so far, features) -> margins with the trees of ``rounds`` added."""

    @F.pandas_udf("array<double>")
    def add(margins: pd.Series, features: pd.Series) -> pd.Series:
        if not len(margins):
            return pd.Series([], dtype=object)
        x, m = np.stack(features.to_numpy()), np.stack(margins.to_numpy()).astype(float)
        for trees in rounds:
            m = m + rate * np.column_stack([tree_values(t, x) for t in trees])
        return pd.Series(list(m))

    return add


def softmax(margins):
    top = F.array_max(margins)
    e = F.transform(margins, lambda m: F.exp(m - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


class _BoostParams(HasFeaturesCol, HasLabelCol):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's step that is taken", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a node", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that a round sees", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)


class SoftmaxBoosting(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator; labels are 0, 1, ... as numbers."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", maxIter=20, maxDepth=5, stepSize=0.1, maxBins=32,
                 minInstancesPerNode=1, subsamplingRate=1.0, seed=42):
        super().__init__()
        self._setDefault(maxIter=20, maxDepth=5, stepSize=0.1, maxBins=32, minInstancesPerNode=1, subsamplingRate=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "SoftmaxBoostingModel":
        spark, get = dataset.sparkSession, self.getOrDefault
        ensure_checkpoint_dir(spark)
        # Without the assembler's notes on nominal slots: a one-hot slot is a number like others, cut at a threshold.
        rows = dataset.select(F.col(self.getFeaturesCol()).alias("features", metadata={}), vector_to_array(self.getFeaturesCol()).alias("x"),
                              F.col(self.getLabelCol()).cast("int").alias("y")).where("y IS NOT NULL")
        counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}     # a row a class
        classes, total = max(counts, default=0) + 1, sum(counts.values())
        prior = [float(np.log(max(counts.get(k, 0), 0.5) / total)) if total else 0.0 for k in range(classes)]
        rate, rounds, recent = get(self.stepSize), [], []
        start = rows.withColumn("margins", F.array(*[F.lit(v) for v in prior])).checkpoint() if total else None

        def one(k: int, made: DataFrame) -> dict:
            p = F.element_at("p", k + 1)
            weight = F.greatest(p * (1 - p), F.lit(LEAST_WEIGHT))
            target = ((F.col("y") == k).cast("double") - p) / weight
            data = made.select("features", F.greatest(F.lit(-MOST_TARGET), F.least(F.lit(MOST_TARGET), target)).alias("t"), weight.alias("w"))
            tree = DecisionTreeRegressor(featuresCol="features", labelCol="t", weightCol="w", maxDepth=get(self.maxDepth),
                                         maxBins=get(self.maxBins), minInstancesPerNode=get(self.minInstancesPerNode), seed=get(self.seed))
            return flat_tree(tree.fit(data)._java_obj.rootNode())

        with ThreadPoolExecutor(max(1, classes)) as pool:
            for i in range(get(self.maxIter) if total else 0):
                state = start.withColumn("margins", _margins(recent, rate)("margins", "x")) if recent else start
                if len(recent) == CHECKPOINT:
                    state = start = state.checkpoint()
                    recent = []
                made = state.withColumn("p", softmax(F.col("margins"))).select("features", "y", "p")
                if get(self.subsamplingRate) < 1:
                    made = made.sample(get(self.subsamplingRate), seed=get(self.seed) + i)
                made = made.persist()
                fit = inheritable_thread_target(spark)(one)
                trees = list(pool.map(lambda k: fit(k, made), range(classes)))
                rounds.append(trees)
                recent.append(trees)
                made.unpersist()
        model = SoftmaxBoostingModel(json.dumps({"prior": prior, "rate": rate, "rounds": rounds}))
        return model._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol())


class SoftmaxBoostingModel(Model, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction (margins), probability and prediction (the class of the largest margin, ties to the smaller)."""

    trees = Param(Params._dummy(), "trees", "prior, rate and flat trees of all rounds, as JSON", TypeConverters.toString)

    def __init__(self, trees: str | None = None):
        super().__init__()
        if trees is not None:
            self._set(trees=trees)

    def parts(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.parts()
        margins = _margins(p["rounds"], p["rate"])(F.array(*[F.lit(v) for v in p["prior"]]), vector_to_array(self.getFeaturesCol()))
        out = dataset.withColumn("__m", margins)
        return (out.withColumn("rawPrediction", array_to_vector("__m")).withColumn("probability", array_to_vector(softmax(F.col("__m"))))
                .withColumn("prediction", (F.array_position("__m", F.array_max("__m")) - 1).cast("double")).drop("__m"))
