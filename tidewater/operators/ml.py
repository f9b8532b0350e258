"""Model training, scoring and evaluation with MLlib.

The reference trains single-machine gradient-boosting / forest libraries; here
the same roles are played by MLlib estimators, which train distributed over
the cached model table.  Metrics reuse the aggregate forms of ``metrics.py``
(macro F1 over labels present, as the reference computes it).
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..session import staged
from . import features as FT
from . import metrics as MT
from .boosting import SoftmaxBoosting
from .profile import with_class_weights

LABEL = "traffic_level_numeric"


# ---------------------------------------------------------------------------
# M1: feature pipeline
# ---------------------------------------------------------------------------

def feature_stages(numeric=None, categorical="study_area", scale: bool = False,
                   impute: bool = False, drop_centroids: bool = False) -> list:
    numeric = list(numeric or C.NUMERIC_FEATURES)
    if drop_centroids:
        numeric = [c for c in numeric if not c.startswith("centroid_")]
    stages = []
    inputs = numeric
    if impute:
        imputed = [f"{c}__imp" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=imputed))
        inputs = imputed
    cat_cols = []
    if categorical:
        stages.append(StringIndexer(inputCol=categorical, outputCol=f"{categorical}__idx",
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        # the indexer maps unseen areas to its extra last index, which the encoder drops:
        # one slot per area, and zeros for an unknown one
        stages.append(OneHotEncoder(inputCols=[f"{categorical}__idx"], outputCols=[f"{categorical}__ohe"],
                                    dropLast=True, handleInvalid="error"))
        cat_cols = [f"{categorical}__ohe"]
    if scale:   # numbers only; the one-hot slots stay 0 and 1
        stages.append(VectorAssembler(inputCols=inputs, outputCol="numbers", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="numbers", outputCol="numbers_scaled", withMean=True, withStd=True))
        inputs = ["numbers_scaled"]
    stages.append(VectorAssembler(inputCols=inputs + cat_cols, outputCol="features", handleInvalid="keep"))
    return stages


def feature_names(numeric=None, areas=None, drop_centroids: bool = False) -> list[str]:
    numeric = list(numeric or C.NUMERIC_FEATURES)
    if drop_centroids:
        numeric = [c for c in numeric if not c.startswith("centroid_")]
    areas = sorted(areas or C.STUDY_AREAS)
    return numeric + [f"study_area={a}" for a in areas]


# ---------------------------------------------------------------------------
# Macro-F1 evaluator (for TrainValidationSplit / candidate loops)
# ---------------------------------------------------------------------------

class MacroF1Evaluator(Evaluator):
    """Macro F1 over the labels present in label or prediction (reference rule)."""

    def __init__(self, labelCol: str = LABEL, predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        d = dataset.select(F.col(self.labelCol).cast("int").alias("actual"),
                           F.col(self.predictionCol).cast("int").alias("predicted"))
        return float(MT.class_metrics(d).select("macro_f1").first()[0])

    def isLargerBetter(self) -> bool:
        return True


# ---------------------------------------------------------------------------
# M2 / M3: candidates
# ---------------------------------------------------------------------------

@dataclass
class Candidate:
    name: str
    family: str
    params: dict = field(default_factory=dict)
    scale: bool = False
    weighted: bool = False


def build_estimator(c: Candidate, label: str = LABEL, seed: int = 42):
    p = dict(c.params)
    if c.family == "logistic":
        lr = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", **p)
        return lr.setWeightCol("weight") if c.weighted else lr
    if c.family == "tree":
        return DecisionTreeClassifier(featuresCol="features", labelCol=label, seed=seed, **p)
    if c.family == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, **p)
    if c.family == "boosted":
        return SoftmaxBoosting(featuresCol="features", labelCol=label, seed=seed, **p)
    if c.family == "gbt_regressor":
        return GBTRegressor(featuresCol="features", labelCol=C.TARGET_COLUMN, seed=seed, **p)
    if c.family == "forest_regressor":
        return RandomForestRegressor(featuresCol="features", labelCol=C.TARGET_COLUMN, seed=seed, **p)
    raise ValueError(c.family)


def baseline_candidates() -> list[Candidate]:
    """M2: the baseline families with all their iterations, trees and rounds (MLlib depth is capped at 30)."""
    return [
        Candidate("LogisticRegression", "logistic", {"maxIter": 1000}, scale=True, weighted=True),
        Candidate("DecisionTree", "tree", {"maxDepth": 16, "minInstancesPerNode": 10}),
        Candidate("RandomForest", "forest", {"numTrees": 300, "maxDepth": DEEPEST, "minInstancesPerNode": 2}),
        Candidate("BoostedTrees", "boosted", {"maxIter": 350, "stepSize": 0.05, "maxDepth": 7, "minInstancesPerNode": 3,
                                              "subsamplingRate": 0.9}),
    ]


# Candidate settings.  Boosted: rounds, rate, depth, least rows of a node, share of rows.
BOOSTED_GLOBAL = [(300, 0.03, 5, 1, 0.9), (400, 0.03, 7, 1, 0.9), (500, 0.03, 7, 3, 0.9), (350, 0.05, 5, 3, 0.9),
                  (450, 0.05, 7, 3, 0.9), (350, 0.05, 9, 3, 0.9), (300, 0.07, 6, 3, 0.85), (400, 0.04, 8, 5, 0.9)]
BOOSTED_LOCAL = [(300, 0.03, 5, 1, 0.9), (400, 0.03, 7, 1, 0.9), (500, 0.03, 7, 3, 0.9), (350, 0.05, 7, 3, 0.9),
                 (400, 0.04, 8, 5, 0.9), (350, 0.05, 9, 3, 0.9), (300, 0.07, 6, 3, 0.85)]
BOOSTED_COUNTS = [(300, 0.03, 5, 1, 0.9), (400, 0.03, 7, 1, 0.9), (500, 0.03, 7, 3, 0.9), (350, 0.05, 7, 3, 0.9),
                  (400, 0.04, 8, 5, 0.9), (350, 0.05, 9, 3, 0.9)]
# Histogram-boosted: rate, rounds, leaves, least rows of a leaf.
HISTOGRAM_GLOBAL = [(0.05, 250, 31, 20), (0.05, 350, 31, 20), (0.05, 350, 63, 20), (0.08, 250, 31, 20),
                    (0.08, 300, 63, 20), (0.04, 400, 63, 30), (0.06, 300, 47, 30), (0.04, 450, 31, 40)]
# Forest: trees, depth (None: no limit), least rows of a leaf, features of a node.
FOREST_GLOBAL = [(400, None, 1, "sqrt"), (400, None, 2, "sqrt"), (500, 24, 2, "sqrt"), (500, 32, 2, "sqrt"), (500, None, 4, "sqrt"),
                 (400, None, 2, "0.5")]
DEEPEST = 30            # MLlib's limit


def _some(n: int, share: float) -> int:
    return max(1, round(n * share))


def _boosted(prefix: str, settings: list[tuple], share: float = 1.0, family: str = "boosted") -> list[Candidate]:
    return [Candidate(f"{prefix}_{i:02d}", family, {"maxIter": _some(n, share), "stepSize": rate, "maxDepth": depth,
                                                    "minInstancesPerNode": least, "subsamplingRate": rows})
            for i, (n, rate, depth, least, rows) in enumerate(settings, 1)]


def tuning_candidates() -> list[Candidate]:
    """M3: all 22 candidates of three families, with all their rounds and trees.

    Boosted trees with a depth, boosted trees with a number of leaves (as the depth that holds them), forests.
    """
    leaves = [(n, rate, math.ceil(math.log2(held)), least, 1.0) for rate, n, held, least in HISTOGRAM_GLOBAL]
    forests = [Candidate(f"RF_{i:02d}", "forest", {"numTrees": n, "maxDepth": min(depth or DEEPEST, DEEPEST),
                                                   "minInstancesPerNode": least, "featureSubsetStrategy": features})
               for i, (n, depth, least, features) in enumerate(FOREST_GLOBAL, 1)]
    return _boosted("GBT", BOOSTED_GLOBAL) + _boosted("HGB", leaves) + forests


def local_candidates() -> list[Candidate]:
    """M4: the 7 candidates of a local model, with all their rounds."""
    return _boosted("LOCAL", BOOSTED_LOCAL)


def regressor_candidates(share: float = 1.0) -> list[Candidate]:
    """M5: the 6 candidates of count regression."""
    return _boosted("REG", BOOSTED_COUNTS, share, "gbt_regressor")


def majority_class(train: DataFrame, label: str = LABEL):
    """Most frequent train class (ties -> smaller class) as a scalar subquery."""
    return (train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), label).limit(1).select(label).scalar())


def fit_candidate(c: Candidate, train: DataFrame, drop_centroids: bool = False,
                  impute: bool = False) -> tuple[PipelineModel, float]:
    stages = feature_stages(scale=c.scale, impute=impute, drop_centroids=drop_centroids)
    data = with_class_weights(train) if c.weighted else train
    owned = not data.is_cached      # iterative learners must re-read a persisted input, not its lineage
    if owned:
        data = data.persist()
    pipe = Pipeline(stages=stages + [build_estimator(c)])
    t0 = time.time()
    model = pipe.fit(data)
    secs = time.time() - t0
    if owned:
        data.unpersist()
    return model, secs


def evaluate_classifier(model: PipelineModel, data: DataFrame) -> DataFrame:
    scored = model.transform(data).select(F.col(LABEL).cast("int").alias("actual"),
                                          F.col("prediction").cast("int").alias("predicted"),
                                          "study_area")
    return scored


def train_and_validate(train: DataFrame, valid: DataFrame, candidates: list[Candidate],
                       drop_centroids: bool = False, parallelism: int = 8) -> tuple[DataFrame, dict]:
    """M2 / M3: fit each candidate on train, score validation; one metrics row each.

    Returns (metrics DataFrame, fitted models by name).  Features are assembled once (and once more scaled, if a
    candidate asks for it) into narrow written tables that all candidates read: a fit takes hundreds of jobs, and the
    driver keeps the plan of each, so none may hold the lineage of the rows.  ``parallelism`` candidates are fitted at
    a time, so that small stages of one fill the cluster beside those of another.
    """
    spark = train.sparkSession
    held, valid = staged(train, "train"), staged(valid, "validation")
    maj = majority_class(held)
    dummy = MT.class_metrics(valid.select(F.col(LABEL).cast("int").alias("actual"), maj.cast("int").alias("predicted"))).first()
    rows, models = [("Dummy", "majority", dummy["accuracy"], dummy["macro_f1"], dummy["weighted_f1"], 0.0)], {}
    ready = {}
    for scale in sorted({c.scale for c in candidates}):
        f = Pipeline(stages=feature_stages(scale=scale, drop_centroids=drop_centroids)).fit(held)
        ready[scale] = (f, staged(f.transform(with_class_weights(held)).select("features", LABEL, "weight"), "features").persist(),
                        staged(f.transform(valid).select("features", LABEL, "study_area"), "features").persist())

    def one(c: Candidate) -> tuple[tuple, PipelineModel]:
        f, data, check = ready[c.scale]
        t0 = time.time()
        model = build_estimator(c).fit(data)
        secs = time.time() - t0
        m = MT.class_metrics(evaluate_classifier(model, check)).first()
        return (c.name, c.family, m["accuracy"], m["macro_f1"], m["weighted_f1"], round(secs, 3)), PipelineModel(stages=f.stages + [model])

    with ThreadPoolExecutor(max(1, min(parallelism, len(candidates)))) as pool:
        for c, (row, model) in zip(candidates, pool.map(inheritable_thread_target(spark)(one), candidates)):
            rows.append(row)
            models[c.name] = model
    for _, data, check in ready.values():
        data.unpersist()
        check.unpersist()
    df = spark.createDataFrame(rows, "model string, family string, accuracy double, macro_f1 double, "
                                     "weighted_f1 double, train_seconds double")
    return df, models


def tune(train: DataFrame, valid: DataFrame, candidates: list[Candidate]) -> tuple[DataFrame, str]:
    """M3: ranked candidate table and the name of the best (highest validation macro F1)."""
    res, _ = train_and_validate(train, valid, candidates)
    ranked = res.filter(F.col("family") != "majority").orderBy(F.desc("macro_f1"), "model")
    best = ranked.first()["model"]
    return ranked, best


def train_local_models(train: DataFrame, valid: DataFrame, candidates: list[Candidate],
                       areas=None) -> DataFrame:
    """M4: one model per area (few areas, many rows each), centroids dropped."""
    spark = train.sparkSession
    areas = areas or sorted(C.STUDY_AREAS)
    train, valid = staged(train, "train"), staged(valid, "validation")     # every area reads its part of them
    out = []
    for a in areas:
        tr = train.filter(F.col("study_area") == a)
        va = valid.filter(F.col("study_area") == a)
        res, _ = train_and_validate(tr, va, candidates, drop_centroids=True)
        best = res.filter(F.col("family") != "majority").orderBy(F.desc("macro_f1"), "model").first()
        out.append((a, best["model"], best["macro_f1"], best["accuracy"]))
    return spark.createDataFrame(out, "study_area string, best_model string, macro_f1 double, accuracy double")


def train_regressors(train: DataFrame, test: DataFrame, thresholds: DataFrame,
                     candidates: list[Candidate], parallelism: int = 4) -> DataFrame:
    """M5: count regression; metrics on the clipped prediction and on its class."""
    spark = train.sparkSession
    f = Pipeline(stages=feature_stages()).fit(train)
    train = f.transform(train).select("features", C.TARGET_COLUMN).persist()
    test = f.transform(test).select("features", C.TARGET_COLUMN, LABEL, "study_area").persist()

    def one(c: Candidate) -> tuple:
        t0 = time.time()
        model = build_estimator(c).fit(train)
        secs = time.time() - t0
        s = model.transform(test).withColumn("clipped", F.greatest(F.lit(0.0), F.col("prediction")))
        reg = MT.regression_metrics(s, C.TARGET_COLUMN, "clipped").first()
        s = s.join(F.broadcast(thresholds.select("study_area", "high_threshold")), "study_area")
        cls = s.select(F.col(LABEL).cast("int").alias("actual"),
                       FT.regression_to_class(F.col("clipped"), F.col("high_threshold")).alias("predicted"))
        m = MT.class_metrics(cls).first()
        return c.name, reg["mae"], reg["rmse"], reg["r2"], m["macro_f1"], round(secs, 3)

    with ThreadPoolExecutor(max(1, min(parallelism, len(candidates)))) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), candidates))
    train.unpersist()
    test.unpersist()
    return spark.createDataFrame(rows, "model string, mae double, rmse double, r2 double, macro_f1 double, "
                                       "train_seconds double")


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------

def score_batch(model: PipelineModel, rows: DataFrame, model_name: str,
                keep: list[str] | None = None) -> DataFrame:
    """Class, label, confidence (max probability), label -> probability map."""
    keep = keep or ["timestamp_utc", "study_area"]
    s = model.transform(rows)
    probs = vector_to_array("probability")
    names = F.array(*[F.lit(n) for n in C.CLASS_NAMES])
    # a class that the training rows do not hold has no model: probability 0
    s = s.withColumn("__q", probs)
    s = s.withColumn("__p", F.concat("__q", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(len(C.CLASS_NAMES)) - F.size("__q")))))
    return s.select(*keep,
                    F.col("prediction").cast("int").alias("predicted_class"),
                    F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_label"),
                    F.array_max("__p").alias("confidence"),
                    F.map_from_arrays(names, F.slice("__p", 1, 3)).alias("probabilities"),
                    F.transform(F.slice("__p", 1, 3), lambda p: F.round(p * 100, 1)).alias("display_pct"),
                    F.lit(C.PREDICTION_HORIZON_HOURS).alias("horizon_hours"),
                    F.lit(model_name).alias("model_name"))


def live_prediction(model: PipelineModel, features: DataFrame, readiness: DataFrame,
                    model_name: str) -> DataFrame:
    """Ready reference hours are scored; others get a not-ready row with missing lags."""
    j = features.join(readiness.withColumnRenamed("reference_hour", "timestamp_utc"), "timestamp_utc")
    ready = score_batch(model, j.filter(F.col("ready")), model_name,
                        keep=["timestamp_utc", "study_area", "ready", "missing_lags"])
    not_ready = j.filter(~F.col("ready")).select(
        "timestamp_utc", "study_area", "ready", "missing_lags",
        F.lit(None).cast("int").alias("predicted_class"), F.lit(None).cast("string").alias("predicted_label"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("map<string,double>").alias("probabilities"),
        F.lit(None).cast("array<double>").alias("display_pct"),
        F.lit(C.PREDICTION_HORIZON_HOURS).alias("horizon_hours"), F.lit(model_name).alias("model_name"))
    return ready.unionByName(not_ready)


def feature_importance_top(spark: SparkSession, model: PipelineModel, names: list[str],
                           n: int = 20) -> DataFrame:
    """K9: top features by importance (vector length = feature count, bounded)."""
    est = model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(n)


def write_predictions(scored: DataFrame, path: str) -> None:
    """Test rows with predicted class and label, as Parquet."""
    scored.write.mode("overwrite").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
