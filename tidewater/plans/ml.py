"""Registered queries: MLlib training, tuning, scoring (rows-only checks: model fits
are not SQL).  Baselines, tuning and local models fit every candidate of the full lists over all rows, with all rounds and
trees; ``train_regressor`` takes ``SHARE`` of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import livefeatures as LF
from ..operators import ml as ML
from ..session import staged
from .model import complete_rows, live_hourly, model_rows, refs
from .registry import register

SCORED = ML.Candidate("RandomForest_20", "forest", {"numTrees": 20, "maxDepth": 8})     # the model of the scoring queries


SHARE = 0.005   # of the rounds and trees of the full regression candidates


def _splits(spark, sf):
    rows = staged(model_rows(spark, sf), "model-rows")      # made once; each split, and each pass of a fit, reads it
    return (rows.filter(F.col("dataset_split") == "train"), rows.filter(F.col("dataset_split") == "validation"),
            rows.filter(F.col("dataset_split") == "test"))


def _best_forest(spark, sf):
    train, _, _ = _splits(spark, sf)
    model, _ = ML.fit_candidate(SCORED, train)
    return model


@register("feature_pipeline")
def feature_pipeline(spark, sf):
    """M1: indexer + one-hot (unknown kept) + assembler + scaler over the model table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    train, _, _ = _splits(spark, sf)
    m = Pipeline(stages=ML.feature_stages(scale=True)).fit(train)
    out = m.transform(model_rows(spark, sf))
    return out.select("timestamp_utc", "study_area", F.size(vector_to_array("features")).alias("width"))


@register("train_baselines")
def train_baselines(spark, sf):
    """M2: majority, logistic (balanced), tree, forest, boosted trees; validation metrics and time."""
    train, valid, _ = _splits(spark, sf)
    res, _ = ML.train_and_validate(train, valid, ML.baseline_candidates())
    return res


@register("tune_models")
def tune_models(spark, sf):
    """M3: all 22 candidates of three families, ranked by validation macro F1."""
    train, valid, _ = _splits(spark, sf)
    ranked, _ = ML.tune(train, valid, ML.tuning_candidates())
    return ranked


@register("train_local_models")
def train_local_models(spark, sf):
    """M4: one model per area (centroids dropped), best by validation macro F1."""
    train, valid, _ = _splits(spark, sf)
    return ML.train_local_models(train, valid, ML.local_candidates())


@register("train_regressor")
def train_regressor(spark, sf):
    """M5: count regressors; MAE / RMSE / R2 and macro F1 of the derived class."""
    train, _, test = _splits(spark, sf)
    thr = FT.area_thresholds(complete_rows(spark, sf))
    return ML.train_regressors(train, test, thr, ML.regressor_candidates(SHARE))


@register("score_batch")
def score_batch(spark, sf):
    """Class, label, confidence and probability map for the test rows."""
    _, _, test = _splits(spark, sf)
    return ML.score_batch(_best_forest(spark, sf), test, "RandomForest_20")


@register("write_predictions")
def write_predictions(spark, sf):
    """The scored test rows (the caller writes them with ``ML.write_predictions``)."""
    _, _, test = _splits(spark, sf)
    s = ML.score_batch(_best_forest(spark, sf), test, "RandomForest_20",
                       keep=["timestamp_utc", "study_area", "traffic_level_numeric", "traffic_level"])
    return s.select("timestamp_utc", "study_area", "traffic_level_numeric", "traffic_level",
                    "predicted_class", "predicted_label")


@register("live_prediction")
def live_prediction(spark, sf):
    """Readiness + live features + scoring for every reference hour."""
    hourly = live_hourly(spark, sf)
    r = refs(spark)
    feats = LF.live_feature_rows(spark, hourly, r)
    ready = LF.history_readiness(hourly, r)
    return ML.live_prediction(_best_forest(spark, sf), feats, ready, "RandomForest_20")


@register("feature_importance_top")
def feature_importance_top(spark, sf):
    """K9: top 20 features of the forest by importance."""
    return ML.feature_importance_top(spark, _best_forest(spark, sf), ML.feature_names())

