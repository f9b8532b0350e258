"""MLlib path (rows-only in the driver check): fit, score, evaluate on the smallest tables."""

from pyspark.sql import functions as F

from tidewater import config as C
from tidewater.operators import ml as ML
from tidewater.operators import metrics as MT
from tidewater.plans import model as M

SF001 = "/root/testdata/sf0.001"


def test_fit_score_evaluate(spark):
    rows = M.model_rows(spark, SF001)
    train = rows.filter(F.col("dataset_split") == "train")
    test = rows.filter(F.col("dataset_split") != "train")
    model, secs = ML.fit_candidate(ML.Candidate("rf", "forest", {"numTrees": 5, "maxDepth": 4}), train)
    assert secs >= 0
    scored = ML.score_batch(model, test, "rf").collect()
    assert len(scored) == test.count()
    for r in scored:
        probs = r.probabilities
        assert set(probs) == set(C.CLASS_NAMES)
        assert abs(sum(probs.values()) - 1.0) < 1e-9
        assert r.confidence == max(probs.values())
        assert r.predicted_label == C.CLASS_NAMES[r.predicted_class]
    m = MT.class_metrics(ML.evaluate_classifier(model, test)).first()
    assert 0.0 <= m.macro_f1 <= 1.0 and 0.0 <= m.accuracy <= 1.0
    assert ML.MacroF1Evaluator().evaluate(model.transform(test)) == m.macro_f1
    top = ML.feature_importance_top(spark, model, ML.feature_names()).collect()
    assert 0 < len(top) <= 20


def test_feature_vector_width(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    rows = M.model_rows(spark, SF001)
    p = Pipeline(stages=ML.feature_stages(scale=True)).fit(rows)
    w = p.transform(rows).select(F.size(vector_to_array("features")).alias("w")).first().w
    assert w == len(C.NUMERIC_FEATURES) + len(C.STUDY_AREAS)
    unknown = rows.limit(1).withColumn("study_area", F.lit("Nowhere"))
    v = p.transform(unknown).select(vector_to_array("features").alias("v")).first().v
    assert v[len(C.NUMERIC_FEATURES):] == [0.0] * len(C.STUDY_AREAS)
    known = p.transform(rows).select(vector_to_array("features").alias("v")).limit(50).collect()
    assert all(sorted(r.v[len(C.NUMERIC_FEATURES):])[-1] == 1.0 for r in known)      # one-hot slots are not scaled


def test_boosted_probabilities(spark):
    rows = M.model_rows(spark, SF001)
    train = rows.filter(F.col("dataset_split") == "train")
    model, _ = ML.fit_candidate(ML.Candidate("b", "boosted", {"maxIter": 3, "maxDepth": 3}), train)
    scored = ML.score_batch(model, rows.filter(F.col("dataset_split") != "train"), "b").collect()
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and r.confidence < 1 for r in scored)
    assert all(max(r.probabilities, key=r.probabilities.get) == r.predicted_label for r in scored)
    assert len({round(r.confidence, 6) for r in scored}) > 1


def test_training_queries_fit_whole_candidates(monkeypatch):
    """All iterations, trees and rounds of the reference's candidates."""
    from tidewater.plans import ml as P
    seen = {}
    monkeypatch.setattr(P, "_splits", lambda *a: (None, None, None))
    monkeypatch.setattr(ML, "train_and_validate", lambda tr, va, c: (seen.update(baselines=c), None))
    monkeypatch.setattr(ML, "tune", lambda tr, va, c: (seen.update(tuned=c), None))
    monkeypatch.setattr(ML, "train_local_models", lambda tr, va, c: seen.update(local=c))
    for query in (P.train_baselines, P.tune_models, P.train_local_models):
        query(None, "unused")
    size = {k: [c.params.get("maxIter", c.params.get("numTrees")) for c in v] for k, v in seen.items()}
    assert size["baselines"] == [1000, None, 300, 350]
    assert size["tuned"] == [300, 400, 500, 350, 450, 350, 300, 400, 250, 350, 350, 250, 300, 400, 300, 450, 400, 400, 500, 500, 500, 400]
    assert size["local"] == [300, 400, 500, 350, 400, 350, 300]
    assert [c.params["maxDepth"] for c in seen["baselines"] if "maxDepth" in c.params] == [16, 30, 7]
