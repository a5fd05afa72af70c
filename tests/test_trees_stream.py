"""Tree-ensemble scoring against an independent traversal; streaming parity with batch."""
import json
import math


from dwellframe.operators import trees as TR
from dwellframe.streaming import intake as SI
from conftest import SF_SMALL


def _walk(tree, feats, row):
    node = 0
    while not (tree["left_children"][node] == -1 and tree["right_children"][node] == -1):
        x = row[feats[tree["split_indices"][node]]]
        if x is None or (isinstance(x, float) and math.isnan(x)):
            left = tree["default_left"][node] == 1
        else:
            left = x < tree["split_conditions"][node]
        node = tree["left_children"][node] if left else tree["right_children"][node]
    return tree["base_weights"][node]


def test_toy_model_scores(spark):
    doc = json.loads(TR.toy_model_text())["learner"]
    feats = doc["feature_names"]
    rows = [(1, 22.0, 3, 55.0, 100.0), (2, 30.0, 6, None, 300.0), (3, None, 2, 70.0, float("nan")), (4, 24.5, 4, 45.0, 250.0)]
    df = spark.createDataFrame(rows, "patient_id int, bmi double, charlson_index int, age double, residual_rf double")
    ens = TR.Ensemble.load(spark)
    got = {r.patient_id: r for r in ens.score(df).collect()}
    margin = math.log(0.5 / 0.5)
    for pid, *vals in rows:
        row = dict(zip(feats, vals))
        raw = [margin, margin]
        for t, cls in zip(doc["gradient_booster"]["model"]["trees"], doc["gradient_booster"]["model"]["tree_info"]):
            raw[cls] += _walk(t, feats, row)
        m = max(raw)
        e = [math.exp(v - m) for v in raw]
        probs = [v / sum(e) for v in e]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[pid].probs, probs))
        assert got[pid].pred_class == probs.index(max(probs))
    arrow = {r.patient_id: r.raw_scores for r in ens.score_arrow(df).collect()}
    assert all(abs(a - b) < 1e-12 for pid in arrow for a, b in zip(arrow[pid], got[pid].raw_scores))


def test_base_margin():
    assert TR.base_margin(0.5) == 0.0 and TR.base_margin(2.0) == 2.0 and TR.base_margin(float("nan")) == 0.0


def test_stream_intake_matches_batch(spark):
    osm, labs = SI.static_aggregates(spark, SF_SMALL)
    out = SI.derive_and_validate(SI.intake_records(spark, SF_SMALL), osm, labs)
    assert out.isStreaming
    path = SI.run_to_files(out, "test_intake")
    from dwellframe.sources import views
    assert spark.read.parquet(path).count() == views.view(spark, SF_SMALL, "cohort").count()
