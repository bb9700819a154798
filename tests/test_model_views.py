"""A9, A10, A18 over the forest's flags and J4, J5, A26, O5, X1, X3 over the model's importance."""
import pytest

import __spark_entry__ as E
from harborline.constants import EXPLAIN_FEATURES
from harborline.plans import features as FP


def _run(spark, sf, name):
    return E.queries()[name](spark, sf).collect()


def test_anomaly_views_follow_the_forest(spark, sf):
    rows = FP.load_stage(spark, sf, "plain", anomaly="iforest").select("is_anomaly", "anomaly_score", "is_delayed", "wave_height_meters").toPandas()
    a, n = rows[rows.is_anomaly == 1], rows[rows.is_anomaly == 0]
    assert 0.03 < len(a) / len(rows) < 0.07 and a.anomaly_score.min() > n.anomaly_score.max()
    got = _run(spark, sf, "anomaly_lift_forest")[0]
    assert (got.shipments, got.anomalies) == (len(rows), len(a))
    assert got.anomaly_delay_rate == pytest.approx(a.is_delayed.mean(), abs=1e-6)
    assert got.risk_lift == pytest.approx(a.is_delayed.mean() / max(n.is_delayed.mean(), 0.001), abs=1e-5)
    diff = {r[0]: r[1] for r in _run(spark, sf, "anomaly_driver_diff_forest")}
    assert diff["wave_height_meters"] == pytest.approx(a.wave_height_meters.mean() - n.wave_height_meters.mean(), abs=1e-5)
    bins = _run(spark, sf, "anomaly_histogram_forest")
    assert bins and got != _run(spark, sf, "anomaly_lift")[0]


def test_importance_views_follow_the_model(spark, sf):
    imp = {r.feature: r.importance for r in _run(spark, sf, "permutation_importance")}
    assert len(imp) == len(FP.C.feature_list(FP.load_features(spark, sf).columns))
    top = _run(spark, sf, "top_features_model")
    assert [r.importance for r in top] == sorted(imp.values(), reverse=True)[:15]
    groups = {r.grp: r for r in _run(spark, sf, "importance_by_group_model")}
    assert sum(r.importance for r in groups.values()) == pytest.approx(sum(imp.values()), abs=1e-4)
    assert sum(r.pct for r in groups.values()) == pytest.approx(1.0, abs=1e-4)
    assert {r.feature for r in _run(spark, sf, "feature_group_lookup_model")} == set(imp)
    assert all(r.importance >= 0 for r in _run(spark, sf, "importance_by_category_model"))
    best = {r.feature: r.importance for r in top}
    aligned = {r.feature: r.importance for r in _run(spark, sf, "importance_align_model")}
    assert aligned == {c: best.get(c, 0.001) for c in EXPLAIN_FEATURES}


def test_explanations_follow_the_model(spark, sf):
    imp = {r.feature: r.importance for r in _run(spark, sf, "permutation_importance")}
    scored = FP.load_scored(spark, sf).select("shipment_id", *EXPLAIN_FEATURES).toPandas().drop_duplicates("shipment_id").set_index("shipment_id")
    most = scored.max()
    got = [r for r in _run(spark, sf, "explain_contributions_model") if r["rank"] == 1]
    assert len(got) >= len(scored)
    for r in got[:200]:
        want = max(abs(scored.loc[r.shipment_id, c]) / (most[c] + 1e-9) * imp.get(c, 0.001) for c in EXPLAIN_FEATURES)
        assert r.contribution == pytest.approx(want, abs=1e-5)
    advice = _run(spark, sf, "reroute_advice_model")
    assert advice and {r.top_feature for r in advice} <= set(imp)
