"""Metrics, models and reports."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.columns import risk_band
from vigilark.operators import forest, metrics, ranking, smote
from vigilark.schema import SESSION_FEATURES, WINDOW_FEATURES, ColumnContractError, require_session_features, schema_matches
from vigilark.sources import reports


def test_auc_and_quantiles_with_ties(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    score = np.round(rng.random(500) * 0.6 + 0.3 * y, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, score double")
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert ranking.roc_auc(df).first()["auc"] == pytest.approx(want)
    row = ranking.exact_quantiles(df, "score", {"a": 0.25, "b": 0.9}).first()
    assert (row["a"], row["b"]) == pytest.approx(tuple(np.quantile(score, [0.25, 0.9])))
    assert ranking.roc_auc(df.filter("y = 1")).first()["auc"] is None


@pytest.mark.parametrize("outer", [1, 4, 512])
@pytest.mark.parametrize("kind", ["double", "int", "decimal(12,4)"])
def test_running_totals_over_two_levels_of_ranges(spark, monkeypatch, outer, kind):
    monkeypatch.setattr(ranking, "OUTER_RANGES", outer)
    rng = np.random.default_rng(3)
    values = np.unique(np.round(np.exp(rng.normal(size=900) * 3) * 10))
    rows = [(float(v), int(n), int(m)) for v, n, m in zip(values, rng.integers(0, 9, len(values)), rng.integers(0, 2, len(values)))]
    df = spark.createDataFrame(rows, "v double, n bigint, m bigint").withColumn("v", F.col("v").cast(kind)).repartition(5)
    assert ranking._placed(df, "v", 30).select("_outer", "_inner").distinct().count() > 20
    got = {float(r["v"]): (r["n_before"], r["m_before"]) for r in ranking.running_totals(df, "v", ["n", "m"], 20).collect()}
    n = m = 0
    for v, own_n, own_m in rows:
        assert got.pop(v) == (n, m)
        n, m = n + own_n, m + own_m
    assert not got
    assert ranking.running_totals(df.limit(0), "v", ["n"], 20).count() == 0


def test_risk_bands(spark):
    values = [-0.1, 0.0, 0.19, 0.2, 0.5, 0.8, 1.0, 1.01, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(risk_band(F.col("v")))
    assert [r[0] for r in df.collect()] == [
        "unknown", "low", "low", "medium", "high", "critical", "critical", "unknown", "unknown", "unknown"]


def test_decision_boundaries(spark):
    df = spark.createDataFrame([(0.3, 0), (0.25, 0), (0.1, 1), (0.9, 1)], "score double, iso_flag int")
    got = [tuple(r)[2:] for r in metrics.ensemble_decision(df).collect()]
    assert got == [(1, 0), (0, 0), (1, 1), (1, 0)]
    assert metrics.ensemble_decision(df, iso_flag=None).agg(F.sum("is_attack")).first()[0] == 2
    sweep = metrics.threshold_sweep(spark.createDataFrame([(1, 0.3)], "y int, score double"))
    assert sweep.filter("threshold = 0.3").first()["recall"] == 1.0


def test_confusion_cells_sum_to_rows_and_empty_input(spark):
    df = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(41)], "y int, is_attack int")
    assert sum(metrics.confusion_matrix(df).first()) == 41
    none = df.filter("false")
    assert sum(metrics.confusion_matrix(none).first()) == 0
    assert metrics.detection_rates(none).first()["recall"] is None
    assert metrics.prioritisation_coherence(none.select(
        F.lit("x").alias("risk_band"), F.lit("x").alias("predicted_tactic"), F.lit(1.0).alias("tactic_confidence")
    )).first()["critical_with_tactic_share"] is None


def test_schema_contract(spark):
    row = spark.createDataFrame([tuple([1.0] * 41)], SESSION_FEATURES)
    assert require_session_features(row.select(*reversed(SESSION_FEATURES))).columns == SESSION_FEATURES
    assert schema_matches(row) and not schema_matches(row.select(*reversed(SESSION_FEATURES)))
    with pytest.raises(ColumnContractError, match="duration is missing"):
        require_session_features(row.drop("duration"))
    live = spark.createDataFrame([tuple([1.0] * 16)], WINDOW_FEATURES)
    with pytest.raises(ColumnContractError, match="are window features"):
        require_session_features(live)
    with pytest.raises(ColumnContractError, match="flag is not numeric"):
        require_session_features(row.withColumn("flag", F.lit("SF")))


def test_forest_finds_the_outlier_and_survives_storage(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    x[0] = 12.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vector array<double>")
    grown = forest.fit_vectors(df, "id", 40, 64, 0.05, 42, ["a", "b", "c", "d"])
    scores = {r["id"]: r["s"] for r in df.select("id", grown.scores(F.col("vector")).alias("s")).collect()}
    assert scores[0] == max(scores.values()) and scores[0] > 0.6 > sorted(scores.values())[300]
    flagged = df.select(grown.flags(F.col("vector")).alias("f")).agg(F.sum("f")).first()[0]
    assert 0.03 * 600 <= flagged <= 0.06 * 600
    grown.save(str(tmp_path / "forest"))
    again = forest.load_forest(str(tmp_path / "forest"))
    same = df.select("id", again.scores(F.col("vector")).alias("s")).collect()
    assert all(scores[r["id"]] == r["s"] for r in same)
    assert forest.load_forest(str(tmp_path / "none")) is None


def test_smote_exact_neighbours_and_segments(spark):
    rng = np.random.default_rng(4)
    points = {i: rng.normal(size=3) for i in range(40)}
    rows = [(("a" if i < 25 else "b"), i, [float(v) for v in p]) for i, p in points.items()]
    df = spark.createDataFrame(rows, "label string, id bigint, features array<double>")
    found = smote.nearest_in_class(df, {"a": 25, "b": 15}, 4, block_rows=6)
    for r in found.collect():
        mates = range(25) if r["label"] == "a" else range(25, 40)
        near = sorted((float(((points[j] - points[r["id"]]) ** 2).sum()), j) for j in mates if j != r["id"])[:4]
        assert [n["near_id"] for n in r["neighbours"]] == [j for _, j in near]
    made = smote.smote_oversample(df, {"b": 50}, 4, block_rows=6)
    counts = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    assert counts == {"a": 25, "b": 50}
    for r in made.filter("synthetic").collect():
        base, p = points[r["id"]], np.array(r["features"])
        off = [np.linalg.norm(p - base) + np.linalg.norm(points[j] - p) - np.linalg.norm(points[j] - base) for j in range(25, 40)]
        assert min(off) < 1e-9
    for bad in ({"a": 10}, {"c": 10}):
        with pytest.raises(ValueError):
            smote.smote_oversample(df, bad)


def test_blocks_are_measured_in_bounded_memory(monkeypatch):
    """Blocks of rows of one place may be many times a usual block; distances and copies are held a few rows at a time."""
    rng = np.random.default_rng(7)
    features = rng.normal(size=(4000, 4))
    features[500:700] = features[500]  # copies
    left = pd.DataFrame({"label": "a", "id": np.arange(2000), "features": list(features[:2000])})
    right = pd.DataFrame({"other_id": np.arange(4000)[::-1], "other_features": list(features[::-1])})
    tracemalloc.start()
    found = smote._best_of_blocks(left, right, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6, peak
    monkeypatch.setattr(smote, "DISTANCES", 1 << 30)
    whole = smote._best_of_blocks(left, right, 5)
    assert found.drop(columns="near").equals(whole.drop(columns="near")) and len(found) == 10_000
    assert (np.stack(found["near"]) == np.stack(whole["near"])).all()


@pytest.mark.parametrize("kind", ["mixed scales", "clusters"])
def test_curves_find_most_neighbours(spark, monkeypatch, kind):
    """Recall against exact neighbours; a third of the second class is one vector."""
    monkeypatch.setattr(smote, "FITTED_ROWS", 500)
    rng = np.random.default_rng(8)
    n, d, k = 4000, 12, 5
    if kind == "clusters":
        features = rng.normal(size=(25, d))[rng.integers(0, 25, n)] * 4 + rng.normal(size=(n, d)) * 0.3
    else:
        features = rng.normal(size=(n, 4)) @ rng.normal(size=(4, d)) * (10.0 ** rng.uniform(0, 2, d)) + rng.normal(size=(n, d)) * 0.1
    labels = np.where(np.arange(n) < 2500, "a", "b")
    features[2500:3000] = features[2500]
    rows = [(str(c), i, f.tolist()) for i, (c, f) in enumerate(zip(labels, features))]
    df = spark.createDataFrame(rows, "label string, id bigint, features array<double>")
    got = {r["id"]: [x["distance"] for x in r["neighbours"]] for r in smote.near_in_class(
        df, {"a": 2500, "b": 1500}, k, block_rows=100).collect()}
    assert len(got) == n and all(len(v) == k and v == sorted(v) for v in got.values())
    hits = 0
    for own in range(0, n, 7):
        mates = np.flatnonzero((labels == labels[own]) & (np.arange(n) != own))
        limit = np.sort(((features[mates] - features[own]) ** 2).sum(1))[k - 1] + 1e-9
        hits += sum(x <= limit for x in got[own])
    recall = hits / (k * len(range(0, n, 7)))
    assert recall >= 0.9, recall


def test_large_classes_are_oversampled_by_curves(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("a" if i < 300 else "b", i, rng.normal(size=3).tolist()) for i in range(340)]
    df = spark.createDataFrame(rows, "label string, id bigint, features array<double>")
    monkeypatch.setattr(smote, "EXACT_ROWS", 100)
    made = smote.smote_oversample(df, {"a": 450, "b": 60}, 4)
    assert {r["label"]: r["count"] for r in made.groupBy("label").count().collect()} == {"a": 450, "b": 60}
    assert sorted(map(str, made.collect())) == sorted(map(str, smote.smote_oversample(df.repartition(5), {"a": 450, "b": 60}, 4).collect()))


def test_nothing_to_oversample_keeps_the_rows(spark):
    rows = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(6)], "label string, id long, features array<double>")
    grown = smote.smote_oversample(rows, {}).collect()
    assert sorted((r.id, r.features, r.synthetic) for r in grown) == [(i, [float(i), 1.0], False) for i in range(6)]


def test_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    assert reports.latest_report(spark, path, reports.VALIDATION_REPORT).count() == 0
    rates = spark.sql("SELECT CAST(NULL AS DOUBLE) AS recall, 0.123456D AS false_positive_rate")
    coherence = spark.sql("SELECT 0L AS critical_alerts, CAST(NULL AS DOUBLE) AS critical_with_tactic_share, CAST(NULL AS DOUBLE) AS avg_confidence")
    reports.write_report(reports.validation_row(rates, coherence), path)
    row = reports.latest_report(spark, path, reports.VALIDATION_REPORT).first()
    assert row["detection_rate"] is None and row["false_positive_rate"] == 0.1235 and row["age_seconds"] >= 0


def test_label_map():
    assert len(dims.TACTIC_OF_LABEL) == 39 and set(dims.TACTIC_OF_LABEL.values()) == set(dims.TACTICS)
