"""Boosted trees: both ways of growing, a plain learner, SQL over stored nodes, and the registry."""

import glob
import math
import shutil
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilark.operators import boost, encode, risk
from vigilark.plans import models, tables
from vigilark.schema import SESSION_FEATURES
from vigilark.sources.models import ModelRegistry, data_key

FEATURES = ["a", "b", "c", "d"]


def rows_of(n=400, classes=2, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 2, n), np.round(rng.normal(size=n), 2), np.full(n, 3.0)]).astype(float)
    x[rng.random(x.shape) < 0.03] = np.nan
    signal = np.nan_to_num(x[:, 0]) / 10 + np.nan_to_num(x[:, 2]) + x[:, 1] * 1.0 + rng.normal(size=n) * 0.4
    y = np.digitize(np.nan_to_num(signal), np.quantile(np.nan_to_num(signal), np.arange(1, classes) / classes))
    weight = np.where(y == 1, 1.5, 1.0)
    return x, y, weight


def frame(spark, x, y, weight):
    rows = [([None if math.isnan(v) else float(v) for v in r], int(c), float(w)) for r, c, w in zip(x, y, weight)]
    df = spark.createDataFrame(rows, "v array<double>, y int, weight double")
    return df.select("v", "y", "weight", *[F.col("v")[i].alias(f) for i, f in enumerate(FEATURES)])


def plain_fit(x, y, weight, outputs, rounds, depth, rate, cuts):
    """Rounds of trees by trying every cut of every feature with loops; rows in, margins out."""
    margin = np.zeros((len(x), outputs))
    filled = np.where(np.isnan(x), -np.inf, x)
    for _ in range(rounds):
        e = np.exp(margin - margin.max(1, keepdims=True))
        p = 1 / (1 + np.exp(-margin)) if outputs == 1 else e / e.sum(1, keepdims=True)
        step = np.zeros_like(margin)
        for k in range(outputs):
            target = y if outputs == 1 else (y == k)
            g, h = weight * (p[:, k] - target), weight * p[:, k] * (1 - p[:, k]) * (1 if outputs == 1 else 2)

            def split(rows, left_depth):
                G, H = g[rows].sum(), h[rows].sum()
                best = (boost.LEAST_GAIN, None, None)
                for f, values in enumerate(cuts):
                    for cut in values:
                        low = filled[rows, f] <= cut
                        a, b = h[rows][low].sum(), h[rows][~low].sum()
                        if min(a, b) < boost.MIN_SLOPE:
                            continue
                        c, d = g[rows][low].sum(), g[rows][~low].sum()
                        gain = (c * c / (a + 1) + d * d / (b + 1) - G * G / (H + 1)) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
                if left_depth == 0 or best[1] is None:
                    step[rows, k] = -rate * G / (H + 1)
                    return
                low = filled[rows, best[1]] <= best[2]
                split(rows[low], left_depth - 1)
                split(rows[~low], left_depth - 1)

            split(np.arange(len(x)), depth)
        margin += step
    return margin


@pytest.mark.parametrize("classes", [1, 3])
def test_both_ways_of_growing_equal_a_plain_learner(spark, monkeypatch, classes):
    monkeypatch.setattr(boost, "FEW_ROWS", 100)
    monkeypatch.setattr(boost, "STORE_EVERY", 2)
    x, y, weight = rows_of(classes=max(2, classes))
    df = frame(spark, x, y, weight)
    cuts = boost.cut_points(df, FEATURES, 16)
    assert [len(c) for c in cuts][1] == 2 and len(cuts[0]) <= 15 and len(cuts[3]) == 1
    want = plain_fit(x, y, weight, classes, 5, 3, 0.3, cuts)
    for in_task in (0, 60, 10_000):  # levels only, both, whole trees in tasks
        model = boost.fit_boosted(df, [f"c{k}" for k in range(classes)], FEATURES, 5, 3, 0.3, 16, in_task)
        got = np.array([r[0] for r in df.select(model.margins(F.col("v"))).collect()])
        assert np.abs(got - want).max() < 1e-9
        assert model.nodes.groupBy("output", "round").count().count() == 5 * classes


def test_softmax_is_no_worse_than_one_model_per_class(spark):
    x, y, weight = rows_of(1200, 4, 7)
    weight[:] = 1.0
    df = frame(spark, x, y, weight).withColumn("part", F.monotonically_increasing_id() % 3)
    train, test = df.filter("part > 0"), df.filter("part = 0")
    soft = boost.fit_boosted(train, list("wxyz"), FEATURES, 15, 4, 0.2)
    alone = [boost.fit_boosted(train.withColumn("y", (F.col("y") == k).cast("int")), ["one"], FEATURES, 15, 4, 0.2) for k in range(4)]
    rows = test.select("y", soft.probabilities(F.col("v")).alias("soft"), *[m.probabilities(F.col("v"))[0].alias(f"p{k}") for k, m in enumerate(alone)]).collect()
    assert all(abs(sum(r.soft) - 1) < 1e-12 for r in rows)
    loss = np.mean([-math.log(r.soft[r.y]) for r in rows])
    single = np.mean([-math.log(r[f"p{r.y}"] / sum(r[f"p{k}"] for k in range(4))) for r in rows])
    assert loss <= single * 1.02 and loss < 0.8 * math.log(4)


def test_sql_over_the_stored_nodes_gives_the_same_scores(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = tables.session_features(spark, sf)
    rows = encode.encode_categoricals(raw, encode.fit_encoder(raw.filter("not is_test"))).drop("score", "iso_flag", "difficulty_level", "is_test")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for kind, model in {"risk": risk.fit_risk(rows, 6, 4), "tactics": risk.fit_tactic(encode.tactic_dataset(rows), 4, 4)}.items():
        model.save(str(tmp_path / kind))
        again = boost.load_boosted(str(tmp_path / kind))
        assert again.classes == model.classes and again.features == SESSION_FEATURES
        vector = F.array(*[F.col(f).cast("double") for f in SESSION_FEATURES])
        got = {r[0]: r[1] for r in rows.select("session_id", again.margins(vector)).collect()}
        found = duckdb.sql(f"""
WITH RECURSIVE s AS (SELECT session_id, [{', '.join(f'{f}::DOUBLE' for f in SESSION_FEATURES)}] AS v FROM read_parquet('{tmp_path}/rows/*.parquet')),
n AS (SELECT * FROM read_parquet('{tmp_path}/{kind}/nodes/*.parquet')),
w AS (SELECT session_id, v, output, round, node, "left" AS l, feature, split, value FROM s, n WHERE node = 0
 UNION ALL SELECT w.session_id, w.v, w.output, w.round, n.node, n."left", n.feature, n.split, n.value FROM w
 JOIN n ON n.output = w.output AND n.round = w.round AND n.node = w.l + CAST(w.v[w.feature + 1] > w.split AS INT) WHERE w.l <> w.node)
SELECT session_id, output, sum(value) FROM w WHERE l = node GROUP BY ALL""").fetchall()
        assert len(found) == len(got) * len(model.classes)
        assert max(abs(got[i][k] - m) for i, k, m in found) < 1e-9
        gains = duckdb.sql(f"SELECT feature, avg(gain) FROM read_parquet('{tmp_path}/{kind}/nodes/*.parquet') WHERE \"left\" <> node GROUP BY 1").fetchall()
        shares = {r.feature: r.importance for r in risk.feature_importance(again).collect()}
        total = sum(g for _, g in gains)
        assert sum(shares.values()) == pytest.approx(1) and all(shares[SESSION_FEATURES[f]] == pytest.approx(g / total) for f, g in gains)


def test_rows_that_are_not_wanted_are_not_scored(spark):
    model = models.given_model(spark, ["x", "y"])
    row = spark.createDataFrame([(i, *[float(i)] * len(SESSION_FEATURES)) for i in range(4)], ["session_id", *SESSION_FEATURES])
    got = risk.predict_tactic(model, row, F.col("session_id") > 1).orderBy("session_id").collect()
    assert [r["predicted_tactic"] is None for r in got] == [True, True, False, False]
    assert all(0.5 <= r["tactic_confidence"] <= 1 for r in got[2:])


def test_odd_training_tables(spark):
    x, y, weight = rows_of(40)
    df = frame(spark, x, y, weight)
    with pytest.raises(ValueError):
        boost.fit_boosted(df.limit(0), ["c"], FEATURES, 2, 2, 0.1)
    same = boost.fit_boosted(df.withColumn("y", F.lit(1)), ["c"], FEATURES, 2, 2, 0.1)
    assert same.nodes.filter("left <> node").count() == 0 and same.nodes.filter("value > 0").count() == 2
    empty = boost.fit_boosted(df.withColumns({f: F.lit(None).cast("double") for f in FEATURES}), ["c"], FEATURES, 1, 2, 0.1)
    assert empty.nodes.count() == 1
    shares = risk.feature_importance(empty).collect()
    assert len(shares) == 4 and all(r.importance == 0 for r in shares)


def test_registry_finds_a_model_again(spark, tmp_path):
    x, y, weight = rows_of(60)
    df = frame(spark, x, y, weight)
    registry, fits = ModelRegistry(spark, str(tmp_path / "models")), []
    assert registry.listed().count() == 0

    def wanted(data, **trees):
        def fit():
            fits.append(trees)
            return boost.fit_boosted(data, ["c"], FEATURES, **trees)
        return registry.fitted("risk", data_key(data), trees, fit, boost.Boosted.save, boost.load_boosted)

    first = wanted(df, rounds=2, depth=2, rate=0.1)
    again = wanted(df.repartition(5).orderBy("a"), rounds=2, depth=2, rate=0.1)
    assert len(fits) == 1 and sorted(map(str, first.nodes.collect())) == sorted(map(str, again.nodes.collect()))
    wanted(df, rounds=3, depth=2, rate=0.1)
    wanted(df.filter("y = 1").unionAll(df), rounds=2, depth=2, rate=0.1)
    assert len(fits) == 3 and registry.listed().count() == 3
    assert ModelRegistry(spark, str(tmp_path / "models")).path_of("risk", data_key(df), {"rounds": 2, "depth": 2, "rate": 0.1})


def test_only_the_models_asked_for_are_fitted(spark, tmp_path):
    raw = tables.session_features(spark, "/root/testdata/sf0.001")
    rows = encode.encode_categoricals(raw, encode.fit_encoder(raw)).drop("score", "iso_flag", "difficulty_level", "is_test")
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    fit = models.fitted(rows, registry=registry, kinds=["forest"])
    assert fit.forest is not None and fit.risk is None and fit.tactics is None
    assert [r.kind for r in registry.listed().collect()] == ["forest"]


def test_margins_are_renewed_once_a_round_on_blocks_that_are_held(spark, monkeypatch):
    x, y, weight = rows_of()
    added, kept = [], boost._Table.add
    monkeypatch.setattr(boost._Table, "add", lambda table, trees: (added.append((len(trees), table.rows.is_cached)), kept(table, trees)))
    boost.fit_boosted(frame(spark, x, y, weight), ["c"], FEATURES, 3, 2, 0.3, in_task=0)
    assert added == [(1, True)] * 3


def test_a_small_table_is_fitted_by_one_task(spark, monkeypatch):
    x, y, weight = rows_of()
    want = boost.fit_boosted(frame(spark, x, y, weight), ["c"], FEATURES, 3, 2, 0.3, in_task=0).nodes.orderBy("round", "node").collect()
    monkeypatch.setattr(boost._Table, "__init__", lambda *_: pytest.fail("a pass per level"))
    got = boost.fit_boosted(frame(spark, x, y, weight), ["c"], FEATURES, 3, 2, 0.3).nodes.orderBy("round", "node").collect()
    assert [(r.node, r.feature, r.split, r.left) for r in got] == [(r.node, r.feature, r.split, r.left) for r in want]
    assert max(abs(a.value - b.value) for a, b in zip(got, want)) < 1e-12


@pytest.mark.parametrize("direct", [0, 1 << 26])
def test_blocks_that_are_lost_are_made_again(spark, monkeypatch, direct):
    monkeypatch.setattr(boost, "FEW_ROWS", 100)
    monkeypatch.setattr(boost, "STORE_EVERY", 2)
    monkeypatch.setattr(boost, "DIRECT", direct)
    x, y, weight = rows_of(classes=3)
    fit = lambda: boost.fit_boosted(frame(spark, x, y, weight), list("xyz"), FEATURES, 6, 3, 0.3, in_task=0).nodes.orderBy("output", "round", "node").collect()
    want, held, sums, calls = fit(), [], boost._Table._sums, []

    def losing(table, step, nodes):
        calls.append(step.level)
        places = table.rows.collect()
        held.append(max(len(str(place)) for place in places))
        if len(calls) in (2, 11):  # in the first round, and after several
            shutil.rmtree(places[-1][2])
        return sums(table, step, nodes)

    monkeypatch.setattr(boost._Table, "_sums", losing)
    got = fit()
    assert max(held) < 500 and not [p for p in glob.glob(f"{tempfile.gettempdir()}/vigilark-boost-*")]
    assert [(r.node, r.feature, r.split, r.left) for r in got] == [(r.node, r.feature, r.split, r.left) for r in want]
    assert max(abs(a.value - b.value) for a, b in zip(got, want)) < 1e-9


def test_cuts_are_exact_quantiles_of_counted_values(spark, monkeypatch):
    values = [float(i % 200) for i in range(4000)] + [None] * 7 + [float("nan")] * 5
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "a double, b double").repartition(3)
    cuts, wide = boost.cut_points(df, ["a", "b"], 16)
    assert cuts.tolist() == [float(math.ceil(4000 * i / 16 / 20) - 1) for i in range(1, 16)]
    monkeypatch.setattr(boost, "COUNTED", 10)
    rough = boost.cut_points(df, ["a", "b"], 16)
    assert len(rough[0]) == len(wide) == 15 and np.abs(rough[1] - wide).max() <= 4012 / 16 / 50 + 1
