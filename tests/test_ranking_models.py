import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketloom.operators import ranking
from marketloom.plans import evaluate, forecast_run, interpret, model_frame as mf, train, score
from marketloom.session import scratch_path
from marketloom.sources.schemas import RETURN_TARGET


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.5]), st.floats(-1e6, 1e6)), min_size=0, max_size=60),
       st.sampled_from([0.0, 0.05, 0.5, 0.95, 1.0]))
def test_exact_quantiles_match_numpy(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None]
    got = ranking.exact_quantiles(df, ["x"], p)["x"]
    assert got == (pytest.approx(np.quantile(known, p), rel=1e-9, abs=1e-9) if known else None)


def test_exact_quantiles_narrow_in_passes(spark, monkeypatch):
    """A third of the rows share one value, the rest is heavy-tailed; small limits force several passes."""
    monkeypatch.setattr(ranking, "SMALL_ENOUGH", 10)
    monkeypatch.setattr(ranking, "BINS", 8)
    monkeypatch.setattr(ranking, "SKETCH_SIZE", 16)
    rng = np.random.default_rng(1)
    x = np.r_[np.zeros(2000), np.exp(rng.normal(0, 6, 4001))]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x, "z": np.full(len(x), 7.0)})).repartition(6)
    got = ranking.exact_quantiles(df, ["x", "y", "z"], 0.5)
    assert got["x"] == np.median(x) and got["y"] == np.median(-x) and got["z"] == 7.0
    assert ranking.exact_quantiles(df, ["x"], 0.25)["x"] == 0.0
    assert ranking.exact_quantiles(df, ["x"], 0.99)["x"] == pytest.approx(np.quantile(x, 0.99), rel=1e-12)


def test_exact_quantiles_take_two_scans(spark, monkeypatch):
    """Sketches bracket the ranks; one more pass finds them, whatever is missing, repeated or infinite. A bracket beside the rank costs a pass only."""
    rng, passes, counted = np.random.default_rng(4), [], ranking._counted
    monkeypatch.setattr(ranking, "_counted", lambda values, spans, keep: (passes.append(len(spans)) if spans else None) or counted(values, spans, keep))
    x = rng.normal(size=30_000)
    y = np.where(rng.random(30_000) < 0.3, np.nan, np.round(x, 1))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "c": np.full(30_000, 2.5), "none": np.full(30_000, np.nan)})).repartition(5)
    got = ranking.exact_quantiles(df, ["x", "y", "c", "none"], 0.5)
    assert got == {"x": np.median(x), "y": np.nanmedian(y), "c": 2.5, "none": None} and len(passes) == 1
    wrong = [dict(column="x", rank=r, n=1, lo=9.0, hi=9.0) for r in ranking._ranks(30_000, 0.5)]
    monkeypatch.setattr(ranking, "_bracketed", lambda *_: ({"x": 30_000}, wrong))
    assert ranking.exact_quantiles(df, ["x"], 0.5)["x"] == np.median(x)
    assert ranking.exact_quantiles(df.where("x is null"), [], 0.5) == {}


def test_dense_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ranking.dense_row_number(df, ["k"], "n").collect()
    assert all(r.n == r.k + 1 for r in got) and len(got) == 1000


def frame(spark, assets, days):
    return spark.range(assets * days).select(
        (F.col("id") % assets).alias("asset_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") / assets).cast("int")).alias("feature_date"))


@pytest.mark.parametrize("assets,days", [(1, 10), (1, 70), (3, 50), (7, 31), (40, 3)])
def test_holdout_is_a_prefix_of_the_order(spark, assets, days):
    df = frame(spark, assets, days)
    got = [r.t for r in df.withColumn("t", evaluate.train_flag(df)).orderBy("feature_date", "asset_id").collect()]
    n = assets * days
    split = min(max(60, int(n * 0.8)), n - 1)
    assert got == [True] * split + [False] * (n - split)


def test_row_folds(spark):
    df = frame(spark, 3, 45)  # 135 rows: two complete test windows
    folds = evaluate.fold_table(evaluate.fold_blocks(df, "rows")).orderBy("fold").collect()
    assert [(r.fold, r.train_rows, r.test_rows) for r in folds] == [(1, 80, 20), (2, 100, 20)]


def ridge(x, y, alpha):
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    penalty = alpha * np.eye(z.shape[1])
    penalty[0, 0] = 0
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    return lambda new: np.c_[np.ones(len(new)), (new - mean) / std] @ beta, beta[1:]


def model_data(spark, n=200):
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(size=(n, 3)) * [1, 50, 0.01], np.full(n, 4.0)]
    y = x @ [0.3, 0.01, 5, 0] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, asset_id=np.arange(n) % 2)
    pdf["feature_date"] = [dt.date(2024, 1, 1) + dt.timedelta(days=i // 2) for i in range(n)]
    pdf[RETURN_TARGET] = pdf.y
    return pdf, spark.createDataFrame(pdf)


def test_ridge_equals_the_closed_form(spark):
    pdf, df = model_data(spark)
    model = train.fit_ridge(train.with_vector(df, list("abcd")).withColumn("label", F.col("y")))
    predict, beta = ridge(pdf[list("abcd")].to_numpy(), pdf.y.to_numpy(), 2.0)
    got = np.array([r.prediction for r in model.transform(train.with_vector(df, list("abcd"))).orderBy("feature_date", "asset_id").collect()])
    np.testing.assert_allclose(got, predict(pdf[list("abcd")].to_numpy()), rtol=1e-9, atol=1e-9)


def test_fold_ridge_equals_refitting(spark):
    pdf, df = model_data(spark)
    got = {r.fold: r for r in evaluate.ridge_fold_metrics(evaluate.fold_blocks(df, "rows"), list("abcd")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    x, y = pdf[list("abcd")].to_numpy(), pdf.y.to_numpy()
    for fold in got:
        end = 80 + 20 * (fold - 1)
        p = ridge(x[:end], y[:end], 2.0)[0](x[end:end + 20])
        assert got[fold].mae == pytest.approx(np.abs(y[end:end + 20] - p).mean(), rel=1e-8)


def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (1, 0.6)], "label int, score double")
    m = evaluate.classification_metrics(df)
    assert m["accuracy"] == pytest.approx(0.6) and m["precision"] == pytest.approx(2 / 3) and m["recall"] == pytest.approx(2 / 3)
    assert m["roc_auc"] == pytest.approx(3.5 / 6)
    one_class = evaluate.classification_metrics(df.where("label = 1"))
    assert one_class["roc_auc"] is None
    assert evaluate.classification_metrics(df.withColumn("score", F.lit(0.1)))["precision"] == 0.0


def test_donors_are_one_cycle_in_hash_order(spark):
    """The same permutation however the rows are ranged: each row takes the next in hash order, the last the first."""
    df = train.with_vector(frame(spark, 4, 100).withColumn("x", F.col("asset_id") * 1000.0 + F.dayofyear("feature_date")), ["x"])
    keyed = df.withColumn("h", F.xxhash64(F.lit(42), "asset_id", "feature_date")).orderBy("h", "asset_id", "feature_date").select("x").collect()
    cycle = [r.x for r in keyed]
    want = set(zip(cycle, cycle[1:] + cycle[:1]))
    for parts in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = interpret.with_donor(df).select("x", vector_to_array("donor")[0].alias("d")).collect()
        assert {(r.x, r.d) for r in rows} == want and len(rows) == 400
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_importance_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    n = 300
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n), "asset_id": np.arange(n)})
    pdf["label"] = 3 * pdf.a - pdf.b
    df = train.with_vector(spark.createDataFrame(pdf).withColumn("feature_date", F.lit(dt.date(2024, 1, 1))), ["a", "b", "c"])
    model = train.fit_ridge(df)
    got = {r.feature: r.importance for r in interpret.permutation_importance(model, df, ["a", "b", "c"]).collect()}
    rows = interpret.with_donor(df).select("label", vector_to_array("features").alias("x"), vector_to_array("donor").alias("d")).collect()
    x, d, y = (np.array([r[k] for r in rows]) for k in ("x", "d", "label"))

    def rmse(z):
        return np.sqrt(((y - z @ model.coefficients.toArray() - model.intercept) ** 2).mean())
    for j, name in enumerate("abc"):
        z = x.copy()
        z[:, j] = d[:, j]
        assert got[name] == pytest.approx(max(rmse(z) - rmse(x), 0), abs=1e-9)
    assert "Generate" not in interpret.permutation_importance(model, df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString().split("Aggregate", 1)[1]


def test_importance_finds_the_informative_feature(spark):
    rng = np.random.default_rng(0)
    n = 600
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "asset_id": np.arange(n)})
    pdf["label"] = 3 * pdf.a
    df = train.with_vector(spark.createDataFrame(pdf).withColumn("feature_date", F.lit(dt.date(2024, 1, 1))), ["a", "b"])
    model = train.fit_forest_regressor(df)
    got = {r.feature: r.importance for r in interpret.permutation_importance(model, df, ["a", "b"]).collect()}
    assert got["a"] > 1 > got["b"] >= 0


@pytest.mark.parametrize("settings", [{}, {"numTrees": 3, "maxDepth": 10, "minInstancesPerNode": 1}])
def test_forest_importance_equals_transforms(spark, settings):
    """A forest is scored from its splits in one pass, as its transform scores it; trees of more than a word of leaves go through the transform."""
    rng = np.random.default_rng(3)
    n, names = 500, ["a", "b", "c", "flat"]
    pdf = pd.DataFrame({**{c: rng.normal(size=n) for c in "abc"}, "flat": 1.0, "asset_id": np.arange(n), "feature_date": dt.date(2024, 1, 1)})
    pdf["label"] = np.sin(3 * pdf.a) + pdf.b * pdf.c
    df = train.with_vector(spark.createDataFrame(pdf), names)
    model = train.fit_forest_regressor(df, **settings)
    found = interpret.permutation_importance(model, df, names)
    trees = interpret.forest_table(model)
    assert (trees is None) == bool(settings) and ("MapInArrow" in found._jdf.queryExecution().executedPlan().toString()) == (trees is not None)
    got = {r.feature: r.importance for r in found.collect()}
    rows = interpret.with_donor(df).select("label", vector_to_array("features").alias("x"), vector_to_array("donor").alias("d")).collect()
    x, d, y = (np.array([r[k] for r in rows]) for k in ("x", "d", "label"))

    def rmse(z):
        p = model.transform(train.with_vector(spark.createDataFrame(pd.DataFrame(z, columns=names).assign(y=y)), names)).select("y", "prediction").toPandas()
        return np.sqrt(((p.y - p.prediction) ** 2).mean())
    for j, name in enumerate(names):
        z = x.copy()
        z[:, j] = d[:, j]
        assert got[name] == pytest.approx(max(rmse(z) - rmse(x), 0), abs=1e-12)
    assert got["a"] > 0 and got["flat"] == 0


def test_pillar_shares():
    shares = {r["pillar"]: r["weight"] for r in interpret.pillar_shares({"momentum_5d": -3.0, "risk_score": 1.0, "volume": 9.0}, "weight")}
    assert shares == {"history": 0.75, "risk": 0.25, "sentiment": 0.0}


@pytest.fixture(scope="module")
def universe(spark):
    bars, news = [], []
    for asset, phase in ((1, 0.0), (2, 0.7)):
        for i, d in enumerate(pd.bdate_range("2024-01-02", periods=180)):
            p = round(100 + 0.12 * i + 2.5 * math.sin(i / 9 + phase) + 0.7 * math.cos(i / 5), 4)
            bars.append((asset, f"A{asset}", d.date(), p, p + 1, p - 1, p, p, p, int(1_000_000 + 2_500 * i + 15_000 * abs(math.sin(i / 11)))))
            if i % 5 == 0:
                s = round(math.sin(i / 5 / 4 + phase), 4)
                news.append((asset, d.to_pydatetime(), s, "positive" if s >= 0.15 else "negative" if s <= -0.15 else "neutral", "feed"))
    return (spark.createDataFrame(bars, "asset_id long, ticker string, price_date date, open_price double, high_price double, low_price double, "
                                        "close_price double, adjusted_close double, analysis_price double, volume long"),
            spark.createDataFrame(news, "asset_id long, published_at timestamp, sentiment_score double, sentiment_label string, source_name string"),
            spark.createDataFrame([(1, "A1"), (2, "A2")], "asset_id long, ticker string"))


def test_forecast_run_end_to_end(spark, universe):
    bars, news, assets = universe
    root = scratch_path(spark, "run")
    run = forecast_run.run_forecast(spark, root, bars, news, assets, dt.datetime(2024, 12, 1), forest_folds=1)
    rows = run["predictions"].collect()
    assert len(rows) == 2 and {r.as_of_date for r in rows} == {dt.date(2024, 9, 9)}
    for r in rows:
        assert 0 <= r.probability_positive_20d <= 1 and 0 <= r.confidence_score <= 1 and -100 <= r.composite_ml_score <= 100
        assert r.probability_positive_20d + r.downside_probability_20d == pytest.approx(1)
        assert abs(r.predicted_return_20d) <= 0.6 and r.model_run_id == run["run_id"]
        assert r.top_features_json.count('"absolute_contribution"') == 8 and r.pillar_weights_json.count("pillar") == 3
    result = run["training"]
    assert len(result.features) == 62 and result.row_counts["total_rows"] == 360
    assert set(result.holdout["regression"]) == {"ridge_regression", "random_forest_regressor"}
    assert len(result.expanding["refitted_folds"]) == 1 and sum(w["weight"] for w in result.pillar_weights) == pytest.approx(1)
    # weights in standardized units against the closed form
    frame_, features, _ = train.prepare(spark.read.parquet(f"{root}/technical_features").join(
        spark.read.parquet(f"{root}/sentiment_features").drop("batch_id", "writer"), ["asset_id", "feature_date"], "left").join(assets, "asset_id"))
    pdf = frame_.where(F.col(RETURN_TARGET).isNotNull()).toPandas()
    _, beta = ridge(pdf[features].to_numpy(float), pdf[RETURN_TARGET].to_numpy(float), 2.0)
    np.testing.assert_allclose([result.ridge_weights[f] for f in features], beta, rtol=1e-5, atol=1e-8)


def test_stored_run_scores_without_a_fit(spark, universe, monkeypatch):
    """Models, medians and scales are read back: the same rows, though every fit is an error."""
    bars, news, assets = universe
    from marketloom.plans.feature_store import feature_store_frames
    rows = feature_store_frames(bars, news)["training_frame"].persist()
    result, root = train.fit_models(rows), scratch_path(spark, "stored")
    train.save_result(spark, result, forecast_run.run_path(root, "r1"))
    want = sorted(map(str, score.predict(rows, result, dt.datetime(2024, 12, 1), run_id="r1").collect()))

    def no_fit(*_):
        raise AssertionError("fitted")
    monkeypatch.setattr(train, "MODEL_FACTORIES", {"regression": {"ridge_regression": no_fit}, "classification": {}})
    other = spark.newSession()
    got = forecast_run.predict_from_run(other, root, "r1", rows, dt.datetime(2024, 12, 1)).collect()
    assert sorted(map(str, got)) == want and len(want) == 2
    loaded = train.load_result(spark, forecast_run.run_path(root, "r1"))
    assert loaded.start_date == result.start_date and loaded.importances == result.importances and loaded.medians == result.medians


def test_registered_challenger_is_evaluated_and_scores(spark, universe):
    """A gradient-boosted regressor beside the others shows up in holdout, folds and predictions."""
    from pyspark.ml.regression import GBTRegressor
    from marketloom.plans.feature_store import feature_store_frames
    bars, news, _ = universe
    rows = feature_store_frames(bars, news)["training_frame"].persist()
    small = dict(train.FOREST, numTrees=3, maxDepth=2)
    registry = {"regression": {"ridge_regression": train.fit_ridge, "boosted_trees": lambda f: GBTRegressor(maxIter=3, maxDepth=2, seed=1).fit(f)},
                "classification": {"random_forest_classifier": lambda f: train.fit_forest_classifier(f, **small)}}
    result = train.train_models(rows, forest_folds=1, registry=registry, selected={"comparison": "boosted_trees"})
    assert set(result.holdout["regression"]) == {"ridge_regression", "boosted_trees"} and result.holdout["regression"]["boosted_trees"]["rmse"] > 0
    assert result.expanding["regression"]["boosted_trees"]["folds"] == 1 and result.expanding["refitted_folds"][0]["regression"]["boosted_trees"]["mae"] > 0
    assert score.predict(rows, result, dt.datetime(2024, 12, 1)).count() == 2


def test_metrics_of_groups_equal_those_of_one(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(y), float(np.round(s, 1))) for g in range(4) for y, s in zip(rng.integers(0, 2, 60) if g else np.ones(60), rng.random(60))]
    df = spark.createDataFrame(rows, "fold int, label int, score double")
    for r in evaluate.classification_metrics_by(df, ["fold"]).collect():
        one = evaluate.classification_metrics(df.where(F.col("fold") == r.fold))
        assert {k: v for k, v in r.asDict().items() if k != "fold"} == {k: pytest.approx(v) if v is not None else None for k, v in one.items()}


def test_training_is_deterministic(spark, universe):
    bars, news, _ = universe
    from marketloom.plans.feature_store import feature_store_frames
    rows, features, _ = train.prepare(feature_store_frames(bars, news)["training_frame"])
    v = train.classification_rows(train.with_vector(rows, features))
    score = [train.probability_up(train.fit_forest_classifier(v).transform(v)).agg(F.sum("score")).first()[0] for _ in range(2)]
    assert score[0] == pytest.approx(score[1], abs=1e-12)


def test_too_little_history_is_an_error(spark, universe):
    bars, news, _ = universe
    from marketloom.plans.feature_store import feature_store_frames
    few = bars.where(F.col("price_date") < F.lit("2024-01-20").cast("date"))
    with pytest.raises(ValueError):
        train.train_models(feature_store_frames(few, news)["training_frame"])


def test_latest_row_is_scored_with_universe_medians(spark, universe):
    bars, news, _ = universe
    from marketloom.plans.feature_store import feature_store_frames
    rows = mf.model_frame(feature_store_frames(bars, news)["training_frame"])
    medians = mf.column_medians(rows.persist(), mf.MODEL_FEATURES)
    assert mf.impute(mf.latest_rows(rows), medians).dropna(subset=mf.MODEL_FEATURES).count() == 2
