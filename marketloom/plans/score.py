"""Scored predictions with explanations, and their display form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import (
    clamp_probability, clamp_return, composite_score, confidence, signal_label)
from marketloom.plans import interpret
from marketloom.plans.model_frame import impute, latest_rows, model_frame
from marketloom.plans.train import TrainingResult, probability_up, with_vector

# fixed values: stored in every prediction
MODEL_FAMILY = "machine_learning_signal_calibration"
TARGET_NAME = "forward_return_20d"


def signal_columns(frame: DataFrame, scale) -> DataFrame:
    """Composite score, confidence and labels from raw model outputs.

    Input columns: raw_return, raw_challenger, raw_probability and the three pillar scores.
    """
    r, c, p = F.col("raw_return"), F.col("raw_challenger"), F.col("raw_probability")
    pillars = [F.col(n) for n in ("history_score", "risk_score", "sentiment_score")]
    up = clamp_probability(p)
    return frame.withColumns({
        "predicted_return_20d": clamp_return(r, scale),
        "probability_positive_20d": up,
        "downside_probability_20d": clamp_probability(1.0 - up),
        "composite_ml_score": composite_score(r, p, pillars, scale),
        "confidence_score": confidence(r, c, p, scale),
    }).withColumns({
        "predicted_negative_return_flag": (F.col("downside_probability_20d") >= 0.5).cast("int"),
        "directional_signal": signal_label(F.col("composite_ml_score")),
    })


def top_rows(rows: DataFrame, key: str, measure: str, n: int = 8, name: str = "feature") -> DataFrame:
    """The ``n`` largest rows per key, packed as one ordered JSON list."""
    w = Window.partitionBy(key).orderBy(F.desc(measure), F.asc(name))
    top = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    packed = F.array_sort(F.collect_list(F.struct("_rn", name, measure)))
    return top.groupBy(key).agg(F.to_json(F.transform(packed, lambda s: F.struct(
        s[name].alias(name), s[measure].alias(measure)))).alias("top_json"))


def score_frame(prepared: DataFrame, result: TrainingResult, generated_at, run_id: str | None = None,
                horizon_days: int = 20) -> DataFrame:
    """Predictions for every row of an imputed model frame. All models are applied in one narrow pass."""
    models, names = result.models, result.selected
    scored = with_vector(prepared, result.features)
    scored = models[names["regression"]].transform(scored).withColumnRenamed("prediction", "raw_return")
    scored = models[names["comparison"]].transform(scored).withColumnRenamed("prediction", "raw_challenger")
    scored = probability_up(models[names["classification"]].transform(scored), "raw_probability")
    stats = (result.features, result.column_mean, result.column_scale, result.ridge_weights)
    top = F.transform(F.slice(interpret.contribution_array(*stats), 1, 8), lambda c: F.struct(
        c["feature"].alias("feature"), c["standardized_value"].alias("standardized_value"),
        c["coefficient"].alias("coefficient"), c["contribution"].alias("contribution"), c["absolute_contribution"].alias("absolute_contribution")))
    weights = F.array(*[F.struct(F.lit(r["pillar"]).alias("pillar"), F.lit(r["weight"]).alias("weight"))
                        for r in result.pillar_weights])
    important = F.array(*[F.struct(F.lit(r["feature"]).alias("feature"), F.lit(r["importance"]).alias("importance"))
                          for r in result.importances[:8]])
    return signal_columns(scored, F.lit(result.target_std)).select(
        "asset_id", F.col("feature_date").alias("as_of_date"), F.lit(horizon_days).alias("prediction_horizon_days"),
        F.lit(run_id).cast("string").alias("model_run_id"),
        F.lit(names["regression"]).alias("regression_model_name"),
        F.lit(names["classification"]).alias("classification_model_name"),
        F.lit(names["regression"]).alias("selected_model_name"), F.lit(MODEL_FAMILY).alias("model_family"),
        F.lit(TARGET_NAME).alias("target_name"),
        "predicted_return_20d", "downside_probability_20d", "probability_positive_20d",
        "predicted_negative_return_flag", "composite_ml_score", "confidence_score", "directional_signal",
        "history_score", "risk_score", "sentiment_score",
        *[interpret.pillar_contribution(p, *stats).alias(f"{p}_contribution") for p in ("history", "risk", "sentiment")],
        F.to_json(weights).alias("pillar_weights_json"), F.to_json(important).alias("feature_importance_json"),
        F.to_json(top).alias("top_features_json"),
        F.lit(generated_at).cast("timestamp").alias("prediction_generated_at"))


def predict(training: DataFrame, result: TrainingResult, generated_at, as_of=None, run_id: str | None = None,
            horizon_days: int = 20) -> DataFrame:
    """Prediction of the latest row per asset, on or before ``as_of``, against universe-level statistics."""
    latest = impute(latest_rows(model_frame(training), as_of), result.medians)
    return score_frame(latest, result, generated_at, run_id, horizon_days)


def prediction_history_frame(stored: DataFrame) -> DataFrame:
    """Stored predictions, clamped for display."""
    return stored.where(F.col("as_of_date").isNotNull()).withColumns({
        "predicted_return_20d": clamp_return(F.col("predicted_return_20d")),
        **{c: clamp_probability(F.col(c)) for c in
           ("downside_probability_20d", "probability_positive_20d", "confidence_score")}})


# fixed values: the keys, features offered as drivers, in tie order; the labels are our own words
DRIVER_LABELS = {
    "momentum_20d": "return of the last 20 days",
    "ma_distance_20d": "gap to the 20-day mean price",
    "drawdown_from_peak": "loss since the latest high",
    "realized_volatility_20d": "volatility realized over 20 days",
    "recent_realized_volatility_5d": "volatility realized over 5 days",
    "downside_volatility_20d": "volatility of losing days (20 days)",
    "rolling_volatility_20d": "rolling volatility (20 days)",
    "volume_ratio_20d": "volume relative to its 20-day mean",
    "sentiment_mean_7d": "mean news tone of the week",
    "negative_article_share_7d": "share of negative news in the week",
    "article_count_7d": "news items in the week",
}


def feature_drivers(history: DataFrame, as_of: DataFrame | None = None, top_n: int = 5, min_values: int = 20) -> DataFrame:
    """Current value of each driver against the asset's own history, most unusual first.

    ``history``: recent joined feature rows per asset. ``as_of``: (asset_id, as_of_date) of the snapshot;
    an asset whose snapshot date is not in its history, or without ``as_of``, uses its newest row.
    All statistics come from one aggregation per asset, with one slot per driver.
    """
    rows = history
    if as_of is not None:
        rows = rows.join(as_of.select("asset_id", "as_of_date"), "asset_id")
        picked = F.struct((F.col("feature_date") == F.col("as_of_date")), F.col("feature_date"))
    else:
        picked = F.struct(F.lit(False), F.col("feature_date"))
    names = list(DRIVER_LABELS)
    stats = rows.groupBy("asset_id").agg(
        F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in names]), picked).alias("now"),
        *[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in names])
    slots = F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(c).alias("feature"), F.lit(DRIVER_LABELS[c]).alias("label"),
        F.col(f"now.{c}").alias("current_value"), F.col(f"{c}.mean").alias("historical_mean"),
        F.col(f"{c}.n").alias("n"), F.col(f"{c}.std").alias("std")) for i, c in enumerate(names)])
    long = stats.select("asset_id", F.explode(slots).alias("d")).select("asset_id", "d.*").where(
        F.col("current_value").isNotNull() & (F.col("n") >= min_values))
    z = F.coalesce(F.try_divide(F.col("current_value") - F.col("historical_mean"), F.col("std")), F.lit(0.0))
    ranked = long.withColumn("z_score", z).withColumn("driver_rank", F.row_number().over(
        Window.partitionBy("asset_id").orderBy(F.desc(F.abs("z_score")), "place")))
    return ranked.where(F.col("driver_rank") <= top_n).select(
        "asset_id", "driver_rank", "feature", "label", "current_value", "historical_mean", "z_score",
        F.when(F.col("current_value") >= F.col("historical_mean"), "supportive").otherwise("cautionary").alias("direction"))
