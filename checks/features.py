"""Checks of the feature store, the model frame and stored predictions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.analytics import articles
from checks.base import BLOCKS, SENTIMENT, check
from marketloom.functions import columns as fc
from marketloom.operators import reads, technical
from marketloom.operators.sentiment import sentiment_features
from marketloom.operators.technical import technical_features
from marketloom.plans import feature_store, marts, model_frame as mf, score
from marketloom.session import kept
from marketloom.sources import demo_universe as u
from marketloom.sources.schemas import NEGATIVE_TARGET, RETURN_TARGET, TECHNICAL_COLUMNS

RAW = {"analysis_price", "close_price", "adjusted_close", "volume"}
TECH = [c for c in TECHNICAL_COLUMNS if c not in RAW]
SENT = [c for c in SENTIMENT if "count" not in c]


def market(spark, sf):
    return u.priced_assets(spark, sf)


def technical_rows(spark, sf):
    return technical_features(market(spark, sf), keep_targets_for=20)


def training_rows(spark, sf):
    """The joined store, as the model frame reads it."""
    return feature_store.feature_store_frames(market(spark, sf), articles(spark, sf))["training_frame"]


def model_rows(spark, sf):
    return mf.model_frame(training_rows(spark, sf))


def predictions(spark, sf):
    return u.stored_predictions(model_rows(spark, sf))


def _features(ids: str, columns: list[str]):
    """One check per technical feature family, all reading the same feature job."""
    @check(f"{ids}", f"select asset_id, feature_date, {', '.join(columns)} from x_tech",
           rounds=" ".join(c for c in columns if c not in RAW))
    def _(spark, sf):
        return technical_rows(spark, sf).select("asset_id", "feature_date", *columns)


_features("w06_return_lags", ["return_lag_1d", "return_lag_5d", "return_lag_10d"])
_features("w07_rolling_mean_returns", ["rolling_mean_return_5d", "rolling_mean_return_20d"])
_features("w08_rolling_volatilities", ["rolling_volatility_10d", "rolling_volatility_20d"])
_features("w09_realized_volatilities", ["realized_volatility_20d", "recent_realized_volatility_5d"])
_features("w10_momentum", ["momentum_5d", "momentum_10d", "momentum_20d"])
_features("w11_moving_average_distances", ["ma_distance_10d", "ma_distance_20d"])
_features("w12_rolling_drawdown", ["drawdown_from_peak", "rolling_drawdown_20d"])
_features("w13_downside_volatility", ["downside_volatility_20d"])
_features("w14_intraday_range", ["intraday_range_pct"])
_features("w15_volume_features", ["volume", "volume_change_1d", "volume_ratio_20d", "volume_zscore_20d"])


@check("w16_technical_features", f"""
select asset_id, ticker, feature_date, {', '.join(TECHNICAL_COLUMNS)}, feature_version from x_tech""", rounds=" ".join(TECH))
def _(spark, sf):
    return technical_features(market(spark, sf))


@check("w17_forward_targets", f"select asset_id, feature_date, {RETURN_TARGET}, {NEGATIVE_TARGET} from x_tech",
       rounds=RETURN_TARGET)
def _(spark, sf):
    return technical.forward_targets(u.bars(spark, sf))


@check("j03_attach_targets", f"""
select asset_id, feature_date, momentum_20d, {RETURN_TARGET}, {NEGATIVE_TARGET} from x_tech""",
       rounds=f"momentum_20d {RETURN_TARGET}")
def _(spark, sf):
    features = technical_features(market(spark, sf)).select("asset_id", "feature_date", "momentum_20d")
    return technical.attach_targets(features, technical.forward_targets(u.bars(spark, sf)))


@check("q07_training_frame", f"""
select asset_id, ticker, feature_date, {', '.join(TECHNICAL_COLUMNS)}, {RETURN_TARGET}, {NEGATIVE_TARGET}, feature_version,
  {', '.join(SENTIMENT)} from x_store""", rounds=" ".join([*TECH, *SENT, RETURN_TARGET]))
def _(spark, sf):
    frames = feature_store.feature_store_frames(market(spark, sf), articles(spark, sf))
    return reads.training_frame(frames["technical_features"], frames["sentiment_features"], u.assets(spark, sf))


@check("q07_training_frame_of_one", f"""
select feature_date, momentum_20d, sentiment_mean_7d from x_store where ticker = 'S000004'
 and feature_date between date '2001-06-01' and date '2001-09-30'""", rounds="momentum_20d sentiment_mean_7d")
def _(spark, sf):
    frames = feature_store.feature_store_frames(market(spark, sf), articles(spark, sf))
    return reads.training_frame(frames["technical_features"], frames["sentiment_features"], u.assets(spark, sf), "s000004",
                                dt.date(2001, 6, 1), dt.date(2001, 9, 30)).select(
        "feature_date", "momentum_20d", "sentiment_mean_7d")


_W19 = "trailing_return_60d sentiment_change_7d article_volume_zscore_30d"


@check("w19_trailing_context", f"select asset_id, feature_date, {', '.join(_W19.split())} from x_trail", rounds=_W19)
def _(spark, sf):
    return mf.trailing_context(training_rows(spark, sf)).select("asset_id", "feature_date", *_W19.split())


_W20 = [c for c in mf.DERIVED_COLUMNS[:17] if c not in _W19.split()]


@check("w20_derived_ratios", f"select asset_id, feature_date, {', '.join(_W20)} from x_ratio", rounds=" ".join(_W20))
def _(spark, sf):
    return mf.derived_ratios(mf.trailing_context(training_rows(spark, sf))).select("asset_id", "feature_date", *_W20)


_PROXY = ["benchmark_daily_return", "benchmark_momentum_20d", "benchmark_momentum_60d"]


@check("a16_benchmark_proxy", "select * from x_proxy", rounds=" ".join(_PROXY))
def _(spark, sf):
    return mf.benchmark_proxy(mf.trailing_context(training_rows(spark, sf)))


@check("a16_cross_section_proxy", """
select feature_date, avg(daily_return) as benchmark_daily_return, avg(momentum_20d) as benchmark_momentum_20d,
       avg(trailing_return_60d) as benchmark_momentum_60d from x_trail group by 1""", rounds=" ".join(_PROXY))
def _(spark, sf):
    renamed = mf.trailing_context(training_rows(spark, sf)).withColumn("ticker", F.concat(F.lit("_"), "ticker"))
    return mf.benchmark_proxy(renamed)


_W21 = ["benchmark_relative_return_1d", "benchmark_relative_momentum_20d", "benchmark_relative_return_60d"]


@check("w21_j04_benchmark_relative", f"select asset_id, feature_date, {', '.join(_W21)} from x_relative", rounds=" ".join(_W21))
def _(spark, sf):
    return mf.benchmark_relative(mf.trailing_context(training_rows(spark, sf))).select("asset_id", "feature_date", *_W21)


_W22 = ["history_score", "risk_score", "sentiment_score", "pillar_composite_pre_ml"]


@check("w22_pillar_scores", f"select asset_id, feature_date, {', '.join(_W22)} from x_model", rounds=" ".join(_W22))
def _(spark, sf):
    return model_rows(spark, sf).select("asset_id", "feature_date", *_W22)


@check("m01_model_frame", f"""
select asset_id, ticker, feature_date, {RETURN_TARGET}, {NEGATIVE_TARGET},
  {', '.join(f'{c}::double as {c}' for c in mf.MODEL_FEATURES)} from x_model""",
       rounds=" ".join([c for c in mf.MODEL_FEATURES if c not in RAW] + [RETURN_TARGET]))
def _(spark, sf):
    return model_rows(spark, sf)


@check("w23_j05_latest_rows", """
select * from (select asset_id, max(feature_date) as feature_date from x_tech where feature_date <= date '2001-06-30' group by 1)
join (select asset_id, feature_date, history_score, risk_score, sentiment_score from x_model) using (asset_id, feature_date)""",
       rounds="history_score risk_score sentiment_score")
def _(spark, sf):
    return mf.latest_rows(model_rows(spark, sf), dt.date(2001, 6, 30)).select(
        "asset_id", "feature_date", "history_score", "risk_score", "sentiment_score")


@check("a17_column_medians", "\nunion all\n".join(
    f"select '{c}' as feature, coalesce(quantile_cont({c}::double, 0.5), 0) as median from x_model" for c in mf.MODEL_FEATURES),
       rounds="median")
def _(spark, sf):
    medians = mf.column_medians(kept(model_rows(spark, sf)), mf.MODEL_FEATURES)
    return spark.createDataFrame(list(medians.items()), "feature string, median double")


@check("a19_target_statistics", f"""
select avg({RETURN_TARGET}) as mean, coalesce(nullif(stddev_samp({RETURN_TARGET}), 0), 0.05) as std from x_tech""",
       rounds="mean std")
def _(spark, sf):
    from marketloom.plans.train import target_statistics
    return target_statistics(technical_rows(spark, sf))


# --- stored predictions -----------------------------------------------------------------------

_NUM = ["predicted_return_20d", "downside_probability_20d", "probability_positive_20d", "composite_ml_score",
        "confidence_score", "history_score", "risk_score", "sentiment_score"]
_HEAD = ["as_of_date", "prediction_horizon_days", "regression_model_name", "classification_model_name", *_NUM[:3],
         "predicted_negative_return_flag", *_NUM[3:5], "directional_signal", *_NUM[5:], "prediction_generated_at"]


@check("f07_f08_f09_f10_signals", f"""
select asset_id, as_of_date, {', '.join(_NUM)}, predicted_negative_return_flag, directional_signal from x_prediction""",
       rounds=" ".join(_NUM))
def _(spark, sf):
    return predictions(spark, sf).select("asset_id", "as_of_date", *_NUM, "predicted_negative_return_flag", "directional_signal")


@check("f09_context_labels", """
select asset_id, as_of_date, case when predicted_return_20d >= 0.03 then 'Constructive' when predicted_return_20d <= -0.03
    then 'Defensive' else 'Balanced' end as return_outlook,
  case when downside_probability_20d >= 0.60 then 'Elevated downside risk' when downside_probability_20d <= 0.40
    then 'Contained downside risk' else 'Mixed downside risk' end as downside_regime,
  case when sentiment_score >= 0.2 then 'constructive' when sentiment_score <= -0.2 then 'cautious' else 'mixed' end as tone
from x_prediction""")
def _(spark, sf):
    return predictions(spark, sf).select(
        "asset_id", "as_of_date", fc.return_outlook(F.col("predicted_return_20d")).alias("return_outlook"),
        fc.downside_regime(F.col("downside_probability_20d")).alias("downside_regime"),
        fc.tone_label(F.col("sentiment_score")).alias("tone"))


@check("f11_json_fields", """
select asset_id, as_of_date, 'history' as first_pillar, prediction_horizon_days as days from x_prediction""")
def _(spark, sf):
    packed = predictions(spark, sf).withColumn("j", F.to_json(F.struct(
        F.array(F.struct(F.lit("history").alias("pillar"))).alias("pillars"), F.col("prediction_horizon_days").alias("days"))))
    parsed = F.from_json("j", "pillars array<struct<pillar:string>>, days int")
    return packed.select("asset_id", "as_of_date", parsed.alias("p")).select(
        "asset_id", "as_of_date", F.col("p.pillars")[0]["pillar"].alias("first_pillar"), "p.days")


@check("f12_formatted_figures", """
select asset_id, as_of_date, case when predicted_return_20d is null then 'N/A' else printf('%.2f%%', 100 * predicted_return_20d) end
    as return_text, case when composite_ml_score is null then 'N/A' else printf('%.1f', composite_ml_score) end as score_text,
  case when confidence_score is null then 'N/A' else printf('%.2f%%', 100 * confidence_score) end as confidence_text
from x_prediction""")
def _(spark, sf):
    return predictions(spark, sf).select(
        "asset_id", "as_of_date", fc.percent_text(F.col("predicted_return_20d")).alias("return_text"),
        fc.number_text(F.col("composite_ml_score"), 1).alias("score_text"),
        fc.percent_text(F.col("confidence_score")).alias("confidence_text"))


@check("q08_stored_predictions", f"""
select ticker, model_run_id, {', '.join(_HEAD)} from x_prediction join x_asset using (asset_id)""", rounds=" ".join(_NUM))
def _(spark, sf):
    return reads.predictions(predictions(spark, sf), u.assets(spark, sf))


_SNAP = reads.SNAPSHOT_TECHNICAL + reads.SNAPSHOT_SENTIMENT
BLOCKS["x_latest"] = f"""
select * exclude (rn) from (
  select p.*, ticker, run_timestamp, evaluation_summary, feature_version, {', '.join(reads.SNAPSHOT_TECHNICAL)},
    {', '.join(f's.{c}' for c in reads.SNAPSHOT_SENTIMENT)},
    row_number() over (partition by p.asset_id order by as_of_date desc, prediction_generated_at desc) as rn
  from x_prediction p join x_asset using (asset_id) left join x_model_run on model_run_id = run_id
  left join (select asset_id, feature_date, {', '.join(reads.SNAPSHOT_TECHNICAL)} from x_tech) t
    on t.asset_id = p.asset_id and t.feature_date = as_of_date
  left join x_sent s on s.asset_id = p.asset_id and s.feature_date = as_of_date) where rn = 1
"""


def latest(spark, sf, changed=lambda stored: stored):
    frames = feature_store.feature_store_frames(market(spark, sf), articles(spark, sf))
    return reads.latest_prediction(changed(predictions(spark, sf)), u.assets(spark, sf), u.model_runs(spark, sf),
                                   frames["technical_features"], frames["sentiment_features"])


@check("q09_latest_prediction", f"""
select asset_id, ticker, model_run_id, run_timestamp, evaluation_summary, feature_version, {', '.join(_HEAD)},
  {', '.join(_SNAP)} from x_latest""", rounds=" ".join(_NUM + [c for c in _SNAP if "_count_" not in c]))
def _(spark, sf):
    return latest(spark, sf).select("asset_id", "ticker", "model_run_id", "run_timestamp", "evaluation_summary",
                                    "feature_version", *_HEAD, *_SNAP)


@check("q10_prediction_history", f"""
select ticker, {', '.join(_HEAD)} from (select *, row_number() over (partition by asset_id order by as_of_date desc) as rn
  from x_prediction) join x_asset using (asset_id) where rn <= 60""", rounds=" ".join(_NUM))
def _(spark, sf):
    return reads.prediction_history(predictions(spark, sf), u.assets(spark, sf))


BLOCKS["x_driver"] = f"""
select t.asset_id, t.feature_date, {', '.join(reads.SNAPSHOT_TECHNICAL)}, {', '.join(reads.SNAPSHOT_SENTIMENT[1:])}
from (select *, row_number() over (partition by asset_id order by feature_date desc) as rn from x_tech) t
left join x_sent s on s.asset_id = t.asset_id and s.feature_date = t.feature_date where rn <= 252
"""
_DRIVER = reads.SNAPSHOT_TECHNICAL + reads.SNAPSHOT_SENTIMENT[1:]


def drivers(spark, sf):
    return reads.driver_frame(technical_features(market(spark, sf)), sentiment_features(articles(spark, sf)))


@check("q11_driver_frame", f"select asset_id, feature_date, {', '.join(_DRIVER)} from x_driver",
       rounds=" ".join(c for c in _DRIVER if "_count_" not in c))
def _(spark, sf):
    return drivers(spark, sf)


@check("q14_complete_predictions", """
select asset_id, as_of_date, composite_ml_score is not null and confidence_score is not null and history_score is not null
  and risk_score is not null and sentiment_score is not null and directional_signal is not null as is_complete
from x_prediction""")
def _(spark, sf):
    return reads.is_complete(predictions(spark, sf)).select("asset_id", "as_of_date", "is_complete")


@check("q14_assets_needing_forecast", """
select asset_id, ticker from x_asset where asset_id not in (
  select asset_id from (select *, row_number() over (partition by asset_id order by as_of_date desc) as rn from x_prediction
    where as_of_date <= date '1995-10-01')
  where rn = 1 and composite_ml_score is not null and confidence_score is not null)""")
def _(spark, sf):
    from marketloom.plans.forecast_run import assets_needing_forecast
    early = predictions(spark, sf).where(F.col("as_of_date") <= F.lit("1995-10-01").cast("date"))
    return assets_needing_forecast(u.assets(spark, sf), early).select("asset_id", "ticker")


@check("q14_assets_needing_forecast_all", """
select asset_id, ticker from x_asset where asset_id not in (
  select asset_id from (select *, row_number() over (partition by asset_id order by as_of_date desc) as rn from x_prediction)
  where rn = 1 and composite_ml_score is not null and confidence_score is not null and history_score is not null
    and risk_score is not null and sentiment_score is not null and directional_signal is not null)""")
def _(spark, sf):
    from marketloom.plans.forecast_run import assets_needing_forecast
    return assets_needing_forecast(u.assets(spark, sf), predictions(spark, sf)).select("asset_id", "ticker")


BLOCKS["x_gappy"] = """
select * replace (case when day(as_of_date) % 3 <> 0 then sentiment_score end as sentiment_score,
  case when day(as_of_date) % 4 <> 1 then composite_ml_score end as composite_ml_score,
  case when day(as_of_date) % 4 <> 1 then directional_signal end as directional_signal,
  case when day(as_of_date) % 5 <> 2 then confidence_score end as confidence_score,
  case when day(as_of_date) % 11 <> 7 then predicted_return_20d end as predicted_return_20d)
from x_prediction where asset_id in (select asset_id from x_asset where is_active)
"""


@check("q14_assets_needing_forecast_gaps", """
select asset_id, ticker from x_asset where asset_id not in (
  select asset_id from (select *, row_number() over (partition by asset_id order by as_of_date desc) as rn from x_gappy)
  where rn = 1 and composite_ml_score is not null and confidence_score is not null and history_score is not null
    and risk_score is not null and sentiment_score is not null and directional_signal is not null)""")
def _(spark, sf):
    from marketloom.plans.forecast_run import assets_needing_forecast
    stored = u.with_gaps(predictions(spark, sf), u.assets(spark, sf))
    return assets_needing_forecast(u.assets(spark, sf), stored).select("asset_id", "ticker")


@check("f11_parsed_explanations", """
select asset_id, as_of_date, place::int as place, feature, contribution, abs(contribution) as absolute_contribution from (
  select asset_id, as_of_date, 0 as place, 'history' as feature, history_contribution as contribution from x_prediction union all
  select asset_id, as_of_date, 1, 'risk', risk_contribution from x_prediction union all
  select asset_id, as_of_date, 2, 'sentiment', sentiment_contribution from x_prediction)
where day(as_of_date) % 7 not in (3, 4)""", rounds="contribution absolute_contribution")
def _(spark, sf):
    parsed = marts.parsed_explanations(u.with_explanations(predictions(spark, sf)))
    rows = parsed.select("asset_id", "as_of_date", F.posexplode("top_features").alias("place", "t"))
    return rows.select("asset_id", "as_of_date", "place", "t.feature", "t.contribution", "t.absolute_contribution")


@check("q15_feature_counts", f"""
select unnest([{', '.join(f"'{c}'" for c in mf.MODEL_FEATURES)}]) as feature,
  unnest([{', '.join(f"count({c})" for c in mf.MODEL_FEATURES)}]) as n from x_model""")
def _(spark, sf):
    """Rows that have a value, for every numeric column that the frame offers as a feature of the models."""
    frame = model_rows(spark, sf)
    names = [c for c in reads.feature_columns(frame) if c in mf.MODEL_FEATURES]
    counts = frame.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "n")


@check("w24_feature_drivers", "select * from (" + """
with slots as (""" + "\nunion all ".join(
    f"select asset_id, {i} as place, '{c}' as feature, '{l}' as label, arg_max({c}::double, feature_date) as plain, "
    f"max_by(coalesce({c}::double, 'nan'::double), feature_date) as current_value, avg({c}) as historical_mean, "
    f"count({c}) as n, stddev_samp({c}) as std from x_driver group by asset_id"
    for i, (c, l) in enumerate(score.DRIVER_LABELS.items())) + """)
select asset_id, driver_rank::int as driver_rank, feature, label, current_value, historical_mean, z_score, direction from (
  select *, row_number() over (partition by asset_id order by abs(round(z_score, 9)) desc, place) as driver_rank,
    case when current_value >= historical_mean then 'supportive' else 'cautionary' end as direction
  from (select *, coalesce((current_value - historical_mean) / nullif(std, 0), 0.0) as z_score from slots
        where not isnan(current_value) and n >= 20)) where driver_rank <= 5)""",
       rounds="current_value historical_mean z_score")
def _(spark, sf):
    return score.feature_drivers(drivers(spark, sf))


@check("m15_prediction_history_frame", f"""
select asset_id, as_of_date, {', '.join(_NUM)} from x_prediction""", rounds=" ".join(_NUM))
def _(spark, sf):
    return score.prediction_history_frame(predictions(spark, sf)).select("asset_id", "as_of_date", *_NUM)
