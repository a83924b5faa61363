"""Checks of splits, metrics, models, explanations, marts and the full forecast run."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from checks.analytics import articles
from checks.base import BLOCKS, check
from checks.features import latest, market, model_rows, predictions, technical_rows, training_rows
from marketloom.functions.columns import SIGNAL_THRESHOLD
from marketloom.plans import evaluate, forecast_run, interpret, marts, model_frame as mf, score, train
from marketloom.session import kept, scratch_path
from marketloom.sources import demo_universe as u
from marketloom.sources.schemas import NEGATIVE_TARGET, RETURN_TARGET

# Features of the contribution checks, whose SQL spells them out.
CORE = ["momentum_5d", "momentum_20d", "rolling_volatility_20d", "realized_volatility_20d", "ma_distance_20d",
        "drawdown_from_peak", "volume_ratio_20d", "sentiment_mean_7d", "history_score", "risk_score"]
GENERATED = dt.datetime(2002, 1, 1)


def imputed(spark, sf, features=None):
    frame = kept(model_rows(spark, sf))
    features = features or mf.MODEL_FEATURES
    return mf.impute(frame, mf.column_medians(frame, features))  # a projection of the stored frame: not stored again


@check("m02_time_holdout", f"""
select asset_id, feature_date, row_number() over (order by feature_date, asset_id)
  <= least(greatest(60, floor(0.8::double * (select count(*) from x_tech))), (select count(*) from x_tech) - 1) as is_train
from x_tech""")
def _(spark, sf):
    rows = technical_rows(spark, sf).select("asset_id", "feature_date")
    return rows.withColumn("is_train", evaluate.train_flag(rows))


BLOCKS["x_block"] = f"""
select asset_id, feature_date, {RETURN_TARGET}, case when b <= floor((days - 80) / 20) then b end as block from (
  select *, case when k <= 80 then 0 else ceil((k - 80) / 20)::int end as b, max(k) over () as days from (
    select *, dense_rank() over (order by feature_date) as k from x_tech))
"""
BLOCKS["x_row_block"] = """
select asset_id, feature_date, case when b <= floor((n - 80) / 20) then b end as block from (
  select *, case when k <= 80 then 0 else ceil((k - 80) / 20)::int end as b, max(k) over () as n from (
    select asset_id, feature_date, row_number() over (order by feature_date, asset_id) as k from x_tech))
"""


@check("m03_expanding_windows", """
select block as fold, (sum(n) over w)::bigint as train_rows, n as test_rows, min(a) over w as train_start,
       max(b) over w as train_end, a as test_start, b as test_end
from (select block, count(*) as n, min(feature_date) as a, max(feature_date) as b from x_block where block is not null group by 1)
window w as (order by block rows between unbounded preceding and 1 preceding) qualify fold > 0""")
def _(spark, sf):
    rows = technical_rows(spark, sf).select("asset_id", "feature_date")
    return evaluate.fold_table(evaluate.fold_blocks(rows))


@check("m03_expanding_windows_by_row", "select asset_id, feature_date, block from x_row_block")
def _(spark, sf):
    rows = technical_rows(spark, sf).select("asset_id", "feature_date")
    return evaluate.fold_blocks(rows, unit="rows")


@check("m04_ridge_coefficients")
def _(spark, sf):
    vectors = train.with_vector(imputed(spark, sf), mf.MODEL_FEATURES)
    model = train.fit_ridge(train.regression_rows(vectors))
    rows = [(f, float(c)) for f, c in zip(mf.MODEL_FEATURES, model.coefficients)] + [("intercept", float(model.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@check("m05_ridge_fold_metrics")
def _(spark, sf):
    return evaluate.ridge_fold_metrics(evaluate.fold_blocks(imputed(spark, sf)), mf.MODEL_FEATURES)


# Two features keep the closed form short enough for SQL.
PAIR = ["momentum_20d", "rolling_volatility_20d"]
BLOCKS["x_pair"] = f"""
select t.asset_id, t.feature_date, block, momentum_20d as a, rolling_volatility_20d as b, t.{RETURN_TARGET} as y
from x_tech t join x_block k on k.asset_id = t.asset_id and k.feature_date = t.feature_date
where momentum_20d is not null and rolling_volatility_20d is not null and t.{RETURN_TARGET} is not null
"""


def pair_rows(spark, sf):
    return technical_rows(spark, sf).select("asset_id", "feature_date", RETURN_TARGET, *PAIR)


BLOCKS["x_ridge"] = """
select *, ((n + 2) * s1 - c * s2) / ((n + 2) * (n + 2) - c * c) as za, ((n + 2) * s2 - c * s1) / ((n + 2) * (n + 2) - c * c) as zb
from (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, stddev_pop(a) as sa, stddev_pop(b) as sb,
        (avg(a * y) - avg(a) * avg(y)) * count(*) / stddev_pop(a) as s1,
        (avg(b * y) - avg(b) * avg(y)) * count(*) / stddev_pop(b) as s2,
        (avg(a * b) - avg(a) * avg(b)) * count(*) / (stddev_pop(a) * stddev_pop(b)) as c from x_pair)
"""


def pair_weights(spark, sf):
    """Ridge on the pair: coefficients, intercept, and weights in standardized units."""
    rows = pair_rows(spark, sf).dropna().persist()
    model = train.fit_ridge(train.regression_rows(train.with_vector(rows, PAIR)))
    scale = rows.agg(*[F.stddev_pop(c).alias(c) for c in PAIR]).first()
    coefficients = {f: float(c) for f, c in zip(PAIR, model.coefficients)}
    return coefficients, float(model.intercept), {f: c * scale[f] for f, c in coefficients.items()}


@check("m04_ridge_closed_form", """
select 'momentum_20d' as feature, za / sa as coefficient from x_ridge
union all select 'rolling_volatility_20d', zb / sb from x_ridge
union all select 'intercept', my - za / sa * ma - zb / sb * mb from x_ridge""", rounds="coefficient")
def _(spark, sf):
    coefficients, intercept, _ = pair_weights(spark, sf)
    return spark.createDataFrame([*coefficients.items(), ("intercept", intercept)], "feature string, coefficient double")


@check("m05_ridge_folds_closed_form", """
with g as (select avg(a) as ga, avg(b) as gb from x_pair),
k as (select block, count(*) as n, sum(a - ga) as a, sum(b - gb) as b, sum(y) as y, sum((a - ga) * (a - ga)) as aa,
        sum((b - gb) * (b - gb)) as bb, sum((a - ga) * (b - gb)) as ab, sum((a - ga) * y) as ay, sum((b - gb) * y) as yb
      from x_pair, g where block is not null group by 1),
t as (select block, sum(n) over w as n, sum(a) over w as a, sum(b) over w as b, sum(y) over w as y, sum(aa) over w as aa,
        sum(bb) over w as bb, sum(ab) over w as ab, sum(ay) over w as ay, sum(yb) over w as yb from k
      window w as (order by block rows between unbounded preceding and 1 preceding)),
z as (select block, n, a / n as ma, b / n as mb, y / n as my, sqrt(aa / n - (a / n) * (a / n)) as sa,
        sqrt(bb / n - (b / n) * (b / n)) as sb, ab - a * b / n as cab, ay - a * y / n as cay, yb - b * y / n as cby from t where block > 0),
c as (select *, cab / (sa * sb) as r, cay / sa as s1, cby / sb as s2 from z),
w as (select *, ((n + 2) * s1 - r * s2) / ((n + 2) * (n + 2) - r * r) / sa as wa,
             ((n + 2) * s2 - r * s1) / ((n + 2) * (n + 2) - r * r) / sb as wb from c),
p as (select x.block as fold, x.y, my + wa * (x.a - ga - ma) + wb * (x.b - gb - mb) as p from x_pair x join w on w.block = x.block, g)
select fold, count(*) as rows, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
       avg(((y >= 0) = (p >= 0))::int) as directional_accuracy from p group by 1""", rounds="mae rmse directional_accuracy")
def _(spark, sf):
    blocked = evaluate.fold_blocks(pair_rows(spark, sf)).dropna(subset=PAIR).persist()
    return evaluate.ridge_fold_metrics(blocked, PAIR)


@check("m06_forest_regressor")
def _(spark, sf):
    vectors = train.with_vector(imputed(spark, sf), mf.MODEL_FEATURES)
    flag = evaluate.train_flag(vectors)
    model = train.fit_forest_regressor(train.regression_rows(vectors.where(flag)))
    return evaluate.regression_metrics(model.transform(train.regression_rows(vectors.where(~flag))))


@check("m07_forest_classifier")
def _(spark, sf):
    vectors = train.with_vector(imputed(spark, sf), mf.MODEL_FEATURES)
    flag = evaluate.train_flag(vectors)
    model = train.fit_forest_classifier(train.classification_rows(vectors.where(flag)))
    scored = train.probability_up(model.transform(train.classification_rows(vectors.where(~flag))))
    return spark.createDataFrame([json.dumps(evaluate.classification_metrics(scored))], "string").toDF("metrics")


_METRICS = "mae rmse directional_accuracy"


@check("m08_regression_metrics", f"""
select count(*) as rows, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
       avg(((y >= 0) = (p >= 0))::int) as directional_accuracy
from (select {RETURN_TARGET} as y, momentum_20d as p from x_tech) where y is not null and p is not null""", rounds=_METRICS)
def _(spark, sf):
    return evaluate.regression_metrics(technical_rows(spark, sf), prediction="momentum_20d")


@check("m09_classification_metrics", f"""
with s as (select 1 - {NEGATIVE_TARGET} as y, 1 / (1 + exp(-3 * momentum_5d)) as p from x_tech
           where {NEGATIVE_TARGET} is not null and momentum_5d is not null),
r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as k from s)
select count(*) as rows, avg((y = (p >= 0.5)::int)::int) as accuracy,
  count(*) filter (y = 1 and p >= 0.5)::double / nullif(count(*) filter (p >= 0.5), 0) as "precision",
  count(*) filter (y = 1 and p >= 0.5)::double / nullif(count(*) filter (y = 1), 0) as recall,
  (sum(k) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as roc_auc
from r""", rounds="accuracy recall roc_auc")
def _(spark, sf):
    rows = technical_rows(spark, sf).select(
        (1 - F.col(NEGATIVE_TARGET)).alias("label"), (1.0 / (1.0 + F.exp(-3.0 * F.col("momentum_5d")))).alias("score"))
    m = evaluate.classification_metrics(rows)
    return spark.createDataFrame([m], "rows long, accuracy double, precision double, recall double, roc_auc double")


@check("m10_mean_of_folds", f"""
select count(*) as folds, avg(mae) as mae, avg(rmse) as rmse, avg(directional_accuracy) as directional_accuracy from (
  select block, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
         avg(((y >= 0) = (p >= 0))::int) as directional_accuracy
  from (select block, b.{RETURN_TARGET} as y, momentum_20d as p from x_block b join x_tech using (asset_id, feature_date))
  where y is not null and p is not null and block > 0 group by 1)""", rounds=_METRICS)
def _(spark, sf):
    rows = technical_rows(spark, sf).select("asset_id", "feature_date", RETURN_TARGET, "momentum_20d")
    blocked = evaluate.fold_blocks(rows).where(F.col("block") > 0)
    return evaluate.mean_of_folds(evaluate.regression_metrics(blocked, ["block"], prediction="momentum_20d"), _METRICS.split())


_FOREST_FOLD = ("regression_mae regression_rmse regression_directional_accuracy classification_accuracy classification_precision "
                "classification_recall classification_roc_auc").split()


@check("m10_forest_fold_metrics")
def _(spark, sf):
    rows = train.refitted_fold_metrics(evaluate.fold_blocks(imputed(spark, sf)), mf.MODEL_FEATURES)
    flat = [{"fold": r["fold"]} | {f"regression_{k}": v for k, v in r["regression"]["random_forest_regressor"].items()}
            | {f"classification_{k}": v for k, v in r["classification"]["random_forest_classifier"].items()} for r in rows]
    return spark.createDataFrame([(r["fold"], *[r.get(c) for c in _FOREST_FOLD]) for r in flat],
                                 "fold int, " + ", ".join(f"{c} double" for c in _FOREST_FOLD))


# Fixed coefficients: the arithmetic of contributions is checked apart from fitting.
_COEF = {c: (-1) ** i * (0.5 + 0.1 * i) for i, c in enumerate(CORE)}
BLOCKS["x_contribution"] = "\nunion all\n".join(
    f"select asset_id, '{c}' as feature, '{mf.PILLAR_OF[c]}' as pillar, ({c} - 0.1::double) / 0.7::double * {w!r}::double "
    f"as contribution from x_last" for c, w in _COEF.items())
BLOCKS["x_last"] = """
select * replace (""" + ", ".join(f"coalesce({c}, 0)::double as {c}" for c in CORE) + """) from (
  select *, row_number() over (partition by asset_id order by feature_date desc) as rn from x_model) where rn = 1
"""


def contribution_rows(spark, sf):
    last = mf.impute(mf.latest_rows(model_rows(spark, sf)), {c: 0.0 for c in CORE})
    return interpret.contributions(last, CORE, {c: 0.1 for c in CORE}, {c: 0.7 for c in CORE}, _COEF)


@check("m11_linear_weights", """
select 'momentum_20d' as feature, 'history' as pillar, za as coefficient, abs(za) as absolute_weight from x_ridge
union all select 'rolling_volatility_20d', 'risk', zb, abs(zb) from x_ridge""", rounds="coefficient absolute_weight")
def _(spark, sf):
    return interpret.linear_weights(spark, pair_weights(spark, sf)[2])


@check("m11_pillar_shares", """
select 'history' as pillar, abs(za) / (abs(za) + abs(zb)) as weight from x_ridge
union all select 'risk', abs(zb) / (abs(za) + abs(zb)) from x_ridge union all select 'sentiment', 0.0::double""", rounds="weight")
def _(spark, sf):
    shares = interpret.pillar_shares(pair_weights(spark, sf)[2], "weight")
    return spark.createDataFrame(shares, "pillar string, weight double")


@check("m12_contributions", "select asset_id, feature, pillar, contribution from x_contribution", rounds="contribution")
def _(spark, sf):
    return contribution_rows(spark, sf).select("asset_id", "feature", "pillar", "contribution")


@check("m12_pillar_contributions", """
select asset_id, pillar, sum(contribution) as contribution from x_contribution group by 1, 2""", rounds="contribution")
def _(spark, sf):
    return interpret.contributions_by_pillar(contribution_rows(spark, sf))


@check("t06_top_features", """
select asset_id, feature, contribution from (select *, row_number() over (partition by asset_id
  order by abs(contribution) desc, feature) as rn from x_contribution) where rn <= 8""", rounds="contribution")
def _(spark, sf):
    rows = contribution_rows(spark, sf)
    packed = score.top_rows(rows, "asset_id", "absolute_contribution")
    items = F.from_json("top_json", "array<struct<feature:string,absolute_contribution:double>>")
    top = packed.select("asset_id", F.explode(items).alias("t")).select("asset_id", "t.feature")
    return rows.join(top, ["asset_id", "feature"]).select("asset_id", "feature", "contribution")


@check("m13_permutation_importance")
def _(spark, sf):
    vectors = train.with_vector(imputed(spark, sf), mf.MODEL_FEATURES)
    flag = evaluate.train_flag(vectors)
    model = train.fit_forest_regressor(train.regression_rows(vectors.where(flag)))
    return interpret.permutation_importance(model, train.regression_rows(vectors.where(~flag)), mf.MODEL_FEATURES)


def stored_run_predictions(spark, sf):
    """Models are fitted and stored, read back, and score the latest rows."""
    rows = training_rows(spark, sf)
    root = scratch_path(spark, "stored_run")
    train.save_result(spark, train.fit_models(rows), forecast_run.run_path(root, "check"))
    return forecast_run.predict_from_run(spark, root, "check", rows, GENERATED)


@check("m14_predictions")
def _(spark, sf):
    return stored_run_predictions(spark, sf)


@check("m14_prediction_rules", """
select asset_id, feature_date as as_of_date, 20 as prediction_horizon_days, true as return_is_clamped, true as chances_add_up,
  true as flag_follows_chance, true as label_follows_score, true as scores_in_range, 8 as top_features, 3 as pillars, true as sizes_fall
from x_last""")
def _(spark, sf):
    p = stored_run_predictions(spark, sf)
    score_ = F.col("composite_ml_score")
    label = F.when(score_ >= SIGNAL_THRESHOLD, "Favorable").when(score_ <= -SIGNAL_THRESHOLD, "Unfavorable").otherwise("Neutral")
    top = F.from_json("top_features_json", "array<struct<feature:string,contribution:double,absolute_contribution:double>>")
    sizes = F.transform(top, lambda t: t["absolute_contribution"])
    pillars = F.from_json("pillar_weights_json", "array<struct<pillar:string,weight:double>>")
    up, down = F.col("probability_positive_20d"), F.col("downside_probability_20d")
    return p.select(
        "asset_id", "as_of_date", "prediction_horizon_days", (F.abs("predicted_return_20d") <= 0.6).alias("return_is_clamped"),
        (F.abs(up + down - 1) < 1e-9).alias("chances_add_up"), ((down >= 0.5).cast("int") == F.col("predicted_negative_return_flag")).alias("flag_follows_chance"),
        (label == F.col("directional_signal")).alias("label_follows_score"),
        (score_.between(-100, 100) & F.col("confidence_score").between(0, 1) & up.between(0, 1)).alias("scores_in_range"),
        F.size(top).alias("top_features"), F.size(pillars).alias("pillars"),
        ((F.reverse(F.array_sort(sizes)) == sizes) & F.forall(top, lambda t: t["absolute_contribution"] == F.abs(t["contribution"]))).alias("sizes_fall"))


@check("m16_forecast_run")
def _(spark, sf):
    run = forecast_run.run_forecast(spark, scratch_path(spark, "forecast"), market(spark, sf), articles(spark, sf),
                                    u.assets(spark, sf), GENERATED)
    return run["predictions"]


# --- marts ------------------------------------------------------------------------------------

_KPI = ("total_return annualized_return annualized_volatility max_drawdown historical_var expected_shortfall "
        "latest_rolling_volatility")
BLOCKS["x_news"] = """
select asset_id, count(*) as article_count, sum(sentiment_score::decimal(18,10))::double / count(*) as average_sentiment,
  count(*) filter (sentiment_label = 'positive') as positive_count, count(*) filter (sentiment_label = 'negative') as negative_count,
  count(*) filter (sentiment_label = 'neutral') as neutral_count, max(published_at) as latest_published_at
from (select *, row_number() over (partition by asset_id order by published_at desc, url) as rn from x_article) where rn <= 25
group by 1
"""


@check("b01_asset_kpis", f"""
select asset_id, coverage_start, coverage_end, price_count as observation_count, last_price as latest_price,
  {', '.join(_KPI.split())}, daily_drift, daily_volatility, return_count as observations from x_kpi""",
       rounds=_KPI + " daily_drift daily_volatility")
def _(spark, sf):
    return marts.asset_kpis(u.bars(spark, sf))


def briefing(spark, sf):
    last = score.prediction_history_frame(latest(spark, sf))
    return marts.briefing_mart(marts.asset_kpis(u.bars(spark, sf)), u.assets(spark, sf), u.news_articles(spark, sf), last)


@check("b01_briefing_mart", f"""
select asset_id, a.ticker, asset_name, asset_class, coverage_start, coverage_end, price_count as observation_count,
  last_price as latest_price, {', '.join(_KPI.split())}, coalesce(article_count, 0) as article_count, average_sentiment,
  as_of_date, composite_ml_score, directional_signal
from x_kpi join x_asset a using (asset_id) left join x_news using (asset_id) left join x_latest p using (asset_id)""",
       rounds=_KPI + " average_sentiment composite_ml_score")
def _(spark, sf):
    return briefing(spark, sf).select(
        "asset_id", "ticker", "asset_name", "asset_class", "coverage_start", "coverage_end", "observation_count",
        "latest_price", *_KPI.split(), "article_count", "average_sentiment", "as_of_date", "composite_ml_score",
        "directional_signal")


@check("b02_commentary", """
select asset_id,
  asset_name || ' (' || lower(asset_class) || ') returned ' || printf('%.2f%%', 100 * total_return)
    || ' over the stored history, ' || printf('%.2f%%', 100 * annualized_return) || ' a year, at an annualized volatility of '
    || printf('%.2f%%', 100 * annualized_volatility) || '. Deepest drawdown: ' || printf('%.2f%%', 100 * max_drawdown)
    || '; one-day 95% VaR: ' || printf('%.2f%%', 100 * historical_var) || '.' as executive_text,
  'Performance was ' || case when total_return >= 0 then 'positive' else 'negative' end || ': total return '
    || printf('%.2f%%', 100 * total_return) || ', annualized ' || printf('%.2f%%', 100 * annualized_return) || '.' as performance_text,
  'Volatility ' || printf('%.2f%%', 100 * annualized_volatility) || ', drawdown ' || printf('%.2f%%', 100 * max_drawdown)
    || ', 95% VaR ' || printf('%.2f%%', 100 * historical_var) || ', expected shortfall '
    || printf('%.2f%%', 100 * expected_shortfall) || '. Past figures, not a forecast.' as risk_text
from x_kpi join x_asset using (asset_id)""")
def _(spark, sf):
    return marts.commentary(briefing(spark, sf)).select("asset_id", "executive_text", "performance_text", "risk_text")


@check("b02_news_and_signal_texts", """
select asset_id,
  case when article_count is null then 'No stored news.' else article_count::varchar || ' recent articles, tone '
    || case when average_sentiment >= 0.2 then 'constructive' when average_sentiment <= -0.2 then 'cautious' else 'mixed' end
    || ', mean score ' || printf('%.2f', average_sentiment) || '; positive ' || positive_count::varchar || ', neutral '
    || neutral_count::varchar || ', negative ' || negative_count::varchar || '.' end as sentiment_text,
  case when composite_ml_score is null then 'No stored model signal.' else 'Composite score ' || printf('%.2f', composite_ml_score)
    || ' (' || lower(directional_signal) || '). Expected 20-day return ' || printf('%.2f%%', 100 * least(greatest(predicted_return_20d, -0.6), 0.6))
    || ', chance of a gain ' || printf('%.2f%%', 100 * probability_positive_20d) || '. Pillars: history ' || printf('%.2f', history_score)
    || ', risk ' || printf('%.2f', risk_score) || ', sentiment ' || printf('%.2f', sentiment_score) || '.' end as signal_text
from x_kpi join x_asset using (asset_id) left join x_news using (asset_id) left join x_latest p using (asset_id)""")
def _(spark, sf):
    return marts.commentary(briefing(spark, sf)).select("asset_id", "sentiment_text", "signal_text")


BLOCKS["x_gappy_latest"] = """
select p.*, article_count_7d, source_count_7d from (
  select *, row_number() over (partition by asset_id order by as_of_date desc, prediction_generated_at desc) as rn from x_gappy) p
left join x_sent s on s.asset_id = p.asset_id and s.feature_date = as_of_date where rn = 1
"""


@check("b03_signal_overview", f"""
select a.asset_id, a.ticker, p.asset_id is not null as available, case when p.asset_id is not null then coalesce(directional_signal, 'Neutral') end as regime_label,
  case when p.asset_id is not null and composite_ml_score is null then '{marts._INCOMPLETE["composite_ml_score"]}' end as composite_ml_score_reason,
  case when p.asset_id is not null and confidence_score is null then '{marts._INCOMPLETE["confidence_score"]}' end as confidence_score_reason,
  case when p.asset_id is not null and sentiment_score is null then 'sentiment pillar missing in the stored signal'
       when p.asset_id is not null and coalesce(article_count_7d, 0) = 0 and coalesce(source_count_7d, 0) = 0 then '{marts.NEUTRAL_SENTIMENT}' end
    as sentiment_score_reason,
  case when p.asset_id is not null and day(as_of_date) % 7 in (3, 4) then 0 when p.asset_id is not null then 3 end::int as top_features,
  case when p.asset_id is null then '{marts.NO_SIGNAL}' else
    case when composite_ml_score is null then 'Composite score unavailable.'
         else 'Composite score ' || printf('%.1f', composite_ml_score) || ', signal ' || lower(directional_signal) || '.' end
    || case when predicted_return_20d is null then ' Return or probability unavailable.'
            else ' Expected 20-day return ' || printf('%.2f%%', 100 * least(greatest(predicted_return_20d, -0.6), 0.6)) || ', chance of a gain '
                 || printf('%.2f%%', 100 * probability_positive_20d) || '.' end
    || case when confidence_score is null then ' Confidence unavailable.' else ' Confidence ' || printf('%.0f%%', 100 * confidence_score) || '.' end
    || ' Chance of a loss ' || printf('%.2f%%', 100 * downside_probability_20d) || ': '
    || case when downside_probability_20d >= 0.60 then 'elevated downside risk' when downside_probability_20d <= 0.40
         then 'contained downside risk' else 'mixed downside risk' end || '.'
    || case when sentiment_score is null then ' Notes: sentiment pillar missing in the stored signal.'
            when coalesce(article_count_7d, 0) = 0 and coalesce(source_count_7d, 0) = 0 then ' Notes: {marts.NEUTRAL_SENTIMENT}.' else '' end
    || case when sentiment_score is null then ' Pillar scores are incomplete, see the notes.' else ' Pillars: history ' || printf('%.2f', history_score)
         || ', risk ' || printf('%.2f', risk_score) || ', sentiment ' || printf('%.2f', sentiment_score) || '.' end end as interpretation
from x_asset a left join x_gappy_latest p on p.asset_id = a.asset_id""")
def _(spark, sf):
    rows = latest(spark, sf, lambda stored: u.with_explanations(u.with_gaps(stored, u.assets(spark, sf))))
    return marts.signal_overview(rows, u.assets(spark, sf)).select(
        "asset_id", "ticker", "available", "regime_label", "composite_ml_score_reason", "confidence_score_reason", "sentiment_score_reason",
        F.when(F.col("available"), F.size("top_features")).alias("top_features"), "interpretation")


@check("b03_signal_summary", f"""
select asset_id, least(greatest(predicted_return_20d, -0.6), 0.6) as predicted_return_20d, directional_signal,
  case when history_score is null then 'history pillar missing in the stored signal' end as history_score_reason,
  case when coalesce(article_count_7d, 0) = 0 and coalesce(source_count_7d, 0) = 0 then '{marts.NEUTRAL_SENTIMENT}' end
    as sentiment_score_reason,
  case when predicted_return_20d >= 0.03 then 'Constructive' when predicted_return_20d <= -0.03 then 'Defensive'
    else 'Balanced' end as return_outlook,
  'Composite score ' || printf('%.1f', composite_ml_score) || ', signal ' || lower(directional_signal)
    || '. Expected 20-day return ' || printf('%.2f%%', 100 * predicted_return_20d) || ', chance of a gain '
    || printf('%.2f%%', 100 * probability_positive_20d) || '. '
    || case when confidence_score is null then 'Confidence unavailable.'
            else 'Confidence ' || printf('%.0f%%', 100 * confidence_score) || '.' end
    || ' Chance of a loss ' || printf('%.2f%%', 100 * downside_probability_20d) || ': '
    || case when downside_probability_20d >= 0.60 then 'elevated downside risk' when downside_probability_20d <= 0.40
         then 'contained downside risk' else 'mixed downside risk' end || '.'
    || case when coalesce(article_count_7d, 0) = 0 then ' Notes: {marts.NEUTRAL_SENTIMENT}.' else '' end as interpretation
from x_latest""", rounds="predicted_return_20d")
def _(spark, sf):
    return marts.signal_summary(latest(spark, sf)).select(
        "asset_id", "predicted_return_20d", "directional_signal", "history_score_reason", "sentiment_score_reason",
        "return_outlook", "interpretation")


@check("b03_pillar_rows", """
select asset_id, 'History' as pillar, history_contribution as contribution from x_latest union all
select asset_id, 'Risk', risk_contribution from x_latest union all
select asset_id, 'Sentiment', sentiment_contribution from x_latest""", rounds="contribution")
def _(spark, sf):
    return marts.pillar_contribution_rows(marts.signal_summary(latest(spark, sf)))
