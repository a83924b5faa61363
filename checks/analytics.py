"""Checks of returns, risk and sentiment analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BLOCKS, check, rolled
from marketloom.operators import returns, risk, sentiment
from marketloom.operators.windows import last_rows
from marketloom.sources import demo_universe as u

_S = "(partition by asset_id order by price_date)"

BLOCKS["x_return"] = f"""
select asset_id, price_date, analysis_price as price, analysis_price / lag(analysis_price) over {_S} - 1 as daily_return,
  analysis_price / first_value(analysis_price) over {_S} - 1 as cumulative_return,
  ln(analysis_price) - lag(ln(analysis_price)) over {_S} as log_return,
  max(analysis_price) over (partition by asset_id order by price_date rows unbounded preceding) as running_peak
from x_bar
"""
BLOCKS["x_risk"] = f"""
select *, price / running_peak - 1 as drawdown, sqrt(252.0) * {rolled('stddev_samp', 'daily_return', 21)} as rolling_volatility
from x_return
"""
BLOCKS["x_cutoff"] = "select asset_id, quantile_cont(daily_return, 0.05) as cutoff from x_return group by 1"
BLOCKS["x_kpi"] = """
select asset_id, count(*) as price_count, arg_min(price, price_date) as first_price, arg_max(price, price_date) as last_price,
  min(price_date) as coverage_start, max(price_date) as coverage_end,
  arg_max(price, price_date) / arg_min(price, price_date) - 1 as total_return,
  pow(arg_max(price, price_date) / arg_min(price, price_date), 252.0 / (count(*) - 1)) - 1 as annualized_return,
  count(daily_return) as return_count, stddev_samp(daily_return) * sqrt(252.0) as annualized_volatility,
  min(drawdown) as max_drawdown, -max(cutoff) as historical_var,
  -avg(daily_return) filter (daily_return <= cutoff) as expected_shortfall,
  arg_max(rolling_volatility, price_date) filter (rolling_volatility is not null) as latest_rolling_volatility,
  avg(daily_return) as daily_drift, stddev_samp(daily_return) as daily_volatility
from x_risk join x_cutoff using (asset_id) group by 1
"""
_RISK = "annualized_volatility max_drawdown historical_var expected_shortfall latest_rolling_volatility"


@check("w01_daily_returns", "select asset_id, price_date, daily_return from x_return", rounds="daily_return")
def _(spark, sf):
    return returns.return_frame(u.bars(spark, sf)).select("asset_id", "price_date", "daily_return")


@check("w02_cumulative_returns", """
select asset_id, price_date, cumulative_return from x_return where daily_return is not null""", rounds="cumulative_return")
def _(spark, sf):
    return returns.cumulative_return_series(u.bars(spark, sf))


@check("w03_return_frame", """
select asset_id, price_date, price, daily_return, cumulative_return, log_return from x_return""",
       rounds="daily_return cumulative_return log_return")
def _(spark, sf):
    return returns.return_frame(u.bars(spark, sf))


@check("w04_drawdowns", "select asset_id, price_date, price, running_peak, drawdown from x_risk", rounds="drawdown")
def _(spark, sf):
    return risk.drawdown_series(u.bars(spark, sf))


@check("w05_rolling_volatility", "select asset_id, price_date, daily_return, rolling_volatility from x_risk",
       rounds="daily_return rolling_volatility")
def _(spark, sf):
    return risk.rolling_volatility(u.bars(spark, sf))


@check("a05_a06_return_totals", """
select asset_id, price_count, first_price, last_price, total_return, annualized_return from x_kpi""",
       rounds="total_return annualized_return")
def _(spark, sf):
    return returns.return_totals(u.bars(spark, sf))


@check("a07_annualized_volatility", "select asset_id, annualized_volatility from x_kpi", rounds="annualized_volatility")
def _(spark, sf):
    r = returns.return_frame(u.bars(spark, sf))
    return r.groupBy("asset_id").agg(risk.annualize(F.stddev_samp("daily_return")).alias("annualized_volatility"))


@check("a08_max_drawdown", "select asset_id, max_drawdown from x_kpi", rounds="max_drawdown")
def _(spark, sf):
    return risk.drawdown_series(u.bars(spark, sf)).groupBy("asset_id").agg(F.min("drawdown").alias("max_drawdown"))


@check("a09_historical_var", """
select asset_id, -quantile_cont(daily_return, 0.05) as var_95, -quantile_cont(daily_return, 0.01) as var_99
from x_return group by 1""", rounds="var_95 var_99")
def _(spark, sf):
    q = F.percentile("daily_return", [0.05, 0.01]).alias("q")
    return returns.return_frame(u.bars(spark, sf)).groupBy("asset_id").agg(q).select(
        "asset_id", (-F.col("q")[0]).alias("var_95"), (-F.col("q")[1]).alias("var_99"))


@check("a10_expected_shortfall", "select asset_id, historical_var, expected_shortfall from x_kpi",
       rounds="historical_var expected_shortfall")
def _(spark, sf):
    return risk.risk_summary(u.bars(spark, sf)).select("asset_id", "historical_var", "expected_shortfall")


@check("a11_risk_summary", f"select asset_id, return_count, {', '.join(_RISK.split())} from x_kpi", rounds=_RISK)
def _(spark, sf):
    return risk.risk_summary(u.bars(spark, sf))


@check("j07_cutoff_on_rows", "select asset_id, price_date, daily_return, cutoff from x_risk join x_cutoff using (asset_id)",
       rounds="daily_return cutoff")
def _(spark, sf):
    return risk.risk_frame(u.bars(spark, sf)).select("asset_id", "price_date", "daily_return", "cutoff")


# --- sentiment --------------------------------------------------------------------------------

def articles(spark, sf):
    src = u.data_sources(spark, sf).select("source_id", "source_name")
    known = u.assets(spark, sf).select("asset_id")
    return u.news_articles(spark, sf).join(known, "asset_id", "left_semi").join(src, "source_id")


_DAILY = "sentiment_mean_1d negative_article_share_1d positive_article_share_1d"


@check("a12_daily_sentiment", f"""
select asset_id, feature_date, article_count_1d, {', '.join(_DAILY.split())}, source_count_1d from x_day""", rounds=_DAILY)
def _(spark, sf):
    return sentiment.daily_sentiment(articles(spark, sf)).drop("source_sentiment_dispersion_1d")


@check("a13_source_dispersion", "select * from x_dispersion", rounds="source_sentiment_dispersion_1d")
def _(spark, sf):
    return sentiment.daily_sentiment(articles(spark, sf)).select("asset_id", "feature_date", "source_sentiment_dispersion_1d")


@check("a14_sentiment_summary", """
select asset_id, count(*) as article_count, sum(sentiment_score::decimal(18,10))::double / count(*) as average_sentiment,
  count(*) filter (sentiment_label = 'positive') as positive_count,
  count(*) filter (sentiment_label = 'negative') as negative_count,
  count(*) filter (sentiment_label = 'neutral') as neutral_count, max(published_at) as latest_published_at
from x_article group by 1""", rounds="average_sentiment")
def _(spark, sf):
    return sentiment.sentiment_summary(u.news_articles(spark, sf))


@check("a15_sentiment_trend", """
select asset_id, d as published_date, article_count,
  (f + case when 2 * rest > n or (2 * rest = n and f % 2 <> 0) then 1 else 0 end) / 10000.0::double as average_sentiment
from (select *, s - f * n as rest from (select *, floor(s::double / n)::bigint as f from (
  select asset_id, published_at::date as d, count(*) as n, count(headline) as article_count,
         sum((sentiment_score::decimal(18,10) * 10000)::bigint)::bigint as s from x_article group by 1, 2)))""")
def _(spark, sf):
    return sentiment.sentiment_trend(u.news_articles(spark, sf))


@check("a15_text_sentiment_trend", """
select asset_id, d as published_date, article_count,
  (f + case when 2 * rest > n or (2 * rest = n and f % 2 <> 0) then 1 else 0 end) / 10000.0::double as average_sentiment
from (select *, s - f * n as rest from (select *, floor(s::double / n)::bigint as f from (
  select asset_id, published_at::date as d, count(*) as n, count(headline) as article_count,
         sum((sentiment_score::decimal(18,10) * 10000)::bigint)::bigint as s from x_text group by 1, 2)))""")
def _(spark, sf):
    return sentiment.sentiment_trend(u.text_articles(spark, sf))


_SENT = ("sentiment_mean_1d sentiment_mean_7d sentiment_std_7d negative_article_share_7d positive_article_share_7d "
         "source_sentiment_dispersion_7d")


@check("w18_sentiment_features", "select * from x_sent", rounds=_SENT, digits=10)
def _(spark, sf):
    return sentiment.sentiment_features(articles(spark, sf))


@check("w18_trailing_counts_of_texts", """
select asset_id, d as feature_date, n as article_count_1d, (sum(n) over (partition by asset_id order by d
  rows between 6 preceding and current row))::bigint as article_count_7d
from (select asset_id, published_at::date as d, count(*) as n from x_text group by 1, 2)""")
def _(spark, sf):
    daily = sentiment.daily_sentiment(u.text_articles(spark, sf))
    return daily.select("asset_id", "feature_date", "article_count_1d",
                        F.sum("article_count_1d").over(last_rows(7, "feature_date")).alias("article_count_7d"))
