"""Registry of checked queries, and the SQL building blocks their oracles share.

Each check pairs a Spark query over the generated tables with the same question in plain SQL. Doubles
that involve inexact arithmetic are rounded on both sides, the same columns to the same digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


@dataclass
class Check:
    name: str
    run: Callable
    sql: str | None
    rounds: tuple[str, ...]


CHECKS: dict[str, Check] = {}


def rounded(column: str, digits: int = DIGITS):
    """Rounded half away from zero on the binary value, as the SQL side does; Spark's ``round`` goes through decimal text, the dearest step of a wide row.

    Scaled values past the range of a double stay as they are. Adding zero turns a negative zero into zero.
    """
    x = F.col(column)
    scaled = x * F.lit(10.0 ** digits)
    whole = F.rint(scaled)
    tie = F.when(scaled - whole == 0.5 * F.signum(scaled), F.signum(scaled)).otherwise(F.lit(0.0))
    return F.when(F.abs(scaled) < F.lit(float("inf")), (whole + tie) / F.lit(10.0 ** digits)).otherwise(x) + F.lit(0.0)


def check(name: str, sql: str | None = None, rounds: str = "", digits: int = DIGITS):
    """Register a query. ``sql`` may use any block of ``BLOCKS`` by name."""
    columns = tuple(rounds.split())

    def register(fn):
        def run(spark, sf_dir) -> DataFrame:
            df = fn(spark, sf_dir)
            kinds = dict(df.dtypes)
            return df.withColumns({c: rounded(c, digits) if kinds[c] == "double" else F.round(F.col(c), digits) + F.lit(0.0) for c in columns}) if columns else df
        text = None
        if sql is not None:
            text = f"{with_blocks(sql)}\n{sql.strip()}"
            if columns:
                text = (f"{with_blocks(sql)}\nselect * replace ("
                        + ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in columns)
                        + f") from (\n{sql.strip()}\n) checked")
        CHECKS[name] = Check(name, run, text, columns)
        return fn
    return register


BLOCKS: dict[str, str] = {}


def with_blocks(sql: str) -> str:
    """WITH clause holding the blocks that ``sql`` mentions, directly or through other blocks."""
    import re
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(BLOCKS[name])
                if name not in wanted:
                    wanted.append(name)
    visit(sql)
    return "with " + ",\n".join(f"{n} as materialized (\n{BLOCKS[n].strip()}\n)" for n in wanted) if wanted else ""


BLOCKS["x_asset"] = """
select s_suppkey as asset_id,
       case when s_suppkey = 0 then 'SPY' else 'S' || lpad(s_suppkey::varchar, 6, '0') end as ticker,
       s_name as asset_name, case when s_suppkey % 5 = 0 then 'ETF' else 'Equity' end as asset_class,
       'X' || n_regionkey::varchar as exchange, 'USD' as currency,
       case when s_suppkey % 4 <> 0 then 'sector ' || (s_suppkey % 11)::varchar end as sector,
       cast(null as varchar) as industry, n_name as country, s_acctbal >= 0 as is_active,
       case when s_suppkey % 10 <> 9 then s_suppkey % 2 + 1 end as primary_source_id
from supplier join nation on s_nationkey = n_nationkey
"""

BLOCKS["x_source"] = """
select * from (values (1::bigint, 'feed_f', 'market_data'), (2, 'feed_o', 'market_data'), (3, 'click', 'news_api'),
  (4, 'error', 'news_api'), (5, 'purchase', 'news_api'), (6, 'signup', 'news_api'), (7, 'view', 'news_api'))
  t(source_id, source_name, source_type)
"""

_BAR = """max(l_extendedprice / l_quantity) as high_price, min(l_extendedprice / l_quantity) as low_price,
       sum(l_extendedprice::decimal(18,2))::double / sum(l_quantity::decimal(18,2))::double as close_price,
       sum(l_quantity::decimal(18,2))::bigint as volume"""

BLOCKS["x_bar"] = f"""
select *, coalesce(adjusted_close, close_price) as analysis_price from (
  select *, lag(close_price) over (partition by asset_id order by price_date) as open_price,
         case when day(price_date) % 7 <> 0 then close_price end as adjusted_close
  from (select l_suppkey as asset_id, l_shipdate::date as price_date, {_BAR} from lineitem group by 1, 2))
"""

BLOCKS["x_feed"] = f"""
select *, lag(close_price) over (partition by asset_id, source_id order by price_date) as open_price,
       case when day(price_date) % 7 <> 0 then close_price end as adjusted_close,
       price_date::timestamp + to_hours(18 + source_id) as ingestion_timestamp
from (select l_suppkey as asset_id, case when l_linestatus = 'F' then 1 else 2 end::bigint as source_id,
             l_shipdate::date as price_date, {_BAR} from lineitem group by 1, 2, 3)
"""

_LABEL = ("case when {s} >= 0.2 then 'positive' when {s} <= -0.2 then 'negative' "
          "when {s} is not null then 'neutral' end")

BLOCKS["x_article"] = f"""
select *, {_LABEL.format(s="sentiment_score")} as sentiment_label, published_at + interval 1 hour as ingestion_timestamp
from (select user_id as asset_id, source_id, event_id::varchar as provider_article_id,
             'desk ' || event_type as publisher_name, 'Item ' || event_id::varchar as headline, props as summary,
             'https://news.test/' || event_id::varchar as url, ts - interval 8219 day as published_at,
             greatest(least((value::decimal(10,2) - 35)::double / 100.0, 1.0), -1.0) as sentiment_score,
             cast(null as varchar) as query_text
      from events left join x_source on source_name = event_type)
"""

# words are cut on white space, stripped of punctuation and lower-cased
BLOCKS["x_text"] = f"""
select *, {_LABEL.format(s="sentiment_score")} as sentiment_label from (
  select doc_id, doc_id % (select count(*) from supplier) as asset_id, source as source_name,
         (date '1995-01-01' + ((doc_id * 7919) % 2400)::int)::timestamp as published_at,
         split_part(text, chr(10), 1) as headline,
         coalesce(round_even(((p - n)::double / nullif(p + n, 0))::double, 4), 0.0) as sentiment_score
  from (select *, len(list_filter(w, lambda x: x in ('the', 'of', 'and'))) as p,
               len(list_filter(w, lambda x: x in ('a', 'in', 'to'))) as n
        from (select *, list_transform(regexp_split_to_array(text, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+'),
                                       lambda x: lower(trim(x, '.,:;!?()[]{{}}"'''))) as w from documents)))
"""

BLOCKS["x_run"] = """
select o_orderkey as run_id, 'S' || lpad(o_custkey::varchar, 6, '0') as ticker,
       case when left(o_orderpriority, 1) in ('1', '2', '3') then 'feed_f' else 'feed_o' end as provider_name,
       case when o_custkey % 5 = 0 then 'ETF' else 'Equity' end as asset_type, o_orderdate::timestamp as started_at,
       case o_orderstatus when 'F' then 'success' when 'P' then 'timeout' else 'provider_error' end as fetch_status,
       case o_orderstatus when 'F' then null else 'status ' || o_orderstatus end as error_message,
       floor(o_totalprice)::bigint as record_count_fetched, floor(o_totalprice / 2)::bigint as records_written,
       o_orderdate::date - 365 as coverage_start_date, o_orderdate::date as coverage_end_date
from orders
"""

_W = "(partition by asset_id order by {d} rows between {n} preceding and current row)"


def rolled(fn: str, x: str, n: int, date: str = "price_date", least: int | None = None) -> str:
    w = _W.format(d=date, n=n - 1)
    return f"case when count({x}) over {w} >= {least or n} then {fn}({x}) over {w} end"


_S = "(partition by asset_id order by price_date)"

BLOCKS["x_level"] = f"""
select b.*, ticker, analysis_price as p, analysis_price / lag(analysis_price) over {_S} - 1 as daily_return,
       ln(analysis_price) - lag(ln(analysis_price)) over {_S} as log_return,
       analysis_price / max(analysis_price) over (partition by asset_id order by price_date rows unbounded preceding) - 1
         as drawdown_from_peak,
       {", ".join(f"analysis_price / lag(analysis_price, {k}) over {_S} - 1 as momentum_{k}d" for k in (5, 10, 20))},
       volume::double / nullif(lag(volume) over {_S}, 0) - 1 as volume_change_1d,
       lead(analysis_price, 20) over {_S} / analysis_price - 1 as target_forward_return_20d
from x_bar b join x_asset using (asset_id)
"""

BLOCKS["x_tech"] = f"""
select asset_id, ticker, price_date as feature_date, p as analysis_price, close_price, adjusted_close, volume, daily_return,
  {", ".join(f"lag(daily_return, {k}) over {_S} as return_lag_{k}d" for k in (1, 5, 10))},
  {", ".join(f"{rolled('avg', 'daily_return', n)} as rolling_mean_return_{n}d" for n in (5, 20))},
  {", ".join(f"{rolled('stddev_samp', 'daily_return', n)} as rolling_volatility_{n}d" for n in (10, 20))},
  sqrt(252.0) * {rolled('stddev_samp', 'log_return', 20)} as realized_volatility_20d,
  sqrt(252.0) * {rolled('stddev_samp', 'log_return', 5)} as recent_realized_volatility_5d,
  momentum_5d, momentum_10d, momentum_20d,
  {", ".join(f"p / ({rolled('avg', 'p', n)}) - 1 as ma_distance_{n}d" for n in (10, 20))},
  drawdown_from_peak, {rolled('min', 'drawdown_from_peak', 20)} as rolling_drawdown_20d,
  {rolled('stddev_samp', 'downside', 20)} as downside_volatility_20d, (high_price - low_price) / p as intraday_range_pct,
  volume_change_1d, volume / nullif({rolled('avg', 'volume', 20)}, 0) as volume_ratio_20d,
  (volume - ({rolled('avg', 'volume', 20)})) / nullif({rolled('stddev_samp', 'volume', 20)}, 0) as volume_zscore_20d,
  target_forward_return_20d,
  case when target_forward_return_20d is not null then (target_forward_return_20d < 0)::int end
    as target_negative_return_20d, 'v1' as feature_version
from (select *, case when daily_return is not null then least(daily_return, 0.0) end as downside from x_level)
"""

_EXACT = "sum({x}::decimal(18,10))::double"

BLOCKS["x_day"] = f"""
select asset_id, feature_date, count(*) as article_count_1d,
       {_EXACT.format(x="sentiment_score")} / count(*) as sentiment_mean_1d,
       count(*) filter (lower(sentiment_label) = 'negative')::double / count(*) as negative_article_share_1d,
       count(*) filter (lower(sentiment_label) = 'positive')::double / count(*) as positive_article_share_1d,
       count(distinct source_name) as source_count_1d
from (select *, published_at::date as feature_date from x_article join x_source using (source_id)
      join (select asset_id from x_asset) using (asset_id))
group by 1, 2
"""

BLOCKS["x_dispersion"] = f"""
select asset_id, feature_date, stddev_samp(m) as source_sentiment_dispersion_1d
from (select asset_id, published_at::date as feature_date, source_id, {_EXACT.format(x="sentiment_score")} / count(*) as m
      from x_article join (select asset_id from x_asset) using (asset_id) group by 1, 2, 3) group by 1, 2
"""

_W7 = _W.format(d="feature_date", n=6)

BLOCKS["x_sent"] = f"""
select asset_id, feature_date, article_count_1d, sentiment_mean_1d,
  avg(sentiment_mean_1d) over {_W7} as sentiment_mean_7d,
  {rolled('stddev_samp', 'sentiment_mean_1d', 7, 'feature_date', 2)} as sentiment_std_7d,
  avg(negative_article_share_1d) over {_W7} as negative_article_share_7d,
  avg(positive_article_share_1d) over {_W7} as positive_article_share_7d,
  (sum(article_count_1d) over {_W7})::bigint as article_count_7d, max(source_count_1d) over {_W7} as source_count_7d,
  avg(source_sentiment_dispersion_1d) over {_W7} as source_sentiment_dispersion_7d
from x_day join x_dispersion using (asset_id, feature_date)
"""

BLOCKS["x_store"] = "select * from x_tech left join x_sent using (asset_id, feature_date)"

SENTIMENT = ["article_count_1d", "sentiment_mean_1d", "sentiment_mean_7d", "sentiment_std_7d",
             "negative_article_share_7d", "positive_article_share_7d", "article_count_7d", "source_count_7d",
             "source_sentiment_dispersion_7d"]
_F = "(partition by asset_id order by feature_date)"

BLOCKS["x_trail"] = f"""
select *, analysis_price / lag(analysis_price, 60) over {_F} - 1 as trailing_return_60d,
  sentiment_mean_7d - lag(sentiment_mean_7d, 7) over {_F} as sentiment_change_7d,
  (article_count_1d - ({rolled('avg', 'article_count_1d', 30, 'feature_date', 5)}))
    / nullif({rolled('stddev_samp', 'article_count_1d', 30, 'feature_date', 5)}, 0) as article_volume_zscore_30d
from (select * replace ({", ".join(f"coalesce({c}, 0)::double as {c}" for c in SENTIMENT)}) from x_store)
"""

BLOCKS["x_ratio"] = """
select *, momentum_20d as trailing_return_20d, ma_distance_10d - ma_distance_20d as moving_average_spread_10_20,
  rolling_mean_return_20d / nullif(rolling_volatility_20d, 0) as sharpe_like_ratio_20d,
  momentum_20d / nullif(realized_volatility_20d, 0) as trend_strength_20d,
  momentum_20d * volume_ratio_20d as volume_confirmation_20d,
  rolling_mean_return_20d - 1.65::double * rolling_volatility_20d as value_at_risk_20d,
  rolling_mean_return_20d - 2.06::double * rolling_volatility_20d as expected_shortfall_20d,
  (recent_realized_volatility_5d / sqrt(252.0)) / nullif(realized_volatility_20d / sqrt(252.0), 0) as volatility_regime_20d,
  drawdown_from_peak - rolling_drawdown_20d as drawdown_regime_20d,
  momentum_20d - 1.65::double * realized_volatility_20d * sqrt(20.0::double / 252.0) as stress_return_20d,
  20 * rolling_mean_return_20d - 1.65::double * (realized_volatility_20d / sqrt(252.0)) * sqrt(20.0) as monte_carlo_downside_20d,
  downside_volatility_20d / nullif(rolling_volatility_20d, 0) as downside_ratio_20d,
  sentiment_mean_1d - sentiment_mean_7d as sentiment_trend_7d,
  0.55::double * sentiment_mean_7d + 0.20::double * (positive_article_share_7d - negative_article_share_7d)
    + 0.15::double * tanh(coalesce(article_volume_zscore_30d, 0) / 2) + 0.10::double * tanh(source_count_7d / 4)
    as combined_sentiment_score_7d
from x_trail
"""

BLOCKS["x_proxy"] = """
select feature_date, avg(daily_return) as benchmark_daily_return, avg(momentum_20d) as benchmark_momentum_20d,
       avg(trailing_return_60d) as benchmark_momentum_60d
from x_ratio where ticker in ('SPY', 'VOO', 'IVV', '^GSPC')
   or not exists (select 1 from x_ratio where ticker in ('SPY', 'VOO', 'IVV', '^GSPC'))
group by 1
"""

BLOCKS["x_relative"] = """
select *, daily_return - benchmark_daily_return as benchmark_relative_return_1d,
       momentum_20d - benchmark_momentum_20d as benchmark_relative_momentum_20d,
       trailing_return_60d - benchmark_momentum_60d as benchmark_relative_return_60d
from x_ratio left join x_proxy using (feature_date)
"""


def _mean_tanh(parts: str) -> str:
    terms = [t.split("/") for t in parts.split(",")]
    return "(" + " + ".join(f"tanh(coalesce({c.strip()}, 0) / {s.strip()}::double)" for c, s in terms) + f") / {len(terms)}.0"


BLOCKS["x_model"] = f"""
select *, (history_score + risk_score + sentiment_score) / 3.0 as pillar_composite_pre_ml from (select *,
  {_mean_tanh("momentum_5d / 0.05, trailing_return_20d / 0.10, trailing_return_60d / 0.18, moving_average_spread_10_20 / 0.04, sharpe_like_ratio_20d / 1.5, benchmark_relative_momentum_20d / 0.08, volume_confirmation_20d / 0.12")} as history_score,
  {_mean_tanh("-realized_volatility_20d / 0.45, -downside_volatility_20d / 0.03, drawdown_from_peak / 0.20, value_at_risk_20d / 0.05, expected_shortfall_20d / 0.07, stress_return_20d / 0.10, monte_carlo_downside_20d / 0.10, calm / 0.60")} as risk_score,
  {_mean_tanh("sentiment_mean_7d / 0.50, sentiment_trend_7d / 0.25, -sentiment_std_7d / 0.40, article_volume_zscore_30d / 2, combined_sentiment_score_7d / 0.50, positive_article_share_7d / 0.60, -negative_article_share_7d / 0.60, source_count_7d / 4")} as sentiment_score
  from (select *, 1 - coalesce(volatility_regime_20d, 1) as calm from x_relative))
"""

# a stored prediction per asset and date, made from features so that both sides can compute it
BLOCKS["x_raw_signal"] = """
select asset_id, ticker, feature_date as as_of_date, target_forward_return_20d, target_negative_return_20d,
       momentum_20d as raw_return, trailing_return_60d as raw_challenger, 1 / (1 + exp(-3 * momentum_5d)) as raw_probability,
       history_score, risk_score, sentiment_score, realized_volatility_20d, downside_volatility_20d
from x_model where momentum_20d is not null
"""

BLOCKS["x_prediction"] = """
select asset_id, as_of_date, 20 as prediction_horizon_days, 'run-' || year(as_of_date)::varchar as model_run_id,
  'ridge_regression' as regression_model_name, 'random_forest_classifier' as classification_model_name,
  'ridge_regression' as selected_model_name,
  r as predicted_return_20d, 1 - p as downside_probability_20d, p as probability_positive_20d,
  (1 - p >= 0.5)::int as predicted_negative_return_flag, s as composite_ml_score,
  case when c is not null then least(greatest(0.30::double * least(abs(r) / 0.25, 1) + 0.20::double * least(abs(2 * p - 1), 1)
    + 0.25::double * (1 - least(abs(r - c) / 0.25, 1))
    + 0.25::double * (1 - least(abs(1 / (1 + exp(-(r / 0.25))) - p), 1)), 0), 1) end as confidence_score,
  case when s >= 20 then 'Favorable' when s <= -20 then 'Unfavorable' else 'Neutral' end as directional_signal,
  history_score, risk_score, sentiment_score,
  0.1::double * history_score as history_contribution, 0.1::double * risk_score as risk_contribution,
  0.1::double * sentiment_score as sentiment_contribution, as_of_date::timestamp + interval 1 day as prediction_generated_at
from (select *, 100 * (0.45::double * tanh(r / 0.25) + 0.35::double * (2 * p - 1)
                       + 0.20::double * ((history_score + risk_score + sentiment_score) / 3.0)) as s
      from (select *, least(greatest(raw_return, -0.6), 0.6) as r,
                   case when raw_challenger is not null then least(greatest(raw_challenger, -0.6), 0.6) end as c,
                   raw_probability as p from x_raw_signal))
"""

BLOCKS["x_model_run"] = """
select 'run-' || y::varchar as run_id, make_date(y, 12, 31)::timestamp as run_timestamp,
       '{"year": ' || y::varchar || '}' as evaluation_summary, 'v1' as feature_version
from (select distinct year(price_date)::int as y from x_bar)
"""
