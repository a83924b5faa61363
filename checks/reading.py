"""Checks of sources, sinks, upserts, reads, joins, coverage and top-k queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import BLOCKS, check
from marketloom.functions import columns as fc
from marketloom.operators import reads, upsert
from marketloom.session import scratch_path
from marketloom.sources import demo_universe as u
from marketloom.sources import normalize, schemas
from marketloom.sources.lake import LakeTable

_FEED = "asset_id, source_id, price_date, open_price, high_price, low_price, close_price, adjusted_close, volume, ingestion_timestamp"


@check("s01_typed_scan", """
select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'F'""")
def _(spark, sf):
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    rows = spark.read.schema(schema).parquet(f"{sf}/orders.parquet")
    return rows.where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).drop("o_orderstatus")


@check("s02_normalize_bars", """
select l_suppkey as asset_id, l_shipdate::date as price_date, l_extendedprice as open_price,
  l_extendedprice + 1 as high_price, l_extendedprice - 1 as low_price,
  l_extendedprice * (1 - l_discount) as close_price,
  case when l_linestatus = 'F' then l_extendedprice * (1 - l_discount) end as adjusted_close,
  l_quantity::bigint as volume
from lineitem where l_returnflag <> 'R'""", rounds="open_price high_price low_price close_price adjusted_close")
def _(spark, sf):
    bars = normalize.normalize_bars(u.raw_daily_rows(spark, sf))
    return bars.withColumns({c: F.col(c).cast("double") for c in
                             ("open_price", "high_price", "low_price", "close_price", "adjusted_close")})


BLOCKS["x_metadata"] = """
select 'S' || lpad(c_custkey::varchar, 6, '0') as ticker,
  coalesce(case when c_custkey % 3 <> 0 then c_name end, case when c_custkey % 2 <> 0 then 'Long ' || c_name end,
           lower(c_mktsegment)) as asset_name,
  case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then c_mktsegment else lower(c_mktsegment) end as asset_class,
  case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 'NYS' else 'ARC' end as exchange,
  case when c_custkey % 6 = 0 then 'EUR' when c_custkey % 7 = 0 then 'GBP' else 'USD' end as currency,
  case when c_custkey % 2 = 0 then c_mktsegment end as sector, cast(null as varchar) as industry,
  'C' || c_nationkey::varchar as country, c_acctbal >= 0 as is_active
from customer
"""


@check("s03_normalize_metadata", "select * from x_metadata")
def _(spark, sf):
    return normalize.normalize_metadata(u.raw_metadata(spark, sf))


@check("s04_normalize_feeds", """
select event_id, user_id as asset_id, case event_type when 'click' then 'flat' when 'view' then 'nested'
         else 'nested_without_id' end as shape,
  'beats ' || event_type || ' weak growth' as headline,
  case event_type when 'click' then 'record losses' when 'view' then 'surge; strong, gains!' else props end as summary,
  'https://raw.test/' || event_id::varchar as url, date_trunc('second', ts) as published_at,
  case event_type when 'click' then 'desk' else 'pub ' || event_type end as publisher_name,
  case event_type when 'click' then event_id::varchar when 'view' then 'n' || event_id::varchar
    else left(sha256('https://raw.test/' || event_id::varchar || '|beats ' || event_type || ' weak growth|'
                     || strftime(ts, '%Y-%m-%dT%H:%M:%S')), 24) end as provider_article_id,
  case event_type when 'click' then 0.2::double when 'view' then 0.6667::double else 0.3333::double end as sentiment_score,
  'positive' as sentiment_label
from events where event_type <> 'error'""")
def _(spark, sf):
    return normalize.normalize_feeds(u.raw_feed(spark, sf))


BLOCKS["x_correction"] = f"""
select l_suppkey as asset_id, case when l_linestatus = 'F' then 1 else 2 end::bigint as source_id,
  l_shipdate::date as price_date, max(l_extendedprice / l_quantity) as high_price,
  min(l_extendedprice / l_quantity) as low_price,
  sum(l_extendedprice::decimal(18,2))::double / sum(l_quantity::decimal(18,2))::double as close_price,
  sum(l_quantity::decimal(18,2))::bigint as volume
from lineitem where l_returnflag = 'R' group by 1, 2, 3
"""

@check("s05_upsert_prices", f"""
select * from (select asset_id, source_id, price_date, cast(null as double) as open_price, high_price, low_price,
  close_price, close_price as adjusted_close, volume,
  price_date::timestamp + to_hours(42 + source_id) as ingestion_timestamp from x_correction)
union all
select {_FEED} from x_feed f where not exists (select 1 from x_correction c where c.asset_id = f.asset_id
  and c.source_id = f.source_id and c.price_date = f.price_date)""")
def _(spark, sf):
    return upsert.upsert_prices(u.historical_prices(spark, sf), u.price_corrections(spark, sf))


@check("s05_lake_table_roundtrip", """
select asset_id, source_id, price_date, price_date::timestamp + to_hours(42 + source_id) as ingestion_timestamp, volume
from x_correction
union all
select asset_id, source_id, price_date, ingestion_timestamp, volume from x_feed f where not exists (select 1 from x_correction c
  where c.asset_id = f.asset_id and c.source_id = f.source_id and c.price_date = f.price_date)""")
def _(spark, sf):
    table = LakeTable(spark, scratch_path(spark, "lake"), "historical_prices", ["ingestion_timestamp"])
    table.write_batch(u.historical_prices(spark, sf), 0)
    compacted = table.compact(scratch_path(spark, "snapshot"))
    compacted.write_batch(u.price_corrections(spark, sf), 1)
    return compacted.current().select("asset_id", "source_id", "price_date", "ingestion_timestamp", "volume")


@check("s06_upsert_assets", """
select a.asset_id, coalesce(m.ticker, a.ticker) as ticker, coalesce(m.asset_name, a.asset_name) as asset_name,
  case when m.ticker is not null then m.asset_class else a.asset_class end as asset_class,
  case when m.ticker is not null then m.exchange else a.exchange end as exchange,
  coalesce(m.currency, a.currency) as currency,
  case when m.ticker is not null then m.sector else a.sector end as sector,
  case when m.ticker is not null then m.industry else a.industry end as industry,
  case when m.ticker is not null then m.country else a.country end as country,
  coalesce(m.is_active, a.is_active) as is_active,
  case when m.ticker is not null then 2::bigint else a.primary_source_id end as primary_source_id
from x_asset a full join x_metadata m on a.ticker = m.ticker""")
def _(spark, sf):
    new = normalize.normalize_metadata(u.raw_metadata(spark, sf))
    return upsert.upsert_assets(u.assets(spark, sf), new, primary_source_id=2)


@check("s06_assign_asset_ids", """
select asset_id, ticker from x_asset
union all
select (select max(asset_id) from x_asset) + row_number() over (order by ticker), ticker
from x_metadata where ticker not in (select ticker from x_asset)""")
def _(spark, sf):
    new = normalize.normalize_metadata(u.raw_metadata(spark, sf))
    return upsert.assign_ids(upsert.upsert_assets(u.assets(spark, sf), new)).select("asset_id", "ticker")


@check("s06_upsert_sources", """
select coalesce(s.source_id, null) as source_id, coalesce(n.source_name, s.source_name) as source_name,
       coalesce(n.source_type, s.source_type) as source_type
from x_source s full join (select distinct source as source_name, 'news_text' as source_type from documents
  union select 'feed_f', 'news_text') n on n.source_name = s.source_name""")
def _(spark, sf):
    names = u.read(spark, sf, "documents", "source").select(F.concat(F.lit(" "), "source").alias("source_name")).unionByName(
        u.data_sources(spark, sf).where(F.col("source_id") == 1).select("source_name"))
    new = names.select("source_name", F.lit("news_text ").alias("source_type"), F.lit(None).cast("string").alias("source_url"))
    return upsert.upsert_sources(u.data_sources(spark, sf), new).drop("source_url")


@check("s07_upsert_news", """
select asset_id, source_id, case publisher_name when 'desk view' then null when 'desk click' then 'new-' || provider_article_id
    else provider_article_id end as provider_article_id,
  case when publisher_name in ('desk signup', 'desk click') then url || '/v2' else url end as url,
  'Update ' || headline as headline, published_at, ingestion_timestamp as created_at
from x_article
union all
select asset_id, source_id, provider_article_id, url, headline, published_at, ingestion_timestamp from x_article
where publisher_name = 'desk click'""")
def _(spark, sf):
    old = u.news_articles(spark, sf).withColumn("created_at", F.col("ingestion_timestamp"))
    new = u.news_updates(spark, sf).withColumn("ingestion_timestamp", F.when(
        F.col("publisher_name") == "desk click", F.timestamp_add("HOUR", F.lit(1), F.col("published_at")))
        .otherwise(F.col("ingestion_timestamp")))
    return upsert.upsert_news(old, new).select(
        "asset_id", "source_id", "provider_article_id", "url", "headline", "published_at", "created_at")


@check("s08_upsert_features", """
select asset_id, feature_date, daily_return, 'v1' as feature_version from x_tech where feature_date < date '1999-01-01'
union all
select asset_id, feature_date, momentum_5d, 'v2' from x_tech where feature_date >= date '1999-01-01'""",
       rounds="daily_return")
def _(spark, sf):
    from marketloom.operators.technical import technical_features
    rows = technical_features(u.priced_assets(spark, sf)).select(
        "asset_id", "feature_date", "daily_return", "momentum_5d", "feature_version")
    new = rows.where(F.col("feature_date") >= F.lit("1999-01-01").cast("date")).select(
        "asset_id", "feature_date", F.col("momentum_5d").alias("daily_return"), F.lit("v2").alias("feature_version"))
    return upsert.upsert(rows.drop("momentum_5d"), new, ["asset_id", "feature_date"], ["feature_version"])


@check("s09_schema_evolution", """
select run_id, ticker, cast(null as varchar) as cache_status from x_run where fetch_status <> 'success'
union all select run_id, ticker, 'miss' from x_run where fetch_status = 'success'""")
def _(spark, sf):
    runs = u.ingestion_runs(spark, sf)
    old = runs.where(F.col("fetch_status") != "success").select("run_id", "ticker")
    new = runs.where(F.col("fetch_status") == "success").select("run_id", "ticker", F.lit("miss").alias("cache_status"))
    return upsert.add_missing_columns(old, new)


@check("s10_known_and_rejected_articles", """
select provider_article_id, asset_id, asset_id in (select asset_id from x_asset) as accepted from x_article""")
def _(spark, sf):
    good, bad = upsert.split_known(u.news_articles(spark, sf), u.assets(spark, sf))
    return (good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
            .select("provider_article_id", "asset_id", "accepted"))


BLOCKS["x_state"] = """
select ticker, provider_name,
  max(case when fetch_status = 'success' then started_at end) as last_successful_fetch_at,
  max(started_at) as request_timestamp,
  arg_max(fetch_status, (started_at, run_id)) as fetch_status,
  arg_max(record_count_fetched, case when fetch_status = 'success' then (started_at, run_id) end) as record_count_fetched,
  arg_max(coverage_end_date, case when fetch_status = 'success' then (started_at, run_id) end) as coverage_end_date,
  arg_max(coalesce(error_message, ''), (started_at, run_id)) as error_text, min(started_at) as created_at
from x_run group by 1, 2
"""


@check("s11_ingestion_state", """
select ticker, provider_name, last_successful_fetch_at, request_timestamp, fetch_status, record_count_fetched,
       coverage_end_date, nullif(error_text, '') as error_message, created_at from x_state""")
def _(spark, sf):
    return upsert.ingestion_state(u.ingestion_runs(spark, sf)).select(
        "ticker", "provider_name", "last_successful_fetch_at", "request_timestamp", "fetch_status",
        "record_count_fetched", "coverage_end_date", "error_message", "created_at")


@check("s12_table_inventory", """
select 'assets' as table_name, count(*) as row_count from x_asset union all
select 'data_sources', count(*) from x_source union all select 'historical_prices', count(*) from x_feed union all
select 'news_articles', count(*) from x_article""")
def _(spark, sf):
    return reads.table_inventory({"assets": u.assets(spark, sf), "data_sources": u.data_sources(spark, sf),
                                  "historical_prices": u.historical_prices(spark, sf),
                                  "news_articles": u.news_articles(spark, sf)})


# --- reads ------------------------------------------------------------------------------------

@check("q01_active_assets", """
select ticker, asset_name, asset_class, exchange, currency, is_active from x_asset where is_active""")
def _(spark, sf):
    return reads.asset_list(u.assets(spark, sf))


@check("q02_asset_metadata", """
select ticker, asset_name, asset_class, exchange, currency, sector, industry, country, is_active,
       source_name as primary_source
from x_asset left join x_source on primary_source_id = source_id""")
def _(spark, sf):
    return reads.asset_metadata(u.assets(spark, sf), u.data_sources(spark, sf))


_HISTORY = """
select ticker, price_date, open_price, high_price, low_price, close_price, adjusted_close, volume, source_name,
       ingestion_timestamp from x_feed join x_asset using (asset_id) join x_source using (source_id)"""


@check("q03_price_history_of_one", _HISTORY + """
where ticker = 'S000003' and price_date between date '1996-01-01' and date '1999-12-31'""")
def _(spark, sf):
    return reads.price_history(u.historical_prices(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf),
                               " s000003 ", dt.date(1996, 1, 1), dt.date(1999, 12, 31))


@check("q03_price_history_all", _HISTORY)
def _(spark, sf):
    return reads.price_history(u.historical_prices(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf))


_NEWS = """ticker, publisher_name, headline, summary, url, published_at, sentiment_score, sentiment_label, query_text,
  source_name, ingestion_timestamp from x_article join x_asset using (asset_id) join x_source using (source_id)"""


@check("q04_recent_news_of_one", f"""
select {_NEWS} where ticker = 'S000005' and published_at::date between date '2001-07-05' and date '2001-07-25'
order by published_at desc, url limit 20""")
def _(spark, sf):
    return reads.recent_news(u.news_articles(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf), "S000005", 20,
                             dt.date(2001, 7, 5), dt.date(2001, 7, 25))


@check("q04_recent_news_all", f"""
select * exclude (rn) from (select row_number() over (partition by asset_id order by published_at desc, url) as rn,
  {_NEWS}) where rn <= 20""")
def _(spark, sf):
    return reads.recent_news(u.news_articles(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf))


BLOCKS["x_resolved"] = """
select * exclude (rn) from (select *, row_number() over (partition by asset_id, price_date
  order by source_id desc, ingestion_timestamp desc) as rn from x_feed) where rn = 1
"""


@check("q05_market_feature_source", """
select asset_id, ticker, price_date, open_price, high_price, low_price, close_price, adjusted_close, volume, source_name,
       coalesce(adjusted_close, close_price) as analysis_price
from x_resolved join x_asset using (asset_id) join x_source using (source_id)""")
def _(spark, sf):
    return reads.market_feature_source(u.historical_prices(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf),
                                       source_priority={2: 0, 1: 1})


@check("q06_sentiment_source", """
select asset_id, ticker, published_at, sentiment_score, sentiment_label, source_name
from x_article join x_asset using (asset_id) join x_source using (source_id)""")
def _(spark, sf):
    return reads.sentiment_source(u.news_articles(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf))


@check("q12_resolve_sources", """
select asset_id, price_date, source_id, close_price, volume, ingestion_timestamp from x_resolved""")
def _(spark, sf):
    return reads.resolve_prices(u.historical_prices(spark, sf), {2: 0, 1: 1}).select(
        "asset_id", "price_date", "source_id", "close_price", "volume", "ingestion_timestamp")


@check("q13_dataset_validation", """
select t as ticker, case when a.ticker is null then 'missing_metadata' when coalesce(n, 0) = 0 then 'missing_price_history'
    when n < 2 then 'insufficient_price_history' else 'validated' end as status,
  coalesce(n, 0) as price_rows, coalesce(n, 0) as clean_prices, coalesce(n, 0) >= 2 and a.ticker is not null as success
from (select 'S' || lpad(c_custkey::varchar, 6, '0') as t from customer) r left join x_asset a on a.ticker = t
left join (select asset_id, count(*) as n from x_feed group by 1) using (asset_id)""")
def _(spark, sf):
    requests = u.raw_metadata(spark, sf).select("ticker")
    return reads.dataset_validation(requests, u.assets(spark, sf), u.historical_prices(spark, sf))


@check("q15_feature_columns", """
select unnest(['momentum_5d', 'daily_return', 'volume']) as feature, 62 as feature_count
from (select count(*) from lineitem)""")
def _(spark, sf):
    from checks.features import model_rows
    frame = model_rows(spark, sf)
    names = reads.feature_columns(frame)
    listed = F.explode(F.array(*[F.lit(n) for n in names if n in ("momentum_5d", "daily_return", "volume")]))
    return frame.agg(F.count("*").alias("n")).select(listed.alias("feature"), F.lit(len(names)).alias("feature_count"))


@check("q16_requested_universe", """
select ticker, asset_name, country from x_asset where is_active
 and ticker in (select 'S' || lpad(o_custkey::varchar, 6, '0') from orders)""")
def _(spark, sf):
    requests = u.ingestion_runs(spark, sf).select(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"))
    return upsert.requested_assets(u.assets(spark, sf), requests).select("ticker", "asset_name", "country")


AS_OF = "2001-08-01 12:00:00"


@check("q17_market_freshness", f"""
select ticker, coalesce(n, 0) as price_rows, coalesce(f >= timestamp '{AS_OF}' - interval 9000 hour, false) as metadata_fresh,
  coalesce(f >= timestamp '{AS_OF}' - interval 2000 hour, false) as price_fresh, f as last_successful_fetch_at,
  coalesce(n, 0) > 0 and coalesce(f >= timestamp '{AS_OF}' - interval 2000 hour, false) as is_cache_hit
from x_asset left join (select asset_id, count(*) as n from x_feed group by 1) using (asset_id)
left join (select ticker, max(last_successful_fetch_at) as f from x_state group by 1) using (ticker)""")
def _(spark, sf):
    state = upsert.ingestion_state(u.ingestion_runs(spark, sf))
    return reads.market_freshness(u.assets(spark, sf), u.historical_prices(spark, sf), state,
                                  dt.datetime(2001, 8, 1, 12), metadata_hours=9000, price_hours=2000)


@check("q18_sentiment_freshness", """
select asset_id, max(ingestion_timestamp) as latest_ingestion,
       max(ingestion_timestamp) >= timestamp '2001-07-31 00:00:00' - interval 24 hour as is_fresh
from x_article group by 1""")
def _(spark, sf):
    return reads.sentiment_freshness(u.news_articles(spark, sf), dt.datetime(2001, 7, 31))


# --- joins ------------------------------------------------------------------------------------

@check("j01_fact_to_dimensions", """
select asset_id, ticker, source_name, price_date, close_price from x_feed join x_asset using (asset_id)
join x_source using (source_id)""")
def _(spark, sf):
    return (u.historical_prices(spark, sf).join(u.assets(spark, sf), "asset_id").join(u.data_sources(spark, sf), "source_id")
            .select("asset_id", "ticker", "source_name", "price_date", "close_price"))


@check("j02_optional_dimension", """
select ticker, source_name, source_type from x_asset left join x_source on primary_source_id = source_id""")
def _(spark, sf):
    src = u.data_sources(spark, sf)
    return (u.assets(spark, sf).join(src, F.col("primary_source_id") == src.source_id, "left")
            .select("ticker", "source_name", "source_type"))


@check("j06_stale_tickers", """
select ticker from x_asset where ticker not in (select ticker from x_run where fetch_status = 'success')""")
def _(spark, sf):
    ok = u.ingestion_runs(spark, sf).where(F.col("fetch_status") == "success")
    return u.assets(spark, sf).join(ok, "ticker", "left_anti").select("ticker")


# --- coverage ---------------------------------------------------------------------------------

@check("a01_price_counts", "select ticker, count(*) as price_row_count from x_feed join x_asset using (asset_id) group by 1")
def _(spark, sf):
    return reads.price_counts(u.historical_prices(spark, sf), u.assets(spark, sf))


@check("a02_price_coverage", """
select ticker, min(price_date) as first_price_date, max(price_date) as last_price_date, count(*) as total_rows
from x_feed join x_asset using (asset_id) group by 1""")
def _(spark, sf):
    return reads.price_coverage(u.historical_prices(spark, sf), u.assets(spark, sf))


@check("a03_price_profile", """
select ticker, min(close_price) as min_close_price, max(close_price) as max_close_price, avg(close_price) as avg_close_price,
       min(volume) as min_volume, max(volume) as max_volume, avg(volume) as avg_volume
from x_feed join x_asset using (asset_id) group by 1""", rounds="avg_close_price avg_volume")
def _(spark, sf):
    return reads.price_profile(u.historical_prices(spark, sf), u.assets(spark, sf))


@check("a04_source_counts", """
select source_name, ticker, count(*) as price_row_count
from x_feed join x_asset using (asset_id) join x_source using (source_id) group by 1, 2""")
def _(spark, sf):
    return reads.source_counts(u.historical_prices(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf))


# --- top-k ------------------------------------------------------------------------------------

@check("t01_recent_prices_of_one", f"""
select asset_id, price_date, source_id, close_price, volume from x_feed join x_asset using (asset_id)
where ticker = 'S000002' order by price_date desc, source_id limit 10""")
def _(spark, sf):
    return reads.recent_prices_of(u.historical_prices(spark, sf), u.assets(spark, sf), "S000002").select(
        "asset_id", "price_date", "source_id", "close_price", "volume")


@check("t01_recent_prices_all", """
select asset_id, price_date, open_price, high_price, low_price, close_price, adjusted_close, volume from (
  select *, row_number() over (partition by asset_id order by price_date desc) as rn from x_bar) where rn <= 10""")
def _(spark, sf):
    return reads.recent_prices(u.bars(spark, sf))


@check("t02_price_listing", """
select ticker, asset_name, asset_class, price_date, close_price, volume from x_feed join x_asset using (asset_id)
order by ticker, price_date desc, source_id limit 25""")
def _(spark, sf):
    return reads.price_listing(u.historical_prices(spark, sf), u.assets(spark, sf))


@check("t03_latest_ingested", """
select ticker, price_date, close_price, ingestion_timestamp, source_name
from x_feed join x_asset using (asset_id) join x_source using (source_id)
order by ingestion_timestamp desc, ticker limit 15""")
def _(spark, sf):
    return reads.latest_ingested(u.historical_prices(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf))


@check("t04_joined_sample", """
select ticker, asset_name, source_name, price_date, close_price, adjusted_close, volume
from x_feed join x_asset using (asset_id) join x_source using (source_id)
order by price_date desc, ticker, source_name limit 15""")
def _(spark, sf):
    return reads.joined_sample(u.historical_prices(spark, sf), u.assets(spark, sf), u.data_sources(spark, sf))


@check("t05_recent_headlines", """
select asset_id, strftime(published_at, '%Y-%m-%d %H:%M') as published_at, publisher_name, headline, sentiment_label,
       sentiment_score, source_name, url
from (select *, row_number() over (partition by asset_id order by published_at desc, url) as rn
      from x_article join x_source using (source_id)) where rn <= 8""")
def _(spark, sf):
    articles = u.news_articles(spark, sf).join(u.data_sources(spark, sf).select("source_id", "source_name"), "source_id")
    return reads.recent_headlines(articles)


# --- scalar functions -------------------------------------------------------------------------

@check("f01_ticker_codes", """
select c_custkey, 'C/D-' || c_custkey::varchar || '/X' as raw, 'C-D-' || c_custkey::varchar || '-X' as ticker from customer""")
def _(spark, sf):
    key = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit(" c/ d—"), key, F.lit("/ x "))
    return u.read(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("C/D-"), key, F.lit("/X")).alias("raw"), fc.ticker_code(raw).alias("ticker"))


@check("f02_lexical_scores", "select doc_id, sentiment_score, sentiment_label from x_text")
def _(spark, sf):
    from marketloom.operators.sentiment import score_texts
    docs = u.read(spark, sf, "documents", "doc_id", "text")
    return score_texts(docs, positive=u.DEMO_POSITIVE, negative=u.DEMO_NEGATIVE).drop("text")


@check("f03_labels", "select provider_article_id, sentiment_label from x_article")
def _(spark, sf):
    return u.news_articles(spark, sf).select("provider_article_id", "sentiment_label")


@check("f04_publication_times", """
select event_id, date_trunc('second', ts) as from_seconds, date_trunc('millisecond', ts) as from_millis,
       ts as from_iso, date_trunc('second', ts) - interval 2 hour as from_zoned from events""")
def _(spark, sf):
    e = u.read(spark, sf, "events", "event_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id",
                    fc.published_time(F.unix_seconds("ts").cast("string")).alias("from_seconds"),
                    fc.published_time(F.unix_millis("ts").cast("string")).alias("from_millis"),
                    fc.published_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("from_iso"),
                    fc.published_time(F.concat(iso, F.lit("+02:00"))).alias("from_zoned"))


@check("f05_fallback_ids", """
select event_id, left(sha256('https://news.test/' || event_id::varchar || '|Item ' || event_id::varchar || '|'
  || case when date_trunc('second', ts) = ts then strftime(ts, '%Y-%m-%dT%H:%M:%S')
     else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end), 24) as article_id from events""")
def _(spark, sf):
    n = F.col("event_id").cast("string")
    return u.read(spark, sf, "events").select("event_id", fc.fallback_article_id(
        F.concat(F.lit("https://news.test/"), n), F.concat(F.lit("Item "), n), F.col("ts").cast("timestamp")).alias("article_id"))


@check("f06_query_texts", """select ticker, '"' || ticker || '" OR "' || asset_name || '"' as query_text from x_asset""")
def _(spark, sf):
    return u.assets(spark, sf).select("ticker", fc.news_query_text(F.lower("ticker"), F.col("asset_name")).alias("query_text"))


@check("b04_asset_labels", """
select ticker, ticker || ' | ' || asset_name as label, asset_name, asset_class, exchange, currency from x_asset""")
def _(spark, sf):
    return reads.asset_labels(u.assets(spark, sf))


@check("b05_batch_summary", """
select provider_name, count(*) as tickers_processed, count(*) filter (loaded) as assets_loaded,
       coalesce(sum(rows), 0)::bigint as rows_loaded, sum(runs)::bigint as runs
from (select provider_name, ticker, bool_or(fetch_status = 'success') as loaded, count(*) as runs,
             sum(records_written) filter (fetch_status = 'success') as rows from x_run group by 1, 2) group by 1""")
def _(spark, sf):
    return upsert.batch_summary(u.ingestion_runs(spark, sf))
