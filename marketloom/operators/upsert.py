"""Set-based upserts, referential checks and run-log state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import ticker_code


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str], keep_first: list[str] = ()) -> DataFrame:
    """The last row per key. ``max_by`` combines before the shuffle, so many copies of one key are harmless.

    Columns in ``keep_first`` keep their earliest non-NULL value.
    """
    rank = F.struct(*order)
    payload = [c for c in rows.columns if c not in keys and c not in keep_first]
    winners = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), rank).alias("_last"),
        *[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), rank)).alias(f"_first_{c}")
          for c in keep_first])
    return winners.select(*[
        F.col(c) if c in keys else F.col(f"_first_{c}").alias(c) if c in keep_first else F.col(f"_last.{c}").alias(c)
        for c in rows.columns])


def add_missing_columns(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Additive schema evolution: columns missing on one side are NULL there."""
    return existing.unionByName(new, allowMissingColumns=True)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] = (),
           keep_first: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key; the last by ``order`` wins inside ``new``."""
    both = add_missing_columns(existing.withColumn("_batch", F.lit(0)), new.withColumn("_batch", F.lit(1)))
    return latest_per_key(both, keys, ["_batch", *order], list(keep_first)).drop("_batch")


def upsert_prices(existing: DataFrame, new: DataFrame) -> DataFrame:
    keep = ["created_at"] if "created_at" in existing.columns else []
    return upsert(existing, new, ["asset_id", "source_id", "price_date"], ["ingestion_timestamp"], keep)


def upsert_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Type and url follow the latest record (by ``updated_at``, where there is one); the id stays.

    ``source_id`` stays NULL for sources not seen before, see ``assign_ids``.
    """
    tidy = new.withColumns({"source_name": F.trim("source_name"), "source_type": F.trim("source_type")})
    keep = [c for c in ("source_id", "created_at") if c in existing.columns]
    order = [c for c in ("updated_at",) if c in new.columns]
    return upsert(existing, tidy, ["source_name"], [*order, "source_type", "source_url"], keep)


def upsert_assets(existing: DataFrame, records: DataFrame, primary_source_id: int | None = None) -> DataFrame:
    """Attributes follow the new record, also when it lacks them; currency and activity have defaults.

    ``asset_id`` stays NULL for assets not seen before, see ``assign_ids``.
    """
    named = records.withColumn("ticker", F.upper(F.trim("ticker")))
    for column in ("asset_class", "exchange", "sector", "industry", "country", "currency"):
        if column not in named.columns:
            named = named.withColumn(column, F.lit(None).cast("string"))
    if "is_active" not in named.columns:
        named = named.withColumn("is_active", F.lit(None).cast("boolean"))
    order = [c for c in ("fetched_at", "asset_name") if c in named.columns]
    n = latest_per_key(named, ["ticker"], order).alias("n")
    e = existing.alias("e")
    seen = F.col("n.ticker").isNotNull()

    def follow(column):
        return F.when(seen, F.col(f"n.{column}")).otherwise(F.col(f"e.{column}")).alias(column)

    source = F.col("e.primary_source_id")
    if primary_source_id is not None:
        source = F.when(seen, F.lit(primary_source_id).cast("long")).otherwise(source)
    return e.join(n, F.col("e.ticker") == F.col("n.ticker"), "full_outer").select(
        F.col("e.asset_id").alias("asset_id"),
        F.coalesce("n.ticker", "e.ticker").alias("ticker"),
        F.when(seen, F.trim("n.asset_name")).otherwise(F.col("e.asset_name")).alias("asset_name"),
        follow("asset_class"), follow("exchange"),
        F.coalesce("n.currency", "e.currency", F.lit("USD")).alias("currency"),
        follow("sector"), follow("industry"), follow("country"),
        F.when(seen, F.coalesce("n.is_active", F.lit(True))).otherwise(F.col("e.is_active")).alias("is_active"),
        source.alias("primary_source_id"),
    )


def assign_ids(rows: DataFrame, id_column: str = "asset_id", key: str = "ticker") -> DataFrame:
    """Give rows without an id the next free ids, in the order of their key: assets by ticker, sources by name."""
    from marketloom.operators.ranking import dense_row_number

    known = rows.where(F.col(id_column).isNotNull())
    fresh = dense_row_number(rows.where(F.col(id_column).isNull()), [key], "_rank")
    top = known.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    return known.unionByName(fresh.withColumn(id_column, F.col("_rank") + top).drop("_rank").select(*rows.columns))


def upsert_news(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Two-key upsert inside (asset, source): match on the provider id, else on the url.

    A new article replaces every stored article it matches on either key, so both keys stay unique.
    The same article under two assets stays two rows.
    """
    scope = ["asset_id", "source_id"]
    tidy = new.withColumns({
        "headline": F.trim("headline"), "url": F.trim("url"),
        "provider_article_id": F.nullif(F.trim("provider_article_id"), F.lit("")),
    }).where((F.length("headline") > 0) & (F.length("url") > 0))
    order = ["ingestion_timestamp", "published_at", "headline"]
    by_id = latest_per_key(tidy.where(F.col("provider_article_id").isNotNull()), [*scope, "provider_article_id"],
                           [*order, "url"])
    batch = latest_per_key(by_id.unionByName(tidy.where(F.col("provider_article_id").isNull()))
                           .withColumn("_id", F.coalesce("provider_article_id", F.lit(""))),
                           [*scope, "url"], [*order, "_id"]).drop("_id")
    # keys of every incoming article, also of those replaced later in the same batch
    kept = (existing
            .join(tidy.where(F.col("provider_article_id").isNotNull()).select(*scope, "provider_article_id"),
                  [*scope, "provider_article_id"], "left_anti")
            .join(tidy.select(*scope, "url"), [*scope, "url"], "left_anti"))
    if "created_at" in existing.columns:
        id_match = existing.where(F.col("provider_article_id").isNotNull()).select(
            *scope, "provider_article_id", F.col("created_at").alias("_created_by_id"))
        url_match = existing.select(*scope, "url", F.col("created_at").alias("_created_by_url"))
        batch = (batch.drop("created_at")
                 .join(id_match, [*scope, "provider_article_id"], "left")
                 .join(url_match, [*scope, "url"], "left")
                 .withColumn("created_at", F.coalesce("_created_by_id", "_created_by_url", "ingestion_timestamp"))
                 .drop("_created_by_id", "_created_by_url"))
    return add_missing_columns(kept, batch)


def split_known(rows: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether the asset exists. Assets are unique, so AQE may broadcast them."""
    ids = assets.select("asset_id")
    return rows.join(ids, "asset_id", "left_semi"), rows.join(ids, "asset_id", "left_anti")


def requested_assets(assets: DataFrame, requests: DataFrame, active_only: bool = True) -> DataFrame:
    """Assets whose ticker is in the request list."""
    wanted = requests.select(F.upper(F.trim("ticker")).alias("ticker"))
    pool = assets.where("is_active") if active_only else assets
    return pool.join(wanted, "ticker", "left_semi")


def normalized_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("normalized_ticker", ticker_code(F.col("ticker")))


def ingestion_state(runs: DataFrame) -> DataFrame:
    """Current state per (ticker, provider): a success sets everything, a failure only the attempt."""
    ok = F.col("fetch_status") == "success"
    rank = F.struct("started_at", *(["run_id"] if "run_id" in runs.columns else ["completed_at", "fetch_status"]))
    attempt = F.struct("started_at", "fetch_status", "error_message")
    success = F.struct("started_at", "asset_type", "record_count_fetched", "coverage_start_date", "coverage_end_date")
    state = runs.groupBy("ticker", "provider_name").agg(
        F.max_by(attempt, rank).alias("a"),
        F.max_by(success, F.when(ok, rank)).alias("s"),
        F.min("started_at").alias("created_at"),
    )
    return state.select(
        "ticker", "provider_name", F.col("s.asset_type").alias("asset_type"),
        F.col("a.started_at").alias("request_timestamp"),
        F.col("s.started_at").alias("last_successful_fetch_at"),
        F.col("a.fetch_status").alias("fetch_status"),
        F.when(F.col("a.fetch_status") != "success", F.col("a.error_message")).alias("error_message"),
        "s.record_count_fetched", "s.coverage_start_date", "s.coverage_end_date",
        F.col("s.started_at").alias("metadata_fetched_at"), F.col("s.started_at").alias("prices_fetched_at"),
        "created_at", F.col("a.started_at").alias("updated_at"),
    )


def merged_state(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two states of the same log's parts as one: the later attempt, the later success, the first sight of every key.

    Equal to ``ingestion_state`` of the whole log, without reading it again.
    """
    both = previous.withColumn("_part", F.lit(0)).unionByName(fresh.withColumn("_part", F.lit(1)))
    attempt = ["request_timestamp", "fetch_status", "error_message", "updated_at"]
    success = ["asset_type", "last_successful_fetch_at", "record_count_fetched", "coverage_start_date", "coverage_end_date",
               "metadata_fetched_at", "prices_fetched_at"]
    done = F.col("last_successful_fetch_at")
    merged = both.groupBy("ticker", "provider_name").agg(
        F.max_by(F.struct(*attempt), F.struct("request_timestamp", "_part")).alias("a"),
        F.max_by(F.struct(*success), F.when(done.isNotNull(), F.struct(done, F.col("_part")))).alias("s"),
        F.min("created_at").alias("created_at"))
    return merged.select("ticker", "provider_name", "created_at", "a.*", "s.*").select(*fresh.columns)


def batch_summary(runs: DataFrame) -> DataFrame:
    """Tickers processed, assets loaded and rows written, per provider."""
    ok = F.col("fetch_status") == "success"
    per_ticker = runs.groupBy("provider_name", "ticker").agg(
        F.max(ok).alias("loaded"), F.sum(F.when(ok, F.col("records_written"))).alias("rows"),
        F.count("*").alias("runs"))
    return per_ticker.groupBy("provider_name").agg(
        F.count("*").alias("tickers_processed"), F.count_if("loaded").alias("assets_loaded"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_loaded"), F.sum("runs").alias("runs"))
