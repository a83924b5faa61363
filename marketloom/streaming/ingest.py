"""Structured Streaming versions of ingest, deduplication, daily sentiment and ingestion state."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.operators.upsert import ingestion_state, latest_per_key, split_known
from marketloom.plans.ingest_run import Provider, ingest_market_batch
from marketloom.sources.lake import LakeTable


def _writer(checkpoint: str) -> str:
    return "stream-" + hashlib.sha1(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _into(table: LakeTable, checkpoint: str):
    """Write each micro-batch as one batch folder. Batch numbers start anew with every checkpoint, so the checkpoint names the
    writer: a replayed batch overwrites itself and nothing else."""
    own = table.written_by(_writer(checkpoint))

    def write(batch: DataFrame, batch_id: int) -> None:
        own.write_batch(batch, batch_id)
    return write


def _known_only(rows: DataFrame, assets: DataFrame | None) -> DataFrame:
    return rows if assets is None else split_known(rows, assets)[0]


def ingest_bars(bars: DataFrame, table: LakeTable, checkpoint: str, assets: DataFrame | None = None) -> StreamingQuery:
    """Stores every micro-batch; with ``assets``, bars of unknown assets are left out."""
    return (_known_only(bars, assets).writeStream.foreachBatch(_into(table, checkpoint)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_news(articles: DataFrame, table: LakeTable, checkpoint: str, assets: DataFrame | None = None) -> StreamingQuery:
    """Stores every micro-batch, the latest version of an article inside it; versions in different batches resolve on
    read. No state is kept and no article is too late, so a correction always replaces what it corrects."""
    write = _into(table, checkpoint)

    def newest(batch: DataFrame, batch_id: int) -> None:
        write(latest_per_key(batch, table.keys, [*table.order, "published_at", "headline"]), batch_id)
    return (_known_only(articles, assets).writeStream.foreachBatch(newest).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_raw_bars(raw: DataFrame, root: str, provider: Provider, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of raw vendor rows through the whole ingest job: stored or rejected, logged, state updated."""
    writer = _writer(checkpoint)

    def load(batch: DataFrame, batch_id: int) -> None:
        ingest_market_batch(batch.sparkSession, root, batch, provider, datetime.now(timezone.utc), batch_id=batch_id, writer=writer)
    return raw.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_sentiment_stream(articles: DataFrame, delay: str = "2 days") -> DataFrame:
    """Daily sentiment per asset on event time; a day is emitted once the watermark has passed it."""
    label = F.lower("sentiment_label")
    total = F.count("*")
    return (articles.where(F.col("published_at").isNotNull() & F.col("sentiment_score").isNotNull())
            .withWatermark("published_at", delay)
            .groupBy("asset_id", F.window("published_at", "1 day").alias("w"))
            .agg(total.alias("article_count_1d"),
                 F.sum(F.col("sentiment_score").cast("decimal(18,10)")).cast("double").alias("score_sum"),
                 F.count_if(label == "negative").alias("negatives"), F.count_if(label == "positive").alias("positives"))
            .select("asset_id", F.to_date("w.start").alias("feature_date"), "article_count_1d",
                    (F.col("score_sum") / F.col("article_count_1d")).alias("sentiment_mean_1d"),
                    (F.col("negatives") / F.col("article_count_1d")).alias("negative_article_share_1d"),
                    (F.col("positives") / F.col("article_count_1d")).alias("positive_article_share_1d")))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_state(runs: DataFrame) -> DataFrame:
    """Running ingestion state per (ticker, provider), for update or complete mode: all fields of the batch state."""
    return ingestion_state(runs)


def upsert_state(stream: DataFrame, table: LakeTable, checkpoint: str) -> StreamingQuery:
    """Writes changed state rows of every micro-batch; readers take the latest per key."""
    return (stream.writeStream.outputMode("update").foreachBatch(_into(table, checkpoint)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
