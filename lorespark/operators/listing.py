"""What the catalogue tells of collections, documents and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States of a document on its way.
UNDERWAY = ("queued", "fetching", "parsing", "chunking", "embedding")


def collection_stats(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per collection, empty ones too; ``documents`` has collection, status, chunk_count, size_bytes."""
    is_, amount = lambda *s: F.count_if(F.col("status").isin(*s)), lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = documents.groupBy("collection").agg(
        F.count(F.lit(1)).alias("documents"), is_("indexed").alias("indexed"), is_("failed").alias("failed"), is_("skipped").alias("skipped"),
        is_(*UNDERWAY).alias("processing"), amount("chunk_count").alias("chunks"), amount("size_bytes").alias("size_bytes"),
    )
    s = collections.select("collection").join(counts, "collection", "left").na.fill(0)
    status = F.when(F.col("processing") > 0, "processing").when(F.col("documents") == 0, "empty").when(F.col("failed") > 0, "has_errors").otherwise("ready")
    return s.withColumn("status", status)


def newest(jobs: DataFrame, collection: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a collection's jobs (collection, created_at, id), newest first, with the number of all."""
    own = jobs.where(F.col("collection") == collection)
    page = own.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("total"))))  # one row


def active_syncs(jobs: DataFrame, source_id: str) -> DataFrame:
    """Synchronisations of a source that wait or run; the target is JSON."""
    return jobs.where(F.col("status").isin("queued", "running") & (F.col("kind") == "sync") & (F.get_json_object("target", "$.source_id") == source_id))


def with_chunk_count(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def first_errors(errors: DataFrame, order: str, most: int = 100, job: str = "job") -> DataFrame:
    """The first errors of each job; what a report keeps, the counts are the job's own."""
    return errors.withColumn("turn", F.row_number().over(Window.partitionBy(job).orderBy(order))).where(F.col("turn") <= most).drop("turn")
