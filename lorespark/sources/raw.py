"""Raw copies of documents' files: bytes stored once under their hash, with the documents that refer to them.

Both tables belong to one catalogue, so a document's new copy and the loss of its old one are one version.  Bytes go when
no document refers to them any more; how many do is counted, never kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..functions.written import cut
from .snapshots import Catalogue, Change

TABLES = {"files": ("document_id", "document_id string, filename string, raw_hash string, size_bytes bigint"), "blobs": ("raw_hash", "raw_hash string, content binary")}


def safe_name(name: Column) -> Column:
    """The last part of a path without control characters; ``file`` where nothing is left."""
    bare = F.trim(F.substring_index(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/", -1))
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"[\x00-\x1f]", "_"), F.lit("")), F.lit("file"))


class RawStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, max_bytes: int = 50 << 20):
        self.state, self.max_bytes = Catalogue(spark, root, TABLES, buckets), max_bytes

    def put(self, run_id: str, files: DataFrame) -> int:
        """Store ``files`` (document_id, filename, content), each in place of what its document had; the version that holds them.

        Of several rows of a document the one of the greatest name and hash counts; files above ``max_bytes`` and null ones are
        left out, and what their documents had stays.  Bytes that are there are not written again.
        """
        if done := self.state.published(run_id):
            return done
        files = files.where(F.col("content").isNotNull() & (F.length("content") <= self.max_bytes) & F.col("document_id").isNotNull())
        rows = files.select(F.col("document_id").cast("string").alias("document_id"), safe_name(F.col("filename")).alias("filename"), F.sha2("content", 256).alias("raw_hash"), F.length("content").cast("bigint").alias("size_bytes"))
        rows = rows.groupBy("document_id").agg(F.max(F.struct("filename", "raw_hash", "size_bytes")).alias("x")).select("document_id", "x.*")
        rows = cut(rows)
        lacking = cut(rows.select("raw_hash").distinct().join(self.state.read("blobs").select("raw_hash"), "raw_hash", "left_anti"))
        bytes_ = files.select(F.sha2("content", 256).alias("raw_hash"), "content").join(lacking, "raw_hash", "left_semi").groupBy("raw_hash").agg(F.first("content").alias("content"))
        return self.state.apply(run_id, {"files": Change(rows=rows), "blobs": Change(rows=bytes_, keys=lacking)})  # the bytes go straight into their buckets

    def replace(self, run_id: str, files: DataFrame, documents: DataFrame, kinds: list[str]) -> tuple[int, DataFrame]:
        """Replace the files of documents that were uploaded: (version, refused).

        ``documents`` has document_id and source_type; only those of type ``file`` take a new file, whose ending must be one of
        ``kinds``.  ``refused`` has document_id and the reason.
        """
        asked = files.withColumn("document_id", F.col("document_id").cast("string")).join(documents.select(F.col("document_id").cast("string").alias("document_id"), "source_type"), "document_id", "left")
        why = F.when(F.col("source_type").isNull(), "no such document").when(F.col("source_type") != "file", "a source's document changes with its source")
        why = why.when(F.col("content").isNull() | (F.length("content") > self.max_bytes), "the file is too large or empty").when(~extension(safe_name(F.col("filename"))).isin(kinds), "the format is not supported")
        asked = asked.withColumn("reason", why)
        return self.put(run_id, asked.where("reason is null")), asked.where("reason is not null").select("document_id", "reason")

    def delete(self, run_id: str, documents: DataFrame) -> int:
        return self.state.apply(run_id, {"files": Change(keys=documents.select(F.col("document_id").cast("string").alias("document_id")))})

    def references(self, version: int | None = None) -> DataFrame:
        """raw_hash, n: how many documents refer to each stored copy; 0 for what :meth:`collect` would remove."""
        n = self.state.read("files", version).groupBy("raw_hash").agg(F.count(F.lit(1)).alias("n"))
        return self.state.read("blobs", version).select("raw_hash").join(n, "raw_hash", "left").na.fill(0, ["n"])

    def collect(self, run_id: str) -> int:
        """Remove the bytes that no document refers to."""
        if done := self.state.published(run_id):
            return done
        return self.state.apply(run_id, {"blobs": Change(keys=cut(self.references().where("n = 0").select("raw_hash")))})

    def read(self, version: int | None = None) -> DataFrame:
        """document_id, filename, raw_hash, size_bytes, content; the bytes are looked up by their hash."""
        return self.state.read("files", version).join(self.state.read("blobs", version), "raw_hash").select("document_id", "filename", "raw_hash", "size_bytes", "content")
