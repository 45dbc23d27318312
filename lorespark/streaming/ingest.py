"""Files of a source kept in step with a table: a stream of new files, and listings that tell what is gone.

The table's rows are the state by source key.  Each batch is published under its own run id, so a batch that is replayed
after a failure changes nothing, and a file that comes late does not undo what a newer one said.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.written import cut
from ..operators import sync
from ..sources.snapshots import Catalogue, Change

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: What the state holds of a file; other tables (chunks) follow it in the same version.
STATE = "source_key string, raw_hash string, modified timestamp, size_bytes bigint, status string"


def ingest(spark: SparkSession, root: str, checkpoint: str, process: Callable[[DataFrame, int], None], once: bool = True, per_batch: int | None = None) -> StreamingQuery:
    """Hand each batch of files under new paths to ``process``; the checkpoint remembers what was read.  A file that changes under
    its old path, or goes, does not come again: a listing (:func:`reconcile`) tells of it."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true")
    files = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(root)
    writer = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def file_rows(files: DataFrame, key: Column | None = None) -> DataFrame:
    """A row of state for each file; the key is its path unless ``key`` says otherwise.  Of several of one key the newest counts."""
    rows = files.select((F.col("path") if key is None else key).alias("source_key"), F.sha2("content", 256).alias("raw_hash"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    return sync.newest(rows, ["source_key"], ["modified", "raw_hash"]).select("source_key", "raw_hash", "modified", "size_bytes", F.lit("indexed").alias("status"))


def apply_batch(state: Catalogue, run_id: str, rows: DataFrame, follow: Callable[[DataFrame], dict[str, Change]] | None = None, table: str = "documents") -> int:
    """Publish a batch of :func:`file_rows`: new and changed files replace their rows, unchanged and late ones leave them.

    ``follow`` makes the changes of other tables (chunks, say) from the rows that are new or changed; all become one
    version.  A run id that was published before changes nothing.
    """
    if done := state.published(run_id):
        return done
    rows = cut(rows)
    stored = state.read(table).select("source_key", F.col("raw_hash").alias("old_hash"), F.col("modified").alias("old_modified"))
    late = F.col("modified") < F.col("old_modified")
    fresh = rows.join(stored, "source_key", "left").where(F.col("old_modified").isNull() | (~late & ~F.col("raw_hash").eqNullSafe(F.col("old_hash")))).select(rows.columns)
    fresh = cut(fresh)
    return state.apply(run_id, {table: Change(rows=fresh)} | (follow(fresh) if follow else {}))


def reconcile(state: Catalogue, run_id: str, listing: DataFrame, follow: Callable[[DataFrame, DataFrame], dict[str, Change]] | None = None, table: str = "documents") -> int:
    """Bring the state to a full listing of the source (rows of :func:`file_rows`): new, changed and deleted keys in one version.

    Deletions are seen here only, as a stream of files never tells of one that is gone.  ``follow`` makes the changes of
    other tables from the rows that came and the keys that went.
    """
    if done := state.published(run_id):
        return done
    listing = cut(listing)
    action = cut(sync.sync_diff(listing, state.read(table)).where("action <> 'unchanged'"))
    fresh = listing.join(action.where("action in ('new', 'changed')").select("source_key"), "source_key", "left_semi")
    gone = action.where("action = 'deleted'").select("source_key")
    keys = action.select("source_key")
    return state.apply(run_id, {table: Change(rows=fresh, keys=keys)} | (follow(fresh, gone) if follow else {}))
