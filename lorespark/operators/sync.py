"""Keeping a collection in step with its source: differences, duplicates, caches, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync_diff(listing: DataFrame, stored: DataFrame, key: str = "source_key", version: str = "raw_hash") -> DataFrame:
    """(key, action): `new`, `changed`, `unchanged` or `deleted`, by one full outer join on the key; a null hash on either side is `changed`."""
    a = listing.select(key, F.col(version).alias("now"), F.lit(True).alias("listed"))
    b = stored.select(key, F.col(version).alias("then"), F.lit(True).alias("known"))
    action = F.when(F.col("known").isNull(), "new").when(F.col("listed").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def first_copies(docs: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Add ``duplicate_of``: the first row of equal content, null for that row itself.  Counts meet before rows are joined back."""
    first = docs.groupBy(content).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(content).alias("same"), "first")
    out = docs.join(first, docs[content] == first["same"], "left")
    own = F.struct(*order) == F.col("first")
    return out.withColumn("duplicate_of", F.when(~own, F.col(f"first.{order[-1]}"))).drop("same", "first")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache lacks."""
    return wanted.select(key).distinct().join(cache, key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` in place of those of ``table`` with their keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, as a cache that is written again keeps it.  Rows meet within a task before the shuffle."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*")


def unchanged(listing: DataFrame, stored: DataFrame, key: str = "source_key", force: bool = False) -> DataFrame:
    """(key, unchanged): indexed before without an error, from equal bytes, with the chunking and model that hold now.

    ``listing`` has raw_hash, chunking, model; ``stored`` raw_hash, applied_chunking, applied_model, indexed_at, error.  A
    document without chunks has no applied_model, which any model suits.
    """
    now = listing.select(key, F.col("raw_hash").alias("now"), "chunking", "model")
    both = now.join(stored.select(key, "raw_hash", "applied_chunking", "applied_model", "indexed_at", "error"), key, "left")
    same = F.col("indexed_at").isNotNull() & F.col("error").isNull() & (F.col("now") == F.col("raw_hash")) & F.col("chunking").eqNullSafe(F.col("applied_chunking"))
    same &= F.coalesce(F.col("applied_model") == F.col("model"), F.lit(True))
    return both.select(key, (F.coalesce(same, F.lit(False)) & F.lit(not force)).alias("unchanged"))


def replace_chunks(chunks: DataFrame, documents: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """``chunks`` after ``documents`` were indexed anew: chunks written by hand stay, their others give way to ``new``.

    ``new`` has the columns of ``chunks`` but id and origin; ids are document and place, so a second run writes the same.
    """
    again = documents.select(key).distinct().withColumn("again", F.lit(True))
    kept = chunks.join(again, key, "left").where(F.col("again").isNull() | (F.col("origin") == "manual")).select(chunks.columns)
    made = new.withColumn("id", F.concat_ws("-", F.col(key), F.col("seq"))).withColumn("origin", F.lit("auto"))
    return kept.unionByName(made.select(chunks.columns))


def manual_chunks(chunks: DataFrame, added: DataFrame, key: str = "document_id") -> DataFrame:
    """``added`` (document, place, text) with the numbers and ids that follow the document's highest."""
    last = chunks.groupBy(key).agg(F.max("seq").alias("last"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    out = added.join(last, key, "left").withColumn("seq", (F.coalesce("last", F.lit(-1)) + turn).cast("bigint"))
    return out.select(F.concat(F.col(key).cast("string"), F.lit("-m"), F.col("seq").cast("string")).alias("id"), key, "seq", F.lit("manual").alias("origin"), "text")


def cascade_delete(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key).distinct(), key, "left_anti")


def job_outcome(counts: DataFrame) -> DataFrame:
    """A job failed only if something failed and nothing was done or unchanged."""
    return counts.withColumn("outcome", F.when((F.col("failed") > 0) & (F.col("done") + F.col("unchanged") == 0), "failed").otherwise("completed"))
