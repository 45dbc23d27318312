"""Search over an index of chunks joined with their documents, filtered before the best are taken."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import condition
from .products import scored

#: Queries of one cell.
BLOCK = 4096


def index(chunks: DataFrame, documents: DataFrame, collections: DataFrame) -> DataFrame:
    """Chunks that a search may find, with their documents' columns.

    ``chunks`` has document_id, enabled, embedding, model; ``documents`` document_id, collection, enabled; ``collections``
    collection and the model that holds now.  Chunks of an older model wait until they are embedded anew.
    """
    on = chunks.where(F.col("enabled") & F.col("embedding").isNotNull()).drop("enabled")
    return on.join(documents.where("enabled").drop("enabled"), "document_id").join(collections.select("collection", "model"), ["collection", "model"])


def missing(requested: DataFrame, existing: DataFrame, key: str = "collection") -> DataFrame:
    """Requested collections that do not exist; a search over the others goes on."""
    return requested.select(key).distinct().join(existing.select(key), key, "left_anti")


def scores(chunks: DataFrame, queries: DataFrame, filters: dict[str, Any] | None = None, key: str = "chunk_id", k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Each chunk that passes ``filters`` with each query (query_id, model, q) of its model and size, and the raw product.

    The queries are a stated set; both sides are dealt into cells (see :func:`lorespark.operators.products.scored`).  A search
    that wants ``k`` for each query, or products of ``threshold`` at least, says so here: no other pairs become rows then, and
    :func:`best` ranks those that do.
    """
    return scored(chunks.where(condition(filters)), queries, key, ["model"], k, threshold, block=BLOCK)


def best(found: DataFrame, k: int, threshold: float | None = None, key: str = "chunk_id") -> DataFrame:
    """Add rank: each query's ``k`` best by raw score, ties to the smaller key; the threshold is inclusive and unrounded."""
    found = found if threshold is None else found.where(F.col("score") >= threshold)
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def shaped(found: DataFrame, documents: DataFrame, collections: DataFrame) -> DataFrame:
    """Results as a reader gets them: query_id, rank, chunk_id, score, vector_score, rerank_score, text, section, seq, document, collection.

    ``found`` has query_id, chunk_id, document_id, collection, text, section, seq, score and perhaps rerank_score, by which
    results are ranked where it is not null.  Scores are raw until here and rounded now.  ``documents`` (document_id, title,
    filename, ...) and ``collections`` (collection, name, ...) become structs; a document without a title has its file's name.
    """
    again = F.col("rerank_score") if "rerank_score" in found.columns else F.lit(None).cast("double")
    found = found.withColumn("rerank_score", again)
    order = [F.coalesce("rerank_score", "score").desc(), F.desc("score"), "chunk_id"]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    title = F.coalesce(_filled(F.col("title")), "filename").alias("title")
    about = documents.select("document_id", F.struct("document_id", title, *[c for c in documents.columns if c not in ("document_id", "title", "collection")]).alias("document"))
    named = collections.select(F.col("collection"), F.struct(*collections.columns).alias("of"))
    rounded = lambda x: F.round(x, 4) + F.lit(0.0)
    return found.join(about, "document_id").join(named, "collection").select(
        "query_id", "rank", "chunk_id", rounded(F.coalesce("rerank_score", "score")).alias("score"), rounded(F.col("score")).alias("vector_score"),
        rounded(F.col("rerank_score")).alias("rerank_score"), "text", "section", "seq", "document", F.col("of").alias("collection"),
    )


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def rerank_text(title: Column, section: Column, text: Column, most: int | None = None) -> Column:
    """Title and section above the text; ``most`` characters of it, if given, as a model is asked."""
    head = F.concat_ws(" › ", _filled(title), _filled(section))
    whole = F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)
    return whole if most is None else F.substring(whole, 1, most)


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.coalesce(F.concat(_filled(section), F.lit("\n")), F.lit("")), F.lit("\n"), text)


def embedded(wanted: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``wanted`` (key, text, ...) with v and whether the ``cache`` (key, v) had it; each missing key is embedded once.

    ``embed`` makes (key, v) of (key, text).
    """
    lacking = wanted.select("key", "text").join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    known = cache.select("key", "v", F.lit(True).alias("cached")).unionByName(embed(lacking).select("key", "v", F.lit(False).alias("cached")))
    return wanted.join(known, "key")
