"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut where its own content says so, so equal passages give equal chunks wherever they stand.  A text
is then represented by its recipe, the ordered list of its chunk identifiers, and texts are equal when their recipes are.
Whole texts are read in place; only the chunks of texts that have a possible partner are moved, once, to verify that an
identifier stands for one byte string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Chunks have at least MIN_CHUNK characters, but for a text's last, and at most MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 8192
#: A cut is made behind this context: about one in a hundred places of European prose, and CJK stops.
BOUNDARY = r"[aeimnoqsuy][cdlnrst] |[.!?]\n|[。，？]"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """Lazily from ``least`` characters up to the first boundary or the end; without either, ``most`` characters or the rest."""
    return rf"(?s).{{{least},{most}}}?(?:(?<={BOUNDARY})|\z)|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    """Null becomes empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    return F.regexp_extract_all(norm, F.lit(chunk_pattern(least, most)), F.lit(0))


def proven(chunk: Column, identifier=F.xxhash64) -> Column:
    """A chunk's identifier, and 120 bits of its SHA-256 as two numbers that prove it."""
    digest = F.sha2(chunk, 256)
    part = lambda at: F.conv(F.substr(digest, F.lit(at), F.lit(15)), 16, 10).cast("long")
    return F.struct(identifier(chunk).alias("id"), part(1).alias("p"), part(16).alias("q"))


def exact_dedup(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK, identifier=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts equal after white-space normalisation form a group; its smallest doc_id stays.  Null and empty texts are equal
    to each other (recipe of no chunks); white space alone is one space.  A row repeated under its own doc_id counts and
    stays as that document does.  Columns other than doc_id and text are ignored.  ``identifier`` hashes one chunk; where
    two different chunks share its value the verification finds it, and recipes holding it are compared by their proofs
    as well, so a weak hash gives right results too.
    """
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    recipes = cut(base.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm"), least, most), lambda c: proven(c, identifier)).alias("chunks"),
    ))
    # The chunk store: one row for each identifier.  Texts stay where they are; equal chunks of a task meet before the shuffle.
    pieces = recipes.select("doc_id", F.posexplode("chunks").alias("at", "chunk")).select("doc_id", "at", "chunk.*")
    store = pieces.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "pq" for f in (F.min, F.max)])
    forged = cut(store.where("min_p < max_p or min_q < max_q").select("id"))
    named = recipes.select("doc_id", "text_sha256", F.col("chunks.id").alias("recipe"))
    if forged.isEmpty():
        named = named.withColumn("proofs", F.lit(None).cast("array<struct<at:int,p:bigint,q:bigint>>"))
    else:
        proofs = pieces.join(forged, "id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "p", "q"))).alias("proofs"))
        named = named.join(proofs, "doc_id", "left")
    return _label(named)


def _label(named: DataFrame) -> DataFrame:
    """Compare ordered identifier lists: groups are counted before the shuffle, and only those of two or more are joined back."""
    named = named.withColumn("r", F.xxhash64("recipe"))
    groups = (
        named.groupBy("r", "recipe", "proofs").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id")).where("group_size > 1")
        .select(F.col("r").alias("r2"), F.col("recipe").alias("recipe2"), F.col("proofs").alias("proofs2"), "group_size", "keep_id")
    )
    same = (F.col("r") == F.col("r2")) & (F.col("recipe") == F.col("recipe2")) & F.col("proofs").eqNullSafe(F.col("proofs2"))
    return named.join(groups, same, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )
