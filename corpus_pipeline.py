"""From raw documents to packed sequences: toxicity, exact and near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import exact_dedup, minmax, mixing, packing, toxicity
from lorespark.llm.common import cut, table
from lorespark.llm.queries import tokenizer_path


#: Repeated doc_ids up to this number are broadcast (16 bytes each); beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
OWN, KEYS = "own_doc_id", 1 << 50


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row in place of doc_id, which moves to OWN.

    The key is the doc_id, but for rows without one and for all but one of the rows that share one: these get numbers that
    no doc_id has, above all of them if there is room, from rows written once, so that every use sees the same.
    """
    docs = docs.withColumn(OWN, F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("long"))
    met = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    nulls, most, low, top = met.agg(F.count_if(F.col("doc_id").isNull()), F.max(F.when(F.col("doc_id").isNotNull(), F.col("k"))), F.min("doc_id"), F.max("doc_id")).first()
    if not nulls and (most or 0) < 2:
        return docs
    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    low, top = (0, -1) if top is None else (low, top)
    if top + KEYS < 2**63:
        new = F.lit(top + 1) + F.col("row")
    elif low - KEYS >= -(2**63):
        new = F.lit(low - 1) - F.col("row")
    else:
        raise ValueError("doc_ids leave no free numbers at either end")
    ids = rows.where("doc_id is not null")
    first = cut(ids.groupBy("doc_id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id", "first"))
    first = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    named = ids.join(first, "doc_id", "left").withColumn("doc_id", F.when(F.coalesce(F.col("row") == F.col("first"), F.lit(True)), F.col("doc_id")).otherwise(new))
    return named.select(docs.columns).unionByName(rows.where("doc_id is null").withColumn("doc_id", new).select(docs.columns))


def _own(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.withColumn("doc_id", F.col(OWN)).select(columns)


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` (see :func:`_keyed`) that stay; keys are unique, so the one shuffle of the texts has no large group."""
    return docs.join(kept.where("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that of the smallest key, which is the smallest doc_id where doc_ids are unique."""
    rows = _keyed(docs)
    return _own(_keep(rows, exact_dedup.exact_dedup(rows)), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and 80 percent, as for all stages on word shingles."""
    rows = _keyed(docs)
    return _own(_keep(rows, minmax.near_dedup(rows, width=5)), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    return _own(mixing.repeated(rows, mixing.mix(rows)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Learned scores, sketches and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
