"""The operators of this subpackage applied to their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, exact_dedup, fim, langid, licences, minmax, mixing, packing, quality, repeats, shards, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source and 400 ids; one in twenty is that folder's licence file.

    One row per document; documents that repeat an id, or have none, are one file and have its result.
    """
    doc_id = F.col("doc_id")
    name = F.concat(F.when((doc_id / 20).cast("bigint") % 20 == 0, "LICENSE.").otherwise("file."), doc_id.cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce((doc_id / 400).cast("bigint").cast("string"), F.lit("none")), F.coalesce(name, F.lit("file")))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return docs.select("doc_id", "path").join(licences.licences(docs), "path")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By itself the operator has room for more words than as a stage of the pipeline."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), most=3 * packing.KNOWN)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=["n_chars"])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_dedup(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.strip_repeats(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = op1_language_id, op2_licence_scan, op3_toxicity, op4_exact_dedup, op5_packing, op6_mixing, op7_quality, op8_near_dedup, op9_sharding, op10_nearest, op11_fill_in_middle, op12_token_alignment, op13_suffix_dedup
    return {f.__name__: f for f in (*ops, pipeline)}


EXACT_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""

NEAR_SQL = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from w union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) as component_id from r group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, w.doc_id = m.component_id as kept
from w left join n using (doc_id) join m on m.a = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": EXACT_SQL, "op6_mixing": mixing.ORACLE, "op8_near_dedup": NEAR_SQL, "op11_fill_in_middle": fim.ORACLE}
