"""Queries over tables that change by versions: snapshots, synchronised state, cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.written import shared_folder
from ..operators import listing
from ..sources.raw import RawStore
from ..sources.snapshots import Catalogue, Change
from ..streaming import ingest
from .catalog import query, table

CHUNKS = "id string, document_id bigint, seq bigint, origin string, text string"
TABLES = {"documents": ("document_id", "document_id bigint, chunk_count bigint, status string"), "chunks": ("document_id", CHUNKS)}


def chunk_catalogue(spark, sf_dir) -> tuple[Catalogue, list[int]]:
    """Conversations as documents with their turns as chunks, in three runs: all of them; odd ones indexed anew into one chunk,
    beside what users wrote; those by five deleted.  The second run comes twice, as after a failure."""
    rows = table(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "document_id", "turn": "seq"})
    origin = F.when(F.col("role") == "user", "manual").otherwise("auto")
    chunks = rows.select(F.concat_ws("-", "document_id", "seq").alias("id"), "document_id", "seq", origin.alias("origin"), "text")
    ids = rows.select("document_id").distinct().withColumn("status", F.lit("indexed"))
    counted = lambda made: listing.with_chunk_count(ids, made)
    state = Catalogue(spark, shared_folder(spark, "chunks"), TABLES, buckets=8)
    odd = ids.where("document_id % 2 = 1")
    new = odd.select(F.concat("document_id", F.lit("-new")).alias("id"), "document_id", F.lit(0).cast("bigint").alias("seq"), F.lit("auto").alias("origin"), F.lit("new").alias("text"))
    manual = F.col("origin") == "manual"
    left = chunks.where(manual).join(odd, "document_id", "left_semi").unionByName(new)
    gone = ids.where("document_id % 5 = 0").select("document_id")
    again = {"chunks": Change(rows=new, keys=odd.select("document_id"), keep=manual), "documents": Change(rows=counted(left).join(odd.select("document_id"), "document_id", "left_semi"))}
    versions = [state.apply("first", {"chunks": Change(rows=chunks), "documents": Change(rows=counted(chunks))})]
    versions += [state.apply("again", again), state.apply("again", again), state.apply("gone", {"chunks": Change(keys=gone), "documents": Change(keys=gone)})]
    return state, versions


AGAIN = """with c as (select conv_id::varchar || '-' || turn as id, conv_id as document_id, turn as seq, case when role = 'user' then 'manual' else 'auto' end as origin, text from conversations),
v1 as (select * from c), v2 as (select * from c where document_id % 2 = 0 or origin = 'manual' union all select distinct document_id || '-new', document_id, 0::bigint, 'auto', 'new' from c where document_id % 2 = 1),
v3 as (select * from v2 where document_id % 5 <> 0)"""


@query(f"{AGAIN} select id, document_id, seq, origin, text from v3")
def snapshot_chunks(spark, sf_dir):
    state, _ = chunk_catalogue(spark, sf_dir)
    return state.read("chunks")


@query(f"""{AGAIN} select 1 as version, document_id, count(*) as chunks from v1 group by all union all select 2, document_id, count(*) from v2 group by all
union all select 3, document_id, count(*) from v3 group by all""")
def snapshot_versions(spark, sf_dir):
    """Readers of older versions still see them; the document rows of a version agree with its chunks."""
    state, versions = chunk_catalogue(spark, sf_dir)
    each = [state.read("documents", v).select(F.lit(i).alias("version"), "document_id", F.col("chunk_count").alias("chunks")) for i, v in enumerate(dict.fromkeys(versions), 1)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""select 'doc' || doc_id as source_key, sha256(case when doc_id % 7 = 0 then text || ' ' else text end) as raw_hash, n_chars as size_bytes from documents where doc_id % 11 <> 0""")
def synced_state(spark, sf_dir):
    """A first listing, a batch of changed files that comes twice, a batch of files older than those, and a listing that lacks some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("source_key"), "text", F.col("n_chars").alias("size_bytes"))
    at = lambda day, text: [T.content_hash(text).alias("raw_hash"), F.lit(f"2024-01-0{day}").cast("timestamp").alias("modified"), "size_bytes", F.lit("indexed").alias("status")]
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    state = Catalogue(spark, shared_folder(spark, "state"), {"documents": ("source_key", ingest.STATE)}, buckets=8)
    ingest.reconcile(state, "listing-1", docs.where("doc_id % 10 <> 0").select("source_key", *at(1, F.col("text"))))
    batch = docs.where("doc_id % 10 = 0 or doc_id % 7 = 0").select("source_key", *at(3, changed))
    for _ in range(2):
        ingest.apply_batch(state, "batch-0", batch)
    ingest.apply_batch(state, "batch-1", docs.where("doc_id % 14 = 0").select("source_key", *at(2, F.lit("late"))))
    ingest.reconcile(state, "listing-2", docs.where("doc_id % 11 <> 0").select("source_key", *at(4, changed)))
    return state.read("documents").select("source_key", "raw_hash", "size_bytes")


@query("""with f as (select 'd' || doc_id as document_id, case when doc_id % 5 = 0 then doc_id || '.md' else doc_id || '.txt' end as filename, case when doc_id % 5 = 0 then text || chr(33) else text end as content from documents where doc_id % 7 <> 0)
select document_id, filename, sha256(content) as raw_hash, octet_length(encode(content)) as size_bytes, count(*) over (partition by sha256(content)) as n from f""")
def raw_store(spark, sf_dir):
    """All documents as files; every fifth is replaced, every seventh deleted, and what nobody refers to is collected."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), "doc_id", "text")
    name = lambda ending: F.concat("doc_id", F.lit(ending)).alias("filename")
    store = RawStore(spark, shared_folder(spark, "raw"), buckets=8)
    store.put("first", docs.select("document_id", name(".txt"), F.col("text").cast("binary").alias("content")))
    new = docs.where("doc_id % 5 = 0 or doc_id % 9 = 0").select("document_id", F.concat(F.lit("up\\"), "doc_id", F.when(F.col("doc_id") % 5 == 0, ".md").otherwise(".exe")).alias("filename"), F.concat("text", F.lit("!")).cast("binary").alias("content"))
    store.replace("second", new, docs.select("document_id", F.lit("file").alias("source_type")), [".md"])
    store.delete("third", docs.where("doc_id % 7 = 0"))
    store.collect("fourth")
    return store.read().join(store.references(), "raw_hash").select("document_id", "filename", F.sha2("content", 256).alias("raw_hash"), "size_bytes", "n")
