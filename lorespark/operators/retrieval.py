"""Two-stage retrieval for many queries at once: filtered cosine candidates, near-duplicate collapse, then reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_hash, terms
from ..functions.vectors import bag_vector, bags, dot
from ..functions.written import cut
from . import search
from .filters import condition
from .products import scored

CANDIDATES, TOP, SAME, K1, B, VECTOR_WEIGHT = 20, 5, 0.97, 1.5, 0.75, 0.6
#: Candidates are compared by scores of this many places, so that the order of additions does not decide.
PLACES = 9
#: Queries that go to the tasks in one pass; each is as long as a vector.
QUERIES = 10_000
#: Rows whose vectors a task holds at a time.
SLICE = 1000
#: Chunk ids of candidates that are broadcast at most.
BROADCAST_IDS = 1_000_000
COUNTERS = ("candidates", "after_threshold", "after_dedup", "after_rerank", "returned")


def rounded(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def embedded(rows: DataFrame, text: str = "text", model: str = "bow") -> DataFrame:
    """Add ``embedding`` and ``model``: the offline bag-of-words vector of each row's text, without a shuffle."""
    return rows.withColumn("embedding", bag_vector(F.col(text))).withColumn("model", F.lit(model))


def asked(rows: DataFrame, key: str, text: str = "text", model: str = "bow") -> DataFrame:
    """Rows of texts as queries: query_id, text, model, q."""
    return rows.select(F.col(key).alias("query_id"), F.col(text).alias("text"), F.lit(model).alias("model"), bag_vector(F.col(text)).alias("q"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: exact cosine of unit vectors; ``queries`` (query_id, q) is a stated set met by all rows.

    Both sides are dealt into cells, and each cell keeps k rows a query before the last sort.
    """
    pairs = scored(vectors, queries, "vec_id", k=k, places=4)
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def collapse(candidates: DataFrame, same: float = SAME) -> DataFrame:
    """Greedy pass over one query's ranked candidates (rank, key, hash, v): skip equal hashes of picked rows and products above ``same``.

    The fold runs over the candidates of a query, whose number the candidate limit bounds.
    """
    item = F.struct("rank", "key", "hash", "v")
    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.slice("items", 1, 0)
    taken = F.aggregate(
        "items", empty,
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["hash"] == x["hash"]) | (dot(y["v"], x["v"]) > same)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return listed.select("query_id", F.explode(taken).alias("x")).select("query_id", "x.rank", "x.key")


def candidates(chunks: DataFrame, queries: DataFrame, k: int = CANDIDATES, filters: dict[str, Any] | None = None, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score, rank: each query's ``k`` best of the chunks that pass ``filters``; ties go to the smaller key.

    Queries, a stated set, go to the tasks in passes of QUERIES at most; a task multiplies its chunks' vectors with them and
    keeps ``k`` for each query, so what is shuffled does not grow with the chunks of a task.  Chunks meet queries of their
    own model and size only; rows without a vector meet none.  Without a column ``embedding`` the offline one is worked out
    from ``text`` where the products are, a few rows at a time.
    """
    passes = max(1, -(-queries.count() // QUERIES))
    vector = F.col("embedding").cast("array<double>").alias("embedding") if "embedding" in chunks.columns else F.col("text")
    rows = chunks.where(condition(filters)).select(key, "model", vector)
    rows = rows.where("embedding is not null") if "embedding" in chunks.columns else rows
    parts = []
    for i in range(passes):
        one = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).select("query_id", "model", F.col("q").cast("array<double>").alias("q")).toArrow()
        parts.append(_best_in_tasks(rows, one, k, key, queries.schema["query_id"].dataType.simpleString()))
    return search.best(reduce(DataFrame.unionByName, parts), k, key=key)


def _best_in_tasks(rows: DataFrame, queries: pa.Table, k: int, key: str, kind: str) -> DataFrame:
    by: dict[tuple, list[int]] = {}
    for i, (model, q) in enumerate(zip(queries["model"].to_pylist(), queries["q"].to_pylist(), strict=True)):
        by.setdefault((model, len(q)), []).append(i)
    sets = [(model, size, queries["query_id"].combine_chunks().take(pa.array(at)), np.array([queries["q"][i].as_py() for i in at])) for (model, size), at in by.items()]
    shared = rows.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            models = batch["model"].to_pylist()
            if "text" in batch.schema.names:
                flat = np.concatenate(bags(batch["text"].to_pylist()))
                at = np.arange(len(models) + 1) * (len(flat) // len(models))
            else:
                vectors = batch["embedding"]
                at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            for model, size, ids, q in shared.value:
                mine = np.flatnonzero((np.diff(at) == size) & np.fromiter((m == model for m in models), bool, len(models)))
                if not len(mine):
                    continue
                scores = np.round(flat[at[mine][:, None] + np.arange(size)] @ q.T, PLACES)
                scores[~np.isfinite(scores)] = -np.inf  # of vectors with holes; they are nobody's best
                keys = batch[key].take(pa.array(mine))
                turn = np.argsort(pc.array_sort_indices(keys).to_numpy(), kind="stable")  # the place of each key
                least = np.partition(scores, len(mine) - k, axis=0)[len(mine) - k] if len(mine) > k else np.full(len(q), -np.inf)
                who, which = [], []
                for j in range(len(q)):
                    near = np.flatnonzero((scores[:, j] >= least[j]) & (scores[:, j] > -np.inf))
                    near = near[np.lexsort((turn[near], -scores[near, j]))[:k]]
                    who.append(np.full(len(near), j))
                    which.append(near)
                who, which = np.concatenate(who), np.concatenate(which)
                yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(who)), key: keys.take(pa.array(which)), "score": scores[which, who]})

    return rows.mapInArrow(run, f"query_id {kind}, {key} {rows.schema[key].dataType.simpleString()}, score double")


def bm25(found: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, key, bm25 of each candidate (query_id, key, text); all statistics are those of its query's candidates.

    ``queries`` has query_id and text.  A term that no candidate has counts nothing; a query without terms gives 0 to all.
    """
    own = Window.partitionBy("query_id")
    rows = found.select("query_id", key, terms(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("mean", F.avg("length").over(own))
    wanted = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("asked"))
    rows = rows.join(wanted, "query_id").withColumn("term", F.explode_outer("asked"))
    rows = rows.withColumn("tf", F.size(F.filter("terms", lambda t: t == F.col("term")))).drop("terms", "asked")
    rows = rows.withColumn("df", F.count_if(F.col("tf") > 0).over(Window.partitionBy("query_id", "term")))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1)
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    part = F.when(F.col("tf") > 0, part / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean)))
    return rows.groupBy("query_id", key).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25"))


def heuristic(found: DataFrame, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Add rerank_score: the vector score and the share of the query's best BM25, weighed."""
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    lexical = F.when(best > 0, F.col("bm25") / best).otherwise(0.0)
    return found.withColumn("rerank_score", rounded(weight * F.greatest(F.lit(0.0), rounded(F.col("score"))) + (1 - weight) * lexical))


def distinct(chunks: DataFrame, best: DataFrame, same: float = SAME, key: str = "chunk_id") -> DataFrame:
    """The candidates ``best`` (query_id, key, score, rank) that :func:`collapse` leaves, with the columns of their chunks.

    Texts are read a second time here, of candidates only, whose number ``k`` bounds for each query.
    """
    ids = best.select(key).distinct()
    few = ids.count() <= BROADCAST_IDS
    found = chunks.join(F.broadcast(ids) if few else ids, key)
    rows = best.join(cut(found if "embedding" in chunks.columns else found.withColumn("embedding", bag_vector(F.col("text")))), key)
    left = collapse(rows.select("query_id", "rank", F.col(key).alias("key"), normalized_hash(F.col("text")).alias("hash"), F.col("embedding").alias("v")), same)
    return rows.drop("embedding").join(left.select("query_id", F.col("key").alias(key)), ["query_id", key])


def retrieve(
    chunks: DataFrame, queries: DataFrame, filters: dict[str, Any] | None = None, method: str = "none", candidate_k: int = 0, top_k: int = 0,
    threshold: float | None = None, same: float = SAME, rerank_threshold: float | None = None, key: str = "chunk_id",
) -> tuple[DataFrame, DataFrame]:
    """(results, counters) of all ``queries`` (query_id, text, model, q; see :func:`asked`).

    ``chunks`` has key, text, model, perhaps embedding (else it is the offline one) and what ``filters`` ask for; title and section, if there, are part of what
    is reranked.  Results are the chunks' columns with query_id, rank, score and rerank_score (null without a rerank), up to
    ``top_k`` for each query; 0 takes the usual limits, TOP results of CANDIDATES or ``top_k`` candidates.  Filters hold
    before candidates are taken.  Both thresholds are inclusive, and the one on rerank_score holds where there is a rerank.
    Of texts of equal normalised hash, or with a product above ``same``, the better candidate stays.  Counters have a row
    for each query, also for one that finds nothing: candidates, after_threshold, after_dedup, after_rerank, returned.
    """
    top_k = top_k or TOP
    candidate_k = candidate_k or max(CANDIDATES, top_k)
    if not 1 <= top_k <= 50 or not top_k <= candidate_k <= 200 or method not in ("none", "heuristic"):
        raise ValueError("top_k is 1 to 50, candidate_k is top_k to 200, method is none or heuristic")
    met = cut(candidates(chunks, queries, candidate_k, filters, key))
    passed = met if threshold is None else met.where(F.col("score") >= threshold)
    found = cut(distinct(chunks, passed, same, key))
    if method == "heuristic":
        part = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string")
        texts = found.select("query_id", key, search.rerank_text(part("title"), part("section"), F.col("text")).alias("text"))
        ranked = heuristic(found.join(bm25(texts, queries, key), ["query_id", key])).drop("bm25")
        ranked = ranked if rerank_threshold is None else ranked.where(F.col("rerank_score") >= rerank_threshold)
        order = [F.desc("rerank_score"), "rank"]
    else:
        ranked, order = found.withColumn("rerank_score", F.lit(None).cast("double")), ["rank"]
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    ranked = cut(ranked)
    results = ranked.where(F.col("rank") <= top_k)
    each = [(met, {"candidates": F.count(F.lit(1)), "after_threshold": F.count_if(F.lit(True) if threshold is None else F.col("score") >= threshold)}),
            (found, {"after_dedup": F.count(F.lit(1))}), (ranked, {"after_rerank": F.count(F.lit(1)), "returned": F.count_if(F.col("rank") <= top_k)})]
    counters = queries.select("query_id")
    for df, what in each:
        counters = counters.join(df.groupBy("query_id").agg(*[c.alias(n) for n, c in what.items()]), "query_id", "left")
    return results, counters.na.fill(0, list(COUNTERS))
