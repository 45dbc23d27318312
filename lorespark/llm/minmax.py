"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

SHINGLE, PERCENT, PERMUTATIONS, ROWS, SEED, KNOWN = 4, 80, 64, 4, 5, 300_000
BLOCK, BLOCK_SHINGLES, BROADCAST_IDS, HOT, EDGES = 2000, 2_000_000, 1_000_000, 1000, 50_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: WordHash, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words, A-Z in lower case; a shorter text is one run, no words are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space only
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for place in range(min(width, len(h))):
        out = _mix(out * _GOLD + h[place : place + n])
    return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least and the greatest value under each permutation: two components for one evaluation."""
    low, high = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    for i in range(0, len(shingles), 4096):
        x = shingles[i : i + 4096, None] * a + b
        low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    return np.stack([low, high], 1)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` components; the band's number is part of it."""
    parts = sig.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for i in range(rows):
        key = _mix(key * _GOLD + parts[:, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int, permutations: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the whole set), keys of the bands."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, permutations, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in slices(batches):
            n, ids, keys = [], [], []
            for t in batch["text"].to_pylist():
                s = shingle_set(t, known, width)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bands(signature(s, a, b), rows) if len(s) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_shingles": pa.array(n, pa.int64()), "set_id": pa.array(ids, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_id binary, keys array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in slices(batches):
            sets = [shingle_set(t, known, width) for t in batch["text"].to_pylist()]
            ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "set_id": pa.array(ids, pa.binary()), "members": pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "doc_id bigint, set_id binary, members array<bigint>")


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key) of more than a thousandth of ``total`` rows each, so a thousand at most, whatever the table."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(HOT, total / 1000)).select(key)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node reachable.

    Large stars and small stars by turns, written each round.  A round deals the edges out by one end, then by the other,
    and all that a node needs is done where its edges lie; nodes with very many edges get their least neighbour by broadcast.
    As many tasks write as the edges ask for, so few edges leave few files.
    """
    sized = lambda x, n: x.coalesce(max(8, n // EDGES))
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    last = print_of(e)
    while last[0]:
        e = sized(e, last[0])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        hot = F.broadcast(least.where(F.col("k") > max(HOT, 2 * last[0] / 1000)).select("u", F.col("m").alias("hot_m")))  # a thousand nodes at most
        up = both.where("v > u").join(hot, "u", "left")
        far = up.where("hot_m is not null").select(F.col("v").alias("u"), F.col("hot_m").alias("v"))
        near = up.where("hot_m is null").select("u", "v").join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = sized(far, last[0]).unionByName(sized(near, last[0])).repartition("u").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        node = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))  # itself, or one that stood between
        e = cut(sized(large.join(root, "u").select(node.alias("u"), F.col("m").alias("v")), last[0]))
        if (now := print_of(e)) == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def links_between(a: tuple, b: tuple, same: bool, percent: int) -> list[tuple[int, int]]:
    """One confirmed link for each pair of roots that the documents of two blocks join.

    A block is (doc_id, root, sets).  Documents of the commonest root need no comparison among themselves; each of the
    others counts its common shingles with all documents of the other block by an inverted list of that block.
    """
    roots, n = np.unique(np.concatenate([a[1], b[1]]), return_counts=True)
    main = roots[n.argmax()]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for (ids_x, root_x, sets_x), (ids_y, root_y, sets_y) in [(a, b)] if same else [(a, b), (b, a)]:
        size = np.fromiter(map(len, sets_y), np.int64, len(sets_y))
        flat, owner = np.concatenate(sets_y), np.repeat(np.arange(len(sets_y)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i in np.flatnonzero(root_x != main):
            lo, hi = np.searchsorted(flat, sets_x[i]), np.searchsorted(flat, sets_x[i], "right")
            n_hit = hi - lo
            at = np.repeat(lo - np.cumsum(n_hit) + n_hit, n_hit) + np.arange(n_hit.sum())
            common = np.bincount(owner[at], minlength=len(sets_y))
            for j in np.flatnonzero((100 * common >= percent * (len(sets_x[i]) + size - common)) & (root_y != root_x[i])):
                pair = tuple(sorted((int(root_x[i]), int(root_y[j]))))
                found.setdefault(pair, (int(ids_x[i]), int(ids_y[j])))
    return list(found.values())


def _between(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents of one group and of different roots; groups are dealt into blocks that meet pairwise.

    ``rows`` has (rep, root, n, group).  A task holds two blocks, so a group of any size is no large task, and all that
    is written is one link for each pair of roots found joined in a task.
    """
    size = rows.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("words"), F.countDistinct("root").alias("k")).where("k > 1")
    many = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int")
    dealt = rows.join(size.select("group", many.alias("many")), "group").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("many")).cast("int"))
    dealt = dealt.join(sets.withColumnRenamed("doc_id", "rep"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("rep", "root", "group", "own", "members", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"))

    def run(t: pa.Table) -> pa.Table:
        own, s, u = t["own"].to_numpy(), t["s"][0].as_py(), t["t"][0].as_py()
        ids, root = t["rep"].to_numpy(), t["root"].to_numpy()
        sets_of = t["members"].combine_chunks()
        flat, at = sets_of.values.to_numpy(zero_copy_only=False), sets_of.offsets.to_numpy()
        every = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        block = lambda k: ((w := np.flatnonzero(own == k)), (ids[w], root[w], [every[i] for i in w]))[1]
        a, b = block(s), block(u)
        found = links_between(a, b, s == u, percent) if len(a[0]) and len(b[0]) else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("group", "s", "t").applyInArrow(run, "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets.

    ``pairs`` is (leader a, follower b, n of b).  Followers are dealt into tasks of about BLOCK_SHINGLES shingles, and a
    leader's set goes once to each task that holds some of its followers, not once to each follower.
    """
    count, shingles = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-int(shingles) // BLOCK_SHINGLES), -(-count // (10 * BLOCK)))
    hot = hot_keys(pairs, "a", count).withColumn("hot", F.lit(True))
    apart = F.when(F.col("hot"), F.xxhash64("a", "b")).otherwise(F.xxhash64("a"))
    dealt = cut(pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.pmod(apart, F.lit(tasks)).cast("int").alias("task")))
    leaders = dealt.select("a", "task").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("task", "a", F.lit(None).cast("bigint").alias("b"), "members")
    followers = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("task", "a", "b", "members")

    def run(t: pa.Table) -> pa.Table:
        a, leads, members = t["a"].to_numpy(), t["b"].is_null().to_numpy(), t["members"].combine_chunks()
        b = t["b"].fill_null(0).to_numpy()
        flat, at = members.values.to_numpy(zero_copy_only=False), members.offsets.to_numpy()
        of = {int(a[i]): flat[at[i] : at[i + 1]] for i in np.flatnonzero(leads)}
        found = []
        for i in np.flatnonzero(~leads):
            x, y = of[int(a[i])], flat[at[i] : at[i + 1]]
            place = np.searchsorted(x, y)
            common = int((x.take(place, mode="clip") == y).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                found.append(i)
        return pa.table({"a": a[found], "b": b[found]})

    return leaders.unionByName(followers).groupBy("task").applyInArrow(run, "a bigint, b bigint")


def near_dedup(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents of equal sets are one class and go on as its smallest doc_id.  Classes that share the key of a band are
    candidates; with 64 permutations in 32 bands of 4, a pair at 80 percent is missed once in ten million.  In a bucket
    every class is first compared with the smallest only.  Where a bucket still holds several components after that, the
    buckets that overlap form a group, and its classes of different components are all compared inside tasks, by inverted
    lists; so no link that could join two components is lost, no pairs are written out, and pairs inside one component
    need no comparison.  All links are confirmed on the full sets.

    Null and empty texts and texts of white space have no shingles and are linked with nothing.  A row without doc_id is
    linked with nothing, has no component_id and stays.  Rows that repeat a doc_id share its component.  Extra columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(sketches(docs, width, permutations, rows, seed))
    classes = cut(
        sketch.where("doc_id is not null and n_shingles > 0").groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    )
    spread = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    member = cut(spread.join(shared, "key").select("key", "rep", "n", "leader"))
    in_bucket = member.groupBy("rep").agg(F.min("n").alias("n"))
    named = classes.join(in_bucket.select("rep"), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "set_id")
    few = named.count() <= BROADCAST_IDS  # a row is 8 bytes here; beyond that bound the texts are shuffled instead
    ids = named.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = cut(full_sets(texts, width).join(named, ["doc_id", "set_id"], "left_semi").dropDuplicates(["doc_id", "set_id"]).select("doc_id", "members"))

    fits = lambda m, n: 100 * F.least(m, n) >= percent * F.greatest(m, n)  # noqa: E731  no pair of other sizes can be that similar
    sized = in_bucket.select(F.col("rep").alias("leader"), F.col("n").alias("leader_n"))
    first = member.where("rep <> leader").select("rep", "n", "leader").distinct().join(sized, "leader").where(fits(F.col("n"), F.col("leader_n")))
    tried = cut(first.select(F.col("leader").alias("a"), F.col("rep").alias("b"), "n").distinct())
    links = cut(_confirmed(tried, sets, percent))
    roots = components(links)
    placed = member.select("key", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    # What may still be linked is drawn into groups, by buckets that hold several components.
    near = placed.join(open_keys, "key", "left_semi").select("rep", "root", "n", "key")
    hub = near.groupBy("key").agg(F.min("rep").alias("hub"))
    tied = components(near.join(hub, "key").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    tied = tied.select(F.col("node").alias("rep"), F.col("root").alias("hub"))
    rows = near.select("rep", "root", "n").distinct().join(tied, "rep", "left").select("rep", "root", "n", F.coalesce("hub", "rep").alias("group"))
    more = cut(_between(cut(rows), sets, percent))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = classes.select(F.col("set_id").alias("set"), "rep", "copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.where("copies > 1 or root is not null").select("set", F.coalesce("root", "rep").alias("root"))
    out = sketch.select("doc_id", "n_shingles", "set_id").join(named, F.col("set_id") == F.col("set"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
