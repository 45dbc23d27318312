"""Approximate nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textmodel import Adam

K, SAMPLE, INNER_SAMPLE, ASKED, GRAPH, HIDDEN, EPOCHS, AIM, SEED = 10, 6000, 2000, 200, 10, 96, 40, 0.94, 17
#: Rows of a partition at most, about; a level of the router has at most WIDTH parts, so leaves grow beyond WIDTH ** 2 * LEAF
#: rows.  Vectors are placed SLICE at a time.
LEAF, WIDTH, SLICE = 1000, 64, 1000
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 4_000


def nearest(points: np.ndarray, queries: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Places of the k nearest points of each query, by blocks."""
    out, square = [], (points**2).sum(1)
    for i in range(0, len(queries), 512):
        d = square - 2 * queries[i : i + 512] @ points.T
        if skip_self:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1] - 1), 1)[:, :k])
    return np.concatenate(out)


def balanced_cut(graph: np.ndarray, points: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1, seed: int = SEED) -> np.ndarray:
    """Part of each node: halves by random projections first, then nodes move to where most neighbours are, while there is room."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(points), int)
    for level in range(int(np.log2(parts))):
        for p in range(2**level):
            own = np.flatnonzero(part == p)
            x = points[own] - points[own].mean(0) if len(own) else points[own]
            way = rng.normal(size=points.shape[1])
            for _ in range(5):  # towards the direction of greatest spread
                way = x.T @ (x @ way)
                way /= np.linalg.norm(way) + 1e-12
            order = own[np.argsort(x @ way, kind="stable")]
            part[order[len(order) // 2 :]] = p + 2**level
    size, most = np.bincount(part, minlength=parts), int(np.ceil(slack * len(points) / parts))
    into = [[] for _ in range(len(points))]
    for i, row in enumerate(graph):
        for j in row:
            into[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(points)):
            votes = np.bincount(part[np.r_[graph[i], into[i]].astype(int)], minlength=parts) * ((size < most) | (np.arange(parts) == part[i]))
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i], moved = best, moved + 1
        if not moved:
            break
    return part


def classifier(points: np.ndarray, part: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = np.maximum(points.std(0), 1e-9)
    p = {"w1": rng.normal(0, 1 / np.sqrt(points.shape[1]), (points.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), "b2": np.zeros(parts)}
    adam, x = Adam(0.005), (points - points.mean(0)) / scale
    for _ in range(epochs):
        for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[i] @ p["w1"] + p["b1"], 0)
            z = h @ p["w2"] + p["b2"]
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(i)), part[i]] -= 1
            g /= len(i)
            gh = g @ p["w2"].T * (h > 0)
            adam.step({"w1": x[i].T @ gh + 1e-5 * p["w1"], "b1": gh.sum(0), "w2": h.T @ g + 1e-5 * p["w2"], "b2": g.sum(0)}, p)
    return p | {"mean": points.mean(0), "scale": scale}


def log_odds(points: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Log probability of each partition for each point."""
    h = np.maximum((points - model["mean"]) / model["scale"] @ model["w1"] + model["b1"], 0)
    z = h @ model["w2"] + model["b2"]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def whole(width: int) -> dict[str, np.ndarray]:
    """The router that knows one partition only."""
    return {"w1": np.zeros((width, 1)), "b1": np.zeros(1), "w2": np.zeros((1, 1)), "b2": np.zeros(1), "mean": np.zeros(width), "scale": np.ones(width)}


def learned(points: np.ndarray, parts: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """A router into ``parts`` partitions (a power of two), fewer where ``points`` are too few to tell them apart."""
    parts = min(parts, 1 << max(0, int(np.log2(max(1, len(points) // 32)))))
    if parts < 2:
        return whole(points.shape[1])
    return classifier(points, balanced_cut(nearest(points, points, GRAPH, True), points, parts, seed=seed), parts, seed=seed)


class Router:
    """One router, or one more below each of its partitions; leaf = partition x ``fan`` + partition below."""

    def __init__(self, top: dict[str, np.ndarray], below: dict[int, dict[str, np.ndarray]] | None = None):
        self.top, self.below, self.parts = top, below or {}, len(top["b2"])
        self.fan = max([1, *(len(m["b2"]) for m in self.below.values())])

    def homes(self, points: np.ndarray) -> np.ndarray:
        part = log_odds(points, self.top).argmax(1) if len(points) else np.zeros(0, int)
        out = part * self.fan
        for p, model in self.below.items():
            own = np.flatnonzero(part == p)
            if len(own):
                out[own] += log_odds(points[own], model).argmax(1)
        return out

    def ways(self, points: np.ndarray, many: int) -> np.ndarray:
        """The ``many`` most probable leaves of each point."""
        top = log_odds(points, self.top)
        every = np.full((len(points), self.parts, self.fan), -np.inf)
        every[:, :, 0] = top
        for p, model in self.below.items():
            every[:, p, : len(model["b2"])] = top[:, p, None] + log_odds(points, model)
        return np.argsort(-every.reshape(len(points), -1), 1, kind="stable")[:, :many]

    def leaves(self) -> int:
        return sum(len(self.below[p]["b2"]) if p in self.below else 1 for p in range(self.parts))


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v as doubles) of vectors that take part: not null, without null or non-finite components, not zero; with an id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def block_nearest(q_id: np.ndarray, q: np.ndarray, r_id: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest of one block by the exact distance, ties to the smaller id; its own id is no candidate."""
    out_q, out_r, out_d = [], [], []
    square = (r**2).sum(1)
    for i in range(0, len(q), 64):
        rough = square + (q[i : i + 64] ** 2).sum(1)[:, None] - 2 * q[i : i + 64] @ r.T
        rough[q_id[i : i + 64, None] == r_id] = np.inf
        for j, d in enumerate(rough):
            last = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
            near = np.flatnonzero((d <= last + 1e-9 * (1 + abs(last) + square.max())) & np.isfinite(d)) if np.isfinite(last) else np.flatnonzero(np.isfinite(d))
            exact = np.sqrt(((r[near] - q[i + j]) ** 2).sum(1))
            order = np.lexsort((r_id[near], exact))[:k]
            out_q.append(np.full(len(order), q_id[i + j]))
            out_r.append(r_id[near][order])
            out_d.append(exact[order])
    flat = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)])
    return flat(out_q, np.int64), flat(out_r, np.int64), flat(out_d, float)


def _vectors(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded sample on the driver, by way of Arrow; sorted, so reruns agree."""
    got = rows.select("vec_id", "v").toArrow().combine_chunks().sort_by("vec_id")
    return got["vec_id"].to_numpy(), _matrix(got["v"]).astype(float) if len(got) else np.zeros((0, width))


def probes_for(router: Router, rows: DataFrame, asked_id: np.ndarray, asked: np.ndarray, k: int, aim: float) -> int:
    """How many leaves a query must look into to find ``aim`` of its neighbours, measured on the whole table.

    A bounded set of queries that taught the router nothing meets all rows in one pass: each task keeps its ``k`` nearest
    rows of each query, with the leaf that holds them.
    """
    leaves = router.leaves()
    if leaves < 2 or not len(asked):
        return leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_leaf = np.full((len(asked), k), np.inf), np.full((len(asked), k), -1)
        for b in batches:
            if len(b):
                v = _matrix(b["v"])
                d = (asked**2).sum(1)[:, None] + (v**2).sum(1) - 2 * asked @ v.T
                d[asked_id[:, None] == b["vec_id"].to_numpy()] = np.inf
                d, leaf = np.concatenate([best_d, d], 1), np.concatenate([best_leaf, np.broadcast_to(router.homes(v), d.shape)], 1)
                at = np.argpartition(d, k - 1, 1)[:, :k]
                best_d, best_leaf = np.take_along_axis(d, at, 1), np.take_along_axis(leaf, at, 1)
        q = np.repeat(np.arange(len(asked), dtype=np.int32), k)
        yield pa.RecordBatch.from_pydict({"q": q, "d": best_d.ravel(), "leaf": best_leaf.ravel().astype(np.int32)})

    near = rows.mapInArrow(run, "q int, d double, leaf int").where("leaf >= 0")
    turn = F.row_number().over(Window.partitionBy("q").orderBy("d", "leaf"))
    true = near.withColumn("turn", turn).where(F.col("turn") <= k).select("q", "leaf").collect()  # ASKED x k rows at most
    if not true:
        return leaves
    place = np.argsort(router.ways(asked, router.parts * router.fan), 1)
    at = np.sort([place[r["q"], r["leaf"]] for r in true])
    return int(at[max(0, math.ceil(aim * len(at)) - 1)]) + 1


def _packed(model: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **model)
    return out.getvalue()


def leaf_rows(n: int) -> int:
    """Rows of a leaf for a table of ``n``: about twice their root while one level is enough, so that a small table is routed
    too, and LEAF from there on."""
    return min(LEAF, max(math.ceil(2 * math.sqrt(n)), -(-n // WIDTH), 1))


def learn(rows: DataFrame, width: int, n: int, sample: int = SAMPLE, leaf: int = LEAF, k: int = K, aim: float = AIM) -> tuple[Router, int]:
    """Router and probes for ``n`` rows (vec_id, v) of ``width`` components, as many leaves as ``leaf`` rows each ask for.

    The upper level is learned from a bounded sample here.  Where it has too few parts, a level below is learned in one
    task for each of its parts, from about INNER_SAMPLE rows of that part; only the small models come here.
    """
    ids, drawn = _vectors(rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample), width)
    order = np.random.default_rng(SEED).permutation(len(drawn))
    n_held = min(ASKED, len(drawn) // 10)
    asked, known = order[:n_held], drawn[order[n_held:]]
    power = lambda x: 1 << max(0, min(WIDTH.bit_length() - 1, math.ceil(math.log2(max(1.0, x)))))
    top = learned(known, power(n / leaf))
    router, parts = Router(top), len(top["b2"])
    fan = power(n / parts / leaf)
    if parts > 1 and fan > 1:
        share = min(1.0, INNER_SAMPLE * parts / n)

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    yield pa.RecordBatch.from_pydict({"v": b["v"], "part": pa.array(router.homes(_matrix(b["v"])).astype(np.int32))})

        def train(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "model": [_packed(learned(_matrix(t["v"])[: 4 * INNER_SAMPLE], fan))]})

        few = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED + 1)), F.lit(1 << 30)) < int(share * (1 << 30)))
        made = few.select("v").mapInArrow(routed, "v array<double>, part int").groupBy("part").applyInArrow(train, "part int, model binary").collect()  # WIDTH rows at most
        router = Router(top, {r["part"]: dict(np.load(io.BytesIO(r["model"]))) for r in made})
    return router, probes_for(router, rows, ids[asked], drawn[asked], k, aim)


def search(table: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, leaf: int | None = None, probes: int | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score, probes, leaves: the ``k`` nearest found, by Euclidean distance, for each of ``queries`` (of the table's form).

    A router (see :func:`learn`) is learned from bounded samples of the vectors of the commonest dimension; every row of
    it is indexed under its most probable leaf.  Leaves (of :func:`leaf_rows`, unless given) grow in number with the rows up to
    WIDTH ** 2, about four million rows; beyond that they grow in size.  A query reads about ``probes`` x ``leaf`` rows.  A query looks into its ``probes`` most probable leaves (learned, unless
    given) and ranks all rows there exactly.  Distances need equal dimensions: vectors of any other dimension form one
    leaf for each dimension and are compared with all of their own kind.  Leaves are dealt into blocks of about
    ``block_rows`` rows and ``block_queries`` queries that meet pairwise, so a leaf of any size is no large task.
    Unusable vectors (see :func:`usable`) take no part; repeated rows are all candidates, and a query that occurs twice is answered once; an empty table gives no rows;
    extra columns are ignored.
    """
    rows, asked = usable(table), usable(queries).dropDuplicates(["vec_id", "v"])
    width = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    width, n = (width["d"], width["n"]) if width else (0, 0)
    main = lambda x: x.where(F.size("v") == width)
    other = lambda x: x.where(F.size("v") != width).select("vec_id", "v", (-F.size("v")).alias("part"))
    router, aimed = learn(main(rows), width, n, sample, leaf or leaf_rows(n), k) if width else (Router(whole(0)), 1)
    probes = min(probes or aimed, router.leaves())

    def routed(place):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole_batch.slice(i, SLICE) for whole_batch in batches for i in range(0, len(whole_batch), SLICE)):
                if len(b):
                    yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "v": b["v"], "parts": pa.array(list(place(_matrix(b["v"])).astype(np.int32)), pa.list_(pa.int32()))})

        return run

    fields = "vec_id bigint, v array<double>, parts array<int>"
    homes = main(rows).mapInArrow(routed(lambda x: router.homes(x)[:, None]), fields).select("vec_id", "v", F.col("parts")[0].alias("part"))
    ways = main(asked).mapInArrow(routed(lambda x: router.ways(x, probes)), fields).select("vec_id", "v", F.explode("parts").alias("part"))
    homes, ways = cut(homes.unionByName(other(rows))), cut(ways.unionByName(other(asked)))
    blocks = lambda x, most, name: x.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    size = blocks(homes, block_rows, "n_rows").join(blocks(ways, block_queries, "n_asked"), "part")  # a row for each leaf that is asked
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = ways.join(size, "part").withColumn("t", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("n_asked")).cast("int")).withColumn("s", every("n_rows"))
    right = homes.withColumn("row", F.monotonically_increasing_id()).join(size, "part")
    right = right.withColumn("s", F.pmod(F.xxhash64("row"), F.col("n_rows")).cast("int")).withColumn("t", every("n_asked"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            found = block_nearest(a["vec_id"].to_numpy(), _matrix(a["v"]), b["vec_id"].to_numpy(), _matrix(b["v"]), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    key, kept = ["part", "s", "t"], ["vec_id", "v", "part", "s", "t"]
    near = left.select(kept).groupBy(*key).cogroup(right.select(kept).groupBy(*key)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = near.withColumn("rank", turn.cast("int")).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", F.lit(probes).alias("probes"), F.lit(router.leaves()).alias("leaves"))
