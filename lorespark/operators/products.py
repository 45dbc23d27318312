"""Products of rows' vectors with many queries' vectors, a block of rows and a block of queries to a cell.

Both sides are dealt by a shuffle, so the driver holds neither, and a cell holds about CELL rows of each.  A cell multiplies
its matrices a few rows at a time to see which pairs can count, and adds up the products of those in the vectors' order, as
:func:`lorespark.functions.vectors.dot` does: the scores are the same to the last bit.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a cell, on either side, where the best are asked for, and rows and queries where all pairs may count; products that
#: a task holds at a time; pairs that are added up at a time.
CELL, ALL, PRODUCTS, PAIRS = (4096, 4096), (2048, 1024), 1 << 20, 1 << 18


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """``x`` rounded as Spark's round() does it, by the decimal digits that a double is written with."""
    scaled = x * 10.0**places
    with np.errstate(invalid="ignore"):
        out = np.where(np.isfinite(x), np.rint(scaled) / 10.0**places, x)
        unsure = np.flatnonzero(np.isfinite(x) & ((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) | (np.abs(scaled) > 1e9)))
    unit = Decimal(1).scaleb(-places)
    for i in unsure:
        d = Decimal(repr(float(x[i])))
        out[i] = float(d.quantize(unit, ROUND_HALF_UP)) if d.adjusted() < 20 else x[i]
    return out + 0.0


def _matrix(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one size as a matrix, and which of them have no null."""
    lists = lists.combine_chunks()
    flat = lists.flatten()
    shape = len(lists), len(flat) // max(1, len(lists))
    whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(shape).all(axis=1)
    return pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(shape), whole


def _exact(rows: np.ndarray, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of the pairs (i, j), added up from the first component to the last; both matrices stand transposed."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        for x, y in zip(rows, queries, strict=True):
            out[at : at + PAIRS] += x[a] * y[b]
    return out


def _order(score: np.ndarray, turn: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs by query, the greatest score first (NaN is the greatest, as in Spark), then by the keys' order."""
    hole = np.isnan(score)
    return np.lexsort((turn, np.where(hole, 0.0, -score), ~hole, j))


def pairs(rows: pa.Table, queries: pa.Table, key: str, k: int | None, least: float | None, places: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows and of queries, and scores, of the pairs of one cell that count (see :func:`scored`)."""
    (e, there), (q, asked) = _matrix(rows["embedding"]), _matrix(queries["q"])
    et, qt = np.ascontiguousarray(e.T), np.ascontiguousarray(q.T)
    turn = np.argsort(pc.array_sort_indices(rows[key].combine_chunks()).to_numpy(), kind="stable")
    bound = np.full(len(q), -np.inf if least is None else least)  # scores below it count for nothing
    slack = 0.0 if places is None else 0.5 * 10.0**-places
    kept = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    made, step = [], max(1, PRODUCTS // max(1, len(q)))
    with np.errstate(all="ignore"):
        far = np.sqrt((q * q).sum(axis=1)).max(initial=0.0)
        for at in range(0, len(e), step):
            part = e[at : at + step]
            near = part @ q.T
            err = 8 * (e.shape[1] + 1) * np.finfo(float).eps * far * np.sqrt((part * part).sum(axis=1)).max(initial=0.0)
            if k is not None and not at and len(part) > k and np.isfinite(near).all():
                bound = np.maximum(bound, np.partition(near, len(part) - k, axis=0)[len(part) - k] - err - slack) if there[:step].all() else bound
            i, j = np.nonzero(~(near < bound - err - slack) & there[at : at + step, None] & asked)
            i = i + at
            score = _exact(et, qt, i, j)
            score = score if places is None else half_up(score, places)
            fits = np.ones(len(i), bool) if least is None else ~(score < least)
            i, j, score = i[fits], j[fits], score[fits]
            if k is None:
                made.append((i, j, score))
                continue
            i, j, score = (np.concatenate(x) for x in zip(kept, (i, j, score), strict=True))
            by = _order(score, turn[i], j)
            i, j, score = i[by], j[by], score[by]
            first = np.searchsorted(j, j)  # where each query's pairs begin
            place = np.arange(len(j)) - first
            last = place == k - 1
            full = np.where(np.isnan(score[last]), np.inf, score[last])
            bound[j[last]] = np.maximum(bound[j[last]], full)
            kept = i[place < k], j[place < k], score[place < k]
    return kept if k is not None else tuple(np.concatenate(x) for x in zip(kept, *made, strict=True))


def scored(rows: DataFrame, queries: DataFrame, key: str, on: list[str] = (), k: int | None = None, least: float | None = None, places: int | None = None, block: int = CELL[1]) -> DataFrame:
    """The rows (key, embedding, ...) and queries (query_id, q, ...) that agree in ``on`` and in their vectors' size, with score.

    Only pairs whose score is ``least`` at least count, if that is given, and of those the ``k`` best of each query and cell, if
    that is: whoever ranks the result has each query's k best among them, ties to the smaller key.  ``places`` rounds scores
    before either; a cell has ``block`` queries at most or so.  Vectors without values, or with a null among them, have no score.  The other columns of both stay.
    """
    size, most = ALL if k is None else CELL
    parts, blocks = max(1, -(-rows.count() // size)), max(1, -(-queries.count() // min(block, most)))
    deal = lambda df, name, n: F.pmod(F.xxhash64(F.col(name), F.lit(17)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    agree = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on], F.lit(True))
    cell = ["part", "block", "size", *on]
    left = rows.where(F.col("embedding").isNotNull() & agree).withColumns({"part": deal(rows, key, parts), "size": F.size("embedding")}).withColumn("block", every(blocks))
    right = queries.where(F.col("q").isNotNull() & agree).withColumns({"block": deal(queries, "query_id", blocks), "size": F.size("q")}).withColumn("part", every(parts))
    mine = [c for c in rows.columns if c != "embedding"]
    theirs = [c for c in queries.columns if c != "q" and c not in on]
    schema = StructType([*[rows.schema[c] for c in mine], *[queries.schema[c] for c in theirs], StructField("score", DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, score = (np.zeros(0, int),) * 2 + (np.zeros(0),)
        if len(a) and len(b):
            i, j, score = pairs(a, b, key, k, least, places)
        columns = {c: a[c].take(pa.array(i)) for c in mine} | {c: b[c].take(pa.array(j)) for c in theirs}
        return pa.table(columns | {"score": pa.array(score)})

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, schema)
