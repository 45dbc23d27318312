"""What the two trained text classifiers share: hashed words and a sparse matrix product in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

WORDS = re.compile(r"\w+")


class Hashed(dict):
    """word -> bucket, remembered up to a bound."""

    def __init__(self, buckets: int, most: int = 300_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        at = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        return at


def _sums(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` for each key of 0..n-1; ``key`` is sorted."""
    out = np.zeros((n, *values.shape[1:]))
    if len(key):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[key[first]] = np.add.reduceat(values, first, 0)
    return out


class Sparse:
    """Rows of (column, value); products by sums over entries sorted by row, or by column."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray], width: int):
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        self._set(row, np.concatenate([*rows, np.zeros(0, np.int32)]), np.concatenate([*values, np.zeros(0, np.float32)]).astype(np.float32), (len(rows), width))

    def _set(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.col, self.val, self.shape = row, col, val, shape
        order = np.argsort(col, kind="stable")
        self.row_by_col, self.col_by_col, self.val_by_col = row[order], col[order], val[order]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return _sums(w.take(self.col, 0) * (self.val if w.ndim == 1 else self.val[:, None]), self.row, self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return _sums(g.take(self.row_by_col, 0) * (self.val_by_col if g.ndim == 1 else self.val_by_col[:, None]), self.col_by_col, self.shape[1])

    def squared(self) -> Sparse:
        out = Sparse([], [], self.shape[1])
        out._set(self.row, self.col, self.val**2, self.shape)
        return out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, grads: dict[str, np.ndarray], params: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def score_texts(docs: DataFrame, scorer: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, held_out, text); ``scorer()`` is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for b in slices(batches):
            s = score(b["text"].to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def features_of(texts: DataFrame, keys: list[str], featurise: Callable[[], Callable[[str | None], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(keys, col, val) of the texts: columns and values of each."""
    fields = ", ".join(f"{k} bigint" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = featurise()
        for b in slices(batches):
            made = [make(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({k: b[k] for k in keys} | {"col": pa.array([m[0] for m in made], pa.list_(pa.int32())), "val": pa.array([m[1] for m in made], pa.list_(pa.float32()))})

    return texts.select(*keys, "text").mapInArrow(run, f"{fields}, col array<int>, val array<float>")


def narrowed(rows: DataFrame, keys: list[str], place: np.ndarray) -> DataFrame:
    """``rows`` of (keys, col, val) with only the columns whose ``place`` is 0 or more, at their new places."""
    fields = ", ".join(f"{k} bigint" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b["col"].offsets.to_numpy()
            at = place[b["col"].values.to_numpy()[first[0] : first[-1]]]
            val = b["val"].values.to_numpy()[b["val"].offsets[0].as_py() :][: len(at)]
            ends = np.concatenate([[0], np.cumsum(at >= 0)])[first - first[0]].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[at >= 0])) for x in (at, val)]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), *lists], names=[*keys, "col", "val"])

    return rows.mapInArrow(run, f"{fields}, col array<int>, val array<float>")


def sample_rows(made: DataFrame, keys: list[str]) -> list:
    """A bounded sample's rows of (keys, col, val) on the driver, by way of Arrow; sorted, so reruns agree."""
    made = made.toArrow()
    rows = []
    for b in made.to_batches():
        (cols, at), (vals, _) = ((b[x].values.to_numpy(), b[x].offsets.to_numpy()) for x in ("col", "val"))
        names = [b[k].to_pylist() for k in keys]
        rows += [(*(n[i] for n in names), cols[x:y].copy(), vals[x:y].copy()) for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True))]
    return sorted(rows, key=lambda r: (*r[: len(keys)], r[len(keys)].tobytes()))
