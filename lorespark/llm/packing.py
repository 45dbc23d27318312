"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

CAPACITY, END, PIECE, WINDOWS, KNOWN = 2048, 1, 512, 256, 200_000
#: Characters encoded together, about; texts are never split here.
RUN = 8_000_000
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _runs(store: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``store`` that begin at ``first``, one after another, and where each of them begins, and the last one ends."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return store[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])], upto


class Ids:
    """Chunk between spaces -> its ids.  White space never joins two chunks in one token, so texts may be cut there.

    New chunks are encoded many at a time, with a digit between blanks between them that none of them holds; a digit by
    itself is one token of its own, so the ids are split at it again.  The ids of all chunks lie in one array.
    """

    def __init__(self, path: str, signs: str = "7391", most: int = KNOWN, together: int = 20_000):
        self.t, self.most, self.together = tokenizer(path), most, together
        self.at: dict[str, int] = {}
        self.store, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = lambda x: self.t.encode(x, add_special_tokens=False).ids
        self.marks = {x: ids(x)[0] for x in signs if len(ids(x)) == 1 and ids(f"a {x} b") == ids("a") + ids(x) + ids("b")}

    def _encode(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``words`` in the order in which they were encoded, their ids and how many each has."""
        order, made, sizes, left = [], [], [], words
        for sign, mark in self.marks.items():
            plain = [w for w in left if sign not in w and "<|" not in w]
            left = [w for w in left if sign in w or "<|" in w]
            for i in range(0, len(plain), self.together):
                group = plain[i : i + self.together]
                a = np.array(self.t.encode_batch_fast([f" {sign} ".join(group)], add_special_tokens=False)[0].ids, np.uint32)
                marked = a == mark
                sizes.append(np.diff(np.flatnonzero(np.concatenate([[True], marked, [True]]))) - 1)
                made.append(a[~marked])
                order += group
        for w in left:
            made.append(np.array(self.t.encode(w, add_special_tokens=False).ids, np.uint32))
            sizes.append([len(made[-1])])
            order.append(w)
        return order, np.concatenate([self.store[:0], *made]), np.concatenate([self.size[:0], *sizes])

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words``, and where those of each begin and the last end.

        Closing marks behind an ASCII letter are tokens of their own, so the words before them are looked up without."""
        cores, tails = words.to_numpy(zero_copy_only=False).tolist(), []
        marked = np.flatnonzero(pc.match_substring_regex(words, "[A-Za-z][,.!?;:]+$").to_numpy(zero_copy_only=False))
        for i in marked.tolist():
            w = cores[i]
            cores[i] = w.rstrip(",.!?;:")
            tails.append(w[len(cores[i]) :])
        every = cores + tails
        row, store, size = list(map(self.at.get, every)), self.store, self.size
        new = list(dict.fromkeys(w for w, i in zip(every, row, strict=True) if i is None))
        if new:
            order, ids, sizes = self._encode(new)
            fresh = dict(zip(order, range(len(size), len(size) + len(order)), strict=True))
            row = [fresh[w] if i is None else i for w, i in zip(every, row, strict=True)]
            store, size = np.concatenate([store, ids]), np.concatenate([size, sizes])
            if len(self.at) < self.most:
                self.at.update(fresh)
                self.store, self.size = store, size
        row = np.array(row, np.int64)
        # A word's closing marks stand right behind it.
        row = np.insert(row[: len(cores)], marked + 1, row[len(cores) :])
        tokens, upto = _runs(store, (np.cumsum(size) - size)[row], size[row])
        return tokens, np.delete(upto, marked + np.arange(1, len(marked) + 1))


_known: dict[str, Ids] = {}


def known_ids(path: str, most: int = KNOWN) -> Ids:
    """The chunks that this Python worker has met, kept from task to task; ``most`` of them are about 200 bytes each."""
    if path not in _known or _known[path].most != most:
        _known[path] = Ids(path, most=most)
    return _known[path]


def encoded(texts: pa.Array, known: Ids) -> Iterator[np.ndarray]:
    """The ids of each text; null counts as empty."""
    chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    flat = chunks.flatten().dictionary_encode()
    store, first = known.of(flat.dictionary)
    word = flat.indices.to_numpy(zero_copy_only=False)
    tokens, upto = _runs(store, first[word], np.diff(first)[word])
    at = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield tokens[upto[a] : upto[b]]


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length): whole windows first; what remains in equal parts of ``piece`` at most, small enough to balance."""
    whole = n // capacity
    made = [(i * capacity, capacity) for i in range(whole)]
    rest, at = n - whole * capacity, whole * capacity
    if rest:
        k = -(-rest // piece)
        for i in range(k):
            size = rest // k + (i < rest % k)
            made.append((at, size))
            at += size
    return made


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, end: int = END, most: int = KNOWN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and then ``end``, cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_ids(path, most)
        for b in slices(batches, 16 << 20):
            texts = b["text"]
            size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
            ends = np.r_[np.flatnonzero(np.diff(size // RUN)) + 1, len(texts)] if len(texts) else []
            for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True) if len(texts) else ():
                i, j = int(i), int(j)
                rows, out = [], []
                for k, ids in enumerate(encoded(texts.slice(i, j - i), known)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for start, length in cuts(len(ids), capacity, piece):
                        rows.append(i + k)
                        out.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                table = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].take(pa.array(rows, pa.int64()))} | dict(zip(("start", "length", "ids_crc32", "doc_tokens"), table.T.copy(), strict=True)))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each item when ``k`` windows are filled by Karmarkar-Karp differencing.

    Each item begins as a partial partition of its own: one window holds it, the others are empty.  The two partitions of
    greatest imbalance are merged, the fullest windows of the one with the emptiest of the other, until one is left; only
    differences between windows matter, so the smallest is taken off all.  Ties are broken by the order in which
    partitions arose.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap = []
    for count, item in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        heap.append((-int(sizes[item]) if k > 1 else 0, count, np.array([sizes[item]], np.int64), np.array([item], np.int64)))
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        (_, _, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        if len(a) + len(b) <= k:  # their windows do not meet, nothing is added
            loads, nodes = np.concatenate([a, b[::-1]]), np.concatenate([x, y[::-1]])
        else:
            loads, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)  # a partition holds its filled windows only
            loads[: len(a)], nodes[: len(a)] = a, x
            low = k - len(b)
            meet = np.flatnonzero((nodes[low:] >= 0) & (y[::-1] >= 0)) + low
            loads[low:] += b[::-1]
            fresh = np.arange(len(left), len(left) + len(meet))
            left.extend(nodes[meet].tolist())
            right.extend(y[k - 1 - meet].tolist())
            nodes[low:] = np.where(y[::-1] >= 0, y[::-1], nodes[low:])
            nodes[meet] = fresh
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        if len(loads) == k:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]) if len(loads) else 0, count, loads, nodes))
        count += 1
    window = np.zeros(n, np.int64)
    for w, top in enumerate(heap[0][3].tolist() if heap else ()):
        stack = [top] if top >= 0 else []
        while stack:
            node = stack.pop()
            if left[node] < 0:
                window[node] = w
            else:
                stack += [left[node], right[node]]
    return window


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Near-equal windows of at most ``capacity``; whenever differencing exceeds it there are more windows.

    As many more as would bring the fullest window under the capacity, were it to stand as far above the mean again.
    """
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, k)
        fullest = np.bincount(window, sizes).max() if len(sizes) else 0
        if fullest <= capacity:
            return window
        above = fullest - total / k
        k = max(k + 1, int(np.ceil(total / max(1.0, capacity - above))) if above < capacity / 2 else 0)


def pack(made: DataFrame, capacity: int = CAPACITY, per_block: int = WINDOWS) -> DataFrame:
    """Add sequence_id and offset to the rows of :func:`pieces`.

    Pieces are dealt by the hash of their row number, which equal rows don't share, into blocks of about ``per_block``
    windows, as many as the tokens need; each block is packed by itself, and its loss is a window or two.  Pieces of a
    whole window are sequences already.  ``made`` is written (:func:`cut`), so that its row numbers stay.
    """
    total = made.agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-int(total) // (capacity * per_block)))
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        size = group["length"].to_numpy()
        full = int((size == capacity).sum())
        window = np.concatenate([np.arange(full), full + windows(size[full:], capacity)]).astype(np.int64)
        order = np.argsort(window, kind="stable")
        sizes, owner = size[order], window[order]
        before = np.cumsum(sizes) - sizes
        offset = np.empty(len(size), np.int64)
        new = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
        offset[order] = before - np.repeat(before[new], np.diff(np.r_[np.flatnonzero(new), len(owner)]))
        base = group["block"].to_numpy() << 24
        return group.drop_columns(["block"]).append_column("sequence_id", pa.array(base + window)).append_column("offset", pa.array(offset))

    fields = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return made.withColumn("block", block).groupBy("block").applyInArrow(run, fields)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, per_block: int = WINDOWS, end: int = END, most: int = KNOWN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone.  A document that occurs several times is packed as often.  Extra columns
    are ignored; an empty table gives no rows.  Only lengths and check sums are shuffled, never texts or ids.  ``most``
    bounds the words that a Python worker remembers; it changes time and memory, never a result.
    """
    return pack(cut(pieces(docs, path, capacity, piece, end, most)), capacity, per_block)
