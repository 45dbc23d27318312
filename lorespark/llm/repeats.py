"""Passages that occur twice in a corpus, byte for byte, by suffix arrays of shards.

Every string of ``WIDTH`` bytes (a window) belongs to one place inside it, its anchor: the first of its ``GRAM``-byte
strings of the smallest hash.  Equal windows have equal anchors, so shards are dealt by the anchors' hashes, and a window
is looked for among the contexts of its own anchor only.  A context is the text of all windows of one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .suffixes import repeated

WIDTH, GRAM = 200, 64
#: Bytes looked at together in a task; of contexts in a shard, about.
RUN, SHARD_BYTES = 1 << 17, 1 << 20
#: Rows that are broadcast at most (up to 32 bytes each); contexts of one anchor that a shard takes at most.
BROADCAST, HOT = 2_000_000, 2000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


def gram_hashes(t: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes; ``gram`` is a power of two, halves are joined at every step."""
    h = (t.astype(np.uint64) + np.uint64(1)) * _GOLD
    h ^= h >> np.uint64(29)
    size, step = 1, 0
    while size < gram:
        h = h[:-size] * _ODD[step] + h[size:]
        h ^= h >> np.uint64(31)
        size, step = 2 * size, step + 1
    h *= _GOLD
    return h ^ (h >> np.uint64(32))


def owners(t: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each place of ``t``, and the hashes of its grams.  The hash's last 24 bits give way to
    the place, so that the first of equal ones is the smallest."""
    h = gram_hashes(t, gram)
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, size = width - gram + 1, 1
    while 2 * size <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: -(span - size)], key[span - size :])
    return (key & np.uint64(0xFFFFFF)).astype(np.int64), h


def contexts(raw: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor's hash) of every anchor of the texts.

    Texts are looked at in runs of about RUN windows, which overlap by a window, so a text of any length needs little
    memory; the windows of an anchor that two runs share are put together again.
    """
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum(size)
    found = []
    for at in range(0, max(0, len(flat) - width + 1), RUN):
        t = flat[at : at + RUN + width - 1]
        own, h = owners(t, width, gram)
        place = np.arange(at, at + len(own))
        text = np.searchsorted(end, place, "right")
        place = place[inside := place + width <= end[text]]
        if len(place):
            own, text = own[inside], text[inside]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
            first = np.flatnonzero(new)
            found.append((text[first], place[first], np.diff(np.append(first, len(place))), own[first] + at, h[own[first]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text, start, windows, anchor, h = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    windows = np.add.reduceat(windows, new)
    return text[new], start[new] - (end - size)[text[new]], windows, h[new].view(np.int64)


def _distinct(texts: pa.Array, width: int) -> tuple[list[bytes], list[int], list[int]]:
    """The distinct texts of a slice that have a window, the row of each and how many rows have it."""
    rows: dict[bytes, list[int]] = {}
    for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        if t is not None and len(t) >= width:
            rows.setdefault(t, []).append(i)
    return list(rows), [x[0] for x in rows.values()], [len(x) for x in rows.values()]


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(hash, n): how often each anchor's hash occurs in a slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, _, times = _distinct(batch["text"], width)
            text, _, _, h = contexts(raw, width, gram)
            keys, back = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"hash": keys.astype(np.int64), "n": np.bincount(back, np.array(times, np.int64)[text], len(keys)).astype(np.int64)})

    return docs.select("text").mapInArrow(run, "hash bigint, n bigint")


def places(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(p, q, start, windows, hash, context, n) of each anchor of each distinct text of a slice; p and q stand for the text,
    ``context`` for the bytes of its windows, ``n`` is the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, row, times = _distinct(batch["text"], width)
            text, start, windows, h = contexts(raw, width, gram)
            own = np.fromiter((xxhash.xxh3_64_intdigest(raw[k][i : i + n + width - 1]) for k, i, n in zip(text.tolist(), start.tolist(), windows.tolist(), strict=True)), np.uint64, len(text))
            row = pa.array(np.array(row, np.int64)[text])
            yield pa.RecordBatch.from_pydict({
                "p": batch["p"].take(row), "q": batch["q"].take(row), "start": start.astype(np.int64), "windows": windows.astype(np.int64), "hash": h,
                "context": own.view(np.int64), "n": np.array(times, np.int64)[text],
            })

    return docs.select("p", "q", "text").mapInArrow(run, "p bigint, q bigint, start bigint, windows bigint, hash bigint, context bigint, n bigint")


def _few(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= BROADCAST else rows


def _texts_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(hash, context, hot, bytes) of the places ``wanted`` (p, q, start, windows, hash, context, hot), once for each context."""
    lists = cut(wanted.groupBy("p", "q").agg(F.collect_list(F.struct("start", "windows", "hash", "context", "hot")).alias("places")))
    count = lists.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch["places"]
            many = np.diff(lists.offsets.to_numpy())
            x = lists.flatten()
            column = {f.name: x.field(i) for i, f in enumerate(x.type)}
            at, n = column["start"].to_pylist(), column["windows"].to_pylist()
            owner = np.repeat(np.arange(len(many)), many).tolist()
            raw = batch["text"].cast(pa.binary()).to_pylist()
            cuts = [raw[k][i : i + m + width - 1] for k, i, m in zip(owner, at, n, strict=True)]
            yield pa.RecordBatch.from_pydict({"hash": column["hash"], "context": column["context"], "hot": column["hot"], "bytes": pa.array(cuts, pa.binary())})

    found = docs.join(_few(lists, count), ["p", "q"]).select("text", "places").mapInArrow(run, "hash bigint, context bigint, hot boolean, bytes binary")
    return found.groupBy("hash", "context", "hot").agg(F.min("bytes").alias("bytes"))


def _runs(at: np.ndarray, width: int) -> list[int]:
    """First and last end, by turns, of the stretches that windows at the ascending places ``at`` cover."""
    new = np.flatnonzero(np.diff(at) > width)
    return np.stack([at[np.append(0, new + 1)], at[np.append(new, len(at) - 1)] + width], 1).ravel().tolist()


def _by_arrays(texts: DataFrame, n_bytes: int, width: int) -> DataFrame:
    """(hash, context, covered): suffix arrays of shards that hold all contexts of their anchors."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("hash", "ascending"), ("context", "ascending")])
        found = repeated(t["bytes"].to_pylist(), width)
        hit = [i for i, x in enumerate(found) if len(x)]
        t = t.select(["hash", "context"]).take(pa.array(hit, pa.int64()))
        return t.append_column("covered", pa.array([_runs(found[i], width) for i in hit], pa.list_(pa.int64())))

    shard = F.pmod(F.xxhash64("hash"), F.lit(max(1, -(-int(n_bytes) // SHARD_BYTES)))).alias("shard")
    return texts.select("hash", "context", "bytes", shard).groupBy("shard").applyInArrow(run, "hash bigint, context bigint, covered array<bigint>")


def _by_windows(texts: DataFrame, width: int) -> DataFrame:
    """The same for anchors of very many contexts: their windows are counted one by one, so no task holds such an anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, at, digest = [], [], []
            for i, b in enumerate(batch["bytes"].to_pylist()):
                for k in range(len(b) - width + 1):
                    rows.append(i)
                    at.append(k)
                    digest.append(xxhash.xxh3_128_digest(b[k : k + width]))
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict({"hash": batch["hash"].take(row), "context": batch["context"].take(row), "at": pa.array(at, pa.int64()), "digest": pa.array(digest, pa.binary())})

    each = texts.select("hash", "context", "bytes").mapInArrow(run, "hash bigint, context bigint, at bigint, digest binary")
    twice = each.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("digest")
    covered = F.flatten(F.transform(F.array_sort(F.collect_list("at")), lambda x: F.array(x, x + width)))
    return each.join(twice, "digest").groupBy("hash", "context").agg(covered.alias("covered"))


def spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(p, q, spans): for each text with repeated windows, the bytes they cover, as ascending ends by turns.

    ``docs`` has text and the two hashes p and q that stand for it.
    """
    known = cut(anchors(docs, width, gram).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"))
    at = places(docs, width, gram).join(_few(known, known.count()), "hash", "left_semi")
    at = cut(at.groupBy("p", "q", "start", "windows", "hash", "context").agg(F.sum("n").alias("n")))
    # Equal contexts are one, with their number; what occurs twice as a whole is repeated as a whole.
    place = F.struct("p", "q", "start", "windows")
    whole = cut(at.groupBy("hash", "context").agg(F.sum("n").alias("n"), F.min(place).alias("place")))
    several = whole.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    several = several.select("hash", (F.col("k") > hot).alias("hot"))
    wanted = cut(whole.join(several, "hash").select("hash", "context", "hot", "place.*"))
    n_bytes, n_hot = wanted.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("windows") + width - 1)), F.lit(0)), F.count_if("hot")).first()
    texts = _texts_of(docs, wanted, width)
    if n_hot:
        texts = cut(texts)
    parts = _by_arrays(texts.where("not hot"), n_bytes, width)
    if n_hot:
        parts = parts.unionByName(_by_windows(texts.where("hot"), width))
    full = whole.where("n > 1").select("hash", "context", F.array(F.lit(0).cast("long"), F.col("place.windows") + width - 1).alias("covered"))
    covered = full.unionByName(parts.join(whole.where("n = 1").select("hash", "context"), ["hash", "context"], "left_semi"))
    found = at.select("p", "q", "start", "hash", "context").join(covered, ["hash", "context"])
    found = found.select("p", "q", F.transform("covered", lambda x: x + F.col("start")).alias("covered"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for x in batch["covered"]:
                ends = x.values.flatten().to_numpy().reshape(-1, 2)
                ends = ends[np.argsort(ends[:, 0], kind="stable")]
                reach = np.maximum.accumulate(ends[:, 1])
                new = np.flatnonzero(ends[1:, 0] > reach[:-1])
                out.append(np.stack([ends[np.append(0, new + 1), 0], reach[np.append(new, len(reach) - 1)]], 1).ravel())
            yield pa.RecordBatch.from_pydict({"p": batch["p"], "q": batch["q"], "spans": pa.array(out, pa.list_(pa.int64()))})

    return found.groupBy("p", "q").agg(F.collect_list("covered").alias("covered")).mapInArrow(union, "p bigint, q bigint, spans array<bigint>")


def strip_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans, kept (binary): the text without each byte of a repeated window.

    Windows are judged on the texts as they came, and do not reach over a text's end; a text that occurs twice is all
    repeated, if it has a window at all.  Removal is by bytes, so ``kept`` need not be valid UTF-8.  Null texts count as
    empty.  A null or repeated doc_id is kept, each row for itself; columns other than doc_id and text are ignored; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("p"), F.xxhash64(F.lit(1), text, F.length(text)).alias("q"))
    found = cut(spans(docs.select("p", "q", "text"), width, gram, hot))
    count = found.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, size = [], []
            for t, ends in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
                size.append(len(t))
                ends = [0, *(ends or ()), len(t)]
                kept.append(b"".join([t[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array(size, pa.int64()), "spans": batch["spans"], "kept": pa.array(kept, pa.binary())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.join(_few(found, count), ["p", "q"], "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<bigint>, kept binary")


def digests(made: DataFrame) -> DataFrame:
    """Lengths and a digest in place of the texts of :func:`strip_repeats`."""
    return made.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans") / 2, F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
