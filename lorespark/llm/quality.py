"""Text quality by a factorisation machine over hashed words, structure statistics and metadata (numpy, trained here)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, slices, smallest_hashes
from .textmodel import WORDS, Adam, Hashed, Sparse, sample_rows, sigmoid

BUCKETS, BINS, RANK, SAMPLE, SEED = 1 << 15, 12, 4, 2500, 13
ROUNDS, RATE, DECAY, WORD_SHARE = 60, 0.1, 3e-4, 0.5


#: Kinds of characters as bits.
SPACE_, LETTER, UPPER, DIGIT, MARK, BAR, ASKS, SIGN, STOP, COMMA, LINE = (1 << i for i in range(11))
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """What each code point is, as bits; made once a Python worker."""
    if not _kinds:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            x = chr(c)
            table[c] = LETTER * x.isalpha() | UPPER * (x.isupper() and c < 0x250) | DIGIT * x.isdecimal() | MARK * (not x.isalnum() and not x.isspace() and x != "_")
        for bit, signs in ((SPACE_, " \t\n\v\f\r"), (BAR, "|"), (ASKS, "!?"), (SIGN, "#$%&*<>{}[]\\^~_=+@/"), (STOP, ".!?"), (COMMA, ".,!?;:"), (LINE, "\n")):
            table[[ord(x) for x in signs]] |= bit
        _kinds.append(table)
    return _kinds[0]


def structure(texts: list[str]) -> np.ndarray:
    """Shares and means of each text, each squeezed into 0..1: letters, capitals, digits, punctuation, word and line shapes, length.

    All texts are looked at together, as one array of code points with a line end before and behind each.
    """
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    what = kinds()[codes]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(size + 1)])  # the line end before each text, and the last one

    def share(bit: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum((what & bit) != 0)])[at])

    n = np.maximum(1, size)
    blank = (what & SPACE_) != 0
    starts, ends = np.flatnonzero(~blank[1:] & blank[:-1]) + 1, np.flatnonzero(~blank[:-1] & blank[1:])
    of_word = np.searchsorted(at, starts, "right") - 1
    per = lambda x: np.bincount(of_word, x, len(texts))
    k = np.maximum(1, np.bincount(of_word, minlength=len(texts)))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, of_word, ends - starts + 1)
    last = what[ends]
    odd = per(((last & (COMMA | LETTER | DIGIT)) == 0).astype(float))
    breaks = np.flatnonzero((what & LINE) != 0)
    before = np.searchsorted(ends, breaks, "left") - 1  # the word that ends before each line end
    filled = np.zeros(len(breaks), bool)
    filled[1:] = (before[1:] >= 0) & (ends[np.maximum(before[1:], 0)] > breaks[:-1]) if len(ends) else False
    line_of = np.searchsorted(at, breaks[filled] - 1, "right") - 1
    m = np.maximum(1, np.bincount(line_of, minlength=len(texts)))
    stopped = np.bincount(line_of, (last[before[filled]] & STOP) != 0, len(texts)) if len(ends) else np.zeros(len(texts))
    letters = share(LETTER)
    squeezed = [
        letters / n, share(UPPER) / np.maximum(1, letters), share(DIGIT) / n, share(MARK) / n,
        share(BAR) * 8 / n, share(ASKS) * 8 / n, share(SIGN) * 8 / n, letters / k / 16, n / m / 1000, odd / k,
        np.log1p(per(np.ones(len(starts)))) / 16, stopped / m, longest / (50 + longest),
    ]
    return np.minimum(1.0, np.stack(squeezed, 1))


N_STATS = 15  # those of structure(), and the shares of different words and lines


def encode(hashed: Hashed, bins: int = BINS, metadata: Sequence[str] = ()):
    """(row, column, value) of many texts: hashed words (unit length together), then each statistic as a soft pair of neighbouring bins.

    ``rows`` holds the metadata: a number is a statistic of its logarithm, anything else a hashed word with its name; a
    missing one is a word too.
    """

    def make(texts: list[str | None], rows: list[dict] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        cols, sizes, shares = [], [], []
        for i, t in enumerate(texts):
            words, lines = WORDS.findall(t.lower()), [x for x in t.split("\n") if x and not x.isspace()]
            found = set(words)
            shares.append((len(found) / max(1, len(words)), len(set(lines)) / max(1, len(lines))))
            extra = [f"{name}={rows[i][name]}" for name in metadata if not isinstance(rows[i][name], int | float)] if metadata else []
            own = np.unique(np.fromiter((hashed[w] for w in (*found, *extra)), np.int32, len(found) + len(extra)))
            cols.append(own)
            sizes.append(len(own))
        stats = np.concatenate([structure(texts), np.array(shares).reshape(-1, 2)], 1)
        if metadata:
            more = np.array([[np.log1p(abs(float(r[name]))) / 24 if isinstance(r[name], int | float) else 0.0 for name in metadata] for r in rows]).reshape(len(texts), -1)
            stats = np.concatenate([stats, np.nan_to_num(more)], 1)
        size = np.array(sizes, np.int64)
        x = np.clip(np.sqrt(stats), 0, 1) * (bins - 1)
        low = np.minimum(x.astype(np.int32), bins - 2)
        at = hashed.buckets + np.arange(stats.shape[1], dtype=np.int32) * bins + low
        row = np.concatenate([np.repeat(np.arange(len(texts)), size), np.repeat(np.arange(len(texts)), 2 * stats.shape[1])])
        col = np.concatenate([*cols, np.concatenate([at, at + 1], 1).ravel()]).astype(np.int32)
        val = np.concatenate([np.repeat(WORD_SHARE / np.sqrt(np.maximum(1, size)), size), np.concatenate([1 - (x - low), x - low], 1).ravel()])
        order = np.argsort(row, kind="stable")
        return row[order], col[order], val[order].astype(np.float32)

    return make


def fm_scores(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, model: dict[str, np.ndarray]) -> np.ndarray:
    """Of ``n`` rows, in linear time: the pairwise part is half of (sum of v x) squared less the sum of (v x) squared."""
    vx = model["v"].take(col, 0) * val[:, None]
    sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(vx.shape[1])], 1)
    return model["b"] + np.bincount(row, model["w"].take(col) * val - 0.5 * (vx**2).sum(1), n) + 0.5 * (sums**2).sum(1)


def fit(x: Sparse, y: np.ndarray, rank: int = RANK, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> dict[str, np.ndarray]:
    """Full-batch Adam on the logistic loss; both classes weigh as they occur."""
    rng = np.random.default_rng(seed)
    share = min(0.99, max(0.01, float(y.mean())))
    p = {"w": np.zeros(x.shape[1]), "v": rng.normal(0, 0.02, (x.shape[1], rank)), "b": np.array(np.log(share / (1 - share)))}
    square, adam = x.squared(), Adam(rate)
    for _ in range(rounds):
        sums = x @ p["v"]
        z = p["b"] + x @ p["w"] + 0.5 * ((sums**2).sum(1) - square @ (p["v"] ** 2).sum(1))
        g = (sigmoid(z) - y) / len(y)
        gv = x.back(g[:, None] * sums) - p["v"] * square.back(g)[:, None]
        adam.step({"w": x.back(g) + decay * p["w"], "v": gv + decay * p["v"], "b": g.sum()}, p)
    return p


def _held(texts: pa.RecordBatch, metadata: Sequence[str]) -> list[dict] | None:
    return texts.select(list(metadata)).to_pylist() if metadata else None


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, seed: int = SEED, metadata: Sequence[str] = ()) -> dict[str, np.ndarray]:
    """Fit on at most ``sample`` labelled rows by smallest seeded hash.  A document labelled twice counts by its lower label.

    Without labels the model says 0.5 of everything.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    texts = docs.select("doc_id", "text", *metadata).join(F.broadcast(smallest_hashes(known, sample, seed)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encode(Hashed(buckets), metadata=metadata)
        for b in slices(batches):
            row, col, val = make(b["text"].to_pylist(), _held(b, metadata))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (col, val)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], *lists], names=["doc_id", "quality", "col", "val"])

    rows = sample_rows(texts.mapInArrow(run, "doc_id bigint, quality bigint, col array<int>, val array<float>"), ["doc_id", "quality"])
    width = buckets + (N_STATS + len(metadata)) * BINS
    if not rows:
        return {"w": np.zeros(width), "v": np.zeros((width, 1)), "b": np.array(0.0)}
    return fit(Sparse([r[2] for r in rows], [r[3] for r in rows], width), np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: dict[str, np.ndarray], buckets: int = BUCKETS, metadata: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null counts as empty, and an empty text has a score as any other."""
    model = {k: v.astype(np.float32) for k, v in model.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encode(Hashed(buckets), metadata=metadata)
        for b in slices(batches):
            s = sigmoid(fm_scores(*make(b["text"].to_pylist(), _held(b, metadata)), b.num_rows, model).astype(np.float64))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.select("doc_id", "held_out", "text", *metadata).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, metadata: Sequence[str] = ()) -> DataFrame:
    """Train on what is not held out, then score every row.

    ``metadata`` names further columns of ``docs`` (numbers, text or null) that enter the machine; other extra columns are
    ignored.  Repeated rows are scored alike.  Of rows whose seeded hashes tie, the smaller doc_id is drawn first; labels
    of one class only give a model that says that class.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *metadata, in_fold(F.col("doc_id"), folds, held).alias("held_out"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~in_fold(F.col("doc_id"), folds, held))
    return score(docs, train(docs.where(~F.col("held_out")), labels, metadata=metadata), metadata=metadata)
