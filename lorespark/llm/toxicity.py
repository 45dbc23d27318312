"""Toxicity by non-negative positive-unlabelled learning over hashed words and word beginnings (numpy, trained here)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_fold, slices, smallest_hashes, texts_of
from .textmodel import WORDS, Adam, Sparse, features_of, narrowed, sample_rows, score_texts, sigmoid

BUCKETS, POSITIVE, UNLABELLED, SEED = 1 << 20, 2500, 5000, 11
#: SCREEN: a column enters if the positives have so many standard errors more of it, FEATURES at most.
ROUNDS, RATE, PENALTY, SCREEN, FEATURES, SCALE = 150, 0.1, 1e-4, 3.3, 600, 4.0
STARTS, LEAST_ROWS = (4, 5, 6, 7), 3


def parts(word: str, buckets: int) -> list[int]:
    """Buckets of a word: itself, and its beginnings, which inflected and compound forms share."""
    made = [word, *(f"^{word[:k]}" for k in STARTS if len(word) >= k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in made]


class PartsOf(dict):
    """word -> what ``of`` says of its parts, remembered up to a bound."""

    def __init__(self, of, buckets: int, most: int = 300_000):
        super().__init__()
        self.of, self.buckets, self.most = of, buckets, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.of(parts(word, self.buckets))
        return found


def counted(buckets: int):
    """Columns and values of a text: how often each part occurs, over the square root of the number of words."""
    known = PartsOf(lambda x: x, buckets)

    def make(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = WORDS.findall((text or "").lower())
        col, count = np.unique(np.array([p for w in words for p in known[w]], np.int32), return_counts=True)
        return col, SCALE * count / np.sqrt(max(1, len(words)))

    return make


def screen(rows: DataFrame, least: float = SCREEN, most: int = FEATURES) -> list[int]:
    """Columns that the positives have ``least`` standard errors more of, the ``most`` clearest of them; few positives lower that bar.

    ``rows`` is (is_pos, col, val) with one row per text; the sums over columns are Spark's, so only the ``most`` columns come here.
    """
    n = {r["is_pos"]: r["n"] for r in rows.groupBy("is_pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    x = rows.select("is_pos", F.explode(F.arrays_zip("col", "val")).alias("x")).select("is_pos", "x.col", F.col("x.val").cast("double").alias("val"))
    sums = lambda flag: [F.sum(F.when(F.col("is_pos") == flag, y)).alias(f"{name}{flag}") for name, y in (("s", F.col("val")), ("q", F.col("val") ** 2), ("k", F.lit(1)))]
    made = cut(x.groupBy("col").agg(*sums(1), *sums(0)).where("k1 > 0").fillna(0))
    squares, entries = made.agg(F.sum("q1"), F.sum("k1")).first()
    floor = squares / entries / n_p**2 if entries else 1.0
    spread = lambda flag, m: F.greatest(F.col(f"q{flag}") / m - (F.col(f"s{flag}") / m) ** 2, F.lit(0.0)) / m
    t = (F.col("s1") / n_p - F.col("s0") / n_u) / F.sqrt(spread(1, n_p) + spread(0, n_u) + F.lit(floor))
    clear = made.where(F.col("k1") >= LEAST_ROWS).withColumn("t", t).where(F.col("t") >= min(least, 0.4 * float(np.sqrt(n_p))))
    return sorted(r["col"] for r in clear.orderBy(F.desc("t"), "col").limit(most).select("col").collect())


def nnpu(positive: Sparse, unlabelled: Sparse, prior: float, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimise the non-negative PU risk, first with the logistic loss, then with the sigmoid loss.

    Risk = prior E_p[l(z)] + max(0, E_u[l(-z)] - prior E_p[l(-z)]).  Where the second term, the risk on the negatives
    that hide in the unlabelled rows, falls below nought, its gradient is turned round instead, as the non-negative
    estimator asks for; that stops a flexible model from explaining the positives away.  The sigmoid loss is bounded, so
    wrong labels do not pull for ever.
    """
    p = {"w": np.zeros(positive.shape[1]), "b": np.array(np.log(prior / (1 - prior)))}
    n_p, n_u = max(1, positive.shape[0]), max(1, unlabelled.shape[0])
    for logistic in (True, False):
        adam = Adam(rate)
        for _ in range(rounds):
            s_p, s_u = sigmoid(positive @ p["w"] + p["b"]), sigmoid(unlabelled @ p["w"] + p["b"])
            if logistic:
                hidden = -np.log1p(-s_u + 1e-15).mean() + prior * np.log1p(-s_p + 1e-15).mean()
                up, as_neg, down = 1 - s_p, s_p, s_u
            else:
                hidden = s_u.mean() - prior * s_p.mean()
                up, as_neg, down = s_p * (1 - s_p), s_p * (1 - s_p), s_u * (1 - s_u)
            sign = 1.0 if hidden >= 0 else -1.0
            g_p = -prior / n_p * (sign * as_neg + (up if sign > 0 else 0))
            g_u = sign * down / n_u
            adam.step({"w": positive.back(g_p) + unlabelled.back(g_u) + penalty * p["w"], "b": g_p.sum() + g_u.sum()}, p)
    return p["w"], float(p["b"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE, unlabelled: int = UNLABELLED, buckets: int = BUCKETS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Fit on at most ``positives`` confirmed toxic rows and ``unlabelled`` others of ``docs``, by smallest seeded hash.

    The class prior is the share of toxic rows among all labels given.  A document labelled twice is toxic if any label
    says so.  Without a toxic row, or without unlabelled text, the model says 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    zero = np.zeros(buckets), -35.0
    if not n_pos:
        return zero
    prior = min(0.9, max(1e-4, n_pos / n))
    pos = smallest_hashes(known.where("toxic = 1").select("doc_id"), positives, seed).withColumn("is_pos", F.lit(1).cast("long"))
    unl = smallest_hashes(docs.where("doc_id is not null").select("doc_id"), unlabelled, seed + 1).distinct().withColumn("is_pos", F.lit(0).cast("long"))
    rows = cut(features_of(texts_of(docs, pos.unionByName(unl)), ["doc_id", "is_pos"], lambda: counted(buckets)))
    keep = screen(rows)
    place = np.full(buckets, -1, np.int32)
    place[keep] = np.arange(len(keep))
    few = sample_rows(narrowed(rows, ["doc_id", "is_pos"], place), ["doc_id", "is_pos"])
    part = lambda flag: Sparse([r[2] for r in few if r[1] == flag], [r[3] for r in few if r[1] == flag], max(1, len(keep)))
    a, b = part(1), part(0)
    if not a.shape[0] or not b.shape[0]:
        return zero
    small, bias = nnpu(a, b, prior)
    weights = np.zeros(buckets)
    weights[keep] = small[: len(keep)]
    return weights, bias


def scorer_of(weights: np.ndarray, bias: float):
    live, buckets = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}, len(weights)

    def scorer():
        known = PartsOf(lambda x: sum(live.get(i, 0.0) for i in x), buckets)

        def one(text: str | None) -> float:
            words = WORDS.findall((text or "").lower())
            return SCALE * sum(map(known.__getitem__, words)) / max(1, len(words)) ** 0.5

        return lambda texts: sigmoid(np.array([one(t) for t in texts], np.float64) + bias)

    return scorer


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null and empty texts have no words and score by the bias alone."""
    return score_texts(docs, scorer_of(weights, bias))


def _learned(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> tuple[np.ndarray, float]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~in_fold(F.col("doc_id"), folds, held))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~in_fold(F.col("doc_id"), folds, held))
    return train(docs, labels)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Train on what is not held out, then score every row.  Extra columns are ignored; repeated rows are scored alike."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", in_fold(F.col("doc_id"), folds, held).alias("held_out"))
    return score(rows, *_learned(docs, labels, folds, held))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; nothing is shuffled but the sample.

    Null and empty texts stay, unless the bias alone reaches the threshold.
    """
    scorer = scorer_of(*_learned(docs, labels, folds, held))

    def run(batches):
        score = scorer()
        for b in slices(batches):
            yield b.filter(pa.array(score(b["text"].to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
