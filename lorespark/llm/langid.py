"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, slices, smallest_hashes, texts_of

DIM, N, SEED, SAMPLE, BLOCK, PIECE = 1024, 3, 7, 6000, 400_000, 200_000
UNKNOWN = "und"
_letters: dict[int, np.ndarray] = {}
_is_letter: list[np.ndarray] = []


def letter(code: int, dim: int = DIM) -> np.ndarray:
    """The random +1/-1 vector of a code point; it depends on nothing but the code point, so all tasks agree."""
    if code not in _letters or len(_letters[code]) != dim:
        _letters[code] = np.random.default_rng((SEED, code)).integers(0, 2, dim, dtype=np.int8) * 2 - 1
    return _letters[code]


def gram_vectors(grams: np.ndarray, n: int, dim: int) -> np.ndarray:
    """Bind: the letter vectors of an n-gram, each rotated by its place, multiplied element by element."""
    out = np.ones((len(grams), dim), np.int8)
    for place in range(n):
        codes, at = np.unique((grams >> (21 * place)) & 0x1FFFFF, return_inverse=True)
        out *= np.stack([np.roll(letter(int(c), dim), place) for c in codes])[at]
    return out.astype(np.float32)


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _letters_only(text: str) -> np.ndarray:
    """Code points in lower case, 32 for all that is no letter."""
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_is_letter[0][codes], codes, np.uint32(32))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of a stream of letters and single spaces; those that hold no letter in their first two places are left out."""
    size = max(0, len(codes) - n + 1)
    grams = np.zeros(size, np.int64)
    for place in range(n):
        grams |= codes[place : place + size].astype(np.int64) << (21 * place)
    return grams[(codes[1 : 1 + size] != 32) | (codes[:size] != 32)] if n > 1 else grams[codes[:size] != 32]


def text_grams(text: str | None, n: int = N, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of one text, read in pieces of ``piece`` characters whose counts are merged, so its arrays stay small.

    Whatever lies between two words counts as one space; the last n - 1 letters of a piece are carried into the next.
    """
    kinds, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = text or ""
    carry, space = np.array([32], np.uint32), True
    for at in range(0, len(text) + 1, piece):
        codes = _letters_only(text[at : at + piece] + (" " if at + piece > len(text) else ""))
        blank = codes == 32
        codes = codes[~(blank & np.r_[space, blank[:-1]])]
        space = bool(blank[-1]) if len(blank) else space
        stream = np.concatenate([carry, codes])
        carry = stream[max(0, len(stream) - n + 1) :]
        every = np.concatenate([kinds, new := np.sort(_grams(stream, n))])
        weight = np.concatenate([counts, np.ones(len(new), np.int64)])
        kinds, at_kind = np.unique(every, return_inverse=True)
        counts = np.bincount(at_kind, weight, len(kinds)).astype(np.int64)
    return kinds, counts


def gram_counts(texts: list[str | None], n: int = N, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of the letters in lower case; texts above ``piece`` characters are read in pieces, others together."""
    if any(len(t or "") > piece for t in texts):
        parts = [text_grams(t, n, piece) for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(g) for g, _ in parts])
        return owner, np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts])
    streams = _letters_only("".join(" " + (t or "") + " " for t in texts))
    size = np.fromiter((len((t or "").lower()) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    first = np.zeros(len(streams), bool)
    first[np.cumsum(size) - size] = True
    blank = streams == 32
    keep = ~blank | first
    keep[1:] |= ~blank[:-1]
    streams, owner = streams[keep], owner[keep]
    m = max(0, len(streams) - n + 1)
    whole = (owner[:m] == owner[n - 1 : n - 1 + m]) & ((streams[1 : 1 + m] != 32) | (streams[:m] != 32))
    grams = np.zeros(m, np.int64)
    for place in range(n):
        grams |= streams[place : place + m].astype(np.int64) << (21 * place)
    kinds, at = np.unique(grams[whole], return_inverse=True)
    both, count = np.unique(owner[:m][whole].astype(np.int64) * max(1, len(kinds)) + at, return_counts=True)
    return both // max(1, len(kinds)), kinds[both % max(1, len(kinds))] if len(kinds) else both, count


def bundle(texts: list[str | None], n: int = N, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each text's n-gram vectors, and whether it has a letter at all.  Counts enter by their square root."""
    owner, grams, count = gram_counts(texts, n)
    out = np.zeros((len(texts), dim), np.float32)
    kinds, at = np.unique(grams, return_inverse=True)
    for low in range(0, len(kinds), 8192):  # bounds the table of n-gram vectors
        part = (at >= low) & (at < low + 8192)
        weight = np.zeros((len(texts), min(8192, len(kinds) - low)), np.float32)
        weight[owner[part], at[part] - low] = np.sqrt(count[part])
        out += weight @ gram_vectors(kinds[low : low + 8192], n, dim)
    has = np.zeros(len(texts), bool)
    has[owner] = True
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def profiles(docs: DataFrame, sample: int = SAMPLE, n: int = N, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Language prototypes: the unit bundles of labelled rows, summed by Spark for each language and dimension.

    At most ``sample`` labelled rows are used (those of smallest seeded hash); what reaches the driver is one number for
    each language and dimension.  Rows without lang or doc_id teach nothing.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    ids = smallest_hashes(labelled, sample, seed).groupBy("doc_id").agg(F.min("lang").alias("known"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            texts, langs = b["text"].to_pylist(), b["known"].to_pylist()
            for i, j in blocks(texts):
                vectors, _ = bundle(texts[i:j], n, dim)
                for lang, v in zip(langs[i:j], _unit(vectors), strict=True):
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "at": np.arange(dim, dtype=np.int32), "x": v})

    parts = texts_of(docs, ids).select("text", "known").mapInArrow(sums, "lang string, at int, x double")
    rows = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).orderBy("lang", "at").collect()
    langs = sorted({r["lang"] for r in rows})
    table = np.zeros((len(langs), dim))
    for r in rows:
        table[langs.index(r["lang"]), r["at"]] = r["x"]
    return langs, _unit(table)


def identify(docs: DataFrame, langs: list[str], table: np.ndarray, n: int = N, dim: int = DIM) -> DataFrame:
    """Add nothing but (doc_id, held_out, lang_pred, score) to what ``docs`` (doc_id, held_out, text) has.

    The prediction is the prototype of greatest cosine, ties to the first in code-point order; the score is that cosine,
    at least 0.  Null texts, texts without letters, and any text where no language was learned give ``und`` and 0.
    Texts are read whole; extra columns are ignored; repeated rows are predicted alike.
    """
    table = table.astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b["text"].to_pylist()
            names, scores = [], []
            for i, j in blocks(texts):
                vectors, has = bundle(texts[i:j], n, dim)
                cos = _unit(vectors) @ table.T if len(langs) else np.zeros((j - i, 1))
                best = cos.argmax(1)
                names += [langs[k] if ok and langs else UNKNOWN for k, ok in zip(best, has, strict=True)]
                scores.append(np.where(has & bool(langs), np.clip(cos[np.arange(j - i), best], 0, 1), 0.0).astype(np.float64))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pa.array(names, pa.string()), "score": np.concatenate(scores) if scores else np.zeros(0)})

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Learn prototypes from the labelled rows that are not held out, then identify every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", in_fold(F.col("doc_id"), folds, held).alias("held_out"))
    return identify(docs, *profiles(docs.where(~F.col("held_out")), sample))
