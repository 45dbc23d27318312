"""Links between the tokens of two public tokenizers, and how often each pair of token ids is linked.

A text is cut where both tokenizers are known to begin a new token: before a single blank or line end that stands between
characters which are not white space.  Such a chunk is encoded once for all the places where a worker meets it, and its
tokens, groups and links are the same wherever it stands.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Chunks remembered by a Python worker, and the bytes of their data at most.
KNOWN, KNOWN_BYTES = 400_000, 128 << 20
#: Id pairs that are broadcast at most (16 bytes each); beyond it documents and pairs meet by a join.
BROADCAST_PAIRS, SALTS, FLUSH = 2_000_000, 16, 1_000_000
_BREAK, _PLAIN = re.compile(r"(?<=\S)(?=[ \n]\S)"), re.compile(r"[ \n]\S+")
#: Short chunks encoded together.
TOGETHER = 500


def byte_decoder() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes of Latin-1 are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_decoder()
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of the second tokenizer reach over blanks or line ends, so texts cannot be cut there")
        self.blank = self.b.piece_to_id("▁")
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))

    def _alone(self, chunk: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for one chunk, None where either does not give its bytes back.  A chunk that does not begin with a blank
        loses the blank that the second tokenizer adds."""
        a, b = self.a.encode(chunk, add_special_tokens=False).ids, self.b.encode(chunk[1:] if chunk[0] == " " else chunk)
        if chunk[0] != " ":
            b = b[1:] if b and b[0] == self.blank else []
        raw = chunk.encode("utf-8", "surrogatepass")
        same = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """(right, ids of A, of B, numbers of A's ids by chunk, of B's).  Short chunks are encoded many at a time, as in a text of
        their own: one behind the other they are cut where they were; where that fails, each by itself."""
        runs: list[list[int]] = [[]]
        for i, c in enumerate(chunks):
            if len(c) > 64 or not _PLAIN.fullmatch(c):
                runs += [[i], []]
            else:
                runs[-1].append(i)
                if len(runs[-1]) == TOGETHER:
                    runs.append([])
        runs = [r for r in runs if r]
        many = [r for r in runs if len(r) > 1]
        joined = ["".join([chunks[i] for i in r]) for r in many]
        both = zip(self.a.encode_batch_fast([" a" + g for g in joined], add_special_tokens=False), self.b.encode(["a" + g for g in joined], num_threads=1), joined, strict=True)
        right, ids, n = np.zeros(len(chunks), bool), ([], []), (np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64))
        for r in runs:
            taken = self._together(*next(both), [chunks[i] for i in r]) if len(r) > 1 else None
            if taken is not None:
                right[r] = True
                for side in (0, 1):
                    ids[side].append(taken[side])
                    n[side][r] = taken[side + 2]
                continue
            for i in r:
                if (one := self._alone(chunks[i])) is not None:
                    right[i] = True
                    for side in (0, 1):
                        ids[side].append(one[side])
                        n[side][i] = len(one[side])
        flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in ids]
        return right, *flat, *n

    def _together(self, a, b: list[int], joined: str, chunks: list[str]) -> tuple | None:
        raw = b" a" + joined.encode("utf-8", "surrogatepass")
        ends = np.cumsum([2, *(len(c) if c.isascii() else len(c.encode("utf-8", "surrogatepass")) for c in chunks)])
        found = []
        for ids, of, size in ((a.ids, self.bytes_a, self.size_a), (b, self.bytes_b, self.size_b)):
            if b"".join([of[i] for i in ids]) != raw:
                return None
            ids = np.array(ids, np.int64)
            at = np.cumsum(size[ids])
            cut = np.searchsorted(at, ends)
            if (at[cut] != ends).any():
                return None
            found.append((ids[cut[0] + 1 :], np.diff(cut)))
        return found[0][0], found[1][0], found[0][1], found[1][1]


def linked(ends_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all linked pairs: token i of A with ``n_b[i]`` tokens of B from ``first_b[i]`` on, by repetition."""
    a = np.repeat(np.arange(len(ends_a)), n_b)
    return a, np.repeat(first_b - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(a))


class Chunks(dict):
    """Chunk -> its number; what is known of the chunks stands in arrays."""

    def __init__(self, pair: Pair, links: str, table: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        super().__init__()
        self.pair, self.links, self.table = pair, links, table
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.n = np.zeros((0, 7), np.int64)  # right, n_a, n_b, n_groups, n_links, n_best, count_sum
        self.text: list[bytes] = []
        self.keys: list[np.ndarray] = []
        self.used, self.most = 0, KNOWN

    def _forget(self) -> None:
        """Keep the first that were met, the frequent ones among them."""
        for c in self.late:
            del self[c]
        self.n, self.text, self.keys = self.n[: self.most], self.text[: self.most], self.keys[: self.most]

    def __missing__(self, chunk: str) -> int:
        i = self[chunk] = len(self)
        self.fresh.append(chunk)
        return i

    def look(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; all of them are known afterwards, until the next look."""
        if len(self) > self.most:
            self._forget()
        before = len(self)
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.fresh:
            self._learn(self.fresh)
            self.used += sum(map(len, self.fresh[: max(0, self.most - before)]))
            if self.used * 16 > KNOWN_BYTES:
                self.most = min(self.most, before)
            self.late, self.fresh = self.fresh[max(0, self.most - before) :], []
        return at

    def _learn(self, chunks: list[str]) -> None:
        p = self.pair
        right, flat_a, flat_b, n_a, n_b = p.encode(chunks)
        ends_a, ends_b = np.cumsum(p.size_a[flat_a]), np.cumsum(p.size_b[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        if self.links == "end":
            first = np.searchsorted(ends_b, ends_a)
            met = (first < len(ends_b)) & (ends_b[np.minimum(first, len(ends_b) - 1)] == ends_a) if len(ends_b) else np.zeros(len(ends_a), bool)
            ia, ib = linked(ends_a, ends_b, first, met.astype(np.int64))
        else:
            lo, hi = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, "right")
            ia, ib = linked(ends_a, ends_b, lo, hi - lo)
        key = (flat_a[ia] << 32) | flat_b[ib]
        upto = np.cumsum(n_a)
        owner = np.searchsorted(upto, ia, "right")  # the chunk of each link
        stat = np.zeros((len(chunks), 7), np.int64)
        stat[:, 0], stat[:, 1], stat[:, 2] = right, n_a, n_b
        last = np.r_[0, upto]
        ends_at = np.r_[0, ends_a][last]
        stat[:, 3] = np.searchsorted(common, ends_at[1:], "right") - np.searchsorted(common, ends_at[:-1], "right")
        stat[:, 4] = np.bincount(owner, minlength=len(chunks))
        if self.table is not None:
            keys, counts, best = self.table
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            stat[:, 5] = np.bincount(owner, best[place], len(chunks))
            np.add.at(stat[:, 6], owner, counts[place])
            self.text += self._texts(flat_a, flat_b, group_a, group_b, stat[:, 3])
        else:
            at = np.r_[0, np.cumsum(stat[:, 4])]
            self.keys += [key[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        self.n = np.concatenate([self.n, stat])

    @staticmethod
    def _texts(flat_a, flat_b, group_a, group_b, n_groups) -> list[bytes]:
        """The groups of each chunk as text."""
        n = int(n_groups.sum())
        side = []
        for flat, group in ((flat_a, group_a), (flat_b, group_b)):
            at, ids = np.searchsorted(group, np.arange(n + 1)).tolist(), [b"%d" % i for i in flat.tolist()]
            side.append([b",".join(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
        both = [x + b"|" + y for x, y in zip(*side, strict=True)]
        at = np.r_[0, np.cumsum(n_groups)].tolist()
        return [b";".join(both[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


_pairs: dict[tuple[str, str], Pair] = {}
_known: dict[tuple, Chunks] = {}


def _chunks(path_a: str, path_b: str, links: str, table=None, name=None) -> Chunks:
    """What this Python worker knows, from task to task, under ``name``; what it knew under others goes."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    key = (path_a, path_b, links, name)
    if key not in _known:
        for other in [k for k in _known if k[3] != name]:
            del _known[other]
        _known[key] = Chunks(_pairs[path_a, path_b], links, table)
    return _known[key]


def _regular(t: str) -> bool:
    """Whether all white space of ``t``, which begins with a blank, is single blanks and line ends before something else, so that
    each is a place to cut."""
    words = t.split()
    return len(t) - sum(map(len, words)) == len(words) == t.count(" ") + t.count("\n") and "\0" not in t


def _cut(texts: Iterable[str | None]) -> tuple[list[str], np.ndarray]:
    """All chunks of the texts, each behind a blank, and where each text's chunks end."""
    flat: list[str] = []
    ends = []
    for t in texts:
        if t:
            t = " " + t
            flat += t.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")[1:] if _regular(t) else _BREAK.split(t)
        ends.append(len(flat))
    return flat, np.array(ends, np.int64)


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0)])
    return upto[ends] - upto[np.r_[0, ends[:-1]]]


def pair_counts(docs: DataFrame, path_a: str, path_b: str, links: str = "end", salts: int = SALTS) -> DataFrame:
    """(key, n): how many links of the corpus hold each pair of ids; key is A's id times 2^32 plus B's.

    A task adds up its own links; a first shuffle by key and salt, and a second by key, add up the rest, so a pair that
    every document holds is no large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _chunks(path_a, path_b, links, None, "counts")
        held: list[np.ndarray] = []

        def added(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([p[:, 0] for p in parts]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, back, np.concatenate([p[:, 1] for p in parts]))
            return keys, n

        for batch in slices(batches):
            flat, ends = _cut(batch["text"].to_pylist())
            at = known.look(flat)
            right = np.diff(np.r_[0, np.cumsum(known.n[at, 0])][np.r_[0, ends]]) == np.diff(np.r_[0, ends])
            at = at[np.repeat(right, np.diff(np.r_[0, ends]))]
            which, times = np.unique(at, return_counts=True)
            if len(which):
                keys = np.concatenate([known.keys[i] for i in which.tolist()])
                held.append(np.stack([keys, np.repeat(times, known.n[which, 4])], 1))
            if sum(map(len, held)) > FLUSH:
                keys, n = added(held)
                held = [np.stack([keys, n], 1)]
                if len(keys) > FLUSH // 2:
                    yield pa.RecordBatch.from_pydict({"key": keys, "n": n})
                    held = []
        if held:
            keys, n = added(held)
            yield pa.RecordBatch.from_pydict({"key": keys, "n": n})

    counted = docs.select("text").mapInArrow(run, "key bigint, n bigint")
    salted = counted.groupBy("key", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("key").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """(key, n, best): whether no pair of the same B id has a higher count."""
    b = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return counts.withColumn("b", b).join(top, "b").select("key", "n", (F.col("n") == F.col("top")).alias("best"))


FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _described(docs: DataFrame, path_a: str, path_b: str, links: str, table, pairs: bool) -> DataFrame:
    """Each row with its numbers; ``pairs`` gives the ids and counts of its distinct links as well, for a join."""
    spark = docs.sparkSession
    shared, name = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _chunks(path_a, path_b, links, shared.value, name)
        plain = Chunks(known.pair, links, None) if pairs else None
        for batch in slices(batches):
            flat, ends = _cut(batch["text"].to_pylist())
            at = known.look(flat)
            sums = _sums(known.n[at], ends)
            begin = np.r_[0, ends[:-1]]
            right = (sums[:, 0] == ends - begin) & (ends > begin)
            sums[~right] = 0
            digest = [hashlib.sha256(b";".join([known.text[k] for k in at[i:j].tolist()])).hexdigest() if ok else "" for i, j, ok in zip(begin.tolist(), ends.tolist(), right.tolist(), strict=True)]
            out = {c: batch[c] for c in batch.schema.names if c != "text"} | dict(zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), sums[:, 1:].T.copy(), strict=True)) | {"groups_sha256": pa.array(digest, pa.string())}
            if plain is not None:
                at = plain.look(flat)
                each = [np.unique(np.concatenate([plain.keys[k] for k in at[i:j].tolist()]), return_counts=True) if ok else None for i, j, ok in zip(begin.tolist(), ends.tolist(), right.tolist(), strict=True)]
                out["keys"] = pa.array([x[0] if x else [] for x in each], pa.list_(pa.int64()))
                out["times"] = pa.array([x[1] if x else [] for x in each], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, {FIELDS}" + ", keys array<bigint>, times array<bigint>" * pairs)


def align(docs: DataFrame, path_a: str, path_b: str, links: str = "end", salts: int = SALTS, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``links`` is ``end`` (tokens whose bytes end together) or ``group`` (all pairs of a group between common cuts).
    Texts that are null or empty, or that either tokenizer does not give back byte for byte, have zeros and an empty
    digest.  Rows that repeat a doc_id count each for itself; a null doc_id is kept; columns other than doc_id and text
    are ignored; an empty table gives no rows.  Counts that tie for the highest of a B id are all the highest.

    Texts are read twice and never shuffled.  Up to ``broadcast_pairs`` distinct id pairs go to the tasks, which look
    them up; beyond that number a document's distinct pairs are joined with the counts.
    """
    docs = docs.select("doc_id", "text")
    counts = cut(with_best(cut(pair_counts(docs, path_a, path_b, links, salts))))
    if 0 < counts.count() <= broadcast_pairs:
        rows = counts.orderBy("key").toArrow()
        table = tuple(rows[c].to_numpy() for c in ("key", "n", "best"))
        return _described(docs, path_a, path_b, links, (table[0], table[1], table[2].astype(np.float64)), False)
    none = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1))
    return _joined(docs, counts, path_a, path_b, links, none)


def _joined(docs: DataFrame, counts: DataFrame, path_a: str, path_b: str, links: str, none) -> DataFrame:
    """The same by a join on id pairs; rows are told apart by a number of this one plan, and a hot pair is looked up by broadcast."""
    rows = cut(_described(docs.withColumn("row", F.monotonically_increasing_id()), path_a, path_b, links, none, True))
    each = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    hot = F.broadcast(counts.orderBy(F.desc("n"), "key").limit(1000).select("key", F.struct("n", "best").alias("hot")))
    each = each.join(hot, "key", "left")
    near = each.where("hot is not null").select("row", "times", "hot.n", "hot.best")
    far = each.where("hot is null").select("row", "key", "times").join(counts, "key").select("row", "times", "n", "best")
    sums = near.unionByName(far).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("found"), F.sum(F.col("times") * F.col("n")).alias("total"))
    out = rows.drop("keys", "times", "n_best", "count_sum").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("found", F.lit(0)).cast("long").alias("n_best"), F.coalesce("total", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
