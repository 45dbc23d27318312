"""Vector columns: products, unit length, and the offline bag-of-words embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
LONG_WORD = r"([\p{L}\p{N}_]{3,})"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    divided = lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
    return F.transform(F.array(norm(v)), divided)[0]  # the norm is worked out once


def bucket(word: Column) -> Column:
    """md5 of the first five letters, modulo 256: its last byte."""
    return F.conv(F.right(F.md5(F.substring(word, 1, 5)), F.lit(2)), 16, 10).cast("int")


def bag_of_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, n): the embedding in long form.  Words of fewer than three letters do not count; without any, bucket 0 is 1.

    Buckets are counted within the task before anything is shuffled: at most 256 rows a document are.
    """
    long = F.regexp_extract_all(F.lower(F.col(text)), F.lit(LONG_WORD), F.lit(1))
    rows = docs.select(key, F.explode(F.when(F.size(long) > 0, long).otherwise(F.array(F.lit(None).cast("string")))).alias("word"))
    rows = rows.select(key, F.when(F.col("word").isNull(), 0).otherwise(bucket(F.col("word"))).alias("bucket"))
    return rows.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))


def bags(texts: Iterable[str | None]) -> list[np.ndarray]:
    """The unit vectors of texts, in Python."""
    out = []
    for t in texts:
        words = _LONG.findall(t.lower()) if t else []
        n = np.bincount([_buckets[w[:5]] for w in words] or [0], minlength=BUCKETS).astype(float)
        out.append(n / np.sqrt((n * n).sum()))
    return out


def _bags(texts: pd.Series) -> pd.Series:
    return pd.Series(bags(texts), dtype=object)


class _Buckets(dict):
    """Beginning of a word -> its bucket, of as many as fit; a worker keeps them from batch to batch."""

    def __missing__(self, word: str) -> int:
        found = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[-1]
        if len(self) < 100_000:
            self[word] = found
        return found


_LONG, _buckets = re.compile(r"\w{3,}"), _Buckets()


def bag_vector(text: Column) -> Column:
    """The same embedding as a dense unit vector, without a shuffle: words are counted in Arrow batches, which takes a tenth of
    the time that array functions over 256 buckets do.  A null text is an empty one."""
    return F.pandas_udf(_bags, "array<double>")(text)
