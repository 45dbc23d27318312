"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that the contracts count as such.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a local session (tests) takes a temporary
    one, and a cluster, whose executors could not share it, is told to name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def slices(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``most`` bytes, so that a task's Python objects stay few; a row is never split."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def in_fold(key: Column, folds: int, held: int) -> Column:
    """Whether crc32 of the key's text falls into the held-out fold; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == held, F.lit(False))


def smallest_hashes(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of ``ids``, by smallest seeded hash of doc_id: a repeatable uniform sample."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of a bounded id table (see :func:`smallest_hashes`); the bound makes the broadcast safe, so no text is shuffled."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
