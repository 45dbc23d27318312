"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS, SHARE, MAX_EPOCHS, SEED, BUCKETS = (3.0, 1.0, 2.0), 1.5, 2.0, 42, 4096


def words(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows of (source_size, weight).

    Clamping at ``max_epochs`` times a source's size and resharing the excess by weight until nothing is above ends at
    one water level: every target is the smaller of its cap and level x weight.  Sources fill up in order of cap/weight,
    so running sums over the table of sources find the level.  A source without words or weight gets 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    live = sources.withColumn("cap", cap).withColumn("full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    order = Window.orderBy(F.col("full_at").asc_nulls_last(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    free = live.withColumn("level", F.when(level <= F.col("full_at"), level))
    first = F.min_by("level", F.when(F.col("level").isNotNull(), F.struct("full_at", F.col("source").isNull(), "source"))).over(Window.partitionBy())
    return free.withColumn("level", first).withColumn(
        "target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.when(F.col("weight") > 0, F.col("cap")), F.lit(0.0))
    ).drop("cap", "full_at", "level")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies x size).

    ``weights`` are dealt to the sources in code-point order, null last, repeating; targets share ``share`` times all
    words.  A source with target r x its size gives each document floor(r) times, and once more those first in a seeded
    order, until the remaining fraction is reached: the document that would go beyond it is taken if that comes nearer.
    So a source misses its target by half a document at most, and reruns agree.  Null or blank texts have size 0 and take
    nothing; null doc_ids come last in ties.  The order is dealt into ``buckets`` by hash, and only the bucket in which
    the threshold lies is ordered row by row, so that no task gets a whole source.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), "doc_id")).alias("luck"))
    sized = cut(sized.withColumn("bucket", F.floor(F.conv(F.substr("luck", F.lit(1), F.lit(6)), 16, 10).cast("long") * buckets / 16**6).cast("int")))
    cells = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1)).withColumn("total", total)
    plan = water_fill(sources, F.col("total"), max_epochs).select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    cells = cells.withColumn("upto", upto).join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", F.col("bucket").alias("b"), "source_size", "target", "whole", "extra", (F.col("upto") - F.col("words")).alias("before"), "upto"
    )
    joined = sized.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    edge = (F.col("upto") > F.col("extra")) & (F.col("before") < F.col("extra"))
    kept = ["doc_id", "source", "size", "source_size", "target", "whole"]
    sure = joined.where(~edge).select(*kept, (F.col("upto") <= F.col("extra")).cast("long").alias("once_more"))
    run = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("luck", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    near = joined.where(edge).withColumn("run", run).select(*kept, (F.col("run") - F.col("size") / 2 <= F.col("extra")).cast("long").alias("once_more"))
    return sure.unionByName(near).withColumn("copies", F.col("whole") + F.col("once_more")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


#: DuckDB's statement of :func:`mix` with these weights: the same order by md5, one running sum per source.
ORACLE = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                  md5('42:' || doc_id) as luck from documents),
s as (select source, cast(sum(size) as bigint) as source_size, sum(sum(size)) over () * 1.5 as total,
             [3.0, 1.0, 2.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)]::double as weight from d group by source),
f as (select *, source_size * 2.0 as cap, source_size * 2.0 / weight as full_at from s),
l as (select *, (total - coalesce(sum(cap) over (order by full_at, source rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by full_at, source rows between current row and unbounded following) as level from f),
t as (select source, source_size, least(cap, (select level from l where level <= full_at order by full_at, source limit 1) * weight)::double as target from l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
r as (select d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as extra,
             sum(size) over (partition by d.source order by luck, doc_id nulls last, size rows between unbounded preceding and current row) as run
      from d join p on d.source is not distinct from p.source)
select doc_id, source, size, source_size, target, cast(whole + (extra > 0 and run - size / 2.0 <= extra)::int as bigint) as copies,
       cast((whole + (extra > 0 and run - size / 2.0 <= extra)::int) * size as bigint) as taken from r
"""


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with the columns of ``docs``; doc_ids are unique in both."""
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("mixed_id"), F.col("copies").cast("int").alias("mixed_copies"))
    back = docs.join(taken, docs["doc_id"] == F.col("mixed_id"))
    return back.withColumn("mixed_turn", F.explode(F.sequence(F.lit(1), F.col("mixed_copies")))).select(*[docs[c] for c in docs.columns])
