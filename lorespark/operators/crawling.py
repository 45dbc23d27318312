"""A crawl over links, breadth first, with a budget of pages that were fetched.

Each depth is one round: its pages in the order in which they were discovered, and what they lead to.  The order is a
number, worked out within blocks of ranks and from the blocks' sums, so no depth is sorted as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches_mask
from ..functions.written import cut

#: Ranks of one block; the sums of all blocks of a depth meet in one window.
BLOCK = 1024


def running(rows: DataFrame, block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one by (block, order)."""
    rows = rows.withColumn("block", block)
    sums = rows.groupBy("block").agg(F.sum(value).alias("all"))
    offsets = sums.select("block", (F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("offset"))
    own = F.sum(value).over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(own, F.lit(0))).join(offsets, "block").withColumn(name, (F.col(name) + F.col("offset")).cast("bigint")).drop("block", "offset")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether masks let an address in: none of ``exclude``, and one of ``include`` if there are any; masks meet the whole address."""
    any_of = lambda masks: reduce(lambda a, b: a | b, [matches_mask(url, m) for m in masks], F.lit(False))
    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))


def crawl(start: str, pages: DataFrame, links: DataFrame, depth: int, max_pages: int, same_host: bool = True, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """url, depth, place, fetched: the pages that were asked for, numbered from 1 in the order of asking.

    ``pages`` (url, ok) says which can be fetched; a page that is not there fails like one that is not ok.  ``links`` (src,
    dst, at) has a page's links with their places; fragments are cut off.  Only pages that were fetched count towards
    ``max_pages`` and lead further, down to ``depth``.  An address is asked for once, where it was discovered first.  Links to
    other hosts than the start's are left out if ``same_host``, and those that the masks keep out; the start itself is not
    held against masks.  If the start fails there is nothing to crawl, and that is an error.
    """
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    spark, start = pages.sparkSession, start.partition("#")[0]
    known = pages.groupBy(bare("url").alias("url")).agg(F.max("ok").alias("ok"))
    links = links.select(bare("src").alias("src"), bare("dst").alias("dst"), "at").where(F.col("dst").isNotNull() & allowed(F.col("dst"), list(include), list(exclude)))
    if same_host:
        links = links.where(host(F.col("dst")) == host(F.lit(start)))
    frontier = spark.createDataFrame([(start, 1)], "url string, rank bigint")
    seen, out, asked, fetched = frontier.select("url"), [], 0, 0
    for d in range(depth + 1):
        here = frontier.join(known, "url", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        block = F.floor((F.col("rank") - 1) / BLOCK)
        here = running(here, block, ["rank"], F.col("ok").cast("int"), "before").where(F.col("before") + fetched < max_pages)
        here = cut(here.select("url", F.lit(d).alias("depth"), "rank", "ok"))
        n, good = here.agg(F.count(F.lit(1)), F.count_if("ok")).first()
        if d == 0 and not good:
            raise ValueError(f"{start} could not be fetched")
        out.append(here.select("url", "depth", (F.col("rank") + asked).alias("place"), F.col("ok").alias("fetched")))
        asked, fetched = asked + n, fetched + good
        if d == depth or fetched >= max_pages:
            break
        found = here.where("ok").select(F.col("url").alias("src"), F.col("rank").alias("parent")).join(links, "src").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("parent", "at")).alias("first"))
        found = cut(found.join(seen, "url", "left_anti").select("url", "first.parent", "first.at"))
        if found.isEmpty():
            break
        block = F.floor((F.col("parent") - 1) / BLOCK)
        frontier = running(found, block, ["parent", "at", "url"], F.lit(1), "before").select("url", (F.col("before") + 1).alias("rank"))
        seen = seen.unionByName(found.select("url"))
    return reduce(DataFrame.unionByName, out)
