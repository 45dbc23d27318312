"""Queries over paged documents, layered configurations and crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.written import cut
from ..operators import chunking, crawling, pages, parsing
from .catalog import fixed_sql, query, table


def _pages(spark, sf_dir):
    """Each document as pages with a header, a numbered heading, a third of its text, broken words and lines, and a footer; every
    fourth has two pages, too few to tell its headers, and every fifth but those a page without text at its end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("body"))
    many = F.when(F.col("doc_id") % 4 == 0, 2).otherwise(F.when(F.col("doc_id") % 5 == 0, 4).otherwise(3))
    rows = docs.withColumn("page", F.explode(F.sequence(F.lit(1), many))).withColumn("third", F.floor(F.length("body") / 3).cast("int"))
    part = F.expr("substring(body, (page - 1) * third + 1, case when page = 3 then length(body) else third end)")
    number = F.col("page").cast("string")
    level = F.when(F.col("page") == 3, "2.1 Sub").otherwise(F.concat(number, F.element_at(F.array(F.lit(" Alpha"), F.lit(" Beta"), F.lit(""), F.lit("")), F.col("page"))))
    text = F.concat(F.lit("  The HANDBOOK of "), F.col("doc_id").cast("string"), F.lit("\n"), level, F.lit("\nB: "), part, F.lit(" wrap-\nped and\nsoft.\nEnd "), F.chr(F.col("page") + 64), F.lit(".\n\nPage "), number, F.lit("\n"))
    return rows.select("doc_id", "page", F.when(F.col("page") < 4, text).otherwise(" ").alias("text"))


PAGED = r"""with b as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as body from documents),
p as (select doc_id, page::int as page, doc_id % 4 = 0 as short, substr(body, (page - 1) * (length(body) // 3) + 1, case when page = 3 then length(body) else length(body) // 3 end) as part,
    case page when 3 then '2.1 Sub' when 2 then '2 Beta' else '1 Alpha' end as head from b, range(1, 4) r(page) where page < 3 or doc_id % 4 <> 0),
u as (select doc_id, page, 1 as place, coalesce(case page when 2 then '1 Alpha' end, '') as section, 'The HANDBOOK of ' || doc_id as text from p where short
    union all select doc_id, page, 2, case page when 3 then '2 Beta › 2.1 Sub' else head end, head || chr(10) || 'B: ' || part || ' wrapped and soft.' || chr(10) || 'End ' || chr(64 + page) || '.' || case when short then chr(10) || chr(10) || 'Page ' || page else '' end from p)"""


@query(f"{PAGED} select doc_id, row_number() over (partition by doc_id order by page, place)::int as unit, page, section, text from u")
def paged_units(spark, sf_dir):
    return pages.paged_units(_pages(spark, sf_dir))


@query(f"{PAGED} select doc_id, case when doc_id % 4 = 0 then 2 when doc_id % 5 = 0 then 4 else 3 end::bigint as pages, count(*) as units, '1 Alpha' as title, null::varchar as error from u group by doc_id")
def paged_outcomes(spark, sf_dir):
    rows = _pages(spark, sf_dir)
    return pages.paged_outcomes(rows, pages.paged_units(rows))


LAYERED = """(select doc_id, text, case when doc_id % 10 = 0 then 100 when source = 'src1' then 150 when lang = 'en' then 200 else 400 end as tokens, case when doc_id % 10 = 0 then 50 when lang = 'en' then 30 else 0 end as lap_tokens
from documents where doc_id % 17 <> 0)"""


@query(fixed_sql(LAYERED, "tokens", "lap_tokens"))
def chunk_layered(spark, sf_dir):
    """Languages as collections, sources, and documents with settings of their own: one plan with many configurations.  Every
    seventeenth document has settings that are no such thing, and so no chunks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("source", F.lit("none")).alias("source_id"), F.coalesce("lang", F.lit("")).alias("collection"), "text")
    own = F.when(F.col("document_id") % 17 == 0, '{"chunk_size_tokens": true}').when(F.col("document_id") % 10 == 0, '{"chunk_size_tokens": 100, "chunk_overlap_tokens": 50}').when(F.col("document_id") % 3 == 0, '{"chunk_size_tokens": null}')
    sources = docs.select("source_id").distinct().withColumn("settings", F.when(F.col("source_id") == "src1", '{"chunk_size_tokens": 150}'))
    size = F.when(F.col("collection") == "en", '{"method": "fixed", "chunk_size_tokens": 200, "chunk_overlap_tokens": 30}').otherwise('{"method": "fixed", "chunk_size_tokens": 400, "chunk_overlap_tokens": 0}')
    rows = chunking.effective(docs.withColumn("settings", own), sources, docs.select("collection").distinct().withColumn("settings", size)).where("chunking_error is null")
    units = rows.select(F.col("document_id").alias("doc_id"), F.lit(0).alias("unit"), "text", "chunking")
    return chunking.chunk_units(units).select("doc_id", "seq", "char_start", "char_end", "tokens", "text")


def _linked_pages(spark, sf_dir):
    """The pages with a section of links at their end: to three other pages by number, to one that is not there, and to another host."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    n, own = F.lit(p.count()), lambda x: F.concat(F.lit("https://site.example/p/"), x.cast("string"))
    to = lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>'))
    i = F.col("page_id")
    more = F.concat(F.lit("<section>"), to(F.concat(own((i * 7 + 3) % n), F.lit("#top"))), to(F.concat(F.lit("/gone/"), i.cast("string"))), to(own((i * 3 + 1) % n)), to(F.lit("https://other.example/p/1")), to(own((i + 2) % n)), F.lit("</section>"))
    return p.select("page_id", own(i).alias("url"), F.concat("html", more).alias("html"))


CRAWL = """with n as (select count(*) as n from pages),
l as (select page_id as src, pos, case pos when 0 then (page_id * 7 + 3) % n when 1 then -1 - page_id when 2 then (page_id * 3 + 1) % n else (page_id + 2) % n end as dst from pages, n, range(0, 4) r(pos)
    where not (case pos when 0 then (page_id * 7 + 3) % n when 2 then (page_id * 3 + 1) % n when 3 then (page_id + 2) % n else 0 end)::varchar like '%9'),
d0 as (select 0::bigint as id, 1::bigint as rank, 0 as depth),
"""
_LEVEL = """d{0} as (select dst as id, row_number() over (order by min(rank * 10 + pos)) as rank, {0} as depth from l join d{1} on src = id where id >= 0 and id % 6 <> 5 and dst not in ({2}) group by dst),
"""
CRAWL += "".join(_LEVEL.format(d, d - 1, " union ".join(f"select id from d{k}" for k in range(d))) for d in (1, 2, 3))
CRAWL += """a as (select *, row_number() over (order by depth, rank) as place, (id >= 0 and id % 6 <> 5) as fetched from (select * from d0 union all select * from d1 union all select * from d2 union all select * from d3)),
b as (select *, sum(fetched::int) over (order by place) - fetched::int as before from a)
select case when id >= 0 then 'https://site.example/p/' || id else 'https://site.example/gone/' || (-1 - id) end as url, depth, place, fetched from b where before < 25"""


@query(CRAWL)
def crawl_pages(spark, sf_dir):
    """From page 0 over the links that the pages' HTML holds, three deep, until 25 pages are fetched; every sixth page fails, and
    pages whose number ends with 9 are masked out."""
    pages_ = _linked_pages(spark, sf_dir)
    parsed = parsing.html_pages(pages_).select("page_id", F.posexplode("links").alias("at", "dst"))
    links = pages_.select("page_id", F.col("url").alias("src")).join(parsed, "page_id")
    ok = pages_.select("url", (F.col("page_id") % 6 != 5).alias("ok"))
    links = cut(links.select("src", "dst", "at"))  # every depth meets them, and pages are parsed once
    return crawling.crawl("https://site.example/p/0", ok, links, 3, 25, exclude=["https://site.example/p/*9"])


LINKS = "with recursive l as (select page_id as src, (page_id * 7 + 3) % (select count(*) from pages) as dst from pages union select page_id, (page_id * 3 + 1) % (select count(*) from pages) from pages)"


@query(f"""{LINKS}, w as (select 0::bigint as url, 0 as depth union select dst, depth + 1 from w join l on src = url where depth < 3) select url, min(depth)::int as depth from w group by url""")
def crawl_bfs(spark, sf_dir):
    """Every page can be fetched, and the budget is above their number."""
    p = table(spark, sf_dir, "pages").select("page_id")
    many = p.count()
    n, name = F.lit(many), lambda x: x.cast("string")
    links = p.select(name(F.col("page_id")).alias("src"), F.posexplode(F.array(name((F.col("page_id") * 7 + 3) % n), name((F.col("page_id") * 3 + 1) % n))).alias("at", "dst"))
    found = crawling.crawl("0", p.select(name(F.col("page_id")).alias("url"), F.lit(True).alias("ok")), links, 3, many + 1, same_host=False)
    return found.select(F.col("url").cast("bigint").alias("url"), "depth")
