"""Parsers from text to units (section, text).  Markdown is read with windows in the JVM; HTML becomes a list of
events by a small row-local helper, and windows over the events tell blocks, headings and what is skipped."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.properties import property_value
from ..functions.text import clean

SEPARATOR = " › "


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, line; null texts are one empty line, CR and CRLF end lines as LF does."""
    return docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")).alias("at", "line"))


def joined_lines() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")


def headed_units(lines: DataFrame, key: str) -> DataFrame:
    """key, unit, section, text from (key, at, line, level, title); level 0 is no heading.

    A unit begins at each heading of level 1 to 3; section is the path of headings, and a heading resets those below it.
    """
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    for n in (1, 2, 3):
        here = F.col("level") == n
        lines = lines.withColumn(f"h{n}", F.last(F.when(here, F.col("title")), True).over(w)).withColumn(f"p{n}", F.last(F.when(here, F.col("at")), True).over(w))
    second = F.when(F.col("p2") > F.coalesce("p1", F.lit(-1)), F.col("h2"))
    third = F.when(F.col("p3") > F.greatest(F.coalesce("p1", F.lit(-1)), F.coalesce("p2", F.lit(-1))), F.col("h3"))
    lines = lines.withColumn("section", F.concat_ws(SEPARATOR, "h1", second, third)).withColumn("unit", F.sum(F.col("level").between(1, 3).cast("int")).over(w))
    units = lines.groupBy(key, "unit", "section").agg(joined_lines().alias("text"))
    units = units.withColumn("text", F.regexp_replace(F.regexp_replace("text", "\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
    return units.where("text <> ''").select(key, F.col("unit").cast("int").alias("unit"), "section", "text")


def markdown_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Units of Markdown (see :func:`headed_units`): headings are marked or underlined and stand outside fences.

    Lines are numbered, and fences and headings are running counts over a document.
    """
    lines = numbered_lines(docs, key, text)
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("fenced", F.sum(fence.cast("int")).over(w) % 2 == 1).withColumn("mark", F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)))
    after = F.trim(F.lead("line").over(Window.partitionBy(key).orderBy("at")))
    plain = (F.trim("line") != "") & ~F.col("line").rlike(r"^[ \t\-*>|#=]") & ~fence
    setext = F.when(plain & after.rlike("^=+$"), 1).when(plain & after.rlike("^-{3,}$"), 2).otherwise(0)
    lines = lines.withColumn("level", F.when(F.col("fenced") | fence, 0).when(F.col("mark") > 0, F.col("mark")).otherwise(setext))
    ruled = F.lag("level").over(Window.partitionBy(key).orderBy("at"))
    lines = lines.withColumn("ruled", (F.coalesce(ruled, F.lit(0)) > 0) & F.trim("line").rlike("^[=-]+$") & (F.col("level") == 0)).where("not ruled")
    return headed_units(lines.withColumn("title", F.trim(F.regexp_replace("line", r"^\s*#{1,6}\s+|\s+#+\s*$", ""))), key)


#: Properties of front matter with a column of their own, and how many lines it may have.
TITLE, DATES, FRONT_LINES = "title", ("date", "updated", "last_modified"), 60


def front_matter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, title, doc_date, properties, text without the front matter.

    Front matter stands between a first line `---` and the next `---` or `...` of the first lines.  Only entries of one line
    count; quotes around values and the brackets of lists go, of two entries with one name the later holds, and properties are
    normalised (see :func:`..functions.properties.property_value`).  Without
    front matter title and date are null and the properties empty; a null text is an empty one.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    rows = docs.select(key, lines.alias("lines"))
    ends = F.transform(F.slice("lines", 2, FRONT_LINES - 1), lambda x: F.trim(x).isin("---", "..."))
    rows = rows.withColumn("end", F.when(F.trim(F.col("lines")[0]) == "---", F.array_position(ends, True)).otherwise(0).cast("int"))
    given = F.slice("lines", F.lit(2), F.greatest(F.col("end") - 1, F.lit(0)))
    entry = r"(?U)^([\w.][\w.-]{0,39})\s*:\s*['\"]*(.*?)['\"]*\s*$"
    pairs = F.transform(given, lambda x: F.struct(F.regexp_extract(x, entry, 1).alias("name"), F.regexp_extract(x, entry, 2).alias("value")))
    rows = rows.withColumn("pairs", F.filter(pairs, lambda x: (x["name"] != "") & (x["value"] != "")))
    last = lambda *names: F.try_element_at(F.filter("pairs", lambda x: F.lower(x["name"]).isin(*names)), F.lit(-1))["value"]
    others = F.filter("pairs", lambda x: ~F.lower(x["name"]).isin(TITLE, *DATES))
    rows = rows.withColumn("others", F.transform(others, lambda x: x.withField("value", F.regexp_replace(x["value"], r"^\[+|\]+$", ""))))
    rest = lambda i: F.slice("others", i + 2, F.size("others"))
    held = F.filter("others", lambda x, i: ~F.exists(rest(i), lambda y: y["name"] == x["name"]))
    held = F.filter(F.transform(held, lambda x: x.withField("value", property_value(x["value"]))), lambda x: x["value"].isNotNull())
    body = F.array_join(F.slice("lines", F.when(F.col("end") > 0, F.col("end") + 2).otherwise(1), F.size("lines")), "\n")
    return rows.select(key, last(TITLE).alias("title"), F.substring(last(*DATES), 1, 10).alias("doc_date"), F.map_from_entries(held).alias("properties"), body.alias("text"))


def plain_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, unit, section, text: the whole clean text as one unit; blank and null texts have none."""
    rows = docs.select(key, F.lit(1).alias("unit"), F.lit("").alias("section"), clean(F.col(text)).alias("text"))
    return rows.where("text <> ''")


def rst_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Units of reStructuredText (see :func:`headed_units`): a heading is underlined, or ruled above and below, by one
    repeated sign at least as long as itself.

    Each pair of sign and kind of rule is a style; a style's level is its place in order of first appearance.  Rules are
    left out of the text, and a rule is never a heading itself.
    """
    w = Window.partitionBy(key).orderBy("at")
    lines = numbered_lines(docs, key, text).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    lines = lines.withColumn("rule", F.col("line").rlike(r"""^([-=`:'"~^_*+#<>])\1{2,}$"""))
    said = (F.trim("line") != "") & ~F.col("rule")
    flush = said & ~F.col("line").rlike(r"^\s")
    under = F.lead("rule").over(w) & (F.length(F.lead("line").over(w)) >= F.length(F.trim("line")))
    sign = F.substring(F.lead("line").over(w), 1, 1)
    lines = lines.withColumn("ends", flush & F.coalesce(under, F.lit(False)))
    # A rule that already underlines the line before it opens nothing.
    opened = F.lag("rule").over(w) & ~F.coalesce(F.lag("ends", 2).over(w), F.lit(False)) & (F.substring(F.lag("line").over(w), 1, 1) == sign)
    boxed = said & F.coalesce(under & opened, F.lit(False))
    style = F.when(boxed, F.concat(sign, F.lit("over"))).when(F.col("ends"), sign)
    lines = lines.withColumn("boxed", boxed).withColumn("style", style)
    since = F.min("at").over(Window.partitionBy(key, "style"))
    lines = lines.withColumn("since", F.when(F.col("style").isNotNull(), since)).withColumn("heads", F.col("style").isNotNull())
    level = F.dense_rank().over(Window.partitionBy(key, "heads").orderBy("since"))
    lines = lines.withColumn("level", F.when(F.col("heads"), level).otherwise(0))
    used = F.col("rule") & (F.coalesce(F.lag("heads").over(w), F.lit(False)) | F.coalesce(F.lead("boxed").over(w), F.lit(False)))
    lines = lines.withColumn("used", used).where("not used").withColumn("title", F.trim("line"))
    return headed_units(lines.withColumn("line", F.when(F.col("heads"), F.col("title")).otherwise(F.col("line"))), key)


#: Elements whose text is left out, that end a block, what some stand for, and the properties that <meta> gives.
SKIPPED = "script style noscript svg template iframe nav footer form button select aside".split()
BLOCKS = "p div br ul ol table section blockquote header dl dt dd figure figcaption hr main article pre h1 h2 h3 h4 h5 h6".split()
SIGNS = {"td": " | ", "th": " | ", "tr": "\n", "li": "\n- "}
META = {
    "description": "description", "og:description": "description", "author": "author", "keywords": "keywords",
    "article:published_time": "published", "article:modified_time": "modified", "og:site_name": "site",
}
MAIN_LEAST = 200
#: Bytes of pages whose events a task holds at a time.
PARSED = 256 << 10
EVENT = "struct<kind:string,tag:string,value:string>"


class Events(HTMLParser):
    """What a page opens, closes and says, in order; what it means is worked out by windows over these rows."""

    def __init__(self, url: str | None):
        super().__init__(convert_charrefs=True)
        self.url, self.seen = url or "", []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        value = {"a": given.get("href"), "html": given.get("lang"), "meta": given.get("content")}.get(tag)
        kind = META.get((given.get("name") or given.get("property") or "").lower(), "") if tag == "meta" else "open"
        if tag == "a" and value:
            value = urldefrag(urljoin(self.url, value.strip()))[0]
        self.seen.append((kind or "open", tag, value))
        if said := "```\n" if tag == "pre" else SIGNS.get(tag):
            self.seen.append(("said", "", said))

    def handle_endtag(self, tag):
        self.seen += [("said", "", "\n```")] * (tag == "pre") + [("close", tag, None)]

    def handle_data(self, data):
        self.seen.append(("said", "", data))


def page_events(pages: DataFrame) -> DataFrame:
    """page_id, at, kind, tag, value, error: a row for each event, and one at least for each page; a page that can't be read gives an error.

    A task parses pages of about PARSED bytes at a time and hands their events on, so what Python holds is a batch of pages as
    it came and those events, however many pages a task has.
    """
    url = F.col("url") if "url" in pages.columns else F.lit("").alias("url")
    events = pages.select("page_id", "html", url).mapInArrow(parsed, f"page_id bigint, events array<{EVENT}>, error string")
    return events.select("page_id", "error", F.posexplode_outer("events").alias("at", "x")).select("page_id", F.coalesce("at", F.lit(0)).alias("at"), "x.*", "error")


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of pages (see :func:`_parsed`), in batches of PARSED bytes of pages, or of one page that has more."""
    for b in batches:
        step = max(1, b.num_rows * PARSED // max(1, b.nbytes))
        yield from (_parsed(b.slice(i, step)) for i in range(0, b.num_rows, step))


def _parsed(pages: pa.RecordBatch) -> pa.RecordBatch:
    """page_id, events, error of each page."""
    seen, ends, errors = [], [0], []
    for html, url in zip(pages["html"].to_pylist(), pages["url"].to_pylist(), strict=True):
        parser, error = Events(url), None
        try:
            parser.feed(html or "")
            parser.close()
        except (ValueError, AssertionError) as e:
            parser.seen, error = [], str(e)
        seen += parser.seen
        ends.append(len(seen))
        errors.append(error)
    fields = [pa.array(list(x), pa.string()) for x in zip(*seen, strict=True)] if seen else [pa.array([], pa.string())] * 3
    events = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["kind", "tag", "value"]))
    return pa.RecordBatch.from_arrays([pages["page_id"], events, pa.array(errors, pa.string())], names=["page_id", "events", "error"])


def _depth(tags: list[str], upto) -> Column:
    """How many of ``tags`` are open; a close without an open counts for nothing."""
    change = F.when(F.col("tag").isin(tags), F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1)).otherwise(0)
    return F.sum(F.coalesce(change, F.lit(0))).over(upto)


def _floored(rows: DataFrame, name: str, tags: list[str], upto) -> DataFrame:
    rows = rows.withColumn(name, _depth(tags, upto))
    return rows.withColumn(name, F.col(name) - F.least(F.lit(0), F.min(name).over(upto)))


def page_blocks(events: DataFrame) -> DataFrame:
    """page_id, block, level, text, inner: the runs of text between the ends of blocks; level 0 is no heading, inner is within main or article.

    What stands in a skipped element is left out.  White space is folded but for line ends, and kept as it is in <pre>.
    """
    upto = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = _floored(events, "skipped", SKIPPED, upto).where(F.col("skipped") == 0).where(~F.coalesce(F.col("tag").isin(SKIPPED), F.lit(False)))
    seen = _floored(_floored(seen, "raw", ["pre"], upto), "inner", ["main", "article"], upto).withColumn("titled", _depth(["title"], upto) > 0)
    head = F.when(F.col("tag").rlike("^h[1-6]$"), F.when(F.col("kind") == "open", F.substring("tag", 2, 1).cast("int")).otherwise(0))
    seen = seen.withColumn("level", F.coalesce(F.last(head, True).over(upto), F.lit(0))).withColumn("block", F.count_if(F.col("tag").isin(BLOCKS)).over(upto))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "")
    blocks = seen.where("kind = 'said' and not titled").groupBy("page_id", "block", "level", F.col("raw") > 0, F.col("inner") > 0).agg(said.alias("text")).toDF("page_id", "block", "level", "raw", "inner", "text")
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[ \\t\\r\\f\\x0B\\xA0]+", " "), " ?\n ?", "\n"), "\n{2,}", "\n")
    text = F.when(F.col("raw"), F.regexp_replace("text", "^\n+|\n+$", "")).otherwise(F.regexp_replace(folded, r"^\s+|\s+$", ""))
    text = F.when(F.col("level") > 0, F.regexp_replace(text, r"\s+", " ")).otherwise(text)
    return blocks.withColumn("text", text).where("text <> ''").select("page_id", "block", "level", "text", "inner")


def main_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of the main part, or all where that has fewer than ``MAIN_LEAST`` characters."""
    of = Window.partitionBy("page_id")
    return blocks.withColumn("main", F.coalesce(F.sum(F.when(F.col("inner"), F.length("text"))).over(of), F.lit(0)) >= MAIN_LEAST).where("inner or not main").drop("main")


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, lang, text (blocks parted by blank lines), links, properties, doc_date, error.

    ``pages`` has page_id, html and perhaps url, against which links are joined; fragments are cut off, and only http and
    https stay.  The title is the page's own or its first heading; the date is that of the last change, else of publication.
    """
    events = page_events(pages)
    upto = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = _floored(events, "skipped", SKIPPED, upto).withColumn("titled", F.coalesce(F.last(F.when((F.col("tag") == "title") & (F.col("skipped") == 0), F.col("kind") == "open"), True).over(upto), F.lit(False)))
    shown, ordered = F.col("skipped") == 0, lambda x: F.transform(F.array_sort(F.collect_list(F.when(x, F.struct("at", "value")))), lambda y: y["value"])
    about = shown & (F.col("tag") == "meta") & (F.col("kind") != "open") & (F.col("value") != "")
    entries = F.array_sort(F.collect_list(F.when(about, F.struct("at", "kind", F.trim("value").alias("value")))))
    last = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["kind"]), F.create_map(x["kind"], x["value"])))
    link = shown & (F.col("tag") == "a") & F.col("value").rlike("^https?:")
    heads = seen.groupBy("page_id").agg(
        F.trim(F.regexp_replace(F.array_join(ordered(F.col("titled") & (F.col("kind") == "said")), ""), r"\s+", " ")).alias("own"),
        F.max_by("value", F.when(shown & (F.col("tag") == "html") & (F.col("value") != ""), F.col("at"))).alias("lang"),
        ordered(link).alias("links"), last.alias("properties"), F.max("error").alias("error"),
    )
    blocks = main_blocks(page_blocks(events))
    texts = blocks.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.min_by("text", F.when(F.col("level") == 1, F.col("block"))).alias("first")
    )
    date = lambda k: F.nullif(F.regexp_extract(F.col("properties")[k], r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return heads.join(texts, "page_id", "left").select(
        "page_id", F.coalesce(F.nullif("own", F.lit("")), "first", F.lit("")).alias("title"), "lang", F.coalesce("text", F.lit("")).alias("text"), "links", "properties", F.coalesce(date("modified"), date("published")).alias("doc_date"), "error",
    )


def html_units(pages: DataFrame) -> DataFrame:
    """page_id, unit, section, text (see :func:`headed_units`): a line for each block, and a blank one behind what is no heading."""
    blocks = main_blocks(page_blocks(page_events(pages)))
    line = F.when(F.col("level") > 0, F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    return headed_units(blocks.select("page_id", F.col("block").alias("at"), line.alias("line"), "level", F.col("text").alias("title")), "page_id")


def json_units(rows: DataFrame, record: str, id_path: str, fields: list[str]) -> DataFrame:
    """One atomic unit a JSON record: section, text of ``field: value`` lines for what is there, unreadable lines left out."""
    part = [F.when(F.get_json_object(record, f"$.{f}") != "", F.concat(F.lit(f"{f}: "), F.trim(F.get_json_object(record, f"$.{f}")))) for f in fields]
    out = rows.where(F.get_json_object(record, "$").isNotNull())
    return out.withColumn("section", F.concat(F.lit("Запись "), F.get_json_object(record, f"$.{id_path}"))).withColumn("unit_text", F.concat_ws("\n", *part)).where("unit_text <> ''")
