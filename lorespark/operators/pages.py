"""Text of paged documents, as a PDF's text layer gives it, to units: (document, page, text) rows, no PDF library.

Lines are rows with numbers.  What repeats at the edges of a document's pages is counted over its pages by shape; headings,
pages and sections are running values over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean
from .parsing import SEPARATOR, joined_lines

#: A numbered heading (its number first) and what it does not end with; signs after which a line break stays, and
#: what the next line begins with if the break is a soft one.
HEADING, NO_HEADING = r"^(\d{1,2}(?:\.\d{1,2}){0,2})\.?\s+[A-ZА-ЯЁ].{2,90}$", r"[.,;]$"
HARD, GOES_ON = ".!?:;", 'a-zа-яё(«"'
#: Lines looked at from either end of a page, the pages that a document has at least for that and the share on
#: which a shape stands, and the characters under which a document counts as scanned.
EDGE, LEAST_PAGES, SHARE, LEAST_TEXT = 2, 3, 0.5, 20
SCANNED = "no text layer: text recognition is needed"


def shape(line: Column) -> Column:
    """Lines that differ in case and numbers only have one shape."""
    return F.regexp_replace(F.lower(F.trim(line)), r"\p{Nd}+", "#")


def page_lines(pages: DataFrame, key: str) -> DataFrame:
    """key, page, at, line, edge: ``edge`` marks the first and last EDGE lines of a page that are not blank."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "\n")
    lines = pages.select(key, "page", F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("said", F.col("line").rlike(r"(?U)\S"))
    own = Window.partitionBy(key, "page", "said")
    near = F.least(F.row_number().over(own.orderBy("at")), F.row_number().over(own.orderBy(F.desc("at")))) <= EDGE
    return lines.select(key, "page", "at", "line", (F.col("said") & near).alias("edge"))


def running_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, shape) of headers and footers: shapes at the edges of half of the pages of a document of three or more.

    Pages of one document are counted within the task first; a shape counts once for each page.
    """
    many = lines.groupBy(key).agg(F.countDistinct("page").alias("pages"))
    found = lines.where("edge").groupBy(key, shape(F.col("line")).alias("shape")).agg(F.countDistinct("page").alias("n"))
    return found.join(many, key).where((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= F.greatest(F.lit(2.0), F.col("pages") * SHARE))).select(key, "shape")


def mended(text: Column) -> Column:
    """Words parted by a hyphen at the line's end become one, and soft line breaks blanks."""
    text = F.regexp_replace(text, r"([\p{L}\p{N}_])-\n(?=[\p{L}\p{N}_])", "$1")
    return F.regexp_replace(text, rf"(?<![{HARD}])\n(?=[{GOES_ON}])", " ")


def paged_units(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, unit, page, section, text of ``pages`` (key, page, text): a unit begins at each numbered heading and each page.

    Headers and footers are left out, and the section is the path of headings down to the third level.  Pages are numbered
    from their own column, gaps and all; null texts are empty pages.  Documents of fewer than LEAST_TEXT characters have no
    units (see :func:`paged_outcomes`).  Rows must be unique by key and page.
    """
    lines = page_lines(pages, key)
    lines = lines.withColumn("shape", F.when(F.col("edge"), shape(F.col("line"))))
    kept = lines.join(running_lines(lines, key), [key, "shape"], "left_anti")
    texts = kept.groupBy(key, "page").agg(joined_lines().alias("text"))
    lines = texts.select(key, "page", F.posexplode(F.split(mended(F.col("text")), "\n")).alias("at", "line"))
    bare = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    number = F.when(~bare.rlike(NO_HEADING), F.nullif(F.regexp_extract(bare, HEADING, 1), F.lit("")))
    level = F.when(number.isNotNull(), F.least(F.lit(3), F.size(F.split(number, r"\."))))
    lines = lines.withColumn("level", level).withColumn("title", F.when(number.isNotNull(), bare)).withColumn("line", F.coalesce("title", "line"))
    w = Window.partitionBy(key).orderBy("page", "at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("page", "at")
    for n in (1, 2, 3):
        lines = lines.withColumn(f"h{n}", F.last(F.when(F.col("level") == n, F.struct(place.alias("place"), "title")), True).over(upto))
    behind = lambda n, *above: [F.col(f"h{n}.place") > F.col(f"h{a}.place") for a in above]
    shown = F.col("h1.title"), F.when(F.coalesce(*behind(2, 1), F.lit(True)), F.col("h2.title")), F.when(F.coalesce(*behind(3, 1), F.lit(True)) & F.coalesce(*behind(3, 2), F.lit(True)), F.col("h3.title"))
    lines = lines.withColumn("section", F.concat_ws(SEPARATOR, *shown))
    opens = F.col("level").isNotNull() | F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True))
    lines = lines.withColumn("part", F.sum(opens.cast("int")).over(upto))
    units = lines.groupBy(key, "part").agg(F.first("page").alias("page"), F.first("section").alias("section"), joined_lines().alias("text"))
    units = units.withColumn("text", clean(F.col("text"))).where("text <> ''").join(_read(pages, key), key, "left_semi")
    turn = F.row_number().over(Window.partitionBy(key).orderBy("part"))
    return units.select(key, turn.alias("unit"), "page", "section", "text")


def _sizes(pages: DataFrame, key: str) -> DataFrame:
    bare = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum(bare).alias("size"))


def _read(pages: DataFrame, key: str) -> DataFrame:
    return _sizes(pages, key).where(F.col("size") >= LEAST_TEXT).select(key)


def paged_outcomes(pages: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pages, units, title, error of each document: the title is its first heading of the first level; a document with
    hardly any text is taken for a scan."""
    top = F.col("text").rlike(r"^\d{1,2}\.?\s") & ~F.col("section").contains(SEPARATOR) & (F.substring_index("text", "\n", 1) == F.col("section"))
    found = units.groupBy(key).agg(F.count(F.lit(1)).alias("units"), F.min(F.when(top, F.struct("unit", "section")))["section"].alias("title"))
    out = _sizes(pages, key).join(found, key, "left")
    return out.select(key, "pages", F.coalesce("units", F.lit(0)).alias("units"), "title", F.when(F.col("size") < LEAST_TEXT, SCANNED).alias("error"))
