"""From files of any kind to units: each kind's rows go to its parser, and one table comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind
from . import code, parsing, records

PARSED = ("markdown", "rst", "html", "jsonl", "text", "code")
UNSUPPORTED, EMPTY = "unsupported format", "no text"


def record_units(docs: DataFrame, id_path: str, fields: list[str]) -> DataFrame:
    """doc_id, unit, section, text: a unit for each readable line of JSON, numbered by line."""
    if "text_fields" in docs.columns:
        return records.record_units(records.parsed_records(docs))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\\r?\\n|\\r")).alias("at", "record")).where("record <> ''")
    units = parsing.json_units(lines, "record", id_path, fields)
    return units.select("doc_id", (F.col("at") + 1).alias("unit"), F.coalesce("section", F.lit("")).alias("section"), F.col("unit_text").alias("text"))


def parse_documents(docs: DataFrame, id_path: str = "id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, kind, unit, section, text of files (doc_id long and unique, filename, text); ``fields`` and ``id_path`` are for JSON records.

    Files that come from :func:`..filetypes.with_types` have their kind and fields already, and those hold.

    Units are numbered in order within a file, and blank ones are left out.  Files of other kinds and null or blank texts
    have no units (see :func:`outcomes`).  Each parser reads the rows of its kind alone, so write what is dear to decode.
    """
    typed = [c for c in ("text_fields", "metadata_fields") if "kind" in docs.columns and c in docs.columns]
    rows = docs.select("doc_id", "filename", "text", *typed, (F.col("kind") if typed else kind(F.col("filename"))).alias("kind")).where("text is not null")
    of = lambda k: rows.where(F.col("kind") == k)
    made = {
        "markdown": parsing.markdown_units(parsing.front_matter(of("markdown"))),
        "rst": parsing.rst_units(of("rst")),
        "html": parsing.html_units(of("html").select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
        "jsonl": record_units(of("jsonl"), id_path, list(fields)),
        "text": parsing.plain_units(of("text")),
        "code": code.code_units(of("code").select("doc_id", "filename", "text"), "doc_id"),
    }
    out = None
    for name in PARSED:
        part = made[name].select("doc_id", F.lit(name).alias("kind"), F.col("unit").cast("int").alias("unit"), F.coalesce("section", F.lit("")).alias("section"), "text")
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("text").rlike(r"(?U)\S"))


def outcomes(docs: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, kind, units, sections (distinct, null for none), error: what became of each file."""
    section = F.when(F.col("section") != "", F.col("section"))
    counts = units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.count_distinct(section).alias("sections"))
    typed = {"kind", "text_fields"} <= set(docs.columns)
    rows = docs.select("doc_id", (F.col("kind") if typed else kind(F.col("filename"))).alias("kind")).join(counts, "doc_id", "left")
    error = F.when(F.col("kind").isNull() | ~F.col("kind").isin(*PARSED), UNSUPPORTED).when(F.col("units").isNull(), EMPTY)
    return rows.select("doc_id", "kind", F.coalesce("units", F.lit(0)).alias("units"), F.nullif("sections", F.lit(0)).alias("sections"), error.alias("error"))
