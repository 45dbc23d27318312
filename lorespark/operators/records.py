"""JSON records, one on a line, to units: which fields are text and which are metadata is data of the row, or follows from the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.properties import stripped

LINE_END = r"\r\n|[\n\u000B\f\r\u001C-\u001E\u0085\u2028\u2029]"
OBJECT, SECTION = "map<string,variant>", "Запись "
#: Stands behind a line's value in one array, so that a line with anything behind its value is told from a whole one.
END = "\u0001end of line"


def entries(value: Column) -> Column:
    """The entries of a variant that is an object, else null."""
    return F.try_variant_get(value, "$", OBJECT)


def _shape(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_scalar(value: Column) -> Column:
    return F.coalesce(~_shape(value).isin("OBJECT", "ARRAY", "VOID"), F.lit(False))


def shown(value: Column) -> Column:
    """A variant as text: True and False, numbers by value, nested ones as compact JSON, null and nothing as an empty text."""
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(F.when(_shape(value) == "BOOLEAN", F.initcap(text)).otherwise(text), F.lit(""))


def field(record: Column, name: Column) -> Column:
    """The field of that name, else the one at the end of its dotted path."""
    path = F.split(name, r"\.")
    inner = F.aggregate(F.slice(path, F.lit(2), F.size(path)), F.try_element_at(record, path[0]), lambda value, part: F.try_element_at(entries(value), part))
    return F.coalesce(F.try_element_at(record, name), inner)


def parsed_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, at (line, from 1), bad, section, text, metadata for each line of ``docs`` that is not blank.

    ``docs`` may have ``text_fields`` and ``metadata_fields`` (arrays of names or dotted paths).  Without text fields a
    record's text is all its own scalar fields, in its order, but for ``id`` and the metadata.  One field alone stands
    without its name, several as lines ``name: value``; empty values are left out.  Metadata keeps scalars, and a scalar
    ``id`` always.  The section names the id or, without one or with null, the line.  What is no object counts as the field
    ``value``.  A line that is no JSON is bad, and so are one with a key given twice and NaN; ``text`` is then null, as for
    a record without any text.  Null texts have no lines; extra columns are ignored.
    """
    none = F.array().cast("array<string>")
    given = lambda name: F.array_distinct(F.coalesce(F.filter(name, lambda x: stripped(x) != ""), none)) if name in docs.columns else none
    rows = docs.select(key, given("text_fields").alias("wanted"), given("metadata_fields").alias("about"), F.posexplode(F.split(text, LINE_END)).alias("at", "line"))
    rows = rows.withColumn("line", stripped(F.col("line"))).where("line <> ''")
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "line", F.lit(f',"{END}"]'.replace("\u0001", "\\u0001")))), "$", "array<variant>")
    rows = rows.withColumn("both", both)
    whole = (F.size("both") == 2) & (F.try_variant_get(F.try_element_at("both", F.lit(2)), "$", "string") == END)
    rows = rows.withColumn("value", F.when(whole, F.col("both")[0])).withColumn("inside", entries(F.col("value")))
    rows = rows.withColumn("record", F.when(F.col("value").isNotNull(), F.coalesce("inside", F.create_map(F.lit("value"), F.col("value")))))
    keys = F.when(F.col("inside").isNotNull(), F.json_object_keys("line")).otherwise(F.array(F.lit("value")))
    own = F.filter(keys, lambda k: (k != "id") & ~F.array_contains("about", k) & is_scalar(F.try_element_at("record", k)))
    rows = rows.withColumn("fields", F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(own))
    found = F.transform("fields", lambda k: F.struct(k.alias("name"), field(F.col("record"), k).alias("value")))
    said = F.transform(found, lambda x: F.struct(x["name"].alias("name"), stripped(shown(x["value"])).alias("said")))
    rows = rows.withColumn("said", F.filter(said, lambda x: x["said"] != ""))
    lines = F.transform("said", lambda x: F.when(F.size("fields") == 1, x["said"]).otherwise(F.concat(x["name"], F.lit(": "), x["said"])))
    number = F.try_element_at("record", F.lit("id"))
    named = is_scalar(number) | (F.array_contains("about", "id") & (_shape(number) != "VOID"))
    kept = F.filter(F.transform(F.array_union("about", F.array(F.lit("id"))), lambda k: F.struct(k.alias("name"), field(F.col("record"), k).alias("value"))), lambda x: is_scalar(x["value"]))
    made = F.struct(
        (F.col("at") + 1).cast("int").alias("at"), F.col("value").isNull().alias("bad"),
        F.concat(F.lit(SECTION), F.when(named, shown(number)).otherwise((F.col("at") + 1).cast("string"))).alias("section"),
        F.when(F.size("said") > 0, F.array_join(lines, "\n")).alias("text"),
        F.map_from_entries(F.transform(kept, lambda x: F.struct(x["name"], shown(x["value"])))).alias("metadata"),
    )
    # A row of its own by a generator: what is asked of the result later is then not worked out anew below, once for each use.
    return rows.select(key, F.inline(F.array(made)))


def record_units(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, unit (the line), section, text, metadata of the records of :func:`parsed_records` that have a text; each is a unit of its own."""
    return parsed.where("text is not null").select(key, F.col("at").alias("unit"), "section", "text", "metadata")


def record_outcomes(docs: DataFrame, parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, records (with a text), bad, warning (null where no line is bad): one row for each key of ``docs``, null included."""
    rows = docs.select(key, F.lit(0).alias("record"), F.lit(0).alias("bad")).unionByName(parsed.select(key, F.col("text").isNotNull().cast("int").alias("record"), F.col("bad").cast("int")))
    sums = rows.groupBy(key).agg(F.sum("record").alias("records"), F.sum("bad").alias("bad"))
    return sums.withColumn("warning", F.when(F.col("bad") > 0, F.concat(F.lit("lines that are no JSON: "), F.col("bad").cast("string"))))
