"""Properties of documents as texts: dates, lists, placeholders and length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: What programs write where a property has no value, and the length at which values end.
PLACEHOLDERS, LONGEST = ("unspecified", "anonymous", "untitled", "unknown", "none", "null", "(anonymous)", "(unspecified)"), 500


def stripped(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\u001C-\u001F]+|[\s\u001C-\u001F]+$", "")


def property_value(text: Column) -> Column:
    """The first 500 characters of ``text`` without white space at its ends; null where nothing or a placeholder is left."""
    text = stripped(text)
    return F.when((text != "") & ~F.lower(text).isin(*PLACEHOLDERS), F.substring(text, 1, LONGEST))


def property_list(values: Column) -> Column:
    """The values that are not null, joined with commas, as one property."""
    return property_value(F.array_join(F.transform(values, lambda x: x.cast("string")), ", "))


#: How a day may be written: parted, in digits alone, and as paged documents write it with the time behind it.
DAYS = (r"^(\d{4})[-/.](\d{2})[-/.](\d{2})(?!\d)", r"^(\d{4})(\d{2})(\d{2})(?!\d)", r"^D:(\d{4})(\d{2})(\d{2})")


def iso_date(text: Column) -> Column:
    """`yyyy-MM-dd` of a text that begins with a day as ``DAYS`` say; null for others and for what is no day of the calendar."""
    said = [F.concat_ws("-", *[F.regexp_extract(stripped(text), form, i) for i in (1, 2, 3)]) for form in DAYS]
    found = F.coalesce(*[F.nullif(x, F.lit("--")) for x in said])
    return F.date_format(F.try_to_date(found, "yyyy-MM-dd"), "yyyy-MM-dd")


def overlay(*layers: Column) -> Column:
    """One map of the ``layers``, each laid over those before it; null layers and null values let what lies below through."""
    none = F.create_map().cast("map<string,string>")

    def lay(below: Column, layer: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(layer, k)), layer)

    return reduce(lay, [F.map_filter(F.coalesce(x, none), lambda _, v: v.isNotNull()) for x in layers], none)


def property_map(rows: DataFrame, names: list[str]) -> Column:
    """A map of the columns ``names`` that have a value: days and times as `yyyy-MM-dd`, lists joined, truth values and numbers as they are."""
    values = []
    for name in names:
        kind, column = rows.schema[name].dataType, rows[name]
        if isinstance(kind, S.DateType | S.TimestampType | S.TimestampNTZType):
            value = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, S.ArrayType):
            value = property_list(column)
        elif isinstance(kind, S.NumericType | S.BooleanType):
            value = column.cast("string")
        else:
            value = property_value(column.cast("string"))
        values.append(F.struct(F.lit(name).alias("name"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*values), lambda x: x["value"].isNotNull()))
