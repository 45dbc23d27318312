"""File types as data: which endings are read as what, and which fields of JSON records are text, by collection and file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.properties import stripped
from ..functions.text import KINDS, extension
from .records import entries

CODE = tuple(KINDS["code"])
FIXED = {ending: kind for kind, endings in KINDS.items() if kind != "code" for ending in endings}
ENDING = r"^\.[a-z0-9_+-]{1,20}$"
NAMES, JSON_NAMES = ("code_extensions", "extra_text_extensions", "jsonl"), ("text_fields", "metadata_fields")
#: Collections' types are broadcast up to so many endings in all (about 30 MB), and joined by shuffle beyond.
BROADCAST_ENDINGS = 500_000


def _object(layer: str) -> Column:
    return entries(F.try_parse_json(layer))


def _first(layers: list[str], has, take, default: Column) -> Column:
    """What ``take`` gives for the first of the layers that ``has`` it."""
    return reduce(lambda out, layer: F.when(F.coalesce(has(layer), F.lit(False)), take(layer)).otherwise(out), reversed(layers), default)


def _list(value: Column) -> Column:
    """A variant list of texts; an empty one for null."""
    none = F.array().cast("array<string>")
    return F.when(value.isNull() | F.is_variant_null(value), none).otherwise(F.try_variant_get(value, "$", "array<string>"))


def _endings(value: Column) -> Column:
    plain = F.transform(_list(value), lambda x: F.lower(stripped(x)))
    return F.transform(plain, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))


def _fields(value: Column, name: str) -> Column:
    return F.filter(F.transform(_list(F.try_element_at(entries(value), F.lit(name))), stripped), lambda x: x != "")


def _unknown(value: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(value), F.array(*map(F.lit, names)))) > 0


def _bad_json(value: Column) -> Column:
    held = entries(value)
    bad = [_unknown(held, JSON_NAMES), *[_fields(value, n).isNull() for n in JSON_NAMES]]
    return held.isNull() | reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), bad, F.lit(False))


def collection_types(collections: DataFrame, layers: list[str]) -> DataFrame:
    """collection, types (ending to kind), text_fields, metadata_fields, file_types_error from settings as JSON, the strongest layer first.

    Each of ``code_extensions``, ``extra_text_extensions`` and ``jsonl`` comes whole from the first layer that has it (null is
    an empty list), else from the defaults.  Endings are lower-cased and begin with a dot.  The endings of ``KINDS`` other than
    code keep their kind, then code counts, then text.  A layer that is no object, unknown names, endings or fields that
    are no such thing are an error, and the collection has no types.  Of a collection's rows the least settings count.
    """
    rows = collections.groupBy("collection").agg(F.min(F.struct(*layers)).alias("s")).select("collection", "s.*")
    at = lambda layer, name: F.try_element_at(_object(layer), F.lit(name))
    has = lambda name: lambda layer: F.map_contains_key(_object(layer), name)
    none = F.array().cast("array<string>")
    rows = rows.select(
        "*", _first(layers, has(NAMES[0]), lambda x: _endings(at(x, NAMES[0])), F.array(*map(F.lit, CODE))).alias("code"), _first(layers, has(NAMES[1]), lambda x: _endings(at(x, NAMES[1])), none).alias("plain"),
        *[_first(layers, has(NAMES[2]), lambda x, n=n: _fields(at(x, NAMES[2]), n), none).alias(n) for n in JSON_NAMES],
    )
    wrong = F.lit(None).cast("string")
    for layer in layers:
        odd = F.exists(F.array(*[F.coalesce(F.when(has(n)(layer), F.coalesce(F.exists(_endings(at(layer, n)), lambda x: ~F.coalesce(x.rlike(ENDING), F.lit(False))), F.lit(True))), F.lit(False)) for n in NAMES[:2]]), lambda x: x)
        here = F.when(_object(layer).isNull(), "file types are no object").when(_unknown(_object(layer), NAMES), "unknown file types").when(odd, "no such ending").when(has(NAMES[2])(layer) & _bad_json(at(layer, NAMES[2])), "no such JSON fields")
        wrong = F.coalesce(wrong, F.when(F.col(layer).isNotNull(), here))
    fixed = F.array(*map(F.lit, FIXED))
    code = F.array_except("code", fixed)
    pair = lambda kind: lambda x: F.struct(x.alias("ending"), F.lit(kind).alias("kind"))
    known = F.array(*[F.struct(F.lit(e).alias("ending"), F.lit(k).alias("kind")) for e, k in FIXED.items()])
    types = F.map_from_entries(F.concat(known, F.transform(code, pair("code")), F.transform(F.array_except(F.array_except("plain", fixed), code), pair("text"))))
    fine = lambda x: F.when(F.col("file_types_error").isNull(), x)
    rows = rows.withColumn("file_types_error", wrong)
    return rows.select("collection", fine(types).alias("types"), *[fine(F.col(n)).alias(n) for n in JSON_NAMES], "file_types_error")


def with_types(files: DataFrame, types: DataFrame, json_layers: tuple[str, ...] = ()) -> DataFrame:
    """``files`` (collection, filename, ...) with kind, text_fields, metadata_fields and file_types_error by :func:`collection_types`.

    Collections without settings, and null, go by the defaults.  ``json_layers`` are columns of the file's or its source's own
    ``{"text_fields": [...], "metadata_fields": [...]}``, the strongest first; an empty object gives nothing, and one that cannot
    be read is an error.  A file with an error has no kind.  Columns of these names in ``files`` are replaced.
    """
    made = ("kind", *JSON_NAMES, "file_types_error")
    held = F.struct("types", *JSON_NAMES, "file_types_error")
    types = types.select(F.col("collection").alias("__of"), held.alias("__types"))
    few = types.agg(F.coalesce(F.sum(F.greatest(F.size("__types.types"), F.lit(1))), F.lit(0))).first()[0] <= BROADCAST_ENDINGS
    files = files.drop(*made)
    kept = files.columns
    rows = files.join(F.broadcast(types) if few else types, F.col("collection") == F.col("__of"), "left")
    default = F.create_map(*[F.lit(x) for pair in (FIXED | dict.fromkeys(CODE, "code")).items() for x in pair])
    used = F.when(F.col("__of").isNull(), default).otherwise(F.col("__types.types"))
    given = lambda layer: F.size(_object(layer)) > 0
    none = F.array().cast("array<string>")
    fields = [_first(list(json_layers), given, lambda x, n=n: _fields(F.try_parse_json(x), n), F.coalesce(F.col(f"__types.{n}"), none)).alias(n) for n in JSON_NAMES]
    wrong = F.coalesce(F.col("__types.file_types_error"), *[F.when(F.col(x).isNotNull() & _bad_json(F.try_parse_json(x)), "no such JSON fields") for x in json_layers])
    rows = rows.select(*kept, F.try_element_at(used, extension(F.col("filename"))).alias("kind"), *fields, wrong.alias("file_types_error"))
    fine = lambda n: F.when(F.col("file_types_error").isNull(), F.col(n))
    return rows.withColumns({n: fine(n) for n in ("kind", *JSON_NAMES)})
