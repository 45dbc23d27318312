"""Queries over files whose types, charsets, fields and properties are data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.properties import iso_date, property_map
from ..operators import filetypes, records
from ..sources.files import decoded
from .catalog import query, table


def _record_files(spark, sf_dir):
    """Each document as a file of six lines: a record with nested fields, one that is cut off, a blank one, a list, a bare text and a
    record of one field; by number of the document, fields are not named, or are paths, or a single one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("body"))
    meta = F.struct("lang", F.struct("source").alias("deep"))
    first = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit(" A title ").alias("title"), "body", (F.col("doc_id") * 2).alias("n"), meta.alias("meta"), (F.col("doc_id") % 2 == 0).alias("even")))
    text = F.concat(first, F.lit('\n{"id": \r\n \n[1, 2]\n"bare"\n'), F.to_json(F.struct(F.col("body").alias("q"))))
    n = F.col("doc_id") % 3
    wanted = F.when(n == 1, F.array(F.lit("meta.deep.source"), F.lit("body"))).when(n == 2, F.array(F.lit("body")))
    return docs.select("doc_id", text.alias("text"), wanted.alias("text_fields"), F.when(n == 1, F.array(F.lit("meta.lang"), F.lit("even"))).alias("metadata_fields"))


RECORDS = r"""with d as (select doc_id, coalesce(lang, '-') as lang, coalesce(source, '-') as source, trim(regexp_replace(text, '\s+', ' ', 'g')) as body, doc_id % 3 as n, case when doc_id % 2 = 0 then 'True' else 'False' end as even from documents),
u as (select doc_id, 1 as unit, 'Запись ' || doc_id as section, case n when 2 then body when 1 then 'meta.deep.source: ' || source || case when body <> '' then chr(10) || 'body: ' || body else '' end
    else 'title: A title' || case when body <> '' then chr(10) || 'body: ' || body else '' end || chr(10) || 'n: ' || doc_id * 2 || chr(10) || 'even: ' || even end as text, case when n = 1 then lang end as lang, case when n = 1 then even end as even, doc_id::varchar as id from d
  union all select doc_id, 5, 'Запись 5', 'bare', null, null, null from d where n = 0
  union all select doc_id, 6, 'Запись 6', body, null, null, null from d where n = 0)"""


@query(f"{RECORDS} select doc_id, unit::int as unit, section, sha256(text) as text_sha256, lang, even, id from u where text <> ''")
def record_fields(spark, sf_dir):
    units = records.record_units(records.parsed_records(_record_files(spark, sf_dir)))
    of = lambda k: F.col("metadata")[k]
    return units.select("doc_id", "unit", "section", F.sha2("text", 256).alias("text_sha256"), of("meta.lang").alias("lang"), of("even").alias("even"), of("id").alias("id"))


@query(f"{RECORDS} select d.doc_id, count(text)::bigint as records, 1::bigint as bad, 'lines that are no JSON: 1' as warning from d left join u on u.doc_id = d.doc_id and u.text <> '' group by d.doc_id")
def record_warnings(spark, sf_dir):
    files = _record_files(spark, sf_dir)
    return records.record_outcomes(files, records.parsed_records(files))


@query("""with f as (select doc_id, lang, ['.md', '.cfg', '.py', '.rb', '.jsonl', '.bin'][1 + doc_id % 6] as ending from documents)
select doc_id, case when lang = 'de' then null when ending = '.md' then 'markdown' when ending = '.jsonl' then 'jsonl' when ending = '.cfg' and lang in ('en', 'fr') then 'text'
    when ending = '.rb' and lang = 'en' then 'code' when ending = '.py' and (lang is null or lang <> 'en') then 'code' end as kind,
  case when lang = 'de' then null when doc_id % 4 = 0 then 'own' when lang in ('en', 'fr') then 'a,b.c' else '' end as text_fields, case when lang = 'de' then 'no such ending' end as file_types_error from f""")
def file_types_layered(spark, sf_dir):
    """Languages as collections under one base layer: English has endings of code of its own, French the base's, German one that is no
    ending, and the others none at all; every fourth file brings fields of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("collection"))
    ends = F.array(*map(F.lit, (".MD", ".cfg", ".py", ".rb", ".jsonl", ".bin")))
    files = docs.withColumn("filename", F.concat(F.lit("x.y/f"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 6 + 1).cast("int"))))
    files = files.withColumn("own", F.when(F.col("doc_id") % 4 == 0, '{"text_fields": ["own", " "]}').when(F.col("doc_id") % 4 == 1, "{}"))
    own = F.when(F.col("collection") == "en", '{"code_extensions": ["RB ", ".rb"]}').when(F.col("collection") == "de", '{"code_extensions": ["r b"]}')
    named = docs.where("collection in ('en', 'fr', 'de')").select("collection").distinct()
    settings = named.select("collection", own.alias("own"), F.lit('{"extra_text_extensions": ["cfg", "md"], "jsonl": {"text_fields": ["a", "b.c"]}}').alias("base"))
    out = filetypes.with_types(files, filetypes.collection_types(settings, ["own", "base"]), ("own",))
    return out.select("doc_id", "kind", F.array_join("text_fields", ",").alias("text_fields"), "file_types_error")


ASCII = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g')"


@query(f"select doc_id, sha256(case when doc_id % 7 < 6 then 'Привет, ' else 'Käse: ' end || {ASCII}) as text_sha256 from documents")
def decoded_texts(spark, sf_dir):
    """Each document behind a word in another script, as bytes in seven ways: UTF-8 with a mark, the Cyrillic code page without a name,
    KOI8-R, UTF-16, UTF-8 under a wrong name and under one nobody knows, and Latin-1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?").alias("text"))
    n, word = F.col("doc_id") % 7, "Привет, "
    plain, whole = F.col("text").cast("binary"), F.concat(F.lit(word), "text").cast("binary")
    with_word = lambda charset, w=word: F.concat(F.unhex(F.lit(w.encode(charset).hex())), plain)
    content = F.when(n == 0, F.concat(F.unhex(F.lit("EFBBBF")), whole)).when(n == 1, with_word("cp1251")).when(n == 2, with_word("koi8-r"))
    content = content.when(n == 3, F.encode(F.concat(F.lit(word), "text"), "UTF-16")).when(n == 6, with_word("latin-1", "Käse: ")).otherwise(whole)
    charset = F.when(n == 2, "KOI8-R").when(n == 3, "utf-16").when(n == 4, "us-ascii").when(n == 5, "x-none").when(n == 6, "ISO-8859-1")
    return docs.select("doc_id", F.sha2(decoded(content, charset), 256).alias("text_sha256"))


PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""select doc_id, nullif(substr({PLAIN}, 1, 500), '') as about, case when doc_id % 3 = 0 then 'A. Writer' end as author, nullif(trim(concat_ws(', ', source, lang)), '') as keywords,
doc_id::varchar as number, '2024-01-' || lpad((1 + doc_id % 28)::varchar, 2, '0') as modified, case when doc_id % 40 < 31 then '2024-01-' || lpad((1 + doc_id % 40)::varchar, 2, '0') end as said from documents""")
def document_properties(spark, sf_dir):
    """Texts above the length, placeholders, lists with nulls, numbers, times, and days in three forms, some of which the calendar lacks."""
    docs, number = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    author = F.when(F.col("doc_id") % 3 == 0, "  A. Writer ").when(F.col("doc_id") % 3 == 1, " Unknown").otherwise("(ANONYMOUS)")
    day = lambda n: F.lpad((1 + F.col("doc_id") % n).cast("string"), 2, "0")
    moment = F.to_timestamp(F.concat(F.lit("2024-01-"), day(28), F.lit(" 23:30:00")))
    form = F.col("doc_id") % 3
    said = F.when(form == 0, F.concat(F.lit("2024/01/"), day(40), F.lit(" noon"))).when(form == 1, F.concat(F.lit("D:202401"), day(40), F.lit("120000+03'00'"))).otherwise(F.concat(F.lit("2024-01-"), day(40), F.lit("T10:00")))
    rows = docs.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("about"), author.alias("author"), F.array("source", "lang").alias("keywords"), F.col("doc_id").alias("number"), moment.alias("modified"), iso_date(said).alias("said"))
    names = ["about", "author", "keywords", "number", "modified", "said"]
    kept = rows.select("doc_id", property_map(rows, names).alias("properties"))
    return kept.select("doc_id", *[F.col("properties")[n].alias(n) for n in names])
