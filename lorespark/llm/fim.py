"""Fill-in-middle rearrangement of texts (DataFrame functions only).

A text is an array of lines; two hashes of the document's id choose the units where its prefix and its middle end.  The
parts are put together around three marks, and the text is read back from the result by its marks alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A line with its end, or a last one without.
UNIT = r"[^\n]*\n|[^\n]+"
SEED, PERCENT, SPM_PERCENT = 7, 100, 50


def draws(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` numbers of 32 bits, the groups of eight hex digits of the SHA-256 of ``seed:doc_id``; a null id counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; only plain output may hold anything between marks that is not a part."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n, form, prefix, middle, suffix, output.

    ``n`` is the number of lines.  ``percent`` of the documents are rearranged, ``spm_percent`` of these with the suffix
    first; a text that is empty or holds a mark stays plain, and its parts are null.  Null texts count as empty, a null
    doc_id as the word null.  Rows that repeat a doc_id are rearranged alike, each for itself; columns other than doc_id
    and text are ignored; an empty table gives no rows.  Nothing is shuffled and no row depends on another.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), F.array(*draws(F.col("doc_id"), seed)).alias("h"))
    n = F.size("units")
    ends = [F.col("h")[i] % (n + 1) for i in (0, 1)]
    plain = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (F.col("h")[2] % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(*ends).cast("int").alias("a"), F.greatest(*ends).cast("int").alias("b"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    rows = rows.select(
        "doc_id", "n", "form", "text",
        part(F.lit(1), F.col("a")).alias("prefix"),
        part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        part(F.col("b") + 1, F.size("units") - F.col("b")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def digests(made: DataFrame) -> DataFrame:
    """Lengths and digests in place of the texts of :func:`fill_in_middle`."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, 'null')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as units, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') as plain from u),
p as (select doc_id, t, n, case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
    array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:n], '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
    sha256(t) as restored_sha256
from p
"""
