"""Column functions on text; all of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CYRILLIC, LETTER, WORD = "[А-Яа-яЁё]", r"\p{L}", r"([\p{L}\p{N}_]+)"

#: Words that never count as search terms.
STOP_WORDS = (
    "и в во на с со по к ко о об от до из за для не ли же а но или что как это то там тут у при про есть быть мне нам "
    "какой какая какие каких сколько где когда кто чем "
    "the a an of to in on for is are and or what how with by"
).split()

#: Languages of code by extension.
LANGUAGES = {
    "python": [".py", ".pyi"], "kotlin": [".kt", ".kts"], "java": [".java"], "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"], "go": [".go"], "sql": [".sql"], "yaml": [".yaml", ".yml"], "json": [".json"],
    "toml": [".toml"], "xml": [".xml"], "gradle": [".gradle"], "properties": [".properties"], "shell": [".sh"],
}

#: File kinds by extension.
KINDS = {
    "markdown": [".md", ".markdown"], "rst": [".rst"], "html": [".html", ".htm"], "pdf": [".pdf"], "docx": [".docx"],
    "pptx": [".pptx"], "xlsx": [".xlsx"], "jsonl": [".jsonl", ".ndjson"], "text": [".txt", ".log"],
    "code": [x for many in LANGUAGES.values() for x in many if x not in (".mjs", ".cjs")],
}


def cyrillic_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CYRILLIC))


def token_estimate(text: Column) -> Column:
    """0 for nothing, else at least 1: a token for 2.5 Cyrillic or 4 other characters."""
    cyr = cyrillic_count(text)
    n = F.greatest(F.lit(1), F.ceil(cyr / F.lit(2.5) + (F.length(text) - cyr) / F.lit(4.0)))
    return F.when(F.length(text) > 0, n).otherwise(0).cast("bigint")


def detect_language(text: Column) -> Column:
    """`ru` if more than three tenths of the letters in the first 5000 characters are Cyrillic, `en` otherwise, empty without letters."""
    head = F.substring(text, 1, 5000)
    letters = F.regexp_count(head, F.lit(LETTER))
    return F.when(letters == 0, "").when(cyrillic_count(head) / letters > 0.3, "ru").otherwise("en")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_hash(text: Column) -> Column:
    """Hash that ignores case and white space."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), 256)


def clean(text: Column) -> Column:
    """Line ends become LF, NUL goes, three or more line ends become two, and the ends are stripped."""
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\x00", "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def terms(text: Column) -> Column:
    """Words of two letters or more that are no stop words, cut to six characters as a rough stem."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.transform(F.filter(words(text), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)), lambda w: F.substring(w, 1, 6))


def term_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term): :func:`terms` as rows; words become rows before they are looked at, so generated code does it."""
    rows = docs.select(key, F.explode(words(F.col(text))).alias("word"))
    return rows.where((F.length("word") > 1) & ~F.col("word").isin(STOP_WORDS)).select(key, F.substring("word", 1, 6).alias("term"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"[^/](\.[^./]+)$", 1))


def kind(name: Column) -> Column:
    ext, out = extension(name), F.lit(None).cast("string")
    for k, many in KINDS.items():
        out = F.when(ext.isin(many), k).otherwise(out)
    return out


def glob_pattern(mask: str) -> str:
    """`**/` is any folders, `**` anything, `*` and `?` stay within a name; the rest is literal; case does not matter."""
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", mask)
    return "(?i)^" + "".join(wild.get(p) or re.sub(r"([^\w/ -])", r"\\\1", p) for p in parts) + "$"


def matches_mask(path: Column, mask: str) -> Column:
    """A mask without a slash may also match the bare name."""
    whole = path.rlike(glob_pattern(mask))
    return whole if "/" in mask else whole | F.element_at(F.split(path, "/"), -1).rlike(glob_pattern(mask))


#: What some models want before a text.
INSTRUCTION = "Given a question, retrieve passages from the knowledge base that answer the question"
NOMIC, E5 = "nomic-embed", "(^|[/_-])e5"


def query_prefix(model: Column, text: Column) -> Column:
    name = F.lower(model)
    asked = F.when(name.contains("qwen3-embedding"), F.concat(F.lit(f"Instruct: {INSTRUCTION}\nQuery: "), text))
    return asked.when(name.contains(NOMIC), F.concat(F.lit("search_query: "), text)).when(name.rlike(E5), F.concat(F.lit("query: "), text)).otherwise(text)


def document_prefix(model: Column, text: Column) -> Column:
    name = F.lower(model)
    return F.when(name.contains(NOMIC), F.concat(F.lit("search_document: "), text)).when(name.rlike(E5), F.concat(F.lit("passage: "), text)).otherwise(text)


def model_parts(model_id: Column) -> Column:
    """(provider, model), parted at the first slash; null unless both are there."""
    part = lambda i: F.regexp_extract(model_id, "^([^/]+)/(.+)$", i)
    return F.when(part(2) != "", F.struct(part(1).alias("provider"), part(2).alias("model")))


def normalize_url(url: Column) -> Column:
    """`https://` where no scheme is named; null unless it is http or https with a host."""
    url = F.trim(url)
    url = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), F.regexp_replace(url, "^/+", "")))
    return F.when(url.rlike("(?i)^https?://([^/?#@]*@)?[^/?#:@]+"), url)


def inline_filename(title: Column, content: Column, form: Column) -> Column:
    """A file name for a text given inline: its title, or its first line; null for a blank text or an unknown format."""
    content = F.regexp_replace(content, r"^\s+|\s+$", "")
    title = F.coalesce(F.when(F.trim(title) != "", F.trim(title)), F.substring(F.substring_index(content, "\n", 1), 1, 80))
    name = F.substring(F.trim(F.regexp_replace(title, r"[^\p{L}\p{N}_\- .]+", "_")), 1, 80)
    ending = F.when(form == "markdown", ".md").when(form == "text", ".txt")
    return F.when(content != "", F.concat(F.when(name != "", name).otherwise("text"), ending))
