"""Files, folders and masks as a DataFrame of (path, content, doc_date)."""

from __future__ import annotations

import codecs
import re
from encodings.aliases import aliases

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import kind, matches_mask

#: Folders that a scan leaves out unless told otherwise.
EXCLUDED = ("**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/.venv/**", "**/.idea/**")


def below(path: Column, root: str) -> Column:
    """``path`` below the folder ``root``; schemes and hosts of both are left out of account.  A root with signs of a mask, or one
    that is the file itself, leaves the name alone."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    whole, top = F.regexp_replace(path, scheme, ""), re.sub("/+", "/", re.sub(scheme, "", root)).rstrip("/") + "/"
    return F.when(whole.startswith(top), F.substr(whole, F.lit(len(top) + 1))).otherwise(F.element_at(F.split(whole, "/"), -1))


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: tuple[str, ...] = EXCLUDED, max_bytes: int = 50 << 20) -> DataFrame:
    """path, kind, size_bytes, doc_date (UTC), content, error; too large files keep their row and give an error instead of content.

    Masks are held against the path below ``root``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = below(F.col("path"), root)
    files = files.where(~F.greatest(F.lit(False), F.lit(False), *[matches_mask(inner, m) for m in exclude]))
    if include:
        files = files.where(F.greatest(F.lit(False), F.lit(False), *[matches_mask(inner, m) for m in include]))
    large = F.col("length") > max_bytes
    return files.select(
        "path", kind(F.col("path")).alias("kind"), F.col("length").alias("size_bytes"), F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd").alias("doc_date"),
        F.when(~large, F.col("content")).alias("content"), F.when(large, "too large").alias("error"),
    )


MARK = "EFBBBF"
#: Charsets of one byte a sign; their upper halves are tables that Python knows, and a byte without a sign is no text in them.
ONE_BYTE = ("latin-1", *(f"iso8859-{n}" for n in (*range(2, 12), *range(13, 17))), *(f"cp125{n}" for n in range(9)), "koi8-r", "koi8-u", "cp866", "cp437", "cp850", "cp852", "mac-cyrillic", "mac-roman")
UPPER, LATIN, NO_SIGN = bytes(range(128, 256)), bytes(range(128, 256)).decode("latin-1"), "\ufffd"


def plain_name(charset: str) -> str:
    return re.sub("[^a-z0-9]", "", charset.lower())


def _names(codec: str) -> list[str]:
    """Every name of a codec, in small letters and digits alone."""
    module = codecs.lookup(codec).name.replace("-", "_")
    module = aliases.get(module, module)
    return sorted({plain_name(x) for x in (codec, codecs.lookup(codec).name, module, *(a for a, m in aliases.items() if m == module))})


def _one_byte(raw: Column, codec: str) -> Column:
    """``raw`` in a charset of one byte a sign, null if it has a byte without one."""
    signs = UPPER.decode(codec, "replace")
    empty = "".join(b for b, c in zip(LATIN, signs, strict=True) if c == NO_SIGN)
    text = F.decode(raw, "ISO-8859-1")
    return F.when(~text.rlike(f"[{empty}]") if empty else F.lit(True), F.translate(text, LATIN, signs))


@F.pandas_udf(StringType())
def _other(raw: pd.Series, charset: pd.Series) -> pd.Series:
    """Charsets of several bytes a sign, and those nobody knows: a text or null."""

    def read(data, name):
        try:
            return None if data is None else bytes(data).decode(name)
        except (UnicodeDecodeError, LookupError, ValueError):
            return None

    return pd.Series([read(d, n) for d, n in zip(raw, charset, strict=True)], dtype=object)


def decoded(content: Column, charset: Column | str | None = None) -> Column:
    """``content`` as text: in its charset, else as UTF-8, else in the Cyrillic code page, else as Latin-1, whichever first can be.

    ``charset`` may differ by row and be null, unknown or wrong; a mark of UTF-8 at the start goes.  Only rows in charsets of
    several bytes other than UTF-8 are handed to Python, the rest stays in the JVM; without a charset there is no Python at all.
    Null content is null.
    """
    raw = F.when(F.hex(F.substring(content, 1, 3)) == MARK, F.substring(content, 4, 2**31 - 1)).otherwise(content)
    utf8 = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    guess = [utf8, _one_byte(raw, "cp1251"), _one_byte(raw, "latin-1")]
    if charset is None:
        return F.coalesce(*guess)
    charset = F.lit(charset) if isinstance(charset, str) else charset
    name = F.regexp_replace(F.lower(charset), "[^a-z0-9]", "")
    declared, known = F.when(name.isin(_names("utf-8") + _names("ascii")), utf8), _names("utf-8") + _names("ascii")
    for codec in ONE_BYTE:
        declared, known = declared.when(name.isin(_names(codec)), _one_byte(raw, codec)), known + _names(codec)
    rest = F.trim(charset) != ""
    rest &= ~name.isin(known)
    return F.coalesce(declared, _other(F.when(rest, raw), F.when(rest, charset)), *guess)
