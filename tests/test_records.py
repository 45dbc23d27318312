import json

import pytest
from lorespark.functions import properties as P
from lorespark.operators import documents, filetypes, records
from lorespark.sources.files import below, decoded, scan
from pyspark.sql import functions as F

FILE = "doc_id bigint, text string, text_fields array<string>, metadata_fields array<string>"


def parsed(spark, rows):
    docs = spark.createDataFrame(rows, FILE)
    out = records.parsed_records(docs)
    units = {}
    for r in records.record_units(out).collect():
        units.setdefault(r["doc_id"], []).append((r["unit"], r["section"], r["text"], r["metadata"]))
    return {k: sorted(v, key=lambda u: u[0]) for k, v in units.items()}, {r["doc_id"]: tuple(r)[1:] for r in records.record_outcomes(docs, out).collect()}


def test_records_without_a_field_list(spark):
    lines = ['{"id": 7, "b": "x", "a": " y ", "n": 2, "t": true, "z": null, "o": {"p": 1}, "l": [1], "e": ""}', "", "no json", '{"only": "one"}\r', '"bare"', "[1]", "null", '{"id": null, "k\'\\"": "q", "d.e": 1}', "{}"]
    units, out = parsed(spark, [(1, "\n".join(lines), None, []), (2, None, None, None), (3, " \n ", [], None), (None, "5", None, None)])
    assert units[1] == [
        (1, "Запись 7", "b: x\na: y\nn: 2\nt: True", {"id": "7"}), (4, "Запись 4", "one", {}), (5, "Запись 5", "bare", {}), (8, "Запись 8", "k'\": q\nd.e: 1", {}),
    ]
    assert out == {1: (4, 1, "lines that are no JSON: 1"), 2: (0, 0, None), 3: (0, 0, None), None: (1, 0, None)} and units[None] == [(1, "Запись 1", "5", {})]


def test_records_with_fields(spark):
    line = json.dumps({"id": {"no": 3}, "a": {"b": {"c": "deep"}, "s": [1, 2]}, "x": "ё", "m": 1.5, "k": False}, ensure_ascii=False)
    units, _ = parsed(spark, [(1, line, ["a.b.c", "x", "gone"], ["m", "a.s", "k", "gone"]), (2, line, ["a.b.c"], ["id"]), (3, line, ["a.s", "a.b"], None), (4, line, None, ["x"]), (5, "7\n[2]", ["value"], None)])
    assert units[1] == [(1, "Запись 1", "a.b.c: deep\nx: ё", {"m": "1.5", "k": "False"})]
    assert units[2] == [(1, 'Запись {"no":3}', "deep", {})] and units[3][0][2] == 'a.s: [1,2]\na.b: {"c":"deep"}' and units[4] == [(1, "Запись 1", "m: 1.5\nk: False", {"x": "ё"})]
    assert units[5] == [(1, "Запись 1", "7", {}), (2, "Запись 2", "[2]", {})]


@pytest.mark.parametrize("line", ['{"a": 1} x', '{"a": 1}, {"b": 2}', '{"a": 1}}', '{"a": 1}], [{"b": 1}', "{'a': 1}", '{"a": NaN}', '{"a": 1, "a": 2}', "[", '{"a": 1'])
def test_bad_lines(spark, line):
    units, out = parsed(spark, [(1, line, None, None)])
    assert units == {} and out[1][:2] == (0, 1)


def test_record_table_edges(spark):
    docs = spark.createDataFrame([(1, '{"a": 1}', "x", 2), (1, '{"a": 2}', None, 3)], "doc_id bigint, text string, section string, at int")
    assert sorted(r["text"] for r in records.record_units(records.parsed_records(docs)).collect()) == ["1", "2"]
    assert [tuple(r) for r in records.record_outcomes(docs, records.parsed_records(docs)).collect()] == [(1, 2, 0, None)]
    assert records.parsed_records(docs.limit(0)).count() == records.record_outcomes(docs.limit(0), records.parsed_records(docs.limit(0))).count() == 0
    long = spark.createDataFrame([(1, json.dumps({"a": "x" * 3_000_000}) + "\n" + '{"a": 1}\n' * 20_000)], "doc_id bigint, text string")
    assert records.parsed_records(long).agg(F.count("text"), F.max(F.length("text"))).first()[:] == (20_001, 3_000_000)


def test_file_types(spark):
    settings = [
        ("plain", None, None), ("own", '{"code_extensions": [" RB", ".py", "py"], "extra_text_extensions": ["log2", ".rb", "md"]}', None), ("base", '{"jsonl": {"text_fields": ["b", " "]}}', '{"code_extensions": ["zig"], "jsonl": {"text_fields": ["a"]}}'),
        ("none", '{"code_extensions": null}', '{"code_extensions": ["zig"]}'), ("e1", "[1]", None), ("e2", '{"other": 1}', None), ("e3", '{"code_extensions": ["a b"]}', None), ("e4", '{"jsonl": {"x": []}}', None), ("e5", '{"jsonl": 1}', None),
        ("e6", None, '{"extra_text_extensions": "x"}'), ("e7", "{", None), ("e8", '{"code_extensions": [""]}', None), ("e9", '{"code_extensions": [null]}', None),
    ]
    types = filetypes.collection_types(spark.createDataFrame(settings, "collection string, own string, base string"), ["own", "base"])
    names = ["a.rb", "a.PY", "a.log2", "a.md", "a.zig", "a.jsonl", "a", None, "x/a.kt"]
    files = spark.createDataFrame([(c, n, "old") for c in [s[0] for s in settings] + ["gone", None] for n in names], "collection string, filename string, kind string")
    rows = filetypes.with_types(files, types).collect()
    got = {c: [r["kind"] for r in sorted((r for r in rows if r["collection"] == c), key=lambda r: names.index(r["filename"]))] for c in {r["collection"] for r in rows}}
    usual = [None, "code", None, "markdown", None, "jsonl", None, None, "code"]
    assert len(rows) == files.count() and got["plain"] == got["gone"] == got[None] == usual
    assert got["own"] == ["code", "code", "text", "markdown", None, "jsonl", None, None, None]
    assert got["base"] == [None, None, None, "markdown", "code", "jsonl", None, None, None] and got["none"] == [None, None, None, "markdown", None, "jsonl", None, None, None]
    assert {tuple(r["text_fields"]) for r in rows if r["collection"] == "base"} == {("b",)}
    errors = {r["collection"]: r["file_types_error"] for r in rows if r["file_types_error"]}
    assert set(errors) == {f"e{i}" for i in range(1, 10)} and all(set(got[c]) == {None} for c in errors)
    assert errors["e1"] == errors["e7"] == "file types are no object" and errors["e2"] == "unknown file types" and errors["e3"] == errors["e6"] == errors["e8"] == errors["e9"] == "no such ending" and errors["e4"] == errors["e5"] == "no such JSON fields"
    assert filetypes.with_types(files.limit(0), types.limit(0)).count() == 0


def test_typed_files_are_parsed_by_their_types(spark):
    types = filetypes.collection_types(spark.createDataFrame([("c", '{"extra_text_extensions": ["cfg"], "jsonl": {"text_fields": ["b"]}}')], "collection string, own string"), ["own"])
    line = '{"id": 1, "a": "x", "b": "y"}\n'
    rows = [(1, "c", "a.cfg", "k = v", None), (2, "c", "a.jsonl", line, None), (3, "d", "a.jsonl", line, "{}"), (4, "d", "a.jsonl", line, '{"text_fields": ["a"]}'), (5, "d", "a.cfg", "k", None), (6, "c", "a.jsonl", line, '{"fields": 1}')]
    files = filetypes.with_types(spark.createDataFrame(rows, "doc_id bigint, collection string, filename string, text string, own string"), types, ("own",))
    units = documents.parse_documents(files)
    assert sorted((r["doc_id"], r["kind"], r["text"]) for r in units.collect()) == [(1, "text", "k = v"), (2, "jsonl", "y"), (3, "jsonl", "a: x\nb: y"), (4, "jsonl", "x")]
    assert {r["doc_id"]: r["error"] for r in documents.outcomes(files, units).collect()} == {1: None, 2: None, 3: None, 4: None, 5: documents.UNSUPPORTED, 6: documents.UNSUPPORTED}


def test_charset_chain(spark):
    word, umlaut = "Привет", "Käse"
    rows = [
        (word.encode(), None, word), (b"\xef\xbb\xbf" + word.encode(), "utf-8", word), (word.encode("cp1251"), None, word), (word.encode("koi8-r"), "KOI8-R", word), (word.encode("cp866"), " cp866", word), (umlaut.encode("latin-1"), "ISO-8859-1", umlaut),
        (umlaut.encode("cp1252"), "Windows-1252", umlaut), (word.encode("utf-16"), "UTF-16", word), (word.encode("utf-16-le"), "utf-16le", word), ("日本".encode("shift_jis"), "Shift_JIS", "日本"), (word.encode(), "ascii", word), (word.encode(), "no-such", word),
        (word.encode("cp1251"), "utf-8", word), (b"a\x98\xe9", None, "a\x98é"), (b"\xff", "utf-16", "я"), (b"", "utf-16", ""), (None, "utf-8", None), (b"\x81a", "cp1252", "Ѓa"), (word.encode("iso8859-5"), "iso-8859-5", word), (b"x", "", "x"), (b"x", "hex", "x"),
    ]
    got = spark.createDataFrame([(i, bytearray(c) if c is not None else None, n, w) for i, (c, n, w) in enumerate(rows)], "i int, content binary, charset string, want string")
    for r in got.select("i", "charset", "want", decoded(F.col("content"), F.col("charset")).alias("text")).collect():
        assert r["text"] == r["want"], tuple(r)
    for r in got.where("charset is null").select("want", decoded(F.col("content")).alias("text")).collect():
        assert r["text"] == r["want"]
    assert got.where("charset = 'KOI8-R'").select(decoded(F.col("content"), "koi8-r")).first()[0] == word


def test_properties(spark):
    texts = ["  x ", "Unknown", "NONE", "(anonymous)", " \u00a0", None, "y" * 600, "unknown author", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.property_value(F.col("t"))).collect()]
    assert got == ["x", None, None, None, None, None, "y" * 500, "unknown author", None]
    days = {"2024-02-29T10:00Z": "2024-02-29", "2023-02-29": None, "20240105": "2024-01-05", "D:20240105120000+03'00'": "2024-01-05", "2024/01/05 x": "2024-01-05", " 2024.01.05": "2024-01-05", "2024-01-055": None, "5.1.2024": None, "202401051": None, "": None, None: None}
    rows = spark.createDataFrame([(d,) for d in days], "t string").select("t", P.iso_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == days
    frame = spark.sql("select 'a' as s, 'none' as p, array('x', null, 'y') as l, array(1, 2) as n, timestamp '2024-01-05 23:30:00' as t, date '2024-01-06' as d, 3 as i, true as b, 1.5D as f, cast(null as int) as z, array() as e")
    got = frame.select(P.property_map(frame, frame.columns).alias("m")).first()["m"]
    assert got == {"s": "a", "l": "x, y", "n": "1, 2", "t": "2024-01-05", "d": "2024-01-06", "i": "3", "b": "true", "f": "1.5"}


def test_masks_are_held_against_the_path_below_the_root(spark, tmp_path):
    root = tmp_path / ".git" / "docs"
    for name in ("a.md", "sub/b.md", "node_modules/c.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    names = lambda **k: sorted(r["path"].rsplit("/", 1)[1] for r in scan(spark, str(root), **k).collect())
    assert names() == ["a.md", "b.md"] and names(include=["sub/*"]) == ["b.md"] and names(exclude=()) == ["a.md", "b.md", "c.md"]
    assert spark.range(1).select(below(F.lit("s3a://bucket/x/y/z.md"), "s3a://bucket/x/")).first()[0] == "y/z.md"


def test_overlay(spark):
    rows = spark.sql("select map('a', '1', 'b', '2', 'c', null) as low, map('b', '3', 'c', '4') as mid, map('b', cast(null as string), 'd', '5') as top, cast(null as map<string,string>) as no")
    laid = lambda *c: rows.select(P.overlay(*map(F.col, c)).alias("m")).first()["m"]
    assert laid("low", "mid", "no", "top") == {"a": "1", "b": "3", "c": "4", "d": "5"} and laid("mid", "low") == {"a": "1", "b": "2", "c": "4"} and laid("no") == laid() == {}
