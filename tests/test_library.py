import math
import random
import re

import duckdb
import pytest

from lorespark.functions import text as T
from lorespark.operators import chunking, parsing, retrieval, sync
from lorespark.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in "events orders documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    theirs = sorted(str([plain(dict(zip(rel.columns, r))[c]) for c in cols]) for r in rel.fetchall())
    assert ours == theirs


def test_text_functions(spark):
    df = spark.createDataFrame([("Привет, мир",), ("",), ("12",), ("hello world",)], "t string")
    got = df.select(T.token_estimate(F.col("t")), T.detect_language(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(5, "ru"), (0, ""), (1, ""), (3, "en")]
    names = spark.createDataFrame([("a/b/x.PY",), (".gitignore",), ("docs\\r.md",), ("x.bin",)], "n string")
    assert [r[0] for r in names.select(T.kind(F.col("n"))).collect()] == ["code", None, "markdown", None]
    paths = spark.createDataFrame([("docs/a.md",), ("docs/x/B.MD",), ("src/a.py",)], "p string")
    assert [r[0] for r in paths.select(T.matches_mask(F.col("p"), "docs/**/*.md")).collect()] == [True, True, False]
    assert [r[0] for r in paths.select(T.matches_mask(F.col("p"), "*.md")).collect()] == [True, True, False]
    dirty = spark.createDataFrame([(" a\r\nb\x00\n\n\n\nc ",)], "t string")
    assert dirty.select(T.clean(F.col("t"))).first()[0] == "a\nb\n\nc"


def test_markdown_sections(spark):
    text = "intro\n# One\nx\n## Two ##\ny\n```\n# no heading\n```\n#### deep\nz\nSet\n---\nq\n# Last\nw"
    rows = parsing.markdown_units(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).orderBy("unit").collect()
    assert [r["section"] for r in rows] == ["", "One", "One › Two", "One › Set", "Last"]
    assert "# no heading" in rows[2]["text"] and "#### deep" in rows[2]["text"] and rows[3]["text"] == "Set\nq"


def test_html(spark):
    body = "<html lang='de'><head><title> A  b </title><meta name='author' content=' Ann '><meta property='article:published_time' content='2024-02-03T10:00'></head><nav><a href='/x'>x</a></nav>"
    body += "<article><h1>Head  ing</h1><p>one <b>two</b></p><pre>\n a\n  b</pre><ul><li>i<li>j</ul><table><tr><td>1<td>2</table><a href='y#z'>y</a><a href='mailto:q'>q</a>" + "z" * 200
    rows = [(1, "https://h.org/d/e", body + "<h2>Sub</h2>more</article><p>out"), (2, None, "<p>a"), (3, None, None), (4, "http://h", "</nav></article><h1>t</h1>b<footer>f</footer> <main>short</main>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in parsing.html_pages(pages).collect()}
    one = got[1]
    assert (one["title"], one["lang"], one["links"], one["doc_date"], one["properties"]["author"]) == ("A b", "de", ["https://h.org/d/y"], "2024-02-03", "Ann")
    assert one["text"].startswith("Head ing\n\none two\n\n```\n\n a\n  b\n```\n\n- i\n- j\n\n| 1 | 2")
    assert "| 1 | 2" in one["text"] and "out" not in one["text"] and one["text"].endswith("Sub\n\nmore")
    assert got[2]["text"] == "a" and (got[3]["text"], got[3]["title"], got[3]["links"]) == ("", "", [])
    assert (got[4]["title"], got[4]["text"]) == ("t", "t\n\nb\n\nshort")
    units = {(r["page_id"], r["section"]): r["text"] for r in parsing.html_units(pages).collect()}
    assert units[1, "Head ing › Sub"] == "Sub\nmore" and units[1, "Head ing"].startswith("Head ing\none two\n\n") and units[2, ""] == "a"


@pytest.mark.parametrize("cfg", [chunking.Chunking(max_chunk_tokens=60, min_chunk_tokens=10), chunking.Chunking("fixed", chunk_size_tokens=50, chunk_overlap_tokens=10)])
def test_chunks_cover_and_fit(spark, cfg):
    text = "\n\n".join(" ".join(f"word{i}{j}." if j % 7 == 6 else f"word{i}{j}" for j in range(i * 9 % 90 + 5)) for i in range(30)) + "\n" + "x" * 900
    rows = chunking.chunk(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id bigint, text string"), cfg).orderBy("doc_id", "seq").collect()
    covered = set()
    for r in rows:
        s, e = r["char_start"], r["char_end"]
        assert r["doc_id"] == 1 and text[s:e] == r["text"] == r["text"].strip() and e > s
        covered |= set(range(s, e))
        assert cfg.method == "fixed" or r["tokens"] <= 60
    assert all(c.isspace() for i, c in enumerate(text) if i not in covered)
    if cfg.method == "fixed":
        assert any(a["char_end"] > b["char_start"] for a, b in zip(rows, rows[1:]))


def tokens(t):
    cyr = len(re.findall("[А-Яа-яЁё]", t))
    return max(1, math.ceil(cyr / 2.5 + (len(t) - cyr) / 4)) if t else 0


def packed(parts, most, smaller):
    """Neighbours joined while the text from the first to the last of them fits; too long ones give way to ``smaller`` parts."""
    out, open_ = [], False
    for text, at in parts:
        if tokens(text) > most:
            out, open_ = out + smaller(text, at), False
        elif open_ and tokens(DOC[out[-1][1] : at + len(text)]) <= most:
            out[-1] = (DOC[out[-1][1] : at + len(text)], out[-1][1])
        else:
            out, open_ = [*out, (text, at)], True
    return out


def found(pattern, text, at):
    return [(m[0].strip(), at + m.start() + len(m[0]) - len(m[0].lstrip())) for m in re.finditer(pattern, text) if m[0].strip()]


def test_structure_chunks_by_brute_force(spark):
    """Paragraphs, lines and sentences by patterns over texts without fences, packed and joined by the rules."""
    global DOC
    rng = random.Random(4)
    for most, least in ((50, 8), (80, 40)):
        texts = ["".join(" ".join(rng.choice("слово alpha beta. gamma! дом? y.) z".split()) for _ in range(rng.randrange(1, 40))) + rng.choice(["\n", "\n\n", " "]) for _ in range(rng.randrange(1, 25))).strip() for _ in range(25)]
        rows = chunking.chunk(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), chunking.Chunking(max_chunk_tokens=most, min_chunk_tokens=least)).orderBy("doc_id", "seq").collect()
        for i, DOC in enumerate(texts):
            by_sentence = lambda t, at: packed(found(r"[^.!?…\n]+(?:[.!?…]+[\"»”)]*|$)", t, at), most, None)
            by_line = lambda t, at: packed(found(r"[^\n]+", t, at), most, by_sentence)
            pieces = [(DOC, 0)] if tokens(DOC) <= most else packed(found(r"(?:[^\n]+\n?)+", DOC, 0), most, by_line)
            want = pieces[:1]
            for text, at in pieces[1:]:
                both = DOC[want[-1][1] : at + len(text)]
                if min(tokens(want[-1][0]), tokens(text)) < least and tokens(both) <= most:
                    want[-1] = (both, want[-1][1])
                else:
                    want.append((text, at))
            assert [(r["text"], r["char_start"]) for r in rows if r["doc_id"] == i] == want


def test_window_chunks_by_rule(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word ", "слово ", "end. ", "line\n", "par\n\n", "x" * 30]) for _ in range(rng.randrange(5, 300))) for _ in range(20)]
    cfg = chunking.Chunking("fixed", chunk_size_tokens=50, chunk_overlap_tokens=15)
    rows = chunking.chunk(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), cfg).orderBy("doc_id", "seq").collect()
    for i, t in enumerate(texts):
        size, overlap, want = max(50, int(50 * len(t) / tokens(t))), int(15 * len(t) / tokens(t)), []
        at = len(t) - len(t.lstrip())
        while at < len(t):
            end = len(t)
            if at + size < len(t):
                low, end = at + int(size * 0.6), at + size
                stops = [max((m.end() for m in re.finditer(p, t[low:end])), default=0) for p in ("\n\n", "\n", r"[.!?…][\"»”)]*\s", " ")]
                end = low + next((x for x in stops if x), end - low)
            want.append((t[at:end].strip(), at))
            if end == len(t):
                break
            back = end - overlap
            if back > at:
                first = re.search(r"[.!?…\n][\"»”)]*\s+", t[back:end])
                back += first.end() if first else t[back:end].find(" ") + 1
            at = back if back > at else end
            at += len(t[at:]) - len(t[at:].lstrip())
        assert [(r["text"], r["char_start"]) for r in rows if r["doc_id"] == i] == [x for x in want if x[0]]


def test_units_carry_their_section(spark):
    """Chunks take section and page of the unit in which they begin; atomic units stay alone; offsets count the joined text."""
    units = [(1, 0, "Intro.", "A", 1, False), (1, 1, "More words here.", "B", 2, False), (1, 2, "Record", "C", 3, True), (1, 3, "t" * 500 + " u" * 200, "D", 4, False), (1, 4, None, "E", 5, False), (2, 0, " ", "F", 6, False)]
    df = spark.createDataFrame(units, "doc_id bigint, unit int, text string, section string, page int, atomic boolean")
    rows = chunking.chunk_units(df, chunking.Chunking(max_chunk_tokens=60, min_chunk_tokens=20)).orderBy("seq").collect()
    full = "\n\n".join(u[2] for u in units[:4])
    assert all(full[r["char_start"] : r["char_end"]] == r["text"] for r in rows)
    assert [(r["text"], r["section"], r["page"]) for r in rows[:2]] == [("Intro.\n\nMore words here.", "A", 1), ("Record", "C", 3)] and {r["section"] for r in rows[2:]} == {"D"}


def test_chunking_rules():
    for bad in ({"chunk_size_tokens": 10}, {"chunk_overlap_tokens": 500}, {"min_chunk_tokens": 1000}, {"max_chunk_tokens": True}, {"method": "none"}):
        with pytest.raises(ValueError):
            chunking.Chunking(**bad)
    assert chunking.Chunking().merged({"method": "fixed", "chunk_size_tokens": None}, None, {"chunk_size_tokens": 200}) == chunking.Chunking("fixed", chunk_size_tokens=200)
    with pytest.raises(ValueError):
        chunking.Chunking().merged({"size": 1})


def test_paragraph_spans(spark):
    text = " a\nb \n\n\n```\nx\n\ny\n```\n \n  c"
    rows = chunking.paragraph_spans(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id bigint, text string")).orderBy("doc_id", "paragraph").collect()
    assert [text[r["char_start"] : r["char_end"]] for r in rows] == ["a\nb", "```\nx\n\ny\n```", "c"] and [r["paragraph"] for r in rows] == [0, 1, 2]


def test_collapse_is_greedy(spark):
    rows = [(1, 1, "a", "h1", [1.0, 0.0]), (1, 2, "b", "h1", [0.0, 1.0]), (1, 3, "c", "h2", [0.999, 0.0447]), (1, 4, "d", "h3", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id int, rank int, key string, hash string, v array<double>")
    assert [r["key"] for r in retrieval.collapse(df).orderBy("rank").collect()] == ["a", "d"]


@pytest.mark.parametrize("method", ["none", "heuristic"])
def test_retrieve_collapses_near_copies(spark, method, tmp_path):
    """Near copies of one text by other hashes, all above 0.97, stand once; so do the counts of the stages."""
    text = " ".join(f"{a}{b}lorem" for a in "abcdefgh" for b in "klmnopqr")
    rows = [(i, f"{text} tail{i}") for i in range(30)] + [(100, text.upper()), (101, "aklorem other words"), (102, "alorem blorem house"), (103, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id bigint, text string, lang string")
    asked = retrieval.asked(spark.createDataFrame([(1, text)], "item_id bigint, text string"), "item_id")
    got, counts = retrieval.retrieve(retrieval.embedded(docs), asked, method=method, candidate_k=34, key="doc_id")
    assert {r["doc_id"] for r in got.collect()} == {100, 101, 102, 103} and counts.first()["after_dedup"] == 4
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    q = catalog.queries()
    assert tuple(q["retrieval_stage_counts"](spark, str(tmp_path)).first()) == (1, 20, 20, 1, 1, 1)
    assert q["bm25_candidates"](spark, str(tmp_path)).count() == 1
    ours = q["near_dup_collapse"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert [tuple(r) for r in ours] == con.sql(catalog.oracle_sql()["near_dup_collapse"]).fetchall() == [(1, 100, 1)]


def test_sync(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "source_key bigint, raw_hash string")
    two = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "source_key bigint, raw_hash string")
    assert {tuple(r) for r in sync.sync_diff(one, two).collect()} == {(1, "new"), (2, "unchanged"), (3, "changed"), (4, "deleted")}
    assert sync.upsert(two, one, ["source_key"]).count() == 4 and sync.cascade_delete(two, one, "source_key").count() == 1


def test_stream_and_files(spark, tmp_path):
    from lorespark.sources.files import decoded, scan
    from lorespark.streaming.ingest import ingest

    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_bytes("﻿привет".encode())
    (tmp_path / "in" / "b.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "in" / ".git" / "c.md").write_text("no")
    files = scan(spark, str(tmp_path / "in"))
    assert {r[0] for r in files.select(decoded(F.col("content"))).collect()} == {"привет"} and files.count() == 2
    seen = []
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) in (2, 3)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 100 and set(e.oracle_sql()) <= set(e.queries())


def test_rst_units(spark):
    text = "=====\nTitle\n=====\nintro\n\nOne\n---\na\n\nTwo\n---\nb\nSub\n~~~\nc d e\n--\n"
    rows = parsing.rst_units(spark.createDataFrame([(1, text), (2, None), (3, "T\n===\nOther\n===\nx")], "doc_id bigint, text string")).orderBy("doc_id", "unit").collect()
    assert [(r["section"], r["text"]) for r in rows] == [
        ("Title", "Title\nintro"), ("Title › One", "One\na"), ("Title › Two", "Two\nb"), ("Title › Two › Sub", "Sub\nc d e\n--"), ("T", "T\nOther\n===\nx"),
    ]


CODE = {
    "a.py": ("import os\n\n# about f\n@dec\ndef f():\n    pass\n\nclass A:\n    x = 1\n    def m(self):\n        pass\n\nif 1:\n    f()\n", ["", "f", "A", "A › m", ""]),
    "a.kt": ("package x\n\n/** doc */\n@Ann\ndata class Foo(val a: Int) {\n    private fun bar(): Int {\n        return object : X {}\n    }\n}\n\nfun top() = 1\n", ["", "Foo", "Foo › bar", "top"]),
    "A.java": ("package x;\n\npublic class A {\n    // note\n    @Override\n    public int go(int a) {\n        return foo(a);\n    }\n    interface B {\n    }\n}\n", ["", "A", "A › go", "A › B"]),
    "a.ts": ("import x from 'y'\nexport class S {\n  async run(a: number): Promise<void> {\n    if (a) {\n    }\n  }\n}\nexport const k = 1\n", ["", "S", "S › run", "k"]),
    "a.go": ("package m\n\n// T is\ntype T struct {\n}\n\nfunc (t *T) Do() {\n}\nfunc main() {}\n", ["", "T", "T.Do", "main"]),
    "a.sql": ("-- first\nCREATE TABLE t (\n  a int\n);\n\ncreate or replace view v as\nselect 1;\nselect a from t;\n", ["CREATE TABLE T", "CREATE OR REPLACE VIEW V", "SELECT A"]),
    "a.yaml": ("# c\na: 1\nb:\n  c: 2\n---\nd: 3\n---\ne: 4\n", ["a", "b", "d", "документ 2 › e"]),
    "a.json": ('{"a": 1, "b": [1]}', ["a", "b"]),
    "b.json": ("[1, {}]", ["[0]", "[1]"]),
    "a.toml": ("x = 1\n# t\n[t]\ny = 2\n[[u.v]]\nz = 1\n", ["", "t", "u.v"]),
    "more.kt": ("@file:X\nsealed interface I<T : Any> {\n    companion object {\n    }\n    suspend fun <T> List<T>.each(f: () -> Unit)\n    typealias Q = Int\n}\nfun interface Run {\n}\ninline fun <reified T> Map<String, T>.pick() = 1\nobject One\nfun `a name`() {}\nval x = 1\n", ["I", "I › companion", "I › each", "Run", "pick", "One", "a name"]),
    "More.java": ("@Deprecated(since = \"1\")\npublic non-sealed class M<T extends Map<String, List<T>>> {\n    private final int x = call(1);\n    public <R> Map<R, T> turn(\n        int a) {\n        return new Foo(1) {\n    }\n    M(int a) {\n    }\n}\n@interface Note {\n}\nrecord P(int a) {\n}\n", ["M", "M › turn", "Note", "P"]),
    "more.js": ("export default function* gen() {\n}\nasync function f() {}\nclass C {\n  static async *walk(a) {\n    if (x) {\n  }\n  get size() {\n  }\n  while (1) {\n}\nexport default class extends C {}\nlet a = 1, b\nfoo(1)\n", ["gen", "f", "C", "C › walk", "C › size", "extends", "a"]),
    "more.go": ("func (s *Set[K]) Add(k K) {\n}\nfunc (t T) Get() int {\n}\nfunc Map[T any](x T) {\n}\ntype E interface {\n}\n", ["Set.Add", "T.Get", "Map", "E"]),
    "more.yml": ("\"q k\": 1\na:b: 2\n- x: 1\nlist :\n  - 1\nurl: http://x\n", ["q k", "list", "url"]),
    "more.toml": ("[ a . b ]\nx = [\n[1]\n]\n", ["a . b", "1"]),
    "more.py": ("x = 1\ny = 2\n\nasync def g():\n    pass\nz = 1\nw = 2\n@d\nclass K:\n    @p\n    def a(self): pass\n    class In:\n        def deep(self): pass\ndef h(): pass\n", ["", "g", "", "K", "K › a", "K › In", "h"]),
    "a.sh": ("echo 1\n", [""]), "bad.py": ("def (", [""]), "bad.json": ("{", [""]), "empty.py": ("", []),
}


def test_code_units(spark):
    from lorespark.operators import code

    rows = [(i, n, t) for i, (n, (t, _)) in enumerate(CODE.items())] + [(90, "null.py", None), (91, None, "x")]
    got = code.code_units(spark.createDataFrame(rows, "doc_id bigint, filename string, text string")).orderBy("doc_id", "unit").collect()
    for i, (name, (_, sections)) in enumerate(CODE.items()):
        assert [r["section"] for r in got if r["doc_id"] == i] == sections, name
    assert {r["text"] for r in got if r["section"] == "f" and r["doc_id"] == 0} == {"# about f\n@dec\ndef f():\n    pass"}
    assert [r["text"] for r in got if r["doc_id"] >= 90] == ["x"]


def zipped(parts: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office(spark):
    from lorespark.operators.office import A, P, R, S, W, office_files, office_units

    w, a, p, s, r = (x[1:-1] for x in (W, A, P, S, R))
    para = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cells = "".join(f"<w:tc>{para(t)}</w:tc>" for t in ("x", "x", "y"))
    body = para("Rules", "Heading1") + para("one") + para("Part", "Heading2") + para("item", "ListBullet") + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>"
    core = '<c xmlns:d="d"><d:creator>Ann</d:creator><d:modified>2024-02-03T00:00:00Z</d:modified></c>'
    names = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Heading1", "heading 1"), ("Heading2", "Заголовок 2"), ("ListBullet", "List Bullet")))
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{w}">{names}</w:styles>', "docProps/core.xml": core})
    shape = lambda t, kind: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    space = f'xmlns:p="{p}" xmlns:a="{a}" xmlns:r="{r}"'
    rel = lambda i, kind, to: f'<Relationships><Relationship Id="{i}" Type="t/{kind}" Target="{to}"/></Relationships>'
    pptx = zipped({
        "ppt/presentation.xml": f'<p:x {space}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:x>', "ppt/_rels/presentation.xml.rels": rel("r1", "slide", "slides/s1.xml"),
        "ppt/slides/s1.xml": f"<p:x {space}>{shape('text', 'body')}{shape('Plan', 'title')}</p:x>", "ppt/slides/_rels/s1.xml.rels": rel("n", "notesSlide", "../notes/n1.xml"),
        "ppt/notes/n1.xml": f"<p:x {space}>{shape('say it', 'body')}</p:x>",
    })
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row><row/><row><c r="A3"><v>2.0</v></c><c r="B3"><v>2.5</v></c><c r="C3" s="1"><v>45292</v></c></row>'
    xlsx = zipped({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel("r1", "worksheet", "worksheets/s.xml"),
        "xl/worksheets/s.xml": f'<worksheet xmlns="{s}"><sheetData>{rows}</sheetData></worksheet>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>size</t></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{s}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })
    files = [("a", "docx", docx), ("b", "pptx", pptx), ("c", "xlsx", xlsx), ("d", "docx", b"no"), ("e", "pptx", None), ("f", "text", b"x")]
    read = office_files(spark.createDataFrame(files, "path string, kind string, content binary"))
    about = {x["path"]: (x["title"], x["author"], x["doc_date"], x["error"] is None) for x in read.collect()}
    assert about == {"a": ("Rules", "Ann", "2024-02-03", True), "b": ("Plan", None, None, True), "c": (None, None, None, True), "d": (None, None, None, False), "e": (None, None, None, False)}
    assert [tuple(x)[2:] for x in office_units(read).orderBy("path", "unit").collect()] == [
        ("Rules", None, "Rules\none"), ("Rules › Part", None, "Part\n- item\nx | y"), ("Слайд 1: Plan", 1, "Plan\ntext\nЗаметки: say it"), ("Лист «One»", 1, "size | when\nsize: 2; Столбец 2: 2.5; when: 2024-01-01"),
    ]


def test_filters(spark):
    from lorespark.operators.filters import condition

    rows = [(1, "en", None, '{"a": "2"}', "{}", "{}"), (2, "ru", "2024-01-02", "{}", '{"a": null, "b.c": true}', '{"a": 2}'), (3, None, "2024-02-01", None, "bad", '{"a": "x"}')]
    df = spark.createDataFrame(rows, "document_id bigint, language string, doc_date string, chunk_metadata string, metadata string, properties string")
    found = lambda **f: [r[0] for r in df.where(condition(f)).orderBy("document_id").collect()]
    assert found() == [1, 2, 3] and found(languages=["en"]) == [1] and found(languages=[]) == [1, 2, 3] and found(document_ids=[1, 3]) == [1, 3]
    assert found(doc_date={"gte": "2024-01-02"}) == [2, 3] and found(doc_date={"lte": "2024-01-31"}) == [2]
    assert found(metadata={"a": 2}) == [2] and found(metadata={"a": "2"}) == [1] and found(metadata={"a": ["x", 2]}) == [2, 3]
    assert found(metadata={"b.c": 1}) == [2] and found(metadata={"b.c": True}) == [2] and found(metadata={"a": []}) == []
    for bad in ({"x": 1}, {"languages": "en"}, {"doc_date": {"eq": 1}}, {"metadata": {"a b": 1}}):
        with pytest.raises(ValueError):
            condition(bad)
