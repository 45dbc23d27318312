import math

import pytest
from lorespark.functions import text as T
from lorespark.functions.vectors import bag_of_words
from lorespark.operators import crawling, documents, parsing, retrieval, search, sync

TEXT = "doc_id bigint, text string"


def test_front_matter(spark):
    rows = [
        (1, "---\r\nTitle: \"A: b\"\r\nupdated: 2023-02-03 10:00\r\nkey: x\r\nkey: y\r\n- list: no\r\n  deep: no\r\nempty:\r\n...\r\n# H\r\nbody"), (2, "text\n---\ntitle: no\n---"), (3, None), (4, ""),
        (5, "---\n" + "k: v\n" * 60 + "---\nlate"), (6, "---\n---"), (7, "---\ntitle: open"),
    ]
    got = {r["doc_id"]: r for r in parsing.front_matter(spark.createDataFrame(rows, TEXT)).collect()}
    assert tuple(got[1])[1:] == ("A: b", "2023-02-03", {"key": "y"}, "# H\nbody")
    for n in (2, 3, 4, 5, 7):
        assert tuple(got[n])[1:] == (None, None, {}, rows[n - 1][1] or ""), n
    assert tuple(got[6])[1:] == (None, None, {}, "")


def test_files_of_all_kinds(spark):
    files = [
        (1, "a.md", "---\ntitle: t\n---\nintro\n# One\nx\n## Two\ny"), (2, "b.rst", "One\n===\nx"), (3, "c.html", "<h1>One</h1><p>x</p>"), (4, "d.jsonl", '{"id": 1, "text": "x"}\nbad\n{"id": 2, "text": "y"}'),
        (5, "e.txt", " x\x00\n\n\n\ny "), (6, "f.py", "def f():\n    return 1\n"), (7, "g.bin", "x"), (8, "h.txt", None), (9, "i.md", " \n"), (10, None, "x"),
    ]
    docs = spark.createDataFrame(files, "doc_id bigint, filename string, text string")
    units = documents.parse_documents(docs)
    got = {}
    for r in sorted(units.collect()):
        got.setdefault(r["doc_id"], []).append((r["section"], r["text"]))
    assert [s for s, _ in got[1]] == ["", "One", "One › Two"] and [s for s, _ in got[4]] == ["Запись 1", "Запись 2"]
    assert got[5] == [("", "x\n\ny")] and got[6][0][0] == "f" and got[2][0][0] == got[3][0][0] == "One" and set(got) == {1, 2, 3, 4, 5, 6}
    end = {r["doc_id"]: (r["units"], r["sections"], r["error"]) for r in documents.outcomes(docs, units).collect()}
    assert end[1] == (3, 2, None) and end[5] == (1, None, None) and end[7][2] == end[10][2] == documents.UNSUPPORTED and end[8] == end[9] == (0, None, documents.EMPTY)
    assert documents.parse_documents(docs.limit(0)).count() == documents.outcomes(docs.limit(0), units).count() == 0


def test_bm25_by_brute_force(spark):
    """Two queries over different candidates: the statistics are each query's own."""
    texts = {1: "red apple apple pie", 2: "green apple", 3: "", 4: None, 5: "blue sky red red red"}
    asked = {7: "red apple of the sea", 8: "apple", 9: "of the"}
    has = {7: (1, 2, 3, 4, 5), 8: (1, 2), 9: (1, 5)}
    found = spark.createDataFrame([(q, k, texts[k]) for q, ks in has.items() for k in ks], "query_id int, doc_id bigint, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]): r["bm25"] for r in retrieval.bm25(found, queries, "doc_id").collect()}
    assert set(got) == {(q, k) for q, ks in has.items() for k in ks}
    for q, ks in has.items():
        split = {k: (texts[k] or "").split() for k in ks}
        n, mean = len(ks), sum(len(split[k]) for k in ks if texts[k] is not None) / sum(texts[k] is not None for k in ks)
        for k, words in split.items():
            score = 0.0
            for term in [t for t in asked[q].split() if t not in ("of", "the")]:
                df, tf = sum(term in w for w in split.values()), words.count(term)
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
            assert got[q, k] == pytest.approx(score), (q, k)


def test_bag_vector_is_the_embedding(spark):
    texts = {1: "red Apple apple pie a of", 2: "", 3: None, 4: "ab", 5: "one two three " * 200}
    rows = spark.createDataFrame(list(texts.items()), TEXT)
    counts = {}
    for r in bag_of_words(rows.fillna(""), "doc_id", "text").collect():
        counts.setdefault(r["doc_id"], [0.0] * 256)[r["bucket"]] = float(r["n"])
    for r in retrieval.embedded(rows).collect():
        want = counts[r["doc_id"]]
        length = math.sqrt(sum(x * x for x in want))
        assert r["embedding"] == pytest.approx([x / length for x in want])


def test_limits_and_thresholds(spark):
    docs = retrieval.embedded(spark.createDataFrame([(i, f"apple number{i} " + " ".join(f"pear{i}{j}" for j in range(i)), "en" if i < 8 else "de") for i in range(1, 9)], TEXT + ", language string"))
    queries = retrieval.asked(spark.createDataFrame([(1, "apple pear11 pear21"), (2, "zzz qqq")], "item_id int, text string"), "item_id")
    run = lambda **given: [[tuple(r) for r in x.collect()] for x in (lambda rc: (rc[0].select("query_id", "rank", "doc_id", "score", "rerank_score").orderBy("query_id", "rank"), rc[1].orderBy("query_id")))(retrieval.retrieve(docs, queries, key="doc_id", **given))]
    found, counts = run(method="heuristic", threshold=0.2)
    mine = [r for r in found if r[0] == 1]
    assert [r[1] for r in mine] == list(range(1, len(mine) + 1)) and counts[0][1] == 8 and counts[0][5] == len(mine) <= 5
    line = mine[1][4]
    again, counts = run(method="heuristic", threshold=0.2, rerank_threshold=line)
    assert [r for r in again if r[0] == 1] == [r for r in mine if r[4] >= line] and counts[0][4] >= counts[0][5] >= 2
    plain, _ = run(filters={"languages": ["de"]})
    assert {r[2] for r in plain} == {8} and all(r[4] is None for r in plain)
    none, counts = run(threshold=1.5)
    assert none == [] and counts == [(1, 8, 0, 0, 0, 0), (2, 8, 0, 0, 0, 0)]
    empty, counts = retrieval.retrieve(docs.limit(0), queries, key="doc_id", method="heuristic")
    assert empty.count() == 0 and [tuple(r)[1:] for r in counts.collect()] == [(0,) * 5] * 2
    for bad in ({"top_k": 51}, {"candidate_k": 201}, {"candidate_k": 3}, {"method": "model"}):
        with pytest.raises(ValueError):
            retrieval.retrieve(docs, queries, **bad)


def test_title_and_section_are_reranked(spark):
    docs = retrieval.embedded(spark.createDataFrame([(1, "same words here", "Apple", ""), (2, "same words there", None, "")], "doc_id bigint, text string, title string, section string"))
    queries = retrieval.asked(spark.createDataFrame([(1, "apple same")], "item_id int, text string"), "item_id")
    got = retrieval.retrieve(docs, queries, method="heuristic", key="doc_id")[0].orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2] and got[0]["rerank_score"] > got[1]["rerank_score"] and got[0]["title"] == "Apple"


def test_results_are_shaped(spark):
    found = spark.createDataFrame(
        [(1, 10, 100, "c", "t", "s", 0, 0.123456, 0.2), (1, 11, 101, "c", "t", "s", 1, 0.9, 0.1), (2, 10, 100, "c", "t", "s", 0, 0.5, None)],
        "query_id int, chunk_id int, document_id int, collection string, text string, section string, seq int, score double, rerank_score double",
    )
    about = spark.createDataFrame([(100, "", "a.md"), (101, "T", "b.md")], "document_id int, title string, filename string")
    named = spark.createDataFrame([("c", "Name")], "collection string, name string")
    got = {(r["query_id"], r["rank"]): r for r in search.shaped(found, about, named).collect()}
    assert [got[x]["chunk_id"] for x in sorted(got)] == [10, 11, 10] and [got[x]["score"] for x in sorted(got)] == [0.2, 0.1, 0.5]
    assert got[1, 1]["document"]["title"] == "a.md" and got[1, 2]["document"]["title"] == "T" and got[2, 1]["collection"]["name"] == "Name" and got[1, 1]["vector_score"] == 0.1235


def test_term_rows_are_terms(spark):
    rows = [(1, "The Running of a b2 Привет-мирное и Ёлка apples"), (2, ""), (3, None), (4, "a")]
    docs = spark.createDataFrame(rows, TEXT)
    whole = docs.select("doc_id", T.terms(docs["text"]).alias("t")).collect()
    assert sorted(tuple(r) for r in T.term_rows(docs, "doc_id").collect()) == sorted((r["doc_id"], t) for r in whole for t in r["t"] or [])


def test_crawl_in_order_of_discovery(spark):
    links = spark.createDataFrame([("0", "5", 0), ("0", "4", 1), ("5", "1", 0), ("1", "0", 0)], "src string, dst string, at int")
    pages = spark.createDataFrame([(x, True) for x in "0145"], "url string, ok boolean")
    assert [(r["url"], r["depth"]) for r in crawling.crawl("0", pages, links, 3, 3, same_host=False).orderBy("place").collect()] == [("0", 0), ("5", 1), ("4", 1)]
