import random

from lorespark.functions import text as T
from lorespark.operators import listing, search, sync
from pyspark.sql import functions as F


def test_search_by_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vector = lambda: [r.random() - 0.5 for _ in range(4)]
    chunks = [(i, i % 7, i % 5 != 0, vector() if i % 11 else None, "b" if i % 3 == 0 else "a") for i in range(60)]
    chunks += [(60, 1, True, [1.0], "a"), (61, None, True, vector(), "a"), (62, 1, True, chunks[1][3], "a")]
    documents = [(d, "c" if d < 5 else "gone", "fr" if d % 2 else None, d != 4) for d in range(7)]
    queries = [(q, "a", vector()) for q in range(7)]
    made = search.index(
        spark.createDataFrame(chunks, "chunk_id int, document_id int, enabled boolean, embedding array<double>, model string"),
        spark.createDataFrame(documents, "document_id int, collection string, language string, enabled boolean"),
        spark.createDataFrame([("c", "a"), ("other", "b")], "collection string, model string"),
    )
    asked = spark.createDataFrame(queries, "query_id int, model string, q array<double>")
    own = {d: lang for d, c, lang, on in documents if c == "c" and on}
    found = [(c, v) for c, d, on, v, m in chunks if on and v and m == "a" and d in own and own[d] == "fr" and len(v) == 4]
    want = []
    for q, _, v in queries:
        ranked = sorted((-sum(x * y for x, y in zip(v, u)), c) for c, u in found)
        want += [(q, i + 1, c) for i, (s, c) in enumerate(ranked[:5]) if -s >= 0.01]
    for block in (1000, 2):
        monkeypatch.setattr(search, "BLOCK", block)
        got = search.best(search.scores(made, asked, {"languages": ["fr"]}), 5, 0.01).select("query_id", "rank", "chunk_id").collect()
        assert sorted(map(tuple, got)) == want and want
    assert search.best(search.scores(made.limit(0), asked), 5).count() == 0


def test_texts_for_models(spark):
    rows = spark.createDataFrame([("T", "S", "x" * 9), ("", None, "y"), (None, "S", "z"), ("T", "", "w")], "t string, s string, x string")
    got = rows.select(search.rerank_text(F.col("t"), F.col("s"), F.col("x"), 8), search.embedding_text(F.col("t"), F.col("s"), F.col("x"))).collect()
    assert [r[0] for r in got] == ["T › S\nxx", "y", "S\nz", "T\nw"]
    assert [r[1] for r in got] == ["T\nS\n\n" + "x" * 9, "\n\ny", None, "T\n\nw"]
    names = spark.createDataFrame([("p/m/x",), ("p/",), ("/m",), ("bare",), (None,)], "m string")
    assert [r[0] and tuple(r[0]) for r in names.select(T.model_parts(F.col("m"))).collect()] == [("p", "m/x"), None, None, None, None]


def test_addresses_and_names(spark):
    urls = [" a.org/x ", "//a.org", "HTTP://a.org:80/", "ftp://a.org", "https://", "http://:80/", "http://u:p@a.org", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.normalize_url(F.col("u"))).collect()]
    assert got == ["https://a.org/x", "https://a.org", "HTTP://a.org:80/", None, None, None, "http://u:p@a.org", None, None]
    texts = [("a/b: c", "x", "text"), (None, "  First\nsecond", "markdown"), ("", " \n ", "text"), ("///", "x", "pdf"), ("п" * 99, "x", "text")]
    rows = spark.createDataFrame(texts, "t string, x string, f string")
    assert [r[0] for r in rows.select(T.inline_filename(F.col("t"), F.col("x"), F.col("f"))).collect()] == ["a_b_ c.txt", "First.md", None, None, "п" * 80 + ".txt"]


def test_listings_of_nothing(spark):
    none = spark.createDataFrame([], "collection string, status string, chunk_count int, size_bytes bigint")
    rows = listing.collection_stats(spark.createDataFrame([("a",)], "collection string"), none).collect()
    assert [(r["collection"], r["documents"], r["size_bytes"], r["status"]) for r in rows] == [("a", 0, 0, "empty")]
    cache = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), (None, 1, "none")], "key string, at int, v string")
    assert sorted(r["v"] for r in sync.newest(cache, ["key"], ["at"]).collect()) == ["new", "none"]


def test_each_missing_key_is_embedded_once(spark):
    wanted = spark.createDataFrame([(1, "a", "A"), (2, "a", "A"), (3, "b", "B")], "id int, key string, text string")
    cache = spark.createDataFrame([("b", [1.0])], "key string, v array<double>")
    seen = []
    embed = lambda rows: seen.append(rows.count()) or rows.select("key", F.array(F.lit(2.0)).alias("v"))
    got = search.embedded(wanted, cache, embed).select("id", "v", "cached").collect()
    assert sorted(map(tuple, got)) == [(1, [2.0], False), (2, [2.0], False), (3, [1.0], True)] and seen == [1]
