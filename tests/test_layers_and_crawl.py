"""Settings by layer and row, long texts in linear time, and crawls with masks and a budget."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorespark.operators import chunking, crawling

SETTINGS = [
    (1, None, None, None), (2, '{"method":"fixed"}', '{"chunk_size_tokens":200,"method":null}', None), (3, "{}", '{"max_chunk_tokens":true}', None), (4, '{"max_chunk_tokens":"5"}', None, None), (5, "[1]", None, None),
    (6, '{"x":1}', None, None), (7, '{"chunk_overlap_tokens":400}', None, None), (8, '{"method":"odd"}', None, None), (9, '{"min_chunk_tokens":1.5}', None, None), (10, "nonsense", None, None), (11, '{"method":3}', None, None),
    (12, '{"max_chunk_tokens":null}', '{"max_chunk_tokens":300}', '{"max_chunk_tokens":200,"min_chunk_tokens":10}'),
]


def test_layers(spark):
    got = {r["id"]: r for r in chunking.layered(spark.createDataFrame(SETTINGS, "id int, a string, b string, c string"), ["a", "b", "c"]).collect()}
    assert {i: tuple(r["chunking"]) for i, r in got.items() if r["chunking"]} == {1: ("structure", 600, 80, 1000, 100), 2: ("fixed", 200, 80, 1000, 100), 12: ("structure", 600, 80, 300, 10)}
    why = {i: r["chunking_error"] for i, r in got.items() if not r["chunking"]}
    assert why[3] == why[4] == why[9] == "sizes are whole numbers" and why[5] == why[10] == "settings are a JSON object" and why[6] == "unknown settings"
    assert why[7] == "sizes are out of range" and why[8] == "no such method" and why[11] == "the method is a text" and len(why) == 9


def test_one_plan_many_configurations(spark):
    rng = random.Random(5)
    text = lambda: "\n".join(" ".join(rng.choice(["alpha", "beta.", "gamma", "Дельта!", "eps"]) for _ in range(rng.randrange(3, 40))) + rng.choice(["", "\n"]) for _ in range(30))
    docs = [(i, None if i % 3 == 0 else f"s{i % 3}", "c", '{"method":"fixed"}' if i % 4 == 0 else None, text()) for i in range(12)]
    df = spark.createDataFrame(docs, "document_id bigint, source_id string, collection string, settings string, text string")
    sources = spark.createDataFrame([("s1", '{"max_chunk_tokens":120}'), ("s2", None)], "source_id string, settings string")
    collections = spark.createDataFrame([("c", '{"min_chunk_tokens":20,"max_chunk_tokens":200,"chunk_size_tokens":100,"chunk_overlap_tokens":10}')], "collection string, settings string")
    rows = chunking.effective(df, sources, collections)
    held = {r["document_id"]: r["chunking"].asDict() for r in rows.collect()}
    assert held[4] == {"method": "fixed", "chunk_size_tokens": 100, "chunk_overlap_tokens": 10, "max_chunk_tokens": 120, "min_chunk_tokens": 20}
    units = lambda r: r.select(F.col("document_id").alias("doc_id"), F.lit(0).alias("unit"), "text", *[c for c in r.columns if c == "chunking"])
    got = sorted(map(tuple, chunking.chunk_units(units(rows)).collect()))
    want = []
    for values in {tuple(sorted(v.items())) for v in held.values()}:
        mine = [i for i, v in held.items() if tuple(sorted(v.items())) == values]
        want += map(tuple, chunking.chunk_units(units(df.where(F.col("document_id").isin(mine))), chunking.Chunking(**dict(values))).collect())
    assert got == sorted(want) and len({tuple(sorted(v.items())) for v in held.values()}) == 4
    asked = spark.createDataFrame([(4, "{}"), (5, '{"min_chunk_tokens":5}'), (8, None)], "document_id bigint, settings string")
    again = {r["document_id"]: r["chunking"].asDict() for r in chunking.effective(chunking.reindexed(df, asked), sources, collections).collect()}
    assert set(again) == {4, 5, 8} and again[4]["method"] == "structure" and again[5]["min_chunk_tokens"] == 5 and again[8] == held[8]


@pytest.mark.parametrize("method", ["fixed", "structure"])
def test_ten_megabytes(spark, method):
    """One line of ten megabytes, and its chunks are the text between their offsets."""
    rng = random.Random(1)
    piece = " ".join(rng.choice(["alpha", "beta", "gamma.", "delta", "привет"]) for _ in range(20_000))
    text = (piece + " ") * (10_000_000 // len(piece))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    rows = chunking.chunk(df, chunking.Chunking(method)).collect()
    assert time.time() - began < 120 and len(rows) > 2000
    assert all(r["text"] == text[r["char_start"] : r["char_end"]] for r in rows) and rows[-1]["char_end"] == len(text.rstrip())


LINKS = {
    "http://a.x/": ["http://a.x/1#f", "http://a.x/2", "http://b.x/9", "http://a.x/skip/3", "http://a.x/1"], "http://a.x/1": ["http://a.x/5", "http://a.x/4"],
    "http://a.x/2": ["http://a.x/4", "http://a.x/6", "http://A.X/7", None], "http://a.x/6": ["http://a.x/8"],
}


@pytest.fixture(scope="module")
def site(spark):
    links = spark.createDataFrame([(s, d, i) for s, ds in LINKS.items() for i, d in enumerate(ds)], "src string, dst string, at int")
    pages = spark.createDataFrame([(f"http://a.x/{n}", n != "5") for n in ("", "1", "2", "4", "5", "6", "7", "8", "skip/3")] + [("http://b.x/9", True)], "url string, ok boolean")
    return pages, links


def asked(site, *args, **given):
    rows = crawling.crawl("http://a.x/#top", *site, *args, **given).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["url"].removeprefix("http://a.x/"), r["depth"], r["fetched"]) for r in rows]


def test_crawl(site, monkeypatch):
    whole = [("", 0, True), ("1", 1, True), ("2", 1, True), ("5", 2, False), ("4", 2, True), ("6", 2, True), ("http://A.X/7", 2, False)]
    assert asked(site, 2, 100, exclude=["**/skip/*"]) == whole
    assert asked(site, 0, 100) == whole[:1]
    assert asked(site, 2, 4, exclude=["**/skip/*"]) == whole[:5]  # the failure does not count, the fourth success ends it
    assert asked(site, 3, 100, include=["http://a.x/*", "http://b.x/*"], exclude=["**/skip/*"], same_host=False)[3] == ("http://b.x/9", 1, True)
    assert asked(site, 9, 100, include=["**/2", "**/6"]) == [("", 0, True), ("2", 1, True), ("6", 2, True)]
    monkeypatch.setattr(crawling, "BLOCK", 1)
    assert asked(site, 2, 100, exclude=["**/skip/*"]) == whole and asked(site, 2, 2, exclude=["**/skip/*"]) == whole[:2]
    with pytest.raises(ValueError):
        crawling.crawl("http://a.x/5", *site, 1, 5)
