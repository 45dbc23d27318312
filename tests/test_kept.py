"""Snapshot tables and synchronised state: dead and repeated runs, conflicts, pinned readers, streams that are replayed."""

import datetime
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lorespark.operators import sync
from lorespark.sources.raw import RawStore
from lorespark.sources.snapshots import Catalogue, Change, Conflict
from lorespark.streaming import ingest

CHUNKS = "document_id bigint, seq int, origin string, text string"


@pytest.fixture()
def state(spark, tmp_path):
    return Catalogue(spark, f"file://{tmp_path}/c", {"chunks": ("document_id", CHUNKS), "documents": ("document_id", "document_id bigint, title string")}, buckets=4)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def chunks(spark, *r):
    return spark.createDataFrame(list(r), CHUNKS)


def test_versions(spark, state):
    assert state.versions() == [] and state.read("chunks").count() == 0 and state.manifest() is None
    first = chunks(spark, (1, 0, "auto", "a"), (1, 1, "manual", "m"), (2, 0, "auto", "b"), (None, 0, "auto", "n"))
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "document_id bigint, title string")
    assert state.apply("r1", {"chunks": Change(rows=first), "documents": Change(rows=titles)}) == 1
    pinned = state.read("chunks", 1)
    change = Change(rows=chunks(spark, (1, 0, "auto", "A2"), (1, 2, "auto", "A3")), keep=F.col("origin") == "manual")
    assert state.apply("r2", {"chunks": change}) == 2
    assert rows(state.read("chunks")) == rows(chunks(spark, (1, 0, "auto", "A2"), (1, 1, "manual", "m"), (1, 2, "auto", "A3"), (2, 0, "auto", "b"), (None, 0, "auto", "n")))
    assert rows(pinned) == rows(first) and rows(state.read("documents")) == rows(titles)
    assert state.apply("r2", {"chunks": change}) == 2 and state.versions() == [1, 2]
    gone = spark.createDataFrame([(2,), (None,), (9,)], "document_id bigint")
    assert state.apply("r3", {"chunks": Change(keys=gone), "documents": Change(keys=gone)}) == 3
    assert {r["document_id"] for r in state.read("chunks").collect()} == {1} and rows(state.read("documents")) == [(1, "A")]
    assert rows(state.read("chunks", 1)) == rows(first)
    assert state.apply("r4", {"chunks": Change(keys=spark.createDataFrame([(1,)], "document_id bigint"))}) == 4
    assert state.read("chunks").count() == 0 and state.read("documents").count() == 1


def test_run_that_dies_before_the_swap(spark, state, tmp_path):
    state.apply("r1", {"chunks": Change(rows=chunks(spark, (1, 0, "auto", "a")))})
    change = {"chunks": Change(rows=chunks(spark, (1, 0, "auto", "b")))}
    state.stage(change, 1)  # written, and then nothing more
    assert rows(state.read("chunks")) == [(1, 0, "auto", "a")] and state.published("r2") is None
    again = Catalogue(spark, state.root, state.tables, buckets=9)
    assert again.buckets == 4
    assert again.apply("r2", change) == 2 and rows(again.read("chunks")) == [(1, 0, "auto", "b")]
    folders = lambda: len(os.listdir(tmp_path / "c/data"))
    assert folders() == 3
    assert again.vacuum(keep=1) == 2 and folders() == 1
    assert again.versions() == [2] and rows(again.read("chunks")) == [(1, 0, "auto", "b")]
    assert again.published("r1") == 1 and again.apply("r1", change) == 1


def test_two_writers(spark, state):
    state.apply("r1", {"chunks": Change(rows=chunks(spark, (1, 0, "auto", "a"), (2, 0, "auto", "b")))})
    staged = state.stage({"chunks": Change(rows=chunks(spark, (1, 0, "auto", "x")))}, 1)
    state.apply("r2", {"chunks": Change(rows=chunks(spark, (2, 0, "auto", "y")))})
    with pytest.raises(Conflict):
        state.publish("r3", staged, 1)
    assert state.versions() == [1, 2]
    assert state.apply("r3", {"chunks": Change(rows=chunks(spark, (1, 0, "auto", "x")))}) == 3
    assert rows(state.read("chunks")) == [(1, 0, "auto", "x"), (2, 0, "auto", "y")]


def test_only_touched_buckets_are_written(spark, state):
    state.apply("r1", {"chunks": Change(rows=chunks(spark, *[(i, 0, "auto", "a") for i in range(40)]))})
    before = state.manifest()["tables"]["chunks"]
    state.apply("r2", {"chunks": Change(rows=chunks(spark, (7, 0, "auto", "b")))})
    after = state.manifest()["tables"]["chunks"]
    assert sum(before[b] != after[b] for b in before) == 1 and state.read("chunks").count() == 40


def files(spark, *r):
    made = [(k, h, datetime.datetime(2024, 1, day), 1, "indexed") for k, h, day in r]
    return spark.createDataFrame(made, ingest.STATE)


def test_batches_and_listings(spark, tmp_path):
    state = Catalogue(spark, f"file://{tmp_path}/s", {"documents": ("source_key", ingest.STATE), "chunks": ("source_key", "source_key string, text string")}, buckets=3)
    follow = lambda fresh: {"chunks": Change(rows=fresh.select("source_key", F.col("raw_hash").alias("text")), keys=fresh.select("source_key"))}
    now = lambda name="documents": {r[0]: r[1] for r in state.read(name).collect()}
    assert ingest.apply_batch(state, "b0", files(spark, ("a", "1", 1), ("b", "1", 1)), follow) == 1
    assert ingest.apply_batch(state, "b1", files(spark, ("a", "2", 3), ("c", "1", 3)), follow) == 2
    assert ingest.apply_batch(state, "b1", files(spark, ("a", "9", 9)), follow) == 2  # replayed
    assert ingest.apply_batch(state, "b2", files(spark, ("a", "1", 2), ("b", "1", 4)), follow) == 3  # late, and unchanged
    assert now() == {"a": "2", "b": "1", "c": "1"} == now("chunks")
    listing = files(spark, ("a", "2", 3), ("b", "5", 5), ("d", None, 5))
    both = lambda fresh, gone: {"chunks": Change(rows=fresh.select("source_key", F.col("raw_hash").alias("text")), keys=fresh.select("source_key").union(gone))}
    ingest.reconcile(state, "l0", listing, both)
    assert now() == {"a": "2", "b": "5", "d": None} and now("chunks") == {"a": "2", "b": "5", "d": None}
    actions = {r["source_key"]: r["action"] for r in sync.sync_diff(listing, state.read("documents")).collect()}
    assert actions == {"a": "unchanged", "b": "unchanged", "d": "changed"}  # a hash that is not known is never unchanged
    assert ingest.reconcile(state, "l0", listing.limit(0), both) == ingest.reconcile(state, "l0", listing, both)
    ingest.reconcile(state, "l1", listing.limit(0), both)
    assert now() == {} == now("chunks")


def test_stream_into_state(spark, tmp_path):
    root, state = tmp_path / "in", Catalogue(spark, f"file://{tmp_path}/s", {"documents": ("source_key", ingest.STATE)}, buckets=2)
    root.mkdir()
    for name, text in (("a.md", "1"), ("b.md", "1")):
        (root / name).write_text(text)
    took = []

    def process(batch, n):
        took.append(n)
        ingest.apply_batch(state, f"stream-{n}", ingest.file_rows(batch, F.regexp_extract("path", r"([^/]*)$", 1)))

    run = lambda where: ingest.ingest(spark, str(root), str(tmp_path / where), process, per_batch=1).awaitTermination()
    run("one")
    (root / "c.md").write_text("3")
    run("one")
    listed = lambda: ingest.file_rows(spark.read.format("binaryFile").load(str(root)), F.regexp_extract("path", r"([^/]*)$", 1))
    pairs = lambda df: {r["source_key"]: (r["raw_hash"], r["size_bytes"]) for r in df.collect()}
    now, sha = pairs(state.read("documents")), pairs(listed())
    versions = state.versions()
    assert now == sha and took == [0, 1, 2] and len(versions) == 3
    shutil.rmtree(tmp_path / "one")  # the stream forgets; its batches come again under the same numbers
    run("one")
    assert state.versions() == versions and pairs(state.read("documents")) == sha
    (root / "b.md").unlink()
    (root / "a.md").write_text("changed")  # under a path that the stream has seen, so the listing tells of it
    ingest.reconcile(state, "listing", listed())
    assert pairs(state.read("documents")) == pairs(listed()) and set(pairs(listed())) == {"a.md", "c.md"}


def test_raw_store(spark, tmp_path):
    store = RawStore(spark, f"file://{tmp_path}/r", buckets=2, max_bytes=10)
    files = lambda *r: spark.createDataFrame([(d, n, c and bytearray(c)) for d, n, c in r], "document_id int, filename string, content binary")
    now = lambda v=None: {r["document_id"]: (r["filename"], bytes(r["content"])) for r in store.read(v).collect()}
    refs = lambda: sorted(r["n"] for r in store.references().collect())
    assert store.put("a", files((1, "c:\\x\\a.md", b"one"), (2, "b\x01.md", b"one"), (3, " ", b"two"), (4, "big", b"x" * 11), (5, "n", None), (None, "n", b"z"))) == 1
    assert now() == {"1": ("a.md", b"one"), "2": ("b_.md", b"one"), "3": ("file", b"two")} and refs() == [1, 2]
    assert store.put("a", files((1, "zzz", b"other"))) == 1 and now()["1"] == ("a.md", b"one")
    docs = spark.createDataFrame([(1, "file"), (2, "url"), (3, "file")], "document_id int, source_type string")
    version, refused = store.replace("b", files((1, "n.md", b"three"), (2, "n.md", b"x"), (3, "n.exe", b"x"), (9, "n.md", b"x")), docs, [".md"])
    assert version == 2 and {r["document_id"] for r in refused.collect()} == {"2", "3", "9"}
    assert now() == {"1": ("n.md", b"three"), "2": ("b_.md", b"one"), "3": ("file", b"two")} and refs() == [1, 1, 1]
    store.delete("c", docs.where("document_id = 3"))
    assert refs() == [0, 1, 1] and store.collect("d") == 4 and refs() == [1, 1]
    assert now(1)["3"] == ("file", b"two") and set(now()) == {"1", "2"}
    assert store.put("e", files((7, "t", b"two"))) == 5 and now()["7"] == ("t", b"two")
