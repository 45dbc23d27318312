from lorespark.sources import raw


def test_bytes_go_to_their_buckets_alone(spark, tmp_path, monkeypatch):
    cuts, cut = [], raw.cut
    monkeypatch.setattr(raw, "cut", lambda df: cuts.append(df.columns) or cut(df))
    store = raw.RawStore(spark, f"file://{tmp_path}/r", buckets=2)
    files = lambda *r: spark.createDataFrame([(d, "a", bytearray(c)) for d, c in r], "document_id int, filename string, content binary")
    store.put("a", files((1, b"one"), (2, b"one"), (3, b"two")))
    store.put("b", files((3, b"one"), (4, b"two"), (5, b"new")))
    assert cuts and not any("content" in c for c in cuts)
    assert {r["document_id"]: bytes(r["content"]) for r in store.read().collect()} == {"1": b"one", "2": b"one", "3": b"one", "4": b"two", "5": b"new"}
    assert sorted(r["n"] for r in store.references().collect()) == [1, 1, 3]
