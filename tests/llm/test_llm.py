"""The training-data operators on small tables: brute force, round trips, and every odd row."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import ann, exact_dedup, langid, licences, minmax, mixing, packing, quality, shards, textmodel, toxicity
from lorespark.llm.queries import tokenizer_path

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, kept string, size string, n int, bucket string, shard string, rep int"
EXTRA = (1, "x", "y", 2, "z", "w", 3)


def words(rng, n):
    return [rng.choice("the and of lorem ipsum dolor sit amet alpha beta gamma delta".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randrange(20, 120))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1].replace(" ", "\n\t"), texts[2] + " tail", texts[3].upper(), " ".join(words(rng, 30000))]
    texts += [None, None, "", " ", "\n\t ", "one", "one two three", "ОДИН два ёж", "é Ω<|endoftext|>! it's", "日本語のテキスト。", "a" * 5000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 9 == 0 else f"s{i % 4}", None) + EXTRA for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], None, None, 1) + EXTRA, (None, None, None, None, None) + EXTRA]
    return spark.createDataFrame(rows, FIELDS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_language(docs, empty):
    got = langid.language_id(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")), r
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert langid.language_id(empty).count() == 0


def test_language_accuracy(spark):
    rng = random.Random(2)
    parts = {"aa": "ba de ki lo", "bb": "xu za qe wy"}
    rows = [(i, " ".join("".join(rng.choices(parts[l].split(), k=3)) for _ in range(rng.randrange(3, 40))), l) for i, l in enumerate(rng.choices(["aa", "bb"], k=300))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    right = langid.language_id(df).where("held_out").join(df, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    a = langid.bundle(["abc def"])[0]
    b = langid.bundle(["ABC... def", "xyz"])[0]
    assert np.array_equal(a[0], b[0])


@pytest.mark.parametrize("learn, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_scores(docs, empty, labels, learn, label):
    got = learn(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert learn(docs, labels.limit(0)).count() == docs.count() and learn(empty, labels).count() == 0


def test_toxic_words_are_found(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 60) + ["vile", "vilest"] * (i % 6 == 0))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900, 1)], "doc_id bigint, toxic int")
    wrong = toxicity.toxicity(df, marks).where("held_out").where((F.col("doc_id") % 6 == 0).cast("int") != F.col("predicted")).count()
    assert wrong == 0
    assert toxicity.drop_toxic(df, marks).count() == 750


def test_toxicity_learns_from_the_whole_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "nnpu", lambda a, b, prior: seen.append((a.shape[0], b.shape[0])) or (np.zeros(a.shape[1]), 0.0))
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), (F.col("id") < 2600).cast("int").alias("toxic"))
    toxicity.train(rows, rows.select("doc_id", "toxic"))
    assert seen == [(2500, 5000)]


def test_language_by_brute_force(spark, docs):
    """Binding, bundling and cosine written out gram by gram."""

    def vector(text):
        codes, total = " ", {}
        for c in (text or "").lower() + " ":
            codes += c if c.isalpha() else "" if codes[-1] == " " else " "
        for i in range(len(codes) - 2):
            if codes[i : i + 2].strip():
                total[codes[i : i + 3]] = total.get(codes[i : i + 3], 0) + 1
        out = np.zeros(langid.DIM)
        for g, n in total.items():
            bound = np.ones(langid.DIM)
            for place, c in enumerate(g):
                bound = bound * np.roll(langid.letter(ord(c)), place)
            out += np.sqrt(n) * bound
        return out / max(np.linalg.norm(out), 1e-12)

    rows = [r for r in docs.dropDuplicates(["doc_id"]).collect() if r["doc_id"] is not None]
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
    prototypes = {}
    for r in rows:
        if r["lang"] and not held(r):
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + vector(r["text"])
    unique = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id bigint, text string, lang string")
    for r in langid.language_id(unique).join(unique.select("doc_id", "text"), "doc_id").collect():
        cos = {k: vector(r["text"]) @ v / np.linalg.norm(v) for k, v in prototypes.items()}
        best = min(cos, key=lambda k: (-cos[k], k))
        if r["lang_pred"] != "und":
            assert r["lang_pred"] == best and abs(r["score"] - max(0, cos[best])) < 1e-4


def test_language_of_very_long_texts(spark):
    """Pieces give the counts of the whole; ties go to the first language."""
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdé-1 ", k=rng.randrange(1, 9))) for _ in range(2000))
    for piece in (5, 64, 10**9):
        kinds, counts = langid.text_grams(text, 3, piece)
        assert np.array_equal(kinds, langid.gram_counts([text], 3, 10**9)[1]) and np.array_equal(counts, langid.gram_counts([text], 3, 10**9)[2])
    long = spark.createDataFrame([(1, "xu za qe " * 700_000), (2, "ba de ki")], "doc_id bigint, text string").withColumn("held_out", F.lit(False))
    langs, table = ["aa", "bb"], langid._unit(langid.bundle(["ba de ki lo", "xu za qe wy"])[0])
    assert [r["lang_pred"] for r in langid.identify(long, langs, table).orderBy("doc_id").collect()] == ["bb", "aa"]
    assert {r["lang_pred"] for r in langid.identify(long, ["aa", "zz"], table[[0, 0]]).collect()} == {"aa"}


def test_toxicity_scores_by_brute_force(spark, docs):
    weights = np.random.default_rng(0).normal(size=512) * (np.arange(512) % 3 == 0)
    rows = docs.select("doc_id", "text").withColumn("held_out", F.lit(False))
    for r in toxicity.score(rows, weights, -0.5).join(rows.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").where("doc_id < 60").collect():
        found = re.findall(r"\w+", (r["text"] or "").lower())
        z = sum(weights[zlib.crc32(x.encode()) % 512] for w in found for x in [w, *("^" + w[:k] for k in (4, 5, 6, 7) if len(w) >= k)])
        want = 1 / (1 + np.exp(0.5 - toxicity.SCALE * z / np.sqrt(max(1, len(found)))))
        assert abs(r["score"] - want) < 1e-6


def test_nnpu_falls_below_no_risk():
    """The estimate of the hidden negatives' risk stays near nought or above, where the plain estimator runs far below."""
    rng = np.random.default_rng(1)
    make = lambda n, shift: textmodel.Sparse([np.arange(40, dtype=np.int32)] * n, list(rng.normal(shift, 1, (n, 40)).astype(np.float32)), 40)
    pos, unl, prior = make(30, 0.2), make(60, 0.0), 0.4
    w, b = toxicity.nnpu(pos, unl, prior)
    loss = lambda z: textmodel.sigmoid(z)  # noqa: E731  sigmoid loss of calling it positive
    assert loss(unl @ w + b).mean() - prior * loss(pos @ w + b).mean() > -0.1 and loss(pos @ w + b).mean() > 0.5


def test_labels_of_one_class(spark, docs, labels):
    ones = labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})
    assert quality.quality(docs, ones).agg(F.min("predicted")).first()[0] == 1
    assert toxicity.toxicity(docs, ones).count() == docs.count()


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    m = {"w": rng.normal(size=9), "v": rng.normal(size=(9, 3)), "b": np.array(0.3)}
    row, col, val = np.array([0, 0, 0, 2, 2]), np.array([1, 4, 7, 0, 4]), rng.normal(size=5)
    got = quality.fm_scores(row, col, val, 3, m)
    for r in range(3):
        own = np.flatnonzero(row == r)
        pairs = sum(m["v"][col[i]] @ m["v"][col[j]] * val[i] * val[j] for i in own for j in own if i < j)
        assert np.isclose(got[r], 0.3 + m["w"][col[own]] @ val[own] + pairs)


def test_structure_by_brute_force(docs):
    texts = [r["text"] or "" for r in docs.collect()] + ["A b!\n\nC|d? 12\n  \n x_y ~", "\n", "é Ωß\tZ.\n- q"]
    got = quality.structure(texts)
    for t, g in zip(texts, got, strict=True):
        ws, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        n, k, m, letters = max(1, len(t)), max(1, len(ws)), max(1, len(lines)), sum(c.isalpha() for c in t)
        longest = max(map(len, ws), default=0)
        want = [
            letters / n, sum(c.isupper() and ord(c) < 0x250 for c in t) / max(1, letters), sum(c.isdecimal() for c in t) / n, len(re.findall(r"[^\w\s]", t)) / n,
            t.count("|") * 8 / n, (t.count("!") + t.count("?")) * 8 / n, sum(map(t.count, "#$%&*<>{}[]\\^~_=+@/")) * 8 / n, letters / k / 16, n / m / 1000,
            sum(w[-1] not in ".,!?;:" and not w[-1].isalpha() and not w[-1].isdecimal() for w in ws) / k, np.log1p(len(ws)) / 16,
            sum(x.rstrip(" \t\v\f\r")[-1] in ".!?" for x in lines) / m, longest / (50 + longest),
        ]
        assert np.allclose(g, np.minimum(1, want)), (t[:40], g, want)


def test_quality_learns_from_metadata(spark):
    rows = [(i, "the same words", 10 if i % 2 else 100_000, None if i % 7 == 0 else "k" + str(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, kind string")
    marks = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    wrong = lambda names: quality.quality(df, marks, metadata=names).where("held_out and predicted <> doc_id % 2").count()
    assert wrong(["n_chars"]) == 0 and wrong(["n_chars", "kind"]) == 0 and wrong([]) > 20


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, empty, weak):
    hashed = (lambda c: F.length(c).cast("long")) if weak else F.xxhash64
    got = exact_dedup.exact_dedup(docs, identifier=hashed).where("doc_id is not null").collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(normal(r["text"]), []).append(r["doc_id"])
    texts = {r["doc_id"]: normal(r["text"]) for r in docs.collect()}
    for r in got:
        own = groups[texts[r["doc_id"]]]
        assert r["group_size"] == len(own) and r["keep_id"] == min(i for i in own if i is not None)
    assert len(got) == docs.count() - 2 and exact_dedup.exact_dedup(empty).count() == 0


def test_packing(docs, empty):
    got = packing.packed(docs, tokenizer_path(), capacity=256, piece=64, per_block=8).collect()
    t = packing.tokenizer(tokenizer_path())
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 256
    once = {r["doc_id"]: r["text"] for r in docs.groupBy("doc_id").agg(F.count("*").alias("k"), F.first("text").alias("text")).where("k = 1").collect()}
    for i, text in once.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    assert packing.packed(empty, tokenizer_path()).count() == 0


def test_differencing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 300)
    load = np.bincount(packing.differencing(sizes, 40), sizes, 40)
    assert load.sum() == sizes.sum() and load.max() - load.min() < 40
    assert np.bincount(packing.windows(np.array([1500, 1500, 1000])), [1500, 1500, 1000]).max() <= 2048
    assert packing.windows(np.zeros(0, int)).tolist() == [] and packing.differencing(np.array([3, 2, 1]), 1).tolist() == [0, 0, 0]


def test_differencing_against_the_book_and_the_best():
    """Two windows: the largest two differ by their difference, and so on; three windows: never far from the best of all ways."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 60, 8)
        left = sorted(sizes.tolist())
        while len(left) > 1:
            left = sorted([*left[:-2], left[-1] - left[-2]])
        load = np.bincount(packing.differencing(sizes, 2), sizes, 2)
        assert load.max() - load.min() == left[0]
        load = np.bincount(packing.differencing(sizes, 3), sizes, 3)
        best = min(max(np.bincount(w, sizes, 3)) for w in itertools.product(range(3), repeat=8))
        assert best <= load.max() <= best + 12


def test_equal_rows_spread_over_all_blocks(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same few words again").alias("text")).repartition(4)
    got = packing.packed(rows, tokenizer_path(), per_block=4)
    blocks = [r[0] for r in got.groupBy((F.col("sequence_id") / (1 << 24)).cast("int")).count().select("count").collect()]
    assert sum(blocks) == 20_000 and len(blocks) >= 12 and max(blocks) < 1.3 * min(blocks)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_mixing(docs, empty):
    got = mixing.mix(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        size = sum(r["size"] for r in own)
        assert own[0]["source_size"] == size and own[0]["target"] <= 2 * size + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert abs(sum(own[0]["target"] for own in by.values()) - 1.5 * total) < 1e-3 or all(abs(o[0]["target"] - 2 * o[0]["source_size"]) < 1e-6 for o in by.values())
    assert mixing.mix(empty).count() == 0


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k=4):
    sets, up = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near(docs, empty):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()])
    got = minmax.near_dedup(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (*want[r["doc_id"]], want[r["doc_id"]][1] == r["doc_id"])
    assert minmax.near_dedup(empty).count() == 0


def test_near_chains(spark):
    """Copies that differ step by step: the first and the last share little, and decoys share a passage."""
    rng = random.Random(5)
    w, rows = words(rng, 150), []
    for i in range(40):
        w = w[: i * 3] + words(rng, 4) + w[i * 3 + 4 :]
        rows.append((100 + i, " ".join(w)))
    passage = words(rng, 80)
    rows += [(200 + i, " ".join(passage + words(rng, 35))) for i in range(40)]
    rng.shuffle(rows)
    want = brute_components(rows)
    got = minmax.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({v[1] for v in want.values()}) < 60


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 3)
    test_near_chains(spark)


def test_sharding(docs, empty):
    rows = shards.shard(docs, shards=4).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        if r["doc_id"] is not None:
            assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert shards.shard(empty).count() == 0


def test_sharding_keeps_groups(spark):
    rng = random.Random(6)
    rows = [(i, f"single {i} " + "x" * rng.randrange(300)) for i in range(1500)] + [(2000 + 10 * g + j, f"group {g} " + "y" * (g % 200)) for g in range(150) for j in range(rng.randrange(2, 6))]
    rows += [(9000 + j, "hot " + "z" * 100) for j in range(1200)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=8)
    load = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(load) < 1.02 * sum(load) / 8
    whole = got.where("doc_id between 2000 and 8999").withColumn("g", (F.col("doc_id") / 10).cast("int")).groupBy("g").agg(F.countDistinct("shard").alias("k"))
    assert whole.where("k = 1").count() >= 0.9 * whole.count()
    assert got.where("doc_id >= 9000").select("shard").distinct().count() <= 5


def test_sharding_cuts_fewer_links_than_hashing(spark):
    """Pairs of equal texts in different shards, counted against placement by hash."""
    rng = random.Random(9)
    rows = [(i, f"group {rng.randrange(200)} " + "t" * 50) for i in range(3000)] + [(5000 + i, f"single {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["shard"] for r in shards.shard(df, shards=8).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    cut = lambda place: sum(place(a) != place(b) for own in by.values() for k, a in enumerate(own) for b in own[:k])
    assert cut(got.get) < 0.3 * cut(lambda i: zlib.crc32(str(i).encode()) % 8)


@pytest.mark.parametrize("leaf", [400, 40])
def test_search_with_a_small_sample(spark, leaf):
    """One and two levels learned from 600 of 8000 clustered vectors: nine in ten found in well under half of the leaves."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(80, 16))[rng.integers(0, 80, 8000)] * 2 + rng.normal(size=(8000, 16)) * 0.6
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(4)
    found = {}
    for r in (got := ann.search(df, df.where("vec_id % 100 = 0"), sample=600, leaf=leaf).collect()):
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(found[q] & set(np.argsort(((v - v[q]) ** 2).sum(1))[1:11].tolist())) for q in range(0, 8000, 100))
    assert hit >= 0.9 * 800 and got[0]["probes"] < 0.4 * got[0]["leaves"] and got[0]["leaves"] >= (100 if leaf == 40 else 8)


def test_search_of_several_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8 if i % 3 else 5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 100 = 0"), k=3).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200, 300, 400, 500}
    for q in (0, 300):  # of the rarer dimension: exact, and among themselves
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, rows[q][1])))), i) for i, v in rows if len(v) == 5 and i != q)[:3]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in near]


def test_search(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 16)) + rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] * 2
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)] + [(3000, rows_v := [float(x) for x in v[0]]), (3001, rows_v)]
    rows += [(3100, None), (3200, [0.0] * 16), (3300, [None] + [1.0] * 15), (3400, [float("nan")] * 16), (3500, [float("inf")] + [0.0] * 15), (3600, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).withColumn("part", F.lit(2))
    got = ann.search(df, df.where("vec_id % 100 = 0"), block_rows=150, block_queries=20).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    ids, points = np.arange(3002), np.vstack([v, v[:1], v[:1]])
    hit = 0
    assert set(found) == set(range(0, 3001, 100))
    for q, near in found.items():
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        true = [int(i) for i in np.lexsort((ids, d)) if i != q][:10]
        assert near == sorted(near) and len(near) == 10 and all(abs(s - d[i]) < 1e-12 for s, i in near)
        hit += len({i for _, i in near} & set(true))
    assert hit >= 0.9 * 10 * len(found) and [i for _, i in found[0][:2]] == [3000, 3001]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    small = df.where("vec_id < 4")
    assert ann.search(small, small).groupBy("query_id").count().where("count = 3").count() == 4


def test_licences(spark):
    rows = [
        ("a/LICENSE", "MIT\nReleased under the MIT License."), ("a/x/one.txt", "nothing to see"), ("a/x/two.txt", "words\nLicensed under the Apache License, Version 2.0.\nwords"),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/three", "text"), ("d/four", "license of the license"),
        ("d/five", None), ("d/six", ""), (None, "Released under the MIT License."), ("a/x/one.txt", "nothing more"), ("e", "x " * 20000 + "\nLicensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "path string, text string, licence string")
    got = {r["path"]: (r["licence"], r["how"], r["from_folder"]) for r in licences.licences(df).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "file", None), "a/x/one.txt": ("MIT", "inherited", "a"), "a/x/two.txt": ("Apache-2.0", "header", None), "a/b/COPYING": ("GPL-3.0", "file", None),
        "a/b/c/three": ("GPL-3.0", "inherited", "a/b"), "d/four": (None, "none", None), "d/five": (None, "none", None), "d/six": (None, "none", None), None: ("MIT", "header", None), "e": ("CC-BY-NC-4.0", "header", None),
    }
    assert licences.licences(df.limit(0)).count() == 0


def test_licence_files_and_ties(spark):
    """Titles over two lines, whole texts, comment signs, a null path, and ties to the first name."""
    title = "          GNU GENERAL PUBLIC LICENSE\n             {}\n\n Copyright (C) Free Software Foundation\n\n  The licenses for most software are made to share."
    rows = [(f"z/{i}", "the words of this file and all of that see under the next") for i in range(100)]
    rows += [("g3/COPYING", title.format("Version 3, 29 June 2007")), ("g2/COPYING", title.format("Version 2, June 1991")), ("i/LICENSE", f"Copyright 2020 Ann\n\n{licences._ISC}\n\n{licences._ISC_WARRANTY}")]
    rows += [("m/LICENSE", "Mozilla Public License Version 2.0\n====\n\n1. Definitions"), ("t/LICENSE", licences._MIT.replace(", ", ",\n") + "\n\n" + licences._MIT_NOTICE + "\n\n" + licences._WARRANTY)]
    rows += [("b/LICENSE", f"{licences._BSD}\n{licences._BSD_WARRANTY}"), ("a/A.java", "/*\n * " + licences._APACHE.replace(". ", ".\n * ") + "\n */"), (None, "Released under the MIT License."), (None, "Nothing.")]
    df = spark.createDataFrame(rows, "path string, text string").repartition(3)
    got = {r["path"]: (r["licence"], r["how"]) for r in licences.licences(df).where("path is null or path not like 'z/%'").collect()}
    assert got == {"g3/COPYING": ("GPL-3.0", "file"), "g2/COPYING": ("GPL-2.0", "file"), "i/LICENSE": ("ISC", "file"), "m/LICENSE": ("MPL-2.0", "file"), "t/LICENSE": ("MIT", "file"), "b/LICENSE": ("BSD-2-Clause", "file"), "a/A.java": ("Apache-2.0", "header"), None: ("MIT", "header")}
    tied = {"CC-B": ("free as a bird",), "CC-A": ("free as a bird",), "B": ("another notice",)}
    assert licences.scan(spark.createDataFrame([("x", "free as a bird")], "path string, text string"), tied).first()["own"] == "CC-A"


def test_licence_scores_by_brute_force(spark):
    """The best cosine over all passages and templates."""
    rng = random.Random(10)
    said = [t for many in licences.TEMPLATES.values() for t in many]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.sample(rng.choice(said).split() + words(rng, 9), k=8)) for _ in range(rng.randrange(1, 5))] + ([rng.choice(said)] if i % 3 == 0 else [])
        rows.append((f"f/{i}", rng.choice(["\n", "\n\n"]).join(lines)))
    n, of = len(rows), lambda t: re.findall(licences.TERM, t.lower())
    df = {}
    for _, t in rows:
        for x in set(of(t)):
            df[x] = df.get(x, 0) + 1

    def bag(t):
        made = {}
        for x in of(t):
            made[x] = made.get(x, 0) + np.log((1 + n) / (1 + max(df.get(x, 0), licences.RARE * n))) + 1
        size = np.sqrt(sum(v * v for v in made.values()))
        return {k: v / size for k, v in made.items()}

    templates = [(name, bag(t)) for name, many in licences.TEMPLATES.items() for t in many]
    got = {r["path"]: r for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for path, t in rows:
        lines = [x for x in t.split("\n") if re.search("[A-Za-z0-9]", x)]
        best = []
        for p in {*lines, *(f"{a} {b}" for a, b in zip(lines, lines[1:])), *re.split(r"\n\s*\n", t), t}:
            own = bag(p)
            best += [(-round(sum(w * own.get(k, 0) for k, w in b.items()), 6), name) for name, b in templates]
        score, name = min(best)
        assert got[path]["own"] == (name if -score >= licences.THRESHOLD else None) or abs(-score - licences.THRESHOLD) < 1e-5, (path, score, name, got[path])


def test_licence_on_small_and_large_tables(spark):
    """Notices with a name, a year or a file beside them, one in a hundred files each; names are in no other file."""

    def found(n):
        notice = ("Released under the MIT License. See LICENSE.txt.", "All rights reserved.", "Copyright 1987 Name{}. Released under the MIT License.")
        rows = [(f"f/{i}", "the words of this file and all of that\nsee under the next" + (" free software" if i % 7 == 0 else "") + ("\n" + notice[i % 100].format(i) if i % 100 < 3 else "")) for i in range(n)]
        kinds = F.regexp_extract("path", r"(\d+)$", 1).cast("int") % 100
        got = licences.scan(spark.createDataFrame(rows, "path string, text string").repartition(4)).groupBy(F.least(kinds, F.lit(3)).alias("kind"), "own").count().collect()
        return {(r["kind"], r["own"]): r["count"] / n for r in got}

    assert found(500) == found(20000) == {(0, "MIT"): 0.01, (1, "Proprietary"): 0.01, (2, "MIT"): 0.01, (3, None): 0.97}


def test_licence_weights_count_every_term(spark):
    """Scores by brute force over all terms, with final dots, a path of two rows and words of no template."""
    rows = [("a", "Released under the MIT License. See LICENSE.txt."), ("b", "see the house. MIT."), ("b", "see license."), ("c", "License 2.0. under see"), ("d", "see the"), ("e", None)]
    own = licences.scan(spark.createDataFrame(rows, "path string, text string")).where("path = 'a'").first()
    files = {}
    for path, text in rows:
        files.setdefault(path, set()).update(re.findall(licences.TERM, (text or "").lower()))
    idf = lambda t: np.log((1 + len(files)) / (1 + sum(t in f for f in files.values()))) + 1
    line, notice = (re.findall(licences.TERM, t.lower()) for t in (rows[0][1], "Released under the MIT License."))
    want = np.sqrt(sum(idf(t) ** 2 for t in notice) / sum(idf(t) ** 2 for t in line))
    assert own["own"] == "MIT" and abs(own["own_score"] - want) < 1e-6


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    last = docs
    for name, stage in p.STAGES[:-1]:
        last = stage(spark, last, sf).cache()
        assert last.columns == docs.columns and last.count() > 0
        if name == "near_dedup":
            want = brute_components([(r["doc_id"], r["text"]) for r in last.collect()], 5)  # the stage takes five words
            assert all(top == i for i, (n, top) in want.items())
    packed = p.STAGES[-1][1](spark, last, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.where("start = 0").count() == last.count()


@pytest.mark.parametrize("high", [0, 2**63 - 500])
def test_pipeline_with_null_and_repeated_ids(spark, high):
    import corpus_pipeline as p

    sf, rng = "/root/testdata/sf0.001", random.Random(7)
    texts = [" ".join(words(rng, 60)) for _ in range(24)]
    near = texts[2] + " tail"
    rows = [(high + i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, " ".join(words(rng, 60)), f"s{i % 3}") for i in range(6)]  # own texts without doc_id
    rows += [rows[5], rows[5], (high + 5, " ".join(words(rng, 60)), "s1"), (high + 6, texts[7], "s0"), (high + 8, near, "s2")]  # repeated doc_ids
    rows += [(None, texts[1], "s1"), rows[24]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    stages = dict(p.STAGES)
    of = lambda df: sorted(map(str, df.collect()))
    assert of(stages["toxicity"](spark, docs, sf)) == of(docs)  # nothing here is toxic
    once = stages["exact_dedup"](spark, docs, sf).cache()
    want = {t for _, t, _ in rows}
    assert sorted(r["text"] for r in once.collect()) == sorted(want) and {tuple(r) for r in once.collect()} <= set(rows)
    apart = stages["near_dedup"](spark, docs, sf).cache()
    left = [r["text"] for r in apart.collect()]
    assert len(left) == len(set(left)) == len(want) - 1 and want - set(left) < {texts[2], near} and {tuple(r) for r in apart.collect()} <= set(rows)
    mixed = stages["mixing"](spark, apart, sf).cache()
    times = {r["text"]: r["count"] for r in mixed.groupBy("text").count().collect()}
    size = apart.count()
    assert 1.3 * size < sum(times.values()) <= 2 * size and max(times.values()) <= 2 and set(times) <= want
    again = stages["mixing"](spark, docs, sf).groupBy("text").count().collect()
    assert {r["text"]: r["count"] for r in again}[texts[5]] <= 2 * 3 and mixed.where("doc_id is null").count() > 0
    packed = stages["packing"](spark, mixed, sf)
    assert packed.where("start = 0").count() == mixed.count() and packed.where("start = 0 and doc_id is null").count() == mixed.where("doc_id is null").count()


def test_nearest_of_repeated_queries(spark):
    """A query row that occurs twice is answered once, with distinct neighbours; small tables are routed as well."""
    rng = np.random.default_rng(3)
    made = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    table = spark.createDataFrame(made, "vec_id bigint, embedding array<double>")
    asked = table.where("vec_id % 50 = 0")
    got = ann.search(table, asked.unionByName(asked)).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert len(by) == 6 and all(sorted(r["rank"] for r in rs) == list(range(1, 11)) and len({r["vec_id"] for r in rs}) == 10 for rs in by.values())
    assert got[0]["leaves"] > 1 and ann.leaf_rows(500) < 50 and ann.leaf_rows(10**9) == ann.LEAF
