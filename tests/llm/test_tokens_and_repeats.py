"""Fill-in-middle, token alignment and repeated passages against plain versions of their own."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lorespark.llm import alignment, fim, repeats, suffixes
from lorespark.llm.queries import tokenizer_path

FIELDS = "doc_id bigint, text string, n bigint, form string, p int, q int, hash string, spans int, kept string, key int, row int"
EXTRA = (1, "x", 2, 3, "y", 4, "z", 5, 6)
PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "\n\n", "  two  blanks ", "a", "a\nb", "a\n\nb", " a\nb\n", "tab\tand\r\nend", "can't we'll 12 345, x.y!", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁x ▁",
    "日本語のテキスト。 混ぜる\nもの", "ОДИН два ёж", "é Ω ① ﬁ", "é ́x", " x   y　z", "a\x1cb c\x0bd \x85", "😀 👩‍👩‍👧 ok", "<P> mark", "x<S>", "<M>", "a<P", "P>b", "q" * 3000, ("word " * 4000).strip(),
]


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "né", "Ku", "x1", "'s", "—", "9", "日"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", ",", "."])
    texts = [rng.choice([" ", "\n", "  ", " "]).join(word() for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    out = list(enumerate(ODD + texts))
    return out + [out[11], out[11], (None, "null id here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([r + EXTRA for r in rows], FIELDS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


def middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'null' if doc_id is None else doc_id}".encode())
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text.encode()), sha(text.encode())
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(units), form, len(pre), len(mid), sha(out.encode()), sha(text.encode())


def test_fill_in_middle(docs, rows, empty):
    made = fim.fill_in_middle(docs)
    got = [tuple(r) for r in fim.digests(made).collect()]
    assert sorted(got, key=repr) == sorted((middle(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.digests(fim.fill_in_middle(empty)).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")
    none = fim.fill_in_middle(docs, percent=0)
    assert {r["form"] for r in none.collect()} == {"plain"}


def test_fill_in_middle_long(spark):
    text = "line of text\n" * 300_000 + "x" * 1_000_000
    row = fim.digests(fim.fill_in_middle(spark.createDataFrame([(5, text)], "doc_id bigint, text string"))).first()
    assert tuple(row) == middle(5, text) and row["n"] == 300_001


def aligned(rows, links):
    pair = alignment.Pair(*map(tokenizer_path, PATHS))
    made, counts = [], Counter()
    for doc_id, text in rows:
        groups, joined = [], []
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            raw = (" " + text).encode()
            if b"".join(pair.bytes_a[i] for i in a) == raw and b"".join(pair.bytes_b[i] for i in b) == raw:
                at_a, at_b = np.cumsum([len(pair.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(pair.bytes_b[i]) for i in b]).tolist()
                i = j = 0
                for end in sorted(set(at_a) & set(at_b)):
                    x, y = at_a.index(end, i) + 1, at_b.index(end, j) + 1
                    groups.append((a[i:x], b[j:y]))
                    i, j = x, y
                joined = [(u, v) for x, y in groups for u in x for v in y] if links == "group" else [(x[-1], y[-1]) for x, y in groups]
        made.append((doc_id, groups, joined))
        counts.update(joined)
    top: dict = {}
    for (_, v), n in counts.items():
        top[v] = max(n, top.get(v, 0))
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [(d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), sha(text(g).encode()) if g else "") for d, g, k in made]


@pytest.mark.parametrize("links", ["end", "group"])
@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 0])
def test_alignment(docs, rows, links, most):
    got = [tuple(r) for r in alignment.align(docs, *map(tokenizer_path, PATHS), links=links, broadcast_pairs=most).collect()]
    assert sorted(got, key=repr) == sorted(aligned(rows, links), key=repr)


def test_alignment_of_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [tuple(r) for r in alignment.align(table, *map(tokenizer_path, PATHS)).collect()]
    assert sorted(got) == sorted(aligned([tuple(r) for r in table.collect()], "end"))


def test_alignment_forgets(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 2)
    known = alignment.Chunks(alignment.Pair(*map(tokenizer_path, PATHS)), "end", None)
    at = known.look([" a", " b", " a", " word"])
    first = known.n[at]
    assert len(known) == 3
    at = known.look([" word", " other", " b"])
    assert (known.n[at][[0, 2]] == first[[3, 1]]).all() and len(known) == 4
    at = known.look([" a", " b"])
    assert (known.n[at] == first[:2]).all() and len(known) == 2


def test_alignment_empty(empty):
    assert alignment.align(empty, *map(tokenizer_path, PATHS)).count() == 0


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(600):
        k = rng.choice([2, 3, 5, 200])
        x = [rng.randrange(1, k) for _ in range(rng.randrange(0, 80))] * rng.choice([1, 1, 3]) + [0]
        t = np.array(x)
        order = suffixes.suffix_array(t, k, short=rng.choice([2, 20])).tolist()
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        shared = suffixes.common_prefixes(t, np.array(order), 9)
        for r in range(1, len(x)):
            a, b = x[order[r - 1] :], x[order[r] :]
            same = next((i for i, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))
            assert shared[order[r]] == min(same, 9)


def test_suffix_array_of_many_names():
    rng = random.Random(1)
    t = np.array([rng.randrange(1, 250) for _ in range(30_000)] * 2 + [0])
    order = suffixes.suffix_array(t, 250, short=100)
    raw = t.astype(np.uint8).tobytes()
    assert (np.sort(order) == np.arange(len(t))).all()
    assert all(raw[a : a + 70_000] < raw[b : b + 70_000] for a, b in zip(order[:-1:97], order[1::97], strict=False))


def stripped(rows, width):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(b), int(gone.sum()), runs, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return out


@pytest.mark.parametrize(("width", "gram", "hot"), [(200, 64, 2000), (24, 8, 2000), (24, 8, 1), (9, 1, 3), (8, 8, 5)])
def test_repeats(spark, rows, width, gram, hot):
    rng = random.Random(width)
    word = lambda: rng.choice(["alpha", "Beta", "gàmma", "δ", "eps", "zeta", "日本"]) + str(rng.randrange(300))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)]
    made = [" ".join([text(rng.randrange(0, 40)), rng.choice(passages), text(rng.randrange(0, 60))][: rng.randrange(1, 4)]) for _ in range(50)]
    made += [made[3], made[3], passages[0], passages[0] * 3, "a" * 900, "a" * 450 + "b", "ab" * 300, made[5][:199], made[5][:200], text(30) + made[7][50:400], passages[1] + text(9) + passages[2] + text(9), "line again\n" * 60]
    table = rows + list(enumerate(made, 1000)) + [(1000, made[0]), (None, made[1])]
    df = spark.createDataFrame([r + EXTRA for r in table], FIELDS).repartition(3)
    got = [tuple(r) for r in repeats.digests(repeats.strip_repeats(df, width, gram, hot)).collect()]
    want = stripped(table, width)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(x[3] > 1 for x in want)


def test_repeats_shuffled(monkeypatch, spark):
    """Nothing broadcast, small runs and shards."""
    monkeypatch.setattr(repeats, "BROADCAST", -1)
    monkeypatch.setattr(repeats, "RUN", 100)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    common = [text(300) for _ in range(3)]
    rows = [(i, text(rng.randrange(400)) + rng.choice(common) + text(rng.randrange(400))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [tuple(r) for r in repeats.digests(repeats.strip_repeats(df)).collect()]
    assert sorted(got) == sorted(stripped(rows, 200))


def test_repeats_long_and_empty(spark, empty):
    rng = random.Random(3)
    part = "".join(rng.choices("abcdefghij \n", k=400))
    text = "".join(rng.choices("abcdefghijklmnop ", k=2_000_000))
    df = spark.createDataFrame([(1, text + part), (2, part[:300] + "!")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in repeats.digests(repeats.strip_repeats(df)).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[2]["n_removed"]) == (300, 1, 300)
    assert got[1]["kept_sha256"] == sha((text + part[300:]).encode())
    assert repeats.strip_repeats(empty).count() == 0
