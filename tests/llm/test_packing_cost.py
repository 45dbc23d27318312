import numpy as np
import pyarrow as pa

from lorespark.llm import packing
from lorespark.llm.queries import tokenizer_path


def test_ids_of_many_words_lie_in_one_array():
    words = ["", "plain", "plain.", "Plain?!;", "é,", "a7", "73.", "7391", "<|endoftext|>", ".", "x<|y", "plain", "fin\x0b", "don't", "ẞ.a.", "A..B,"]
    known, t = packing.Ids(tokenizer_path(), most=3, together=4), packing.tokenizer(tokenizer_path())
    for _ in range(2):
        tokens, upto = known.of(pa.array(words))
        assert [tokens[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [t.encode(w, add_special_tokens=False).ids for w in words]
    texts = pa.array([" ".join(words), None, "", "a\n b, c. " * 40, "7"])
    assert [x.tolist() for x in packing.encoded(texts, known)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]


def test_partitions_that_do_not_meet_are_joined_without_all_windows(monkeypatch):
    made = []
    full = np.full
    monkeypatch.setattr(packing.np, "full", lambda *a, **k: made.append(a[0]) or full(*a, **k))
    sizes = np.arange(900, 0, -1)
    load = np.bincount(packing.differencing(sizes, 256), sizes, 256)
    assert len(made) < 200 and load.sum() == sizes.sum() and (load.min(), load.max()) == (1554, 1676)  # as with all windows
