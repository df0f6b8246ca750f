import random

import numpy as np
import pytest

from lectern.llm.substrings import is_dense, remove_repeats, repeated_in_shard
from lectern.llm.suffixes import permuted_common_prefixes, suffix_array


def test_suffix_array_and_common_prefixes():
    r = random.Random(1)
    for _ in range(200):
        k = r.choice([1, 2, 4, 60, 3000])
        x = np.array([r.randint(1, k) for _ in range(r.randint(1, 70))] + [0], np.int64)
        n = len(x)
        want = sorted(range(n), key=lambda i: x[i:].tolist())
        assert suffix_array(x).tolist() == want
        plcp, _ = permuted_common_prefixes(x, np.array(want), np.arange(n)[::-1].copy())
        for a, b in zip(want, want[1:]):
            shared = 0
            while max(a, b) + shared < n - 1 and x[a + shared] == x[b + shared]:
                shared += 1
            assert plcp[b] == shared


def test_shard():
    assert repeated_in_shard([b"abcdefg", b"xbcdefy", b"zzzz"], 4) == [[(1, 3)], [(1, 3)], []]
    assert repeated_in_shard([b"aaaaaa"], 4) == [[(0, 3)]]


def brute(texts, length):
    at = {}
    data = [(t or "").encode() for t in texts]
    for i, d in enumerate(data):
        for s in range(len(d) - length + 1):
            at.setdefault(d[s : s + length], []).append((i, s))
    gone = [bytearray(len(d)) for d in data]
    for places in at.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = b"\1" * length
    return [(bytes(c for c, g in zip(d, m) if not g), sum(m), len([x for x in bytes(m).split(b"\0") if x])) for d, m in zip(data, gone)]


@pytest.mark.parametrize("length,gram,crowd", [(40, 20, 2000), (40, 20, 1), (24, 8, 3)])
def test_documents_equal_brute_force(spark, length, gram, crowd):
    r = random.Random(length + crowd)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(4)]
    texts = [None, "", "short", "same " * 40, "x" * 300]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(passages))
        texts.append(" ".join(parts))
    texts += texts[10:14] + [texts[20][:-9] + "changed", texts[21][30:]]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(7, texts[7], 5)], "doc_id long, text string, sig int")
    got = sorted(((x.doc_id, bytes(x.kept), x.n_bytes, len(x.spans)) for x in remove_repeats(docs, length, gram, crowd).collect()))
    want = brute([*texts, texts[7]], length)
    ids = [*range(len(texts)), 7]
    assert got == sorted((i, k, len((([*texts, texts[7]])[j] or "").encode()), s) for j, (i, (k, _, s)) in enumerate(zip(ids, want)))


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dense_texts_are_told_where_they_are_cut(spark):
    texts = [None, "", "a b c", "a  bbbbbb\tc", "ab cd", "aaaaaa b c d"]
    want = [False, False, True, False, False, True]
    assert [is_dense((t or "").encode(), 3, 6) for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.dense for r in remove_repeats(docs, 40, 20, dense=(3, 6)).orderBy("doc_id").collect()] == want
