import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash

from lectern.llm import simhash
from lectern.llm.components import components
from lectern.llm.simhash import LAYOUTS, combinations_of, fingerprint, homes, layout, links, near_duplicates, op2_simhash, visits


def plain(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values, limit):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    for text in ["", " \t ", "One", "a b c", "A b C d e f a b c d", "Ünï ÜNÏ x y z É", "x " * 50]:
        assert fingerprint(text) == plain(text)


@pytest.mark.parametrize("reach", [1, 2])
def test_every_value_has_one_home_and_meets_its_neighbours(reach):
    r = np.random.default_rng(3)
    for bits in (21, 22, 28, 36):
        x = r.integers(0, 1 << bits, 200)
        y = x ^ (1 << r.integers(0, bits, 200)) if reach == 2 else x
        index, anchor = visits(y, bits, reach)
        seen = set(zip(index.tolist(), anchor.tolist()))
        assert all((i, a) in seen for i, a in enumerate(homes(x).tolist()))
        assert all(bin(a ^ b).count("1") <= 1 for a, b in zip(homes(x).tolist(), x.tolist()))


def test_layouts_cover_four_bits_and_grow():
    r = random.Random(6)
    for parts, together, slack in LAYOUTS:
        masks = [sum(((1 << n) - 1) << a for a, n in own) for own in combinations_of(parts, together)]
        for _ in range(2000):
            off = sum(1 << b for b in r.sample(range(64), 4))
            assert min((off & m).bit_count() for m in masks) <= slack
    assert [layout(10**k)[0] for k in (3, 6, 7, 8, 9, 11)] == [3, 3, 7, 7, 8, 9]


def near_values(n):
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(n)]
    for v in values[: n // 2]:
        for _ in range(3):
            values.append(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 7))))
    return sorted(set(values))


@pytest.mark.parametrize("chosen", LAYOUTS)
def test_links_connect_what_brute_force_connects(spark, monkeypatch, chosen):
    monkeypatch.setattr(simhash, "SHARE", 3)
    values = near_values(150)
    fps = np.array(values, np.uint64).view(np.int64)
    pairs = links(spark.createDataFrame(pd.DataFrame({"fp": fps})), chosen=chosen).toPandas().to_numpy(np.int64).view(np.uint64)
    joined = {int(v): int(v) for v in values}

    def find(v):
        while joined[v] != v:
            v = joined[v]
        return v

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        joined[max(x, y)] = min(x, y)
    want = groups(values, 4)
    assert [find(v) for v in values] == [values[i] for i in want]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000, i) for i in range(900, 1000)] + [(5, 5)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base.replace("w7 ", "q7 "), base, None, "", " \n", "other words here", base.upper(), "x y"]
    docs = spark.createDataFrame([(10 - i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    values = [plain(t or "") for t in texts]
    want = groups(values, 4)
    for i, t in enumerate(texts):
        assert got[10 - i].fp & (1 << 64) - 1 == values[i]
        assert got[10 - i].component_id == min(10 - j for j in range(len(texts)) if want[j] == want[i])
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, small):
    docs = sorted((x["doc_id"], x["text"]) for x in pq.read_table(f"{small}/documents.parquet").to_pylist())
    values = [fingerprint(t or "") if len(t or "") > 3000 else plain(t or "") for _, t in docs]
    want = groups(values, 4)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in op2_simhash(spark, small).collect()}
    assert got == {d: (f"{v:016x}", docs[g][0]) for (d, _), v, g in zip(docs, values, want)}
