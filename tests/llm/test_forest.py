import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import forest
from lectern.llm.forest import OP13_SQL, PLACES, TREES, digest_of, next_others, op13_forest, others_in_region, shared, shingle_set, signatures, similar_sets

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare  # noqa: E402


def plain_set(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if len(words) < size:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def plain(docs, least=85):
    """doc_id -> (n_shingles, component_id), all pairs compared; doc_ids differ."""
    sets = [(i, plain_set(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= least * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in sets}


def got(spark, docs):
    rows = similar_sets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def some_groups(r, sizes, words=120, edits=4):
    """Groups of texts around a centre, some of which are linked to few others."""
    docs = []
    for size in sizes:
        centre = [f"w{r.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            centre = edited(r, centre, 1) if r.random() < 0.2 else centre
            docs.append(" ".join(edited(r, centre, r.randrange(edits + 1))))
    r.shuffle(docs)
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a B", "a b c", "A b C d e f a b c d", "Ünï ÜNÏ x y z É", "x " * 50, "a\x0bb\x85c d"])
def test_sets(text):
    assert len(shingle_set(text)) == len(plain_set(text))
    assert (shingle_set(text) == shingle_set("".join(c.lower() if c.isascii() else c for c in text))).all()


def test_regions_agree_as_often_as_sets_are_similar():
    r = random.Random(4)
    base = np.array([r.getrandbits(64) for _ in range(600)], np.uint64)
    sets = [np.sort(np.concatenate([base[:550], np.array([r.getrandbits(64) for _ in range(50)], np.uint64)])) for _ in range(40)]
    regions, places = signatures(sets)
    same = [(places[i] == places[j]).mean() for i in range(40) for j in range(i)]
    assert regions.shape == (40, TREES) and places.shape == (40, PLACES)
    assert np.mean(same) == pytest.approx(550 / 650, abs=0.02)


def some_rows(r, n):
    """Rows of some regions in their order."""
    region, node, root = np.sort(r.integers(0, 40, n)), np.arange(n), r.integers(0, 3, n)
    tail = np.where(r.random((n, PLACES)) < 0.8, 7, r.integers(0, 256, (n, PLACES))).astype(np.uint8)
    regions = np.concatenate([region[:, None], r.integers(1000, 1003, (n, TREES - 1))], axis=1)
    r.permuted(regions, axis=1, out=regions)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1, TREES), pa.int32()), pa.array(regions.ravel()))
    columns = {"region": pa.array(region), "node": pa.array(node), "root": pa.array(root), "n": pa.array(np.full(n, 50)), "tail": pa.array([x.tobytes() for x in tail], pa.binary()), "regions": lists}
    return pa.RecordBatch.from_pydict(columns), region, root, tail, regions


CUTS = ([0, 300], [0, 1, 2, 3, 150, 151, 200, 300], list(range(0, 301, 10)))


@pytest.mark.parametrize("cuts", CUTS, ids=range(3))
def test_pairs_over_batches_are_those_of_all(cuts):
    rows, region, root, tail, regions = some_rows(np.random.default_rng(5), 300)
    first = lambda i, j: next(a for a, b in zip(regions[i], regions[j]) if a == b) == region[i] if (regions[i] == regions[j]).any() else False
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if region[i] == region[j] and root[i] != root[j] and (tail[i] == tail[j]).sum() >= forest.AGREEING and first(i, j)]
    batches = [rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
    got = sorted((a, b) for x in others_in_region(iter(batches)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist()))
    assert got == want and want


def test_the_next_of_another_root():
    rows, region, root, tail, _ = some_rows(np.random.default_rng(6), 300)
    want = []
    for i in range(300):
        j = next((j for j in range(i + 1, 300) if root[j] != root[i] or region[j] != region[i]), None)
        if j is not None and region[i] == region[j] and (tail[i] == tail[j]).sum() >= forest.AGREEING:
            want.append((i, j))
    got = lambda batches: [(a, b) for x in next_others(iter(batches)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    assert got([rows]) == want and set(got([rows.slice(0, 100), rows.slice(100)])) <= set(want)


def test_shared():
    one, many = np.array([2, 5, 9], np.uint64), np.array([1, 2, 5, 9, 3, 10, 9], np.uint64)
    assert shared(one, many, np.array([0, 4, 6])).tolist() == [3, 0, 1]


def test_components_equal_all_pairs(spark):
    docs = some_groups(random.Random(1), [1] * 30 + [2] * 15 + [7] * 5 + [25])
    want = plain(docs)
    assert got(spark, docs) == want and len({c for _, c in want.values()}) > 40


def test_a_crowded_region_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(forest, "CROWD", 4)
    monkeypatch.setattr(forest, "SHARE", 16_000)
    docs = some_groups(random.Random(2), [150, 60, 12, 12, 1, 1], edits=6)
    want = plain(docs)
    assert got(spark, docs) == want and 5 < len({c for _, c in want.values()}) < len(docs)


def test_sets_just_over_and_under(spark):
    """17 of 20 is 0.85; 16 of 19 is less."""
    words = [f"w{i}" for i in range(40)]
    docs = []
    for n in range(10, 39):
        docs += [(2 * n, " ".join(f"{n}{w}" for w in words[:n])), (2 * n + 1, " ".join(f"{n}{w}" for w in words[: n + 3]))]
    assert got(spark, docs) == plain(docs)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (3, "one TWO"), (9, "two one"), (10, long), (4, long + " x"), (11, "a b c"), (2, "a b c a b c a b c")]
    assert got(spark, docs) == {5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 3), 3: (1, 3), 9: (1, 9), 10: (5000, 4), 4: (5001, 4), 11: (1, 11), 2: (3, 2)}
    rows = spark.createDataFrame([(None, "x y z", 1, 1), (None, "x y z", 2, 2), (7, "X y z", 3, 3), (7, "X y z", 3, 3), (None, "alone in here", 4, 4), (None, None, 5, 5), (1, "", 0, 0)], "doc_id long, text string, node int, root int")
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in similar_sets(rows).collect()]
    assert sorted(out, key=str) == sorted([(None, 1, 7), (None, 1, 7), (7, 1, 7), (7, 1, 7), (None, 1, None), (None, 0, None), (1, 0, 1)], key=str)
    assert similar_sets(rows.limit(0)).collect() == []


def test_equal_digests_are_equal_sets():
    assert digest_of(shingle_set("a b c d b c d")) == digest_of(shingle_set("A  b c d b c d b")) != digest_of(shingle_set("a b c d"))


def test_query_equals_its_sql(spark, small):
    con, df = compare.duck(small), op13_forest(spark, small)
    assert compare.kinds(df, con, OP13_SQL) == {}
    assert compare.rows_of_spark(df) == compare.rows_of_duck(con, OP13_SQL)
