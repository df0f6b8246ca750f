"""Near copies by the similarity of their word shingles: candidates by simhash anchors and by minima of hashes, each verified.

Texts of the same shingles are one content. Candidates come from two sources:

1. Simhash fingerprints of the shingles, linked at covering-code anchors (``simhash.links``): they gather groups of close copies in
   as many links as there are copies. A pair of Jaccard similarity 0.8 differs in about ten of 64 bits, out of the anchors' reach.
2. Keys of minima: a content has ``BANDS`` keys, each of the minima of ``ROWS`` hash functions. A pair of similarity s shares none with
   probability (1 - s^ROWS)^BANDS, which is 3.2e-6 at 0.8 and less above.

A key's contents are first compared with the most central of them each, which shares the most keys with others: the text of which a large
group's copies were made has all the group's common keys. Contents of one key that are not connected by then are compared with
each other where a key has no more than ``CROWD`` of them. Where it has more, each is first compared with ``DRAWN`` of them, drawn by a hash of key
and content, which connects most. What still isn't connected in such a key is then compared pair by pair too: its contents are dealt to parts of about
``PART``, and each two parts meet in a task of their own (``crowded_links``). There sketches are held against each other first. Contents with a partner by
sketch meet again with all their shingles, and only links leave those tasks, at most one for each two roots. So no key loses a pair; comparisons grow with the square
of a key's contents that are linked with none, rows and the memory of a task don't. A content of which too few shingles occur in any other of its task is in no pair.

A pair is left out if the counts of shingles rule the similarity out or their sketches (a byte of each minimum) agree in under
``SKETCHED`` of the places, which a pair at 0.8 does with probability 2e-6; the others' texts are compared shingle by shingle, so that
no link is a guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointing, map_texts, sized, stored, texts_of
from .components import components
from .simhash import bits_of, links

SHINGLE = 5
LEAST = 0.8
#: Keeps the rounding of products from ruling out a pair at exactly ``LEAST``.
SLACK = 1e-9
BANDS, ROWS = 24, 4
#: Least share of a sketch's places in which a pair at ``LEAST`` agrees.
SKETCHED = 0.6
#: Contents of one key that are compared pair by pair at once, and how many of more are compared with all of them before those that are left are compared.
CROWD, DRAWN = 32, 2
#: Contents of a crowded key in one part, on average, and how many of a part are held against another at a time.
PART, ROWS_AT_ONCE = 1024, 64
#: Where whole sets of shingles meet, a part has no more than ``PART`` times as many on average.
MEAN = 512
_random = np.random.default_rng(42)
XORS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
ODDS = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
FOLD = np.uint64(0x9E3779B97F4A7C15)
PLACES = _random.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of a text's shingles of ``SHINGLE`` words in order, A-Z in lower case; a text of fewer words is one, without words none."""
    words, digest = text.encode("utf-8", "surrogatepass").lower().split(), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), 1)] if words else [], np.uint64)
    own = np.fromiter(map(digest, words), np.uint64, len(words))
    out = own[: len(own) - SHINGLE + 1] * PLACES[0]
    for k in range(1, SHINGLE):
        out ^= out >> np.uint64(31)
        out += own[k : len(own) - SHINGLE + 1 + k] * PLACES[k]
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        out ^= out >> np.uint64(31)
        out *= np.uint64(odd)
    return out ^ out >> np.uint64(31)


def minima(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of ``BANDS`` keys, a row of ``BANDS`` * ``ROWS`` sketch bytes) for each of the sets of hashes, none of which is empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), BANDS), np.uint64)
    sketch = np.empty((len(sets), BANDS * ROWS), np.uint8)
    mixed = np.empty_like(joined)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(joined, XORS[i], out=mixed)
            np.multiply(mixed, ODDS[i], out=mixed)
            least = np.minimum.reduceat(mixed, starts)
            sketch[:, i] = least >> np.uint64(24) & np.uint64(255)
            key = (key ^ least) * FOLD
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64), sketch


def _contents(docs: DataFrame) -> DataFrame:
    """doc_id, sig (of the text), content (of its shingles), n (different shingles), fp (simhash), keys and sketch of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_ = [shingles(t) for t in texts_of(batch, "text")]
        fps = np.array([bits_of(x) for x in all_], np.uint64).view(np.int64)
        sets = [np.unique(x) for x in all_]
        content = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        n = np.array([len(x) for x in sets], np.int64)
        at = np.flatnonzero(n)
        keys: list = [[]] * len(sets)
        sketches: list = [b""] * len(sets)
        if len(at):
            for i, row, sketch in zip(at.tolist(), *minima([sets[i] for i in at])):
                keys[i], sketches[i] = row, sketch.tobytes()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), pa.array(content), pa.array(n), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "sig", "content", "n", "fp", "keys", "sketch"])

    return map_texts(docs.select("doc_id", "sig", "text"), "text", "doc_id long, sig long, content long, n long, fp long, keys array<long>, sketch binary", work, 1 << 20)


def _alike(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose sketches may belong to similar contents."""
    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("a_sketch", "b_sketch"))
    at = np.flatnonzero((x == y).sum(axis=1) >= SKETCHED * BANDS * ROWS)
    return batch.select(["a", "b", "a_sig", "b_sig"]).take(pa.array(at))


def _similar(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows (a, b) whose texts are alike."""
    found = []
    known: dict[str, np.ndarray] = {}  # neighbouring rows share texts
    for i, pair in enumerate(zip(texts_of(batch, "a_text"), texts_of(batch, "b_text"))):
        if len(known) > 64:
            known.clear()
        for t in pair:
            if t not in known:
                known[t] = np.unique(shingles(t))
        x, y = (known[t] for t in pair)
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both >= LEAST * (len(x) + len(y) - both) - SLACK:
            found.append(i)
    return batch.select(["a", "b"]).take(pa.array(found, pa.int64()))


def _met(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of two parts of a key, or of one with itself, in blocks by x: contents of different roots whose counts and sketches may belong to similar ones."""
    low, high, part = (table.column(c).to_numpy() for c in ("low", "high", "part"))
    content, root, n = (table.column(c).to_numpy() for c in ("content", "root", "n"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    here = np.flatnonzero(part == low)
    # rows of one root together, which aren't held against each other
    here = here[np.argsort(root[here], kind="stable")]
    there = np.flatnonzero(part == high)
    for i in range(0, len(here), ROWS_AT_ONCE):
        own = here[i : i + ROWS_AT_ONCE]
        others = there[root[there] != root[own[0]]] if root[own[0]] == root[own[-1]] else there
        at, to = np.nonzero((root[own][:, None] != root[others]) & (np.minimum(n[own][:, None], n[others]) >= LEAST * np.maximum(n[own][:, None], n[others]) - SLACK))
        x, y = own[at], others[to]
        if low[0] == high[0]:
            x, y = x[content[x] < content[y]], y[content[x] < content[y]]
        for j in range(0, len(x), 1 << 14):
            a, b = x[j : j + (1 << 14)], y[j : j + (1 << 14)]
            near = (sketch[a] == sketch[b]).sum(axis=1) >= SKETCHED * BANDS * ROWS
            yield a[near], b[near]


def _across(table: pa.Table) -> pa.Table:
    """(a, b): the contents of all pairs of rows that ``_met`` has."""
    content = table.column("content").to_numpy()
    found = [np.zeros((2, 0), np.int64), *(content[np.stack(pair)] for pair in _met(table))]
    a, b = np.concatenate(found, axis=1)
    return pa.table({"a": a, "b": b})


def _asked(table: pa.Table) -> pa.Table:
    """(key, content) of the rows that are in any pair of ``_met``."""
    asked = np.zeros(len(table), bool)
    for pair in _met(table):
        asked[np.concatenate(pair)] = True
    return table.select(["key", "content"]).filter(pa.array(asked))


def _linked(table: pa.Table) -> pa.Table:
    """(a, b): links between contents whose shingles are alike, one for each two roots that they connect; never all pairs."""
    content, part, low, high = (table.column(c).to_numpy() for c in ("content", "part", "low", "high"))
    sets = table.column("shingles").to_pylist()
    n = np.array([len(x) // 8 for x in sets], np.int64)
    starts = np.cumsum(n) - n
    values, ids = np.unique(np.frombuffer(b"".join(sets), np.int64), return_inverse=True)
    of = np.repeat(np.arange(len(n)), n)
    # of a row's shingles, those that another row holds against which it may be held: no pair has more in common
    sides = [np.bincount(ids[(part == p)[of]], minlength=len(values)) for p in (low[0], high[0])]
    held = sides[0] > 1 if low[0] == high[0] else (sides[0] > 0) & (sides[1] > 0)
    most = np.bincount(of, weights=held[ids], minlength=len(n)) if len(of) else np.zeros(len(n))
    _, group = np.unique(table.column("root").to_numpy(), return_inverse=True)
    marked = np.zeros(len(values), bool)
    found = []
    for a, b in _met(table):
        able = np.minimum(most[a], most[b]) >= LEAST / (1 + LEAST) * (n[a] + n[b]) - SLACK
        a, b = a[able], b[able]
        for x, others in zip(a[np.flatnonzero(np.diff(a, prepend=-1))], np.split(b, np.flatnonzero(np.diff(a)) + 1)):
            others = others[group[others] != group[x]]
            if not len(others):
                continue
            own, width = ids[starts[x] : starts[x] + n[x]], n[others]
            first = np.cumsum(width) - width
            at = np.arange(width.sum()) + np.repeat(starts[others] - first, width)
            marked[own] = True
            both = np.add.reduceat(marked[ids[at]], first, dtype=np.int64)
            marked[own] = False
            for y in others[both >= LEAST * (n[x] + width - both) - SLACK]:
                if group[y] != group[x]:
                    found.append((content[x], content[y]))
                    group[group == group[y]] = group[x]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def _meetings(rows: DataFrame, heads: DataFrame, size: int) -> GroupedData:
    """``rows`` (key, content, root, k) with the columns of ``heads``, dealt to parts of about ``size`` of a key's k; a group is two parts of a key or one with itself."""
    parts = F.greatest(F.ceil(F.col("k") / size), F.lit(1)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    own = ["key", "content", "root", "part", *[c for c in heads.columns if c != "content"]]
    sent = dealt.join(heads, "content").select(*own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return sent.select(*own, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).groupBy("key", "low", "high")


def crowded_pairs(rows: DataFrame, heads: DataFrame, size: int = PART) -> DataFrame:
    """(a, b): all pairs of ``rows`` (key, content, root, k: the key's contents) of one key and different roots that counts and sketches allow; pairs may come twice."""
    return _meetings(rows, heads.select("content", "n", "sketch"), size).applyInArrow(_across, "a long, b long")


def crowded_links(rows: DataFrame, heads: DataFrame, docs: DataFrame, size: int = PART) -> DataFrame:
    """(a, b): links, stored, that connect all roots which similar texts of one key of ``rows`` (key, content, root, k: the key's contents) connect.

    The pairs of ``crowded_pairs`` are compared shingle by shingle where they meet, so that only links leave a task. Shingles are sent for those contents alone that are in such a pair.
    """
    heads = heads.select("content", "sig", "n", "sketch")
    asked = stored(_meetings(rows, heads.drop("sig"), size).applyInArrow(_asked, "key long, content long").distinct(), "asked")
    needed = sized(stored(heads.join(asked.select("content").distinct(), "content", "left_semi"), "needed"), 100_000)
    texts = docs.select("sig", "text").join(needed.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(t)).tobytes() for t in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(sets, pa.binary())], ["sig", "shingles"])

    sets = stored(map_texts(texts, "text", "sig long, shingles binary", work, 1 << 20), "sets")
    heads = stored(needed.join(sets, "sig").drop("sig"), "whole")
    left = rows.select("key", "content", "root").join(asked, ["key", "content"], "left_semi")
    weight = left.join(needed, "content").groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") / MEAN)).alias("k"))
    return stored(_meetings(left.join(weight, "key"), heads, size).applyInArrow(_linked, "a long, b long").distinct(), "linked")


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): the ``pairs`` (a, b: contents) whose texts have a Jaccard similarity of ``LEAST`` or more, stored."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda p: heads.select(F.col("content").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("sig", "n", "sketch")])
    close = F.least("a_n", "b_n") >= LEAST * F.greatest("a_n", "b_n") - SLACK
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b", "a_sig", "b_sig", "a_sketch", "b_sketch")
    both = stored(map_texts(both, "a_sketch", "a long, b long, a_sig long, b_sig long", _alike), "alike")
    needed = sized(stored(both.select(F.explode(F.array("a_sig", "b_sig")).alias("sig")).distinct(), "needed"))
    texts = stored(docs.select("sig", "text").join(needed, "sig", "left_semi").dropDuplicates(["sig"]), "texts")
    whole = both.join(texts.toDF("b_sig", "b_text"), "b_sig").join(texts.toDF("a_sig", "a_text"), "a_sig").select("a", "b", "a_text", "b_text")
    return stored(map_texts(whole, "b_text", "a long, b long", _similar), "similar")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, sig, content and root of every row of ``docs`` (doc_id, sig, text): rows of one root are linked by chains of near copies.

    Near copies share ``LEAST`` or more of all their different ``SHINGLE``-word shingles. Null, empty and wordless texts are copies of each other.
    """
    checkpointing(docs.sparkSession)
    own = stored(_contents(docs), "contents")
    # any text of a content has its shingles
    heads = stored(own.where("n > 0").groupBy("content").agg(F.min("sig").alias("sig"), *[F.first(c).alias(c) for c in ("n", "fp", "keys", "sketch")]), "heads")

    prints = stored(heads.groupBy("fp").agg(F.min("content").alias("least")), "prints")
    linked = links(prints).join(prints.toDF("a", "l"), "a").join(prints.toDF("b", "m"), "b").select(F.col("l").alias("a"), F.col("m").alias("b"))
    printed = heads.join(prints, "fp").select(F.col("content").alias("a"), F.col("least").alias("b"))

    banded = heads.select("content", F.explode("keys").alias("key"))
    often = stored(banded.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "often")
    banded = stored(banded.join(often, "key"), "shared")
    central = stored(banded.groupBy("content").agg(F.sum("k").alias("sharing")), "central")
    one = banded.join(central, "content").groupBy("key").agg(F.max_by("content", F.struct("sharing", "content")).alias("one"))
    stars = banded.join(stored(one, "one"), "key").select(F.col("content").alias("a"), F.col("one").alias("b"))
    first = verified(linked.unionByName(printed).unionByName(stars), heads, docs)

    def grown(roots: DataFrame, found: DataFrame) -> DataFrame:
        more = roots.select(F.col("content").alias("a"), F.col("root").alias("b")).unionByName(found)
        return stored(components(more), "roots").withColumnRenamed("node", "content")

    def unconnected(roots: DataFrame, shared: DataFrame) -> DataFrame:
        """key, content, root and k (the key's contents) of the keys of ``shared`` whose contents are of several roots."""
        rooted = shared.select("key", "content").join(roots, "content", "left").select("key", "content", F.coalesce("root", "content").alias("root"))
        open_ = rooted.groupBy("key").agg(F.count("*").alias("k"), F.min("root").alias("m"), F.max("root").alias("x")).where("m <> x").select("key", "k")
        return stored(rooted.join(stored(open_, "open"), "key"), "rooted")

    roots = stored(components(first), "roots").withColumnRenamed("node", "content")
    rooted = unconnected(roots, banded)
    side = lambda rows, p: rows.select("key", F.col("content").alias(p), F.col("root").alias(f"{p}_root"))
    few, many = rooted.where(F.col("k") <= CROWD), rooted.where(F.col("k") > CROWD)
    place = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("content", "key"), "content"))
    drawn = stored(side(many, "b").withColumn("content", F.col("b")).withColumn("place", place).where(F.col("place") <= DRAWN), "drawn")
    rest = [side(few, "a").join(side(few, "b"), "key").where("a_root < b_root"), side(many, "a").join(drawn, "key").where("a_root <> b_root")]
    rest = verified(rest[0].select("a", "b").unionByName(rest[1].select("a", "b")), heads, docs)
    if not rest.isEmpty():
        roots = grown(roots, rest)
    if not many.isEmpty():
        left = unconnected(roots, many)
        last = crowded_links(left, heads, docs) if not left.isEmpty() else left
        if not last.isEmpty():
            roots = grown(roots, last)
    return own.select("doc_id", "sig", "content").join(roots, "content", "left").select("doc_id", "sig", "content", F.coalesce("root", "content").alias("root"))
