"""Near copies by the similarity of their word shingles, with a forest of sorted signatures (LSH forest).

Texts of one set of shingles are one content, told by a 128-bit digest of the set. A content's signature is ``TREES`` * ``DEPTH`` minima of hash functions;
each tree orders all contents by the signature from its own ``DEPTH`` minima on, cyclically. Two contents of similarity s agree in a tree's first ``DEPTH`` minima
with probability s^DEPTH, and in no tree's with (1 - s^DEPTH)^TREES: 3.9e-7 at 0.85, less above. So a tree's regions are the contents with equal first minima, and a link is
looked for between those that share a region:

1. In each tree a content meets the next in the order, with which it has the longest common prefix: as deep as that region is dense. For each content the neighbour
   that agrees best in the whole signature is confirmed on the full sets. So large groups of copies grow together, by no more comparisons than they
   have members.
2. Contents of one region that aren't known to be connected by then are compared with each other. In regions of up to ``CROWD`` contents, by their signatures first: pairs that agree in
   too few places, which a pair at ``LEAST`` does with probability 2e-7, go, and the others are confirmed on the full sets.
3. In a crowded region the contents outside its largest group meet all of its contents with their full sets, in shares of the region of bounded size, so
   that only confirmed links leave the task that compares them. Nothing is drawn or left out.

A pair is compared in the first tree in which it shares a region, and in no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointing, map_texts, sized, stored, texts_of
from .components import components
from .simhash import spanning

SHINGLE = 3
#: Percent of two sets' union that their intersection has at least.
LEAST = 85
TREES, DEPTH = 20, 4
PLACES = TREES * DEPTH
CROWD = 32
#: Bytes of the sets of a crowded region that are in one share, on average.
SHARE = 8 << 20
#: Places in which two signatures agree at least: of 80 a pair at 0.85 agrees in fewer with probability 1.9e-7.
AGREEING = 50
_random = np.random.default_rng(13)
XORS = _random.integers(0, 1 << 64, PLACES, np.uint64)
ODDS = _random.integers(0, 1 << 64, PLACES, np.uint64) | np.uint64(1)
STEPS = _random.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
FOLD = np.uint64(0x9E3779B97F4A7C15)
LINK = "a long, b long"


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of a text's different ``size``-word shingles in order of size, A-Z in lower case; a text of fewer words is one, without words none."""
    words, digest = text.encode("utf-8", "surrogatepass").lower().split(), xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), 1)] if words else [], np.uint64)
    own = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(own) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out ^= out >> np.uint64(31)
        out += own[k : n + k] * STEPS[k]
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        out ^= out >> np.uint64(31)
        out *= np.uint64(odd)
    return np.unique(out ^ out >> np.uint64(31))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the ``TREES`` regions, a byte of each of the ``PLACES`` minima) of each of the sets, none of which is empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    regions, places = np.empty((len(sets), TREES), np.uint64), np.empty((len(sets), PLACES), np.uint8)
    mixed = np.empty_like(joined)
    for tree in range(TREES):
        key = np.full(len(sets), tree + 1, np.uint64) * FOLD
        for i in range(tree * DEPTH, (tree + 1) * DEPTH):
            np.bitwise_xor(joined, XORS[i], out=mixed)
            np.multiply(mixed, ODDS[i], out=mixed)
            least = np.minimum.reduceat(mixed, starts)
            places[:, i] = least >> np.uint64(24) & np.uint64(255)
            key = (key ^ least) * FOLD
            key ^= key >> np.uint64(29)
        regions[:, tree] = key
    return regions.view(np.int64), places


def with_signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, sig, digest (of the set), n (its size), regions and places of every row of ``docs`` (doc_id, sig, text); empty sets have no digest and no regions."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in texts_of(batch, "text")]
        n = np.array([len(x) for x in sets], np.int64)
        regions, places = [[]] * len(sets), [b""] * len(sets)
        at = np.flatnonzero(n).tolist()
        if at:
            for i, own, bytes_ in zip(at, *signatures([sets[i] for i in at])):
                regions[i], places[i] = own, bytes_.tobytes()
        digests = [digest_of(x) if len(x) else None for x in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sig"), pa.array(digests, pa.binary()), pa.array(n), pa.array(regions, pa.list_(pa.int64())), pa.array(places, pa.binary())],
            ["doc_id", "sig", "digest", "n", "regions", "places"],
        )

    return map_texts(docs.select("doc_id", "sig", "text"), "text", "doc_id long, sig long, digest binary, n long, regions array<long>, places binary", work)


def digest_of(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8).reshape(-1, PLACES)


def _close(n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar."""
    return 100 * np.minimum(n, m) >= least * np.maximum(n, m)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _regions(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("regions").flatten().to_numpy().reshape(-1, TREES)


def _first_here(x: np.ndarray, y: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Whether ``region`` is the first that both of (rows of) ``x`` and ``y`` are in."""
    same = x == y
    at = same.argmax(axis=-1)
    return same.any(axis=-1) & (np.take_along_axis(np.broadcast_to(x, same.shape), at[..., None], axis=-1)[..., 0] == region)


def next_others(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """root, agree, a and b from rows (region, node, root, n, tail) in order of region and tail: each row with the next of another root in its region."""
    waiting: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy() for c in ("region", "node", "root", "n")] + [_matrix(batch, "tail")]
        region, node, root, n, tail = (np.concatenate(x) for x in zip(waiting, own)) if waiting else own
        cut = np.flatnonzero((region[1:] != region[:-1]) | (root[1:] != root[:-1])) + 1  # where another root or region begins
        first = np.arange(len(region))
        after = np.append(cut, len(region))[np.searchsorted(cut, first, "right")]
        first, after = first[after < len(region)], after[after < len(region)]
        ok = (region[first] == region[after]) & _close(n[first], n[after], least)
        first, after = first[ok], after[ok]
        agree = (tail[first] == tail[after]).sum(axis=1)
        ok = agree >= AGREEING
        first, after = first[ok], after[ok]
        yield pa.RecordBatch.from_arrays([pa.array(root[first]), pa.array(agree[ok].astype(np.int32)), pa.array(node[first]), pa.array(node[after])], ["root", "agree", "a", "b"])
        waiting = [x[-1:] for x in (region, node, root, n, tail)]


def others_in_region(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (region, node, root, n, tail, regions) in order of region, ``CROWD`` in one at most: those of different roots that may be similar and share no region before."""
    waiting: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy() for c in ("region", "node", "root", "n")] + [_matrix(batch, "tail"), _regions(batch)]
        seen = len(waiting[0]) if waiting else 0
        region, node, root, n, tail, regions = (np.concatenate(x) for x in zip(waiting, own)) if waiting else own
        for ahead in range(1, len(region)):
            first = np.arange(max(seen - ahead, 0), len(region) - ahead)
            first = first[region[first] == region[first + ahead]]
            if not len(first):
                break
            first = first[(root[first] != root[first + ahead]) & _close(n[first], n[first + ahead], least)]
            first = first[(tail[first] == tail[first + ahead]).sum(axis=1) >= AGREEING]
            first = first[_first_here(regions[first], regions[first + ahead], region[first])]
            if len(first):
                yield _links(node[first], node[first + ahead])
        last = int(np.searchsorted(region, region[-1]))
        waiting = [x[last:] for x in (region, node, root, n, tail, regions)]


def shared(one: np.ndarray, many: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes the sorted set ``one`` has in common with each of the sets that lie in ``many`` from ``starts`` on."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    return np.add.reduceat((one[at] == many).astype(np.int64), starts)


def met(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Links from rows (region, share, visit, node, root, regions, hashes) in that order: a share's contents come first and wait while its visitors pass by.

    Of what it finds, a share gives links that connect as much.
    """
    kept_of, nodes, roots, regions, sets = None, None, None, None, []
    joined: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        region, share, visit, node, root = (batch.column(c).to_numpy() for c in ("region", "share", "visit", "node", "root"))
        own, hashes = _regions(batch), [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.flatnonzero((region[1:] != region[:-1]) | (share[1:] != share[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(region)]):
            home = a + int(np.count_nonzero(visit[a:b] == 0))
            if kept_of != (region[a], share[a]):
                kept_of, nodes, roots, regions, sets, joined = (region[a], share[a]), node[a:home], root[a:home], own[a:home], hashes[a:home], None
            elif home > a:
                nodes, roots, regions = (np.concatenate(x) for x in ((nodes, node[a:home]), (roots, root[a:home]), (regions, own[a:home])))
                sets, joined = sets + hashes[a:home], None
            if home == b or not len(sets):
                continue
            if joined is None:
                sizes = np.array([len(s) for s in sets])
                joined = np.concatenate(sets), sizes
            many, sizes = joined
            starts = np.cumsum(sizes) - sizes
            for i in range(home, b):
                one = hashes[i]
                ok = (roots != root[i]) & _close(len(one), sizes, least) & _first_here(own[i][None], regions, region[i])
                if not ok.any():
                    continue
                at = np.flatnonzero(ok)
                n = sizes[at]
                begins = np.cumsum(n) - n
                both = shared(one, many[np.repeat(starts[at] - begins, n) + np.arange(n.sum())], begins)
                at = at[100 * both >= least * (len(one) + n - both)]
                if len(at):
                    at = at[np.unique(roots[at], return_index=True)[1]]
                    found.append((np.full(len(at), node[i]), nodes[at]))
            if found:
                yield _links(*spanning(np.stack([np.concatenate(x) for x in zip(*found)])))
                found = []


class Contents:
    """The contents of a table, and what connects them.

    ``heads`` has node (number of the content), digest, named (a row that has it: doc_id, sig), n, regions and places; ``rows`` has the contents of each region
    of more than one: region, k (how many), node, n, regions and tail, the places in the tree's order; ``sets`` the hashes of those contents; ``roots`` node and root of those that are linked.
    """

    def __init__(self, docs: DataFrame, own: DataFrame, least: int, size: int):
        self.docs, self.least, self.size = docs, least, size
        a_row = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sig"))
        heads = own.where("n > 0").groupBy("digest").agg(a_row.alias("named"), *[F.first(c).alias(c) for c in ("n", "regions", "places")])
        self.heads = stored(heads.withColumn("node", F.monotonically_increasing_id()), "heads")
        self.rows = self._rows()
        self.sets = self._sets()
        self.roots: DataFrame | None = None

    def _rows(self) -> DataFrame:
        rows = self.heads.select("node", F.posexplode("regions").alias("tree", "region"))
        often = stored(rows.groupBy("region").agg(F.count("*").alias("k")).where("k > 1"), "often")
        # only contents that share a region take their signatures along
        rows = stored(rows.join(sized(often), "region"), "shared").join(self.heads.select("node", "n", "regions", "places"), "node")
        cut = (F.col("tree") + 1) * DEPTH
        tail = F.concat(F.substr("places", cut + 1), F.substr("places", F.lit(1), cut))
        return stored(rows.select("region", "k", "node", "n", "regions", tail.alias("tail")), "regions")

    def _sets(self) -> DataFrame:
        nodes = self.rows.select("node").distinct()
        needed = stored(self.heads.join(nodes, "node", "left_semi").select("node", "digest", F.col("named.doc_id").alias("of"), F.col("named.sig").alias("of_sig")), "needed")
        texts = self.docs.join(sized(needed), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("of_sig"))).select("node", "digest", "text")
        size = self.size

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, size) for t in texts_of(batch, "text")]
            at = [i for i, (x, d) in enumerate(zip(sets, batch.column("digest").to_pylist())) if digest_of(x) == d]
            return pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at, pa.int64())), pa.array([sets[i].tobytes() for i in at], pa.binary())], ["node", "hashes"])

        return stored(map_texts(texts, "text", "node long, hashes binary", work).dropDuplicates(["node"]), "sets")

    def rooted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the root of each node; one that isn't linked is its own."""
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """(a, b): the ``pairs`` whose whole sets are similar."""
        least = self.least

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("a_set", "b_set"))
            both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)]
            at = [i for i, (k, p, q) in enumerate(zip(both, x, y)) if 100 * k >= least * (len(p) + len(q) - k)]
            return batch.select(["a", "b"]).take(pa.array(at, pa.int64()))

        rows = pairs.join(self.sets.toDF("a", "a_set"), "a").join(self.sets.toDF("b", "b_set"), "b").select("a", "b", "a_set", "b_set")
        return map_texts(rows, "a_set", LINK, work)

    def gather(self, links: DataFrame) -> DataFrame:
        """The ``links`` (a, b), stored. Their contents get as root the least content within two links or more; what has one root is connected, not all that is connected has."""
        links = stored(links, "confirmed")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("near")), "near")
        self.roots = stored(near.join(near.toDF("near", "root"), "near").select("node", "root"), "roots")
        return links

    def between_roots(self, links: DataFrame) -> DataFrame:
        """The ``links`` (a, b) as links of their contents' roots."""
        for side in ("a", "b"):
            links = self.rooted(links.withColumnRenamed(side, "node")).drop("node").withColumnRenamed("root", side)
        return links.select("a", "b")

    def best_neighbours(self) -> DataFrame:
        """a, b: for each root the pair that agrees most among those of its contents with the next of another root in their regions."""
        least = self.least
        rows = self.rooted(self.rows).select("region", "node", "root", "n", "tail")
        ordered = rows.repartitionByRange("region", "tail", "node").sortWithinPartitions("region", "tail", "node")
        found = ordered.mapInArrow(lambda batches: next_others(batches, least), "root long, agree int, a long, b long")
        return stored(found.groupBy("root").agg(F.max(F.struct("agree", "a", "b")).alias("pair")).select("pair.a", "pair.b"), "best")

    def others(self) -> DataFrame:
        """a, b: the pairs of different roots in regions that aren't crowded."""
        least = self.least
        rows = self.rooted(self.rows.where(F.col("k") <= CROWD)).select("region", "node", "root", "n", "tail", "regions")
        return rows.repartition("region").sortWithinPartitions("region").mapInArrow(lambda batches: others_in_region(batches, least), LINK)

    def met_in_crowds(self) -> DataFrame:
        """Links of crowded regions: of all contents outside a region's largest root with all of the region."""
        least = self.least
        rows = stored(self.rooted(self.rows.where(F.col("k") > CROWD)).select("region", "node", "root", "n", "regions"), "crowded")
        groups = rows.groupBy("region", "root").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
        parted = groups.groupBy("region").agg(F.count("*").alias("groups"), F.max_by("root", F.struct("size", "root")).alias("largest"), F.ceil(8 * F.sum("n") / SHARE).alias("shares")).where("groups > 1")
        rows = rows.join(sized(stored(parted, "parted")), "region").join(self.sets, "node")
        homes = rows.withColumns({"share": F.pmod(F.xxhash64("node"), F.col("shares")), "visit": F.lit(0)})
        visitors = rows.where("root <> largest").withColumns({"share": F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)), "visit": F.lit(1)})
        dealt = homes.unionByName(visitors).select("region", "share", "visit", "node", "root", "regions", "hashes").repartition("region", "share").sortWithinPartitions("region", "share", "visit")
        return dealt.mapInArrow(lambda batches: met(batches, least), LINK)


def similar_sets(docs: DataFrame, least: int = LEAST, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text): the least doc_id that links reach.

    Linked are texts whose sets of ``size``-word shingles have an intersection of ``least`` percent of their union or more, each confirmed on the whole sets; at less than 85 the trees find fewer of them.
    Null, empty and wordless texts have the empty set and are linked with nothing: their component_id is their doc_id. A null doc_id has the least other one that is reached, null if there is none.
    Repeated rows come out repeated; other columns aren't read; an empty table gives no rows.
    """
    checkpointing(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"))
    own = stored(with_signatures(docs, size), "signatures")
    contents = Contents(docs, own, least, size)
    first = contents.gather(contents.confirmed(contents.best_neighbours()))
    found = contents.confirmed(contents.others()).unionByName(contents.met_in_crowds())
    # what has one root by now is one node of the graph that is left
    left = contents.between_roots(first.unionByName(found))
    whole = components(left).toDF("root", "whole")
    heads = contents.rooted(contents.heads.select("node", "digest", F.col("named.doc_id").alias("first"))).join(whole, "root", "left")
    heads = heads.select("node", "digest", "first", F.coalesce("whole", "root").alias("root"))
    heads = stored(heads, "rooted")
    named = heads.join(heads.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("digest", "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.where("n > 0").join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op13_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents, and the document of each that is kept."""
    rows = similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Sets by word shingles, all pairs that share one, and what chains of links reach.
OP13_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
 both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
 SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
