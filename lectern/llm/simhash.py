"""Near duplicates by simhash: fingerprints that differ in few bits, found with covering-code anchors.

A fingerprint's 64 bits are divided into parts, and so many parts are taken together that two fingerprints that differ in at most 4
bits differ in at most ``slack`` bits of some combination: one of three parts (slack 1), or all but four of seven to nine (slack 0, as 4 bits
lie in 4 parts at most). Anchors of a combination are the words of a code: a Hamming code over its first 15 bits (perfect, covering
radius 1) and all values of the rest. Each fingerprint lies within distance 1 of exactly one anchor, its home; one that differs from it
in ``slack`` bits lies within radius plus slack of that anchor. So each fingerprint is replicated to all anchors within that
distance in each combination, and compared there, by all 64 bits, with those that are at home.

The more distinct fingerprints, the more parts (``layout``): the number of anchors grows with theirs, so an anchor has a bounded number of homes
and the pairs compared grow as the fingerprints do.

Equal fingerprints are one row before that. A crowded anchor's homes are split by hash into shares of
bounded size and its visitors sent to each share; a share yields a forest of links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointing, give_back, map_texts, small_batches, sized, stored, texts_of
from .components import components

SEED = 42
THRESHOLD = 4
SHINGLE = 4
#: (parts, parts taken together, slack), in the order in which the number of anchors grows.
LAYOUTS = ((3, 1, 1), (7, 3, 0), (8, 4, 0), (9, 5, 0))
CODED = 15
#: Homes of an anchor, on average, beyond which the next layout is taken.
HOMES = 32
#: Homes in one share of an anchor at most, on average.
SHARE = 512
#: Pairs that a task compares at a time.
BLOCK = 1 << 16
#: A combination has fewer bits than this, and its number lies above them.
ANCHOR_BITS = 37


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles in order; a text of ``size`` words or fewer is one, a text without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64-bit simhash of a text's word shingles; 0 for a text without words.

    >>> fingerprint("") == fingerprint(" ") == 0
    True
    """
    return bits_of(shingles(text, size))


def bits_of(hashes: np.ndarray) -> int:
    """The 64 bits of which each is 1 in over half the ``hashes``; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long, the 64 bits) of every row of ``docs`` (doc_id, text); null texts are empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in texts_of(batch, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "doc_id long, fp long", work)


def combinations_of(parts: int, together: int) -> list[tuple[tuple[int, int], ...]]:
    """The combinations of ``together`` of the 64 bits' ``parts``, each as the (first bit, bits) of its parts."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return list(combinations([(a, b - a) for a, b in zip(edges, edges[1:])], together))


def layout(prints: int) -> tuple[int, int, int]:
    """The first of ``LAYOUTS`` in which ``prints`` fingerprints are at most ``HOMES`` an anchor; the last one if none is."""
    for parts, together, slack in LAYOUTS:
        bits = 64 * together // parts
        if prints <= HOMES << (bits - 4):
            break
    return parts, together, slack


def _syndrome(values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(CODED):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


def homes(values: np.ndarray) -> np.ndarray:
    """The anchor within distance 1 of each value: its first 15 bits corrected to a word of the Hamming code."""
    syndrome = _syndrome(values)
    return np.where(syndrome > 0, values ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), values)


def visits(values: np.ndarray, bits: int, reach: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """All (index into ``values``, anchor) with the anchor within distance ``reach`` of the value."""
    index, anchors, syndrome = [], [], _syndrome(values)
    for changed in (c for k in range(reach + 1) for c in combinations(range(bits), k)):
        mask, own = sum(1 << c for c in changed), 0
        for c in changed:
            own ^= c + 1 if c < CODED else 0
        at = np.flatnonzero(syndrome == own)  # the changed value is a code word
        index.append(at)
        anchors.append(values[at] ^ mask)
    return np.concatenate(index), np.concatenate(anchors)


def _replicate(fps: np.ndarray, home: bool, chosen: tuple[int, int, int]) -> pd.DataFrame:
    """anchor (the combination's number in the upper bits) and fp of each fingerprint at home or as a visitor."""
    frames, values = [], fps.view(np.uint64)
    for k, own in enumerate(combinations_of(*chosen[:2])):
        joined, width = np.zeros(len(values), np.int64), 0
        for first, bits in own:
            joined |= (values >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64) << width
            width += bits
        index, anchor = (np.arange(len(joined)), homes(joined)) if home else visits(joined, width, 1 + chosen[2])
        frames.append(pd.DataFrame({"anchor": anchor | k << ANCHOR_BITS, "fp": fps[index]}))
    return pd.concat(frames, ignore_index=True)


def at_anchors(fps: DataFrame, home: bool, chosen: tuple[int, int, int] = LAYOUTS[0]) -> DataFrame:
    """(anchor, fp) for each fingerprint's homes, or for all anchors that it visits."""

    def run(batches):
        for b in batches:
            for a in range(0, len(b), 512):
                yield _replicate(b["fp"].to_numpy(np.int64)[a : a + 512], home, chosen)
        give_back()

    return fps.select("fp").mapInPandas(run, "anchor long, fp long")


def spanning(pairs: np.ndarray) -> np.ndarray:
    """(node, least node of its group) for all nodes that the columns of ``pairs`` link to a smaller one."""
    if not pairs.size:
        return pairs
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(pairs.shape)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (a, b, before[a], before[b]):
            np.minimum.at(label, x, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([nodes[moved], nodes[label[moved]]])


def near_pairs(home: np.ndarray, first: np.ndarray, last: np.ndarray, visitor: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Forests that connect each visitor with those of home[first:last] of its row at ``threshold`` or fewer differing bits.

    Compared in blocks, and shrunk to a forest after each.
    """
    out, width = [], last - first
    ends = np.cumsum(width)
    a = 0
    while a < len(visitor):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        w = width[a:b]
        row = np.repeat(np.arange(a, b), w)
        at = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[a:b], w)
        x, y = visitor[row], home[at]
        near = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= threshold) & (x != y)
        if near.any():
            out.append(spanning(np.stack([x[near], y[near]])))
        a = b
    return out


def compare_sorted(batches, threshold: int):
    """Links from rows (anchor, share, visit, fp) in that order: a share's homes come first and wait while its visitors pass by."""
    kept_share, kept = None, np.zeros(0, np.int64)
    for frame in batches:
        if not len(frame):
            continue
        anchor, share, fp = (frame[c].to_numpy(np.int64) for c in ("anchor", "share", "fp"))
        visit = frame["visit"].to_numpy().astype(bool)
        of = np.cumsum(np.concatenate([[kept_share != (anchor[0], share[0])], (anchor[1:] != anchor[:-1]) | (share[1:] != share[:-1])]))  # 0: the share that waits
        home_of, home = np.concatenate([np.zeros(len(kept), np.int64), of[~visit]]), np.concatenate([kept, fp[~visit]])
        asked = of[visit]
        found = near_pairs(home, np.searchsorted(home_of, asked, "left"), np.searchsorted(home_of, asked, "right"), fp[visit], threshold)
        kept_share, kept = (anchor[-1], share[-1]), home[home_of == of[-1]]
        if found:
            a, b = spanning(np.concatenate(found, axis=1))
            yield pd.DataFrame({"a": a, "b": b})
    give_back()


def links(fps: DataFrame, threshold: int = THRESHOLD, chosen: tuple[int, int, int] | None = None) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``fps`` (distinct fp, stored) that chains of near ones connect."""
    small_batches(fps.sparkSession)
    chosen = chosen or layout(fps.count())
    at_home = at_anchors(fps, True, chosen)
    # an anchor with many homes has several shares; by the layout few have
    crowded = sized(stored(at_home.groupBy("anchor").count().where(F.col("count") > SHARE).select("anchor", F.ceil(F.col("count") / SHARE).alias("shares")), "crowded"))
    shares = F.coalesce("shares", F.lit(1))
    home = at_home.join(crowded, "anchor", "left").select("anchor", F.pmod(F.xxhash64("fp"), shares).alias("share"), F.lit(0).alias("visit"), "fp")
    visitor = at_anchors(fps, False, chosen).join(crowded, "anchor", "left").select("anchor", "fp", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share")).select("anchor", "share", F.lit(1).alias("visit"), "fp")
    rows = home.unionByName(visitor).repartition("anchor", "share").sortWithinPartitions("anchor", "share", "visit")
    return rows.mapInPandas(lambda batches: compare_sorted(batches, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text): the least doc_id that chains of links reach.

    Links are between fingerprints with ``threshold`` (4 at most) or fewer differing bits. Null, empty and
    wordless texts have fingerprint 0 and are linked like others. Repeated rows come out repeated; other columns
    aren't read; an empty table gives no rows.
    """
    if not 0 <= threshold <= 4:
        raise ValueError("the anchors cover thresholds of 0 to 4")
    checkpointing(docs.sparkSession)
    own = stored(fingerprints(docs, size), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, threshold)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
