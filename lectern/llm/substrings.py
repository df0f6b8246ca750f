"""Removal of byte strings that occur more than once, with suffix arrays over shards.

Every ``length``-byte window of every text chooses one anchor, the ``gram``-byte string in it with the least hash
(the first of equals), so equal windows choose equal anchors at equal offsets. The windows that
choose the same occurrence of an anchor are a stretch; its context is the bytes that they cover.

1. One pass over the texts gives each stretch: its anchor's hash and its context's hash.
2. An anchor that occurs once is left. Contexts with the same anchor and hash are equal: if there are two
   or more, all their windows repeat.
3. Where an anchor has different contexts, one of each kind is cut out of the texts and dealt to shards
   by anchor. A shard's suffix array is sorted by induction; the permuted common prefixes tell which windows
   occur in another context too. An anchor with more than ``CROWD`` different contexts is not one shard's work: its
   contexts go through all steps again with anchors of more bytes, half way to ``length``, which part them further; where an
   anchor is a whole window there are no different contexts left.
4. The windows' bytes are cut out of each text.

A byte goes only if a suffix array has compared its window, or if two windows agree in the hashes of anchor and context,
128 bits of two kinds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointing, map_texts, stored
from .suffixes import permuted_common_prefixes, suffix_array

LENGTH = 400
GRAM = 200
#: Different contexts of one anchor in a shard at most.
CROWD = 500
#: Bytes in a shard, up to one anchor's contexts more.
SHARD = 1 << 18
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_TABLES: list[np.ndarray] = []


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``size``-byte string in ``data``; equal strings have equal hashes."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    if not _TABLES or len(_TABLES[0]) < n:
        most = 1 << max(n - 1, 1 << 16).bit_length()
        _TABLES[:] = _powers(BASE, most), _powers(pow(BASE, -1, 1 << 64), most)
    up, down = _TABLES
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): windows first..last-1 of the text choose one occurrence of an anchor, by its hash.

    Texts shorter than ``length`` have none.
    """
    m = len(data) - length + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    width = length - gram + 1
    hashes = rolling(data, gram)
    # upper hash bits, then the position: the first of equals is the least. Positions are counted modulo 2^24, by
    # blocks of half that, so that any text's length is fine.
    firsts, anchors_at = [], []
    step = 1 << 23
    for a in range(0, m, step):
        b = min(m, a + step)
        part = hashes[a : b + width - 1]
        key = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        key = np.concatenate([key, np.full(-len(key) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
        tail = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        head = np.minimum.accumulate(key, axis=1).ravel()
        least = np.minimum(tail[: b - a], head[width - 1 : width - 1 + b - a])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + a
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        firsts.append(cut + a)
        anchors_at.append(at[cut])
    first, at = np.concatenate(firsts), np.concatenate(anchors_at)
    if len(firsts) > 1:  # a stretch may reach over a block's end
        keep = np.concatenate([[True], at[1:] != at[:-1]])
        first, at = first[keep], at[keep]
    return first, np.append(first[1:], m), hashes[at]


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]


def signed(docs: DataFrame) -> DataFrame:
    """``docs`` with sig, a hash of the text, which with doc_id tells the texts apart."""
    return docs.withColumn("sig", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def all_stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, sig, first, last, anchor, context (hashes) of each stretch of each text of ``docs`` (doc_id, sig, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, columns = [], []
        digest = xxhash.xxh64_intdigest
        for data in _bytes_of(batch):
            first, last, anchor = stretches(np.frombuffer(data, np.uint8), length, gram)
            rows.append(len(first))
            if len(first):
                context = np.array([digest(data[a : b + length - 1], 7) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
                columns.append((first, last, anchor.view(np.int64), context.view(np.int64)))
        of = pa.array(np.repeat(np.arange(len(rows)), rows))
        parts = [np.concatenate(c) for c in zip(*columns)] or [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("sig").take(of), pa.array(parts[0].astype(np.int32)), pa.array(parts[1].astype(np.int32)), pa.array(parts[2]), pa.array(parts[3])], ["doc_id", "sig", "first", "last", "anchor", "context"])

    return map_texts(docs.select("doc_id", "sig", "text"), "text", "doc_id long, sig long, first int, last int, anchor long, context long", work)


def repeated_in_shard(contexts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context, the spans (first, last) of its windows that occur anywhere else in the shard."""
    if not contexts:
        return []
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\x00".join(contexts) + b"\x00\x00", np.uint8).astype(np.int64) + 2
    text[ends - 1] = 1  # between contexts
    text[-1] = 0
    room = np.repeat(ends, sizes + 1) - 1 - np.arange(len(text) - 1)
    plcp, before = permuted_common_prefixes(text, suffix_array(text), np.append(room, 0))
    again = plcp >= length
    again[before[again]] = True
    out = []
    for a, n in zip((ends - sizes - 1).tolist(), sizes.tolist()):
        own = np.concatenate([[False], again[a : a + n], [False]])
        edges = np.flatnonzero(own[1:] != own[:-1])
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


SPAN = "anchor long, context long, spans array<struct<a:int,b:int>>"


def _sharded(batches, length: int):
    """Rows (anchor, context, spans) from rows (anchor, context, data) in the order of anchor."""
    rows: list[tuple] = []
    size, last = 0, None

    def done():
        found = repeated_in_shard([r[2] for r in rows], length)
        kept = [(r[0], r[1], s) for r, s in zip(rows, found) if s]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in k[2]] for k in kept], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["anchor", "context", "spans"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != last and size >= SHARD:
                yield done()
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
            last = row[0]
    if rows:
        yield done()


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, sig, runs (array of struct a, b): starts a..b-1 of the windows of each text of ``docs`` (doc_id, sig, text) that also start anywhere else."""
    every = stored(all_stretches(docs, length, gram), "stretches")
    often = every.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") < F.max("context")).alias("mixed")).where("n > 1").select("anchor", "mixed")
    # stored, so that both sides of the join are dealt anew and a very frequent anchor's rows can be split
    found = stored(every.join(stored(often, "often"), "anchor"), "repeated")

    mixed = found.where("mixed")
    kinds = mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sig", "first", "last")).alias("one"))
    kinds = stored(kinds, "kinds")
    wanted = kinds.select("one.*", "anchor", "context").groupBy("doc_id", "sig").agg(F.collect_list(F.struct("first", "last", "anchor", "context")).alias("wanted"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w["anchor"], w["context"], data[w["first"] : w["last"] + length - 1]) for data, ws in zip(_bytes_of(batch), batch.column("wanted").to_pylist()) for w in ws]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["anchor", "context", "data"])

    wanted = wanted.withColumnsRenamed({"doc_id": "w_doc", "sig": "w_sig"})
    holding = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("sig") == F.col("w_sig"))).select("text", "wanted")
    contexts = stored(map_texts(holding, "text", "anchor long, context long, data binary", cut).dropDuplicates(["anchor", "context"]), "contexts")

    crowds = stored(kinds.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowds")
    if crowds.isEmpty():
        spans = _in_shards(contexts, length)
    else:
        apart = contexts.join(crowds, "anchor", "left_semi").select(F.col("anchor").alias("doc_id"), F.col("context").alias("sig"), F.col("data").alias("text"))
        again = repeated_windows(stored(apart, "crowded"), length, gram + max(1, (length - gram) // 2), crowd)
        spans = _in_shards(contexts.join(crowds, "anchor", "left_anti"), length).unionByName(again.select(F.col("doc_id").alias("anchor"), F.col("sig").alias("context"), F.col("runs").alias("spans")))

    same = found.where("not mixed").select("doc_id", "sig", F.col("first").alias("a"), F.col("last").alias("b"))
    copies = kinds.where("n > 1").select("anchor", "context")
    copied = mixed.join(copies, ["anchor", "context"], "left_semi").select("doc_id", "sig", F.col("first").alias("a"), F.col("last").alias("b"))
    single = kinds.where("n = 1").join(spans, ["anchor", "context"]).select("one.*", F.explode("spans").alias("s")).select("doc_id", "sig", (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b"))
    runs = same.unionByName(copied).unionByName(single)
    return runs.groupBy("doc_id", "sig").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))


def _in_shards(contexts: DataFrame, length: int) -> DataFrame:
    """anchor, context and spans of the ``contexts`` (anchor, context, data) with windows that occur again among those of their anchor."""
    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _sharded(batches, length), SPAN)


def removed_spans(runs: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte spans that the windows of ``runs`` cover, which are in order of their first start."""
    out: list[list[int]] = []
    for r in runs:
        a, b = r["a"], r["b"] - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def worded_runs(runs: list[dict], data: bytes, length: int, words: int) -> list[dict]:
    """``runs`` joined where their starts meet, of which those stay whose bytes hold more than ``words`` whole words or ``LENGTH`` bytes."""
    out: list[dict] = []
    for r in runs:
        if out and r["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], r["b"])
        else:
            out.append(dict(r))

    def enough(a: int, b: int) -> bool:
        found = data[a:b].split()
        broken = (a > 0 and not _spaced(data, a)) + (b < len(data) and not _spaced(data, b))
        return b - a >= LENGTH or len(found) - broken > words

    return [r for r in out if enough(r["a"], r["b"] - 1 + length)]


def is_dense(data: bytes, words: int, size: int) -> bool:
    """Whether some ``words`` words in a row of the text lie in fewer than ``size`` bytes."""
    space = np.concatenate([[True], np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)), [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    return len(starts) >= words and bool((ends[words - 1 :] - starts[: len(starts) - words + 1] < size).any())


def _spaced(data: bytes, at: int) -> bool:
    """Whether a word ends or begins at this place, or none is near."""
    return data[at - 1 : at].isspace() or data[at : at + 1].isspace()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, carry: tuple[str, ...] = (), words: int | None = None, dense: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, the columns ``carry``, kept (binary), spans (array of struct a, b: bytes removed) and n_bytes of every row of ``docs`` (doc_id, text).

    A byte goes if a ``length``-byte string that covers it starts anywhere else too, in the same text or another. Null
    texts are empty; texts shorter than ``length`` stay whole; repeated rows are occurrences like others; other
    columns aren't read; an empty table gives no rows. ``kept`` may end within a character: it is bytes. With ``words``,
    only unbroken runs of such strings go that hold more than so many whole words, or ``LENGTH`` bytes (texts without spaces).
    With ``dense``, the words and bytes of ``is_dense``, a last column dense tells that of the whole text; it is found here, as a step of its own
    before would keep a second Python worker in every task that reads the texts.
    """
    checkpointing(docs.sparkSession)
    texts = signed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text"))
    runs = repeated_windows(texts.select("doc_id", "sig", "text"), length, gram, crowd).withColumnsRenamed({"doc_id": "r_doc", "sig": "r_sig"})
    whole = texts.join(runs, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("sig") == F.col("r_sig")), "left").select("doc_id", *carry, "text", "runs")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, spans, sizes, flags = [], [], [], []
        for data, own in zip(_bytes_of(batch), batch.column("runs").to_pylist()):
            own = own or []
            cut = removed_spans(own if words is None else worded_runs(own, data, length, words), length)
            at, parts = 0, []
            for a, b in cut:
                parts.append(data[at:a])
                at = b
            kept.append(b"".join([*parts, data[at:]]))
            spans.append([{"a": a, "b": b} for a, b in cut])
            sizes.append(len(data))
            if dense:
                flags.append(is_dense(data, *dense))
        first = [batch.column(i) for i in range(1 + len(carry))]
        return pa.RecordBatch.from_arrays([*first, pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(sizes, pa.int64()), *([pa.array(flags, pa.bool_())] if dense else [])], ["doc_id", *carry, *(m.name for m in made)])

    span = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    made = [T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(span)), T.StructField("n_bytes", T.LongType()), *([T.StructField("dense", T.BooleanType())] if dense else [])]
    return map_texts(whole, "text", T.StructType([*whole.schema.fields[: 1 + len(carry)], *made]), work)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without 400-byte strings that occur again, as digests."""
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
