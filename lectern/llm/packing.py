"""Packing of token sequences by minimum bin slack.

Each task packs the documents that it reads: full windows of ``capacity`` ids are cut off a document
first, what remains of it is one piece. Pieces wait as counts by length. A window takes the longest
waiting piece and the multiset of other lengths that fills the rest best: a subset-sum table over the
waiting lengths, one Python integer as bitset for each length (a length's count enters by powers of two),
from which the counts used are traced back. A filling is repeated as often as the counts allow.
No shuffle: windows never reach over tasks, which costs one unfilled window a task at most in practice.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, text_slices, texts_of
from .tokens import byte_encoder

CAPACITY = 2048
#: Pieces that a task gathers before it packs them; bounds its memory.
POOL = 20_000
END_OF_TEXT = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (length -> how many, within ``counts``) whose sum is the largest up to ``room``.

    >>> best_filling({5: 1, 4: 2, 3: 1}, 12)
    {3: 1, 5: 1, 4: 1}
    """
    if room <= 0:
        return {}
    within, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & within
            left, times = left - take, times * 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # this sum needs the step
            used[length] += take
            total -= length * take
    return dict(used)


def fillings(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Pairs of (multiset of lengths, how many windows get it) until ``counts`` is used up."""
    counts = {k: v for k, v in counts.items() if v > 0}
    order: list[int] = sorted(counts)
    while order:
        longest = order[-1]
        counts[longest] -= 1
        used = best_filling(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        repeat = min(counts[k] // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= v * repeat
            if not counts[k]:
                del counts[k]
                order.remove(k)
        yield used, repeat


def pack_pieces(pieces: list[tuple], capacity: int, first_id: int) -> tuple[list[tuple], int]:
    """Rows (piece fields, sequence_id, offset) for pieces whose third field is their length; the next free id."""
    waiting: dict[int, deque] = defaultdict(deque)
    for p in pieces:
        waiting[p[2]].append(p)
    rows, sequence = [], first_id
    for used, repeat in fillings({k: len(v) for k, v in waiting.items()}, capacity):
        lengths = sorted(used, reverse=True)
        for _ in range(repeat):
            offset = 0
            for length in lengths:
                for _ in range(used[length]):
                    rows.append((*waiting[length].popleft(), sequence, offset))
                    offset += length
            sequence += 1
    return rows, sequence


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, pool: int = POOL) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text): its place in a sequence of at most ``capacity`` ids.

    Null or empty texts are the end-of-text id alone. Other columns of ``docs`` are not read; repeated rows
    are packed once each; an empty table gives no rows. ``sequence_id`` is the task's number in the upper bits
    and a counter in the lower 32.
    """
    names = SCHEMA.split(", ")
    kinds = pa.schema([(n.split()[0], pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = byte_encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 32
        end = END_OF_TEXT.to_bytes(4, "little")
        pieces: list[tuple] = []
        rows: list[tuple] = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=kinds)

        for part in text_slices(batches, "text"):
            for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part, "text")):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), n)
                    if row[2] == capacity:
                        rows.append((*row, sequence, 0))
                        sequence += 1
                    else:
                        pieces.append(row)
            if len(pieces) >= pool:
                packed, sequence = pack_pieces(pieces, capacity, sequence)
                rows += packed
                pieces = []
            if len(rows) >= 20_000:
                yield table(rows)
                rows = []
        packed, sequence = pack_pieces(pieces, capacity, sequence)
        rows += packed
        if rows:
            yield table(rows)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
