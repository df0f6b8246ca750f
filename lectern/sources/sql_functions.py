"""The library's functions for SQL text: scalar ones in SQL itself, which Spark unfolds into the plan, the matching ratio, and table functions over partitioned input.

``registered(spark)`` makes them temporary functions of the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import SNIPPET, STUDENT_MODE, TEACHER_MODE
from lectern.operators.chunks import ABBREVIATIONS, MARK, WORDS
from lectern.operators.faq import sequence_ratio
from lectern.operators.lines import LIST_MARK

SPACE = r"(?U)\\s+"
EDGES = r"(?U)^\\s+|\\s+$"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _protected(text: str) -> str:
    for a in ABBREVIATIONS:
        text = f"replace({text}, {_quoted(a)}, {_quoted(a.replace('.', MARK))})"
    return text


#: Name, parameters, what is returned, and the SQL; those that name others come behind them.
SCALARS = (
    ("stripped", "t STRING", "STRING", f"regexp_replace(coalesce(t, ''), '{EDGES}', '')"),
    ("collapsed", "t STRING", "STRING", f"regexp_replace(stripped(t), '{SPACE}', ' ')"),
    ("words_of", "t STRING", "ARRAY<STRING>", f"filter(split(t, '{SPACE}'), w -> w <> '')"),
    ("snippet", "t STRING", "STRING", f"CASE WHEN length(collapsed(t)) <= {SNIPPET} THEN collapsed(t) ELSE concat(regexp_replace(substring(collapsed(t), 1, {SNIPPET - 1}), '(?U)\\\\s+$', ''), '…') END"),
    ("normal_email", "t STRING", "STRING", "lower(stripped(t))"),
    (
        "access_role", "t STRING", "STRING",
        "CASE WHEN NOT contains(normal_email(t), '@') THEN NULL WHEN startswith(regexp_replace(normal_email(t), '^[^@]*@', ''), 'education.')"
        " OR contains(substring_index(normal_email(t), '@', 1), '.education') THEN 'teacher' WHEN t IS NOT NULL THEN 'student' END",
    ),
    ("role_instruction", "role STRING", "STRING", f"CASE WHEN role = 'teacher' THEN {_quoted(TEACHER_MODE)} ELSE {_quoted(STUDENT_MODE)} END"),
    ("sentences_of", "t STRING", "ARRAY<STRING>", f"transform(split({_protected(chr(96) + 't' + chr(96))}, '(?<=[.!?])\\\\s+'), s -> replace(s, '{MARK}', '.'))"),
    ("is_list_item", "t STRING", "BOOLEAN", f"rlike(stripped(t), {_quoted(LIST_MARK)})"),
)


def _batch(rows: list[tuple], **types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))


class PackedChunks:
    """Rows (key, at, part) of one partition in order of ``at``, a batch at a time, as chunks of at most ``WORDS`` words; a longer part stands alone. One batch and its chunks are held at a time."""

    def __init__(self) -> None:
        self.key, self.number, self.parts, self.words = None, 0, [], 0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for key, part in zip(rows.column("key").to_pylist(), rows.column("part").to_pylist()):
            n = len(part.split())
            if self.parts and self.words + n > WORDS:
                out.append(self._closed())
            self.key = key
            self.parts.append(part)
            self.words += n
        if out:
            yield self._table(out)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield self._table([self._closed()])

    def _closed(self) -> tuple:
        out = self.key, self.number, " ".join(self.parts), len(self.parts)
        self.number, self.parts, self.words = self.number + 1, [], 0
        return out

    def _table(self, rows: list[tuple]) -> pa.RecordBatch:
        return _batch(rows, key=pa.int64(), chunk_index=pa.int32(), text=pa.string(), sentence_count=pa.int32())


class LineBlocks:
    """Rows (key, at, flat, kind) of one partition in order of ``at``, a batch at a time, as blocks: runs of paragraph or table lines, each heading and list item alone; blank lines end a run. One batch and its blocks are held at a time."""

    def __init__(self) -> None:
        self.key, self.kind, self.number, self.lines = None, None, 0, []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for key, flat, kind in zip(*(rows.column(c).to_pylist() for c in ("key", "flat", "kind"))):
            if kind != self.kind or kind in ("heading", "list_item"):
                out += self._closed()
                self.number += 1
            self.key, self.kind = key, kind
            self.lines.append(flat)
        if out:
            yield self._table(out)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if out := self._closed():
            yield self._table(out)

    def _closed(self) -> list[tuple]:
        lines, self.lines = self.lines, []
        if not lines or self.kind == "blank":
            return []
        return [(self.key, self.number, self.kind, len(lines), ("\n" if self.kind == "table" else " ").join(lines))]

    def _table(self, rows: list[tuple]) -> pa.RecordBatch:
        return _batch(rows, key=pa.int64(), block=pa.int64(), element_type=pa.string(), lines=pa.int64(), text=pa.string())


TABLES = {
    "packed_chunks": (PackedChunks, "key BIGINT, chunk_index INT, text STRING, sentence_count INT"),
    "line_blocks": (LineBlocks, "key BIGINT, block BIGINT, element_type STRING, lines BIGINT, text STRING"),
}


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the functions."""
    for name, parameters, returned, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returned} RETURN {body}")
    spark.udf.register("sequence_ratio", sequence_ratio)
    for name, (kind, columns) in TABLES.items():
        spark.udtf.register(name, F.arrow_udtf(kind, returnType=columns))
    return spark
