"""All queries of the library by name, and their SQL for DuckDB."""

from __future__ import annotations

from . import analytics, chat, files, retrieval, sql_text, streams, text

QUERIES = {**chat.QUERIES, **text.QUERIES, **retrieval.QUERIES, **files.QUERIES, **analytics.QUERIES, **streams.QUERIES, **sql_text.QUERIES}
ORACLES = {**chat.ORACLES, **text.ORACLES, **retrieval.ORACLES, **files.ORACLES, **analytics.ORACLES, **streams.ORACLES, **sql_text.ORACLES}
