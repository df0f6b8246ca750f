"""Queries on files, runs, JSON lines and what sessions have read."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalars as S
from lectern.operators import chunks as C
from lectern.operators import embedding as E
from lectern.operators import ingestion as G
from lectern.operators import lines as N
from lectern.operators import reports as P
from lectern.operators import turns as T
from lectern.plans import text as X
from lectern.session import spread, table
from lectern.sources import jsonl as J
from lectern.sources import jsonl_files as W
from lectern.sources.fixtures import oracle_with, view
from lectern.sources.scratch import scratch_path

#: Suffixes of the made-up paths, by doc_id.
MADE = (".pdf", ".PPTX", ".Png", ".jpg", ".jpeg", ".webp", ".bmp", ".TIF", ".tiff", ".txt", "", ".pdf.bak")
#: Folders of the made-up paths, by doc_id; only from the first may files be taken.
FOLDERS = ("out", "out/../secret", "out/a/../b", "./out", "elsewhere", "outer")


def _picked(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def _files(s, d):
    """Each document as a file with a made-up path."""
    n = F.col("doc_id")
    path = F.concat(_picked(FOLDERS, F.floor(n / len(MADE))), F.lit("/"), n.cast("string"), _picked(MADE, n))
    return table(s, d, "documents").select("doc_id", path.alias("path"), (F.octet_length(S.text_of(F.col("text"))) * 1000).cast("long").alias("length"))


def _jsonl_chunks(s, d):
    rows = X._paragraphs(s, d)
    n = F.col("doc_id").cast("string")
    name = F.concat(F.lit("chunk-"), n, F.lit("-"), F.col("chunk_index").cast("string"))
    return rows.select(name.alias("id"), "text", F.create_map(F.lit("doc"), n, F.lit("strategy"), F.lit("paragraph")).alias("metadata"))


def _runs(s, d):
    """Two runs: over all files, and over those for teachers."""
    every = X.QUERIES["file_results"](s, d)
    return every.withColumn("run", F.lit("all")).unionByName(every.where("doc_id % 3 = 0").withColumn("run", F.lit("teacher")))


def _read(s, d):
    """What sessions have read: documents as files, every third as a web page."""
    n = F.col("doc_id")
    kind = F.when(n % 3 == 0, "Web page").otherwise("Document")
    return table(s, d, "documents").select((n % 100).alias("session_id"), "doc_id", kind.alias("kind"), F.concat_ws("/", "source", n.cast("string")).alias("name"), "text")


def _appended(s, d):
    """Conversations of which only the first turns are stored, with the later ones behind them."""
    rows = table(s, d, "conversations")
    first = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    held = rows.where("turn < 3 and conv_id % 4 <> 1").groupBy("conv_id").agg(F.transform(first, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))
    all_turns = T.append_turns(held, rows.where("turn >= 3 or conv_id % 4 = 1"))
    return all_turns.select("conv_id", F.size("turns").alias("turns"), F.array_join(F.transform("turns", lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n").alias("transcript"))


def _instructions(s, d):
    rows = view(s, d, "messages")
    return rows.select("msg_id", S.role_instruction(S.access_role(F.col("user_email"))).alias("instruction"))


def _page_rows(s, d):
    """Documents as files of pages of 40 lines; of one page in nine only its image was there, and its lines were recognised."""
    lines = F.split(S.text_of(F.col("text")), "\n")
    rows = spread(table(s, d, "documents")).select("doc_id", lines.alias("lines")).withColumn("page", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / N.PAGE_LINES).cast("int"))))
    own = F.slice("lines", F.col("page") * N.PAGE_LINES + 1, F.lit(N.PAGE_LINES))
    text = F.when((F.col("doc_id") + F.col("page")) % 9 != 0, F.array_join(own, "\n"))
    return rows.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), (F.col("page") + 1).alias("page_number"), text.alias("text"), own.alias("recognised"))


def _contents(s, d):
    """Documents as text files, some of them broken, without a reader, or of pages in JSON."""
    n = F.col("doc_id")
    content = F.when(n % 50 == 7, F.unhex(F.lit("fffe00"))).when(n % 50 == 8, F.lit('{"page_number"').cast("binary")).otherwise(S.text_of(F.col("text")).cast("binary"))
    suffix = F.when(n % 50 == 8, ".jsonl").when(n % 50 == 9, ".odd").otherwise(".txt")
    return spread(table(s, d, "documents")).select(F.concat(F.lit("in/"), n.cast("string"), suffix).alias("path"), content.alias("content"))


def _run(s, d):
    """A whole run: files are read, their pages packed into chunks, and each file has its result."""
    return G.packed_results(G.read_files(_contents(s, d)), lambda text: C.reject_reason(text).isNull())


def _files_round_trip(s, d):
    """All chunks written as JSON lines, and read again."""
    path = scratch_path(W.registered(s), "jsonl")
    _jsonl_chunks(s, d).write.format(W.NAME).mode("append").option("path", path).save()
    rows = s.read.format(W.NAME).option("path", path).load()
    return rows.select("id", "text", F.col("metadata")["doc"].alias("doc"), F.col("metadata")["strategy"].alias("strategy"))


def _chunk_vectors(s, d):
    """Vectors of all chunks; the first provider isn't there. The sum weighs each place of the vector by its number."""
    chunks = _jsonl_chunks(s, d).select("id", "text")
    rows = E.embedded(chunks, ["absent", "letters"])
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("id", "provider", F.size("embedding").cast("long").alias("dimensions"), weighed.alias("weighed"))


QUERIES = {
    "jsonl_files": _files_round_trip,
    "chunk_embeddings": _chunk_vectors,
    "page_blocks": lambda s, d: G.page_blocks(_page_rows(s, d)),
    "run_results": lambda s, d: _run(s, d).withColumn("error", F.when(F.col("path").endswith(".jsonl"), F.lit("not JSON")).otherwise(F.col("error"))),
    "run_manifest": lambda s, d: P.manifest(_run(s, d)),
    "file_readers": lambda s, d: P.supported(_files(s, d)).select("path", "suffix", "reader"),
    "file_downloads": lambda s, d: P.downloads(_files(s, d), ["out"]),
    "manifest_comparison": lambda s, d: J.side_by_side(_runs(s, d)),
    "jsonl_round_trip": lambda s, d: J.parsed_lines(J.json_lines(_jsonl_chunks(s, d))).select("id", "text", F.col("metadata")["doc"].alias("doc"), F.col("metadata")["strategy"].alias("strategy")),
    "jsonl_ascii": lambda s, d: J.json_lines(_jsonl_chunks(s, d)).select(F.get_json_object("line", "$.id").alias("id"), F.rlike("line", F.lit(r"^[\x20-\x7e]*$")).alias("ascii")),
    "chunks_with_vectors": lambda s, d: J.with_vectors(table(s, d, "documents").select(F.concat(F.lit("chunk-"), F.col("doc_id").cast("string")).alias("id"), "text"), table(s, d, "embeddings").select(F.concat(F.lit("chunk-"), F.col("vec_id").cast("string")).alias("id"), "embedding")).select("id", "text", F.size("embedding").cast("long").alias("dimensions")),
    "page_contents": lambda s, d: C.as_documents(X._paragraphs(s, d).select("text", "doc_id", "chunk_index")),
    "role_instruction": _instructions,
    "pdf_escape": lambda s, d: spread(table(s, d, "documents")).select("doc_id", S.escape_pdf(F.col("text")).alias("text")),
    "session_read_buffer": lambda s, d: T.session_buffers(_read(s, d), "session_id", "doc_id"),
    "append_turns": _appended,
    "stamped_blocks": lambda s, d: N.stamped_blocks(N.numbered_blocks(spread(table(s, d, "documents")), ["doc_id"]).withColumn("source_file", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))), source_file="", source_type="text", subject="history", grades=(5, None)),
}


def _case(values, n: str) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PATH = f"concat({_case(FOLDERS, f'(doc_id // {len(MADE)})')}, '/', doc_id, {_case(MADE, 'doc_id')})"
STORED_CHUNKS = f"{X.PACKED}, stored AS (SELECT concat('chunk-', doc_id, '-', chunk_index) AS id, text, CAST(doc_id AS VARCHAR) AS doc FROM chunks)"

ORACLES = {
    "file_readers": f"SELECT {PATH} AS path, lower({_case(MADE, 'doc_id')}) AS suffix, CASE doc_id % 12 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pptx' ELSE 'image' END AS reader FROM documents WHERE doc_id % 12 < 9",
    "file_downloads": f"SELECT {PATH} AS path, concat(doc_id, '.pdf') AS name, printf('%.2f MB', octet_length(encode(coalesce(text, ''))) * 1000 / 1048576.0) AS size_mb FROM documents WHERE doc_id % 12 = 0 AND doc_id // 12 % 6 IN (0, 2, 3)",
    "manifest_comparison": f"""{X.FILES}, runs AS (SELECT 'all' AS run, * FROM files UNION ALL SELECT 'teacher', * FROM files WHERE doc_id % 3 = 0)
 SELECT run, count(*) OVER w AS files_discovered, count(*) FILTER (error IS NULL) OVER w AS files_succeeded, CAST(sum(valid_count) OVER w AS BIGINT) AS chunks_valid, doc_id, chunk_count, valid_count FROM runs WINDOW w AS (PARTITION BY run)""",
    "jsonl_round_trip": f"{STORED_CHUNKS} SELECT id, text, doc, 'paragraph' AS strategy FROM stored",
    "jsonl_ascii": f"{STORED_CHUNKS} SELECT id, TRUE AS ascii FROM stored",
    "chunks_with_vectors": "SELECT concat('chunk-', doc_id) AS id, text, len(embedding) AS dimensions FROM documents JOIN embeddings ON doc_id = vec_id",
    "page_contents": f"{X.PACKED} SELECT text AS page_content, concat('{{\"doc_id\":', doc_id, ',\"chunk_index\":', chunk_index, '}}') AS metadata FROM chunks",
    "role_instruction": oracle_with("messages") + """ SELECT msg_id, CASE WHEN contains(email, '@') AND (starts_with(regexp_replace(email, '^[^@]*@', ''), 'education.') OR contains(split_part(email, '@', 1), '.education'))
 THEN 'Teacher mode: respond as a curriculum-support assistant. Prioritize lesson structure, pedagogy, assessment, differentiation, and classroom use.'
 ELSE 'Student mode: respond in clear, simple, supportive language. Focus on short explanations, examples, and study help without unnecessary teaching detail.' END AS instruction
 FROM (SELECT msg_id, lower(trim(coalesce(user_email, ''))) AS email FROM messages)""",
    "pdf_escape": r"SELECT doc_id, replace(replace(replace(coalesce(text, ''), '\', '\\'), '(', '\('), ')', '\)') AS text FROM documents",
    "session_read_buffer": r"""SELECT doc_id % 100 AS session_id, substring(string_agg(regexp_replace(concat('--- ', CASE WHEN doc_id % 3 = 0 THEN 'Web page' ELSE 'Document' END, ': ', source, '/', doc_id, ' ---', chr(10), text), '[\s\p{Z}]+$', ''), chr(10) || chr(10) ORDER BY doc_id), 1, 12000) AS buffer FROM documents GROUP BY 1""",
    "append_turns": "SELECT conv_id, CAST(count(*) AS INT) AS turns, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
    "run_results": f"""{X.RUN} SELECT concat('in/', doc_id, CASE doc_id % 50 WHEN 8 THEN '.jsonl' WHEN 9 THEN '.odd' ELSE '.txt' END) AS path, CASE WHEN error IS NULL THEN 1 ELSE 0 END::BIGINT AS pages, chunk_count, valid_count, error FROM files""",
    "run_manifest": f"{X.RUN} SELECT count(*) AS files_discovered, count(*) FILTER (error IS NULL) AS files_succeeded, count(error) AS files_failed, CAST(sum(chunk_count) AS BIGINT) AS chunks_total, CAST(sum(valid_count) AS BIGINT) AS chunks_valid, 'local' AS embedding_provider FROM files",
    "chunk_embeddings": f"{STORED_CHUNKS} SELECT id, 'letters' AS provider, {E.DIMENSIONS}::BIGINT AS dimensions, CAST(coalesce(list_sum(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c) % {E.DIMENSIONS} + 1)), 0) AS DOUBLE) AS weighed FROM stored",
}
ORACLES["jsonl_files"] = ORACLES["jsonl_round_trip"]
