"""Queries on pages, lines, blocks and chunks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F


from lectern.functions import web
from lectern.operators import chunks as C
from lectern.operators import lines as N
from lectern.operators import reports as P
from lectern.operators import splitting as K
from lectern.session import spread, table


def _lines(s, d):
    return N.doc_lines(spread(table(s, d, "documents")))


def _blocks(s, d):
    """Blocks of all documents as the chunker takes them."""
    blocks = N.numbered_blocks(spread(table(s, d, "documents")).withColumnRenamed("lang", "l"), ["doc_id", "l"])
    return N.block_metadata(blocks, F.col("l"))


def _chunks(s, d):
    return C.chunk_documents(spread(table(s, d, "documents")))


def _paragraphs(s, d):
    return C.chunk_paragraphs(spread(table(s, d, "documents")), ["doc_id"])


def _valid():
    return C.reject_reason(F.col("text")).isNull()


def _numbered(s, d):
    rows = _paragraphs(s, d).withColumn("block_index", F.lit(0))
    return rows


#: The character references in the tables' pages, and what they stand for.
REFERENCES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _results(s, d):
    """Pages as what sources say to questions, eight to each; some without title, body or address."""
    n = F.col("page_id")
    said = F.when(n % 4 != 0, F.concat(F.lit("it's \""), "url", F.lit("\" "))).otherwise(" ")
    return table(s, d, "pages").select(F.floor(n / 8).alias("query_id"), n.alias("ord"), F.when(n % 7 != 0, F.concat(F.lit(" <Page> "), n.cast("string"))).alias("title"), said.alias("body"), F.when(n % 3 != 0, F.col("url")).otherwise("").alias("url"))


QUERIES = {
    "html_text": lambda s, d: spread(table(s, d, "pages")).select("page_id", web.html_text(F.col("html")).alias("text")),
    "html_title": lambda s, d: table(s, d, "pages").select("page_id", web.html_title(F.col("html")).alias("title")),
    "page_envelope": lambda s, d: spread(table(s, d, "pages")).select("page_id", web.page_envelope(F.col("html")).alias("envelope")),
    "url_scheme": lambda s, d: table(s, d, "pages").select("page_id", web.with_scheme(F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))).alias("url")),
    "result_cards": lambda s, d: web.result_cards(_results(s, d)),
    "web_contexts": lambda s, d: web.web_contexts(_results(s, d)),
    "url_domain": lambda s, d: table(s, d, "pages").select("page_id", web.url_domain(F.col("url")).alias("domain")),
    "text_basic": lambda s, d: _lines(s, d).select("doc_id", "line_no", N.basic(F.col("line")).alias("basic")),
    "normalize_text": lambda s, d: spread(table(s, d, "documents")).select("doc_id", N.normal_text(F.col("text")).alias("text")),
    "noise_lines": lambda s, d: _lines(s, d).where(N.is_noise(N.flat_basic(F.col("line")))).groupBy("doc_id").agg(F.count("*").alias("noise")),
    "running_headers": lambda s, d: N.running_lines(_lines(s, d)),
    "strip_headers": lambda s, d: N.strip_running(_lines(s, d)).groupBy("doc_id", "page_number").agg(F.count("*").alias("kept")),
    "heading_lines": lambda s, d: _lines(s, d).where(N.is_heading(F.col("line"))).select("doc_id", "line_no"),
    "list_lines": lambda s, d: _lines(s, d).where(N.is_list_item(F.col("line"))).select("doc_id", "line_no"),
    "table_lines": lambda s, d: _lines(s, d).where(N.is_table_row(F.col("line"))).select("doc_id", "line_no"),
    "line_type_histogram": lambda s, d: _lines(s, d).groupBy(N.line_type(F.col("line")).alias("element_type")).agg(F.count("*").alias("lines")),
    "line_blocks": lambda s, d: N.document_blocks(spread(table(s, d, "documents")), ["doc_id"]),
    "block_metadata": lambda s, d: _blocks(s, d),
    "sentences": lambda s, d: spread(table(s, d, "documents")).select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("at", "sentence")).select("doc_id", F.col("at").cast("int"), "sentence"),
    "sentence_counts": lambda s, d: spread(table(s, d, "documents")).select("doc_id", F.size(C.sentences(F.col("text"))).cast("long").alias("sentences")),
    "chunk_paragraphs": lambda s, d: _paragraphs(s, d),
    "chunk_blocks": lambda s, d: _chunks(s, d),
    "chunk_quality": lambda s, d: _paragraphs(s, d).select("doc_id", "chunk_index", _valid().alias("valid")),
    "chunk_reject_reasons": lambda s, d: spread(table(s, d, "documents")).select("doc_id", C.reject_reason(F.col("text")).alias("reason")),
    "valid_chunks": lambda s, d: C.valid_chunks(_paragraphs(s, d)).groupBy("doc_id").agg(F.count("*").alias("chunks")),
    "char_windows": lambda s, d: spread(table(s, d, "documents")).select("doc_id", F.posexplode(C.char_windows(F.col("text"))).alias("at", "part")).select("doc_id", F.col("at").cast("int"), "part"),
    "recursive_windows": lambda s, d: K.split_documents(spread(table(s, d, "documents")), ["doc_id"]),
    "chunk_ids": lambda s, d: P.chunk_ids(_numbered(s, d)).select("id", "doc_id", "chunk_index"),
    "file_results": lambda s, d: P.file_results(C.chunk_paragraphs(spread(table(s, d, "documents")).where("doc_id % 50 <> 7"), ["doc_id"]), spread(table(s, d, "documents")), _valid()),
    "manifest": lambda s, d: P.manifest(QUERIES["file_results"](s, d)),
    "lecture_notes": lambda s, d: P.lecture_notes(_numbered(s, d).withColumn("lesson", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("lesson-"), (F.col("doc_id") % 30).cast("string"))).otherwise("")).withColumn("source_file", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))),
    "paginate": lambda s, d: P.paginate(spread(table(s, d, "documents"))),
    "ai_json_fallback": lambda s, d: P.ai_pages(spread(table(s, d, "pages")).select("page_id", F.when(F.col("page_id") % 3 == 0, "no json at all").otherwise(F.concat(F.lit('{"summary": "s'), F.col("page_id").cast("string"), F.lit('", "key_topics": "k", "content_type": "lesson"}'))).alias("response"))),
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(value: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({value}, ''), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def _flat(value: str) -> str:
    return rf"regexp_replace({_strip(value)}, '[\s\p{{Z}}]+', ' ', 'g')"


def _basic(value: str) -> str:
    return _flat(rf"regexp_replace(coalesce({value}, ''), '[\x00-\x1f\x7f]', '', 'g')")


def _noise(compact: str) -> str:
    return f"({compact} = '' OR regexp_matches({compact}, {_q('(?i)' + '|'.join(N.LEGAL))}) OR regexp_matches({compact}, {_q('(?i)^(' + N.PAGE_MARK + ')$')}) OR regexp_matches({compact}, {_q('^' + N.NOT_ALNUM + '$')}))"


def _refs(value: str) -> str:
    for reference, char in REFERENCES:
        value = f"replace({value}, {_q(reference)}, {_q(char)})"
    return value


def _markup(value: str) -> str:
    for name in web.DROPPED:
        value = rf"regexp_replace({value}, '(?is)<{name}\b[^>]*>.*?</{name}>', ' ', 'g')"
    return _flat(_refs(f"regexp_replace(regexp_replace({value}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"))


LINES = "WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, CAST((i - 1) // 40 + 1 AS INT) AS page_number, ls[i] AS line FROM raw, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))"


def _heading(value: str) -> str:
    line = _strip(value)
    words = rf"list_filter(regexp_split_to_array({line}, '[\s\p{{Z}}]+'), lambda w: w <> '')"
    first = "substring(w, 1, 1)"
    titled = f"len(list_filter({words}, lambda w: upper({first}) = {first} AND lower({first}) <> {first}))"
    lettered = rf"len(list_filter({words}, lambda w: regexp_matches(w, '\p{{L}}')))"
    return f"(length({line}) <= 90 AND len({words}) > 0 AND ((upper({line}) = {line} AND lower({line}) <> {line} AND len({words}) <= 12) OR (NOT regexp_matches({line}, '[.:;]$') AND {lettered} >= 2 AND {titled} >= greatest(2, len({words}) // 2) AND len({words}) <= 10)))"


def _item(value: str) -> str:
    return f"regexp_matches({_strip(value)}, {_q(N.LIST_MARK)})"


def _row(value: str) -> str:
    line = _strip(value)
    return rf"({line} <> '' AND (contains({line}, '|') OR contains({line}, chr(9)) OR len(regexp_split_to_array({line}, '\s{{2,}}')) >= 3))"


KIND = f"CASE WHEN {_heading('line')} THEN 'heading' WHEN {_item('line')} THEN 'list_item' WHEN {_row('line')} THEN 'table_row' ELSE 'paragraph' END"
BLOCKS = f"""{LINES}, f AS (SELECT doc_id, line_no, {_flat('line')} AS flat FROM lines),
 k AS (SELECT *, CASE WHEN flat = '' THEN 'blank' WHEN {_heading('flat')} THEN 'heading' WHEN {_item('flat')} THEN 'list_item' WHEN {_row('flat')} THEN 'table' ELSE 'paragraph' END AS kind FROM f),
 st AS (SELECT *, CASE WHEN kind IN ('heading', 'list_item') OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS starts FROM k),
 bl AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block FROM st),
 blocks AS (SELECT doc_id, block, kind AS element_type, count(*) AS lines, CASE WHEN kind = 'table' THEN string_agg(flat, chr(10) ORDER BY line_no) ELSE string_agg(flat, ' ' ORDER BY line_no) END AS text FROM bl WHERE kind <> 'blank' GROUP BY doc_id, block, kind)"""


def _sentences(value: str) -> str:
    for a in C.ABBREVIATIONS:
        value = f"replace({value}, {_q(a)}, {_q(a.replace('.', C.MARK))})"
    return rf"list_transform(string_split(regexp_replace({value}, '([.!?])\s+', '\1␟', 'g'), '␟'), lambda x: replace(x, '␞', '.'))"


COUNT = r"len(list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}]+'), lambda w: w <> ''))"
PACKED = f"""WITH RECURSIVE src AS (SELECT doc_id, {_sentences("coalesce(text, '')")} AS ss FROM documents),
 sized AS (SELECT doc_id, ss, list_transform(ss, lambda x: {COUNT.format('x')}) AS ns FROM src),
 fold AS (SELECT doc_id, 1 AS i, 0 AS chunk, ns[1] AS filled FROM sized UNION ALL
  SELECT f.doc_id, i + 1, CASE WHEN filled + ns[i + 1] <= {C.WORDS} THEN chunk ELSE chunk + 1 END, CASE WHEN filled + ns[i + 1] <= {C.WORDS} THEN filled + ns[i + 1] ELSE ns[i + 1] END FROM fold f JOIN sized s ON f.doc_id = s.doc_id WHERE i < len(ss)),
 chunks AS (SELECT f.doc_id, CAST(chunk AS INT) AS chunk_index, string_agg(ss[i], ' ' ORDER BY i) AS text, CAST(count(*) AS INT) AS sentence_count FROM fold f JOIN sized s ON f.doc_id = s.doc_id GROUP BY f.doc_id, chunk)"""


def _reason(value: str) -> str:
    t = _strip(value)
    words = rf"list_filter(regexp_split_to_array({t}, '[\s\p{{Z}}]+'), lambda w: w <> '')"
    letters = rf"length(regexp_replace({t}, '[^\p{{L}}]', '', 'g'))"
    return rf"""CASE WHEN len({words}) < 5 THEN 'too_short' WHEN {letters} / greatest(length({t}), 1) < 0.6 THEN 'few_letters' WHEN regexp_matches({t}, 'https?://|www\.|@[a-zA-Z0-9]') THEN 'address'
 WHEN len(regexp_extract_all({t}, '(?i)\b[0-9a-f]{{8,}}\b')) > 2 THEN 'hex' WHEN len(regexp_extract_all({t}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]{{3,}}')) > 3 THEN 'symbols'
 WHEN len({words}) >= 3 AND upper({t}) = {t} AND lower({t}) <> {t} AND regexp_matches(replace({t}, ' ', ''), '^\p{{L}}+$') THEN 'capitals'
 WHEN len(list_filter({words}, lambda w: NOT regexp_matches(regexp_replace(w, '[.,]', '', 'g'), '^\p{{Nd}}+$'))) = 0 THEN 'numbers' END"""


FILES = f"{PACKED}, made AS (SELECT doc_id, count(*) AS c, count(*) FILTER ({_reason('text')} IS NULL) AS v FROM chunks WHERE doc_id % 50 <> 7 GROUP BY doc_id), files AS (SELECT d.doc_id, coalesce(c, 0) AS chunk_count, coalesce(v, 0) AS valid_count, CASE WHEN c IS NULL THEN 'no text' END AS error FROM documents d LEFT JOIN made m ON d.doc_id = m.doc_id)"

RUN = f"{PACKED}, made AS (SELECT doc_id, count(*) AS c, count(*) FILTER ({_reason('text')} IS NULL) AS v FROM chunks WHERE doc_id % 50 NOT IN (7, 8, 9) GROUP BY doc_id), files AS (SELECT d.doc_id, coalesce(c, 0) AS chunk_count, coalesce(v, 0) AS valid_count, CASE d.doc_id % 50 WHEN 7 THEN 'not UTF-8 text' WHEN 8 THEN 'not JSON' WHEN 9 THEN 'no reader for .odd' END AS error FROM documents d LEFT JOIN made m ON d.doc_id = m.doc_id)"

ORACLES = {
    "html_text": f"SELECT page_id, substring({_markup('html')}, 1, 8000) AS text FROM pages",
    "html_title": f"SELECT page_id, {_strip(_refs('regexp_extract(html, ' + _q('(?is)<title[^>]*>(.*?)</title>') + ', 1)'))} AS title FROM pages",
    "page_envelope": f"SELECT page_id, concat('PAGE TITLE: ', {_strip(_refs('regexp_extract(html, ' + _q('(?is)<title[^>]*>(.*?)</title>') + ', 1)'))}, chr(10), chr(10), 'PAGE CONTENT:', chr(10), substring({_markup('html')}, 1, 8000)) AS envelope FROM pages",
    "url_scheme": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('https://', regexp_replace(url, '^https?://', '')) ELSE url END AS url FROM pages",
    "url_domain": "SELECT page_id, split_part(url, '/', 3) AS domain FROM pages",
    "text_basic": f"{LINES} SELECT doc_id, line_no, {_basic('line')} AS basic FROM lines",
    "noise_lines": f"{LINES} SELECT doc_id, count(*) AS noise FROM (SELECT doc_id, {_basic('line')} AS c FROM lines) WHERE {_noise('c')} GROUP BY doc_id",
    "running_headers": f"""{LINES}, c AS (SELECT *, {_basic('line')} AS compact FROM lines), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) AS down FROM c WHERE compact <> '')
 SELECT doc_id, place, compact, count(*) AS pages FROM (SELECT doc_id, 'header' AS place, compact FROM n WHERE up <= 2 UNION ALL SELECT doc_id, 'footer', compact FROM n WHERE down <= 2) GROUP BY ALL HAVING count(*) >= 2""",
    "strip_headers": f"""{LINES}, c AS (SELECT *, {_basic('line')} AS compact, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) - 1 AS pos, count(*) OVER (PARTITION BY doc_id, page_number) AS size FROM lines),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) AS down FROM c WHERE compact <> ''),
 h AS (SELECT doc_id, compact FROM n WHERE up <= 2 GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT doc_id, compact FROM n WHERE down <= 2 GROUP BY ALL HAVING count(*) >= 2)
 SELECT doc_id, page_number, count(*) AS kept FROM c WHERE NOT {_noise('compact')} AND NOT (pos <= 1 AND EXISTS (SELECT 1 FROM h WHERE h.doc_id = c.doc_id AND h.compact = c.compact)) AND NOT (pos >= greatest(0, size - 2) AND EXISTS (SELECT 1 FROM t WHERE t.doc_id = c.doc_id AND t.compact = c.compact)) GROUP BY ALL""",
    "heading_lines": f"{LINES} SELECT doc_id, line_no FROM lines WHERE {_heading('line')}",
    "list_lines": f"{LINES} SELECT doc_id, line_no FROM lines WHERE {_item('line')}",
    "table_lines": f"{LINES} SELECT doc_id, line_no FROM lines WHERE {_row('line')}",
    "line_type_histogram": f"{LINES} SELECT {KIND} AS element_type, count(*) AS lines FROM lines GROUP BY 1",
    "line_blocks": f"{BLOCKS} SELECT * FROM blocks",
    "block_metadata": f"{BLOCKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INT) AS block_index, element_type, {_flat('text')} AS text, concat('doc-', doc_id) AS source_file, 'text' AS source_type, 'both' AS audience, (SELECT lang FROM documents d WHERE d.doc_id = blocks.doc_id) AS language, 'semantic_denoise_v1' AS normalization_method FROM blocks",
    "sentences": f"WITH s AS (SELECT doc_id, {_sentences('text')} AS ss FROM documents) SELECT doc_id, CAST(i - 1 AS INT) AS at, ss[i] AS sentence FROM s, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i)",
    "sentence_counts": f"SELECT doc_id, len({_sentences('text')}) AS sentences FROM documents",
    "chunk_paragraphs": f"{PACKED} SELECT * FROM chunks",
    "chunk_quality": f"{PACKED} SELECT doc_id, chunk_index, {_reason('text')} IS NULL AS valid FROM chunks",
    "chunk_reject_reasons": f"SELECT doc_id, {_reason('text')} AS reason FROM documents",
    "valid_chunks": f"{PACKED} SELECT doc_id, count(*) AS chunks FROM chunks WHERE {_reason('text')} IS NULL GROUP BY doc_id",
    "char_windows": "SELECT doc_id, CAST(i AS INT) AS at, substring(text, CAST(i * 1200 + 1 AS BIGINT), 1500) AS part FROM documents, LATERAL (SELECT unnest(range(0, greatest(0, length(text) - 1500 + 1199) // 1200 + 1)) AS i)",
    "chunk_ids": f"{PACKED} SELECT concat('chunk-', row_number() OVER (ORDER BY doc_id, chunk_index)) AS id, doc_id, chunk_index FROM chunks",
    "file_results": f"{FILES} SELECT * FROM files",
    "manifest": f"{FILES} SELECT count(*) AS files_discovered, count(*) FILTER (error IS NULL) AS files_succeeded, count(error) AS files_failed, CAST(sum(chunk_count) AS BIGINT) AS chunks_total, CAST(sum(valid_count) AS BIGINT) AS chunks_valid, 'local' AS embedding_provider FROM files",
    "lecture_notes": f"{PACKED}, k AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN concat('lesson-', doc_id % 30) ELSE concat('doc-', doc_id) END AS lesson_key FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY lesson_key ORDER BY doc_id, chunk_index) AS rn FROM k QUALIFY rn <= 6) SELECT lesson_key, count(*) AS chunks, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS notes FROM r GROUP BY lesson_key",
    "ai_json_fallback": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'no json at all' ELSE concat('s', page_id) END AS summary, CASE WHEN page_id % 3 = 0 THEN 'parsing_error' ELSE 'k' END AS key_topics, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 'lesson' END AS content_type FROM pages",
}

RESULTS = """SELECT page_id // 8 AS query_id, page_id AS ord, CASE WHEN page_id % 7 <> 0 THEN concat('<Page> ', page_id) ELSE '' END AS title, CASE WHEN page_id % 4 <> 0 THEN concat('it''s "', url, '"') ELSE '' END AS body,
 CASE WHEN page_id % 3 <> 0 THEN url ELSE '' END AS url FROM pages"""


def _escaped(value: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        value = f"replace({value}, '{char}', '{entity}')"
    return value


ORACLES["result_cards"] = f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INT) AS rank, {_escaped("CASE WHEN title = '' THEN 'Untitled result' ELSE title END")} AS title,
 {_escaped("CASE WHEN contains(url, '//') THEN split_part(url, '/', 3) ELSE '' END")} AS domain, {_escaped('body')} AS snippet, {_escaped('url')} AS url FROM ({RESULTS}) QUALIFY rank <= 5"""
ORACLES["web_contexts"] = f"""SELECT query_id, concat(string_agg(concat(title, ': ', body), chr(10) || chr(10) ORDER BY ord), CASE WHEN count(*) FILTER (url <> '') > 0 THEN concat(chr(10), chr(10), 'Most relevant source URL: ', arg_min(url, ord) FILTER (url <> '')) ELSE '' END) AS context
 FROM ({RESULTS}) WHERE body <> '' GROUP BY query_id"""
