"""Golden cases for what SQL doesn't cover, and for behaviour that is easy to lose."""

import datetime
import json
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import routing, scalars
from lectern.operators import chat_logs, chunks, faq, lines, reports, retrieval, turns
from lectern.sources import jsonl
from lectern.streaming import events as streams


def one(spark, column_of, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in df.select("i", column_of(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normal_text(spark):
    got = one(spark, lines.normal_text, None, "a well-\nknown fact", "first\nsecond. \nThird.\n\nnew", "x ™ y", "Âge", "Page 3 of 9", "all good\n\nDRAFT copy\n\nend.", "sign ■ here , ok !", "a\x00b\tc")
    assert got == ["", "a wellknown fact", "first second. Third. new", "x TM y", "ge", "", "all good end.", "sign here, ok!", "ab c"]


def test_line_kinds(spark):
    got = one(spark, lines.line_type, "INTRODUCTION", "The Water Cycle", "- item", "1. first step of it", "a) x y", "a | b", "one  two  three", "plain words go here and on.", "The Water Cycle.", "A Very Long Title " * 6, "")
    assert got == ["heading", "heading", "list_item", "list_item", "list_item", "table_row", "table_row", "paragraph", "paragraph", "paragraph", "paragraph"]


def plain_chunks(blocks, words):
    """The rules once more, as a loop."""
    out, i, size = [], 0, lambda t: len(t.split())
    while i < len(blocks):
        kind, text = blocks[i]
        if kind in ("heading", "list_item", "table_row"):
            follow, own, j = {"heading": "paragraph"}.get(kind, kind), [text], i + 1
            while size(text) <= words and j < len(blocks) and blocks[j][0] == follow and size(" ".join([*own, blocks[j][1]])) <= words:
                own.append(blocks[j][1])
                j += 1
            out.append((i, "\n".join(own), j - i))
            i = j
            continue
        if kind == "table":
            out.append((i, text, 1))
        else:
            parts, filled = [], 0
            for s in text.replace("? ", "?|").replace(". ", ".|").split("|"):
                if parts and filled + size(s) > words:
                    out.append((i, " ".join(parts), 1))
                    parts, filled = [], 0
                parts.append(s)
                filled += size(s)
            out.append((i, " ".join(parts), 1))
        i += 1
    return out


def test_chunk_blocks_equal_the_loop(spark):
    import random

    r = random.Random(8)
    kinds = ["heading", "paragraph", "paragraph", "list_item", "list_item", "table", "table_row"]
    docs = {d: [(r.choice(kinds), " ".join(r.choice(["aa", "b.", "c?", "dd"]) for _ in range(r.randint(1, 14)))) for _ in range(r.randint(1, 12))] for d in range(60)}
    rows = [(d, i, k, t) for d, bs in docs.items() for i, (k, t) in enumerate(bs)]
    got = chunks.chunk_blocks(spark.createDataFrame(rows, "doc_id long, block_index int, element_type string, text string"), 10)
    found = {}
    for x in got.orderBy("doc_id", "block_index", "chunk_index").collect():
        found.setdefault(x.doc_id, []).append((x.block_index, x.text, x.blocks_combined))
    assert found == {d: plain_chunks(bs, 10) for d, bs in docs.items()}


def test_sentences_keep_abbreviations(spark):
    assert one(spark, chunks.sentences, "", "Dr. Who met Mrs. X. They left, e.g. by car! Why?  So.") == [[""], ["Dr. Who met Mrs. X.", "They left, e.g. by car!", "Why?", "So."]]


def test_reject_reasons(spark):
    texts = ["too few words here", "1 2 3 4 5 6 7", "see https://x.org for more words now", "ALL CAPS WORDS IN THIS ONE", "fine words make a good chunk", "deadbeef01 cafebabe02 abcdef0123 words and many more letters in here to be sure", "a*** b*** c*** d*** enough letters are in this text to pass the share"]
    assert one(spark, chunks.reject_reason, *texts) == ["too_short", "few_letters", "address", "capitals", None, "hex", "symbols"]


def test_snippet_bounds(spark):
    assert one(spark, scalars.snippet, "a" * 140, "a" * 141, "b \n c ", None) == ["a" * 140, "a" * 139 + "…", "b c", ""]


def test_roles(spark):
    assert one(spark, scalars.access_role, "X@Education.org", "a.education@b", "a@b@education.x", "nobody", None) == ["teacher", "teacher", "student", None, None]


def test_routes_in_order(spark):
    df = spark.createDataFrame([("lesson plan as pdf", "teacher", None), ("lesson plan", "student", None), ("summarize the pdf", "x", None), ("wiki image", "x", None), ("hello", "x", "f.pdf"), (None, None, None)], "t string, r string, f string")
    got = [x.a for x in df.select(routing.route(F.col("t"), F.col("r"), F.col("f")).alias("a")).collect()]
    assert got == ["lesson-plan", "lesson-plan-blocked", "short-notes", "image", "document", "general"]


def test_rounding_to_even(spark):
    row = spark.range(35, 36).select(*[c.alias(n) for n, c in routing.lesson_timing(F.col("id").cast("int")).items()]).first()
    assert (row.intro, row.direct, row.guided, row.independent, row.closure) == (4, 10, 10, 6, 5)


def test_fuzzy_matches(spark):
    df = spark.createDataFrame([(1, "who crated lectern"), (2, "newton's laws"), (3, "do you store all my messages?")], "msg_id long, text string")
    got = {r.msg_id: r.question for r in faq.faq_best(df).collect()}
    assert got == {1: "who created lectern", 3: "do you store my messages"}


def test_upserts_and_ratings(spark):
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", "x", "img", 1), ("a", "y", None, 2), ("b", None, None, 1)], "log_id string, v string, img string, n int")
    assert {tuple(r) for r in chat_logs.latest_by_key(events, "log_id", "n").collect()} == {("a", "y", None, 2), ("b", None, None, 1)}
    assert {(r.log_id, r.v, r.img) for r in chat_logs.latest_keeping(events, "log_id", "n", ("img",)).collect()} == {("a", "y", "img"), ("b", None, None)}
    logs = spark.createDataFrame([("a", 0, at)], "log_id string, stars int, timestamp_utc timestamp_ntz")
    late = spark.createDataFrame([("a", 3, at), ("a", 5, at + datetime.timedelta(1))], "log_id string, stars int, timestamp_utc timestamp_ntz")
    assert chat_logs.apply_ratings(logs, late).first().stars == 5


def test_search_beyond_the_listed_sessions(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(f"s{i:02}", "u@x", f"needle {i}" if i < 3 else "hay", "", at + datetime.timedelta(minutes=i), i) for i in range(30)]
    logs = spark.createDataFrame(rows, "session_id string, user_email string, user_prompt string, response string, timestamp_utc timestamp_ntz, seq long")
    got = chat_logs.session_search(logs, "Needle").orderBy("rank").collect()
    assert [(r.session_id, r.message_count) for r in got] == [("s02", 0), ("s01", 0), ("s00", 0)]
    assert chat_logs.session_search(logs, "n_edle").count() == 3


def test_bad_image_is_null(spark):
    logs = spark.createDataFrame([("a", "u"), ("b", "u")], "log_id string, user_name string")
    images = spark.createDataFrame([("a", "u", "data:image/png;base64,aGk="), ("b", "u", "%%%")], "log_id string, user_name string, image string")
    assert {r.log_id: r.image_blob and bytes(r.image_blob) for r in chat_logs.attach_images(logs, images).collect()} == {"a": b"hi", "b": None}


def test_facts(spark):
    df = spark.createDataFrame([("e", 1, "DOE stands for Department"), ("e", 2, "doe means \"Other thing\"."), ("", 3, "ABC is nothing much"), ("e", 4, "gravity is called the force")], "user_email string, ord int, text string")
    facts = turns.user_facts(df)
    assert turns.fact_maps(facts).first().facts == {"DOE": "Other thing", "GRAVITY": "the force"}


def test_windows_of_characters(spark):
    assert [len(w) for w in one(spark, lambda t: chunks.char_windows(t, 10, 8), "x" * 25)[0]] == [10, 10, 9]
    assert one(spark, lambda t: chunks.char_windows(t, 10, 8), "", "abc") == [[""], ["abc"]]


def test_pagination(spark):
    df = spark.createDataFrame([(1, "\n".join(["word " * 30] * 40))], "doc_id long, text string")
    rows = reports.paginate(df).collect()
    assert max(len(r.line) for r in rows) <= 90 and {r.page for r in rows} == {1, 2}
    assert " ".join(r.line.strip() for r in rows).split() == ["word"] * 1200


def test_top_k_grows_with_k(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(50)], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 2")
    few, more = (sorted((x.query_id, x.rank, x.vec_id) for x in retrieval.nearest(v, q, k).collect()) for k in (3, 7))
    assert few == [x for x in more if x[1] <= 3]


def test_files(spark, tmp_path):
    for name in ("a.PDF", "b.txt", "sub/c.png"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * 1024)
    assert {x.suffix for x in reports.discover(spark, str(tmp_path)).collect()} == {".pdf", ".png"}
    listed = reports.file_listing(reports.discover(spark, str(tmp_path))).collect()
    assert [(x.name, x.size_mb) for x in listed] == [("a.PDF", "0.00 MB"), ("c.png", "0.00 MB")]


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("chunk-1", "été", {"k": "v"})], jsonl.CHUNK)
    jsonl.write_jsonl(rows, str(tmp_path / "chunks"))
    assert [tuple(r) for r in jsonl.read_chunks(spark, str(tmp_path / "chunks")).collect()] == [("chunk-1", "été", {"k": "v"})]
    vectors = spark.createDataFrame([("chunk-1", [1.0], {})], jsonl.VECTOR)
    assert jsonl.with_vectors(jsonl.read_chunks(spark, str(tmp_path / "chunks")), vectors).first().embedding == [1.0]
    for run in ("a", "b"):
        (tmp_path / f"{run}.json").write_text(json.dumps({"file_results": [{"file": "x", "chunk_count": 2}]}, indent=1))
    assert jsonl.compare_manifests(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).count() == 2


def test_ai_fallback(spark):
    df = spark.createDataFrame([(1, "{\"summary\": \"s\"}"), (2, "x" * 300)], "page_id long, response string")
    got = {r.page_id: (r.summary, r.key_topics) for r in reports.ai_pages(df).collect()}
    assert got == {1: ("s", None), 2: ("x" * 200, "parsing_error")}


@pytest.fixture
def streamed(spark, tmp_path):
    def run(df, transform, mode="append"):
        path = str(tmp_path / "in")
        df.repartition(1).write.parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        query = transform(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return spark.table("out").collect()

    return run


def test_stream_windows_equal_batch(spark, streamed):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=7 * i), "click" if i % 2 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    got = streamed(df, lambda s: streams.stream_windows(s), "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, streams.windows(df).collect()))


def test_stream_latest(spark, streamed):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, n int, v string")
    assert sorted((r.k, r.v) for r in streamed(df, lambda s: streams.stream_latest(s, "k", "n"), "complete")) == [("a", "z"), ("b", "q")]


def test_stream_pending_images(spark, streamed):
    rows = [(1, "s", 1, "make a poster", True), (2, "s", 2, "no text", False), (3, "s", 3, "thanks", False), (4, "t", 1, "hi", False)]
    df = spark.createDataFrame(rows, "msg_id long, session_id string, ord int, text string, unclear boolean")
    assert [tuple(r) for r in streamed(df, streams.stream_pending_images)] == [(2, "s", "make a poster", "no text")]


def test_nearest_answers_more_queries_than_one_block_holds(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PASS", 7 * (4 * 8 + 8))
    r = random.Random(4)
    data = [(i, [r.random() for _ in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for x in retrieval.nearest(vectors, vectors.where("vec_id % 2 = 0"), 3).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    dots = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    assert {q: [v for _, v in sorted(rows)] for q, rows in got.items()} == {q: sorted(range(60), key=lambda v: (-dots(data[v][1], data[q][1]), v))[:3] for q in range(0, 60, 2)}


def test_paths_are_resolved_and_confined(spark):
    paths = ["out/a.pdf", "out/../b.pdf", "out/x/../c.PDF", "./out/d.pdf", "outer/e.pdf", "/out/f.pdf", "../out/g.pdf", "out/..", ".pdf", "out/h.tar.gz", ""]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, length long")
    got = {r.path: r for r in rows.select("path", reports.resolved(F.col("path")).alias("resolved"), reports.inside(F.col("path"), ["out"]).alias("inside"), reports.suffix_of(F.col("path")).alias("suffix"), reports.reader_of(F.col("path")).alias("reader")).collect()}
    assert {p: r.resolved for p, r in got.items()} == {p: "" if posixpath.normpath(p) == "." else posixpath.normpath(p) for p in paths}
    assert {p for p in paths if got[p].inside} == {"out/a.pdf", "out/x/../c.PDF", "./out/d.pdf", "out/h.tar.gz"}
    assert (got[".pdf"].suffix, got["out/h.tar.gz"].suffix, got["out/x/../c.PDF"].reader, got[""].reader) == ("", ".gz", "pdf", None)
    assert [r.name for r in reports.downloads(rows, ["out"]).orderBy("path").collect()] == ["d.pdf", "a.pdf", "c.PDF"]


def test_stamped_blocks_override_and_keep_numbers(spark):
    rows = spark.createDataFrame([(1, 0, "A first  block", "own", None), (1, 1, " \n ", "own", None), (1, 2, "A third", None, "pdf")], "doc_id long, block int, text string, source_file string, source_type string")
    got = lines.stamped_blocks(rows, source_file="", source_type="html", subject="art", grades=(3, None)).orderBy("block_index").collect()
    assert [(r.block_index, r.text, r.source_file, r.source_type, r.subject, r.audience, r.grade_min, r.grade_max, r.language) for r in got] == [
        (0, "A first block", "own", "html", "art", "both", 3, None, "en"),
        (2, "A third", None, "html", "art", "both", 3, None, "en"),
    ]


def test_session_buffers_strip_ends_and_cut(spark):
    rows = spark.createDataFrame([(1, 2, "Web page", "u", "two \n"), (1, 1, "Document", "f", "one\n \t"), (2, 1, "Document", "g", None), (3, 1, "Document", "h", "x" * 50)], "s long, at int, kind string, name string, text string")
    got = {r.s: r.buffer for r in turns.session_buffers(rows, "s", "at", 40).collect()}
    assert got == {1: "--- Document: f ---\none\n\n--- Web page: u ---\ntwo"[:40], 2: "--- Document: g ---", 3: "--- Document: h ---\n" + "x" * 20}


def test_turns_are_appended_and_lines_come_back(spark):
    held = spark.createDataFrame([(1, [("user", "a")]), (2, [("user", "b")])], "conv_id long, turns array<struct<role:string,content:string>>")
    more = spark.createDataFrame([(1, 2, "user", "c"), (1, 1, "assistant", None), (3, 0, "user", "d")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in turns.append_turns(held, more).collect()}
    assert got == {1: [("user", "a"), ("assistant", None), ("user", "c")], 2: [("user", "b")], 3: [("user", "d")]}
    rows = spark.createDataFrame([("1", "é\n😀\"\\", {"k": "v"}), ("2", "", {}), ("3", None, None)], "id string, text string, metadata map<string,string>")
    written = jsonl.json_lines(rows)
    assert all(r.line.isascii() and "\n" not in r.line for r in written.collect())
    assert sorted(map(tuple, jsonl.parsed_lines(written).collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
