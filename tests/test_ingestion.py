import io
import random
import re
import unicodedata
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunks as C
from lectern.operators import ingestion as G
from lectern.operators import lines as N
from lectern.operators import reports as P
from lectern.plans import registry

SF = "/root/testdata/sf0.001"
PAGES = "path string, page_number int, text string, recognised array<string>"


def slides(*texts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, lines in enumerate(texts, 1):
            ps = "".join(f'<a:p>{"<a:pPr lvl=" + chr(34) + str(level) + chr(34) + "/>" if level else ""}<a:r><a:t>{t}</a:t></a:r></a:p>' for level, t in lines)
            z.writestr(f"ppt/slides/slide{i}.xml", f'<s xmlns:a="{G.DRAWING[1:-1]}">{ps}</s>')
    return out.getvalue()


FILES = {
    "a/one.txt": b"first line\nsecond\x0cnext page",
    "a/broken.txt": b"\xff\xfe\x00",
    "b/two.jsonl": b'{"page_number": 3, "text": "x"}\n\n{"page_number": 4, "text": null, "recognised": ["seen"]}\n',
    "b/broken.jsonl": b'{"page_number": 3',
    "b/missing.jsonl": b'{"text": "no number"}',
    "c/deck.pptx": slides([(0, "Title Words Here"), (1, "item")], [], [(0, "x &amp; y")]),
    "c/broken.pptx": b"PK no zip",
    "c/empty.pptx": slides(),
    "c/scan.PDF": b"%PDF",
    "none": b"x",
    "blank.txt": b" ",
}


@pytest.fixture
def folder(tmp_path):
    for name, content in FILES.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path / "in"


def test_failures_are_rows_and_the_others_go_on(spark, folder):
    read = G.read_files(G.binary_files(spark, str(folder)))
    got = {r.path.split("/in/")[1]: ([tuple(p) for p in r.pages], r.error) for r in read.collect()}
    assert set(got) == set(FILES)
    assert got["a/one.txt"] == ([(1, "first line\nsecond", None), (2, "next page", None)], None)
    assert got["b/two.jsonl"] == ([(3, "x", None), (4, None, ["seen"])], None)
    assert got["c/deck.pptx"] == ([(1, "Title Words Here\n- item", None), (2, "", None), (3, "x & y", None)], None)
    assert got["blank.txt"] == ([(1, " ", None)], None)
    errors = {k: e for k, (pages, e) in got.items() if e}
    assert all(not got[k][0] for k in errors)
    assert errors["a/broken.txt"] == "not UTF-8 text" and errors["c/empty.pptx"] == "no slides" and errors["c/scan.PDF"] == "no reader for .pdf" and errors["none"] == "no reader for files without a suffix"
    assert set(errors) == {"a/broken.txt", "b/broken.jsonl", "b/missing.jsonl", "c/broken.pptx", "c/empty.pptx", "c/scan.PDF", "none"}


def test_readers_are_passed_and_a_run_has_a_manifest(spark, folder):
    def pdf(content):
        return [(1, None, ["A LINE", content[:4].decode()])]

    read = G.read_files(G.binary_files(spark, str(folder)), {**G.READERS, ".pdf": pdf})
    blocks = G.page_blocks(G.pages_of(read))
    chunks = blocks.select("path", F.explode(C.packed(C.sentences(F.col("text")))).alias("c")).select("path", "c.text")
    results = G.run_results(read, chunks, C.reject_reason(F.col("text")).isNull())
    row = P.manifest(results).first()
    assert (row.files_discovered, row.files_succeeded, row.files_failed) == (11, 5, 6) and row.chunks_total == chunks.count() > 3
    assert all((r.chunk_count, r.valid_count) == (0, 0) for r in results.where("error is not null").collect())
    assert {r.producer for r in blocks.where("path like '%scan.PDF'").collect()} == {"recognised"}


def test_an_empty_folder_has_no_rows(spark):
    files = spark.createDataFrame([("a.txt", None)], "path string, content binary")
    assert G.read_files(files.limit(0)).collect() == []
    assert [tuple(p) for p in G.read_files(files).first().pages] == [(1, "", None)]


def basic(text):
    return " ".join(re.sub(r"[\x00-\x1f\x7f]", "", unicodedata.normalize("NFKC", text)).split())


def noise(compact):
    if not compact or re.search("|".join(N.LEGAL), compact, re.I) or re.fullmatch(N.PAGE_MARK, compact, re.I):
        return True
    return bool(re.fullmatch(N.NOT_ALNUM, compact))


def normal(text):
    out = unicodedata.normalize("NFKC", text)
    for old, new in N.MENDED:
        out = out.replace(old, new)
    out = re.sub(r"([A-Za-z])-[ \t]*\n[ \t]*([A-Za-z])", r"\1\2", out)
    out = re.sub(r"(?<![.!?:;])\n(?!\n)", " ", out)
    out = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", out)
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", out))
    out = "\n".join(line for line in out.split("\n") if not noise(basic(line)))
    out = re.sub(N.SYMBOLS, " ", out)
    return " ".join(re.sub(r"\s+([,.;:!?])", r"\1", out).split())


def kind(line):
    words = line.split()
    if len(line) <= 90 and words:
        if line.isupper() and len(words) <= 12:
            return "heading"
        titled, lettered = sum(w[:1].isupper() for w in words), sum(any(c.isalpha() for c in w) for w in words)
        if not line.endswith((".", ":", ";")) and lettered >= 2 and titled >= max(2, len(words) // 2) and len(words) <= 10:
            return "heading"
    if re.match(N.LIST_MARK, line):
        return "list_item"
    return "table" if "|" in line else "paragraph"


def plain_blocks(lines):
    out, last = [], None
    for line in map(normal, lines):
        own = kind(line) if line else None
        if own and own == last and own in ("table", "paragraph"):
            out[-1][1].append(line)
        elif own:
            out.append((own, [line]))
        last = own
    return [(k, ("\n" if k == "table" else " ").join(ls)) for k, ls in out]


def plain_file(pages):
    """Blocks of one file's pages: (page, block, kind, text, producer, recognised)."""
    texts = {n: re.sub(r"([A-Za-z])-[ \t]*\n[ \t]*([A-Za-z])", r"\1\2", unicodedata.normalize("NFKC", t or "")) for n, t, _ in pages}
    lines = {n: [x for x in t.splitlines() if x.strip()] for n, t in texts.items()}
    heads, feet = Counter(), Counter()
    for own in lines.values():
        said = [basic(x) for x in own if basic(x)]
        heads.update(said[:2])
        feet.update(said[-2:])
    out = []
    for n, _, seen in pages:
        own = lines[n]
        kept = [x for i, x in enumerate(own) if not ((i <= 1 and heads[basic(x)] >= 2) or (i >= max(0, len(own) - 2) and feet[basic(x)] >= 2) or noise(basic(x)))]
        if kept:
            made, producer = plain_blocks(kept), "lines"
        elif normal(texts[n]):
            made, producer = [(None, normal(texts[n]))], "page"
        else:
            made, producer = plain_blocks([x for x in seen or [] if not noise(basic(x))]), "recognised"
        out += [(n, i, k, t, producer, len(seen or []) if producer == "recognised" else None) for i, (k, t) in enumerate(made, 1)]
    return out


def check(spark, files):
    rows = spark.createDataFrame([(path, *page) for path, pages in files.items() for page in pages], PAGES)
    got = {}
    for r in G.page_blocks(rows).orderBy("path", "page_number", "block").collect():
        got.setdefault(r.path, []).append((r.page_number, r.block, r.element_type, r.text, r.producer, r.recognised_lines))
    want = {path: plain_file(pages) for path, pages in files.items()}
    assert got == {k: v for k, v in want.items() if v}
    return want


def test_blocks_of_made_up_files_equal_a_plain_loop(spark):
    r = random.Random(4)
    parts = ["Some Heading Words", "ALL CAPITALS", "a plain line of text", "ends here.", "- item one", "2) item two", "a | b", "c | d", "", "Page 3", "all rights reserved", "....", "exam-", "ple goes on", "ﬁne print", "Â odd â€™ signs ■"]
    files = {}
    for f in range(30):
        head, foot = r.choice(["Running Head", "chapter one", ""]), r.choice(["running foot", "7", ""])
        files[f"f{f}"] = [(n, r.choice([None, "", "\n".join([head, *r.choices(parts, k=r.randint(0, 8)), foot]), f"{head}\n{foot}", "\r\n".join(r.choices(parts, k=3))]), r.choice([None, [], r.choices(parts, k=4)])) for n in range(1, r.randint(2, 6))]
    want = check(spark, files)
    assert {p for rows in want.values() for *_, p, _ in rows} == {"lines", "page", "recognised"}


def test_whole_documents_equal_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    files = {}
    for d in docs:
        lines = (d.text or "").split("\n")
        files[f"doc-{d.doc_id}"] = [(i // 40 + 1, None if (d.doc_id + i // 40) % 9 == 0 else "\n".join(lines[i : i + 40]), lines[i : i + 40]) for i in range(0, len(lines), 40)]
    check(spark, files)
    rows = registry.QUERIES["page_blocks"](spark, SF)
    assert rows.count() == sum(len(plain_file(p)) for p in files.values())


def test_pages_are_dealt_once(spark):
    rows = spark.createDataFrame([("f", 1, "x", None)], PAGES)
    plan = G.page_blocks(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and plan.count("hashpartitioning(path") == plan.count("Exchange") and "Python" not in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_numbered_in_their_row(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "INTRO\n\n- a\n- b\n\n©\n\nsome words here.", "en", "s", 0), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("stamped_blocks", "block_metadata"):
        df = entry.queries()[name](spark, str(tmp_path))
        assert "Window" not in _plan(df)
        assert sorted(r.block_index for r in df.collect())[:3] == [0, 1, 2]


def test_a_page_is_made_normal_only_where_its_lines_are_gone(spark):
    from pyspark.sql import functions as F

    from lectern.operators.ingestion import page_blocks
    from lectern.operators.lines import normal_text

    clean = spark.createDataFrame([("a.\nPage 3\n\ncafe\u0301 â€œ x-\ny © , z\x01",), ("Page 4",), (None,)], "text string").select(normal_text(F.col("text")).alias("t"))
    # once for a line of several, once for a single one
    assert _plan(clean).count(r"[\x00-\x1f\x7f]") == 2
    assert [r.t for r in clean.collect()] == ['a. café " xy, z', "", ""]
    pages = spark.createDataFrame([("f", 1, "Some words here", ["seen"]), ("f", 2, "draft", ["seen too"]), ("f", 3, None, None)], "path string, page_number int, text string, recognised array<string>")
    df = page_blocks(pages)
    # what is dealt is a page's text, or the ends of its lines, and no list of lines
    dealt = [lines[i + 1] for lines in [_plan(df).split("\n")] for i, x in enumerate(lines) if "RepartitionByExpression" in x]
    assert len(dealt) == 2 and not any("AS lines#" in x or "AS compact#" in x for x in dealt)
    assert sorted((r.page_number, r.text, r.producer) for r in df.collect()) == [(1, "Some words here", "lines"), (2, "seen too", "recognised")]


def test_files_go_on_in_batches_and_are_read_once(spark, tmp_path):
    import __spark_entry__ as entry

    from lectern.operators import ingestion as G
    from lectern.operators.chunks import chunk_paragraphs, reject_reason

    text = "One sentence of some words stands here. " * 40
    files = spark.createDataFrame([(f"in/{i}{'.odd' if i % 9 == 4 else '.txt'}", b"\xff" if i % 9 == 5 else f"{text}{i}\f\f{text}".encode() if i % 9 else None) for i in range(90)], "path string, content binary")
    read = G.read_files(files)
    valid = lambda t: reject_reason(t if not isinstance(t, str) else F.col(t)).isNull()
    want = G.run_results(read, chunk_paragraphs(G.pages_of(read), ["path"]), valid("text"))
    assert sorted(map(tuple, G.packed_results(read, valid).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    spark.createDataFrame([(1, "a", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = _plan(entry.queries()["run_results"](spark, str(tmp_path)))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
