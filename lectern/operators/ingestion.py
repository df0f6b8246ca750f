"""Files into pages, and pages into blocks: readers whose failures are rows, and an ordered choice of producers for each page."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import bound, nfkc, text_of
from lectern.operators.chunks import WORDS, packed, sentences
from lectern.operators.lines import blocks_of, flat_basic, is_noise, normal_text
from lectern.operators.reports import suffix_of

#: One page of a file: its number, its text, and lines that were recognised in its image, where there are any.
Page = tuple[int, str | None, list[str] | None]
Reader = Callable[[bytes], list[Page]]
PAGE = "struct<page_number:int,text:string,recognised:array<string>>"
READ = pa.schema([("path", pa.string()), ("pages", pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string()), ("recognised", pa.list_(pa.string()))]))), ("error", pa.string())])
#: Bytes of files that are read before their pages are handed on.
BATCH = 1 << 20
#: Ends of lines as in Unicode.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def read_text(content: bytes) -> list[Page]:
    """A text file in UTF-8; form feeds part its pages."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        raise ValueError("not UTF-8 text") from None
    return [(i, page, None) for i, page in enumerate(text.split("\f"), 1)]


def read_json_pages(content: bytes) -> list[Page]:
    """JSON lines of pages: page_number, text, and recognised lines."""
    rows = [json.loads(line) for line in content.decode("utf-8").split("\n") if line.strip()]
    return [(int(r["page_number"]), r.get("text"), r.get("recognised")) for r in rows]


def read_slides(content: bytes) -> list[Page]:
    """A presentation: a page for each slide in order of their numbers, a line for each paragraph, those of a level below the first as list items."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {int(n[16:-4]): n for n in z.namelist() if n.startswith("ppt/slides/slide") and n[16:-4].isdigit() and n.endswith(".xml")}
        pages = []
        for number in sorted(names):
            lines = []
            for p in ElementTree.fromstring(z.read(names[number])).iter(f"{DRAWING}p"):
                line = "".join(t.text or "" for t in p.iter(f"{DRAWING}t")).strip()
                about = p.find(f"{DRAWING}pPr")
                below = about is not None and (int(about.get("lvl", 0)) > 0 or about.find(f"{DRAWING}buChar") is not None)
                if line:
                    lines.append(f"- {line}" if below else line)
            pages.append((number, "\n".join(lines), None))
    if not pages:
        raise ValueError("no slides")
    return pages


#: Readers by suffix. Those of other formats, and models that recognise images, are passed by the caller.
READERS: dict[str, Reader] = {".txt": read_text, ".jsonl": read_json_pages, ".pptx": read_slides}


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of all files under a folder; Spark's source leaves out those of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_files(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """path, pages and error of each of ``files`` (path, content): a reader's exception, or that there is none, is its row's error and leaves its pages empty; the others go on.

    A file is read inside the task that holds it; what was read goes on in batches of about ``BATCH`` bytes of files.
    """
    readers = READERS if readers is None else readers

    def one(suffix: str, content: bytes | None) -> tuple[list[Page], str | None]:
        try:
            if suffix not in readers:
                raise ValueError(f"no reader for {suffix or 'files without a suffix'}")
            return readers[suffix](bytes(content or b"")), None
        except Exception as problem:  # whatever a file does to its reader is that file's own
            return [], str(problem) or type(problem).__name__

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rows = 0, []
            for i, (path, suffix) in enumerate(zip(batch.column("path").to_pylist(), batch.column("suffix").to_pylist())):
                content = batch.column("content")[i].as_py()
                pages, error = one(suffix, content)
                rows.append((path, [dict(zip(("page_number", "text", "recognised"), p)) for p in pages], error))
                size += len(content or b"")
                if size >= BATCH or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), READ.types)], schema=READ)
                    size, rows = 0, []

    return files.select("path", suffix_of(F.col("path")).alias("suffix"), F.col("content").cast("binary").alias("content")).mapInArrow(work, f"path string, pages array<{PAGE}>, error string")


def pages_of(read: DataFrame) -> DataFrame:
    """path, page_number, text and recognised of the pages that were read."""
    return read.select("path", F.explode("pages").alias("p")).select("path", "p.*")


def run_results(read: DataFrame, chunks: DataFrame, valid: Column) -> DataFrame:
    """path, pages, chunk_count, valid_count and error of each file of ``read``; a failed one has zeros. ``chunks`` has path."""
    made = chunks.groupBy("path").agg(F.count("*").alias("c"), F.count_if(valid).alias("v"))
    zero = F.lit(0).cast("long")
    return read.select("path", F.size("pages").cast("long").alias("pages"), "error").join(made, "path", "left").select("path", "pages", F.coalesce("c", zero).alias("chunk_count"), F.coalesce("v", zero).alias("valid_count"), "error")


def packed_results(read: DataFrame, valid: Callable[[Column], Column], words: int = WORDS) -> DataFrame:
    """``run_results`` of files whose pages are packed into chunks of whole sentences: counted in the file's row, which is read once and not shuffled. ``valid`` is of a chunk's text."""
    texts = lambda p: F.transform(packed(sentences(p["text"]), words), lambda c: c["text"])
    counts = F.transform("pages", lambda p: bound(texts(p), lambda ts: F.struct(F.size(ts).alias("c"), F.size(F.filter(ts, valid)).alias("v"))))
    total = lambda name: F.aggregate(F.transform("counts", lambda x: x[name].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = read.select("path", F.size("pages").cast("long").alias("pages"), counts.alias("counts"), "error")
    return rows.select("path", "pages", total("c").alias("chunk_count"), total("v").alias("valid_count"), "error")


def composed(text: Column) -> Column:
    """Composed characters, and words joined that a hyphen parts at a line's end."""
    return F.regexp_replace(nfkc(text_of(text)), r"([A-Za-z])-[ \t]*\n[ \t]*([A-Za-z])", "$1$2")


def page_blocks(pages: DataFrame) -> DataFrame:
    """path, page_number, block, element_type, text, producer and recognised_lines of all pages (path, page_number, text, recognised).

    First a file's running lines: those that are twice among the first two or the last two of its pages. Then each page, without them and without noise, by the first producer that has something: the
    blocks of its lines (``lines``), its whole normal text as one block without element_type (``page``), the blocks of the lines recognised in its image (``recognised``).
    Pages are dealt by file once, to meet their running lines.
    """
    lines = F.filter(F.split(F.col("composed"), LINE_END), lambda x: F.rlike(x, F.lit(r"(?U)\S")))
    rows = pages.withColumn("composed", composed(F.col("text"))).select("path", "page_number", "composed", "recognised", lines.alias("lines"))
    rows = rows.withColumn("compact", F.transform("lines", flat_basic))
    said = F.filter("compact", lambda x: x != "")
    ends = F.concat(*[F.transform(part, lambda x: F.struct(F.lit(place).alias("place"), x.alias("line"))) for place, part in (("head", F.slice(said, 1, 2)), ("foot", F.slice(said, F.greatest(F.size(said) - 1, F.lit(1)), F.lit(2))))])
    # only the lines at the ends of pages are dealt to be counted, and the pages as one text each
    often = rows.select("path", ends.alias("ends")).repartition("path").select("path", F.explode("ends").alias("e")).groupBy("path", "e.place", "e.line").agg(F.count("*").alias("n")).where("n >= 2")
    running = often.groupBy("path").agg(*[F.array_sort(F.collect_set(F.when(F.col("place") == p, F.col("line")))).alias(p) for p in ("head", "foot")])
    none = F.expr("cast(array() as array<string>)")
    rows = rows.select("path", "page_number", "composed", "recognised").repartition("path").join(running, "path", "left").withColumns({p: F.coalesce(p, none) for p in ("head", "foot")})
    rows = rows.withColumn("lines", lines).withColumn("compact", F.transform("lines", flat_basic))

    both = F.arrays_zip("lines", "compact")
    n = F.size("lines")
    goes = lambda x, i: (x["compact"] == "") | ((i <= 1) & F.array_contains("head", x["compact"])) | ((i >= F.greatest(F.lit(0), n - 2)) & F.array_contains("foot", x["compact"])) | is_noise(x["compact"])
    kept = F.transform(F.filter(both, lambda x, i: ~goes(x, i)), lambda x: x["lines"])
    seen = F.filter(F.coalesce("recognised", none), lambda x: ~bound(flat_basic(x), is_noise))
    # a producer is asked only where those before it have nothing
    rows = rows.select("path", "page_number", "composed", "recognised", kept.alias("kept"))
    rows = rows.withColumn("whole", F.when(F.size("kept") > 0, "").otherwise(normal_text(F.col("composed"))))
    rows = rows.withColumn("producer", F.when(F.size("kept") > 0, "lines").when(F.col("whole") != "", "page").otherwise("recognised"))
    rows = rows.withColumn("seen", F.when(F.col("producer") == "recognised", seen))
    whole = F.array(F.struct(F.lit(1).cast("long").alias("block"), F.lit(None).cast("string").alias("element_type"), F.lit(1).cast("long").alias("lines"), F.col("whole").alias("text")))
    made = F.when(F.col("producer") == "page", whole).otherwise(blocks_of(F.when(F.col("producer") == "lines", F.col("kept")).otherwise(F.col("seen")), normal_text))
    rows = rows.select("path", "page_number", "producer", F.when(F.col("producer") == "recognised", F.size("recognised")).alias("recognised_lines"), F.posexplode(made).alias("at", "b"))
    return rows.select("path", "page_number", (F.col("at") + 1).cast("int").alias("block"), "b.element_type", "b.text", "producer", "recognised_lines")
