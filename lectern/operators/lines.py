"""Lines of documents: noise, running headers, kinds of lines, and blocks made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.scalars import bound, collapsed, nfkc, stripped, text_of

#: Lines of a page where a document has no pages of its own.
PAGE_LINES = 40
# Patterns of noise, symbols without meaning, and texts that a wrong encoding left.
LEGAL = ("all rights reserved", r"copyright\s*(?:\(c\)|©)?", "do not (?:copy|distribute|reproduce)", "confidential", "draft", "sample watermark", "for internal use only", "unauthorized")
PAGE_MARK = r"(?:page\s*)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?"
NOT_ALNUM = "[^A-Za-z0-9]{2,}"
SYMBOLS = "[■□▪▫◆◇○●◦※¤§¶©®™]+"
#: What a wrong encoding made of a character, and the character.
MENDED = (("\u00a0", " "), ("\ufeff", ""), ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("Â", ""))
#: Without one of these characters nothing is to be mended.
MENDABLE = "[" + "".join(sorted({old[0] for old, _ in MENDED})) + "]"
LIST_MARK = r"^([-*•] |([0-9]+|[a-zA-Z])[.)]\s+)"


def basic(text: Column) -> Column:
    """Composed, without control characters, white space as single blanks."""
    return collapsed(F.regexp_replace(nfkc(text), r"[\x00-\x1f\x7f]", ""))


def flat_basic(text: Column) -> Column:
    """The same for text that is composed already."""
    return collapsed(F.regexp_replace(text_of(text), r"[\x00-\x1f\x7f]", ""))


def is_noise(compact: Column) -> Column:
    """Whether a line, made basic, is empty, legal wording, a page mark or signs only."""
    legal = F.rlike(compact, F.lit("(?i)" + "|".join(LEGAL)))
    mark = F.rlike(compact, F.lit(f"(?i)^({PAGE_MARK})$"))
    return (compact == "") | legal | mark | F.rlike(compact, F.lit(f"^{NOT_ALNUM}$"))


def is_heading(text: Column) -> Column:
    """Short, and all capitals, or mostly capitalised words without a final stop."""
    return _heading(stripped(text))


def _heading(line: Column) -> Column:
    """``is_heading`` of a stripped line.

    Words are counted by patterns, and only where the line may still be a heading, so that lines stay in generated code.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & (count(r"(?U)\S+") <= 12)
    n = count(r"(?U)\S+")
    titled, lettered = count(r"(?U)(?<!\S)\p{IsUppercase}"), count(r"(?U)(?<!\S)[^\s\p{L}]*\p{L}")
    title = (n <= 10) & (titled >= F.greatest(F.lit(2), F.floor(n / 2))) & (lettered >= 2)
    return F.when((F.length(line) > 90) | (line == ""), False).when(capitals, True).when(F.rlike(line, F.lit("[.:;]$")), False).otherwise(title)


def is_list_item(text: Column) -> Column:
    return F.rlike(stripped(text), F.lit(LIST_MARK))


def is_table_row(text: Column) -> Column:
    """A bar, a tab, or three cells with wide gaps."""
    return _row(stripped(text))


def _row(line: Column) -> Column:
    """``is_table_row`` of a stripped line."""
    return (line != "") & (F.contains(line, F.lit("|")) | F.contains(line, F.lit("\t")) | (F.size(F.split(line, r"\s{2,}")) >= 3))


def line_type(text: Column) -> Column:
    return F.when(is_heading(text), "heading").when(is_list_item(text), "list_item").when(is_table_row(text), "table_row").otherwise("paragraph")


def doc_lines(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no (from 0), line: documents taken apart at newlines, a page every 40 lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_of(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.select("doc_id", (F.floor(F.col("line_no") / PAGE_LINES) + 1).cast("int").alias("page_number"), F.col("line_no").cast("int"), "line")


def running_lines(lines: DataFrame) -> DataFrame:
    """doc_id, place, compact, pages: basic lines that are twice among the first two or last two of a document's pages."""
    rows = lines.withColumn("compact", flat_basic(F.col("line"))).where("compact <> ''")
    page = W.partitionBy("doc_id", "page_number")
    rows = rows.withColumn("up", F.row_number().over(page.orderBy("line_no"))).withColumn("down", F.row_number().over(page.orderBy(F.desc("line_no"))))
    ends = rows.select("doc_id", "compact", F.explode(F.array_compact(F.array(F.when(F.col("up") <= 2, F.lit("header")), F.when(F.col("down") <= 2, F.lit("footer"))))).alias("place"))
    return ends.groupBy("doc_id", "place", "compact").agg(F.count("*").alias("pages")).where("pages >= 2")


def strip_running(lines: DataFrame) -> DataFrame:
    """The lines without blank ones, noise, and running headers and footers at a page's two first or last lines."""
    page = W.partitionBy("doc_id", "page_number")
    rows = lines.withColumn("compact", flat_basic(F.col("line"))).withColumn("at", F.row_number().over(page.orderBy("line_no")) - 1).withColumn("size", F.count("*").over(page))
    marks = running_lines(lines).groupBy("doc_id", "compact").agg(F.bool_or(F.col("place") == "header").alias("header"), F.bool_or(F.col("place") == "footer").alias("footer"))
    marked = rows.join(marks, ["doc_id", "compact"], "left")
    none = F.lit(False)
    head = (F.col("at") <= 1) & F.coalesce("header", none)
    foot = (F.col("at") >= F.greatest(F.lit(0), F.col("size") - 2)) & F.coalesce("footer", none)
    return marked.where((F.col("compact") != "") & ~head & ~foot & ~is_noise(F.col("compact"))).select("doc_id", "page_number", "line_no", "line")


def normal_text(text: Column) -> Column:
    """Cleaned for embedding: composed, wrong encodings mended, hyphens and line ends joined, noise lines and symbols out.

    Every step's text is worked out once, and steps that need certain characters are left out where there are none.
    """

    def mended(t: Column) -> Column:
        out = t
        for old, new in MENDED:
            out = F.replace(out, F.lit(old), F.lit(new))
        return F.when(F.rlike(t, F.lit(MENDABLE)), out).otherwise(t)

    def joined(t: Column) -> Column:
        out = F.regexp_replace(t, r"([A-Za-z])-[ \t]*\n[ \t]*([A-Za-z])", "$1$2")
        return F.when(F.contains(t, F.lit("\n")), F.regexp_replace(out, r"(?<![.!?:;])\n(?!\n)", " ")).otherwise(t)

    def without_noise(t: Column) -> Column:
        kept = F.filter(F.split(F.regexp_replace(t, r"\n{3,}", "\n\n"), "\n"), lambda line: ~bound(flat_basic(line), is_noise))
        return F.when(F.contains(t, F.lit("\n")), F.array_join(kept, "\n")).when(bound(flat_basic(t), is_noise), "").otherwise(t)

    out = bound(bound(nfkc(text), mended), joined)
    out = F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"[ \t]+", " ")
    out = F.regexp_replace(bound(out, without_noise), SYMBOLS, " ")
    return collapsed(F.regexp_replace(out, r"(?U)\s+([,.;:!?])", "$1"))


def line_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block, element_type, lines, text: runs of paragraph or table lines, each heading and list item alone.

    Blank lines end a run. The kinds are those of the collapsed line.
    """
    rows = lines.withColumn("flat", collapsed(F.col("line")))
    kind = F.when(F.col("flat") == "", "blank").when(is_heading(F.col("flat")), "heading").when(is_list_item(F.col("flat")), "list_item").when(is_table_row(F.col("flat")), "table").otherwise("paragraph")
    order = W.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("kind", kind)
    starts = F.col("kind").isin("heading", "list_item") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("block", F.sum("starts").over(order))
    own = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "flat"))), lambda x: x["flat"])
    blocks = rows.where("kind <> 'blank'").groupBy("doc_id", "block", "kind").agg(F.count("*").alias("lines"), own.alias("parts"))
    glue = F.when(F.col("kind") == "table", F.array_join("parts", "\n")).otherwise(F.array_join("parts", " "))
    return blocks.select("doc_id", "block", F.col("kind").alias("element_type"), "lines", glue.alias("text"))


def kind_of(flat: Column) -> Column:
    """The kind of a line without white space beside single blanks."""
    return F.when(flat == "", "blank").when(_heading(flat), "heading").when(F.rlike(flat, F.lit(LIST_MARK)), "list_item").when(_row(flat), "table").otherwise("paragraph")


def blocks_of(lines: Column, made: Callable[[Column], Column] = collapsed) -> Column:
    """Array of struct (block, element_type, lines, text) of an array of lines, each ``made`` first: ``line_blocks`` inside of one row, without a shuffle.

    ``block`` counts from 1, the runs of blank lines too.
    """

    def cut(typed: Column) -> Column:
        begins = lambda x, i: (i == 0) | x["kind"].isin("heading", "list_item") | (x["kind"] != F.get(typed, i - 1)["kind"])
        starts = F.filter(F.transform(typed, lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
        return bound(F.concat(starts, F.array(F.size(typed))), lambda edges: slices(typed, edges))

    def slices(typed: Column, edges: Column) -> Column:
        own = lambda a, i: F.slice(typed, a + 1, F.get(edges, i + 1) - a)
        parts = F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), lambda a, i: F.struct((i + 1).cast("long").alias("block"), own(a, i).alias("own")))
        return F.transform(F.filter(parts, lambda p: p["own"][0]["kind"] != "blank"), block)

    def block(part: Column) -> Column:
        flats, kind = F.transform(part["own"], lambda x: x["flat"]), part["own"][0]["kind"]
        text = F.when(kind == "table", F.array_join(flats, "\n")).otherwise(F.array_join(flats, " "))
        return F.struct(part["block"].alias("block"), kind.alias("element_type"), F.size(flats).cast("long").alias("lines"), text.alias("text"))

    typed = F.transform(F.transform(lines, made), lambda flat: F.struct(flat.alias("flat"), kind_of(flat).alias("kind")))
    return bound(typed, cut)


def document_blocks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the columns of ``line_blocks`` for whole texts: each row's lines are folded where the row is."""
    return numbered_blocks(docs, keys).drop("block_index")


def numbered_blocks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The same with block_index, the block's number in its row from 0."""
    rows = docs.select(*keys, F.posexplode(blocks_of(F.split(text_of(F.col("text")), "\n"))).alias("block_index", "b"))
    return rows.select(*keys, F.col("block_index").cast("int"), "b.*")


def _indexed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with block_index, by order of block where they have none."""
    if "block_index" in blocks.columns:
        return blocks
    return blocks.withColumn("block_index", (F.row_number().over(W.partitionBy("doc_id").orderBy("block")) - 1).cast("int"))


def block_metadata(blocks: DataFrame, language: Column, audience: str = "both", source_type: str | None = None) -> DataFrame:
    """The blocks with their metadata; numbered before empty ones go."""
    rows = _indexed(blocks).withColumn("text", collapsed(F.col("text"))).where("text <> ''")
    return rows.select("doc_id", "block_index", "element_type", "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_file"), F.lit(source_type or "text").alias("source_type"), F.lit(audience).alias("audience"), language.alias("language"), F.lit("semantic_denoise_v1").alias("normalization_method"))


def stamped_blocks(blocks: DataFrame, *, source_file: str | None = None, source_type: str | None = None, subject: str | None = None, audience: str = "both", grades: tuple[int | None, int | None] = (None, None), language: str = "en") -> DataFrame:
    """``blocks`` (doc_id, block, text, and maybe source_file, source_type) with normal text and all metadata.

    Blocks are numbered before those without text go, unless they have a block_index, so numbers may be missing. A source that is named here overrides the
    block's own, an empty one does not; subject, audience, grades and language always do.
    """
    given = lambda name, value: F.lit(value) if value else F.col(name) if name in blocks.columns else F.lit(None).cast("string")
    rows = _indexed(blocks).withColumn("text", normal_text(F.col("text"))).where("text <> ''")
    stamps = {"source_file": given("source_file", source_file), "source_type": given("source_type", source_type), "subject": F.lit(subject).cast("string"), "audience": F.lit(audience)}
    stamps |= {"grade_min": F.lit(grades[0]).cast("int"), "grade_max": F.lit(grades[1]).cast("int"), "language": F.lit(language), "normalization_method": F.lit("semantic_denoise_v1")}
    return rows.select("doc_id", "block_index", "text", *[c.alias(n) for n, c in stamps.items()])
