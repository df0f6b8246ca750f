"""Numbering of chunks, run manifests, lecture notes, pagination, and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIXES = (".pdf", ".pptx", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """The chunks with id chunk-1, chunk-2 ... in order of doc_id, block, chunk.

    A document's chunks are numbered in it, the documents' counts are summed by ranges of doc_id, and the ranges' by one
    short list; so no task orders all chunks.
    """
    own = chunks.withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy("block_index", "chunk_index")))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("stretch", F.shiftright(F.col("doc_id").cast("long"), 12))
    stretches = counts.groupBy("stretch").agg(F.sum("n").alias("all"))
    before = stretches.withColumn("base", F.sum("all").over(W.orderBy("stretch")) - F.col("all")).select("stretch", "base")
    inner = counts.withColumn("inner", F.sum("n").over(W.partitionBy("stretch").orderBy("doc_id")) - F.col("n"))
    starts = inner.join(before, "stretch").select("doc_id", (F.col("base") + F.col("inner")).alias("start"))
    return own.join(starts, "doc_id").select(F.concat(F.lit("chunk-"), (F.col("start") + F.col("at")).cast("string")).alias("id"), *chunks.columns)


def file_results(chunks: DataFrame, files: DataFrame, valid: Column) -> DataFrame:
    """file, chunk_count, valid_count, error of each file; one without chunks has failed."""
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("c"), F.count_if(valid).alias("v"))
    joined = files.select("doc_id").join(made, "doc_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", F.coalesce("c", zero).alias("chunk_count"), F.coalesce("v", zero).alias("valid_count"), F.when(F.col("c").isNull(), F.lit("no text")).alias("error"))


def manifest(results: DataFrame, provider: str = "local") -> DataFrame:
    """One row on a run. The list of files itself is ``file_results``: it grows with the input."""
    return results.agg(
        F.count("*").alias("files_discovered"),
        F.count_if(F.col("error").isNull()).alias("files_succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("files_failed"),
        F.sum("chunk_count").cast("long").alias("chunks_total"),
        F.sum("valid_count").cast("long").alias("chunks_valid"),
        F.lit(provider).alias("embedding_provider"),
    )


def lecture_notes(chunks: DataFrame, most: int = 6) -> DataFrame:
    """For each lesson the first texts of its chunks; a lesson is named by lesson, title or file."""
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("lesson", "lesson_title", "source_file") if c in chunks.columns]
    rows = chunks.withColumn("lesson_key", F.coalesce(*named, F.lit("default")))
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("lesson_key").orderBy("doc_id", "block_index", "chunk_index"))).where(F.col("rn") <= most)
    own = F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"])
    return first.groupBy("lesson_key").agg(F.count("*").alias("chunks"), F.array_join(own, "\n\n").alias("notes"))


def paginate(texts: DataFrame, width: int = 90, lines: int = 50) -> DataFrame:
    """doc_id, page, line_no, line: texts wrapped between words at ``width`` characters, ``lines`` to a page."""
    flat = F.regexp_replace(F.col("text"), rf"([^\n]{{1,{width}}})(?:[ \t]*\n|[ \t]+|$)|([^\n]{{{width}}})", "$1$2\n")
    rows = texts.select("doc_id", F.posexplode(F.split(F.regexp_replace(flat, r"\n+$", ""), "\n")).alias("line_no", "line"))
    return rows.select("doc_id", (F.floor(F.col("line_no") / lines) + 1).cast("int").alias("page"), F.col("line_no").cast("int"), "line")


def suffix_of(path: Column) -> Column:
    """The suffix of a path's last part in lower case, with its dot; empty if there is none."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def reader_of(path: Column) -> Column:
    """Which reader takes a file: pdf, pptx or image; null for files that none takes."""
    suffix = suffix_of(path)
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".pptx", "pptx").when(suffix.isin(*SUFFIXES), "image")


def supported(files: DataFrame) -> DataFrame:
    """The files (path and others) that have a reader, with suffix and reader."""
    return files.withColumns({"suffix": suffix_of(F.col("path")), "reader": reader_of(F.col("path"))}).where("reader is not null")


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime, suffix and reader of the supported files under a folder, by path; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return supported(files.select("path", "length", "modificationTime")).orderBy("path")


def resolved(path: Column) -> Column:
    """A path without . and .. parts; a .. with nothing before it stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != ".") & (p != ""))

    def step(kept: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(kept) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), kept), -1) != "..")
        return F.when(back, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    inner = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(inner, "/"))


def inside(path: Column, folders: list[str]) -> Column:
    """Whether a path, resolved, lies under one of the ``folders`` (without . and .. parts)."""
    clean, out = resolved(path), F.lit(False)
    for folder in folders:
        out = out | F.startswith(clean, F.lit(folder.rstrip("/") + "/"))
    return out


def downloads(files: DataFrame, folders: list[str]) -> DataFrame:
    """path, name and size_mb of the PDF files among ``files`` (path, length) that lie under one of the ``folders``."""
    own = files.where(inside(F.col("path"), folders) & (suffix_of(F.col("path")) == ".pdf"))
    return own.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.format_string("%.2f MB", F.col("length") / (1024 * 1024)).alias("size_mb"))


def file_listing(files: DataFrame) -> DataFrame:
    """name and size_mb of files, for a list of downloads."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.format_string("%.2f MB", F.col("length") / (1024 * 1024)).alias("size_mb")).orderBy("name")


def ai_pages(responses: DataFrame) -> DataFrame:
    """The fields of a model's JSON about each page; what isn't JSON becomes a summary of its first 200 characters."""
    parsed = F.from_json("response", "summary string, key_topics string, content_type string", {"mode": "PERMISSIVE"})
    bad = F.get_json_object("response", "$.summary").isNull()
    return responses.select(
        "page_id",
        F.when(bad, F.substring("response", 1, 200)).otherwise(parsed["summary"]).alias("summary"),
        F.when(bad, "parsing_error").otherwise(parsed["key_topics"]).alias("key_topics"),
        F.when(bad, "unknown").otherwise(parsed["content_type"]).alias("content_type"),
    )
