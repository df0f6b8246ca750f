"""Chunks and vectors as JSON lines, and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "id string, text string, metadata map<string,string>"
VECTOR = "id string, embedding array<double>, metadata map<string,string>"


#: Other characters than ASCII are written as \\u and their code.
ASCII = {"writeNonAsciiCharacterAsCodePoint": "true"}


def json_lines(rows: DataFrame) -> DataFrame:
    """line: each row as one line of JSON in ASCII; what is null is left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), ASCII).alias("line"))


def parsed_lines(lines: DataFrame, schema: str = CHUNK) -> DataFrame:
    """The rows that lines of JSON hold."""
    return lines.select(F.from_json("line", schema).alias("row")).select("row.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line in ASCII, in as many files as there are tasks."""
    json_lines(rows).write.mode("errorifexists").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR).json(path)


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors, by id and not by line number."""
    return chunks.join(vectors.select("id", "embedding"), "id")


def compare_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The per-file results of several runs, side by side."""
    runs = spark.read.option("multiLine", True).json(paths).withColumn("run", F.input_file_name())
    return runs.select("run", F.explode("file_results").alias("f")).select("run", "f.*")


def side_by_side(results: DataFrame) -> DataFrame:
    """The file results (run, doc_id, chunk_count, valid_count, error) of several runs, each with its run's totals."""
    totals = results.groupBy("run").agg(F.count("*").alias("files_discovered"), F.count_if(F.col("error").isNull()).alias("files_succeeded"), F.sum("valid_count").alias("chunks_valid"))
    return results.join(totals, "run").select("run", "files_discovered", "files_succeeded", "chunks_valid", "doc_id", "chunk_count", "valid_count")
