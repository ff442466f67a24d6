"""Chunk and evaluation files in, artifacts out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import local_or_uri

CHUNK = """id string, bookTitle string, chapterId string, chapterTitle string, chapterOrder int, kind string, sequence int,
    text string, sourcePath string, sourceRef string, characterSize int, blockCount int, headingPath array<string>,
    language string, hasFootnotes boolean, tokenEstimate int"""
EVAL_QUERY = "book string, query string, expectedChunks array<string>, topK int"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunks; fields that a line leaves out are null."""
    return spark.read.schema(CHUNK).json(path)


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of queries; topK is 5 where it isn't positive."""
    rows = spark.read.schema(EVAL_QUERY).option("multiLine", True).json(path)
    return rows.withColumn("topK", F.when(F.col("topK") > 0, F.col("topK")).otherwise(5))


def leave_out_empty(columns: dict[str, str]) -> list[Column]:
    """Columns with null for zero, false and empty values, which JSON then leaves out. columns: name and type."""
    empty = lambda c, t: F.size(c) == 0 if t.startswith("array") else ~F.col(c) if t == "boolean" else F.col(c) == ("" if t == "string" else 0)
    return [F.when(~empty(c, t), F.col(c)).alias(c) for c, t in columns.items()]


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """book, sequence, line: each chunk as a JSON object without its empty fields."""
    names = [c.split()[0] for c in CHUNK.replace("\n", " ").split(",")]
    kinds = {n: t for n, t in chunks.dtypes if n in names}
    always = {"id", "text", "sequence", "kind", "chapterId", "characterSize"}
    shown = [F.col(n) if n in always else leave_out_empty({n: kinds[n]})[0] for n in names]
    return chunks.select("book", "sequence", F.to_json(F.struct(*shown)).alias("line"))


def write_files(files: DataFrame, path: str) -> int:
    """Writes each row (name, content) as a file under path, from the tasks; how many there are.

    A file is written under a name of its own and then moved, so a task that runs again or is lost leaves no half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = local_or_uri(f"{path}/{name}")
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(content.encode())
                fs.move(part, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def indented(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def indent_json(column: Column) -> Column:
    """JSON text with an indent of two spaces."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(indented)

    return of(column)


def write_json_array(rows: DataFrame, path: str) -> None:
    """One indented JSON array of the rows in their order, written as they come: the driver holds a partition at a time."""
    fs, at = local_or_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(b"[")
        for k, row in enumerate(rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            f.write(((",\n" if k else "\n") + "  " + indented(row["j"]).replace("\n", "\n  ")).encode())
        f.write(b"\n]")
