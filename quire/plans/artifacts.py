"""A conversion's JSON documents, with the field names of the artifact files."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.files import leave_out_empty

if TYPE_CHECKING:
    from quire.plans.convert import Conversion

# Fields of the artifact files in their order, with the columns they come from. A ? marks fields that are left
# out where they are empty.
METADATA = "title authors? language? publisher? publishedDate?=published_date identifier? sourcePath=source_path sourceSha256=source_sha256"
TOC = "id title kind classifyReason? order source"
STATS = "chapterCount=chapter_count frontMatterCount=front_matter_count backMatterCount=back_matter_count chunkCount=chunk_count footnoteCount=footnote_count"
SUMMARY = f"""pipelineVersion=version generatedAt=generated_at sourcePath=source_path sourceSha256=source_sha256 title {STATS}
    tocResidualBlocksRemoved=toc_residual_blocks_removed crossFileFootnotesLinked=cross_file_footnotes_linked shortChunkCount=short_chunks
    oversizeChunkCount=oversize_chunks minChunkCharacters=min_characters averageChunkCharacters=average_characters
    p50ChunkCharacters=p50_characters p90ChunkCharacters=p90_characters maxChunkCharacters=max_characters"""
CHAPTERS = """id title order kind classifyReason?=classify_reason sourceRef=source_ref blockCount=block_count footnoteCount=footnote_count
    chunkCount=chunk_count shortChunkCount?=short_chunks oversizeChunkCount?=oversize_chunks minChunkCharacters?=min_characters
    averageChunkCharacters?=average_characters maxChunkCharacters?=max_characters tocResidualBlocksRemoved?=toc_trimmed
    crossFileFootnotesLinked?=cross_file_notes warnings?"""
CHUNKS = "id chapterId chapterTitle chapterOrder kind sequence characterSize blockCount? headingPath? hasFootnotes? tokenEstimate? warnings?"
SNAPSHOT = "fileName string, stats struct<chapterCount:int,frontMatterCount:int,backMatterCount:int,chunkCount:int,footnoteCount:int>, chapterTitles array<string>, chunkFingerprints array<string>, chunkCharacterStats array<long>"


def fields(rows: DataFrame, shape: str) -> Column:
    """A struct of the fields that a shape names."""
    kinds, out = dict(rows.dtypes), []
    for field in shape.split():
        name, _, column = field.partition("=")
        column = column or name.rstrip("?")
        value = leave_out_empty({column: kinds[column]})[0] if name.endswith("?") else F.col(column)
        out.append(value.alias(name.rstrip("?")))
    return F.struct(*out)


def _listed(rows: DataFrame, shape: str, name: str, *order: Column) -> DataFrame:
    """book and an array of a book's rows in order."""
    gathered = rows.select("book", F.struct(*order).alias("at"), fields(rows, shape).alias("x")).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("l"))
    return gathered.select("book", F.transform("l", lambda r: r["x"]).alias(name))


def json_documents(made: Conversion) -> dict[str, DataFrame]:
    """book and json, by the document's name. The contents list has the main chapters first, then the others."""
    back, order = (F.col("kind") != "main").alias("back"), F.col("order")
    toc = _listed(made.toc, TOC, "toc", back, order)
    summary = made.summary.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    chapters = _listed(made.chapter_diagnostics, CHAPTERS, "chapters", back, order)
    chunks = _listed(made.chunk_diagnostics, CHUNKS, "chunks", F.col("sequence"))
    told = summary.select("book", fields(summary, SUMMARY).alias("summary")).join(chapters, "book", "left").join(chunks, "book", "left")
    none = F.from_json(F.lit("[]"), chapters.schema["chapters"].dataType)
    return {
        "metadata": made.books.select("book", F.to_json(fields(made.books, METADATA)).alias("json")),
        "toc": made.books.select("book").join(toc, "book", "left").select("book", F.coalesce(F.to_json("toc"), F.lit("[]")).alias("json")),
        "stats": made.stats.select("book", F.to_json(fields(made.stats, STATS)).alias("json")),
        "diagnostics": told.select("book", F.to_json(F.struct("summary", F.coalesce("chapters", none).alias("chapters"), "chunks")).alias("json")),
    }


def snapshot_records(snapshot: DataFrame) -> DataFrame:
    """The regression snapshot under the field names of its file; a row a book."""
    return snapshot.select(F.col("file_name").alias("fileName"), fields(snapshot, STATS).alias("stats"), F.col("chapter_titles").alias("chapterTitles"), F.col("fingerprints").alias("chunkFingerprints"), F.col("five_numbers").alias("chunkCharacterStats"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)


def snapshot_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """fileName, old, new: the books of which the two snapshots' records differ, null where one has none."""
    whole = lambda rows, name: rows.select("fileName", F.struct("stats", "chapterTitles", "chunkFingerprints", "chunkCharacterStats").alias(name))
    pairs = whole(old, "old").join(whole(new, "new"), "fileName", "full")
    return pairs.where(~F.to_json("old").eqNullSafe(F.to_json("new")))
