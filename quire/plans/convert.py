"""Archives to chapters, Markdown, chunks and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks, chunk, diagnostics, render
from quire.plans import artifacts
from quire.sources import epub, files
from quire.sources.shared import fresh_path


@dataclass
class Conversion:
    """What a conversion makes; every table has the column book."""

    books: DataFrame
    chapters: DataFrame
    chunks: DataFrame
    sizes: chunk.Sizes
    back_matter: bool = False
    broken: DataFrame | None = None  # book and error of the archives that could not be read

    @property
    def stats(self) -> DataFrame:
        return diagnostics.book_stats(self.books, self.chapters, self.chunks)

    @property
    def toc(self) -> DataFrame:
        return self.chapters.select("book", "id", "title", "kind", F.col("classify_reason").alias("classifyReason"), "order", F.col("source_ref").alias("source"))

    @property
    def markdown(self) -> DataFrame:
        return render.render_books(self.books, self.chapters)

    @property
    def chapter_markdown(self) -> DataFrame:
        return render.render_chapters(self.chapters)

    @property
    def debug_markdown(self) -> DataFrame:
        return render.render_debug(self.books, self.chapters, diagnostics.book_stats(self.books, self.chapters))

    @property
    def summary(self) -> DataFrame:
        return diagnostics.summary(self.books, self.chapters, self.chunks, self.sizes)

    @property
    def chapter_diagnostics(self) -> DataFrame:
        return diagnostics.chapter_diagnostics(self.chapters, self.chunks, self.sizes)

    @property
    def chunk_diagnostics(self) -> DataFrame:
        return diagnostics.chunk_diagnostics(self.chunks, self.sizes)

    @property
    def snapshot(self) -> DataFrame:
        return diagnostics.regression_snapshot(self.books, self.chapters, self.chunks)

    def written(self, path: str | None = None) -> Conversion:
        """The same with its tables written under path (by default in the shared folder) and read from there."""
        spark, made = self.books.sparkSession, {}
        path = path or fresh_path(spark, "conversion")
        for name in ("books", "chapters"):
            getattr(self, name).write.parquet(f"{path}/{name}")
            made[name] = spark.read.parquet(f"{path}/{name}")
        chunks = chunk.build_chunks(made["books"], made["chapters"], self.sizes, self.back_matter)
        chunks.write.parquet(f"{path}/chunks")
        return Conversion(made["books"], made["chapters"], spark.read.parquet(f"{path}/chunks"), self.sizes, self.back_matter, self.broken)

    def artifacts(self) -> DataFrame:
        """book, name, content: every file of every book, by the names under which `write` puts them.

        A book is `<base>.md` and the folder `<base>` with debug.md, chapters/<id>.md, metadata.json, toc.json, stats.json,
        diagnostics.json and chunks.jsonl. base is the archive's name without its extension; of equal ones, those after
        the first in the order of their paths get a number.
        """
        plain = T.output_name(F.col("source_path"), "")
        nth = F.row_number().over(Window.partitionBy("base").orderBy("book"))
        bases = self.books.select("book", plain.alias("base")).withColumn("nth", nth)
        bases = bases.select("book", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), "nth")).alias("base"))
        lines = files.chunk_lines(self.chunks).groupBy("book").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))).alias("lines"))
        of = lambda rows, name, content: rows.select("book", name.alias("file"), content.alias("content"))
        parts = [
            of(self.markdown, F.lit(".md"), F.col("markdown")),
            of(self.debug_markdown, F.lit("/debug.md"), F.col("markdown")),
            of(self.chapter_markdown, F.concat(F.lit("/chapters/"), T.safe_name(F.col("id")), F.lit(".md")), F.col("markdown")),
            of(lines, F.lit("/chunks.jsonl"), F.array_join("lines", "")),
            *[of(rows, F.lit(f"/{name}.json"), files.indent_json(F.col("json"))) for name, rows in artifacts.json_documents(self).items()],
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.join(bases, "book").select("book", F.concat("base", "file").alias("name"), "content")

    def write(self, path: str) -> int:
        """All artifacts under path, written from the tasks; how many. Chapters and chunks are made once."""
        return files.write_files(self.written().artifacts(), path)

    def write_snapshot(self, path: str) -> None:
        """The regression snapshot of all books as one JSON array, by file name."""
        files.write_json_array(artifacts.snapshot_records(self.snapshot).orderBy("fileName"), path)


def convert(spark: SparkSession, path: str, sizes: chunk.Sizes = chunk.Sizes(), back_matter: bool = False) -> Conversion:
    """Converts the archives under path (or one archive)."""
    return convert_library(epub.read_library(spark, path), sizes, back_matter)


def convert_library(library: epub.Library, sizes: chunk.Sizes = chunk.Sizes(), back_matter: bool = False) -> Conversion:
    chapters = blocks.normalize_chapters(library.chapters)
    return Conversion(library.books, chapters, chunk.build_chunks(library.books, chapters, sizes, back_matter), sizes, back_matter, library.broken)
