"""Counts and size statistics of books, chapters and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.chunk import Sizes

VERSION = "v0.4"


def book_stats(books: DataFrame, chapters: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """A row a book: its main, front and back chapters, notes and chunks; zeros where there are none."""
    counted = chapters.groupBy("book").agg(
        F.count_if(F.col("kind") == "main").alias("chapter_count"),
        F.count_if(F.col("kind") == "frontmatter").alias("front_matter_count"),
        F.count_if(F.col("kind") == "backmatter").alias("back_matter_count"),
        F.sum(F.size("footnotes")).alias("footnote_count"),
    )
    out = books.select("book").join(counted, "book", "left")
    names = ["chapter_count", "front_matter_count", "back_matter_count", "footnote_count", "chunk_count"]
    out = out.join(chunks.groupBy("book").agg(F.count("*").alias("chunk_count")), "book", "left") if chunks is not None else out.withColumn("chunk_count", F.lit(0))
    return out.select("book", *[F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in names])


def size_summary(chunks: DataFrame, group: list[str], sizes: Sizes = Sizes(), size: str = "characterSize", percentiles: tuple[int, ...] = (50, 90)) -> DataFrame:
    """Counts and statistics of chunk sizes by group.

    Percentiles are members at floor((n - 1) p / 100), found from a histogram of sizes: sizes are small integers, so a
    group takes as many histogram rows as it has different sizes, not as many as it has chunks.
    """
    sizes = sizes.settled()
    histogram = chunks.groupBy(*group, F.col(size).cast("long").alias("v")).agg(F.count("*").alias("n"))
    summary = histogram.groupBy(*group).agg(
        F.sum("n").alias("chunk_count"),
        F.sum(F.col("v") * F.col("n")).alias("total_characters"),
        F.min("v").alias("min_characters"),
        F.max("v").alias("max_characters"),
        F.sum(F.when(F.col("v") < sizes.least, F.col("n")).otherwise(0)).alias("short_chunks"),
        F.sum(F.when(F.col("v") > sizes.most, F.col("n")).otherwise(0)).alias("oversize_chunks"),
        F.sort_array(F.collect_list(F.struct("v", "n"))).alias("bins"),
    )
    average = F.floor(F.col("total_characters") / F.col("chunk_count"))
    return summary.withColumns({"average_characters": average, **{f"p{p}_characters": percentile_of_bins(F.col("bins"), F.col("chunk_count"), p) for p in percentiles}}).drop("bins")


def percentile_of_bins(bins: Column, n: Column, p: int) -> Column:
    """The value at floor((n - 1) p / 100) of values counted in ascending bins (v, n)."""
    at = F.floor((n - 1) * max(0, min(100, p)) / 100).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))

    def step(acc: Column, b: Column) -> Column:
        seen = acc["seen"] + b["n"]
        return F.struct(seen.alias("seen"), F.when(acc["v"].isNull() & (seen > at), b["v"]).otherwise(acc["v"]).alias("v"))

    return F.coalesce(F.aggregate(bins, start, step, lambda acc: acc["v"]), F.lit(0).cast("long"))


def chunk_diagnostics(chunks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """chunks with their warnings."""
    sizes = sizes.settled()
    warnings = F.array_compact(
        F.array(
            F.when(F.col("characterSize") < sizes.least, "chunk:short"),
            F.when(F.col("characterSize") > sizes.most, "chunk:oversize"),
            F.when(F.col("blockCount") == 0, "chunk:no_blocks"),
        )
    )
    return chunks.drop("text").withColumn("warnings", warnings)


def chapter_diagnostics(chapters: DataFrame, chunks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """A row a chapter: its blocks and notes, its chunks' statistics (zeros without chunks) and its warnings."""
    of = size_summary(chunks, ["book", "chapterId"], sizes, percentiles=()).withColumnRenamed("chapterId", "id")
    numbers = ["chunk_count", "min_characters", "max_characters", "average_characters", "short_chunks", "oversize_chunks"]
    out = chapters.join(of.select("book", "id", *numbers), ["book", "id"], "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("int") for n in numbers})
    more = F.array_compact(
        F.array(
            F.when((F.col("kind") == "main") & (F.size("blocks") > 0) & (F.col("chunk_count") == 0), "chunk:no_output"),
            F.when(F.col("short_chunks") > 0, "chunk:short_segments"),
            F.when(F.col("oversize_chunks") > 0, "chunk:oversize_segments"),
        )
    )
    return out.select("book", "id", "title", "order", "kind", "classify_reason", "source_ref", F.size("blocks").alias("block_count"), F.size("footnotes").alias("footnote_count"), "toc_trimmed", "cross_file_notes", *numbers, F.concat("warnings", more).alias("warnings"))


def summary(books: DataFrame, chapters: DataFrame, chunks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """A row a book: source, counts and size statistics of all its chunks."""
    trims = chapters.groupBy("book").agg(F.sum("toc_trimmed").alias("toc_residual_blocks_removed"), F.sum("cross_file_notes").alias("cross_file_footnotes_linked"))
    out = books.select("book", F.lit(VERSION).alias("version"), "source_path", "source_sha256", "title").join(book_stats(books, chapters, chunks), "book").join(trims, "book", "left")
    sized = size_summary(chunks, ["book"], sizes).drop("chunk_count", "total_characters")
    out = out.join(sized, "book", "left")
    texts = {"book", "version", "source_path", "source_sha256", "title"}
    return out.select(*[F.col(c) if c in texts else F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in out.columns])


def five_numbers(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum by group, as members of the values."""
    return size_summary(values, group, size=value, percentiles=(25, 50, 75)).select(*group, F.array("min_characters", "p25_characters", "p50_characters", "p75_characters", "max_characters").alias("five_numbers"))


def even_sample(rows: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows at i (n - 1) / (limit - 1), rounded down, of each group in order; all rows of a group of up to `limit`, one for a limit of 1."""
    from pyspark.sql import Window

    of = Window.partitionBy(*group)
    ranked = rows.withColumns({"__at": F.row_number().over(of.orderBy(*order)) - 1, "__n": F.count("*").over(of)})
    at, n = F.col("__at").cast("long"), F.col("__n").cast("long")
    steps = max(1, limit - 1)
    # i is the smallest index that reaches this place; the place is taken if i's own place is it
    i = F.ceil(at * steps / F.greatest(n - 1, F.lit(1))).cast("long")
    taken = (n <= limit) | ((i < limit) & (F.floor(i * (n - 1) / steps) == at))
    return ranked.where(taken).drop("__at", "__n")


def book_fingerprints(chunks: DataFrame, limit: int = 10, size: int = 100) -> DataFrame:
    """book, fingerprints: the beginnings of up to `limit` chunks spread evenly over the book."""
    taken = even_sample(chunks.select("book", "sequence", "text"), ["book"], ["sequence"], limit)
    return taken.groupBy("book").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", T.fingerprint(F.col("text"), size).alias("f")))), lambda x: x["f"]).alias("fingerprints"))


def regression_snapshot(books: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """A record a book: file name, stats, chapter titles, chunk fingerprints and the five numbers of chunk sizes."""
    titles = chapters.groupBy("book").agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("kind") != "main").alias("back"), "order", "title"))), lambda x: x["title"]).alias("chapter_titles"))
    out = books.select("book", F.regexp_extract("source_path", r"([^/]*)\z", 1).alias("file_name")).join(book_stats(books, chapters, chunks), "book")
    return out.join(titles, "book", "left").join(book_fingerprints(chunks), "book", "left").join(five_numbers(chunks, ["book"], "characterSize"), "book", "left")
