"""New archives as they arrive, and what each one becomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.chunk import Sizes
from quire.plans.convert import convert_library
from quire.sources import epub, files

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, path: str, pattern: str = "*.epub", at_once: int = 100) -> DataFrame:
    """A stream of archive files, at most `at_once` a batch."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(path)


def convert_arrivals(spark: SparkSession, path: str, output: str, checkpoint: str, sizes: Sizes = Sizes(), available_now: bool = True) -> StreamingQuery:
    """Appends the chunks of new archives to `output`, a folder a batch, so that a batch that runs again overwrites its own.

    A book is whole in its batch, so no state is kept between batches and there is nothing to wait for.
    """

    def batch(frame: DataFrame, number: int) -> None:
        made = convert_library(epub.library_of(epub.packages(frame)), sizes)
        files.chunk_lines(made.chunks).select("book", "sequence", "line").write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream = arrivals(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
