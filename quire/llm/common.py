"""What the training-data operators share: tables, draws, components; written intermediate tables are the library's."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import discard, fresh_path, local_or_uri, materialise, shared_dir

__all__ = ["ASCII_LOWER", "connected_components", "discard", "draw", "free_shuffles", "fresh_path", "local_or_uri", "materialise", "shared_dir", "table", "text_bytes"]

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM finds their owners unreachable; iterative jobs ask for that."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(column: Column | str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def draw(rows: DataFrame, keys: list[str], expected: int, total: int) -> DataFrame:
    """About `expected` of `total` rows, by the hash of their keys: the same rows each time, whatever their order."""
    share = min(1.0, expected / max(1, total))
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(share * (1 << 40)))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Component of each node that has an edge: columns node, root (the smallest node reachable).

    Alternating large-star and small-star contraction: every round is two aggregations and two joins over at most
    the edges there are, so that neither a component nor a hub is ever gathered in one task. Hubs are split by
    adaptive skew joins. Empty edges give no rows; loops and null ends are ignored; repeated edges count once.
    """
    spark = edges.sparkSession
    ends = [F.col(a).alias("u"), F.col(b).alias("v")]
    now = materialise(
        edges.select(*ends)
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
        if not mark["n"]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u != v").distinct(), "edges")
        discard(now)
        now = after
        free_shuffles(spark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
