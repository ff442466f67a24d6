"""BM25 retrieval inside books, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

K1, B = 1.2, 0.75
#: Scores that agree to so many digits are ties.
TIE_DIGITS = 9
#: Gains are multiples of 1 / GRAIN, so that sums below 512 are exact in any order.
GRAIN = float(1 << 44)
SHARD_CHARS = 8_000_000


def document_frequencies(chunks: DataFrame, text: str = "text") -> DataFrame:
    """book, term, df: in how many chunks of the book a term occurs."""
    return chunks.select("book", F.explode(F.array_distinct(T.tokenize(F.col(text)))).alias("term")).groupBy("book", "term").agg(F.count("*").alias("df"))


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score: the k best chunks (book, id, text) of each query's book (query_id, book, query).

    Ties, to TIE_DIGITS digits, go to the smaller id; gains are rounded to 44 binary places, so that copies score alike in
    whatever order they are summed. Chunks that share no term with the query score zero and follow. A query without terms has
    no rows. Chunks are tokenised once and only terms that some query asks for leave that stage; zero scores are filled from each book's
    k smallest ids rather than by pairing every query with every chunk.
    """
    asked = queries.select("query_id", "book", F.explode(T.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "book", "term").agg(F.count("*").alias("times"))
    terms = asked.select("book", "term").distinct()
    read = chunks.select("book", "id", T.tokenize(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))
    lengths = read.groupBy("book").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).select("book", "n", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("avgdl"))
    postings = read.select("book", "id", "dl", F.explode("terms").alias("term")).join(terms, ["book", "term"], "left_semi").groupBy("book", "term", "id", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("book", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = asked.join(df, ["book", "term"]).join(lengths, "book").select("query_id", "book", "term", "avgdl", (idf * F.col("times")).alias("w"))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = weighted.join(postings, ["book", "term"]).groupBy("query_id", "id").agg((F.sum(F.rint(F.col("w") * gain * GRAIN)) / GRAIN).alias("score"))
    first = chunks.select("book", "id").withColumn("r", F.row_number().over(Window.partitionBy("book").orderBy("id"))).where(F.col("r") <= k)
    filled = asked.select("query_id", "book").distinct().join(first, "book").select("query_id", "id", F.lit(0.0).alias("score"))
    best = hits.unionByName(filled).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", TIE_DIGITS).desc(), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """queries, hits, recall: of the queries with expected chunks (query_id, expected), those of which one was retrieved."""
    got = retrieved.groupBy("query_id").agg(F.collect_list("id").alias("got"))
    hit = F.coalesce(F.arrays_overlap("got", "expected"), F.lit(False))
    judged = expected.where(F.size("expected") > 0).join(got, "query_id", "left").select(hit.cast("int").alias("hit"))
    return judged.agg(F.count("*").alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.avg(F.col("hit").cast("double")).alias("recall"))


def containing(rows: DataFrame, passages: DataFrame, text: str, passage_id: str, passage: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """rows (without text) joined with the passage_id of each passage that their text holds word for word.

    Passages are looked for all at once by an Aho-Corasick automaton of at most shard_chars characters, which is what is
    broadcast; further passages make further automata, each run over all rows. Empty and null passages are left out.
    """
    import ahocorasick

    spark, kept = rows.sparkSession, [c for c in rows.columns if c != text]
    base = rows.select(F.struct(*kept).alias("x"), F.coalesce(text, F.lit("")).alias("t"))
    kind, out = passages.schema[passage_id].dataType.simpleString(), None

    def shards() -> Iterator[dict]:
        held: dict[str, list] = {}
        size = 0
        for r in passages.select(F.col(passage_id).alias("i"), F.col(passage).alias("p")).where("p != ''").toLocalIterator():
            if size and size + len(r["p"]) > shard_chars:
                yield held
                held, size = {}, 0
            held.setdefault(r["p"], []).append(r["i"])
            size += len(r["p"])
        yield held

    def search(shard: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for p, ids in shared.value.items():
                machine.add_word(p, ids)
            machine.make_automaton()
            for batch in batches:
                ids = [sorted({i for _, found in machine.iter(t.as_py()) for i in found}) if len(machine) else [] for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.from_numpy_dtype("int64") if kind == "bigint" else pa.string()))], ["x", "ids"])

        found = base.mapInArrow(run, f"x {base.schema['x'].dataType.simpleString()}, ids array<{kind}>")
        return found.select("x.*", F.explode("ids").alias(passage_id))

    for shard in shards():
        part = search(shard)
        out = part if out is None else out.unionByName(part)
    return out
