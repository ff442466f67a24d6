"""Approximate nearest neighbours by cosine: an NN-descent graph, and greedy search of the graph for queries.

Nodes are the different vectors; equal vectors share a node that keeps the smallest ids, as many as an answer can
need. A few random-hyperplane trees, fitted on a bounded sample, put every node into one small leaf a tree; the best
partners inside a leaf start the graph, at any size of the table. A round of NN-descent then joins each node's neighbours
with one another: a group around node g holds the nodes on either end of g's edges, and every member keeps what it finds
there that is nearer than its worst neighbour. Pairs that met around g before are not taken again. Rounds end when they
bring next to nothing. A node that many lists name has its group dealt into blocks, each with all of the
node's own neighbours, so that a neighbour's neighbour is always met while no group is large.

A query starts from its own node's neighbours and repeatedly expands what is best in its beam and not yet expanded. The
last scores are exact, in double precision, on the original vectors.

Everything that travels is a node's normalised vector in half precision, ids, or scores; nothing is gathered on the
driver but the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, draw, free_shuffles, materialise

SAMPLE = 20_000
GROUP = 256
LEAF, TREES, ROUNDS = 128, 2, 12
GAIN = 0.002
BROADCAST_BYTES = 32 << 20
#: A node, its neighbours, their similarities, and whether each is fresh: not yet met by the node's other neighbours.
LISTS = "u long, vs binary, ss binary, fs binary"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _lists(u: np.ndarray, vs: list[np.ndarray], ss: list[np.ndarray], fs: list[np.ndarray] | None = None) -> pa.RecordBatch:
    fresh = [b"\x01" * len(v) for v in vs] if fs is None else [f.astype(np.uint8).tobytes() for f in fs]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([v.astype("<i8").tobytes() for v in vs], pa.binary()), pa.array([s.astype("<f4").tobytes() for s in ss], pa.binary()), pa.array(fresh, pa.binary())], ["u", "vs", "ss", "fs"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """Runs of rows with equal leading keys from sorted batches; a run of over `limit` rows comes in several pieces."""
    left: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        left = table if left is None else pa.concat_tables([left, table]).combine_chunks()
        if not left.num_rows:
            continue
        cols = [left.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        bounds = [0, *change.tolist()]
        ends = bounds[1:]
        start = bounds[-1]
        for s, e in zip(bounds, ends, strict=False):
            for x in range(s, e, limit):
                yield left.slice(x, min(limit, e - x))
        while left.num_rows - start >= limit:
            yield left.slice(start, limit)
            start += limit
        left = left.slice(start)
    if left is not None and left.num_rows:
        yield left


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, copies: int) -> DataFrame:
    """node, ids (the smallest `copies` of its rows), v (doubles), h (normalised, half precision)."""
    v = F.col(vec_col).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.withColumn("nth", nth).where(F.col("nth") <= copies).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = []
            for x in batch.column(2):
                a = np.asarray(x.as_py(), np.float64)
                a = a / np.abs(a).max()
                hs.append((a / np.sqrt(a @ a)).astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hs, pa.binary())], ["node", "ids", "v", "h"])

    return classes.select(F.col("ids")[0].alias("node"), "ids", "v").mapInArrow(run, "node long, ids array<long>, v array<double>, h binary")


def _plant(sample: np.ndarray, total: int, leaf: int, seed: int) -> list[tuple[np.ndarray, float, int, int]]:
    """A tree as (normal, cut, left, right); children below 0 are leaves."""
    rng, tree, leaves = np.random.default_rng(seed), [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) * total / max(1, len(sample)) > leaf and len(rows) >= 8:
            for _ in range(4):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                side = sample[rows] @ (a - b)
                cut = float(np.median(side))
                low = side < cut
                if 0 < low.sum() < len(rows):
                    at = len(tree)
                    tree.append(None)
                    tree[at] = (a - b, cut, grow(rows[low]), grow(rows[~low]))
                    return at
        leaves += 1
        return -leaves

    root = grow(np.arange(len(sample)))
    return tree if root == 0 else []


def _descend(tree: list, h: np.ndarray) -> np.ndarray:
    out, todo = np.full(len(h), -1, np.int64), [(0, np.arange(len(h)))] if tree else []
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = at
        elif len(rows):
            normal, cut, low, high = tree[at]
            side = h[rows] @ normal < cut
            todo += [(low, rows[side]), (high, rows[~side])]
    return out


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


def _leaf_lists(nodes: DataFrame, total: int, degree: int, leaf: int, trees: int) -> DataFrame:
    spark = nodes.sparkSession
    drawn = draw(nodes, ["node"], SAMPLE, total).orderBy("node").select("h").toArrow()
    sample = _matrix(drawn["h"].combine_chunks(), "<f2").astype(np.float32) if drawn.num_rows else np.zeros((0, 1), np.float32)
    planted = [_plant(sample, total, leaf, 17 + t) for t in range(trees if total > leaf else 1)]
    forest = spark.sparkContext.broadcast(planted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = _matrix(batch.column(1), "<f2").astype(np.float32)
                for t, tree in enumerate(forest.value):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), t, np.int32)), pa.array(_descend(tree, h)), *batch.columns], ["tree", "leaf", "node", "h"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2, 2 * leaf):
            ids, h = run.column(2).to_numpy(), _matrix(run.column(3).combine_chunks(), "<f2").astype(np.float32)
            for x in range(0, len(ids), 512):
                sims = h[x : x + 512] @ h.T
                sims[np.arange(len(sims)), np.arange(x, x + len(sims))] = -9
                best = _top(sims, min(degree, len(ids)))
                ss = np.take_along_axis(sims, best, 1)
                keep = ss > -9
                yield _lists(ids[x : x + 512], [ids[b[k]] for b, k in zip(best, keep, strict=True)], [s[k] for s, k in zip(ss, keep, strict=True)])

    placed = nodes.select("node", "h").mapInArrow(place, "tree int, leaf long, node long, h binary")
    return placed.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "node").mapInArrow(join, LISTS)


def _merge(lists: DataFrame, degree: int) -> DataFrame:
    """One list a node: the `degree` nearest of all its lists. A neighbour that any list has as not fresh isn't fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, held = None, []

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            vs, ss, fs = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((fs, vs))
            order = order[np.append(True, vs[order][1:] != vs[order][:-1])] if len(order) else order
            order = order[np.argsort(-ss[order], kind="stable")[:degree]]
            return vs[order], ss[order], fs[order]

        for batch in batches:
            for u, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if u != at:
                    if at is not None:
                        out.append((at, *best()))
                    at, held = u, []
                held.append(tuple(np.frombuffer(x, kind) for x, kind in zip(packed, ("<i8", "<f4", np.uint8), strict=True)))
                if len(held) >= 512:
                    held = [best()]
                if len(out) >= 2000:
                    yield _lists(*map(list, zip(*out, strict=True)))
                    out = []
        if at is not None:
            out.append((at, *best()))
        if out:
            yield _lists(*map(list, zip(*out, strict=True)))

    return lists.repartition("u").sortWithinPartitions("u").mapInArrow(run, LISTS)


def _edges(graph: DataFrame) -> DataFrame:
    """u, v and fresh for each edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs, fs = ([np.frombuffer(v, kind) for v in batch.column(k).to_pylist()] for k, kind in ((1, "<i8"), (2, np.uint8)))
            if vs:
                ends = np.repeat(batch.column(0).to_numpy(), [len(v) for v in vs])
                yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(np.concatenate(vs), pa.int64()), pa.array(np.concatenate(fs) > 0, pa.bool_())], ["u", "v", "fresh"])

    return graph.select("u", "vs", "fs").mapInArrow(run, "u long, v long, fresh boolean")


def _descent_round(nodes: DataFrame, graph: DataFrame, degree: int, keep: int) -> DataFrame:
    """The graph after each node's neighbours have met one another; pairs that met in an earlier round are not taken again."""
    edges = materialise(_edges(graph), "edges")
    named = edges.groupBy(F.col("v").alias("g")).count().where(F.col("count") > GROUP).select("g", F.ceil(F.col("count") / GROUP).cast("int").alias("blocks"))
    back = edges.select(F.col("v").alias("g"), F.col("u").alias("m"), "fresh").join(named, "g", "left").select("g", F.coalesce(F.pmod(F.xxhash64("m"), "blocks").cast("int"), F.lit(0)).alias("block"), "m", "fresh")
    ahead = edges.select(F.col("u").alias("g"), F.col("v").alias("m"), "fresh").join(named, "g", "left").select("g", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), "m", "fresh")
    members = back.unionByName(ahead).groupBy("g", "block", "m").agg(F.max("fresh").alias("fresh"))

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ss = [np.frombuffer(s, "<f4") for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(s.min()) if len(s) >= degree else -9.0 for s in ss], pa.float32())], ["m", "worst"])

    known = nodes.select(F.col("node").alias("m"), "h").join(graph.select("u", "ss").mapInArrow(worst, "m long, worst float"), "m")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss = [], [], []
        for run in _runs(batches, 2, 4 * GROUP):
            ids, h = run.column(2).to_numpy(), _matrix(run.column(4).combine_chunks(), "<f2").astype(np.float32)
            fresh = run.column(3).to_numpy()
            if not fresh.any():
                continue
            sims = h @ h.T
            sims[~(fresh[:, None] | fresh[None, :])] = -9
            np.fill_diagonal(sims, -9)
            best = _top(sims, min(keep, len(ids)))
            got = np.take_along_axis(sims, best, 1)
            nearer = got > np.maximum(run.column(5).to_numpy(), -8)[:, None]
            for k in np.flatnonzero(nearer.any(axis=1)):
                us.append(ids[k])
                vs.append(ids[best[k][nearer[k]]])
                ss.append(got[k][nearer[k]])
            if len(us) >= 10_000:
                yield _lists(us, vs, ss)
                us, vs, ss = [], [], []
        if us:
            yield _lists(us, vs, ss)

    met = members.join(known, "m").select("g", "block", "m", "fresh", "h", "worst")
    found = met.repartition("g", "block").sortWithinPartitions("g", "block", "m").mapInArrow(join, LISTS)
    stale = F.expr("lpad(x'', cast(octet_length(vs) / 8 as int), x'00')")
    out = materialise(_merge(graph.withColumn("fs", stale).unionByName(found), degree), "graph")
    discard(edges)
    return out


def _nearness(graph: DataFrame) -> float:
    """Sum of all similarities in the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(np.frombuffer(s, "<f4").sum(dtype=np.float64)) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(sums)], pa.float64())], ["s"])

    return graph.select("ss").mapInArrow(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()["s"]


def build_graph(nodes: DataFrame, degree: int = 32, leaf: int = LEAF, trees: int = TREES, rounds: int = ROUNDS, keep: int = 10) -> DataFrame:
    """u, vs, ss: each node's nearest nodes as found, packed, best first. nodes has to be a written table.

    Rounds go on until one raises the sum of all similarities by less than GAIN of it, `rounds` at most.
    """
    graph = materialise(_merge(_leaf_lists(nodes, nodes.count(), degree, leaf, trees), degree), "graph")
    before = _nearness(graph)
    free_shuffles(nodes.sparkSession)
    for _ in range(rounds):
        after = _descent_round(nodes, graph, degree, keep)
        discard(graph)
        graph = after
        free_shuffles(nodes.sparkSession)
        now = _nearness(graph)
        if now - before < GAIN * abs(now):
            break
        before = now
    return graph


def search_graph(nodes: DataFrame, graph: DataFrame, starts: DataFrame, beam: int = 128, max_hops: int = 200) -> DataFrame:
    """q, w, s: the `beam` best nodes found for each node q of starts (distinct), by greedy search from q's neighbours."""
    spark = nodes.sparkSession
    edges = materialise(_edges(graph), "edges")
    wanted = starts.join(nodes.select(F.col("node").alias("q"), F.col("h").alias("qh")), "q")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("qh")), F.lit(0)).alias("n")).first()["n"]
    wanted = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(i), "<f2").astype(np.float32) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b), pa.float32())], ["q", "w", "s"])

    def score(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes.select(F.col("node").alias("w"), "h"), "w").join(wanted, "q").select("q", "w", "h", "qh").mapInArrow(scored, "q long, w long, s float")

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "w"))
    first = score(starts.join(edges, F.col("q") == F.col("u")).select("q", F.col("v").alias("w"))).withColumn("done", F.lit(False))
    pool = materialise(first.repartition("q").withColumn("r", rank).where(F.col("r") <= beam).drop("r"), "pool")
    for _ in range(max_hops):
        ahead = pool.where("not done")
        if ahead.isEmpty():
            return pool
        reached = ahead.select("q", F.col("w").alias("u")).join(edges, "u").select("q", F.col("v").alias("w")).where("q != w").distinct()
        fresh = score(reached.join(pool.select("q", "w"), ["q", "w"], "left_anti")).withColumn("done", F.lit(False))
        both = pool.withColumn("done", F.lit(True)).unionByName(fresh).repartition("q")
        after = materialise(both.withColumn("r", rank).where(F.col("r") <= beam).drop("r"), "pool")
        discard(pool)
        pool = after
        free_shuffles(spark)
    raise RuntimeError(f"searches that have not ended after {max_hops} hops")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = 32, leaf: int = LEAF, trees: int = TREES, rounds: int = ROUNDS, beam: int = 128, rerank: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of vectors whose id is in queries (id_col).

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take no part, neither as
    queries nor as candidates. Vectors of another length than most (the smaller length in a tie) take no part. An id that repeats counts once,
    with its smallest vector. Equal vectors are one node of the graph. Ties in the score go to the smaller id. Fewer
    candidates than k give fewer rows. Other columns are ignored.
    """
    sizes = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    vectors = vectors.where(F.size(vec_col) == (sizes[0]["n"] if sizes else 0))
    nodes = materialise(nodes_of(vectors, id_col, vec_col, k + 1), "nodes")
    graph = build_graph(nodes, degree, leaf, trees, rounds)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id")).distinct()
    rows = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("v")).groupBy("query_id").agg(F.min("v").alias("v"))
    asked = materialise(rows.join(asked, "query_id").join(nodes.select("v", F.col("node").alias("q")), "v").select("query_id", "q"), "queries")
    pool = search_graph(nodes, graph, asked.select("q").distinct(), beam)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "w"))
    best = pool.withColumn("r", rank).where(F.col("r") <= rerank).select("q", "w")
    best = best.unionByName(asked.select("q", F.col("q").alias("w")).distinct())  # rows equal to the query

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (c.values.to_numpy().reshape(len(c), -1) for c in (batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2), batch.column(3)))
                s = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["q", "w", "score"])

    of = nodes.select(F.col("node").alias("w"), F.col("v").alias("b"))
    scored = best.join(of, "w").join(nodes.select(F.col("node").alias("q"), F.col("v").alias("a")), "q").select("q", "w", "a", "b").mapInArrow(exact, "q long, w long, score double")
    found = asked.join(scored, "q").join(nodes.select(F.col("node").alias("w"), "ids"), "w")
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id != vec_id")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
