"""SimHash near-duplicates: fingerprints, a grid range-join over segment popcounts, exact verification, components.

The embedding maps a fingerprint to the number of ones in each of its 32 two-bit segments. Flipping one bit moves
one count by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. Counts are kept in unary inside their two bits (0 -> 00, 1 -> 01, 2 -> 11), which makes the Manhattan
distance the popcount of an xor. The 32 coordinates form `radius + 3` groups. Two points within `radius` in
Manhattan distance agree in at least three groups, so the grid's cells are the triples of groups with their counts:
every link meets in a cell, and what meets is checked by the Manhattan bound and then exactly.

Cells are counted first. One of more than `cell_rows` different fingerprints is not compared pair by pair, nor gathered:
its members are joined through midpoints. Two fingerprints differ in at most 4 bits exactly if some 64-bit word lies within 2 bits of both, and a
word has only 2,081 such neighbours, so those groups stay small however many fingerprints the cell holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import ASCII_LOWER, connected_components, discard, free_shuffles, materialise, text_bytes

LOW_BITS = 0x5555555555555555
SLAB = 4096


def shingle_hashes(text: bytes, shingle: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles in order, repeats included, a slab at a time; fewer words make one shingle, none none."""
    from xxhash import xxh64_intdigest

    words = text.translate(ASCII_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    for at in range(0, len(starts), SLAB):
        yield np.array([xxh64_intdigest(joined[x:y], seed) for x, y in zip(starts[at : at + SLAB], stops[at : at + SLAB], strict=True)], np.uint64)


def _vote(slabs: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in slabs:
        ones += np.add.reduce(np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).astype(np.int64)) if n else 0


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of word shingles: a bit is set if it is set in over half of the hashes; no words give zero."""
    return _vote(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """id_col and fp (signed long) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_bytes(docs[text_col]).alias("text")).mapInArrow(run, f"id {kind}, fp long")
    return out.select(F.col("id").alias(id_col), "fp")


def unary_counts(fp: Column) -> Column:
    """The segment popcounts of a fingerprint, each in unary within its two bits."""
    shifted = F.shiftrightunsigned(fp, 1)
    low, high = (fp.bitwiseOR(shifted)).bitwiseAND(F.lit(LOW_BITS)), fp.bitwiseAND(shifted).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(F.shiftleft(high, 1))


def cell_masks(radius: int, agree: int = 3) -> list[int]:
    """Signed masks over the embedding: one for each choice of `agree` out of radius + agree coordinate groups."""
    groups = radius + agree
    of = [sum(3 << (2 * s) for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    masks = [sum(of[g] for g in c) for c in combinations(range(groups), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over the given links, by repeated minimum and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _thermometer(x: np.ndarray) -> np.ndarray:
    half, low = x >> np.uint64(1), np.uint64(LOW_BITS)
    return ((x | half) & low) | ((x & half & low) << np.uint64(1))


def _cell_links(which: np.ndarray, cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is connected within each cell; rows come sorted by cell."""
    u = fp.view(np.uint64)
    t = _thermometer(u)
    same = (which[1:] == which[:-1]) & (cell[1:] == cell[:-1])
    run_end = np.append(np.flatnonzero(~same) + 1, len(fp))
    left_in_run = np.repeat(run_end, np.diff(np.concatenate([[0], run_end]))) - np.arange(len(fp))
    lefts, rights, step = [], [], 1
    here = np.flatnonzero(left_in_run > step)
    while len(here):
        near = here[np.bitwise_count(t[here] ^ t[here + step]) <= radius]  # the lower bound
        near = near[np.bitwise_count(u[near] ^ u[near + step]) <= radius]
        lefts.append(near)
        rights.append(near + step)
        step += 1
        here = here[left_in_run[here] > step]
    if not lefts:
        return fp[:0], fp[:0]
    left, right = np.concatenate(lefts), np.concatenate(rights)
    touched, index = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = _roots(index[: len(left)], index[len(left) :], len(touched))
    mine = np.flatnonzero(root != np.arange(len(touched)))
    return fp[touched[mine]], fp[touched[root[mine]]]


def grid_links(points: DataFrame, radius: int = 4, cell_rows: int = 2048) -> DataFrame:
    """Columns a, b: links that connect all fingerprints (column fp, distinct) reachable by steps of <= radius bits."""
    masks = cell_masks(radius)
    cells = points.select("fp", unary_counts(F.col("fp")).alias("t")).select("fp", F.posexplode(F.array(*[F.col("t").bitwiseAND(F.lit(m)) for m in masks])).alias("which", "cell"))

    full = materialise(cells.groupBy("which", "cell").count().where(F.col("count") > cell_rows).select("which", "cell"), "crowded")
    crowded = None if full.isEmpty() else materialise(cells.join(full, ["which", "cell"], "left_semi").select("fp").distinct(), "crowded")
    if crowded is not None:
        cells = cells.join(full, ["which", "cell"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]

        def out(*rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _cell_links(*rows, radius)], ["a", "b"])

        for batch in batches:
            which, cell, fp = kept = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            change = np.flatnonzero((which[1:] != which[:-1]) | (cell[1:] != cell[:-1])) + 1
            done = change[-1] if len(change) else 0
            yield out(which[:done], cell[:done], fp[:done])
            kept = [k[done:] for k in kept]
        if len(kept[2]):
            yield out(*kept)

    met = cells.select("which", "cell", "fp").repartition("which", "cell").sortWithinPartitions("which", "cell", "fp").mapInArrow(run, "a long, b long")
    links = materialise(met.distinct(), "links")
    return links if crowded is None else links.unionByName(midpoint_links(crowded, radius))


def midpoint_links(points: DataFrame, radius: int) -> DataFrame:
    """Columns a, b: for every word within radius / 2 bits of some points, a link from each of them to the smallest.

    For a radius of 2 or 4 that connects exactly what is linked by <= radius bits. No word has more points than its ball
    has words, so no group is large.
    """
    flip = lambda i: F.when(F.col(i) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, {i} - 1)"))
    firsts = points.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63 if radius == 4 else 0))).alias("i"))
    pairs = firsts.select("fp", "i", F.explode(F.sequence(F.when(F.col("i") == 0, 0).otherwise(F.col("i") + 1), F.lit(64))).alias("j"))
    balls = pairs.select("fp", F.col("fp").bitwiseXOR(flip("i")).bitwiseXOR(flip("j")).alias("word"))
    low = balls.select("fp", F.min("fp").over(Window.partitionBy("word")).alias("low"))
    return low.where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42, cell_rows: int = 2048) -> DataFrame:
    """id_col, fp, component_id (smallest id reachable) for every row of docs.

    Rows with equal fingerprints are one point from the start, however many there are. A null text counts as empty;
    texts without words have fingerprint zero and link like any other; very long ones are read whole. Repeated ids keep their rows. A null id is
    never a component's id while another row has one. No rows give no rows. Other columns are ignored.
    """
    if radius not in (2, 4):
        raise ValueError("the radius must be 2 or 4")
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    points = prints.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    links = grid_links(points.select("fp"), radius, cell_rows)
    # a fingerprint's label sorts by its smallest id, so that a component's smallest label tells its id
    label = F.struct(F.col("first_id").isNull().alias("missing"), F.col("first_id").alias("id"), "fp")
    points = materialise(points.select("fp", label.alias("label")), "points")
    of = lambda end: points.select(F.col("fp").alias(end), F.col("label").alias(f"label_{end}"))
    roots = connected_components(links.join(of("a"), "a").join(of("b"), "b"), "label_a", "label_b")
    classes = points.join(roots.select(F.col("node.fp").alias("fp"), "root"), "fp", "left")
    classes = materialise(classes.select("fp", F.coalesce("root.id", "label.id").alias("component_id")), "classes")
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


BANDS, BAND_ROWS = 14, 4
#: Members of a bucket that one group compares, about; larger buckets take several groups, in the second round one for each pair of blocks.
PIECE = 512
#: Ids that are broadcast, eight bytes each, to pick texts before they travel; more ids are joined by shuffles alone.
BROADCAST_IDS = 2_000_000
#: How far below the similarity an estimate may lie for a pair to be proposed in the first round.
SLACK = 0.11
BINS = np.uint64(512)


def _least(slabs: list[np.ndarray]) -> np.ndarray:
    """The smallest of each of BANDS * BAND_ROWS hashes of the shingles."""
    factors = np.random.default_rng(5).integers(1, 2**63, (BANDS * BAND_ROWS, 2), dtype=np.uint64) | np.uint64(1)
    out = np.full(len(factors), 2**32 - 1, np.uint64)
    for hashes in slabs:
        for x in range(0, len(hashes), 512):
            mixed = (hashes[None, x : x + 512] * factors[:, :1] + factors[:, 1:]) >> np.uint64(32)
            np.minimum(out, mixed.min(axis=1), out=out)
    return out.astype("<u4")


def _binned(slabs: list[np.ndarray]) -> tuple[int, bytes, int]:
    """How many different hashes there are, their counts by BINS bins (up to 255), and what is counted beyond that.

    Two sets share at most the sum of the lesser counts and the lesser rest.
    """
    different = np.unique(np.concatenate(slabs))
    counts = np.bincount((different % BINS).astype(np.int64), minlength=int(BINS))
    bins = np.minimum(counts, 255)
    return len(different), bins.astype(np.uint8).tobytes(), int((counts - bins).sum())


def _likely(sigs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a forest that spans what is likely to be similar, by the most likely edges (Prim's algorithm)."""
    n, edges = len(sigs), []
    best, source, out = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmax(np.where(out, best, -2.0)))
        if best[at] >= least:
            edges.append((int(source[at]), at))
        elif best[at] >= 0:
            best[out] = -1.0
        out[at] = False
        alike = (sigs == sigs[at]).mean(axis=1)
        nearer = out & (alike > best)
        best[nearer], source[nearer] = alike[nearer], at
    return edges


def similar_links(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, seed: int = 42, known: DataFrame | None = None) -> DataFrame:
    """Columns a, b: links that connect the ids of rows whose shingle sets have a Jaccard similarity of at least `similarity`.

    Equal texts are linked as such. Of the different ones, those that share one of 14 bands of 4 minimum hashes meet. In
    the first round each bucket proposes the edges of a forest by estimated similarity, in pieces that share the bucket's
    smallest member; proposed pairs are checked on the texts themselves. What that links, with the links of `known`
    (columns a, b), makes components. In the second round every pair of a bucket whose ends are still in different
    components is checked in the same way, whatever its estimate or piece, unless the sizes of the two sets or their
    counts by bin prove that it falls short: the first round only saves checks that could join nothing. A large bucket is
    dealt into blocks, and each pair of blocks is a group of its own, so no group grows with the bucket. Rows with a null id
    and texts without words have no links here; very long texts are read whole; no rows give no links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(2):
                slabs = list(shingle_hashes(t.as_py(), shingle, seed))
                out.append((_least(slabs).tobytes(), *_binned(slabs)) if slabs else (None, 0, None, 0))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "same", "sig", "n", "bins", "over"])

    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_bytes(docs[text_col]).alias("t"))
    texts = texts.select("id", F.md5("t").alias("same"), "t")
    # signatures are worked out where the texts are, so that of a text only its signature travels
    read = texts.mapInArrow(run, "id long, same string, sig binary, n long, bins binary, over long")
    classes = materialise(read.groupBy("same").agg(F.min(F.struct("id", "sig", "n", "bins", "over")).alias("r")).select("same", "r.*"), "signatures")
    signed = classes.where("sig is not null").select("id", "sig", "n", "bins", "over")
    firsts = classes.select("same", F.col("id").alias("rep"))
    copies = texts.select("id", "same").join(firsts, "same").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    free_shuffles(spark)

    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * BAND_ROWS * 4 + 1, BAND_ROWS * 4)) for k in range(BANDS)])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sigs = None, [], []

        def edges() -> pa.RecordBatch:
            found = _likely(np.frombuffer(b"".join(sigs), "<u4").reshape(len(sigs), -1), similarity - SLACK) if len(ids) > 1 else []
            pairs = [sorted((ids[x], ids[y])) for x, y in found]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for band, piece, i, sig in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (band, piece) != at:
                    if len(ids) > 1:
                        yield edges()
                    at, ids, sigs = (band, piece), [], []
                ids.append(i)
                sigs.append(sig)
        if len(ids) > 1:
            yield edges()

    banded = signed.select(F.explode(bands).alias("band"), "id")
    buckets = banded.groupBy("band").agg(F.count("*").alias("c"), F.min("id").alias("head")).where("c > 1")
    members = materialise(banded.join(buckets, "band"), "members")
    pieces = F.ceil(F.col("c") / PIECE).cast("int")
    heads = members.where(F.col("c") > PIECE).select("band", "c", "head").distinct()
    heads = heads.select("band", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.col("head").alias("id"))
    met = members.select("band", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece"), "id").unionByName(heads).distinct()
    met = met.join(signed.select("id", "sig"), "id").select("band", "piece", "id", "sig")
    met = met.repartition("band", "piece").sortWithinPartitions("band", "piece", "sig", "id")
    edges = materialise(met.mapInArrow(propose, "a long, b long").distinct(), "candidates")

    def still_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            block, n, ids, root, over = (np.array([r[k] for r in held], np.int64) for k in range(5))
            bins = np.frombuffer(b"".join([r[5] for r in held]), np.uint8).reshape(len(held), -1)
            for x in range(len(held) - 1):
                y = np.arange(x + 1, np.searchsorted(n * similarity, n[x], "right"))  # sorted by size
                y = y[(root[y] != root[x]) & ((block[y] != block[x]) | (at[1] == at[2]))]
                for z in (y[k : k + SLAB] for k in range(0, len(y), SLAB)):
                    most = np.minimum(np.minimum(bins[z], bins[x]).sum(axis=1, dtype=np.int64) + np.minimum(over[z], over[x]), n[x])
                    z = z[most >= similarity * (n[z] + n[x] - most)]
                    if len(z):
                        yield pa.RecordBatch.from_arrays([pa.array(f(ids[z], ids[x]), pa.int64()) for f in (np.minimum, np.maximum)], ["a", "b"])

        for batch in batches:
            for band, i, j, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (band, i, j) != at:
                    if held:
                        yield from pairs()
                    at, held = (band, i, j), []
                held.append(row)
        if held:
            yield from pairs()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, set[int]] = (b"", set())

        def shingles(t: bytes) -> set[int]:
            return set(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(t, shingle, seed)]).tolist())

        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = ta.as_py(), tb.as_py()
                last = last if last[0] == y else (y, shingles(y))
                sa, sb = shingles(x), last[1]
                common = len(sa & sb)
                keep.append(common >= similarity * (len(sa) + len(sb) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def checked(edges: DataFrame) -> DataFrame:
        asked = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().join(classes.select("id", "same"), "id")
        asked = materialise(asked, "asked")
        near = texts  # no text but the asked ones travels, while there are few enough ids to send them everywhere
        if asked.count() <= BROADCAST_IDS:
            near = near.join(F.broadcast(asked.select("id")), "id", "left_semi")
        used = materialise(near.join(asked, ["id", "same"], "left_semi").select("id", "t").dropDuplicates(["id"]), "candidate-texts")
        free_shuffles(spark)
        pairs = edges.join(used.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(used.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
        out = materialise(pairs.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "similar")
        for done in (asked, used):
            discard(done)
        free_shuffles(spark)
        return out

    links = copies.unionByName(checked(edges))
    links = links.unionByName(known.select("a", "b")) if known is not None else links
    roots = materialise(connected_components(links, "a", "b"), "roots")
    rooted = members.select("band", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("band").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    apart = rooted.join(mixed.select("band", pieces.alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    apart = materialise(apart.select("band", "id", "root", "block", "blocks"), "apart")
    spread = apart.join(signed.select("id", "n", "bins", "over"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "id", "root", "over", "bins")
    left = spread.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "n", "id").mapInArrow(still_apart, "a long, b long")
    left = materialise(left.distinct().join(edges, ["a", "b"], "left_anti"), "candidates")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = links if left.isEmpty() else links.unionByName(checked(left))
    for done in (classes, members, edges, apart, left):
        discard(done)
    free_shuffles(spark)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id.

    Rows are linked by fingerprints within `radius` bits, and by a Jaccard similarity of their shingle sets of at least
    `similarity`, which fingerprints of 64 bits alone would miss for the most part: at 0.8 they differ in ten bits or so.
    Rows without words link with one another; very long texts are read whole. Of rows that repeat an id one stays (the
    smallest text); rows with a null id stay. No rows give no rows. Columns and their order stay, whatever their names.
    """
    found = materialise(components(docs, id_col, text_col, shingle, radius).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("a"), F.col("component_id").cast("long").alias("b")), "near")
    links = similar_links(docs, id_col, text_col, shingle, similarity, known=found.where("a != b"))
    gone = connected_components(links, "a", "b").where("node != root").select(F.col("node").alias("__gone"))
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    key, body = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    repeated = plain.where(key.isNotNull()).groupBy(key.cast("long").alias("__id")).agg(F.count("*").alias("n")).where("n > 1")
    stay = plain.join(gone, key.cast("long") == F.col("__gone"), "left_anti")
    several = stay.join(repeated, key.cast("long") == F.col("__id"), "left_semi")
    others = stay.join(repeated, key.cast("long") == F.col("__id"), "left_anti")
    first = several.groupBy(key.alias("__id")).agg(F.min_by(F.struct(*plain.columns), F.struct(body.isNull(), body)).alias("row")).select("row.*")
    return others.unionByName(first).toDF(*names)
