"""Chunks: a chapter's blocks packed in order up to a size, with the headings above them and the notes they cite."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocks import settled
from quire.operators.render import NO_TITLE, block_text

UNIT = "array<struct<text:string,size:int,blocks:int,level:int>>"
PACKED = "array<struct<text:string,blocks:int,headings:array<string>,own_notes:boolean>>"


@dataclass(frozen=True)
class Sizes:
    """Sizes in code points. Those that aren't positive take the defaults; least and most give way to target."""

    target: int = 1200
    least: int = 500
    most: int = 1700

    def settled(self) -> Sizes:
        target, least, most = (v if v > 0 else d for v, d in zip((self.target, self.least, self.most), (1200, 500, 1700), strict=True))
        return Sizes(target, min(least, target), max(most, target))


def units(blocks: Column, sizes: Sizes) -> Column:
    """Units to pack: headings (level over 0), and pieces of the other blocks, of which the first counts its block."""
    unit = lambda text, n, level: F.struct(text.alias("text"), F.length(text).alias("size"), n.cast("int").alias("blocks"), level.cast("int").alias("level"))

    def of(b: Column) -> Column:
        title, level = T.trim(b["text"]), F.greatest(b["level"], F.lit(1))
        heading = F.when(title != "", F.array(unit(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title), F.lit(1), level)))
        cut = lambda text: F.when(text != "", F.transform(T.split_long(text, sizes.target, sizes.most), lambda p, k: unit(p, F.when(k == 0, 1).otherwise(0), F.lit(0))))
        pieces = T.let(T.trim(F.coalesce(block_text(b, 1, False), F.lit(""))), cut)
        return F.coalesce(F.when(b["kind"] == "heading", heading).otherwise(pieces), F.array().cast(UNIT))

    return F.flatten(F.transform(blocks, of))


def heading_path(levels: Column, headings: Column) -> Column:
    """The path after all of a chapter's headings."""
    pairs = F.zip_with(headings, levels, lambda h, n: F.struct(h.alias("h"), n.alias("n")))
    return F.aggregate(pairs, F.array().cast("array<string>"), lambda path, x: T.push_heading(path, x["h"], x["n"]))


def _pack(rows: list[dict], sizes: Sizes) -> Iterator[dict]:
    """Packs one chapter's units; a chapter is read once and its open chunk's length is kept, not measured again."""
    path: list[str] = []
    parts: list[str] = []
    size = blocks = 0

    def close() -> Iterator[dict]:
        nonlocal parts, size, blocks
        if parts:
            yield {"text": "\n\n".join(parts), "blocks": blocks, "headings": list(path), "own_notes": False}
        parts, size, blocks = [], 0, 0

    def open_() -> None:
        nonlocal parts, size
        if not parts and path:
            parts = ["\n".join(path)]
            size = len(parts[0])

    for unit in rows:
        if unit["level"]:
            if size >= sizes.least:
                yield from close()
            if not path or path[-1] != unit["text"]:
                path = [*path[: unit["level"] - 1], unit["text"]] if len(path) >= unit["level"] else [*path, unit["text"]]
            continue
        open_()
        if size + 2 * bool(size) + unit["size"] > sizes.most and size >= sizes.least:
            yield from close()
            open_()
        size += 2 * bool(size) + unit["size"]
        parts.append(unit["text"])
        blocks += unit["blocks"]
        if size >= sizes.target:
            yield from close()
    if parts:
        yield {"text": "\n\n".join(parts), "blocks": blocks, "headings": list(path), "own_notes": True}  # still open when notes were counted


def _pack_all(chapters: DataFrame, sizes: Sizes) -> DataFrame:
    """chapters with packed: its chunks' texts; own_notes marks the one that was open at the chapter's end."""
    kept = [c for c in chapters.columns if c != "units"]
    base = chapters.select(F.struct(*kept).alias("x"), "units")
    kind = pa.list_(pa.struct([("text", pa.string()), ("blocks", pa.int32()), ("headings", pa.list_(pa.string())), ("own_notes", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [list(_pack(u, sizes)) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, kind)], ["x", "packed"])

    return base.mapInArrow(run, f"x {base.schema['x'].dataType.simpleString()}, packed {PACKED}").select("x.*", "packed")


def build_chunks(books: DataFrame, chapters: DataFrame, sizes: Sizes = Sizes(), back_matter: bool = False) -> DataFrame:
    """A row a chunk, with the columns of the chunk files.

    Chunks stay inside a chapter. A chunk that cites notes ends with them; notes that no closed chunk has cited make a
    chunk of their own at the chapter's end, before which the open chunk is closed (so its notes stand in both). Packing
    reads each chapter's row by itself; numbering over a book is the one shuffle.
    """
    sizes = sizes.settled()
    used = chapters if back_matter else chapters.where("kind = 'main'")
    ready = used.select("book", "id", "title", "order", "kind", "source_ref", "footnotes", units(F.col("blocks"), sizes).alias("units"))
    packed = _pack_all(ready, sizes)
    told = F.filter("footnotes", lambda n: (T.trim(n["label"]) != "") & (T.trim(n["content"]) != ""))
    packed = packed.withColumn("__notes", F.transform(told, lambda n: F.struct(T.trim(n["label"]).alias("label"), T.trim(n["content"]).alias("content"))))
    line = lambda n: F.concat(F.lit("[^"), n["label"], F.lit("]: "), n["content"])

    def cited(text: Column) -> Column:
        of_label = lambda label: F.element_at(F.filter("__notes", lambda n: n["label"] == label), -1)
        known = F.filter(T.note_labels(text), lambda label: F.exists("__notes", lambda n: n["label"] == label))
        return F.transform(known, lambda label: line(of_label(label)))

    def with_notes(c: Column) -> Column:
        text = T.trim(c["text"])
        notes = cited(text)
        full = F.when(F.size(notes) > 0, F.concat(text, F.lit("\n\n## Footnotes\n"), F.array_join(notes, "\n"))).otherwise(text)
        return F.struct(full.alias("text"), c["blocks"].alias("blocks"), c["headings"].alias("headings"), (F.size(notes) > 0).alias("noted"))

    closed = F.flatten(F.transform(F.filter("packed", lambda c: ~c["own_notes"]), lambda c: T.note_labels(c["text"])))
    packed = settled(packed.withColumn("__cited", closed))
    orphans = F.filter("__notes", lambda n: ~F.array_contains(F.col("__cited"), n["label"]))
    last = F.struct(F.concat(F.lit("## Footnotes\n"), F.array_join(F.transform("__orphans", line), "\n")).alias("text"), F.size("__orphans").alias("blocks"), F.array(F.lit("## Footnotes")).alias("headings"), F.lit(True).alias("noted"))
    packed = settled(packed.withColumn("__orphans", orphans))
    chunks = F.filter(F.transform("packed", with_notes), lambda c: c["text"] != "")
    packed = packed.withColumn("__chunks", F.concat(chunks, F.when(F.size("__orphans") > 0, F.array(last)).otherwise(F.array().cast("array<struct<text:string,blocks:int,headings:array<string>,noted:boolean>>"))))
    rows = packed.select("book", "id", "title", "order", "kind", "source_ref", F.posexplode("__chunks").alias("pos", "c"))
    in_book = Window.partitionBy("book").orderBy(F.col("kind") != "main", "order", "id", "pos")
    title = T.trim(F.coalesce("bookTitle", F.lit("")))
    of_book = books.select("book", F.col("title").alias("bookTitle"), F.col("source_path").alias("sourcePath"), "language")
    return rows.join(of_book, "book").select(
        "book",
        F.format_string("%s-%03d", "id", F.col("pos") + 1).alias("id"),
        F.when(title == "", NO_TITLE).otherwise(title).alias("bookTitle"),
        F.col("id").alias("chapterId"),
        F.col("title").alias("chapterTitle"),
        F.col("order").alias("chapterOrder"),
        "kind",
        F.row_number().over(in_book).alias("sequence"),
        F.col("c.text").alias("text"),
        "sourcePath",
        F.col("source_ref").alias("sourceRef"),
        F.length("c.text").alias("characterSize"),
        F.col("c.blocks").alias("blockCount"),
        F.col("c.headings").alias("headingPath"),
        "language",
        F.col("c.noted").alias("hasFootnotes"),
        T.estimate_tokens(F.col("c.text"), F.col("language")).alias("tokenEstimate"),
    )
