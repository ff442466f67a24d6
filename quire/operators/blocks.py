"""Operators on chapters, whose blocks are an array of structs in document order.

A chapter is a row; its blocks and notes travel inside it, so these operators need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

BLOCK = "struct<kind:string,text:string,level:int,items:array<string>,rows:array<array<string>>,ordered:boolean>"
NOTE = "struct<id:string,label:string,content:string>"
BLOCKS, NOTES = f"array<{BLOCK}>", f"array<{NOTE}>"
TEXT_KINDS = ["paragraph", "blockquote", "heading"]


def paragraphs(texts: Column) -> Column:
    """Paragraph blocks of an array of texts."""
    return F.transform(texts, lambda t: F.struct(F.lit("paragraph").alias("kind"), t.alias("text"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("items"), F.array().cast("array<array<string>>").alias("rows"), F.lit(False).alias("ordered")))


def settled(rows: DataFrame) -> DataFrame:
    """rows, with the columns so far computed once: filters and later columns don't repeat their expressions per element."""
    return rows.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("__row")).select("__row.*")


def is_residue(block: Column) -> Column:
    """Whether a block is left over from a table of contents: by its text, or by most of a list's items."""
    hits = F.size(F.filter(block["items"], T.is_toc_residue))
    by_items = (F.size(block["items"]) > 0) & (hits >= F.floor(F.size(block["items"]) / 2) + 1)
    return F.when(block["kind"].isin(*TEXT_KINDS), T.is_toc_residue(block["text"])).when(block["kind"] == "list", by_items).otherwise(False)


def is_toc_chapter(title: Column, reason: Column) -> Column:
    why = F.lower(F.coalesce(reason, F.lit("")))
    return T.normalize_title(F.coalesce(title, F.lit(""))).isin(*T.TOC_NAMES) | why.contains("toc") | why.contains("contents")


def trim_residue(chapters: DataFrame) -> DataFrame:
    """Takes residue out of blocks (all of it in a chapter that is a table of contents, else what leads) and counts it in toc_trimmed."""
    marked = settled(chapters.withColumn("__residue", F.transform("blocks", is_residue)))
    first_kept = F.coalesce(F.array_position("__residue", False), F.lit(0)).cast("int")
    led = F.when(first_kept == 0, F.array().cast(BLOCKS)).otherwise(F.slice("blocks", F.greatest(first_kept, F.lit(1)), F.greatest(F.size("blocks"), F.lit(1))))
    clean = F.filter("blocks", lambda b, k: ~F.get(F.col("__residue"), k))
    kept = F.when(is_toc_chapter(F.col("title"), F.col("classify_reason")), clean).otherwise(led)
    marked = settled(marked.withColumn("__kept", kept))
    return marked.withColumns({"toc_trimmed": F.size("blocks") - F.size("__kept"), "blocks": F.col("__kept")}).drop("__residue", "__kept")


def normalize_block(b: Column) -> Column:
    text = F.when(b["kind"].isin(*TEXT_KINDS), T.normalize_paragraph(b["text"])).when(b["kind"] == "code", T.trim(b["text"])).otherwise(b["text"])
    items = F.when(b["kind"] == "list", F.filter(F.transform(b["items"], T.normalize_paragraph), lambda x: x != "")).otherwise(b["items"])
    rows = F.when(b["kind"] == "table", F.transform(b["rows"], lambda r: F.transform(r, T.normalize_paragraph))).otherwise(b["rows"])
    return F.struct(b["kind"].alias("kind"), text.alias("text"), b["level"].alias("level"), items.alias("items"), rows.alias("rows"), b["ordered"].alias("ordered"))


def drop_empty(blocks: Column) -> Column:
    full = lambda b: F.when(b["kind"].isin("code", *TEXT_KINDS), b["text"] != "").when(b["kind"] == "list", F.size(b["items"]) > 0).otherwise(True)
    return F.filter(blocks, full)


def drop_repeats(blocks: Column) -> Column:
    """Blocks without those of text that equal the one before; lists, tables and separators stay."""

    def fresh(b: Column, k: Column) -> Column:
        before = F.get(blocks, k - 1)
        same = b["kind"].isin("code", *TEXT_KINDS) & (b["kind"] == before["kind"]) & (b["text"] == before["text"])
        return (k == 0) | ~F.coalesce(same, F.lit(False))

    return F.filter(blocks, fresh)


def normalize_notes(notes: Column) -> Column:
    clean = F.transform(notes, lambda n: F.struct(n["id"].alias("id"), F.when(T.trim(n["label"]) == "", n["id"]).otherwise(n["label"]).alias("label"), T.normalize_paragraph(n["content"]).alias("content")))
    return F.filter(clean, lambda n: n["content"] != "")


def normalize_chapters(chapters: DataFrame) -> DataFrame:
    """Residue, blocks, notes and titles put right; chapters with neither blocks nor notes left go."""
    out = trim_residue(chapters)
    out = settled(out.withColumn("blocks", drop_empty(F.transform("blocks", normalize_block))))
    out = out.withColumn("blocks", drop_repeats(F.col("blocks"))).withColumn("footnotes", normalize_notes(F.col("footnotes")))
    title = T.normalize_paragraph(F.coalesce("title", F.lit("")))
    out = out.withColumn("title", F.when(title == "", "Untitled Section").otherwise(title))
    return settled(out).where((F.size("blocks") > 0) | (F.size("footnotes") > 0))
