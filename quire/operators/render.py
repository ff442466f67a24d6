"""Markdown of blocks, chapters and books, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

NOTES_TITLE = "脚注"
NO_TITLE = "未命名图书"


def table_lines(rows: Column) -> Column:
    """Lines of a table: the first row is the header, and later rows are cut or filled to its width."""
    head = F.get(rows, F.lit(0))
    width = F.size(head)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fitted = lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.coalesce(F.get(r, k), F.lit("")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""))
    body = F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: line(fitted(r)))
    return F.when((F.size(rows) > 0) & (width > 0), F.concat(F.array(line(head), rule), body)).otherwise(F.array().cast("array<string>"))


def block_text(b: Column, base: int, separators: bool) -> Column:
    """A block's Markdown; null for what isn't shown. Headings of level n stand at base + n - 1, at base at least."""
    level = F.greatest(F.lit(base), F.lit(base) + b["level"] - 1)
    items = F.transform(b["items"], lambda x, k: F.concat(F.when(b["ordered"], F.concat((k + 1).cast("string"), F.lit(". "))).otherwise("- "), x))
    lines = table_lines(b["rows"])
    return (
        F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), b["text"]))
        .when(b["kind"] == "paragraph", b["text"])
        .when(b["kind"] == "blockquote", F.concat(F.lit("> "), b["text"]))
        .when((b["kind"] == "list") & (F.size(b["items"]) > 0), F.array_join(items, "\n"))
        .when(b["kind"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
        .when((b["kind"] == "table") & (F.size(lines) > 0), F.array_join(lines, "\n"))
        .when((b["kind"] == "separator") & F.lit(separators), "---")
    )


def blocks_text(blocks: Column, base: int) -> Column:
    shown = F.filter(F.transform(blocks, lambda b: block_text(b, base, True)), lambda x: x.isNotNull())
    return T.trim(F.array_join(shown, "\n\n"))


def notes_text(notes: Column) -> Column:
    return F.array_join(F.transform(notes, lambda n: F.concat(F.lit("[^"), n["label"], F.lit("]: "), n["content"])), "\n")


def shown_title(title: Column, chapter_id: Column) -> Column:
    t = T.trim(F.coalesce(title, F.lit("")))
    return F.when(t == "", chapter_id).otherwise(t)


def first_heading(blocks: Column) -> Column:
    return F.get(F.filter(blocks, lambda b: b["kind"] == "heading"), F.lit(0))["text"]


def chapter_text(top: int, force_title: Column, notes_title: str = NOTES_TITLE, lead: Column | None = None) -> Column:
    """Markdown of a chapter row (id, title, blocks, footnotes); the title is left out where the first heading repeats it."""
    title = shown_title(F.col("title"), F.col("id"))
    told = F.coalesce(T.normalize_inline(first_heading(F.col("blocks"))) == T.normalize_inline(title), F.lit(False))
    head = F.when(force_title | ~told, F.concat(F.lit("#" * top + " "), title, F.lit("\n\n"))).otherwise("")
    notes = F.when(F.size("footnotes") > 0, F.concat(F.lit("\n\n" + "#" * (top + 1) + f" {notes_title}\n\n"), notes_text(F.col("footnotes")))).otherwise("")
    return F.concat(head, *([lead] if lead is not None else []), blocks_text(F.col("blocks"), top + 1), notes, F.lit("\n"))


def render_chapters(chapters: DataFrame) -> DataFrame:
    """book, id, markdown: a document of its own for each chapter."""
    return chapters.select("book", "id", F.concat(T.trim(chapter_text(1, F.lit(True))), F.lit("\n")).alias("markdown"))


def _whole(chapters: DataFrame, books: DataFrame, lead: Column, text: Column) -> DataFrame:
    """One string a book: lead, then its chapters' texts, main ones first. A book's text is one value, so it is one row's."""
    parts = chapters.select("book", (F.col("kind") != "main").alias("back"), "order", text.alias("text")).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("back", "order", "text"))).alias("parts"))
    joined = F.array_join(F.concat(F.array(lead), F.transform(F.coalesce("parts", F.array().cast("array<struct<back:boolean,order:int,text:string>>")), lambda p: p["text"])), "\n")
    return books.join(parts, "book", "left").select("book", F.concat(T.trim(joined), F.lit("\n")).alias("markdown"))


def book_title() -> Column:
    t = T.trim(F.coalesce("title", F.lit("")))
    return F.when(t == "", NO_TITLE).otherwise(t)


def render_books(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """book, markdown: the title, the main chapters and then the others, each in order."""
    return _whole(chapters, books, F.concat(F.lit("# "), book_title(), F.lit("\n")), chapter_text(2, F.col("kind") != "main"))


def render_debug(books: DataFrame, chapters: DataFrame, stats: DataFrame) -> DataFrame:
    """book, markdown: the same with what was decided about each chapter."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"))
    if_set = lambda shown, *parts: F.when(shown, F.concat(*parts)).otherwise("")
    facts = F.concat(
        *[line(n, F.col(c)) for n, c in (("chapter_id", "id"), ("order", "order"), ("kind", "kind"), ("source_ref", "source_ref"))],
        if_set(F.coalesce(F.col("classify_reason"), F.lit("")) != "", line("classify_reason", F.col("classify_reason"))),
        if_set(F.col("toc_trimmed") > 0, line("toc_trimmed", F.col("toc_trimmed"))),
        if_set(F.col("cross_file_notes") > 0, line("cross_file_notes", F.col("cross_file_notes"))),
        F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- warning: "), w, F.lit("\n"))), ""),
        F.lit("\n"),
    )
    head = F.concat(F.lit("# "), book_title(), F.lit("\n\n## Debug\n\n"), *[line(n, F.col(c)) for n, c in (("source_path", "source_path"), ("source_sha256", "source_sha256"), ("language", "language"), ("chapters", "chapter_count"), ("backmatter", "back_matter_count"), ("footnotes", "footnote_count"))])
    return _whole(chapters, books.join(stats, "book"), head, chapter_text(2, F.lit(True), "Footnotes", facts))
