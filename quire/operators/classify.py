"""Chapter kinds: by the book's guide, else by title, else main text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Titles and guide types that tell a chapter's kind.
FRONT_EXACT = ["cover", "title page", "copyright", "toc", "contents", "table of contents", "preface", "foreword", "版权", "扉页", "目录", "前言", "序言"]
FRONT_PREFIX = ["copyright", "preface", "foreword", "版权", "前言", "序言"]
BACK_EXACT = ["appendix", "bibliography", "references", "works cited", "glossary", "afterword", "translation notes", "translator's notes", "acknowledgment", "acknowledgement", "附录", "参考文献", "后记", "致谢", "词汇表"]
BACK_PREFIX = ["appendix", "bibliography", "references", "works cited", "glossary", "afterword", "translator's afterword", "translation notes", "translator's notes", "acknowledgment", "acknowledgement", "附录", "参考文献", "后记", "致谢"]
GUIDE_MAIN = ["text", "bodymatter"]
GUIDE_FRONT = ["cover", "toc", "title-page", "titlepage", "copyright"]
GUIDE_BACK = ["appendix", "bibliography", "glossary", "index", "notes", "endnotes", "footnotes"]

MAIN, FRONT, BACK = "main", "frontmatter", "backmatter"
KIND = "struct<kind:string,reason:string>"


def _kind(kind: str, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))


def by_title(title: Column) -> Column:
    """Kind and reason that a title tells, null if it tells none. The first keyword of a list that fits is named."""
    t = T.normalize_title(title)
    first = lambda words, fits: F.get(F.filter(F.array(*map(F.lit, words)), fits), F.lit(0))
    equal = lambda words: first(words, lambda w: w == t)
    starts = lambda words: first(words, lambda w: (t == w) | t.startswith(F.concat(w, F.lit(":"))) | t.startswith(F.concat(w, F.lit(" "))))
    tests = [(FRONT, "title_exact:", equal(FRONT_EXACT)), (BACK, "title_exact:", equal(BACK_EXACT)), (FRONT, "title_prefix:", starts(FRONT_PREFIX)), (BACK, "title_prefix:", starts(BACK_PREFIX))]
    return F.coalesce(*[F.when(word.isNotNull(), _kind(kind, F.concat(F.lit(why), word))) for kind, why, word in tests])


def guide_kind(kind_of_ref: Column) -> Column:
    """Kind that a guide reference's type tells; the type, or a listed type followed by `:` or `-`."""
    t = T.normalize_title(kind_of_ref)
    fits = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: (t == w) | t.startswith(F.concat(w, F.lit(":"))) | t.startswith(F.concat(w, F.lit("-"))))
    return F.when(t.isin(*GUIDE_MAIN), MAIN).when(fits(GUIDE_FRONT), FRONT).when(fits(GUIDE_BACK), BACK)


def with_guide(chapters: DataFrame, guide: DataFrame, book: str = "book") -> DataFrame:
    """chapters with guide_type: that of the book's first guide reference of a known type that points at the chapter's file.

    A reference points at a file that equals it or ends with `/` and it. Books' guides are a few rows, so each book's
    are gathered and joined by the book alone; no pair of a chapter and another book's reference is made.
    """
    known = guide.where(guide_kind(F.col("type")).isNotNull()).select(book, "pos", F.lower(T.trim(F.col("type"))).alias("type"), F.regexp_replace("href", "#.*$", "").alias("href"))
    gathered = known.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("pos", "type", "href"))).alias("__guide"))
    source = F.regexp_replace("source_ref", "#.*$", "")
    points = F.filter("__guide", lambda g: (g["href"] != "") & ((source == g["href"]) | source.endswith(F.concat(F.lit("/"), g["href"]))))
    return chapters.join(gathered, book, "left").withColumn("guide_type", F.get(points, F.lit(0))["type"]).drop("__guide")


def classify(chapters: DataFrame) -> DataFrame:
    """chapters (title, guide_type, and kind where it is forced) with kind and classify_reason."""
    forced = F.when(F.col("kind").isNotNull(), F.struct(F.col("kind"), F.col("classify_reason").alias("reason")))
    guided = F.when(guide_kind(F.col("guide_type")).isNotNull(), F.struct(guide_kind(F.col("guide_type")).alias("kind"), F.concat(F.lit("guide:"), "guide_type").alias("reason")))
    told = F.coalesce(forced, guided, by_title(F.coalesce("title", F.lit(""))), _kind(MAIN, F.lit("default:no_signal")))
    return chapters.withColumn("__told", told).withColumns({"kind": F.col("__told.kind"), "classify_reason": F.col("__told.reason")}).drop("__told")


def ensure_main(chapters: DataFrame, book: str = "book") -> DataFrame:
    """In books without main chapters, every chapter that isn't front matter becomes main."""
    none = F.count_if(F.col("kind") == MAIN).over(Window.partitionBy(book)) == 0
    moved = chapters.withColumn("__moved", none & (F.col("kind") != FRONT))
    return moved.withColumns({"kind": F.when(F.col("__moved"), MAIN).otherwise(F.col("kind")), "classify_reason": F.when(F.col("__moved"), "fallback:no_main_detected").otherwise(F.col("classify_reason"))}).drop("__moved")
