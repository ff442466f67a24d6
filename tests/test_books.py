"""Archives from end to end, and the operators between."""

from __future__ import annotations

import hashlib
import json
import shutil
import zipfile
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from quire.operators import blocks as B
from quire.operators import chunk, classify, diagnostics, render, retrieval
from quire.plans import artifacts
from quire.plans.convert import convert, convert_library
from quire.sources import epub, files
from quire.streaming.intake import convert_arrivals


def write_epub(path, ncx, documents, language="en", title="A Book"):
    items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in documents)
    refs = "".join(f'<itemref idref="{n}"/>' for n in documents)
    points = "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{s}"/></navPoint>' for t, s in ncx)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", f'<package xmlns:dc="d"><metadata><dc:title>{title}</dc:title><dc:creator>One</dc:creator><dc:creator> </dc:creator><dc:language>{language}</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine>{refs}<itemref idref="gone"/></spine></package>')
        z.writestr("OEBPS/toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
        for name, body in documents.items():
            z.writestr(f"OEBPS/{name}.xhtml", f"<html><head><title>t</title></head><body>{body}</body></html>")


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    lead = "<p>Contents .... 1</p>\n<p>Chapter 1 .... 3</p>\n"
    write_epub(path / "en.epub", [("Introduction", "one.xhtml#intro"), ("Notes", "notes.xhtml")], {"one": f'{lead}<h1 id="intro">Introduction</h1><p>Text<a href="notes.xhtml#fn1">1</a> here.</p><p>Second.</p>', "notes": '<h1>Notes</h1><aside id="fn1" epub:type="footnote"><p>Kept elsewhere.</p></aside>'})
    write_epub(path / "zh.epub", [("第一章", "one.xhtml"), ("附录", "two.xhtml")], {"one": '<h1>第一章</h1><p>正文<a href="#fn1">1</a></p><p>下一段</p><aside id="fn1" epub:type="footnote">脚注内容</aside>', "two": "<h1>附录</h1><p>附录正文</p>"}, "zh-CN", "示例图书")
    return path


@pytest.fixture(scope="module")
def made(spark, library, tmp_path_factory):
    return convert(spark, str(library)).written(str(tmp_path_factory.mktemp("tables")))


def test_books_and_chapters(made):
    books = {r.title: r for r in made.books.collect()}
    assert books["A Book"].authors == ["One"] and books["示例图书"].language == "zh-CN"
    rows = {(r.book[-7:], r.id): r for r in made.chapters.collect()}
    assert rows["en.epub", "chapter-001"].toc_trimmed == 2 and rows["en.epub", "chapter-001"].cross_file_notes == 1
    assert rows["en.epub", "chapter-002"].kind == "main"
    assert (rows["zh.epub", "chapter-002"].kind, rows["zh.epub", "chapter-002"].classify_reason) == ("backmatter", "title_exact:附录")


def test_markdown(made):
    pages = {r.book[-7:]: r.markdown for r in made.markdown.collect()}
    assert "...." not in pages["en.epub"]
    assert pages["zh.epub"] == "# 示例图书\n\n### 第一章\n\n正文[^1]\n\n下一段\n\n### 脚注\n\n[^1]: 脚注内容\n\n## 附录\n\n### 附录\n\n附录正文\n"
    alone = {(r.book[-7:], r.id): r.markdown for r in made.chapter_markdown.collect()}
    assert alone["zh.epub", "chapter-001"].startswith("# 第一章\n\n## 第一章") and "## 脚注" in alone["zh.epub", "chapter-001"]
    assert "- toc_trimmed: 2" in next(r.markdown for r in made.debug_markdown.collect() if r.book.endswith("en.epub"))


def test_chunks(made):
    rows = [r for r in made.chunks.orderBy("book", "sequence").collect() if r.book.endswith("en.epub")]
    assert [r.id for r in rows] == ["chapter-001-001", "chapter-001-002", "chapter-002-001"]
    assert rows[0].text.endswith("## Footnotes\n[^1]: Kept elsewhere.") and rows[0].headingPath == ["# Introduction"]
    assert rows[1].headingPath == ["## Footnotes"] and rows[1].hasFootnotes  # cited only by the chunk still open


def test_diagnostics(made):
    s = next(r for r in made.summary.collect() if r.book.endswith("en.epub"))
    assert (s.chapter_count, s.chunk_count, s.toc_residual_blocks_removed, s.cross_file_footnotes_linked) == (2, 3, 2, 1)
    warned = [r.warnings for r in made.chapter_diagnostics.collect()]
    assert ["chunk:short_segments"] in warned
    snapshot = {r.book[-7:]: r for r in diagnostics.regression_snapshot(made.books, made.chapters, made.chunks).collect()}
    assert snapshot["zh.epub"].chapter_titles == ["第一章", "附录"] and len(snapshot["zh.epub"].five_numbers) == 5


def test_artifacts(spark, made, tmp_path):
    out = tmp_path / "out"
    assert made.write(str(out)) == made.write(f"file://{out}") == 2 * 7 + 4
    assert sorted(p.relative_to(out).as_posix() for p in out.rglob("*") if p.is_file()) == sorted(
        f"{b}{f}" for b in ("en", "zh") for f in (".md", "/debug.md", "/chapters/chapter-001.md", "/chapters/chapter-002.md", "/metadata.json", "/toc.json", "/stats.json", "/diagnostics.json", "/chunks.jsonl")
    )
    read = lambda name: json.loads((out / name).read_text())
    assert (out / "zh.md").read_text().startswith("# 示例图书\n\n### 第一章")
    assert (out / "zh/toc.json").read_text().startswith('[\n  {\n    "id": "chapter-001",\n    "title": "第一章",\n    "kind": "main",')
    assert [(x["id"], x["kind"]) for x in read("zh/toc.json")] == [("chapter-001", "main"), ("chapter-002", "backmatter")]
    assert list(read("en/metadata.json")) == ["title", "authors", "language", "sourcePath", "sourceSha256"]
    assert read("en/stats.json") == {"chapterCount": 2, "frontMatterCount": 0, "backMatterCount": 0, "chunkCount": 3, "footnoteCount": 2}
    told = read("en/diagnostics.json")
    assert list(told) == ["summary", "chapters", "chunks"] and told["summary"]["tocResidualBlocksRemoved"] == 2 and len(told["chunks"]) == 3
    lines = [json.loads(x) for x in (out / "en/chunks.jsonl").read_text().splitlines()]
    assert [x["sequence"] for x in lines] == [1, 2, 3] and all("id" in x and x.get("headingPath") for x in lines)
    back = files.read_chunks(spark, str(out / "*/chunks.jsonl"))
    assert {r.text for r in back.collect()} == {r.text for r in made.chunks.collect()}
    (tmp_path / "q.json").write_text(json.dumps([{"book": "b", "query": "x", "expectedChunks": ["1"], "topK": 0}]))
    assert files.read_eval_queries(spark, str(tmp_path / "q.json")).first().topK == 5


def test_snapshot_file(spark, made, tmp_path):
    path = str(tmp_path / "snapshot.json")
    made.write_snapshot(path)
    records = json.loads(open(path).read())
    assert [r["fileName"] for r in records] == ["en.epub", "zh.epub"]
    assert list(records[1]) == ["fileName", "stats", "chapterTitles", "chunkFingerprints", "chunkCharacterStats"] and records[1]["chapterTitles"] == ["第一章", "附录"]
    stored = artifacts.read_snapshot(spark, path)
    assert artifacts.snapshot_differences(stored, artifacts.snapshot_records(made.snapshot)).count() == 0
    changed = stored.withColumn("chapterTitles", F.when(F.col("fileName") == "zh.epub", F.array(F.lit("x"))).otherwise(F.col("chapterTitles")))
    assert [r.fileName for r in artifacts.snapshot_differences(stored, changed.unionByName(stored.where("fileName = 'en.epub'").withColumn("fileName", F.lit("new")))).orderBy("fileName").collect()] == ["new", "zh.epub"]


def test_stream(spark, library, tmp_path):
    query = convert_arrivals(spark, str(library), str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_broken_archives_stop_nothing(spark, library, tmp_path):
    shutil.copy(library / "en.epub", tmp_path / "good.epub")
    with zipfile.ZipFile(tmp_path / "empty.epub", "w") as z:
        z.writestr("a", "b")
    (tmp_path / "cut.epub").write_bytes((library / "en.epub").read_bytes()[:200])
    made = convert(spark, str(tmp_path))
    errors = {r.book.rpartition("/")[2]: r.error for r in made.broken.collect()}
    assert set(errors) == {"empty.epub", "cut.epub"} and "has no container" in errors["empty.epub"] and errors["cut.epub"].startswith("BadZipFile")
    assert {r.book.rpartition("/")[2] for r in made.chapters.collect()} == {"good.epub"} == {r.book.rpartition("/")[2] for r in made.books.collect()}


def test_archives_are_opened_once(spark, library, tmp_path):
    opened = str(tmp_path / "opened")

    def counted(path: str, content: bytes) -> dict:
        with open(opened, "a") as f:
            f.write(f"{path}\n")
        return epub.read_package(path, content)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(str(library))
    made = convert_library(epub.library_of(epub.packages(found, counted)))
    assert made.chapters.count() == 4 and made.chunks.count() == 5 and made.summary.count() == 2 and made.markdown.count() == 2
    assert len(open(opened).read().splitlines()) == 2


def test_file_hashes(spark, library):
    for r in epub.scan(spark, str(library)).select("source_path", "source_sha256").collect():
        assert r.source_sha256 == hashlib.sha256(open(r.source_path.removeprefix("file:"), "rb").read()).hexdigest()


def test_last_item_of_an_id_counts(spark):
    package = spark.createDataFrame([("b", [("i", "one", "", ""), ("i", "two", "", "")])], "book string, manifest array<struct<id:string,href:string,media_type:string,properties:string>>")
    assert [(r.id, r.href) for r in epub.manifest(package).collect()] == [("i", "two")]


@pytest.mark.parametrize(
    ("title", "kind", "reason"),
    [("Preface to the second", "frontmatter", "title_prefix:preface"), ("Notes on a thing", "main", "default:no_signal"), ("Works  Cited", "backmatter", "title_exact:works cited"), ("Afterword: x", "backmatter", "title_prefix:afterword"), ("Contents of a box", "main", "default:no_signal"), ("版权", "frontmatter", "title_exact:版权")],
)
def test_classify(spark, title, kind, reason):
    rows = spark.createDataFrame([(title, None, None, None)], "title string, kind string, classify_reason string, guide_type string")
    got = classify.classify(rows).first()
    assert (got.kind, got.classify_reason) == (kind, reason)


def test_guide_goes_first(spark):
    rows = spark.createDataFrame([("b", "Preface", "OEBPS/one.xhtml", None, None)], "book string, title string, source_ref string, kind string, classify_reason string")
    guide = spark.createDataFrame([("b", 0, "other", "one.xhtml"), ("b", 1, "Text", "one.xhtml#x"), ("b", 2, "cover", "one.xhtml")], "book string, pos int, type string, href string")
    got = classify.classify(classify.with_guide(rows, guide)).first()
    assert (got.kind, got.classify_reason) == ("main", "guide:text")


def chapter(spark, texts, notes=()):
    rows = [("b", "chapter-001", "T", 1, "main", "", "a.xhtml", texts, [(f"n{k}", str(k), c) for k, c in notes])]
    base = spark.createDataFrame(rows, f"book string, id string, title string, order int, kind string, classify_reason string, source_ref string, texts array<string>, footnotes {B.NOTES}")
    books = spark.createDataFrame([("b", "B", "en", "b.epub", "x")], "book string, title string, language string, source_path string, source_sha256 string")
    return books, base.withColumn("blocks", B.paragraphs(F.col("texts"))).drop("texts")


def test_packing(spark):
    books, rows = chapter(spark, ["A" * 900, "B" * 900, "C" * 900])
    assert [r.characterSize for r in chunk.build_chunks(books, rows).orderBy("sequence").collect()] == [900, 900, 900]
    books, rows = chapter(spark, ["A. " * 800])
    assert chunk.build_chunks(books, rows).count() >= 2
    books, rows = chapter(spark, ["one [^1]" + "x" * 1300, "two [^2]"], [(1, "first"), (2, "second"), (3, "third")])
    texts = [r.text for r in chunk.build_chunks(books, rows).orderBy("sequence").collect()]
    assert texts[0].endswith("[^1]: first") and texts[1].endswith("[^2]: second") and texts[2] == "## Footnotes\n[^2]: second\n[^3]: third"
    assert chunk.build_chunks(books, rows.withColumn("kind", F.lit("backmatter"))).count() == 0
    assert chunk.build_chunks(books, rows.withColumn("kind", F.lit("backmatter")), back_matter=True).count() == 3


def test_sizes(spark):
    assert chunk.Sizes(0, 2000, 10).settled() == chunk.Sizes(1200, 1200, 1200)
    rows = spark.createDataFrame([("b", 120), ("b", 1800)], "book string, characterSize int")
    got = diagnostics.size_summary(rows, ["book"]).first()
    assert (got.short_chunks, got.oversize_chunks, got.average_characters, got.p50_characters) == (1, 1, 960, 120)


def test_even_sample(spark):
    rows = spark.range(10).select(F.lit(1).alias("g"), "id")
    assert sorted(r.id for r in diagnostics.even_sample(rows, ["g"], ["id"], 4).collect()) == [0, 3, 6, 9]
    assert diagnostics.even_sample(rows, ["g"], ["id"], 1).count() == 1
    assert diagnostics.even_sample(rows, ["g"], ["id"], 20).count() == 10


def test_table(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("1")), F.array(*map(F.lit, "1234")))
    assert spark.range(1).select(render.table_lines(rows).alias("v")).first().v == ["| a | b | c |", "| --- | --- | --- |", "| 1 |  |  |", "| 1 | 2 | 3 |"]


def test_no_scores(spark):
    chunks = spark.createDataFrame([("b", "2", "cat"), ("b", "1", "dog"), ("c", "3", "cat")], "book string, id string, text string")
    queries = spark.createDataFrame([("q", "b", "cat"), ("none", "b", "bird"), ("empty", "b", "!")], "query_id string, book string, query string")
    got = [(r.query_id, r.id, r["rank"]) for r in retrieval.top_k(chunks, queries, 2).orderBy("query_id", "rank").collect()]
    assert got == [("none", "1", 1), ("none", "2", 2), ("q", "2", 1), ("q", "1", 2)]


def test_fallback(spark):
    rows = spark.createDataFrame([("b", "frontmatter", "x"), ("b", "backmatter", "y"), ("c", "frontmatter", "x")], "book string, kind string, classify_reason string")
    got = sorted((r.book, r.kind, r.classify_reason) for r in classify.ensure_main(rows).collect())
    assert got == [("b", "frontmatter", "x"), ("b", "main", "fallback:no_main_detected"), ("c", "frontmatter", "x")]


def test_equal_scores_go_to_the_smaller_id_in_whatever_order_they_are_summed(spark):
    """Every chunk has the same counts, each of another term: the true scores are equal, sums of doubles are not."""
    terms = ["ash", "birch", "cedar", "elm", "fir"]
    counts = list(permutations([1, 2, 3, 5, 7]))
    chunks = spark.createDataFrame([("b", i, " ".join(" ".join([t] * n) for t, n in zip(terms, c, strict=True))) for i, c in enumerate(counts)], "book string, id long, text string")
    queries = spark.createDataFrame([("q", "b", " ".join(terms))], "query_id string, book string, query string")
    got = retrieval.top_k(chunks, queries, 40).orderBy("rank").collect()
    assert [r.id for r in got] == list(range(40))
    assert len({r.score for r in got}) == 1
