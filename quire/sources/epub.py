"""EPUB archives as tables: packages, manifests, spines, guides, contents targets, notes and chapters.

Each archive is opened once, by a binary file scan, and its package is written to the shared folder; what follows are
joins on the book and a name over that table, which read only the columns they need. An archive that can't be read
becomes a row with its error and stops nothing else. Documents are parsed one row at a time, with their own contents
targets and the notes of their book beside them.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions import text as T
from quire.operators import classify
from quire.operators.blocks import BLOCKS, NOTES
from quire.sources.shared import materialise

PACKAGE = """book string, error string, source_path string, source_sha256 string, titles array<string>, creators array<string>,
    languages array<string>, publishers array<string>, dates array<string>, identifiers array<string>,
    manifest array<struct<id:string,href:string,media_type:string,properties:string>>, spine array<string>,
    guide array<struct<type:string,title:string,href:string>>, entries array<struct<name:string,data:binary>>"""
MARKUP = (".xhtml", ".html", ".htm", ".xml", ".ncx", ".opf")


def read_package(path: str, content: bytes) -> dict:
    """The parts of an archive's package. A container, a package file or an entry that can't be read is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        infos = {i.filename: i for i in archive.infolist() if not i.is_dir()}
        text = lambda name: archive.read(infos[name]).decode("utf-8-sig", "replace")
        if "META-INF/container.xml" not in infos:
            raise ValueError(f"{path} has no container")
        roots = [n.attrs["full-path"] for n in M.parse_xml(text("META-INF/container.xml")).walk() if n.tag == "rootfile" and n.attrs.get("full-path")]
        if not roots or roots[0] not in infos:
            raise ValueError(f"{path} has no package file")
        package = M.parse_xml(text(roots[0]))
        folder = posixpath.dirname(roots[0]) or "."
        told = package.first("metadata") or M.Node("metadata")
        values = lambda tag: ["".join(c.texts()) for c in told.walk() if c.tag == tag]
        items = [n.attrs for n in (package.first("manifest") or M.Node("")).walk() if n.tag == "item"]
        manifest = [{"id": a.get("id", ""), "href": M.resolve(folder, a.get("href", "")), "media_type": a.get("media-type", ""), "properties": a.get("properties", "")} for a in items]
        wanted = {m["href"] for m in manifest if m["href"] in infos and (m["href"].lower().endswith(MARKUP) or "html" in m["media_type"].lower() or "nav" in m["properties"])}
        return {
            "source_path": path,
            "source_sha256": hashlib.sha256(content).hexdigest(),
            "titles": values("title"),
            "creators": values("creator"),
            "languages": values("language"),
            "publishers": values("publisher"),
            "dates": values("date"),
            "identifiers": values("identifier"),
            "manifest": manifest,
            "spine": [n.attrs.get("idref", "") for n in (package.first("spine") or M.Node("")).walk() if n.tag == "itemref"],
            "guide": [{"type": n.attrs.get("type", ""), "title": n.attrs.get("title", ""), "href": M.resolve(folder, n.attrs.get("href", ""))} for n in (package.first("guide") or M.Node("")).walk() if n.tag == "reference"],
            "entries": [{"name": n, "data": archive.read(infos[n])} for n in sorted(wanted)],
        }


def scan(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """A row an archive; book is its path. Images and other files are not kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return packages(files)


def packages(files: DataFrame, read: Callable[[str, bytes], dict] = read_package) -> DataFrame:
    """files: path, content. An archive that can't be read has an error, and nothing else but its path and hash."""
    lists = {f.split()[0]: [] for f in ("titles", "creators", "languages", "publishers", "dates", "identifiers", "manifest", "spine", "guide", "entries")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                data = bytes(content) if content is not None else b""
                try:
                    row = {"error": None} | read(path, data)
                except Exception as e:  # whatever is wrong with one archive, the others are read
                    row = lists | {"error": f"{type(e).__name__}: {e}", "source_path": path, "source_sha256": hashlib.sha256(data).hexdigest()}
                yield pd.DataFrame([{"book": path} | row])

    return files.select("path", "content").mapInPandas(run, PACKAGE)


def books(package: DataFrame) -> DataFrame:
    """book and its metadata: the first value of each field that isn't empty, and all authors."""
    fields = {"title": "titles", "language": "languages", "publisher": "publishers", "published_date": "dates", "identifier": "identifiers"}
    return package.select("book", *[T.first_non_empty(F.col(c)).alias(n) for n, c in fields.items()], T.non_empty(F.col("creators")).alias("authors"), "source_path", "source_sha256")


def manifest(package: DataFrame) -> DataFrame:
    """book, id, href, media_type, properties, pos: of items with equal ids the last."""
    items = package.select("book", F.posexplode("manifest").alias("pos", "i")).select("book", "i.*", "pos")
    return items.groupBy("book", "id").agg(F.max_by(F.struct("href", "media_type", "properties", "pos"), "pos").alias("i")).select("book", "id", "i.*")


def spine(package: DataFrame) -> DataFrame:
    return package.select("book", F.posexplode("spine").alias("spine_pos", "id"))


def guide(package: DataFrame) -> DataFrame:
    return package.select("book", F.posexplode("guide").alias("pos", "g")).select("book", "pos", "g.*")


def entries(package: DataFrame) -> DataFrame:
    return package.select("book", F.explode("entries").alias("e")).select("book", F.col("e.name").alias("href"), F.col("e.data").alias("data"))


def is_document(media_type: Column, href: Column) -> Column:
    return F.lower(F.trim(media_type)).isin("application/xhtml+xml", "text/html") | F.lower(href).rlike(r"\.(?:xhtml|html|htm)\z")


def _decode(data: bytes) -> str:
    return bytes(data).decode("utf-8-sig", "replace")


def toc_targets(package: DataFrame) -> DataFrame:
    """book, href, fragment, title, play_order: the links of navigation documents and the points of NCX files, in the order of first sight."""
    items = package.select("book", F.posexplode("manifest").alias("pos", "i")).select("book", "pos", "i.href", "i.properties")
    nav = items.where(F.col("properties").contains("nav")).select("book", "pos", "href", F.lit("nav").alias("how"))
    ncx = items.where(F.lower("href").endswith(".ncx")).select("book", "pos", "href", F.lit("ncx").alias("how"))
    files = nav.unionByName(ncx).join(entries(package), ["book", "href"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [(r, (M.links_of if r.how == "nav" else M.nav_points_of)(r.href, _decode(r.data))) for r in frame.itertuples()]
            yield pd.DataFrame([(r.book, r.pos, r.how, k, *t) for r, found in read for k, t in enumerate(found)], columns=["book", "pos", "how", "k", "href", "fragment", "title"])

    rows = files.select("book", "pos", "how", "href", "data").mapInPandas(run, "book string, pos int, how string, k int, href string, fragment string, title string")
    return merge_targets(rows)


def merge_targets(rows: DataFrame) -> DataFrame:
    """Targets (book, pos, how, k, href, fragment, title) without repeats, numbered by their first place."""
    place = F.struct("pos", F.when(F.col("how") == "nav", 0).otherwise(1).alias("h"), "k")
    first = rows.groupBy("book", "href", "fragment", "title").agg(F.min(place).alias("place"))
    order = F.row_number().over(Window.partitionBy("book").orderBy("place"))
    return first.select("book", "href", "fragment", "title", order.alias("play_order"))


def grouped_targets(targets: DataFrame) -> DataFrame:
    """book, href, targets: a file's targets in play order."""
    in_order = F.sort_array(F.collect_list(F.struct("play_order", "fragment", "title")))
    return targets.groupBy("book", "href").agg(F.transform(in_order, lambda t: F.struct(t["fragment"].alias("fragment"), t["title"].alias("title"))).alias("targets"))


def notes(package: DataFrame) -> DataFrame:
    """book, key, source_ref, content: notes of all documents in the manifest; later items go before earlier ones."""
    items = package.select("book", F.posexplode("manifest").alias("pos", "i")).select("book", "pos", "i.*").where(is_document(F.col("media_type"), F.col("href")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [(r, M.notes_of(r.href, M.parse_html(_decode(r.data)))) for r in frame.itertuples()]
            yield pd.DataFrame([(r.book, r.pos, k, r.href, v) for r, found in read for k, v in found.items()], columns=["book", "pos", "key", "source_ref", "content"])

    rows = items.join(entries(package), ["book", "href"]).select("book", "pos", "href", "data").mapInPandas(run, "book string, pos int, key string, source_ref string, content string")
    return rows.groupBy("book", "key").agg(F.max_by(F.struct("source_ref", "content"), "pos").alias("n")).select("book", "key", "n.*")


def spine_documents(package: DataFrame) -> DataFrame:
    """book, spine_pos, href, data: the spine's files in reading order; itemrefs without an item or a file are left out."""
    return spine(package).join(manifest(package).select("book", "id", "href"), ["book", "id"]).join(entries(package), ["book", "href"])


CHAPTER = f"book string, spine_pos int, seg int, source_ref string, title string, kind string, classify_reason string, warnings array<string>, blocks {BLOCKS}, footnotes {NOTES}, cross_file_notes int"


def parse_documents(documents: DataFrame) -> DataFrame:
    """documents: book, spine_pos, href, data, targets (array of fragment, title), notes (map of key to content)."""
    spark = documents.sparkSession
    schema = spark.createDataFrame([], CHAPTER).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = M.chapters_of(r["href"], _decode(r["data"]), [(t["fragment"], t["title"]) for t in r["targets"] or []], dict(r["notes"] or []))
                rows = [{"book": r["book"], "spine_pos": r["spine_pos"], "seg": k, "source_ref": r["href"]} | c for k, c in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return documents.select("book", "spine_pos", "href", "data", "targets", "notes").mapInArrow(run, schema)


def number_chapters(parsed: DataFrame) -> DataFrame:
    """parsed chapters with order (along the spine) and id, and a title if they have none."""
    order = F.row_number().over(Window.partitionBy("book").orderBy("spine_pos", "seg"))
    out = parsed.withColumn("order", order).withColumn("id", F.format_string("chapter-%03d", "order"))
    return out.withColumn("title", F.when(F.col("title") == "", F.format_string("章节 %03d", "order")).otherwise(F.col("title"))).drop("spine_pos", "seg")


@dataclass
class Library:
    books: DataFrame
    chapters: DataFrame
    broken: DataFrame  # book, error


def read_library(spark: SparkSession, path: str, pattern: str = "*.epub") -> Library:
    """Books and their classified chapters, as parsed and not yet normalised."""
    return library_of(scan(spark, path, pattern))


def library_of(package: DataFrame) -> Library:
    stored = materialise(package, "packages")
    package, broken = stored.where("error is null"), stored.where("error is not null").select("book", "error")
    known = notes(package).groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("key", "content"))).alias("notes"))
    documents = spine_documents(package).join(grouped_targets(toc_targets(package)), ["book", "href"], "left").join(known, "book", "left")
    chapters = number_chapters(parse_documents(documents)).withColumn("toc_trimmed", F.lit(0))
    chapters = classify.ensure_main(classify.classify(classify.with_guide(chapters, guide(package))))
    return Library(books(package), chapters, broken)
