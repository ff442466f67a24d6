"""Registered queries by name, and the SQL whose rows they must equal.

The tables hold no archives: a document is a chapter whose lines are paragraphs, its source is a book; pages are
documents of a spine; conversations are books of short chapters. Operators that need contents entries, headings or
notes get them from the rows themselves, by rules that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as T
from quire.operators import blocks, chunk, classify, diagnostics, render, retrieval
from quire.sources import epub, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "document_stats"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where a scan gives fewer partitions than there are, as a single small file does."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def document_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normalised main chapter a document; books are sources."""
    docs = spread(table(spark, sf_dir, "documents"))
    raw = docs.select(
        F.col("source").alias("book"),
        F.format_string("doc-%d", "doc_id").alias("id"),
        F.format_string("Document %d", "doc_id").alias("title"),
        F.col("doc_id").cast("int").alias("order"),
        F.lit("main").alias("kind"),
        F.lit("default:no_signal").alias("classify_reason"),
        F.format_string("%d.xhtml", "doc_id").alias("source_ref"),
        blocks.paragraphs(F.split("text", "\n", -1)).alias("blocks"),
        F.array().cast(blocks.NOTES).alias("footnotes"),
        F.array().cast("array<string>").alias("warnings"),
        F.lit(0).alias("cross_file_notes"),
    )
    return blocks.normalize_chapters(raw)


def source_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book")).agg(F.min("lang").alias("language"))
    return names.select("book", F.col("book").alias("title"), "language", F.concat("book", F.lit(".epub")).alias("source_path"), F.sha2("book", 256).alias("source_sha256"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.build_chunks(source_books(spark, sf_dir), document_chapters(spark, sf_dir))


# SQL that the oracles share. RE2 knows the white space only by code points.
WS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
ENDS = ".!?;\\n。！？；"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_line(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_trim(x)}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '{WS}+', ' ', 'g'))"


def sql_marker(x: str) -> str:
    return f"regexp_matches(regexp_replace(regexp_extract({x}, '(\\S+)\\s*$', 1), '^[.·•\\-—_()\\[\\]]+|[.·•\\-—_()\\[\\]]+$', '', 'g'), '^([0-9]+|i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)$')"


def sql_residue(x: str) -> str:
    return f"(lower({x}) in ('toc', 'contents', 'table of contents', '目录', '目次') or ({sql_marker(x)} and (contains({x}, '....') or contains({x}, '．．') or contains({x}, '· ·') or regexp_matches(lower({x}), '^(chapter |part |book |section )|^第.*[章节]'))))"


def sql_sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({sql_trim(x)}, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+$'), lambda s: {sql_trim('s')}), lambda s: s <> '')"


def sql_pieces(x: str, target: int = 1200, most: int = 1700) -> str:
    """Pieces of a long text, as a list."""
    full = f"acc.o <> '' and length(acc.o) + 1 + length(s) > {target}"
    fold = f"""list_reduce({sql_sentences(x)}, lambda acc, s: {{
        'o': case when acc.o = '' or ({full}) then s else acc.o || ' ' || s end,
        'd': case when {full} then list_append(acc.d, acc.o) else acc.d end}}, {{'o': '', 'd': []::varchar[]}})"""
    wrapped = f"list_transform([{fold}], lambda r: case when r.o = '' then r.d else list_append(r.d, r.o) end)[1]"
    return f"case when length({x}) <= {most} or len({sql_sentences(x)}) <= 1 then [{x}] else {wrapped} end"


KEPT_LINES = f"""
    lines as (
        select doc_id, lang, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents
    ),
    clean as (select *, {sql_line("raw")} as line from lines),
    full_lines as (select * from clean where line <> ''),
    kept as (
        select * from (select *, lag(line) over (partition by doc_id order by pos) as before from full_lines) where before is null or before <> line
    )"""
CHUNKS = f"""
    {KEPT_LINES},
    unit_lists as (
        select doc_id, any_value(source) as source, flatten(list({sql_pieces("line")} order by pos)) as units, count(*) as n_blocks from kept group by doc_id
    ),
    packed as (
        select doc_id, source, n_blocks, list_reduce(units, lambda acc, x: case
            when length(case when acc.o = '' or (length(acc.o) + 2 + length(x) > 1700 and length(acc.o) >= 500) then x else acc.o || chr(10) || chr(10) || x end) >= 1200
            then {{'d': list_append(case when acc.o <> '' and length(acc.o) + 2 + length(x) > 1700 and length(acc.o) >= 500 then list_append(acc.d, acc.o) else acc.d end,
                    case when acc.o = '' or (length(acc.o) + 2 + length(x) > 1700 and length(acc.o) >= 500) then x else acc.o || chr(10) || chr(10) || x end), 'o': ''}}
            else {{'d': case when acc.o <> '' and length(acc.o) + 2 + length(x) > 1700 and length(acc.o) >= 500 then list_append(acc.d, acc.o) else acc.d end,
                'o': case when acc.o = '' or (length(acc.o) + 2 + length(x) > 1700 and length(acc.o) >= 500) then x else acc.o || chr(10) || chr(10) || x end}} end,
            {{'d': []::varchar[], 'o': ''}}) as r
        from unit_lists
    ),
    chunk_rows as (
        select doc_id, source, n_blocks, unnest(case when r.o = '' then r.d else list_append(r.d, r.o) end) as text,
            generate_subscripts(case when r.o = '' then r.d else list_append(r.d, r.o) end, 1) as nth
        from packed
    )"""


@query(f"""
    with {KEPT_LINES},
    counted as (select doc_id, count(*) as n_blocks, sum(length(line)) as n_chars from kept group by doc_id),
    raw_counts as (select doc_id, count(*) as n_lines, any_value(lang) as lang from lines group by doc_id)
    select doc_id, lang, n_lines, coalesce(n_blocks, 0) as n_blocks, coalesce(n_chars, 0)::bigint as n_chars, ((coalesce(n_chars, 0) + 3) // 4)::bigint as n_tokens
    from raw_counts left join counted using (doc_id)
""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    raw = F.split("text", "\n", -1)
    clean = docs.select("doc_id", "lang", F.size(raw).cast("long").alias("n_lines"), blocks.drop_empty(F.transform(blocks.paragraphs(raw), blocks.normalize_block)).alias("blocks"))
    clean = clean.withColumn("kept", blocks.drop_repeats(F.col("blocks")))
    n_chars = F.aggregate("kept", F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    out = clean.select("doc_id", "lang", "n_lines", F.size("kept").cast("long").alias("n_blocks"), n_chars.alias("n_chars"))
    return out.withColumn("n_tokens", F.floor((F.col("n_chars") + 3) / 4).cast("long"))


@query(f"with {KEPT_LINES} select doc_id, pos, line from clean")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spread(table(spark, sf_dir, "documents"))).select("doc_id", F.col("pos").cast("long").alias("pos"), T.normalize_paragraph(F.col("line")).alias("line"))


@query(f"with {KEPT_LINES} select doc_id, pos, line from kept")
def dedupe_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraph blocks whose level is their place, normalised, without empty ones and repeats."""
    made = blocks.paragraphs(F.split("text", "\n", -1))
    placed = F.transform(made, lambda b, k: b.withField("level", k))
    docs = blocks.settled(spread(table(spark, sf_dir, "documents")).select("doc_id", blocks.drop_empty(F.transform(placed, blocks.normalize_block)).alias("blocks")))
    kept = docs.select("doc_id", F.explode(blocks.drop_repeats(F.col("blocks"))).alias("b"))
    return kept.select("doc_id", F.col("b.level").cast("long").alias("pos"), F.col("b.text").alias("line"))


@query(f"""
    with {KEPT_LINES},
    halves as (
        select doc_id, pos * 2 + h as pos, {sql_trim("case h when 0 then substr(raw, 1, length(raw) // 2) else substr(raw, length(raw) // 2 + 1) end")} as line
        from lines, (values (0), (1)) t(h)
    ),
    seen as (select *, lag(line) over (partition by doc_id order by pos) as before from halves where line <> ''),
    marked as (
        select *, case when coalesce(before like '%-' or (regexp_matches(before, '[\\p{{L}}\\p{{Nd}}]$') and regexp_matches(line, '^[a-z]')), false) then 0 else 1 end as fresh from seen
    ),
    islands as (select *, sum(fresh) over (partition by doc_id order by pos rows unbounded preceding) as island,
        lead(fresh) over (partition by doc_id order by pos) as next_fresh from marked)
    select doc_id, row_number() over (partition by doc_id order by min(pos)) - 1 as nth, string_agg(case when fresh = 1 or before like '%-' then '' else ' ' end
        || case when next_fresh = 0 and line like '%-' then left(line, -1) else line end, '' order by pos) as line
    from islands group by doc_id, island
""")
def merge_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut in the middle, as by a page end, each a paragraph of a web page, and put together where they go on."""
    half = lambda x: F.floor(F.length(x) / 2).cast("int")
    halves = F.flatten(F.transform(F.split("text", "\n", -1), lambda x: F.array(F.substring(x, F.lit(1), half(x)), F.substring(x, half(x) + 1, F.length(x)))))
    safe = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.array_join(F.transform(halves, lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))), "\n")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    documents = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("book"), F.lit(0).alias("spine_pos"), F.lit("x").alias("href"), page.cast("binary").alias("data"), F.array().cast("array<struct<fragment:string,title:string>>").alias("targets"), none.alias("notes"))
    parsed = epub.parse_documents(documents).select(F.col("book").cast("long").alias("doc_id"), F.posexplode("blocks").alias("nth", "b"))
    return parsed.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("b.text").alias("line"))


ENTRY = "case pos % 4 when 1 then 'Chapter ' || pos when 2 then left(line, 20) || ' .... ' || pos else line end"


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised lines, of which some read like contents entries."""
    line = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("Chapter "), F.col("pos").cast("string"))).when(F.col("pos") % 4 == 2, F.concat(F.substring("line", 1, 20), F.lit(" .... "), F.col("pos").cast("string"))).otherwise(F.col("line"))
    return normalize_lines(spark, sf_dir).select("doc_id", "pos", line.alias("line"))


@query(f"with {KEPT_LINES}, entries as (select doc_id, pos, {ENTRY} as line from clean) select doc_id, pos, {sql_residue(sql_line('line'))} as residue from entries")
def toc_residue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_lines(spark, sf_dir).select("doc_id", "pos", T.is_toc_residue(F.col("line")).alias("residue"))


@query(f"""
    with {KEPT_LINES}, entries as (select doc_id, pos, case when pos < doc_id % 4 then 'Part ' || pos || ' .... ' || pos else line end as line from clean),
    flags as (select doc_id, pos, {sql_residue(sql_line("line"))} as residue from entries),
    firsts as (select doc_id, count(*) as n, min(pos) filter (where not residue) as first_kept, count_if(residue) as n_residue from flags group by doc_id)
    select doc_id, (case when doc_id % 5 = 0 then n_residue else coalesce(first_kept, n) end)::bigint as trimmed,
        (n - case when doc_id % 5 = 0 then n_residue else coalesce(first_kept, n) end)::bigint as n_blocks from firsts
""")
def trim_leading_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that begin with contents entries; every fifth is a table of contents by its title."""
    docs = spread(table(spark, sf_dir, "documents"))
    texts = F.transform(F.split("text", "\n", -1), lambda x, k: F.when(k < F.col("doc_id") % 4, F.concat(F.lit("Part "), k.cast("string"), F.lit(" .... "), k.cast("string"))).otherwise(T.normalize_paragraph(x)))
    title = F.when(F.col("doc_id") % 5 == 0, "Table  of Contents").otherwise("One")
    trimmed = blocks.trim_residue(docs.select("doc_id", title.alias("title"), F.lit("").alias("classify_reason"), blocks.paragraphs(texts).alias("blocks")))
    return trimmed.select("doc_id", F.col("toc_trimmed").cast("long").alias("trimmed"), F.size("blocks").cast("long").alias("n_blocks"))


TITLES = ["Preface", "Contents", "Appendix", "COPYRIGHT ", "Works  Cited", "Chapter", "Foreword:", "Glossary", "Translator's Afterword", "前言", "附录", "References:", "Notes", "Index"]
_starts = lambda words: " ".join(f"when t = {w} or starts_with(t, {w} || ':') or starts_with(t, {w} || ' ') then {w}" for w in ("'" + x.replace("'", "''") + "'" for x in words))
_equals = lambda words: " ".join(f"when t = {w} then {w}" for w in ("'" + x.replace("'", "''") + "'" for x in words))


@query(f"""
    with titles as (
        select p_partkey, ([{", ".join("'" + t.replace("'", "''") + "'" for t in TITLES)}])[p_partkey % {len(TITLES)} + 1] || case when p_partkey % 3 = 0 then ' ' || p_name else '' end as title from part
    ),
    plain as (select p_partkey, title, lower(trim(regexp_replace(title, '{WS}+', ' ', 'g'))) as t from titles),
    told as (
        select *, case {_equals(classify.FRONT_EXACT)} end as fe, case {_equals(classify.BACK_EXACT)} end as be,
            case {_starts(classify.FRONT_PREFIX)} end as fp, case {_starts(classify.BACK_PREFIX)} end as bp from plain
    )
    select p_partkey, title,
        case when fe is not null then 'frontmatter' when be is not null then 'backmatter' when fp is not null then 'frontmatter' when bp is not null then 'backmatter' else 'main' end as kind,
        coalesce('title_exact:' || fe, 'title_exact:' || be, 'title_prefix:' || fp, 'title_prefix:' || bp, 'default:no_signal') as reason
    from told
""")
def classify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    title = F.concat(F.get(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % len(TITLES)).cast("int")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    chapters = parts.select("p_partkey", title.alias("title"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("classify_reason"), F.lit(None).cast("string").alias("guide_type"))
    return classify.classify(chapters).select("p_partkey", "title", "kind", F.col("classify_reason").alias("reason"))


@query("""
    with c as (select conv_id, turn, case when role = 'system' then 'frontmatter' when role = 'user' and conv_id % 2 = 0 then 'main' else 'backmatter' end as kind from conversations),
    n as (select *, count_if(kind = 'main') over (partition by conv_id) as mains from c)
    select conv_id, turn, case when mains = 0 and kind <> 'frontmatter' then 'main' else kind end as kind,
        case when mains = 0 and kind <> 'frontmatter' then 'fallback:no_main_detected' else 'given' end as reason from n
""")
def classify_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "frontmatter").when((F.col("role") == "user") & (F.col("conv_id") % 2 == 0), "main").otherwise("backmatter")
    chapters = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), F.lit("given").alias("classify_reason"))
    return classify.ensure_main(chapters, "conv_id").select("conv_id", "turn", "kind", F.col("classify_reason").alias("reason"))


@query("""
    with p as (select page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') as source_ref, page_id % 7 as book from pages),
    g as (select page_id as pos, book, regexp_replace(source_ref, '^[^/]*/', '') as href,
        (['cover', 'text', 'other', 'Notes', 'appendix:a'])[page_id % 5 + 1] as type from p where page_id % 2 = 0),
    f as (
        select p.page_id, arg_min(lower(g.type), g.pos) as guide_type
        from p join g on p.book = g.book and g.type <> 'other' and regexp_replace(g.href, '#.*$', '') <> ''
            and (regexp_replace(p.source_ref, '#.*$', '') = regexp_replace(g.href, '#.*$', '') or ends_with(regexp_replace(p.source_ref, '#.*$', ''), '/' || regexp_replace(g.href, '#.*$', '')))
        group by p.page_id
    )
    select p.page_id, guide_type from p left join f using (page_id)
""")
def guide_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("source_ref"), (F.col("page_id") % 7).alias("book"))
    kinds = F.array(*map(F.lit, ["cover", "text", "other", "Notes", "appendix:a"]))
    refs = pages.where("page_id % 2 = 0").select("book", F.col("page_id").alias("pos"), F.get(kinds, (F.col("page_id") % 5).cast("int")).alias("type"), F.regexp_replace("source_ref", "^[^/]*/", "").alias("href"))
    return classify.with_guide(pages, refs).select("page_id", "guide_type")


@query(f"""select doc_id, lang, case when lower(lang) in ('fr') then length({sql_trim("text")}) else (length({sql_trim("text")}) + 3) // 4 end as n_tokens from (select doc_id, lang, text from documents where lang <> 'fr'
    union all select doc_id, 'fr' as lang, text from documents where lang = 'fr')""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in French stand for a dense script."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "lang", T.estimate_tokens(F.col("text"), F.when(F.col("lang") == "fr", " ZH-cn").otherwise(F.col("lang"))).cast("long").alias("n_tokens"))


@query(f"select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) as nth from (select doc_id, {sql_sentences('text')} as s from documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("nth", "sentence")).select("doc_id", "sentence", (F.col("nth") + 1).cast("long").alias("nth"))


@query(f"select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as nth from (select doc_id, {sql_pieces('t')} as p from (select doc_id, {sql_trim('text')} as t from documents))")
def chunk_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(T.split_long(F.col("text"))).alias("nth", "piece")).select("doc_id", "piece", (F.col("nth") + 1).cast("long").alias("nth"))


@query(f"""with {CHUNKS}
    select source as book, 'doc-' || doc_id || '-' || lpad(nth::varchar, greatest(3, length(nth::varchar))::int, '0') as id, text, length(text) as size,
        row_number() over (partition by source order by doc_id, nth) as sequence from chunk_rows""")
def build_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).select("book", "id", "text", F.col("characterSize").cast("long").alias("size"), F.col("sequence").cast("long").alias("sequence"))


_SUMMARY = """count(*) as chunk_count, sum(size)::bigint as total_characters, min(size) as min_characters, max(size) as max_characters,
    count_if(size < 500) as short_chunks, count_if(size > 1700) as oversize_chunks, (sum(size) // count(*))::bigint as average_characters,
    (list(size order by size))[(count(*) - 1) * 50 // 100 + 1] as p50_characters, (list(size order by size))[(count(*) - 1) * 90 // 100 + 1] as p90_characters"""


@query(f"with {CHUNKS} select book, {_SUMMARY} from (select source as book, length(text) as size from chunk_rows) group by book")
def chunk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.size_summary(document_chunks(spark, sf_dir), ["book"])


@query(f"""with {CHUNKS},
    c as (select doc_id, count(*) as n, min(length(text)) as lo, max(length(text)) as hi, count_if(length(text) < 500) as short, count_if(length(text) > 1700) as oversize from chunk_rows group by doc_id),
    b as (select doc_id, count(*) as n_blocks from kept group by doc_id)
    select 'doc-' || doc_id as id, n_blocks::int as block_count, coalesce(n, 0)::int as chunk_count, coalesce(lo, 0)::int as min_characters, coalesce(hi, 0)::int as max_characters,
        concat_ws(',', case when n is null then 'chunk:no_output' end, case when short > 0 then 'chunk:short_segments' end, case when oversize > 0 then 'chunk:oversize_segments' end) as warnings
    from b left join c using (doc_id)""")
def chapter_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = document_chapters(spark, sf_dir)
    found = diagnostics.chapter_diagnostics(chapters, chunk.build_chunks(source_books(spark, sf_dir), chapters))
    return found.select("id", "block_count", "chunk_count", "min_characters", "max_characters", F.array_join("warnings", ",").alias("warnings"))


_FIVE = ", ".join(f"(list(n_chars order by n_chars))[(count(*) - 1) * {p} // 100 + 1] as p{p}" for p in (0, 25, 50, 75, 100))


@query(f"select lang, {_FIVE} from documents group by lang")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = diagnostics.five_numbers(table(spark, sf_dir, "documents"), ["lang"], "n_chars")
    return five.select("lang", *[F.col("five_numbers")[k].alias(f"p{p}") for k, p in enumerate((0, 25, 50, 75, 100))])


@query("""with r as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as spot, count(*) over (partition by source) as n from documents),
    i as (select unnest(range(0, 10)) as i)
    select distinct source, doc_id from r left join i on true where n <= 10 or spot = i * (n - 1) // 9""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.even_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 10)


@query(f"""with r as (select source, doc_id, text, row_number() over (partition by source order by doc_id) - 1 as spot, count(*) over (partition by source) as n from documents),
    i as (select unnest(range(0, 10)) as i)
    select source as book, string_agg(left({sql_trim("text")}, 100), '|' order by doc_id) as fingerprints
    from (select distinct source, doc_id, text from r left join i on true where n <= 10 or spot = i * (n - 1) // 9) group by source""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("book"), F.col("doc_id").alias("sequence"), "text")
    return diagnostics.book_fingerprints(docs).select("book", F.array_join("fingerprints", "|").alias("fingerprints"))


_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+|\\p{L}|\\p{Nd}')"


@query(f"select doc_id, len({_TERMS}) as n_terms, md5(array_to_string({_TERMS}, ' ')) as terms_md5 from documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.tokenize(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


@query(f"select source as book, term, count(*) as df from (select source, unnest(list_distinct({_TERMS})) as term from documents) group by all")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequencies(spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("book"), "text"))


def book_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("book"), F.col("doc_id").alias("id"), "text")


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, book, query, expected: benchmark items in the books whose documents hold them word for word."""
    docs, items = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    found = retrieval.containing(docs.select("doc_id", "source", "text"), items.where("text != ''"), "text", "item_id", "text").join(items, "item_id")
    ids = F.concat_ws(":", F.col("item_id").cast("string"), "source")
    return found.groupBy(ids.alias("query_id"), F.col("source").alias("book")).agg(F.min("text").alias("query"), F.sort_array(F.collect_set("doc_id")).alias("expected"))


_BM25 = f"""
    expected as (
        select item_id || ':' || source as query_id, source as book, any_value(b.text) as query, list(doc_id) as expected
        from benchmark b join documents d on contains(d.text, b.text) group by item_id, source
    ),
    c as (select source as book, doc_id as id, {_TERMS} as terms from documents),
    s as (select book, count(*) as n, avg(len(terms)) as avgdl from c group by book),
    tf as (select book, id, term, count(*) as tf, any_value(dl) as dl from (select book, id, len(terms) as dl, unnest(terms) as term from c) group by book, id, term),
    df as (select book, term, count(*) as df from tf group by book, term),
    q as (select query_id, book, unnest(regexp_extract_all(lower(query), '[a-z0-9]+|\\p{{L}}|\\p{{Nd}}')) as term from expected),
    hits as (
        select query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) as score
        from q join s using (book) join df using (book, term) join tf using (book, term) group by query_id, id
    ),
    pairs as (select query_id, c.id, coalesce(h.score, 0) as score from expected e join c using (book) left join hits h using (query_id, id)),
    ranked as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from pairs)
"""


@query(f"with {_BM25} select query_id, id, rank, round(score, 6) as score from ranked where rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.top_k(book_documents(spark, sf_dir), contained(spark, sf_dir), 5)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""with {_BM25},
    judged as (select e.query_id, max(case when list_contains(e.expected, r.id) then 1 else 0 end) as hit from expected e left join ranked r on r.query_id = e.query_id and rank <= 5 group by e.query_id)
    select count(*) as queries, sum(hit)::bigint as hits, avg(hit::double) as recall from judged""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = contained(spark, sf_dir)
    return retrieval.recall(retrieval.top_k(book_documents(spark, sf_dir), queries, 5), queries)


_NOTED = "text || ' [^' || (turn % 3 + 1) || '] and [^' || (turn % 2 + 1) || '] then [^' || (turn % 3 + 1) || '] or [^9]'"


def noted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that cite notes of their conversation; each conversation has notes 1 to 5."""
    mark = lambda n: F.concat(F.lit("[^"), (F.col("turn") % n + 1).cast("string"), F.lit("]"))
    text = F.concat("text", F.lit(" "), mark(3), F.lit(" and "), mark(2), F.lit(" then "), mark(3), F.lit(" or [^9]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


@query(f"""with t as (select conv_id, turn, regexp_extract_all({_NOTED}, '\\[\\^([^\\]]+)\\]', 1) as labels from conversations),
    u as (select conv_id, turn, unnest(labels) as label, generate_subscripts(labels, 1) as spot from t),
    d as (select conv_id, turn, label, min(spot) as spot from u where label between '1' and '5' group by all)
    select conv_id, turn, string_agg('[^' || label || ']: note ' || label || ' of ' || conv_id, chr(10) order by spot) as notes from d group by conv_id, turn""")
def footnote_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = noted_turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.note_labels(F.col("text"))).alias("at", "label"))
    notes = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, "12345"))).alias("label"))
    notes = notes.withColumn("content", F.concat(F.lit("note "), "label", F.lit(" of "), F.col("conv_id").cast("string")))
    line = F.concat(F.lit("[^"), "label", F.lit("]: "), "content")
    cited = turns.join(notes, ["conv_id", "label"]).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return cited.select("conv_id", "turn", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("notes"))


@query(f"""with t as (select conv_id, unnest(regexp_extract_all({_NOTED}, '\\[\\^([^\\]]+)\\]', 1)) as label from conversations),
    n as (select distinct conv_id, unnest(['1', '2', '3', '4', '5']) as label from conversations)
    select conv_id, label from n where not exists (select 1 from t where t.conv_id = n.conv_id and t.label = n.label)""")
def orphan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = noted_turns(spark, sf_dir).select("conv_id", F.explode(T.note_labels(F.col("text"))).alias("label"))
    notes = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, "12345"))).alias("label"))
    return notes.join(cited, ["conv_id", "label"], "left_anti")


@query("""with h as (select conv_id, list({'h': repeat('#', (turn * 7 % 3 + 1)::int) || ' ' || role, 'n': (turn * 7 % 3 + 1)::int} order by turn) as hs from conversations group by conv_id)
    select conv_id, array_to_string(list_reduce(hs, lambda p, x: case when len(p) > 0 and p[-1] = x.h then p
        else list_append(case when len(p) >= x.n then p[1:x.n - 1] else p end, x.h) end, []::varchar[]), ' > ') as path from h""")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.col("turn") * 7 % 3 + 1).cast("int")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("n"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "role").alias("h"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "n", "h"))).alias("t"))
    path = chunk.heading_path(F.transform("t", lambda x: x["n"]), F.transform("t", lambda x: x["h"]))
    return gathered.select("conv_id", F.array_join(path, " > ").alias("path"))


@query("""select page_id, case when b = '' then 'book' else b end || '-rag.md' as name
    from (select page_id, trim(translate(regexp_replace(regexp_extract(replace(url, '/', ':'), '([^/]*)$', 1), '\\.[^./]*$', ''), '/\\:*?"<>|', '_________')) as b from pages)""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.output_name(F.translate("url", "/", ":"), "-rag.md").alias("name"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame([(r.page_id, k, *x) for k, x in enumerate(markup.links_of("page.html", r.html))], columns=["page_id", "k", "href", "fragment", "title"])

    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).mapInPandas(run, "page_id long, k int, href string, fragment string, title string")


_LINKS = """l as (select page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]+</a>')) as a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]+</a>'), 1) - 1 as k from pages),
    links as (select page_id, k, regexp_extract(a, '"([^"#]*)', 1) as href, replace(replace(replace(replace(regexp_extract(a, '>([^<]+)<', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') as title from l)"""


@query(f"with {_LINKS} select page_id, k, href, title from links")
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir).select("page_id", F.col("k").cast("long").alias("k"), "href", "title")


@query(f"""with {_LINKS}, f as (select page_id % 10 as book, href, title, min({{'p': page_id, 'k': k}}) as place from links group by all)
    select book, href, title, row_number() over (partition by book order by place.p, place.k) as play_order from f""")
def toc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten books whose contents are the links of their pages; repeated targets count at their first place."""
    rows = page_links(spark, sf_dir).select((F.col("page_id") % 10).alias("book"), F.col("page_id").alias("pos"), F.lit("nav").alias("how"), "k", "href", "fragment", "title")
    return epub.merge_targets(rows).select("book", "href", "title", F.col("play_order").cast("long").alias("play_order"))


@query("""with k as (select conv_id, role from conversations)
    select conv_id % 20 as book, count_if(role = 'user')::int as chapter_count, count_if(role = 'system')::int as front_matter_count, count_if(role = 'assistant')::int as back_matter_count from k group by 1""")
def book_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"user": "main", "system": "frontmatter", "assistant": "backmatter"}
    kind = F.coalesce(*[F.when(F.col("role") == r, k) for r, k in kinds.items()])
    chapters = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("book"), kind.alias("kind"), F.array().cast(blocks.NOTES).alias("footnotes"))
    return diagnostics.book_stats(chapters.select("book").distinct(), chapters).drop("footnote_count", "chunk_count")


def page_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of pages, each a document of one spine."""
    documents = spread(table(spark, sf_dir, "pages")).select(
        F.lit("pages").alias("book"),
        F.col("page_id").cast("int").alias("spine_pos"),
        F.format_string("%d.html", "page_id").alias("href"),
        F.col("html").cast("binary").alias("data"),
        F.array().cast("array<struct<fragment:string,title:string>>").alias("targets"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("notes"),
    )
    parsed = epub.parse_documents(documents).withColumn("id", F.format_string("page-%d", "spine_pos")).withColumn("order", F.col("spine_pos")).withColumn("toc_trimmed", F.lit(0))
    return blocks.normalize_chapters(classify.classify(parsed.withColumn("guide_type", F.lit(None).cast("string"))))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_chapters(spark, sf_dir).select("id", "title", "kind", F.posexplode("blocks").alias("pos", "b")).select("id", "title", "kind", "pos", "b.kind", "b.text", "b.level", F.array_join("b.items", "|").alias("items")).toDF("id", "title", "chapter_kind", "pos", "kind", "text", "level", "items")


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_chapters(page_chapters(spark, sf_dir)).select("id", "markdown")


@query(f"""with {CHUNKS}, s as (select source as book, length(text) as size from chunk_rows),
    five as (select book, {", ".join(f"(list(size order by size))[(count(*) - 1) * {p} // 100 + 1]::varchar as p{p}" for p in (0, 25, 50, 75, 100))}, count(*)::int as chunk_count from s group by book),
    t as (select source as book, string_agg('Document ' || doc_id, '|' order by doc_id) as titles, count(*)::int as chapter_count from (select distinct source, doc_id from kept) group by source)
    select book, book || '.epub' as file_name, chapter_count, chunk_count, titles, concat_ws(',', p0, p25, p50, p75, p100) as five_numbers from five join t using (book)""")
def regression_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, chapters = source_books(spark, sf_dir), document_chapters(spark, sf_dir)
    made = diagnostics.regression_snapshot(books, chapters, chunk.build_chunks(books, chapters))
    numbers = F.array_join(F.transform("five_numbers", lambda x: x.cast("string")), ",")
    return made.select("book", "file_name", "chapter_count", "chunk_count", F.array_join("chapter_titles", "|").alias("titles"), numbers.alias("five_numbers"))


@query(f"""with {KEPT_LINES} select doc_id, '# Document ' || doc_id || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) order by pos) || chr(10) as markdown from kept group by doc_id""")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_chapters(document_chapters(spark, sf_dir)).select(F.regexp_extract("id", "([0-9]+)", 1).cast("long").alias("doc_id"), "markdown")


def order_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of orders: an item a line (ids repeat), a spine of ids that may be unknown."""
    item = F.struct((F.col("l_suppkey") % 5).cast("string").alias("id"), F.format_string("f%d.html", "l_linenumber").alias("href"), F.lit("").alias("media_type"), F.lit("").alias("properties"))
    place = F.struct("l_linenumber", item.alias("item"), (F.col("l_partkey") % 7).cast("string").alias("ref"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("book")).agg(F.sort_array(F.collect_list(place)).alias("lines"))
    manifest, spine = F.transform("lines", lambda x: x["item"]), F.transform("lines", lambda x: x["ref"])
    entries = F.transform(manifest, lambda i: F.struct(i["href"].alias("name"), i["href"].cast("binary").alias("data")))
    return lines.select("book", manifest.alias("manifest"), spine.alias("spine"), F.array_distinct(entries).alias("entries"))


_PACKAGES = """m as (select l_orderkey as book, (l_suppkey % 5)::varchar as id, arg_max('f' || l_linenumber || '.html', {'n': l_linenumber, 'i': (l_suppkey % 5)::varchar, 'r': (l_partkey % 7)::varchar}) as href from lineitem group by all),
    s as (select l_orderkey as book, (l_partkey % 7)::varchar as id, row_number() over (partition by l_orderkey order by l_linenumber, (l_suppkey % 5)::varchar, (l_partkey % 7)::varchar) - 1 as spine_pos from lineitem)"""


@query(f"with {_PACKAGES} select book, id, href from m")
def manifest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epub.manifest(order_packages(spark, sf_dir)).select("book", "id", "href")


@query(f"with {_PACKAGES} select book, spine_pos, href from s join m using (book, id)")
def spine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = epub.spine_documents(order_packages(spark, sf_dir))
    return found.select("book", F.col("spine_pos").cast("long").alias("spine_pos"), "href")


@query("""select page_id, lower(trim(m)) in ('application/xhtml+xml', 'text/html') or regexp_matches(lower(h), '\\.(xhtml|html|htm)$') as is_document
    from (select page_id, (['', ' Text/HTML', 'image/png'])[page_id % 3 + 1] as m, url || (['', '.HTM', '.xhtml', '.css'])[page_id % 4 + 1] as h from pages)""")
def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int"))
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", epub.is_document(pick(["", " Text/HTML", "image/png"]), F.concat("url", pick(["", ".HTM", ".xhtml", ".css"]))).alias("is_document"))


@query(f"""select c_custkey, lower({sql_trim("regexp_replace('  ' || c_name || chr(9) || ' OF ' || c_mktsegment || ' ', '" + WS + "+', ' ', 'g')")}) as title,
        {sql_trim("translate(c_name || '/' || c_mktsegment || ':*?', '/\\:*?\"<>|', '_________')")} as safe, '^' || c_name as note, c_name as stem, c_mktsegment as fragment, c_mktsegment as first, left(c_name, 5) as beginning
    from customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        T.normalize_title(text("  ", name, "\t OF ", segment, " ")).alias("title"),
        T.safe_name(text(name, "/", segment, ":*?")).alias("safe"),
        T.clean_note(text("\u21a9^^", name)).alias("note"),
        T.without_extension(text(name, ".epub")).alias("stem"),
        T.fragment(text("a.html# ", segment)).alias("fragment"),
        T.first_non_empty(F.array(F.lit(" "), F.lit(""), text(" ", segment), name)).alias("first"),
        T.fingerprint(text("\n ", name), 5).alias("beginning"),
    )


@query(f"""with {CHUNKS}
    select source as book, 'doc-' || doc_id || '-' || lpad(nth::varchar, greatest(3, length(nth::varchar))::int, '0') as id, text, length(text) as size from chunk_rows""")
def chunk_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as JSON lines without empty fields, and read again."""
    lines = files.chunk_lines(document_chunks(spark, sf_dir))
    back = F.from_json("line", files.CHUNK)
    return lines.select("book", back.alias("c")).select("book", "c.id", "c.text", F.col("c.characterSize").cast("long").alias("size"))
