"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, licenses, neighbours, pieces, pii, quality, simhash, token_files, url_filter
from quire.llm.common import table


#: Longest dialogue that is rendered whole, in messages.
CHAT_MESSAGES = 4096


def tokenizer_path(name: str) -> str:
    """Where the machine keeps its public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[c.alias(n) for n, c in pii.digest(found).items()])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, url_filter.RULES), url_filter.listed_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    told = F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join(told, ",").alias("licences"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.rotate(table(spark, sf_dir, "conversations"), most=CHAT_MESSAGES)
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return shown.select("conv_id", "speaker", "part", F.col("n_messages").cast("long").alias("n_messages"), "rendered", masks.alias("masks"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spelled = pieces.decode(pieces.encode(docs, model, rate=0.1, seed=42), model)
    n_tokens = F.floor(F.octet_length("ids") / 2).cast("long")
    return spelled.select("doc_id", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("lossless"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_url_filter, op4_nearest_neighbours, op5_licenses, op6_quality, op7_chat_rotation, op8_sentencepiece, op9_simhash_near_dedup, op10_token_files)}
ORACLES: dict[str, str] = {
    "op3_url_filter": f"""
        with rules(rule, rule_host, rule_path, verdict) as (
            values {", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for v, h, p in url_filter.RULES)}
        ),
        rests as (
            select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
        ),
        urls as (
            select row_number() over () as n, page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
            from rests
        ),
        fits as (
            select n, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
            from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by n
        ),
        hosts(listed) as (values {", ".join(f"('{h}')" for h in url_filter.LISTED_HOSTS)}),
        folders(folder) as (values {", ".join(f"('{h}/{f}/')" for h in url_filter.PAGE_HOSTS for f in url_filter.PAGE_FOLDERS)}),
        listed_pages as (select folder || k as listed from folders, range(0, {url_filter.PAGE_END}, {url_filter.PAGE_STEP}) r(k)),
        bare as (
            select n, regexp_replace(regexp_replace(host, '^www\\.', ''), '\\.?(:[0-9]*)?\\z', '') as bare_host, regexp_replace(path, '/+\\z', '') as bare_path
            from urls
        ),
        found as (
            select n, listed from bare join hosts on bare_host = listed or ends_with(bare_host, '.' || listed)
            union all
            select n, listed from bare join listed_pages on bare_host || bare_path = listed
        ),
        longest as (select n, arg_max(listed, length(listed)) as listed from found group by n)
        select page_id, host, path, fits.rule as rule, longest.listed as listed,
            coalesce(fits.verdict, case when longest.listed is not null then 'block' else 'allow' end) as verdict
        from urls left join fits using (n) left join longest using (n)
    """,
    "op7_chat_rotation": f"""
        with d as (select distinct conv_id, turn, role, coalesce(text, '') as text from conversations),
        m as (
            select *, (row_number() over (partition by conv_id order by turn nulls last, role nulls first, text) - 1) // {CHAT_MESSAGES} as part from d
        ),
        p as (select distinct conv_id, role as speaker from m where role is distinct from 'system'),
        r as (
            select m.conv_id, speaker, part, turn, role, text, role is not distinct from speaker as own,
                '<|im_start|>' || case when role is not distinct from speaker then 'assistant' when role = 'system' then 'system'
                    else coalesce('user name=' || replace(replace(replace(role, chr(10), ' '), chr(13), ' '), '<|im_', '<| im_'), 'user') end || chr(10) as head,
                replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) as body
            from m join p on m.conv_id is not distinct from p.conv_id
        ),
        s as (
            select *, sum(length(head) + length(body)) over (
                partition by conv_id, speaker, part order by turn nulls last, role nulls first, text rows unbounded preceding) as stop
            from r
        )
        select conv_id, speaker, part, count(*) as n_messages,
            string_agg(head || body, '' order by turn nulls last, role nulls first, text) as rendered,
            coalesce(string_agg(case when own then (stop - length(body))::bigint || ':' || (stop - 1)::bigint end, ',' order by turn nulls last, role nulls first, text), '') as masks
        from s group by conv_id, speaker, part
    """,
}
