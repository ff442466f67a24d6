"""The corpus pipeline's stages against plain versions of them."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out, docs = {}, table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def shingles(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_columns_and_order(stages, spark, sf):
    names = table(spark, sf, "documents").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "encode"]
    assert all(after.columns == names for name, (_, after) in stages.items() if name != "encode")


def test_quality_keeps_good(stages, spark, sf):
    labels = table(spark, sf, "labels")
    kept = {r.doc_id for r in stages["quality"][1].collect()}
    rows = labels.collect()
    assert np.mean([(r.doc_id in kept) == (r.quality == 1) for r in rows]) > 0.9


def test_no_text_without_words_passes_quality(spark, sf):
    docs = table(spark, sf, "documents")
    more = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, " \n", "en", "s", 0), (None, "a | b | c", None, None, None)], docs.schema)
    stage = dict(corpus_pipeline.STAGES)["quality"]
    assert stage(spark, docs.unionByName(more), sf).where("doc_id < 0 or doc_id is null").count() == 0


def test_one_of_each_group_stays(stages):
    before, after = ({r.doc_id: shingles(r.text) for r in t.collect()} for t in stages["near_duplicates"])
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    ids = sorted(after)
    assert not any(alike(after[a], after[b]) for k, a in enumerate(ids) for b in ids[:k])
    for gone in set(before) - set(after):
        assert any(len(before[gone] & s) >= 0.5 * len(before[gone] | s) for i, s in before.items() if i != gone)


def test_no_benchmark_left(stages, spark, sf):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[k : k + 10]) for r in table(spark, sf, "benchmark").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in stages["decontaminate"])
    hit = {i for i, t in before.items() if any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t))))}
    assert all(after[i] == t for i, t in before.items() if i not in hit)
    assert not any(tuple(words(t)[k : k + 10]) in windows for t in after.values() for k in range(len(words(t))))


def test_personal_data_is_masked(stages):
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in stages["personal_data"])
    assert set(before) == set(after)
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w|\+[0-9] \([0-9]{3}\) 555", t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not re.search("[0-9@]", t))


def test_ids_spell_the_text(stages, spark, sf):
    from quire.llm import pieces, queries

    before, after = stages["encode"]
    spelled = pieces.decode(after, queries.tokenizer_path("piece_bpe_32k.model")).select("doc_id", "decoded").join(before, "doc_id")
    assert spelled.count() == before.count() and spelled.where(F.col("decoded") != F.col("text")).count() == 0


def test_odd_rows_pass_every_stage(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 20_000, None, "s", 1), (3, "Plain words that make up a little text, and nothing more than that.", "en", "s", 5)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= len(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
