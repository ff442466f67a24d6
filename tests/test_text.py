from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from quire.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def of(spark, f, *args):
    return value(spark, f(*[F.lit(a) for a in args]))


@pytest.mark.parametrize(
    ("text", "want"),
    [("中 文 字 符", "中文字符"), ("中文 and English 混排", "中文 and English 混排"), ("你好 ， 世界", "你好，世界"), ("a​b", "ab"), ("　a  b\t\n", "a b"), ("\u001cx", "\u001cx"), ("", ""), (" \n", "")],
)
def test_normalize_paragraph(spark, text, want):
    assert of(spark, T.normalize_paragraph, text) == want


@pytest.mark.parametrize(("last", "text", "want"), [("中文", "字符", False), ("inter-", "national", True), ("Hello.", "world", False), ("continued", "line", True), ("continued", "Line", False), ("中-", "x", True), ("", "x", False)])
def test_should_merge(spark, last, text, want):
    assert of(spark, T.should_merge, last, text) is want


def test_merge(spark):
    assert of(spark, T.merge, "inter-", " national") == "international"
    assert of(spark, T.merge, "a--", "b") == "a-b"
    assert of(spark, T.merge, "one", "two") == "one two"
    assert of(spark, T.merge, "中", "文") == "中文"


@pytest.mark.parametrize(
    ("text", "want"),
    [("Contents .... 1", True), ("Chapter 1", True), ("Part I", False), ("Part i", True), ("Contents", True), ("目录", True), ("第一章 概论 5", True), ("第一章 概论", False), ("A · · b (12)", True), ("Chapter one", False), ("1999 was a year", False), ("", False), ("Section xii", True), ("Section xiii", False)],
)
def test_toc_residue(spark, text, want):
    assert of(spark, T.is_toc_residue, text) is want


def test_tokens(spark):
    assert of(spark, T.estimate_tokens, " abcde ", "en") == 2
    assert of(spark, T.estimate_tokens, "中文字", "zh-CN") == 3
    assert of(spark, T.estimate_tokens, "  ", "en") == 0
    assert of(spark, T.estimate_tokens, "abc", None) == 1


def test_sentences(spark):
    assert of(spark, T.split_sentences, "One. Two! 3.14; end") == ["One.", "Two!", "3.", "14;", "end"]
    assert of(spark, T.split_sentences, "你好。世界？\n\nx") == ["你好。", "世界？", "x"]
    assert of(spark, T.split_sentences, " ") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("Hello World2", ["hello", "world2"]), ("café 한글", ["caf", "é", "한", "글"]), ("中文字", ["中", "文", "字", "中文", "文字"]), ("中a文", ["中", "a", "文"]), ("!?", []), ("日本 x", ["日", "本", "日本", "x"])],
)
def test_tokenize(spark, text, want):
    assert of(spark, T.tokenize, text) == want


def test_split_long(spark):
    pieces = of(spark, lambda t: T.split_long(t, 12, 15), "Aaaa. Bbbb. Cccc. Dddd.")
    assert pieces == ["Aaaa. Bbbb.", "Cccc. Dddd."]
    assert of(spark, lambda t: T.split_long(t, 12, 15), "x" * 40) == ["x" * 40]


def test_percentile(spark):
    five = F.array(*map(F.lit, [1, 2, 3, 4, 5]))
    assert value(spark, T.percentile(five, 90)) == 4
    assert value(spark, T.percentile(five, 100)) == 5
    assert value(spark, T.percentile(five, 0)) == 1
    assert value(spark, T.percentile(F.array().cast("array<int>"), 50)) == 0


def test_names(spark):
    assert of(spark, T.safe_name, ' a/b:c*?"<>|d ') == "a_b_c______d"
    assert of(spark, lambda p: T.output_name(p, "-rag.md"), "/books/A.b.epub") == "A.b-rag.md"
    assert of(spark, lambda p: T.output_name(p, ".md"), "/x/.epub") == "book.md"


def test_notes(spark):
    assert of(spark, T.clean_note, "↩ a note") == "a note"
    assert of(spark, T.clean_note, "^x") == "x"
    assert of(spark, T.note_labels, "a[^1] b[^2] c[^1]") == ["1", "2"]
    assert of(spark, T.fragment, "a.html# x #y") == "x #y"
    assert of(spark, T.fragment, "a.html") == ""


def test_heading_path(spark):
    path = F.array().cast("array<string>")
    for heading, level in (("## A", 2), ("## B", 2), ("### C", 3), ("# D", 1)):
        path = T.push_heading(path, F.lit(heading), F.lit(level))
    assert value(spark, path) == ["# D"]
    two = T.push_heading(T.push_heading(F.array().cast("array<string>"), F.lit("## A"), F.lit(2)), F.lit("## B"), F.lit(2))
    assert value(spark, two) == ["## A", "## B"]
