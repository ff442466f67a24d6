"""Text functions on columns: normalising, testing, splitting and counting, all in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes. CJK letters and marks are the ranges that results depend on; Hangul is not in them.
CJK = "\\u2E80-\\u9FFF"
CJK_MARKS = "\\u3000-\\u303F\\uFF00-\\uFFEF"
SENTENCE_ENDS = ".!?;\\n。！？；"
PARAGRAPH_ENDS = ".!?:;,)\\]\"'。！？；：，、"
TOC_NAMES = ["toc", "contents", "table of contents", "目录", "目次"]
UNSAFE_NAME_CHARS = '/\\:*?"<>|'
NOTE_REF = r"\[\^([^\]]+)\]"

#: White space at either end, Unicode's included; Spark's trim knows only the space. U+001C to U+001F stay.
SPACE = "[\\t-\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
HIDDEN = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize_paragraph(text: Column) -> Column:
    """One line of text: no invisible characters, single spaces, and none between CJK letters or marks."""
    plain = F.translate(trim(text), HIDDEN, "")
    single = trim(F.regexp_replace(plain, f"{SPACE}+", " "))
    wide = f"[{CJK}{CJK_MARKS}]"
    return F.regexp_replace(single, f"(?<={wide}) (?={wide})", "")


def normalize_inline(text: Column) -> Column:
    """Text between tags, entities already resolved: no invisible characters, single spaces (ASCII white space only)."""
    plain = F.regexp_replace(F.translate(text, HIDDEN, ""), "[\\u00A0\\u3000]", " ")
    return trim(F.regexp_replace(plain, r"[\t\n\f\r ]+", " "))


def normalize_title(title: Column) -> Column:
    return F.lower(trim(F.regexp_replace(title, rf"{SPACE}+", " ")))


def contains_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def has_page_marker(text: Column) -> Column:
    """Whether the last word, without the marks around it, is a number or a small roman numeral."""
    last = F.regexp_extract(text, r"(\S+)\s*\z", 1)
    bare = F.regexp_replace(last, r"^[.·•\-—_()\[\]]+|[.·•\-—_()\[\]]+\z", "")
    return bare.rlike(r"^(?:[0-9]+|i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)\z")


def is_toc_residue(text: Column) -> Column:
    """Whether a line reads like an entry of a table of contents."""

    def entry(line: Column) -> Column:
        lower = F.lower(line)
        led = line.contains("....") | line.contains("．．") | line.contains("· ·")
        labelled = lower.rlike(r"^(?:chapter |part |book |section )|^第.*[章节]")
        return lower.isin(*TOC_NAMES) | ((led | labelled) & has_page_marker(line))

    return let(normalize_paragraph(text), entry)


def estimate_tokens(text: Column, language: Column) -> Column:
    """Tokens a text takes: one a character in Chinese, Japanese and Korean, else one in four, rounded up."""
    n = F.length(trim(text))
    dense = F.lower(trim(F.coalesce(language, F.lit("")))).rlike("^(?:zh|ja|ko)")
    return F.when(dense, n).otherwise(F.floor((n + 3) / 4)).cast("int")


def split_sentences(text: Column) -> Column:
    """Sentences with the mark that ends them; empty ones are left out."""
    cut = F.regexp_extract_all(trim(text), F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]|[^{SENTENCE_ENDS}]+\\z"), F.lit(0))
    return F.filter(F.transform(cut, trim), lambda s: s != "")


def should_merge(last: Column, text: Column) -> Column:
    """Whether a paragraph goes on in the next one: after a hyphen, or from a word to a small letter; never across CJK."""
    a, b = trim(last), trim(text)
    runs_on = a.rlike(r"[\p{L}\p{Nd}]\z") & b.rlike("^[a-z]") & ~contains_cjk(a) & ~contains_cjk(b)
    return (a != "") & (b != "") & (a.endswith("-") | runs_on)


def merge(last: Column, text: Column) -> Column:
    """Two paragraphs as one: without the hyphen between them, or with a space unless CJK meets."""
    wide = f"[{CJK}{CJK_MARKS}]"
    close = last.rlike(f"{wide}\\z") & text.rlike(f"^{wide}")
    joined = F.concat(last, F.when(close, "").otherwise(" "), text)
    return F.when(last.endswith("-"), F.concat(F.regexp_replace(last, r"-\z", ""), F.regexp_replace(text, "^ +", ""))).otherwise(joined)


def tokenize(text: Column) -> Column:
    """Search terms: runs of ASCII letters and digits, CJK characters followed by the pairs of their run, other letters alone.

    An accented or other letter outside both scripts ends an ASCII run but not a CJK run.
    """
    lower = F.lower(text)
    latin = F.regexp_extract_all(lower, F.lit(r"[a-z0-9]+|[\p{L}\p{Nd}]"), F.lit(0))
    return F.when(~lower.rlike(f"[{CJK}]"), latin).otherwise(_tokenize_cjk(lower))


def _tokenize_cjk(lower: Column) -> Column:
    """Pieces between what ends a CJK run; in each, its other terms in place and the CJK run's terms where the run ends."""
    word = rf"[a-z0-9]+|[\p{{L}}\p{{Nd}}&&[^a-z0-9{CJK}]]|[\p{{L}}\p{{Nd}}&&[{CJK}]]+"
    found = F.regexp_extract_all(lower, F.lit(word), F.lit(0))

    def terms(w: Column) -> Column:
        n = F.length(w)
        singles = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(w, k, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.substring(w, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(w.rlike(f"^[{CJK}]"), F.concat(singles, pairs)).otherwise(F.array(w))

    return F.flatten(F.transform(found, terms))


def first_non_empty(values: Column) -> Column:
    return F.coalesce(F.get(non_empty(values), F.lit(0)), F.lit(""))


def non_empty(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), trim), lambda x: x != "")


def fragment(href: Column) -> Column:
    """What follows the first # of a link, trimmed; empty without one."""
    return trim(F.regexp_extract(href, r"(?s)^[^#]*#(.*)\z", 1))


def clean_note(content: Column) -> Column:
    """A note without one leading return mark of each kind."""
    return trim(F.regexp_replace(normalize_paragraph(content), r"^↩?↑?\^?", ""))


def note_labels(text: Column) -> Column:
    """Labels of the notes that a text refers to, in order of first reference."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NOTE_REF), F.lit(1)))


def fingerprint(text: Column, size: int = 100) -> Column:
    return F.substring(trim(text), 1, size)


def safe_name(name: Column) -> Column:
    """A name without the characters that file systems refuse."""
    return trim(F.translate(name, UNSAFE_NAME_CHARS, "_" * len(UNSAFE_NAME_CHARS)))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*\z", "")


def output_name(path: Column, suffix: str) -> Column:
    """File name for an output: the last part of a path without its extension, made safe, `book` if nothing is left."""
    base = safe_name(without_extension(F.regexp_extract(path, r"([^/]*)\z", 1)))
    return F.concat(F.when(base == "", "book").otherwise(base), F.lit(suffix))


def greedy_join(sentences: Column, target: int) -> Column:
    """Sentences joined by spaces up to `target` characters, in order; a longer sentence stands alone."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("open"), none.alias("done"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + 1 + F.length(s) > target)
        return F.struct(
            F.when(full | (acc["open"] == ""), s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"),
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def split_long(text: Column, target: int = 1200, most: int = 1700) -> Column:
    """Pieces of a text: itself up to `most` characters, else its sentences joined up to `target`."""

    def pieces(whole: Column) -> Column:
        joined = let(split_sentences(whole), lambda s: F.when(F.size(s) <= 1, F.array(whole)).otherwise(greedy_join(s, target)))
        return F.when(F.length(whole) <= most, F.array(whole)).otherwise(joined)

    return let(trim(text), pieces)


def percentile(sorted_values: Column, p: int) -> Column:
    """Member at floor((n - 1) p / 100) of an ascending array; 0 if it is empty."""
    n = F.size(sorted_values)
    at = F.floor((n - 1) * max(0, min(100, p)) / 100).cast("int")
    return F.coalesce(F.get(sorted_values, F.when(n > 0, at).otherwise(F.lit(0))), F.lit(0))


def push_heading(path: Column, heading: Column, level: Column) -> Column:
    """A heading path after one more heading: cut to the level above if it is that long, then longer by the heading."""
    depth = F.greatest(level, F.lit(1))
    cut = F.when(F.size(path) >= depth, F.slice(path, F.lit(1), depth - 1)).otherwise(path)
    return F.when((F.size(path) > 0) & (F.element_at(path, -1) == heading), path).otherwise(F.concat(cut, F.array(heading)))
