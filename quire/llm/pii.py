"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score. Native expressions only.

A kind's matches are taken with regexp_extract_all and the text between them with split, so a match's place is the
running length of both. Patterns are written so that each character is looked at a bounded number of times (possessive
quantifiers, and a start only where a run starts or the last match ended); they match what the plain forms match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the four base kinds, in their order; then the kinds that the scores add.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Lengths of account numbers by country, as the public registry of IBANs has them.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban(length: int, countries: str) -> str:
    """Country, check digits, groups of four and the rest, with or without spaces between the groups."""
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(_iban(n, c) for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Forms of keys that services give out, and names under which values are kept secret.
TOKENS = [
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"gh[pousr]_[A-Za-z0-9]{36,255}+",
    r"xox[abprs]-[A-Za-z0-9-]{10,255}+",
    r"eyJ[A-Za-z0-9_-]{8,4096}+\.[A-Za-z0-9_-]{8,4096}+\.[A-Za-z0-9_-]{8,4096}+",
]
NAMED = r"(?i:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)"
SECRET = (
    r"(?<![A-Za-z0-9+/_-])(?:"
    + "|".join(TOKENS)
    + rf"|(?=[A-Za-z0-9+/_-]{{16}})(?=[A-Za-z+/_-]*+[0-9])(?<={NAMED}[\"']?\x20?[:=]\x20?[\"']?)[A-Za-z0-9+/_-]{{16,4096}}+=*+)"
)

# Words that raise the score of a kind when they stand near it, and words that lower it.
CONTEXT = {
    "email": ["mail", "email", "contact", "write"],
    "ip": ["ip", "address", "host", "server", "login"],
    "card": ["card", "credit", "visa", "payment", "account"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"],
    "iban": ["iban", "bank", "account", "konto", "compte", "cuenta"],
    "local_phone": ["phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"],
    "national_id": ["ssn", "social", "security", "tax", "identity"],
    "secret": ["secret", "private", "credential", "auth", "login"],
}
AGAINST = {
    "email": ["example"],
    "ip": ["version", "release"],
    "card": ["order", "serial", "tracking"],
    "phone": ["order", "serial", "tracking"],
    "iban": ["example", "sample"],
    "local_phone": ["order", "invoice", "serial", "isbn", "item", "ticket", "tracking"],
    "national_id": ["order", "invoice", "serial", "isbn", "item", "ticket", "model"],
    "secret": ["example", "sample", "placeholder", "dummy"],
}


@dataclass(frozen=True)
class Kind:
    """hint: characters one of which every match has; score: that of a match that passed its check."""

    name: str
    pattern: str
    hint: str
    score: float


BASE = [Kind("email", EMAIL, "@", 0.9), Kind("ip", IP, ".", 0.7), Kind("card", CARD, "", 0.9), Kind("phone", PHONE, "+", 0.8)]
ADDED = [Kind("iban", IBAN, "", 0.9), Kind("local_phone", LOCAL_PHONE, "", 0.3), Kind("national_id", NATIONAL_ID, "-", 0.3), Kind("secret", SECRET, "", 0.7)]
CONTEXT_BONUS = 0.4
CONTEXT_MALUS = 0.2
THRESHOLD = 0.6
NEAR = 40
BLOCK = 64
CHUNK = 512

SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _mod97(c: Column) -> Column:
    """Whether an IBAN's letters and digits leave 1 modulo 97."""
    plain = F.regexp_replace(c, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda x: F.coalesce(x.try_cast("long"), (F.ascii(x) - 55).cast("long"))
    left = F.aggregate(F.split(moved, "(?!$)"), F.lit(0).cast("long"), lambda n, x: (n * F.when(x.between("0", "9"), 10).otherwise(100) + value(x)) % 97)
    return (F.length(plain).between(15, 34)) & (left == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "national_id":
        return ~m.startswith("000") & ~m.startswith("666") & ~m.startswith("9")
    return F.lit(True)


def _gather(pairs: Column, at: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Folds pairs from left to right; step gives the new `at` and an array of what comes out.

    What comes out is gathered in blocks, so that a fold over n pairs doesn't copy n arrays of up to n members.
    """
    none, blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def fold(done: Column, pair: Column) -> Column:
        new_at, more = step(done["at"], pair)
        full = F.size(done["open"]) >= BLOCK
        return F.struct(new_at.alias("at"), F.concat(F.when(full, none).otherwise(done["open"]), more).alias("open"), F.when(full, F.concat(done["full"], F.array(done["open"]))).otherwise(done["full"]).alias("full"))

    start = F.struct(at.alias("at"), none.alias("open"), blocks.alias("full"))
    return F.aggregate(pairs, start, fold, lambda done: F.concat(F.flatten(done["full"]), done["open"]))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """The characters from a to b of a text that is cut into chunks: no more than those chunks is looked at."""
    first = F.floor(a / CHUNK).cast("int")
    joined = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(a < b, F.substring(joined, a % CHUNK + 1, b - a)).otherwise("")


def _spans(found: Column, between: Column, kind: Kind, chunks: Column, size: Column) -> Column:
    """Array of the found matches of one kind that pass its check, in order; places in code points, end exclusive."""
    word = lambda words: rf"(?:^|[^\p{{L}}])(?:{'|'.join(words)})(?:[^\p{{L}}]|$)"
    none = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        m, gap = pair["m"], pair["gap"]
        begin = at + F.length(gap)
        end = begin + F.length(m)
        before, behind = F.greatest(begin - NEAR, F.lit(0)), F.least(end + NEAR, size)
        around = F.lower(F.concat(_piece(chunks, before, begin), F.lit(" | "), _piece(chunks, end, behind)))
        score = F.lit(kind.score) + F.when(around.rlike(word(CONTEXT[kind.name])), CONTEXT_BONUS).otherwise(0.0) - F.when(around.rlike(word(AGAINST[kind.name])), CONTEXT_MALUS).otherwise(0.0)
        span = F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), end.alias("end"), F.least(F.lit(1.0), score).alias("score"))
        return end, F.when(_valid(kind.name, m), F.array(span)).otherwise(none)

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    return F.when(F.size(found) > 0, _gather(pairs, F.lit(0), SPAN, step)).otherwise(none)


def find(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the column pii: an array of (kind, start, end, score), by kind, then by place.

    Words within NEAR characters on either side of a match move its score, up or down. Base kinds stay whatever their score;
    spans of added kinds stay from `threshold` on, and only where they overlap no base span (secrets stay even so). A null
    or empty text has none; very long ones are read whole. Repeated rows are treated alike, no rows give no rows. Columns
    named pii or __pii_* are replaced.
    """
    kinds = BASE + ADDED
    out = docs.withColumn("__pii_text", F.coalesce(docs[text_col].cast("string"), F.lit("")))
    out = out.withColumn("__pii_digit", F.col("__pii_text").rlike("[0-9]"))
    text = F.col("__pii_text")
    may = lambda k: (F.contains(text, F.lit(k.hint)) if k.hint else F.lit(True)) & (F.lit(True) if k.name == "email" else F.col("__pii_digit"))
    matches = lambda k: F.when(may(k), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({f"__pii_{k.name}": matches(k) for k in kinds})
    met = sum((F.size(F.col(f"__pii_{k.name}")) for k in kinds[1:]), F.size(F.col(f"__pii_{kinds[0].name}"))) > 0
    out = out.withColumns({"__pii_chunks": F.when(met, _chunks(text)), "__pii_size": F.length(text)})
    spans = lambda some: F.concat(*[_spans(F.col(f"__pii_{k.name}"), F.split(text, k.pattern, -1), k, F.col("__pii_chunks"), F.col("__pii_size")) for k in some])
    out = out.withColumns({"__pii_base": spans(BASE), "__pii_more": spans(ADDED)})
    apart = lambda s: (s["kind"] == "secret") | ~F.exists("__pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter("__pii_more", lambda s: (s["score"] >= threshold) & apart(s))
    return out.withColumn("pii", F.concat("__pii_base", more)).drop("__pii_text", "__pii_digit", "__pii_chunks", "__pii_size", "__pii_base", "__pii_more", *[f"__pii_{k.name}" for k in kinds])


def mask(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; other columns and their order stay.

    Overlapping spans count as one, under the name of the first. Null texts stay null, empty ones empty; very long ones are
    masked whole. Repeated rows are treated alike, no rows give no rows.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    body = f"c{names.index(text_col)}"
    found, text = find(plain, body, threshold), F.col(body)
    found = found.withColumn("__pii_chunks", F.when(F.size("pii") > 0, _chunks(text)))
    piece = lambda a, b: _piece(F.col("__pii_chunks"), a, b)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        more = F.array(piece(at, s["start"]), F.when(s["kind"] == "", "").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, more).otherwise(F.array().cast("array<string>"))

    size = F.length(text)
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ordered = F.concat(ordered, F.array(F.struct(size.alias("start"), size.alias("end"), F.lit("").alias("kind"))))
    new = F.array_join(_gather(ordered, F.lit(0), "string", step), "")
    return found.withColumn(body, F.when(F.size("pii") > 0, new).otherwise(text)).drop("pii", "__pii_chunks").toDF(*names)


def digest(found: DataFrame) -> dict[str, Column]:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    names = [k.name for k in BASE]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("pii", lambda s: s["kind"] == n)).cast("long")
    counts = {f"n_{n}": count(n) for n in names}
    counts["n_spans"] = F.size("pii").cast("long")
    return counts | {"base_sha256": F.sha2(told(F.filter("pii", lambda s: s["kind"].isin(*names))), 256), "spans": told(F.col("pii"))}
