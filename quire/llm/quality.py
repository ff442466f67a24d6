"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or neither on every document, and are silent where a text is too short for them. The
votes of all documents are counted by pattern (at most 4 to the number of labellers rows, however large the corpus);
expectation-maximisation over those counts estimates how often each labeller gives each of the three answers on either
class, abstaining included, and with that the posterior of each pattern. Silence says nothing about the class. Each
labeller is anchored: it starts from pseudo-counts that trust its votes, and a vote that would count for the other class
counts for none. A bounded sample of documents, drawn by the hash of their ids and text, trains a logistic regression over
hashed features to give those posteriors, and that linear scorer judges every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import draw, text_bytes

GOOD, BAD, NONE, SILENT = 1, 0, 2, 3
ANSWERS = 4
#: Pseudo-counts, by class, of a labeller's answers: bad, good, neither.
ANCHORS = {BAD: (20.0, 1.0, 4.0), GOOD: (1.0, 20.0, 4.0)}
SAMPLE_DOCS = 20_000
DIMENSIONS = 1 << 15
ROUNDS = 100
LABELLERS = ["symbols", "capitals", "variety", "top_word", "repeats", "cells", "sentences", "function_words", "word_length", "short_form"]

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in "the of and to in is that it for was on are as with be by this at from or an le la les de des et en un une que qui dans pour sur est pas au der die das und ist ein eine nicht mit von zu den dem im el los las del y una por con para se no al lo".split()
)
SHAPES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SYMBOLS = frozenset(b"#$%&*<>=@\\^_{|}~")
EDGES = b".,;:!?\"'()[]"


def _vote(value: float, bad: float, good: float) -> int:
    """Bad beyond one bound, good beyond the other, nothing between them."""
    if bad > good:
        return BAD if value > bad else GOOD if value < good else NONE
    return BAD if value < bad else GOOD if value > good else NONE


def _squeeze(shape: bytes) -> bytes:
    out = bytearray()
    for b in shape:
        if len(out) < 2 or out[-1] != b or out[-2] != b:
            out.append(b)
    return bytes(out[:12])


class Reader:
    """Votes and hashed features of a text; each distinct word shape is worked out once."""

    def __init__(self) -> None:
        self.shapes: dict[bytes, tuple[int, int, int, int, int, int]] = {}

    def _shape(self, shape: bytes) -> tuple[int, int, int, int, int, int]:
        from xxhash import xxh64_intdigest

        if len(self.shapes) > 200_000:
            self.shapes.clear()
        symbols, caps = sum(b in SYMBOLS for b in shape), shape.count(b"A")
        ends = int(shape[-1:] in (b".", b"!", b"?") and not symbols)
        got = xxh64_intdigest(b"shape " + _squeeze(shape)) % DIMENSIONS, symbols, caps, shape.count(b"a"), ends, int(not shape.strip(EDGES))
        self.shapes[shape] = got
        return got

    def read(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Vote pattern as a base-4 number, feature places and their values. Without words there are no features."""
        from xxhash import xxh64_intdigest

        words = text.translate(LOWER).split()
        n = len(words)
        if not n:
            return pattern_of([SILENT] * (len(LABELLERS) - 1) + [BAD]), np.zeros(0, np.int64), np.zeros(0)
        counts = Counter(words)
        symbols = caps = small = ends = 0
        places: dict[int, float] = {}
        for shape, c in Counter(text.translate(SHAPES).split()).items():
            at, s, a, z, e, _ = self.shapes.get(shape) or self._shape(shape)
            symbols += s * c
            caps += a * c
            small += z * c
            ends += e * c
            places[at] = places.get(at, 0.0) + c
        (_, top), *_ = counts.most_common(1)
        letters = max(1, caps + small)
        functional = sum(counts[w] for w in FUNCTION_WORDS if w in counts) / n
        cells = counts.get(b"|", 0) / n
        repeats = sum(map(eq, words, islice(words, 1, None))) / n
        stats = [symbols / n, caps / letters, len(counts) / n if n >= 20 else 0.5, top / n if n >= 20 else 0.08, cells, ends / n, functional, letters / n, repeats]
        form = text.strip()
        starts, ends_well = form[:1].isupper() or form[0] >= 128, form[-1:] in (b".", b"!", b"?") or form[-1] >= 128
        votes = [
            _vote(stats[0], 0.5, 0.1),
            _vote(stats[1], 0.5, 0.15) if letters >= 20 else SILENT,
            _vote(stats[2] * max(1.0, n / 400) ** 0.4, 0.25, 0.4) if n >= 20 else SILENT,
            _vote(stats[3], 0.25, 0.15) if n >= 20 else SILENT,
            _vote(stats[8], 0.1, 0.03) if n >= 5 else SILENT,
            BAD if cells > 0.15 else NONE,
            _vote(stats[5], 0.005, 0.03) if n >= 40 else SILENT,
            _vote(stats[6], 0.02, 0.1) if n >= 20 else SILENT,
            BAD if not 2 <= stats[7] <= 14 else NONE,
            (BAD, NONE, GOOD)[starts + ends_well] if n < 5 else SILENT,
        ]
        values = {at: float(np.log1p(c)) / np.log1p(n) for at, c in places.items()}
        for k, value in enumerate(stats):
            values[xxh64_intdigest(f"stat {k} {int(min(value, 15.99) ** 0.5 * 16)}".encode()) % DIMENSIONS] = 1.0
        values[xxh64_intdigest(f"form {starts}{ends_well}".encode()) % DIMENSIONS] = 1.0
        values[0] = 1.0
        return pattern_of(votes), np.fromiter(values, np.int64, len(values)), np.fromiter(values.values(), float, len(values))


def pattern_of(votes: list[int]) -> int:
    return sum(v * ANSWERS**k for k, v in enumerate(votes))


def votes_of(pattern: int) -> list[int]:
    return [pattern // ANSWERS**k % ANSWERS for k in range(len(LABELLERS))]


@dataclass
class LabelModel:
    """prior: share of good documents; accuracy[labeller][class][answer]: how often it gives an answer when it isn't silent."""

    prior: float
    accuracy: np.ndarray

    @classmethod
    def fit(cls, counts: dict[int, int], rounds: int = ROUNDS) -> LabelModel:
        patterns = np.array([votes_of(p) for p in counts], np.int64).reshape(-1, len(LABELLERS))
        n = np.array(list(counts.values()), float)
        good = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
        model = cls(0.5, np.ones((len(LABELLERS), 2, ANSWERS)))  # silence keeps its factor of 1
        for _ in range(max(1, rounds)):
            model.prior = float(np.clip(((good * n).sum() + 1) / (n.sum() + 2), 0.01, 0.99))
            for k in range(len(LABELLERS)):
                for c, share in ((BAD, 1 - good), (GOOD, good)):
                    seen = [(share * n)[patterns[:, k] == answer].sum() + ANCHORS[c][answer] for answer in (BAD, GOOD, NONE)]
                    model.accuracy[k, c, :SILENT] = np.array(seen) / sum(seen)
                told = model.accuracy[k, :, :SILENT]
                useless = [vote for vote in (BAD, GOOD) if told[vote, vote] < told[1 - vote, vote]]
                told[:, useless] = told[:, useless].mean(axis=0)
                other = [answer for answer in (BAD, GOOD, NONE) if answer not in useless]
                told[:, other] *= (1 - told[:, useless].sum(axis=1, keepdims=True)) / told[:, other].sum(axis=1, keepdims=True)
            new = model.posterior(patterns)
            if not len(n) or np.abs(new - good).max() < 1e-6:
                break
            good = new
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        at = np.arange(len(LABELLERS))
        log = [np.log(self.accuracy[at, c, patterns]).sum(axis=1) + np.log(p) for c, p in ((BAD, 1 - self.prior), (GOOD, self.prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def train(places: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, passes: int = 6, rate: float = 0.3, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression on soft targets by mini-batches with per-weight rates; the same rows give the same weights."""
    weights, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for rows in np.array_split(order.permutation(len(target)), max(1, len(target) // 64)):
            if not len(rows):
                continue
            at, x = np.concatenate([places[r] for r in rows]), np.concatenate([values[r] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(places[r]) for r in rows])
            z = np.bincount(row, weights[at] * x, len(rows))
            slope = np.bincount(at, (1 / (1 + np.exp(-z)) - target[rows])[row] * x, DIMENSIONS) / len(rows) + decay * weights
            seen += slope**2
            weights -= rate * slope / np.sqrt(seen)
    return weights


def _read_all(docs: DataFrame, text_col: str, what: str, step, keep: list[str]) -> DataFrame:
    """Reads each text once; step gives the values of the new columns. Columns in keep are handed through."""
    base = docs.select(text_bytes(docs[text_col]).alias("t"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows = [step(*reader.read(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, zip(*rows, strict=True))] if rows else [batch.column(1), pa.array([], pa.int64())], names)

    names = ["x", *[c.split()[0] for c in what.split(", ")]]
    return base.mapInArrow(run, f"x {base.schema['x'].dataType.simpleString()}, {what}")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[LabelModel, np.ndarray]:
    """The label model over all documents, and the scorer's weights from about sample_docs of them at most."""
    votes = _read_all(docs, text_col, "pattern int", lambda p, at, x: (np.int32(p),), [])
    counts = {r["pattern"]: r["count"] for r in votes.groupBy("pattern").count().collect()}
    total = sum(counts.values())
    model = LabelModel.fit(counts)
    drawn = draw(docs, [id_col, text_col], sample_docs, total)
    sample = _read_all(drawn, text_col, "pattern int, at array<int>, v array<float>", lambda p, at, x: (np.int32(p), at.astype(np.int32), x.astype(np.float32)), [])
    rows = sample.select("pattern", "at", "v").toArrow()
    split = lambda c, kind: [a.astype(kind) for a in np.split(c.combine_chunks().values.to_numpy(), np.asarray(c.combine_chunks().offsets)[1:-1])]
    if not rows.num_rows:
        return model, np.zeros(DIMENSIONS)
    patterns = np.array([votes_of(p) for p in rows["pattern"].to_pylist()])
    return model, train(split(rows["at"], np.int64), split(rows["v"], float), model.posterior(patterns))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with label (posterior of the weak labels), score (the scorer's probability of good) and keep added.

    Texts without words, null and empty ones among them, have nothing to learn from: label and score are 0, and they aren't
    kept. Very long texts are read whole. Repeated rows are judged alike, each on its own. No rows give no rows. Columns named
    label, score or keep are replaced.
    """
    docs = docs.drop("label", "score", "keep")
    model, weights = fit(docs, id_col, text_col, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    def step(pattern: int, at: np.ndarray, x: np.ndarray) -> tuple[float, float]:
        model, weights = shared.value
        if not len(at):
            return 0.0, 0.0
        return float(model.posterior(np.array([votes_of(pattern)]))[0]), float(1 / (1 + np.exp(-np.clip(weights[at] @ x, -50, 50))))

    out = _read_all(docs, text_col, "label double, score double", step, docs.columns)
    return out.select(*[F.col(f"x.c{k}").alias(c) for k, c in enumerate(docs.columns)], "label", "score", (F.col("score") >= threshold).alias("keep"))
