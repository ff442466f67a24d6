"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items are the automaton's strings. A document's words run through it once; after each word the
automaton holds the longest suffix of what was read that occurs in some item. A suffix of `window` words or more
marks its words as hit; items of fewer words count as one window and are marked where the whole item has been read.

Items come in shards of at most `shard_words` words, each an automaton of its own. One shard at a time is built and
broadcast, so what the driver and the workers hold is bounded whatever the benchmark's size. Documents are read once a
shard; what the shards found is merged by document. A benchmark of one shard, the usual case, takes a single pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, materialise, text_bytes

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of non-ASCII letters, and turns the rest into spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SHARD_WORDS = 250_000
#: Documents whose words are held at once.
SLICE = 200


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences. State 0 is the start; moves[state] maps a word to the next state."""

    window: int
    moves: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    item_states: dict[int, list[str]] = field(default_factory=dict)
    items: list[list[str]] = field(default_factory=list)
    short: list[tuple[int, int]] = field(default_factory=list)
    windowed: list[int] = field(default_factory=list)

    def _state(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def _extend(self, last: int, word: bytes) -> int:
        to = self.moves[last].get(word)
        if to is not None and self.length[to] == self.length[last] + 1:
            return to
        if to is not None:
            return self._split(last, word, to)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.moves[at]:
            self.moves[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.moves[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: bytes, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.moves[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.moves[at].get(word) == to:
            self.moves[at][word] = copy
            at = self.link[at]
        return copy

    @classmethod
    def build(cls, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        """items: id and words. Items without words add nothing; those without an id match, but are not told."""
        self = cls(window)
        kept = [(i, w) for i, w in items if w]
        ends = []
        for _, item in kept:
            last = 0
            for word in item:
                last = self._extend(last, word)
            ends.append(last)
        n = len(self.moves)
        # The state of the last `window` words, and the items whose windows it stands for.
        self.windowed = [-1] * n
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.windowed[s] = s if self.length[up] < window else self.windowed[up]
        held: dict[int, set[str]] = {}
        shorts: dict[int, set[str]] = {}
        for i, item in kept:
            if len(item) < window:
                at = 0
                for word in item:
                    at = self.moves[at][word]
                shorts.setdefault(at, set()).update([] if i is None else [i])
                continue
            at = 0
            for word in item:
                at = self.moves[at][word]
                if self.windowed[at] >= 0 and i is not None:
                    held.setdefault(self.windowed[at], set()).add(i)
        self.items = [sorted(held.get(s, ())) for s in range(n)]
        # For each state the nearest state up its suffix links, itself included, at which a short item ends.
        above = [-1] * n
        for s in order:
            above[s] = s if s in shorts else above[self.link[s]]
        self.item_states = {s: sorted(x) for s, x in shorts.items()}
        self.short = [(a, above[self.link[a]] if a >= 0 else -1) for a in above]
        return self

    def matches(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (word positions, end exclusive, ascending and apart) and the ids of items found."""
        moves, link, length, windowed, short, window = self.moves, self.link, self.length, self.windowed, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        ends: set[int] = set()
        any_short = bool(self.item_states)
        state = size = 0
        start_moves = moves[0]
        for at, word in enumerate(document):
            to = moves[state].get(word)
            if to is None:
                if word not in start_moves:
                    state = size = 0
                    continue
                while to is None:
                    state = link[state]
                    to = moves[state].get(word)
                size = length[state]
            state = to
            size += 1
            hit = 0
            if size >= window:
                hit = size
                found.add(windowed[state])
            if any_short:
                end = short[state][0]
                # A state's longest string may be longer than what was read; ends are read whole as prefixes of items.
                while end >= 0:
                    if length[end] <= size:
                        hit = max(hit, length[end])
                        ends.add(end)
                    end = short[end][1]
            if hit:
                begin = at + 1 - hit
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at + 1))
        ids = {i for s in found for i in self.items[s]}
        ids.update(i for s in ends for i in self.item_states[s])
        return spans, ids


def _shards(items: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> Iterator[Automaton]:
    """Automata over at most shard_words words each; an item of more words is cut with an overlap of window - 1."""
    shard: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), text_bytes(items[text_col]).alias("t")).toLocalIterator():
        item = words(bytes(row["t"]))
        step = max(1, shard_words - window + 1)
        parts = [item] if len(item) <= shard_words else [item[x : x + shard_words] for x in range(0, max(1, len(item) - window + 1), step)]
        for part in parts:
            if size and size + len(part) > shard_words:
                yield Automaton.build(shard, window)
                shard, size = [], 0
            shard.append((row["i"], part))
            size += len(part)
    if size:
        yield Automaton.build(shard, window)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS = "hits array<struct<start:long,end:long>>, item_ids array<string>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from (whole.slice(x, SLICE) for x in range(0, whole.num_rows, SLICE))


def _told(found: list[tuple[list[tuple[int, int]], set[str]]]) -> list[pa.Array]:
    spans = pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in found], SPANS)
    return [spans, pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))]


def _with_hits(docs: DataFrame, shard: Automaton, body: str) -> DataFrame:
    """docs (columns of plain names) with n_words, hits and item_ids of one shard."""
    shared, at, names = docs.sparkSession.sparkContext.broadcast(shard), docs.columns.index(body), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [words((t or "").encode()) for t in batch.column(at).to_pylist()]
            found = [shared.value.matches(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, texts), pa.int64()), *_told(found)], [*names, "n_words", "hits", "item_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, n_words long, {HITS}")


def _all_hits(docs: DataFrame, first: list[Automaton], rest: Iterator[Automaton], body: str) -> DataFrame:
    """row, hits, item_ids of the rows of docs (a written table with the column row) that any shard hits, a pass a shard."""
    found = None
    for shard in chain(first, rest):
        hits = _with_hits(docs.select("row", body), shard, body).where("size(hits) > 0").select("row", "hits", "item_ids")
        more = materialise(hits if found is None else found.unionByName(hits), "hits")
        if found is not None:
            discard(found)
        found = more
    merged = found.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            spans = [_union([(s["start"], s["end"]) for s in x]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _told([(s, set()) for s in spans])[0], batch.column(2)], ["row", "hits", "item_ids"])

    return merged.mapInArrow(union, f"row long, {HITS}")


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For every document: id_col, n_words, hits (array of word spans) and item_ids (sorted strings).

    Null and empty texts have no words and no hits, very long ones are read whole; items without words match nothing, those
    with a null id match without being told, and items that repeat count once by id. Repeated documents keep their rows.
    Without documents there are no rows, without items no hits. Other columns are ignored.
    """
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    shards = _shards(items, item_id, item_text, window, shard_words)
    first = list(islice(shards, 2))
    if len(first) <= 1:
        out = _with_hits(plain, first[0] if first else Automaton.build([], window), "t")
    else:
        rows = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "documents")
        counted = _with_hits(rows, Automaton.build([], window), "t").drop("t", "hits", "item_ids")
        none = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (x.split() for x in HITS.split(", "))]
        out = counted.join(_all_hits(rows, first, shards, "t"), "row", "left").select("id", "n_words", *none)
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "item_ids")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw)]
    parts, last = [], 0
    for start, end in spans:
        parts.append(raw[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*parts, raw[last:]]).decode()


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without what they share with the items: hit words are cut, and documents that lose more than max_coverage go.

    The bytes from the first to the last word of each hit span go. Where what stood on either side makes a hit together, that
    is cut in turn, until nothing is hit. The rest of the text stays as it is. Texts without hits, null and empty ones
    included, are handed on unchanged; very long ones are read whole. Repeated rows are treated alike and keep their rows. No
    rows give no rows, and no items change nothing. Columns and their order stay, whatever their names.
    """
    names = docs.columns
    plain, body = docs.toDF(*[f"c{k}" for k in range(len(names))]), f"c{names.index(text_col)}"
    shards = _shards(items, item_id, item_text, window, shard_words)
    first = list(islice(shards, 2))
    if len(first) <= 1:
        return _cut_by(plain, first[0] if first else Automaton.build([], window), body, max_coverage).toDF(*names)
    rows = materialise(plain.withColumn("row", F.monotonically_increasing_id()), "documents")
    done, open_ = [], rows.withColumns({"lost": F.lit(0).cast("long"), "words": F.lit(-1).cast("long")})
    while True:
        again = _shards(items, item_id, item_text, window, shard_words) if done else shards
        hits = materialise(_all_hits(open_, [] if done else first, again, body), "hits")
        done.append(open_.join(hits, "row", "left_anti").drop("lost", "words"))
        if hits.isEmpty():
            break
        changed = _cut_once(open_.join(hits.drop("item_ids"), "row"), body)
        open_ = materialise(changed.where(F.col("lost") <= F.col("words") * max_coverage), "documents")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*plain.columns).toDF(*names)


def _cut_by(plain: DataFrame, shard: Automaton, body: str, max_coverage: float) -> DataFrame:
    """remove, for a single shard."""
    shared, at, names = plain.sparkSession.sparkContext.broadcast(shard), plain.columns.index(body), plain.columns

    def cut(text: str | None) -> tuple[str | None, bool]:
        said = words((text or "").encode())
        spans, _ = shared.value.matches(said)
        lost = 0
        while spans:
            lost += sum(b - a for a, b in spans)
            if lost > len(said) * max_coverage:
                return None, False
            text = _without(text, spans)
            spans, _ = shared.value.matches(words(text.encode()))
        return text, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            kept = [cut(t) for t in batch.column(at).to_pylist()]
            texts = pa.array([t for t, _ in kept], pa.string())
            columns = [texts if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([stays for _, stays in kept], pa.bool_()))

    return plain.mapInArrow(run, plain.schema)


def _cut_once(hit: DataFrame, body: str) -> DataFrame:
    """hit (with row, lost, words, hits) with its hits cut from the text and counted in lost; words is that of the first text."""
    given = hit.columns
    names = [c for c in given if c != "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = dict(zip(given, batch.columns, strict=True))
            spans = [[(s["start"], s["end"]) for s in x] for x in rows["hits"].to_pylist()]
            told = rows[body].to_pylist()
            rows[body] = pa.array([_without(t, s) for t, s in zip(told, spans, strict=True)], pa.string())
            rows["lost"] = pa.array([n + sum(b - a for a, b in s) for n, s in zip(rows["lost"].to_pylist(), spans, strict=True)], pa.int64())
            rows["words"] = pa.array([len(words(t.encode())) if n < 0 else n for n, t in zip(rows["words"].to_pylist(), told, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([rows[c] for c in names], names)

    return hit.mapInArrow(run, hit.drop("hits").schema)
