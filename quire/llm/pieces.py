"""SentencePiece encoding with seeded merge-dropout, and its decoding.

The vocabulary is that of a byte-pair SentencePiece model with byte fallback. Merges run from an agenda: the best
scored adjacent pair that is a piece, the leftmost of equals, is taken next. With dropout, a candidate is skipped for good
when a keyed hash of the seed, the document, the candidate's place in it and its piece falls under the rate. The hash replaces a
random draw, so a lost task that runs again gives the same ids.

Where no piece holds two adjacent characters side by side, no merge crosses, so a text falls into parts that are
segmented by themselves. The agendas of many parts run at once: a part is a row of a matrix, a step takes the best
candidate of each row and merges or skips it, and rows whose agenda is empty leave. Parts of over LONG characters run one
by one from a heap. Nothing is looked up from earlier texts: every candidate at every place is drawn.

Ids decode to exactly the text's bytes: characters outside the vocabulary, and the space sign itself where a text holds it,
are spelled in byte pieces; a space stands before each text that is not empty, as the model's own encoder puts one
there, and is taken away again. At rate 0 the ids are those of the library.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.token_files import mix

SPACE = "▁"
MASK = 2**64 - 1
GOLDEN = 0x9E3779B97F4A7C15
#: Characters that are segmented at once.
BLOCK = 1 << 20
#: Lengths of parts that share a matrix; longer parts run from a heap.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48)
LONG = WIDTHS[-1]
CODES = 0x110000


def _draws(places: np.ndarray, pieces: np.ndarray, seed: int) -> np.ndarray:
    """The 32-bit draws of candidates: places are keys of documents plus characters, pieces are ids."""
    return mix(mix(places, seed) ^ (pieces.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN), seed) >> np.uint64(32)


def _draw(place: int, piece: int, seed: int) -> int:
    """One of _draws, without arrays."""
    salt = (seed * GOLDEN + 0x632BE59BD9B4E019) & MASK  # as in mix
    x = place & MASK
    for more in (0, (piece + 1) * GOLDEN & MASK):
        x = ((x ^ more) + salt) & MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        x ^= x >> 31
    return x >> 32


class Table:
    """Numbers by 64-bit key, by open addressing: `get` takes arrays, and gives 0 for keys that are not in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots] == -1
            taken, first = np.unique(slots[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = keys[left[mine]], values[left[mine]]
            stay = np.ones(len(left), bool)
            stay[mine] = False
            slots, left = (slots[stay] + 1) & self.last, left[stay]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(GOLDEN)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], 0)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & self.last
            held = self.keys[slots[left]]
            same = held == keys[left]
            out[left[same]] = self.values[slots[left[same]]]
            left = left[~same & (held != -1)]
        return out


class Pieces:
    """A model's vocabulary as tables, and the agendas over it. Symbols are ids, or size + code point of other characters."""

    def __init__(self, path: str, rate: float, seed: int):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        kinds = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.kind = np.dtype("<u2" if n <= 2**16 else "<u4")
        self.ids = {name.replace(SPACE, " "): i for i, name in enumerate(names) if not kinds[i]}
        self.scores = {name: model.get_score(i) for name, i in self.ids.items()}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes_of = [b""] * n
        for name, i in self.ids.items():
            self.bytes_of[i] = name.encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])
        self.table = np.array(self.bytes_of, object)
        self.limit, self.seed = round(rate * 2**32), seed
        self.symbol = np.arange(n, n + CODES, dtype=np.int32)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        beside = {x for name in self.ids for x in zip(name, name[1:], strict=False)}
        chars = {c: k for k, c in enumerate(sorted({c for x in beside for c in x}), 1)}
        self.group = np.zeros(CODES, np.uint16)  # 0: a character that no piece holds beside another
        self.meet = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for c, k in chars.items():
            self.group[ord(c)] = k
        for a, b in beside:
            self.meet[chars[a], chars[b]] = True
        order = {s: r for r, s in enumerate(sorted(set(self.scores.values())), 1)}
        self.rank = np.zeros(n + 1, np.int32)
        for name, i in self.ids.items():
            self.rank[i] = order[self.scores[name]]
        self.rank[n] = 0
        of = lambda x: self.ids.get(x, n + ord(x) if len(x) == 1 else None)
        halves = ((of(name[:k]), of(name[k:]), i) for name, i in self.ids.items() for k in range(1, len(name)))
        pairs = [x for x in halves if None not in x]
        a, b, i = np.array(pairs, np.int64).reshape(-1, 3).T
        self.joined = Table(self._pair(a, b), (i + 1).astype(np.int32))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 24) | b.astype(np.int64)

    def _join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two symbols make, and its rank; rank 0 for none."""
        known = (a >= 0) & (b >= 0)
        piece = np.where(known, self.joined.get(np.where(known, self._pair(a, b), np.int64(-2))), 0) - 1
        return piece, self.rank[piece]  # piece -1 has the last place of rank, 0

    def segment(self, part: str, place: int) -> list[int]:
        """Symbols of a part from a heap; place stands for the document and the part's place in it."""
        symbols = list(part)
        n = len(symbols)
        scores, ids = self.scores, self.ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int) -> None:
            right = after[left]
            if right < n:
                piece = symbols[left] + symbols[right]
                score = scores.get(piece)
                if score is not None:
                    heappush(agenda, (-score, left, right, piece))

        for k in range(n - 1):
            propose(k)
        while agenda:
            _, left, right, piece = heappop(agenda)
            if after[left] != right or symbols[left] + symbols[right] != piece or not symbols[left] or not symbols[right]:
                continue
            if self.limit and _draw(place + left, ids[piece], self.seed) < self.limit:
                continue
            symbols[left], symbols[right] = piece, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            if before[left] >= 0:
                propose(before[left])
            propose(left)
        return [ids[x] if x in ids else self.size + ord(x) for x in symbols if x]

    def _agendas(self, out: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> None:
        """Merges, in place, the symbols of the parts that start at starts; symbols that went into another become -1.

        Column j of a row is the part's character j; the last column stands beyond both ends. after and before lead from
        a symbol to its neighbours, rank and piece tell what it makes with the one after it.
        """
        width = int(sizes.max()) + 1
        cols = np.arange(width - 1)
        symbols = np.full((len(starts), width), -1, np.int32)
        inside = cols < sizes[:, None]
        at = np.minimum(starts[:, None] + cols, len(out) - 1)
        symbols[:, :-1] = np.where(inside, out[at], -1)
        piece, rank = (np.zeros(symbols.shape, np.int32) for _ in range(2))
        piece[:, :-1], rank[:, :-1] = (x.reshape(len(starts), -1) for x in self._join(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
        after = np.broadcast_to(np.minimum(np.arange(1, width + 1), width - 1).astype(np.int32), symbols.shape).copy()
        before = np.broadcast_to(np.where(np.arange(width) > 0, np.arange(-1, width - 1), width - 1).astype(np.int32), symbols.shape).copy()
        s, p, r, nxt, prv = (x.ravel() for x in (symbols, piece, rank, after, before))
        rows = np.flatnonzero(rank.max(axis=1) > 0)
        while len(rows):
            ranks = rank[rows]
            col = ranks.argmax(axis=1)
            open_ = ranks[np.arange(len(rows)), col] > 0
            rows, col = rows[open_], col[open_]
            base = rows * width
            left = base + col
            made = p[left]
            r[left] = 0
            if self.limit:
                take = _draws(places[rows] + col.astype(np.uint64), made, self.seed) >= self.limit
                base, left, made = base[take], left[take], made[take]
            right = base + nxt[left]
            beyond = nxt[right]
            s[left], s[right], r[right], nxt[left] = made, -1, 0, beyond
            prv[base + beyond] = left - base
            previous = base + prv[left]
            both = np.concatenate([left, previous])
            p[both], r[both] = self._join(np.concatenate([made, s[previous]]), np.concatenate([s[base + beyond], made]))
        out[at[inside]] = symbols[:, :-1][inside]

    def _block(self, codes: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Symbols of characters, -1 for those that went into another. first: where a text (or a slice of one) starts."""
        out = self.symbol[codes]
        group = self.group[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.meet[group[:-1], group[1:]]
        cut |= first
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(codes)))
        low = 1
        for high in WIDTHS:
            those = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(those):
                self._agendas(out, starts[those], sizes[those], places[starts[those]])
        for k in np.flatnonzero(sizes > LONG).tolist():
            a, b = int(starts[k]), int(starts[k] + sizes[k])
            symbols = self.segment(codes[a:b].astype("<u4").tobytes().decode("utf-32-le"), int(places[a]))
            out[a:b] = -1
            out[a : a + len(symbols)] = symbols
        return out

    def _spelled(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: those of bytes for characters that are no pieces."""
        code = symbols - self.size
        if not (code >= 0).any():
            return symbols
        wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        wide = np.where(code >= 0, wide, 1)
        ends = np.cumsum(wide)
        out = np.repeat(symbols, wide)
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            those = np.flatnonzero((code >= 0) & (wide == n))
            for k in range(n):
                bits = code[those] >> (6 * (n - 1 - k))
                out[ends[those] - n + k] = self.byte_ids[(bits | lead) if k == 0 else (bits & 0x3F) | 0x80]
        return out

    def _slices(self, text: str, size: int) -> Iterator[str]:
        """A text in order, cut where no piece reaches across, about size characters at a time."""
        at = 0
        while len(text) - at > size:
            for wide in (size, 4 * size, len(text) - at):
                group = self.group[np.frombuffer(text[at : at + wide].encode("utf-32-le"), "<u4")]
                apart = np.flatnonzero(~self.meet[group[:-1], group[1:]])
                if len(apart):
                    break
            end = at + int(apart[-1]) + 1 if len(apart) else len(text)
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def encode_all(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and how many each has. keys stand for documents in the draws."""
        ids, counts = [np.zeros(0, self.kind)], np.zeros(len(texts), np.int64)
        held: list[tuple[int, int, str]] = []  # text, place of the slice in it, slice
        size = 0

        def flush() -> None:
            sizes = np.array([len(x) for _, _, x in held], np.int64)
            codes = np.frombuffer("".join([x for _, _, x in held]).encode("utf-32-le"), "<u4")
            starts = np.cumsum(sizes) - sizes
            first = np.zeros(len(codes), bool)
            first[starts] = True
            base = np.array([(keys[k] * GOLDEN + at - int(s)) & MASK for (k, at, _), s in zip(held, starts, strict=True)], np.uint64)
            symbols = self._block(codes, first, np.repeat(base, sizes) + np.arange(len(codes), dtype=np.uint64))
            stay = symbols >= 0
            wide = np.where(symbols >= self.size, 1 + (symbols >= self.size + 0x80) + (symbols >= self.size + 0x800) + (symbols >= self.size + 0x10000), stay)
            np.add.at(counts, [k for k, _, _ in held], np.add.reduceat(wide, starts))
            ids.append(self._spelled(symbols[stay]).astype(self.kind))

        for k, text in enumerate(texts):
            at = 0
            for piece in self._slices(" " + text, BLOCK) if text else ():
                held.append((k, at, piece))
                at += len(piece)
                size += len(piece)
                if size >= BLOCK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return np.concatenate(ids), counts

    def encode(self, text: str, key: int) -> bytes:
        """Ids of one text as little-endian bytes."""
        return self.encode_all([text], [key])[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        raw = b"".join(self.table[np.frombuffer(ids, self.kind)].tolist())
        return raw[1:] if raw[:1] == b" " else raw


_LOADED: dict[tuple, Pieces] = {}


def pieces_for(path: str, rate: float, seed: int) -> Pieces:
    """A Python worker's tables, which serve its next tasks too."""
    key = (path, rate, seed)
    if key not in _LOADED:
        _LOADED[key] = Pieces(*key)
    return _LOADED[key]


def _by_characters(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most BLOCK bytes of text, or of one row."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    which = np.cumsum(sizes) // BLOCK
    cuts = np.flatnonzero(np.diff(which)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ids added: little-endian unsigned ids, two bytes each while the vocabulary has at most 65,536 pieces.

    Null and empty texts have no ids; very long texts are taken a slice at a time, with the same ids. Equal rows get equal
    ids; a null id_col counts as one document's. No rows give no rows. A column named ids is replaced. The model file has to be
    at the given path on every machine.
    """
    docs = docs.drop("ids")
    base = docs.select(F.xxhash64(docs[id_col]).alias("k"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(model, rate, seed)
        for batch in batches:
            for part in _by_characters(batch, 1):
                ids, counts = pieces.encode_all(part.column(1).to_pylist(), part.column(0).to_pylist())
                ends = np.append(0, np.cumsum(counts) * pieces.kind.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(2), packed], ["x", "ids"])

    out = base.mapInArrow(run, f"x {base.schema['x'].dataType.simpleString()}, ids binary")
    return out.select(*[F.col(f"x.c{k}").alias(c) for k, c in enumerate(docs.columns)], "ids")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encoded with the text that its ids spell added; null and empty ids spell the empty text. A column of that name is replaced."""
    encoded = encoded.drop(decoded_col)
    base = encoded.select(F.coalesce(encoded[ids_col], F.lit(b"")).alias("i"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(encoded.columns)]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(model, 0.0, 0)
        for batch in batches:
            for part in _by_characters(batch, 0):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([pieces.decode(i.as_py()).decode() for i in part.column(0)], pa.string())], ["x", "text"])

    out = base.mapInArrow(run, f"x {base.schema['x'].dataType.simpleString()}, text string")
    return out.select(*[F.col(f"x.c{k}").alias(c) for k, c in enumerate(encoded.columns)], F.col("text").alias(decoded_col))
