"""Token-id files: raw id payloads in shards, and a minimal perfect hash index from document keys to their places.

Documents are range-partitioned by key into shards of bounded size, encoded, and written as one `.bin` (ids, little-endian, two bytes each if the
vocabulary allows, else four) and one `.idx` file a shard. The index holds the hash's bit levels, and for each slot a
64-bit key fingerprint, the key, the payload offset and the number of ids. A lookup hashes the key through the
levels, takes the rank of the bit that it meets as the slot, and compares the fingerprint: constant time, and a key that
was never stored is turned away. Documents without a key stand first, outside the hash. The catalog, one row a shard, gives each shard's key range and first id.

Files are written under names of their own for each attempt; only those of attempts that ended well are in the
catalog, so lost executors and repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh_path, local_or_uri, materialise, text_bytes

MAGIC = b"QTOK0001"
GAMMA = 2.0
LAST_LEVEL = 64
#: Bytes of text in a shard, about; smaller tables have a shard for each of the session's shuffle partitions.
SHARD_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
FIXED = np.dtype([("fingerprint", "<u8"), ("key", "<i8"), ("offset", "<u8"), ("n_ids", "<u8"), ("row", "<u4"), ("copies", "<u4")])
CACHE_PARTS = 250_000
CACHE_PIECES = 600_000


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser of keys with a salt."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Levels of bits: a key's slot is the rank of the first level's bit that is its own."""

    levels: list[np.ndarray]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64."""
        left, levels = keys.astype(np.int64).view(np.uint64), []
        while len(left):
            if len(levels) == LAST_LEVEL:
                raise ValueError("keys are not distinct")
            size = max(64, int(GAMMA * len(left)))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, from 0 to the number of keys - 1; -1 if no level has a bit for it."""
        keys = keys.astype(np.int64).view(np.uint64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels):
            at = (mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            met = bits[at]
            ranks = np.cumsum(bits)
            out[open_[met]] = base + ranks[at[met]] - 1
            base += int(ranks[-1])
            open_ = open_[~met]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64), 1_000_003)


def write_index(keys: np.ndarray, offsets: np.ndarray, counts: np.ndarray, id_bytes: int, nulls: int = 0) -> bytes:
    """keys in file order, equal ones together; a key that repeats has one slot that tells its first row and its rows.

    The first `nulls` rows have no key, whatever stands in keys there, and no slot.
    """
    known = keys[nulls:]
    first = np.flatnonzero(np.append(True, known[1:] != known[:-1])) if len(known) else np.empty(0, np.int64)
    hashed = PerfectHash.build(known[first])
    slots = np.empty(len(first), FIXED)
    at = hashed.slots(known[first])
    rows = first + nulls
    for name, values in (("fingerprint", fingerprint(known[first])), ("key", known[first]), ("offset", offsets[rows]), ("n_ids", counts[rows]), ("row", rows), ("copies", np.diff(np.append(first, len(known))))):
        slots[name][at] = values
    head = json.dumps({"rows": len(keys), "nulls": nulls, "slots": len(first), "id_bytes": id_bytes, "levels": [len(b) for b in hashed.levels]}).encode()
    bits = b"".join(np.packbits(b).tobytes() for b in hashed.levels)
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, bits, slots.tobytes(), counts.astype("<u8").tobytes()])


@dataclass
class Index:
    """A shard's index as read from its file. counts: ids of each row in file order; the first `nulls` rows have no key."""

    hashed: PerfectHash
    slots: np.ndarray
    counts: np.ndarray
    id_bytes: int
    nulls: int

    @classmethod
    def parse(cls, raw: bytes) -> Index:
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token index")
        size = int.from_bytes(raw[8:12], "little")
        head, at, levels = json.loads(raw[12 : 12 + size]), 12 + size, []
        for n in head["levels"]:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at))[:n].astype(bool))
            at += (n + 7) // 8
        slots = np.frombuffer(raw, FIXED, head["slots"], at)
        return cls(PerfectHash(levels), slots, np.frombuffer(raw, "<u8", head["rows"], at + slots.nbytes), head["id_bytes"], head["nulls"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key that is stored, else -1, by hash and fingerprint."""
        at = self.hashed.slots(keys)
        known = at >= 0
        known[known] = self.slots["fingerprint"][at[known]] == fingerprint(keys[known])
        return np.where(known, at, -1)


# The steps of the tokenizers whose texts fall into parts at white space (see Encoder).
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """Ids of a text as the tokenizer's own encode gives them, as little-endian bytes.

    A tokenizer of the steps SPLITTING collapses white space, drops it and never joins pieces across it, so a text's ids
    are those of its white-space-separated parts in turn. Lower-case Latin letters and the ASCII marks after them are pieces
    of their own that its normaliser leaves as they are, so the library's model takes them directly. Parts and pieces seen
    before are looked up. Its special tokens, which all begin with `<|`, are found in the raw text with case, so a text that
    may hold one is encoded whole. Texts of any other tokenizer are all encoded whole by the library.
    """

    PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
    LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

    def __init__(self, path: str, kind: str, parts: int = CACHE_PARTS, pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind, self.most_parts, self.most_pieces = Tokenizer.from_file(path), np.dtype(kind), parts, pieces
        self.lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = str.maketrans({c: split.pre_tokenize_str(c)[0][0] for c in self.LETTERS})
        self.parts: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        told = json.loads(self.tokenizer.to_str())
        specials = [t["content"] for t in told["added_tokens"]]
        plain = not any(told[k] for k in ("truncation", "padding", "post_processor")) and told["model"]["type"] == "BPE" and not told["model"]["dropout"]
        self.splits = plain and all(told[k] == v for k, v in SPLITTING.items()) and all(t.startswith("<|") for t in specials)

    def _pack(self, ids: list[int]) -> bytes:
        return array("HI"[self.kind.itemsize // 4], ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= self.most_pieces:
                self.pieces.clear()
            got = self.pieces[piece] = self._pack([t.id for t in self.tokenizer.model.tokenize(piece.translate(self.spelled))])
        return got

    def _part(self, part: bytes) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= self.most_parts:
                self.parts.clear()
            text = part.decode()
            m = self.PLAIN.fullmatch(text)
            if m:
                got = self._piece(m[1]) + self._piece(m[2]) if m[2] else self._piece(m[1])
            else:
                got = self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
            self.parts[part] = got
        return got

    def encode(self, text: bytes) -> bytes:
        if not self.splits or b"<|" in text:
            return self._pack(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        parts = text.translate(self.lower).split()
        try:
            return b"".join(map(self.parts.__getitem__, parts))
        except KeyError:
            return b"".join(map(self._part, parts))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(path: str, kind: str) -> Encoder:
    """A Python worker's encoder: what it has looked up serves its next tasks too."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _shards(docs: DataFrame, text_col: str) -> int:
    """Shards of about SHARD_BYTES; of tables too small to occupy the cluster so, as many as it has shuffle partitions."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text_col].cast("string"))), F.lit(0)).alias("n")).first()["n"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // SHARD_BYTES), min(partitions, -(-size // LEAST_BYTES)))


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, shards: int | None = None) -> DataFrame:
    """Encodes and writes docs under path; returns the catalog: shard, bin, idx, first_key, last_key, n_docs, n_ids, start.

    Keys are integers; documents without one come first. A null or empty text gives only end_id; very long ones are
    encoded whole. Repeated keys keep their rows, in the order of the texts' hash; equal rows may fall into several shards.
    No rows give an empty catalog. Other columns are ignored, whatever their names. The tokenizer file has to be at the given
    path on every machine.
    """
    spark = docs.sparkSession
    big = vocabulary_size(tokenizer) > 2**16 or (end_id or 0) >= 2**16
    kind = "<u4" if big else "<u2"
    n = shards or _shards(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("key"), text_bytes(docs[text_col]).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, "key", "tie", "nth").sortWithinPartitions("key", "tie", "nth").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(tokenizer, kind), b"" if end_id is None else np.array([end_id], kind).tobytes()
        width, name = np.dtype(kind).itemsize, f"{path}/{uuid.uuid4().hex}"
        keys, counts, out, fs, at, nulls = [], [], None, None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, at = local_or_uri(name)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(f"{at}.bin", compression=None)
            nulls += batch.column(0).null_count
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            sizes = []
            for text in batch.column(1):
                payload = encoder.encode(text.as_py()) + end
                sizes.append(len(payload) // width)
                out.write(payload)
            counts.append(np.array(sizes, np.int64))
        if out is None:
            return
        out.close()
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        with fs.open_output_stream(f"{at}.idx", compression=None) as f:
            f.write(write_index(keys, np.cumsum(counts) - counts, counts, width, nulls))
        known = keys[nulls:].tolist()
        row = {"bin": [f"{name}.bin"], "idx": [f"{name}.idx"], "first_key": known[:1] or [None], "last_key": known[-1:] or [None], "n_docs": [len(keys)], "n_ids": [int(counts.sum())]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("bin", "idx") else pa.int64()) for k, v in row.items()})

    written = rows.mapInArrow(run, "bin string, idx string, first_key long, last_key long, n_docs long, n_ids long").withColumn("shard", F.spark_partition_id())
    shards_done = sorted(written.collect(), key=lambda r: r["shard"])  # a row a shard
    catalog, start = [], 0
    for r in shards_done:
        catalog.append((r["shard"], r["bin"], r["idx"], r["first_key"], r["last_key"], r["n_docs"], r["n_ids"], start))
        start += r["n_ids"]
    return spark.createDataFrame(catalog, "shard int, bin string, idx string, first_key long, last_key long, n_docs long, n_ids long, start long")


def open_index(path: str) -> Index:
    fs, at = local_or_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        return Index.parse(f.read())


def read_ids(path: str, offset: int, n_ids: int, id_bytes: int) -> np.ndarray:
    """Ids at a place of a payload file, as unsigned 32-bit integers."""
    fs, at = local_or_uri(path)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read_at(n_ids * id_bytes, offset * id_bytes), f"<u{id_bytes}").astype("<u4")


def lookup(spark: SparkSession, catalog: DataFrame, keys: list[int]) -> dict[int, np.ndarray]:
    """Ids of single documents by key through the index; unknown keys are left out. Of a key's rows, the first."""
    out = {}
    for shard in catalog.where(F.lit(False) if not keys else " or ".join(f"({k} between first_key and last_key)" for k in keys)).orderBy("shard").collect():
        index = open_index(shard["idx"])
        for k, slot in zip(keys, index.find(np.array(keys, np.int64)), strict=True):
            if slot >= 0 and k not in out:
                out[k] = read_ids(shard["bin"], int(index.slots["offset"][slot]), int(index.slots["n_ids"][slot]), index.id_bytes)
    return out


def read(catalog: DataFrame, with_ids: bool = False) -> DataFrame:
    """Rows of the files in order of place: key, start, n_tokens, ids_crc32 (and ids), each found through the index.

    A shard is read as a stream, a few megabytes at a time.
    """
    n = max(1, catalog.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                index = open_index(shard["idx"])
                slots = index.slots[np.argsort(index.slots["row"], kind="stable")]
                where = index.find(slots["key"])
                if (where < 0).any() or (index.slots["key"][where] != slots["key"]).any():
                    raise ValueError(f"{shard['idx']} does not find its own keys")
                keys = np.concatenate([np.zeros(index.nulls, np.int64), np.repeat(index.slots["key"][where], index.slots["copies"][where].astype(np.int64))])
                unknown = np.arange(len(keys)) < index.nulls
                counts = index.counts.astype(np.int64)
                starts = np.cumsum(counts) - counts
                if (starts[index.slots["row"][where]] != index.slots["offset"][where]).any():
                    raise ValueError(f"{shard['idx']} has wrong offsets")
                fs, at = local_or_uri(shard["bin"])
                with fs.open_input_stream(at, compression=None, buffer_size=1 << 22) as f:
                    for x in range(0, len(keys), 1000):
                        ids = [np.frombuffer(f.read(int(c) * index.id_bytes), f"<u{index.id_bytes}").astype("<u4") for c in counts[x : x + 1000]]
                        cols = {"key": pa.array(keys[x : x + 1000], pa.int64(), mask=unknown[x : x + 1000]), "start": pa.array(starts[x : x + 1000] + shard["start"], pa.int64()), "n_tokens": pa.array(counts[x : x + 1000], pa.int64()), "ids_crc32": pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())}
                        if with_ids:
                            cols["ids"] = pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(cols)

    return catalog.repartition(n, "shard").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def encode_and_read(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Writes token files for docs into the shared folder and reads them back; the catalog is kept beside them."""
    path = fresh_path(docs.sparkSession, "tokens")
    catalog = materialise(write(docs, path, tokenizer, id_col, text_col, end_id), "catalog")
    return read(catalog)
