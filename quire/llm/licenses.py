"""Licence scans: a trained classifier of word n-grams names licence families, and templates confirm them.

Every line, and every window of WINDOW words of a paragraph (lines up to a blank one, so wrapped text is read as one), is
described by its hashed word 1- to 3-grams. A multinomial logistic regression, trained here on variants of the templates,
made-up licences of no known family, sentences that only sound like licences and passages of a bounded sample of
documents, gives each family, an unknown licence and none a probability; its temperature is set on rows held back, and
`error` tells how far its probabilities are from the shares on rows held back from both. Neighbouring units that look
like a licence make a passage. The family whose template the passage holds best is told if the classifier gives it a
fair probability; a passage that holds no template, or several equally well, is of the unknown class.

A sum over a window's grams is a difference of running sums, so all units of a text cost one look at each gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ASCII_LOWER, draw, text_bytes
from quire.llm.token_files import mix

# Passages by which public licences are cited, open or go on, by family.
TEMPLATES = {
    "MIT": [
        "released under the mit license",
        "licensed under the mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "spdx license identifier apache 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "http www apache org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "GPL": [
        "licensed under the gnu general public license",
        "under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "GPL-3.0": [
        "licensed under the gnu general public license version 3",
        "spdx license identifier gpl 3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "GPL-2.0": [
        "licensed under the gnu general public license version 2",
        "spdx license identifier gpl 2.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "LGPL": [
        "licensed under the gnu lesser general public license",
        "spdx license identifier lgpl",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    ],
    "AGPL": [
        "licensed under the gnu affero general public license",
        "spdx license identifier agpl",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "BSD": [
        "licensed under the bsd license",
        "spdx license identifier bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "MPL-2.0": [
        "licensed under the mozilla public license version 2.0",
        "spdx license identifier mpl 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0",
    ],
    "ISC": [
        "licensed under the isc license",
        "spdx license identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "CC-BY": ["licensed under cc by 4.0", "spdx license identifier cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "spdx license identifier cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "spdx license identifier cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC0": ["dedicated to the public domain under cc0 1.0 universal", "spdx license identifier cc0 1.0", "this is free and unencumbered software released into the public domain"],
}
# Sentences that hold words of licences and are none.
NO_LICENCES = [
    "he renewed his driving licence last week",
    "a driving license is needed to rent the car",
    "the licence plate of the van was noted",
    "she asked for permission to leave the room early",
    "permission to enter the building was granted by the guard",
    "the fishing license expires in may",
    "that is poetic license on the part of the author",
    "the pub lost its licence to sell alcohol",
    "the redistribution of wealth was much debated",
    "the claim of copyright was settled out of court",
    "software for any purpose is sold in the shop",
    "the conditions of the contract are met without modification",
    "the notice was included in the letter to the general public",
    "a free copy of the book is given to any person who asks",
    "the television licence fee went up",
    "the medical board revoked the license of the doctor",
]
# How licences of any family are cited.
STARTS = ["licensed under the", "released under the", "this work is licensed under the", "distributed under the", "use of this file is governed by the", "spdx license identifier", "the terms of use are those of the"]
NONE, UNKNOWN = "none", "unknown"
#: Word pairs of templates or citations that an unknown licence has to hold.
EVIDENCE = 2
DIMENSIONS = 1 << 17
NEGATIVES = 2_000
PASSAGE_CHARS = 2_000
WINDOW, STRIDE = 32, 8
#: Rows in which a gram has to stand to get a weight: a word that one row happens to hold speaks for nothing.
COMMON = 8
#: Words on either side of a passage that are compared with templates too; and how far apart hits of one family make one.
AROUND, APART = 48, 64
BLANK = re.compile(rb"\n[ \t\r]*\n")
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
POWERS = mix(np.arange(64, dtype=np.uint64), 11) | np.uint64(1)


@dataclass
class Words:
    """Words of a text (runs of a-z and 0-9, with inner dots before digits, in small letters): places in bytes, and hashes."""

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, raw: bytes) -> Words:
        text = raw.translate(ASCII_LOWER)
        a = np.frombuffer(text, np.uint8)
        word = ALNUM[a]
        if len(a) > 2:
            word[1:-1] |= (a[1:-1] == 46) & word[:-2] & DIGIT[a[2:]]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.arange(len(a))
        if not len(starts):
            return cls(text, starts, ends, np.zeros(0, np.uint64))
        begun = np.zeros(len(a), np.int64)
        begun[starts] = starts
        place = at - np.maximum.accumulate(begun)
        values = np.where(word, (a.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63], np.uint64(0))
        return cls(text, starts, ends, np.add.reduceat(values, starts))

    def said(self, a: int, b: int) -> list[str]:
        return [self.text[x:y].decode("ascii") for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]


def grams(hashes: np.ndarray) -> list[np.ndarray]:
    """Places of the 1-, 2- and 3-grams that start at each word; a gram that would go beyond the end is left out."""
    out, h = [], hashes
    for n in (1, 2, 3):
        out.append((mix(h, n) >> np.uint64(33)).astype(np.int64) % DIMENSIONS)
        h = mix(h[: max(0, len(hashes) - n)], 7 + n) + hashes[n:] * np.uint64(2 * n + 1) if n < 3 else h
    return out


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


_TEMPLATE_PAIRS = [(family, _pairs(t.split())) for family, ts in TEMPLATES.items() for t in ts]
_FAMILY_PAIRS = {family: {p for f, pairs in _TEMPLATE_PAIRS if f == family for p in pairs} for family in TEMPLATES}
_ALL_PAIRS = set().union(*_FAMILY_PAIRS.values(), *(_pairs(s.split()) for s in STARTS))


def best_template(words: list[str], cover: float) -> tuple[str, list[int]] | None:
    """The family of the template that the words hold best (pairs held by the share held), and where its pairs stand.

    Nothing if no template is held to `cover`, or templates of several families equally well.
    """
    places: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(_pairs(words)):
        places.setdefault(pair, []).append(k)
    best: list[tuple[float, str, list[int]]] = []
    for family, pairs in _TEMPLATE_PAIRS:
        held = [p for p in pairs if p in places]
        share = len(held) / len(pairs)
        if share >= cover:
            best.append((len(held) * share, family, sorted({k for p in held for k in places[p]})))
    best.sort(key=lambda x: -x[0])
    if not best or any(x[0] == best[0][0] and x[1] != best[0][1] for x in best):
        return None
    return best[0][1], best[0][2]


@dataclass
class Classifier:
    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    error: float = 0.0  # mean distance of probability and share, over bins of rows held back

    def probabilities(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each family for units of words from starts to ends, none of them empty."""
        z, n = np.zeros((len(starts), len(self.families))), np.zeros(len(starts))
        for k, at in enumerate(grams(hashes)):
            fresh = np.append(True, at[1:] != at[:-1])[: len(at)]  # a gram that repeats at once counts once
            sums = np.concatenate([np.zeros((1, len(self.families))), np.cumsum(self.weights[at] * fresh[:, None], axis=0)])
            sizes = np.append(0, np.cumsum(fresh))
            begin = np.minimum(starts, len(at))
            stop = np.maximum(ends - k, begin)
            z += sums[stop] - sums[begin]
            n += sizes[stop] - sizes[begin]
        return _softmax((z / np.sqrt(np.maximum(n, 1))[:, None] + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(rng: np.random.Generator, background: list[list[str]]) -> list[tuple[str, list[str]]]:
    """Templates whole, in part and with words lost, with other words around them; licences of no known family; and none."""
    pool = [b for b in background if b] or [["text"]]

    def noise(n: int) -> list[str]:  # words as they stand in documents, so that they speak for no class
        said = pool[int(rng.integers(0, len(pool)))]
        at = int(rng.integers(0, max(1, len(said) - n + 1)))
        return said[at : at + n]

    within = lambda words: (noise(int(rng.integers(0, 14))) if rng.random() < 0.5 else []) + words + (noise(int(rng.integers(0, 14))) if rng.random() < 0.5 else [])
    out = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            words = template.split()
            for _ in range(24):
                kept = [w for w in words if rng.random() > rng.choice([0.0, 0.0, 0.1])] or words
                if len(kept) > 20 and rng.random() < 0.5:  # a window's part of a longer passage
                    at = int(rng.integers(0, len(kept) - 14))
                    kept = kept[at : at + int(rng.integers(14, 33))]
                out.append((family, within(kept)))
    for k in range(600):
        start = STARTS[k % len(STARTS)].split()
        tail = [] if "spdx" in start else ["license"]
        out.append((UNKNOWN, within(start + noise(int(rng.integers(1, 4))) + tail)))
    for k in range(600):
        words = NO_LICENCES[k % len(NO_LICENCES)].split()
        out.append((NONE, within([w for w in words if rng.random() > 0.1])))
        out.append((NONE, noise(int(rng.integers(1, 3))) * int(rng.integers(1, WINDOW))))
    return out


def fit(background: list[str], seed: int = 3, passes: int = 100, rate: float = 2.0) -> Classifier:
    """background: passages of documents. Those that hold a template are left out."""
    rng = np.random.default_rng(seed)
    plain = [x.said(0, len(x.starts)) for x in (Words.of(p.encode()) for p in background)]
    places = [int(rng.integers(0, max(1, len(w) - WINDOW + 1))) for w in plain]
    plain = [w[k : k + int(rng.integers(3, WINDOW + 1))] for w, k in zip(plain, places, strict=True) if w]
    plain = [w for w in plain if best_template(w, 0.5) is None]
    rows = _variants(rng, plain) + [(NONE, w) for w in plain]
    families = [NONE, UNKNOWN, *TEMPLATES]
    rng.shuffle(rows)
    hashes, y = [Words.of(" ".join(w).encode()).hashes for _, w in rows], np.array([families.index(f) for f, _ in rows])
    x = [np.concatenate([g[np.append(True, g[1:] != g[:-1])[: len(g)]] for g in grams(h)]) for h in hashes]
    cut, tune = len(rows) * 7 // 10, len(rows) * 17 // 20
    sizes = np.array([len(r) for r in x])
    at, row = np.concatenate(x[:cut]), np.repeat(np.arange(cut), sizes[:cut])
    scale = 1 / np.sqrt(sizes[:cut])
    order = np.argsort(at, kind="stable")
    places, firsts = np.unique(at[order], return_index=True)
    begins = np.concatenate([[0], np.cumsum(sizes[:cut])[:-1]])
    common = np.bincount(np.concatenate([np.unique(r) for r in x[:cut]]), minlength=DIMENSIONS)[places] >= COMMON
    weights, bias, seen = np.zeros((DIMENSIONS, len(families))), np.zeros(len(families)), 1e-6
    for _ in range(passes):
        slope = _softmax(np.add.reduceat(weights[at], begins, axis=0) * scale[:, None] + bias)
        slope[np.arange(cut), y[:cut]] -= 1
        step = np.add.reduceat((slope * scale[:, None])[row[order]], firsts, axis=0)
        seen = seen + float((step**2).mean())
        weights[places] -= rate * step * common[:, None] / np.sqrt(seen) / 4
        bias -= rate * slope.mean(axis=0)
    model = Classifier(families, weights, bias, 1.0)

    def judged(a: int, b: int) -> np.ndarray:
        ends = np.cumsum([len(h) for h in hashes[a:b]])
        return np.concatenate([model.probabilities(h, np.zeros(1, np.int64), np.array([len(h)])) for h in hashes[a:b]]) if len(ends) else np.zeros((0, len(families)))

    losses = {}
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        model.temperature = t
        losses[t] = -np.log(np.maximum(judged(cut, tune)[np.arange(tune - cut), y[cut:tune]], 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    p = judged(tune, len(rows))
    sure, right = p.max(axis=1), p.argmax(axis=1) == y[tune:]
    bins = np.minimum((sure * 10).astype(int), 9)
    model.error = float(sum(abs(sure[bins == k].mean() - right[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins)))
    model.weights = model.weights.astype(np.float32)
    return model


def _units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in words) of the lines and windows of a text, and the bounds of each word's paragraph."""
    n = len(words.starts)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(words.text, np.uint8) == 10), words.starts)
    paragraph = np.searchsorted([m.start() for m in BLANK.finditer(words.text)], words.starts)

    def runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if n else np.zeros(0, np.int64)
        return first, np.append(first[1:], n) if n else first

    (la, lb), (pa_, pb) = runs(line), runs(paragraph)
    short = lb - la <= 2 * WINDOW
    counts = np.maximum(0, -(-(pb - pa_ - WINDOW) // STRIDE)) + 1
    wa = np.repeat(pa_, counts) + STRIDE * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    wb = np.minimum(wa + WINDOW, np.repeat(pb, counts))
    sizes = pb - pa_
    return np.concatenate([la[short], wa]), np.concatenate([lb[short], wb]), np.repeat(pa_, sizes), np.repeat(pb, sizes)


def scan_text(text: str, model: Classifier, least: float = 0.1, cover: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(family or unknown, start, end, probability) of the licence passages in order; places in code points."""
    raw = text.encode()
    words = Words.of(raw)
    starts, ends, low, high = _units(words)
    if not len(starts):
        return []
    p = model.probabilities(words.hashes, starts, ends)
    likely = np.flatnonzero(p[:, 0] < 0.5)
    if not len(likely):
        return []
    hits: list[list] = []  # family, start, end (words), probability
    left = sorted((int(starts[k]), int(ends[k]), int(k)) for k in likely)
    while left:
        a, b, group = left[0][0], left[0][1], []
        while left and left[0][0] <= b and high[left[0][0]] == high[a]:
            group.append(left.pop(0))
            b = max(b, group[-1][1])
        found = []
        while group:
            a, b = group[0][0], max(g[1] for g in group)
            sure = p[[g[2] for g in group]].max(axis=0)
            x, y = max([int(low[a]), a - AROUND, *(f[2] for f in found if f[2] <= a)]), min([int(high[a]), b + AROUND, *(f[1] for f in found if f[1] >= b)])
            best = best_template(words.said(x, y), cover)
            if best is None or sure[model.families.index(best[0])] < least:
                if sure[1:].max() >= 0.5 and sum(q in _ALL_PAIRS for q in _pairs(words.said(a, b))) >= EVIDENCE:
                    found.append([UNKNOWN, a, b, float(sure[1:].max())])
                break
            # the run of the family's pairs, without a wide gap, that holds most of the template's
            at = np.array([k for k, q in enumerate(_pairs(words.said(x, y))) if q in _FAMILY_PAIRS[best[0]]]) + x
            of_best = {k + x for k in best[1]}
            run = max(np.split(at, np.flatnonzero(np.diff(at) > 12) + 1), key=lambda r: len(of_best.intersection(r.tolist())))
            start, end = int(run[0]), int(run[-1]) + 2
            found.append([best[0], start, end, float(sure[model.families.index(best[0])])])
            rest = [g for g in group if g[1] <= start or g[0] >= end]
            group = rest if len(rest) < len(group) else []
        hits += found
    hits.sort(key=lambda h: (h[1], h[2]))
    out: list[list] = []
    for h in hits:
        known = next((o for o in reversed(out) if o[0] != UNKNOWN), None)
        if h[0] != UNKNOWN and known and known[0] == h[0] and h[1] - known[2] <= APART:
            out = out[: out.index(known) + 1]
            known[2], known[3] = max(known[2], h[2]), max(known[3], h[3])
        elif h[0] != UNKNOWN or not any(o[1] < h[2] and h[1] < o[2] for o in out):
            out = [o for o in out if o[0] != UNKNOWN or o[2] <= h[1] or h[0] == UNKNOWN] + [h]
    place = lambda k: len(raw[:k].decode())
    return [(f, place(int(words.starts[a])), place(int(words.ends[b - 1])), q) for f, a, b, q in out]


def background_of(docs: DataFrame, id_col: str, text_col: str, negatives: int) -> list[str]:
    """Passages of at most PASSAGE_CHARS characters of about `negatives` documents, drawn by hash, at places drawn by hash."""
    drawn = draw(docs, [id_col], negatives, docs.count()).select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    begin = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - PASSAGE_CHARS, F.lit(0)) + 1).cast("int") + 1
    return [r["p"] for r in drawn.select(F.substring(F.col("t"), begin, F.lit(PASSAGE_CHARS)).alias("p")).orderBy("p").collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.1, cover: float = 0.6, negatives: int = NEGATIVES) -> DataFrame:
    """id_col and licences, an array of (family, start, end, probability) in order of place, for every row.

    About `negatives` documents, drawn by the hash of their ids, give background passages for training. Null and empty
    texts hold no licence; very long ones are read whole. Repeated rows keep their rows; no rows give no rows. Other columns
    are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(background_of(docs, id_col, text_col, negatives)))
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("family", "start", "end", "probability"), h, strict=True)) for h in scan_text(t.as_py().decode(), model.value, least, cover)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], ["id", "licences"])

    out = docs.select(docs[id_col].alias("id"), text_bytes(docs[text_col]).alias("t")).mapInArrow(run, f"id {kind}, licences array<struct<family:string,start:long,end:long,probability:double>>")
    return out.select(F.col("id").alias(id_col), "licences")
