"""License scans: winnowed fingerprints pick templates, banded alignment confirms them.

Templates are few and short, and their fingerprints form an inverted index that travels with
the task (its size is checked). Templates of under SHORT words are indexed by every pair of
neighbouring words, so a copy is found while one pair of its words is left. A document shares a
fingerprint with a longer template wherever both have FINGERPRINT + WINNOW - 1 words in a row
in common, which every copy has that lacks a fifth of the words, wherever they lie. Hits on
nearby diagonals become one candidate, and an alignment in a band around them reports how much
of the template is there and where. Hits up to a template's length apart are then chained, and
an alignment without a band finds copies that long insertions or cuts tear apart.

Notices of different licenses share a frame ("Licensed under the ... License"). What tells them
apart, their own words, comes from comparing templates, and a copy without them is no match. A
frame around a name that no template has is reported as UNKNOWN.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.text import gram_hashes, hashes, plain_words

FINGERPRINT = 3  # words of a fingerprint
WINNOW = 2  # neighbouring fingerprints of which the smallest is kept
SHORT = 20  # template words; below, every pair of neighbours is a fingerprint
LONG = 100  # template words; above, copies are aligned without a band only
BAND = 8  # words by which a copy may drift from the template's course
MIN_COVERAGE = 0.8  # matched share of the template's words
MAX_INDEX_WORDS = 1_000_000
FRAME_SHARE = 0.4  # of the licenses' names: a word in so many of them belongs to the frame
UNKNOWN = "unknown"  # reported for a frame around a foreign name
FRAME_NAME = 8  # most words of such a name

# Notices, headers of source files and openings of license texts.
_NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT opening": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "BSD opening": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "Apache-2.0 header": (
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation"
    ),
    **{
        f"GPL-{version}.0 header": (
            f"This program is free software{stop} you can redistribute it and/or modify it under "
            f"the terms of the GNU General Public License as published by the Free Software "
            f"Foundation{stop} either version {version} of the License, or (at your option) any "
            f"later version. This program is distributed in the hope that it will be useful, but "
            f"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
            f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
            f"details. You should have received a copy of the GNU General Public License along "
            f"with this program"
        )
        for version, stop in ((2, ";"), (3, ","))
    },
    "AGPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Affero General Public License for more details. You should have received a copy of the "
        "GNU Affero General Public License along with this program."
    ),
    "LGPL-2.1 header": (
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Lesser General Public License for more details. You should have received a copy "
        "of the GNU Lesser General Public License along with this library."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
}
# Each gives the notices "Licensed under ...", "Released under ..." and "This work is licensed under ...".
_NAMES = {
    "MIT": "the MIT License",
    "ISC": "the ISC License",
    "BSD": "the BSD License",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "Apache-2.0": "the Apache License, Version 2.0",
    "MPL-2.0": "the Mozilla Public License, Version 2.0",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "CC0-1.0": "CC0 1.0",
    **{
        f"CC-{kind}-4.0": f"CC {kind} 4.0"
        for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
    },
}
# Whole texts, in license_texts; no text of the AGPL or of CC licenses but CC0 was at hand.
_TEXTS = (
    "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2",
    "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
    "MIT", "MPL-1.1", "MPL-2.0",
)


def _templates() -> dict[str, str]:
    out = dict(_NOTICES)
    for name, words in _NAMES.items():
        for verb in ("Licensed", "Released", "This work is licensed"):
            notice = f"{verb} under {words}."
            if notice not in out.values():
                out[f"{name} ({verb.lower()})"] = notice
    for name in _TEXTS:
        data = pkgutil.get_data("kinweave.llm", f"license_texts/{name}.txt")
        out[f"{name} text"] = data.decode("utf-8")
    return out


TEMPLATES = _templates()
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def winnow(words: list[bytes], h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chosen fingerprints and the word places where they begin; ``h`` are the words' hashes."""
    g = gram_hashes(hashes(words) if h is None else h, FINGERPRINT)
    if len(g) < WINNOW:
        return g, np.arange(len(g))
    rows = np.lib.stride_tricks.sliding_window_view(g, WINNOW)
    at = np.unique(rows.argmin(axis=1) + np.arange(len(rows)))
    return g[at], at


def _license(name: str) -> str:
    return name.split(" ")[0]


def _shared(a: list[bytes], b: list[bytes]) -> int:
    """Most words of ``a`` and ``b`` in common order."""
    masks: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(a):
        masks[w] |= 1 << i
    return _matched(masks, len(a), b, range(len(b)), len(a))[0]


def own_words(templates: Mapping[str, list[bytes]], names: Mapping[str, str]) -> dict[str, frozenset[bytes]]:
    """Per template, the words without which a copy is one of another license.

    Of a notice, the words of its license's name that are rare among the names of the
    templates' licenses, and its numbers (but 0, which is often left out). Of an excerpt of up
    to LONG words, what it has and a similar excerpt of another license has not.
    """
    present = {_license(n) for n in templates}
    parts = {n: set(plain_words(t)) for n, t in names.items() if n in present}
    common = Counter(w for words in parts.values() for w in words)
    rare = {
        n: {w for w in words if (w.isdigit() and w != b"0") or common[w] < FRAME_SHARE * len(parts)}
        for n, words in parts.items()
    }
    out: dict[str, set[bytes]] = {}
    excerpts = {n: w for n, w in templates.items() if SHORT <= len(w) <= LONG}
    for name, words in templates.items():
        if len(words) < SHORT and len(parts) > 1:
            out[name] = rare.get(_license(name), set()) & set(words)
        for other, theirs in excerpts.items() if name in excerpts else ():
            if _license(other) != _license(name) and _shared(words, theirs) >= MIN_COVERAGE * len(words):
                out.setdefault(name, set()).update(set(words) - set(theirs))
    return {n: frozenset(w) for n, w in out.items() if w}


def _gap(size: int) -> int:
    """Words that a document may have between two hits of one copy."""
    return max(BAND, size) + FINGERPRINT + WINNOW


class TemplateIndex:
    """Fingerprint -> (template, place); templates without words are left out."""

    def __init__(self, templates: Mapping[str, str], names: Mapping[str, str] = _NAMES):
        self.words = {n: w for n, t in templates.items() if (w := plain_words(t))}
        if sum(map(len, self.words.values())) > MAX_INDEX_WORDS:
            raise ValueError("too many template words for an index that every task holds")
        entries: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            if len(words) < SHORT:
                g = gram_hashes(hashes(words), min(2, len(words)))
                grams = zip(g.tolist(), range(len(g)), strict=True)
            else:
                grams = zip(*map(np.ndarray.tolist, winnow(words)), strict=True)
            for x, at in grams:
                entries[x].append((name, at))
        self.sizes = {min(2, len(w)) for w in self.words.values() if len(w) < SHORT}
        self.entries = dict(entries)
        self.keys = np.array(sorted(self.entries), np.uint64)
        self.own = own_words(self.words, names)
        self._masks: dict[str, tuple[dict[bytes, int], dict[bytes, int]]] = {}

    def near(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """Per template with own words that are all in the text, the places near all of them.

        A copy cannot reach further from its own words than all its gaps together.
        """
        places: dict[bytes, list[int]] = {w: [] for own in self.own.values() for w in own}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        out = {}
        for name, own in self.own.items():
            if all(places[w] for w in own):
                size = len(self.words[name])
                reach, mask = size * (_gap(size) + 1), np.ones(len(words), bool)
                for w in own:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.array(places[w])
                    np.add.at(change, np.maximum(at - reach, 0), 1)
                    np.add.at(change, np.minimum(at + reach + 1, len(words)), -1)
                    mask &= np.cumsum(change)[:-1] > 0
                out[name] = mask
        return out

    def hits(self, words: list[bytes]) -> dict[str, list[tuple[int, int]]]:
        """Per template, the (document place, template place) of shared fingerprints.

        Hits far from the template's own words are left out, since no copy is there.
        """
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        if not words or len(self.keys) == 0:
            return found
        h = hashes(words)
        grams = [((g := gram_hashes(h, n)), np.arange(len(g))) for n in sorted(self.sizes)]
        near: dict[str, np.ndarray] | None = None
        for g, at in [*grams, winnow(words, h)]:
            key = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            hit = self.keys[key] == g
            if not hit.any():
                continue
            near = self.near(words) if near is None else near
            key, at = key[hit], at[hit]
            order = np.argsort(key, kind="stable")
            chosen, first = np.unique(key[order], return_index=True)
            for k, places in zip(chosen.tolist(), np.split(at[order], first[1:]), strict=True):
                for name, q in self.entries[int(self.keys[k])]:
                    if name in self.own:
                        places_here = places[near[name][places]] if name in near else places[:0]
                    else:
                        places_here = places
                    found[name] += [(p, q) for p in places_here.tolist()]
        return {n: sorted(f) for n, f in found.items() if f}

    def names_itself(self, name: str, words: list[bytes]) -> bool:
        """Whether the template's own words are all among the words."""
        return name not in self.own or self.own[name].issubset(words)

    def masks(self, name: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
        """Bits of a word's places in the template, counted from its start and from its end."""
        if name not in self._masks:
            ahead: dict[bytes, int] = defaultdict(int)
            back: dict[bytes, int] = defaultdict(int)
            words = self.words[name]
            for i, w in enumerate(words):
                ahead[w] |= 1 << i
                back[w] |= 1 << (len(words) - 1 - i)
            self._masks[name] = dict(ahead), dict(back)
        return self._masks[name]


def bands(hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Lowest and highest diagonal (document - template place) of nearby hits."""
    low = high = None
    for d in sorted({p - q for p, q in hits}):
        if high is not None and d - low <= BAND:
            high = d
        else:
            if high is not None:
                yield low, high
            low = high = d
    if high is not None:
        yield low, high


def chains(hits: list[tuple[int, int]], size: int, count: int) -> Iterator[tuple[int, int]]:
    """Where a template of ``size`` words may lie around hits that belong together.

    Between two hits the document may have as many words more than the template as the whole
    template has.
    """
    gap = _gap(size)
    begin = stop = last = last_q = None
    for p, q in sorted(hits):
        if last is not None and p - last > gap + max(0, q - last_q):
            yield max(0, begin), min(count, stop)
            begin = stop = None
        begin = p - q - BAND if begin is None else min(begin, p - q - BAND)
        stop = p - q + size + BAND if stop is None else max(stop, p - q + size + BAND)
        last, last_q = p, q
    if last is not None:
        yield max(0, begin), min(count, stop)


def _matched(
    masks: Mapping[bytes, int], size: int, words: list[bytes], places: range, enough: int,
    least: float = float("inf"), gap: int = 0,
) -> tuple[int, int]:
    """Most template words in order among the words at ``places``, and how many were read for it.

    A bit of ``open_`` is cleared per matched word, a whole column of the alignment at once.
    From ``least`` matches on, the reading ends once ``gap`` words have added none.
    """
    full = open_ = (1 << size) - 1
    best = reach = 0
    for j, at in enumerate(places, 1):
        mask = masks.get(words[at])
        if mask:
            used = open_ & mask
            open_ = ((open_ + used) | (open_ - used)) & full
            m = size - open_.bit_count()
            if m > best:
                best, reach = m, j
                if m >= enough:
                    break
        if best >= least and j - reach > gap:
            break
    return best, reach


def align_anywhere(
    index: TemplateIndex, name: str, words: list[bytes], begin: int = 0, stop: int | None = None,
    least: float = float("inf"),
) -> tuple[int, int, int]:
    """Most template words matched in order, without a band: (matched, first, end).

    Of equal counts the one that ends first wins, from the last place it can begin at. With
    ``least`` it is the first copy of so many words, as far as it goes on without a longer gap.
    """
    ahead, back = index.masks(name)
    size = len(index.words[name])
    stop = len(words) if stop is None else stop
    matched, read = _matched(ahead, size, words, range(begin, stop), size, least, _gap(size))
    if not matched:
        return 0, 0, 0
    end = begin + read
    _, length = _matched(back, size, words, range(end - 1, begin - 1, -1), matched)
    return matched, end - length, end


def align(template: list[bytes], words: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Most template words matched in order inside the band, and the words spanned.

    Cells lie within BAND of the diagonals low..high. Among equal counts the shortest
    span wins. Returns (matched, first word, end word); nothing matched gives (0, 0, 0).
    """
    none = (0, 0, 0)  # matched, minus span, first
    last: dict[int, tuple[int, int, int]] = {}
    best, best_end = none, 0
    for i, t in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        left = none
        for j in range(max(0, i + low - BAND), min(len(words), i + high + BAND + 1)):
            state = max(last.get(j, none), left)
            if words[j] == t:
                m, _, first = last.get(j - 1, none)
                first = first if m else j
                state = max(state, (m + 1, first - j, first))
            row[j] = left = state
            if state[0] > best[0] or state[0] == best[0] and state[1] > best[1]:
                best, best_end = state, state[2] - state[1] + 1
        last = row
    return best[0], best[2], best_end


def _matches(
    template: list[bytes], words: list[bytes], low: int, high: int, begin: int, stop: int
) -> Iterator[tuple[int, int, int]]:
    """(matched, first, end) of all copies of a template near a candidate, best ones first.

    What lies before and behind a copy may hold another, so both are aligned again.
    """
    least = MIN_COVERAGE * len(template)
    todo = [(begin, stop)]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        matched, first, end = align(template, words[a:b], low - a, high - a)
        if matched and matched >= least:
            yield matched, first + a, end + a
            todo += [(a, first + a), (end + a, b)]


def _torn_matches(
    index: TemplateIndex, name: str, words: list[bytes], regions: Iterator[tuple[int, int]]
) -> Iterator[tuple[int, int, int]]:
    """(matched, first, end) of the copies in regions of the document, without a band.

    A region's words are counted once. A copy is read as far as it goes, and what lies behind
    it is read on from there, so the time is linear in the region.
    """
    template = index.words[name]
    least = MIN_COVERAGE * len(template)
    has = Counter(template)
    for a, b in regions:
        inside = words[a:b]
        if b - a < least or (Counter(inside) & has).total() < least or not index.names_itself(name, inside):
            continue
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if b - a < least:
                continue
            matched, first, end = align_anywhere(index, name, words, a, b, least)
            if matched >= least:
                yield matched, first, end
                todo += [(end, b), (a, first)]


def _free(
    begin: int, stop: int, taken: list[tuple[int, int]], longest: int
) -> Iterator[tuple[int, int]]:
    """What the sorted spans ``taken``, none over ``longest`` words, leave of begin..stop."""
    for k in range(bisect_right(taken, (begin - longest, 0)), len(taken)):
        first, end = taken[k]
        if first >= stop:
            break
        if end > begin:
            if first > begin:
                yield begin, first
            begin = max(begin, end)
    if begin < stop:
        yield begin, stop


# Fixed value: the words around a license's name.
_FRAME = ("licensed or released", "under", "the", "license")


def _foreign_frames(words: list[bytes], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of "licensed/released under the ... license" that no match of a template touches."""
    covered = np.zeros(len(words) + 1, np.int64)
    for first, end in taken:
        covered[first] += 1
        covered[end] -= 1
    covered = np.cumsum(covered)
    for i, w in enumerate(words):
        if w in (b"licensed", b"released") and words[i + 1 : i + 3] == [b"under", b"the"]:
            name = words[i + 3 : i + 4 + FRAME_NAME]
            end = i + 4 + name.index(b"license", 1) if b"license" in name[1:] else 0
            if end and not covered[i:end].any():
                yield i, end


def scan_text(text: str | None, index: TemplateIndex) -> list[tuple[str, int, float, int, int]]:
    """(template, matched words, coverage, start, end) in code points, by start.

    A match holds its template's own words. A frame around a foreign name is UNKNOWN. Of
    overlapping matches of one template the best covered stays, the earlier on a tie. A
    match also goes where a template of at most twice its length, such as the same notice of
    another license, matches more there and is covered no less, or as much and covered better.
    """
    words = plain_words(text)
    matches = []
    for name, hits in index.hits(words).items():
        template = index.words[name]
        found = []
        for low, high in bands(hits) if len(template) <= LONG else ():
            begin, stop = max(0, low - BAND), min(len(words), high + len(template) + BAND)
            if index.names_itself(name, words[begin:stop]):
                found += _matches(template, words, low, high, begin, stop)
        spans = sorted((first, end) for _, first, end in found)
        longest = max((end - first for first, end in spans), default=0)
        for begin, stop in chains(hits, len(template), len(words)):
            found += _torn_matches(index, name, words, _free(begin, stop, spans, longest))
        matches += [
            (-m / len(template), first, end, name, m)
            for m, first, end in found
            if index.names_itself(name, words[first:end])
        ]
    foreign = list(_foreign_frames(words, [m[1:3] for m in matches]))
    if not matches and not foreign:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    taken = {name: np.zeros(len(words), bool) for name in {m[3] for m in matches}}
    out = []
    for coverage, first, end, name, matched in sorted(matches):
        if not taken[name][first:end].any():
            taken[name][first:end] = True
            out.append((name, matched, -coverage, first, end))
    out.sort(key=lambda m: (m[3], m[0]))
    kept = [m for m, better in zip(out, _outdone(out, index), strict=True) if not better]
    kept += [(UNKNOWN, len(_FRAME), 1.0, first, end) for first, end in foreign]
    kept.sort(key=lambda m: (m[3], m[0]))
    return [(*m[:3], spans[m[3]][0], spans[m[4] - 1][1]) for m in kept]


def _outdone(matches: list[tuple[str, int, float, int, int]], index: TemplateIndex) -> list[bool]:
    """Whether a better match of a template of at most twice the length overlaps; by start."""
    out = [False] * len(matches)
    open_: list[int] = []
    for i, m in enumerate(matches):
        open_ = [j for j in open_ if matches[j][4] > m[3]]
        for j in open_:
            for a, b in ((i, j), (j, i)):
                (x, xm, xc, *_), (y, ym, yc, *_) = matches[a], matches[b]
                if len(index.words[y]) <= 2 * len(index.words[x]):
                    out[a] |= ym >= xm and yc >= xc and (ym, yc) != (xm, xc)
        open_.append(i)
    return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per match: doc_id, template, matched, coverage, start and end in code points.

    Null and empty texts have no match. Repeated rows are scanned one by one, and a
    template that occurs several times in a text gives as many rows. UNKNOWN stands for a
    notice of a license that no template names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("template", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64())]
    fields += [("start", pa.int64()), ("end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        for batch in batches:
            rows, owners = [], []
            for i, t in enumerate(batch.column("text")):
                found = scan_text(t.as_py(), index)
                rows += found
                owners += [i] * len(found)
            ids = batch.column("doc_id").take(pa.array(owners, pa.int64()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)]],
                ["doc_id", *[n for n, _ in fields]],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, template string, matched bigint, coverage double, start bigint, end bigint"
    )
