"""Operator 1: licence scan of paragraphs.

A softmax regression on sparse word 1- and 2-grams (those that occur in the
templates below, and the number of other words) names a licence family or 'unknown'.
It is trained here, on variants of the templates, and for the unknown class on a
sample of at most ``SAMPLE`` stretches of the corpus, those of least hash over all
rows, and on scrambled templates.  On a held-out part the logits are scaled
(temperature) and the least probability is set that lets at most ``FALSE`` of the
corpus' stretches through, but not more than ``LOST`` of the variants fall below; there a
stretch is unknown.

Every text is scored whole: ``WINDOWS`` of words slide over its blocks (up to a blank
line), over line ends, and all windows of a batch are scored at once by running sums of
the weights.  Where a window may hold a licence (the bound is set on held-out variants,
so that but ``MISS`` of them pass), the templates' word pairs round it are compared:
a prediction counts if the words also hold ``CONFIRM`` of the word pairs of a part
(``PART`` pairs in a row, or all) of a template of that family, one pair among them that
no other kind of licence has, and no less than of any other family.  Templates are those
below and ``VERBS`` x ``NAMES``.  SPDX tags are read by their ids; an id of none of the
families gives nothing.

A paragraph is a line; a licence counts for the line that it begins in; signs of
comments don't count as words.  Defined cases: null or empty text has no paragraphs and
no families; paragraphs of any length are taken whole; of families of equal share and
length the last in order of the alphabet is taken, of equal probabilities the first of
``FAMILIES``; repeated rows give repeated rows; other columns are ignored; an empty table
gives no rows (and trains on templates alone).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _CLEAR, U64, claim, mix, slices, table

SAMPLE, FALSE, LOST, MISS, CONFIRM, PART, GAP = 3000, 0.001, 0.01, 0.002, 0.7, 12, 8
#: Words of a window, and how far the next one begins.
WINDOWS = [(8, 4), (24, 12)]
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "This work is dedicated to the public domain under the CC0 1.0 Universal dedication."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this document may be reproduced without written permission of the copyright holder.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
VERBS = ["Licensed under the", "Released under the", "Distributed under the", "Licensed under"]
_GNU = ["", " version 2", " version 2.0", " version 2.1", " version 3", " version 3.0", " v2", " v2.0", " v2.1", " v3", " v3.0", " 2.0", " 2.1", " 3.0"]
NAMES = {
    "apache-1.1": ["Apache License Version 1.1", "Apache License 1.1", "Apache Software License Version 1.1"],
    "apache-2.0": ["Apache License", "Apache License Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License Version 2.0"],
    "mit": ["MIT License", "MIT X11 License", "terms of the MIT License"],
    "gpl": [x + v for x in ("GNU General Public License", "GNU GPL", "GPL") for v in _GNU] + ["GPLv2", "GPLv3", "terms of the GNU General Public License"],
    "lgpl": [x + v for x in ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL") for v in _GNU] + ["LGPLv2", "LGPLv2.1", "LGPLv3", "terms of the GNU Lesser General Public License"],
    "agpl": [x + v for x in ("GNU Affero General Public License", "GNU AGPL", "AGPL") for v in _GNU] + ["AGPLv3", "terms of the GNU Affero General Public License"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD 4-Clause License", "2-Clause BSD License", "3-Clause BSD License", "New BSD License", "Simplified BSD License", "Modified BSD License"],
    "mpl-1.1": ["Mozilla Public License Version 1.1", "Mozilla Public License 1.1", "Mozilla Public License v. 1.1", "MPL 1.1"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v. 2.0", "MPL 2.0"],
    "cc-by": [f"{x}{k} {v}" for k in ("", "-SA", "-ND") for v in ("2.0", "2.5", "3.0", "4.0") for x in ("CC BY", "CC-BY")] + [f"Creative Commons Attribution{k} {v} {w} License" for k in ("", "-ShareAlike", "-NoDerivatives") for v, w in (("3.0", "Unported"), ("4.0", "International"))],
    "cc-by-nc": [f"{x}-NC{k} {v}" for k in ("", "-SA", "-ND") for v in ("2.0", "2.5", "3.0", "4.0") for x in ("CC BY", "CC-BY")] + [f"Creative Commons Attribution-NonCommercial{k} {v} {w} License" for k in ("", "-ShareAlike", "-NoDerivatives") for v, w in (("3.0", "Unported"), ("4.0", "International"))],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "unlicense": ["Unlicense"],
    "isc": ["ISC License", "terms of the ISC License"],
}
#: Names that stand between "is" or "are" and "licensed".
SHORT = {"mit": ["MIT"], "apache-2.0": ["Apache 2.0", "Apache-2.0"], "bsd": ["BSD"], "gpl": ["GPL", "GPLv2", "GPLv3"], "lgpl": ["LGPL"], "agpl": ["AGPL"], "mpl-2.0": ["MPL 2.0"], "isc": ["ISC"], "cc0": ["CC0"]}
_KIND, _VERSION = {"lgpl": "gpl", "agpl": "gpl", "cc0": "cc"}, re.compile(r"v?[\d.,;:]*")
FAMILIES = [*TEMPLATES, *(f for f in NAMES if f not in TEMPLATES), "unknown"]
#: Families of SPDX ids, by the first pattern that fits the id in small letters.
SPDX = [(re.compile(p), f) for p, f in [(r"apache-1\.", "apache-1.1"), (r"apache-2\.0", "apache-2.0"), (r"mit($|-)", "mit"), (r"gpl-", "gpl"), (r"lgpl-", "lgpl"), (r"agpl-", "agpl"), (r"0?bsd($|-)", "bsd"), (r"mpl-1\.", "mpl-1.1"), (r"mpl-2\.", "mpl-2.0"), (r"cc-by-nc-", "cc-by-nc"), (r"cc-by-", "cc-by"), (r"cc0-", "cc0"), (r"unlicense$", "unlicense"), (r"isc$", "isc"), (r"licenseref-proprietary", "proprietary")]]
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\s*<>]+(?:[ \t]+(?:and|or|with)[ \t]+[^\s*<>]+)*)", re.I)


def spdx(line: str) -> list[str]:
    """Families of the ids in the SPDX tags of a line (what follows WITH is an exception, not a licence)."""
    found = []
    for tag in _TAG.findall(line):
        ids = re.split(r"\s+(?:and|or)\s+", tag.lower())
        found += [f for x in ids for f in [next((f for p, f in SPDX if p.match(x.strip("()\"',;").split()[0].strip("()\"',;"))), None)] if f] if all(x.strip("()\"',;") for x in ids) else []
    return list(dict.fromkeys(found))


class _Words(dict):
    """Hash of a word without its case and outer punctuation."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.strip(b".,;:()[]{}\"'!?<>*#/").lower())
        return h


_HASH = _Words()
_CLEAR.append(_HASH.clear)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), U64, len(words))


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U64(3) + h[1:])


def windows_of(size: np.ndarray, wide: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the windows of stretches of words that follow one another; the last of each reaches its end."""
    n = 1 + np.maximum(0, -(-(size - wide) // step))
    begin = np.cumsum(size) - size
    first = np.repeat(begin, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return first, np.minimum(first + wide, np.repeat(begin + size, n))


def _share(at: list[tuple[int, bool]], size: int) -> float:
    """The largest share of ``PART`` pairs in a row (or of all) that were found; 0 without an own pair among them."""
    hit, own = np.zeros(size), np.zeros(size)
    for i, o in at:
        hit[i], own[i] = 1, max(own[i], o)
    part = np.ones(min(PART, size))
    return float((np.convolve(hit, part, "valid") / len(part) * (np.convolve(own, part, "valid") > 0.5)).max())


class Scanner:
    """Features, model and templates; small (some thousand numbers), sent to the executors with the function."""

    def __init__(self):
        grams, self.templates, self.forms = [], [], {f: list(TEMPLATES.get(f, [])) for f in FAMILIES[:-1]}
        for family, names in NAMES.items():
            self.forms[family] += [f"{v} {x}" for v in VERBS for x in names]
        for family, names in SHORT.items():
            self.forms[family] += [f"{v} {x} licensed" for v in ("is", "are") for x in names]
        hashed = [(f, _hashes(t.encode().split()), t.split()) for f, ts in self.forms.items() for t in ts]
        kinds: dict[int, set[str]] = {}
        for family, h, _ in hashed:
            for x in h.tolist():
                kinds.setdefault(x, set()).add(_KIND.get(family, family.split("-")[0]))
        self.places: dict[int, list[tuple[int, int, bool]]] = {}  # of each pair: template, position, whether a word of it is known from one kind of licence alone
        for k, (family, h, words) in enumerate(hashed):
            grams += [h, _bigrams(h)]
            self.templates.append((family, len(h) - 1))
            own = [len(kinds[x]) == 1 and not _VERSION.fullmatch(w) for x, w in zip(h.tolist(), words)]
            for i, x in enumerate(_bigrams(h).tolist()):
                self.places.setdefault(x, []).append((k, i, own[i] or own[i + 1]))
        self.grams = np.unique(np.concatenate(grams))
        self.pairs = np.unique(np.concatenate(grams[1::2]))
        self.weights = np.zeros((len(self.grams) + 2, len(FAMILIES)))
        self.temperature, self.least, self.propose = 1.0, 0.5, 0.5

    def vector(self, h: np.ndarray) -> np.ndarray:
        """Counts of the known n-grams and of the other words, over the root of the number of words; and a constant."""
        x = np.zeros(len(self.grams) + 2)
        both = np.concatenate([h, _bigrams(h)])
        at = np.searchsorted(self.grams, both)
        at[at == len(self.grams)] = 0
        hit = self.grams[at] == both
        np.add.at(x, at[hit], 1)
        x[-2] = (~hit[: len(h)]).sum()
        x /= max(1, len(h)) ** 0.5
        x[-1] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def confirmed(self, h: np.ndarray) -> dict[str, float]:
        """By family, the largest share of the word pairs of a part of a template that the paragraph holds, with a pair of that kind alone."""
        hits: dict[int, list[tuple[int, bool]]] = {}
        for x in set(_bigrams(h).tolist()):
            for k, i, own in self.places.get(x, ()):
                hits.setdefault(k, []).append((i, own))
        out: dict[str, float] = {}
        for k, at in hits.items():
            family, size = self.templates[k]
            if len(at) >= CONFIRM * min(PART, size) and (share := _share(at, size)) > out.get(family, 0.0):
                out[family] = share
        return out

    def train(self, others: list[str], seed: int = 1) -> Scanner:
        rng = np.random.default_rng(seed)
        """others: stretches of the corpus."""
        filler = [w for p in others for w in p.split()] or ["lorem", "ipsum", "dolor", "amet"]
        filler = np.array(filler, dtype=object)
        rows, y = [], []
        add = lambda words, label: (rows.append(self.vector(_hashes(" ".join(words).encode("utf-8", "replace").split()))), y.append(label))
        for label, family in enumerate(FAMILIES[:-1]):
            long = [t for t in self.forms[family] if len(t.split()) > PART + 1]
            for k in range(240):
                words = rng.choice(long if k % 2 and long else TEMPLATES[family] if k % 4 and family in TEMPLATES else self.forms[family]).split()
                if len(words) > PART + 1 and rng.random() < 0.7:
                    a = rng.integers(0, len(words) - PART)
                    words = words[a : a + rng.integers(PART, len(words) - a + 1)]
                if rng.random() < 0.3:
                    words[rng.integers(len(words))] = rng.choice(filler)
                if rng.random() < 0.5:
                    pad = list(rng.choice(filler, rng.integers(1, 15)))
                    words = pad + words if rng.random() < 0.5 else words + pad
                add(words, label)
        unknown = len(FAMILIES) - 1
        every = np.array([w for t in TEMPLATES.values() for x in t for w in x.split()], dtype=object)
        mixed = np.concatenate([filler, every[:20]])
        scrambled = [" ".join(rng.choice(every if rng.random() < 0.3 else mixed, rng.integers(3, 40))) for _ in range(600)]
        real = []
        for k, p in enumerate([*others, *scrambled]):
            h = _hashes(p.encode("utf-8", "replace").split())
            known = np.isin(_bigrams(h), self.pairs).any() if len(h) > 1 else False
            if len(h) and not (known and max(self.confirmed(h).values(), default=0.0) >= CONFIRM):
                real += [len(rows)] * (k < len(others))
                rows.append(self.vector(h))
                y.append(unknown)
        x, y = np.array(rows), np.array(y)
        held = rng.random(len(y)) < 0.3
        self._fit(x[~held], y[~held])
        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: self._loss(x[held], y[held], t))
        p = self.probabilities(x[np.array([k for k in real if held[k]], np.int64)])[:, :-1].max(axis=1, initial=0.0)
        right = self.probabilities(x[held & (y != unknown)])[np.arange((held & (y != unknown)).sum()), y[held & (y != unknown)]]
        high = float(np.quantile(right, LOST)) if len(right) else 0.5  # the sample may hold parts of licences
        self.least = max(0.5, min(high, float(np.quantile(p, 1 - FALSE)))) if len(p) else 0.5
        known = 1 - self.probabilities(x[held & (y != unknown)])[:, -1]
        self.propose = min(0.5, float(np.quantile(known, MISS))) if len(known) else 0.5
        return self

    def _loss(self, x, y, t) -> float:
        self.temperature = t
        return float(-np.log(self.probabilities(x)[np.arange(len(y)), y] + 1e-12).mean())

    def _fit(self, x, y, steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> None:
        w = np.zeros_like(self.weights)
        one = np.eye(len(FAMILIES))[y]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for i in range(1, steps + 1):
            self.weights = w
            g = x.T @ (self.probabilities(x) - one) / len(y) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        self.weights = w

    def paragraphs(self, text: str | None):
        """(paragraphs, matches) of a text; a match: (paragraph number, family, probability, share of a template)."""
        return self.matches([text])[0]

    def matches(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, str, float, float]]]]:
        """What ``paragraphs`` gives, for each of the texts."""
        cut = [(t or "").split("\n") for t in texts]
        count = np.array([len(x) for x in cut])
        top = np.cumsum(count) - count  # each text's first line
        words = [x.encode("utf-8", "replace").split() for lines in cut for x in lines]
        size = np.fromiter(map(len, words), np.int64, len(words))
        n = np.add.reduceat((size > 0).astype(np.int64), top) if len(top) else top
        out: list[list] = [[(k, f, 1.0, 1.0) for k, x in enumerate(lines) for f in spdx(x)] if t and "spdx-" in t.lower() else [] for t, lines in zip(texts, cut)]
        new = size == 0
        new[top] = True
        h = _hashes([w for ws in words for w in ws])
        line = np.repeat(np.arange(len(words)), size)
        block = np.cumsum(new)[line]  # a blank line ends a block, and so does a text
        real = h != _HASH[b""]  # not a comment sign alone
        h, line, block = h[real], line[real], block[real]
        if len(h) > 1:
            pairs = _bigrams(h)
            inside = block[1:] == block[:-1]
            cover = self._proposed(h, pairs, inside, block)
            at = np.searchsorted(self.pairs, pairs)
            at[at == len(self.pairs)] = 0
            where = np.flatnonzero((self.pairs[at] == pairs) & inside)
            for part in np.split(where, np.flatnonzero((np.diff(where) > GAP) | (np.diff(block[where]) > 0)) + 1) if len(where) else ():
                if cover[part[0] : part[-1] + 2].any() and any(own for x in pairs[part].tolist() for _, _, own in self.places[x]):
                    k = int(np.searchsorted(top, line[part[0]], side="right")) - 1
                    tagged = {m[0] for m in out[k] if m[2] == m[3] == 1.0 and m[1] in spdx(cut[k][m[0]])} if out[k] else set()
                    out[k] += [(int(line[a] - top[k]), f, p, share) for a, f, p, share in self._notices(h, pairs, part) if int(line[a] - top[k]) not in tagged]
        return [(int(x), sorted(m, key=lambda m: m[0])) for x, m in zip(n, out)]

    def _proposed(self, h: np.ndarray, pairs: np.ndarray, inside: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Of each word, whether a window with it may hold a licence."""

        def sums(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Number of known n-grams before each place, and the sums of their weights by that number."""
            at = np.searchsorted(self.grams, x)
            at[at == len(self.grams)] = 0
            hit = (self.grams[at] == x) & counts
            rows = self.weights[at[hit]]
            return np.concatenate([[0], np.cumsum(hit)]), np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])

        n1, w1 = sums(h, np.ones(len(h), bool))
        n2, w2 = sums(pairs, inside)
        length = np.diff(np.append(np.flatnonzero(np.append(True, ~inside)), len(h)))
        mark = np.zeros(len(h) + 1, np.int64)
        for wide, step in WINDOWS:
            a, b = windows_of(length, wide, step)
            known = n1[b] - n1[a]
            z = w1[n1[b]] - w1[n1[a]] + w2[n2[b - 1]] - w2[n2[a]] + (b - a - known)[:, None] * self.weights[-2]
            z = (z / np.sqrt(b - a)[:, None] + self.weights[-1]) / self.temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            maybe = z[:, -1] <= (1 - self.propose) * z.sum(axis=1)
            np.add.at(mark, a[maybe], 1)
            np.add.at(mark, b[maybe], -1)
        return np.cumsum(mark[:-1]) > 0

    def _notices(self, h: np.ndarray, pairs: np.ndarray, part: np.ndarray) -> list[tuple[int, str, float, float]]:
        """(first word, family, probability, share) of the licences in a stretch with hits at part, none over another.

        A template's pairs in order, at most ``GAP`` words from one to the next, make a run;
        what is judged is the words of a run, so neither line ends nor the text round it count.
        """
        runs: dict[int, list[list[tuple[int, int, bool]]]] = {}
        for a in part.tolist():
            here: dict[int, list[tuple[int, bool]]] = {}
            for k, i, own in self.places[int(pairs[a])]:
                here.setdefault(k, []).append((i, own))
            for k, spots in here.items():
                own_runs = runs.setdefault(k, [])
                last = own_runs[-1][-1] if own_runs else None
                nxt = min((x for x in spots if last and x[0] > last[1]), default=None)
                if last and nxt and a - last[0] <= GAP:
                    own_runs[-1].append((a, *nxt))
                else:
                    own_runs.append([(a, *min(spots))])
        found = []
        for k, own_runs in runs.items():
            family, size = self.templates[k]
            for run in own_runs:
                if len(run) >= CONFIRM * min(PART, size) and (share := _share([(i, o) for _, i, o in run], size)) >= CONFIRM:
                    found.append((len(run), share, -run[0][0], run[-1][0] + 2, family))
        out, taken = [], []
        for _, share, a, end, family in sorted(found, reverse=True):
            if any(-a < e and end > b for b, e in taken):
                continue
            p = self.probabilities(self.vector(h[-a:end]))
            if FAMILIES[int(p.argmax())] == family and p.max() >= self.least:
                taken.append((-a, end))
                out.append((-a, family, float(p.max()), share))
        return out


def stretches(df: DataFrame, text: str = "text", sample: int = SAMPLE, wide: int = 24) -> list[str]:
    """At most ``sample`` distinct stretches of up to ``wide`` words, those of least hash among all that the lines of all rows are cut into."""

    def run(batches):
        claim("licenses")
        held: dict[int, bytes] = {}
        for b in slices(batches):
            words = [x.encode("utf-8", "replace").split() for t in b.column(0).to_pylist() if t for x in t.split("\n")]
            size = np.fromiter(map(len, words), np.int64, len(words))
            size = size[size > 0]
            flat = [w for ws in words for w in ws]
            if not flat:
                continue
            a, e = windows_of(size, wide, wide)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(_hashes(flat)), dtype=U64)])
            name = mix(sums[e] - sums[a])
            bound = max(held) if len(held) >= sample else 1 << 64
            for k in np.argsort(name)[:sample].tolist():
                if (x := int(name[k])) < bound:
                    held[x] = b" ".join(flat[a[k] : e[k]])
            if len(held) > sample:
                held = dict(sorted(held.items())[:sample])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.uint64()).cast(pa.decimal128(20, 0)), pa.array([x.decode("utf-8", "replace") for x in held.values()], pa.string())], names=["h", "p"])

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "h decimal(20,0), p string")
    return [r.p for r in rows.groupBy("h").agg(F.min("p").alias("p")).orderBy("h").limit(sample).collect()]


def trained(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Scanner:
    """A scanner whose unknown class comes from at most ``sample`` stretches of the corpus."""
    return Scanner().train(stretches(df, text, sample))


def scan(df: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each paragraph that a licence was found in: doc_id, paragraph, family, probability, share."""

    def run(batches):
        claim("licenses")
        for b in slices(batches):
            rows = [(i, *m) for i, (_, found) in zip(b.column(0).to_pylist(), scanner.matches(b.column(1).to_pylist())) for m in found]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "paragraph", "family", "probability", "share"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, paragraph long, family string, probability double, share double")


def scan_documents(df: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, n_paragraphs, n_licensed (paragraphs with a licence), families (sorted, joined by commas)."""

    def run(batches):
        claim("licenses")
        for b in slices(batches):
            found = scanner.matches(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len({x[0] for x in m}) for _, m in found], pa.int64()), pa.array([",".join(sorted({x[1] for x in m})) for _, m in found], pa.string())], names=["doc_id", "n_paragraphs", "n_licensed", "families"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_paragraphs long, n_licensed long, families string")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_documents(docs, trained(docs))
