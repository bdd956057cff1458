"""License scans: MinHash bands over overlapping text windows, then exact shingle containment."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-3

# Wording of public license notices, headers and grants.
_FSF = (
    "{this} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_FSF_OLD = (
    "{this} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_SOFTWARE_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_CREATIVE_COMMONS = (
    "This work is licensed under the Creative Commons {name} {version} License. To view a copy of this license, "
    "visit https://creativecommons.org/licenses/{code}/{number}/"
)
_CC_NAMES = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"3.0": "3.0 Unported", "4.0": "4.0 International"}
_FSF_NAMES = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
TEMPLATES = {
    "0BSD grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSD-2-Clause conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause condition": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "BSL-1.0 notice": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "http://www.boost.org/LICENSE_1_0.txt)"
    ),
    "CC BY-NC 4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 dedication": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy "
        "of the CC0 Public Domain Dedication along with this software."
    ),
    "EPL-2.0 notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "EUPL-1.2 notice": (
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions "
        "of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."
    ),
    "GFDL-1.3 notice": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
        "Version 1.3 or any later version published by the Free Software Foundation"
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MIT disclaimer": _SOFTWARE_AS_IS,
    "MPL-1.1 header": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense dedication": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "WTFPL notice": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "Zlib grant": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "GPL-2.0 header": _FSF_OLD.format(this="This program", name=_FSF_NAMES["GPL"], version="2"),
    "LGPL-2.1 header": _FSF_OLD.format(this="This library", name=_FSF_NAMES["LGPL"], version="2.1"),
    **{f"{k}-3.0 header": _FSF.format(this="This program", name=name, version="3") for k, name in _FSF_NAMES.items()},
    **{
        f"CC {code.upper()} {number} statement": _CREATIVE_COMMONS.format(name=name, version=version, code=code, number=number)
        for code, name in _CC_NAMES.items() for number, version in _CC_VERSIONS.items()
    },
}
# Notices too short for shingles, matched word by word.
SHORT_NOTICES = {
    "All rights reserved": "All rights reserved", "CC0-1.0 name": "CC0 1.0", "ISC name": "ISC License", "Unlicense name": "The Unlicense",
    **{f"CC {code.upper()} {number} name": f"CC {code.upper()} {number}" for code in _CC_NAMES for number in _CC_VERSIONS},
}

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def license_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def bands_for(likeness: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` minima so that a window of this Jaccard likeness is retrieved but for ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - likeness**rows))


class Templates:
    """Templates grouped by shingle count, with their MinHash signatures.

    Templates of 2^(k-1)+1 to 2^k shingles share a class with blocks of ``block`` = 2^k shingles. A
    window is two blocks and starts at every block, so a whole copy lies inside one window. A copy that
    holds at least 0.8 of a template's shingles then has a Jaccard likeness to its window of at least
    ``0.8 m / (2 block + 0.2 m)``, which sets the number of bands. Bands hold one minimum each: wider
    bands would need hundreds of minima at that likeness.
    """

    def __init__(self, texts: dict[str, str], miss: float = MISS, seed: int = 3):
        self.names = [n for n in sorted(texts) if len(license_words(texts[n])) >= SHINGLE]
        self.sets = [_shingle_set(license_words(texts[n])) for n in self.names]
        self.classes = []
        blocks = {n: 1 << (len(s) - 1).bit_length() for n, s in zip(self.names, self.sets)}
        rng = np.random.default_rng(seed)
        for block in sorted(set(blocks.values())):
            members = [i for i, n in enumerate(self.names) if blocks[n] == block]
            least = min(len(self.sets[i]) for i in members)
            bands = bands_for(CONTAINED * least / (2 * block + (1 - CONTAINED) * least), 1, miss)
            odd = rng.integers(0, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            add = rng.integers(0, 2**63, bands, dtype=np.uint64)
            signs = []
            for i in members:
                own = _shingle_hashes(license_words(texts[self.names[i]]))
                signs.append([(own * a + c).min() for a, c in zip(odd, add)])
            self.classes.append((block, members, odd, add, np.array(signs, np.uint64)))
        self.siblings = self._siblings()

    def _siblings(self) -> list[set[int]]:
        """Templates that share half the shingles of the smaller one or more, found by shared shingles."""
        holders: dict[tuple, list[int]] = {}
        for i, own in enumerate(self.sets):
            for shingle in own:
                holders.setdefault(shingle, []).append(i)
        shared = Counter((i, j) for held in holders.values() for i in held for j in held if i != j)
        out: list[set[int]] = [set() for _ in self.sets]
        for (i, j), n in shared.items():
            if 2 * n >= min(len(self.sets[i]), len(self.sets[j])):
                out[i].add(j)
        return out

    def span(self, i: int) -> int:
        """Words in a window of this template."""
        return 2 * (1 << (len(self.sets[i]) - 1).bit_length()) + SHINGLE - 1


def _shingle_set(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(SHINGLE))))


def _word_hashes(names: np.ndarray) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass")) for n in names), np.uint64, len(names))


def _roll(hashes: np.ndarray) -> np.ndarray:
    """Hash of every run of five word hashes."""
    n = len(hashes) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        out = (out ^ hashes[k : k + len(out)]) * _MULT
        out ^= out >> np.uint64(32)
    return out


def _shingle_hashes(words: list[str]) -> np.ndarray:
    return _roll(_word_hashes(np.array(words, dtype=object)))


def scan_texts(texts: list, known: Templates) -> list[tuple[int, int, int, float]]:
    """Matches in whole texts: text number, template number, first word of the window, containment."""
    docs = [license_words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    if not len(sizes) or sizes.max() < SHINGLE:
        return []
    number, names = pd.factorize(np.array([w for d in docs for w in d], dtype=object))
    rolled = _roll(_word_hashes(names)[number])
    begins = np.cumsum(sizes) - sizes
    usable = np.maximum(sizes - SHINGLE + 1, 0)
    full = np.flatnonzero(usable)
    keep = np.repeat(begins[full], usable[full]) + _count_up(usable[full])
    hashes = rolled[keep]
    starts = np.cumsum(usable[full]) - usable[full]
    found: dict[tuple[int, int], tuple[float, int]] = {}
    for block, members, odd, add, signs in known.classes:
        blocks = -(-usable[full] // block)
        owner = np.repeat(np.arange(len(full)), blocks)
        step = _count_up(blocks)
        edges = starts[owner] + block * step
        follows = np.append(owner[1:] == owner[:-1], False)
        window, template = [], []
        for band, (a, c) in enumerate(zip(odd, add)):
            low = np.minimum.reduceat(hashes * a + c, edges)
            low[:-1] = np.where(follows[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
            order = np.argsort(signs[:, band], kind="stable")
            keys = signs[order, band]
            left = np.searchsorted(keys, low, "left")
            hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == low)
            for w, l, r in zip(hit, left[hit], np.searchsorted(keys, low[hit], "right")):
                for k in range(l, r):
                    window.append(w)
                    template.append(members[order[k]])
        for w, i in set(zip(window, template)):
            doc, first = int(full[owner[w]]), int(block * step[w])
            words = docs[doc][first : first + 2 * block + SHINGLE - 1]
            share = len(_shingle_set(words) & known.sets[i]) / len(known.sets[i])
            if share >= CONTAINED:
                best = found.get((doc, i), (0.0, 0))
                found[doc, i] = max(best, (share, -first))
    return [(doc, i, -first, share) for (doc, i), (share, first) in sorted(found.items())]


def best_of_siblings(rows: list[tuple[int, int, int, float]], known: Templates) -> list[bool]:
    """Whether no sibling in an overlapping window of the text has more of its shingles, or all of this one's and more."""
    by_text: dict[int, list] = {}
    for row in rows:
        by_text.setdefault(row[0], []).append(row)

    def beaten(row) -> bool:
        doc, i, first, share = row
        for _, j, other, theirs in by_text[doc]:
            if j in known.siblings[i] and first < other + known.span(j) and other < first + known.span(i):
                if theirs > share or (theirs == share and known.sets[i] < known.sets[j]):
                    return True
        return False

    return [not beaten(row) for row in rows]


def short_matches(texts: list, notices: dict[str, str]) -> list[tuple[int, str, int]]:
    """Notices found word by word: text number, notice, first word of its first place. Longer ones hide those inside them."""
    wanted = {tuple(license_words(notice)): name for name, notice in sorted(notices.items(), reverse=True)}
    wanted.pop((), None)
    heads: dict[str, list[tuple[str, ...]]] = {}
    for words in sorted(wanted, key=len, reverse=True):
        heads.setdefault(words[0], []).append(words)
    out = []
    for doc, text in enumerate(texts):
        words, seen, covered = license_words(text), {}, 0
        for at in [k for k, w in enumerate(words) if w in heads]:
            for run in heads[words[at]]:
                if tuple(words[at : at + len(run)]) == run and at + len(run) > covered:
                    seen.setdefault(wanted[run], at)
                    covered = at + len(run)
                    break
        out += [(doc, name, at) for name, at in sorted(seen.items())]
    return out


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size-1 for every size, one after the other."""
    total = sizes.sum()
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
) -> DataFrame:
    """One row ``id, license, first_word, containment, best`` per input row and license found in its text.

    Words are runs of letters and digits, lower-cased; shingles are five words; a license is found if
    one window holds at least 0.8 of its distinct shingles, checked exactly. ``first_word`` is where the
    best window starts (the first of equal ones). Licenses of like wording (siblings) may all be found in
    one place: ``best`` marks the one of which the text holds most, and the longer one where a whole
    template lies inside another. Templates of fewer than five words are left out; short ``notices`` are
    matched word by word instead, with containment 1. Null and empty texts match nothing; a repeated row
    or null id gives its matches like any other; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    known = Templates(templates or TEMPLATES)
    short = notices or {}

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = scan_texts(texts, known)
            found = [(doc, known.names[i], first, share, best) for (doc, i, first, share), best in zip(rows, best_of_siblings(rows, known))]
            if short:
                found += [(doc, name, at, 1.0, True) for doc, name, at in short_matches(texts, short)]
            if found:
                doc, which, first, share, best = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(which), pa.array(first, pa.int64()), pa.array(share, pa.float64()), pa.array(best)],
                    names=["id", "license", "first_word", "containment", "best"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, license string, first_word bigint, containment double, best boolean"
    )
