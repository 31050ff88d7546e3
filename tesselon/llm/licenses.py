"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs of ASCII letters and digits or of bytes above 127, lower-cased in A-Z; punctuation does
not count.  Shingles have three words.  Templates of up to ``2**c`` words are looked for in windows of
``2 * 2**c`` words that advance by ``2**c``, so every occurrence lies whole within some window, whose
shingles are then at least a fifth template (at the required containment).  Each of ``BANDS``
one-value MinHash bands meets with that probability at least, so a window with a match misses all of
them with probability below 1e-6.  A window without any shingle of any template has similarity 0
to all of them, can share no band, and is not sketched.

A retrieved template matches if at least ``PERCENT`` of its distinct shingles stand in the window;
each occurrence in a window is a match of its own, and what touching windows show of one occurrence is
one match, reported by its position in code points.  Of templates that differ in a few words only
(``FAMILIES``) a passage is reported as the one it holds most of.

Defined results.  Null, empty and short texts have no match.  Very long texts are scanned whole.  Repeated
rows each get a row, rows with a null id too.  An empty table gives an empty result.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import bounded_batches

SHINGLE = 3
BANDS = 64
PERCENT = 80

# Notices and texts of common public licences.
TEMPLATES = {
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights "
        "to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0"
    ),
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely"
    ),
}

#: Templates so alike that a passage close to one is close to the others: of those the closest is reported.
FAMILIES = {n: "gnu notice" for n in ("agpl-3.0-notice", "gpl-2.0-notice", "gpl-3.0-notice", "lgpl-2.1-notice", "lgpl-3.0-notice")}


def _clean(text: str | None) -> str:
    """Every byte that is not part of a word becomes a space, so offsets stay."""
    return (text or "").encode().translate(_WORD_BYTES).decode()


_WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 0x20 for b in range(256))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], bands: int = BANDS, percent: int = PERCENT):
        import numpy as np

        from tesselon.llm import shingles as S

        self.S, self.bands, self.percent = S, bands, percent
        self.names, self.sets, self.often, self.classes = [], [], [], {}
        for name, text in sorted(templates):
            w = S.word_hashes([_clean(text)])[0]
            if len(w) < SHINGLE:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            i = len(self.names)
            self.names.append(name)
            runs = S.window_hashes(w, SHINGLE)[: len(w) - SHINGLE + 1]
            self.sets.append(np.unique(runs))
            self.often.append(Counter(runs.tolist()))
            # Room for words put into an occurrence.
            need = max(4, len(w) * 100 // percent)
            self.classes.setdefault((need - 1).bit_length(), []).append(i)
        self.seeds = np.random.default_rng(3).integers(0, 2**63, bands, dtype=np.uint64)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.buckets: dict[tuple[int, int, int], list[int]] = {}
        for c, members in self.classes.items():
            for i in members:
                for b, v in enumerate(self.sketch(self.sets[i]).tolist()):
                    self.buckets.setdefault((c, b, v), []).append(i)

    def sketch(self, items):
        return self.S.mix64(items[None, :] ^ self.seeds[:, None]).min(1)

    def occurrences(self, i: int, at: list[int], items: list[int]) -> list[tuple[int, int, float]]:
        """Stretches (start, end, containment) that each hold enough of template ``i``; ``at`` are the positions of its shingles."""
        out, most, size = [], self.often[i], len(self.sets[i])
        k, left, held = 0, 0, Counter()
        while k < len(at):
            held[items[k]] += 1
            k += 1
            if 100 * len(held) < self.percent * size:
                continue
            # The rest of the occurrence: shingles that it lacks, or that follow without a gap.
            while k < len(at) and (held[items[k]] < most[items[k]] or at[k] == at[k - 1] + 1):
                held[items[k]] += 1
                k += 1
            while held[items[left]] > most[items[left]]:
                held[items[left]] -= 1
                left += 1
            out.append((at[left], at[k - 1] + SHINGLE, sum(n > 0 for n in held.values()) / size))
            left, held = k, Counter()
        return out

    @staticmethod
    def apart(spans: list[tuple[int, int, float]]) -> list[list]:
        """The fullest and shortest spans that do not overlap; another that overlaps only one of them widens it."""
        kept: list[list] = []
        rest = []
        for s, e, share in sorted(set(spans), key=lambda x: (-x[2], x[1] - x[0], x[0])):
            met = bisect_right(kept, s, key=lambda x: x[0])
            if (met and kept[met - 1][1] > s) or (met < len(kept) and kept[met][0] < e):
                rest.append((s, e))
            else:
                kept.insert(met, [s, e, share])
        wide = [list(x) for x in kept]
        for s, e in rest:
            j = max(bisect_right(kept, s, key=lambda x: x[0]) - 1, 0)
            met = [m for m in range(j, min(j + 3, len(kept))) if kept[m][0] < e and s < kept[m][1]]
            if len(met) == 1:
                wide[met[0]][:2] = min(wide[met[0]][0], s), max(wide[met[0]][1], e)
        return wide

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """Per text: (template, start, end, containment) in code points, by start."""
        import numpy as np

        S = self.S
        clean = [_clean(t) for t in texts]
        words, begin, end, first = S.word_hashes(clean)
        runs = S.window_hashes(words, SHINGLE)
        at = np.minimum(np.searchsorted(self.known, runs), max(len(self.known) - 1, 0))
        hit = self.known[at] == runs if len(self.known) and len(runs) else np.zeros(len(runs), bool)
        base = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in clean])])
        out = []
        for k in range(len(texts)):
            a, n = int(first[k]), int(first[k + 1]) - int(first[k])
            local = np.flatnonzero(hit[a : max(a, a + n - SHINGLE + 1)])
            found: dict[int, list[tuple[int, int, float]]] = {}
            for c, members in self.classes.items() if len(local) else ():
                step = 1 << c
                # Windows start at multiples of the step; a shingle lies in its step's window and in the one before.
                for w in sorted({int(x) for p in local.tolist() for x in (p // step, max(p // step - 1, 0))}):
                    lo, hi = w * step, min(n, (w + 2) * step)
                    if hi - lo < SHINGLE:
                        continue
                    window = runs[a + lo : a + hi - SHINGLE + 1]
                    items = np.unique(window)
                    wanted = {i for b, v in enumerate(self.sketch(items).tolist()) for i in self.buckets.get((c, b, v), ())}
                    for i in wanted:
                        inside = np.flatnonzero(np.isin(window, self.sets[i]))
                        for s, e, share in self.occurrences(i, inside.tolist(), window[inside].tolist()):
                            found.setdefault(i, []).append((lo + s, lo + e, share))
            rows = []
            for i, spans in found.items():
                rows += [(self.names[i], int(begin[a + s]) - int(base[k]), int(end[a + e - 1]) - int(base[k]), share) for s, e, share in self.apart(spans)]
            out.append(in_code_points(clean[k].encode(), self.closest(rows)))
        return out

    def closest(self, rows: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Of overlapping matches of one family the fullest; ties go to the template with more shingles, then by name."""
        size = dict(zip(self.names, map(len, self.sets), strict=True))
        taken: dict[str, list[tuple[int, int]]] = {}
        kept = []
        for r in sorted(rows, key=lambda r: (-r[3], -size[r[0]], r[0], r[1])):
            spans = taken.setdefault(FAMILIES.get(r[0], ""), [])
            if r[0] in FAMILIES:
                at = bisect_right(spans, (r[1], r[2]))
                if (at and spans[at - 1][1] > r[1]) or (at < len(spans) and spans[at][0] < r[2]):
                    continue
                spans.insert(at, (r[1], r[2]))
            kept.append(r)
        return kept


def in_code_points(raw: bytes, rows: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Byte offsets turned into code points, in one walk over the text; rows by start, then name."""
    point, at, n = {}, 0, 0
    for p in sorted({p for r in rows for p in r[1:3]}):
        n += len(raw[at:p].decode())
        point[p], at = n, p
    return sorted(((name, point[s], point[e], share) for name, s, e, share in rows), key=lambda r: (r[1], r[0]))


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and matches (license, start, end, containment) for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    listed = tuple(sorted((templates or TEMPLATES).items()))

    def run(batches):
        import pyarrow as pa

        from tesselon.llm.shingles import grouped

        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [r for i, j in grouped(texts) for r in scanner(listed).scan(texts[i:j])]
            rows = [[dict(zip(("license", "start", "end", "containment"), m, strict=True)) for m in r] for r in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, matches array<struct<license:string,start:int,end:int,containment:double>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
