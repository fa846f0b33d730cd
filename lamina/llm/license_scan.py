"""License scans by conditional compression.

Candidate blocks are the stretches of a text around cue words, across line ends, so notices may be
wrapped and stand in comments. Each is compressed once by itself and once per template, the template serving as zstandard raw dictionary; the more a template says what
the block says, the smaller the result. Every template is compared by the exact differences in wording
and confirmed where it also saves bytes; a confirmed notice is cut out and the rest is compared again.
The notice with the largest size reduction is named first, in alphabetical order where reductions tie.

Whole texts are searched, every cue counts, nothing leaves the row: no shuffle. Null and empty texts
have no blocks; a text without confirmed license has null there and no
licenses. Extra columns are ignored; repeated
rows are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

#: Wording of public license notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Lower-case words near which a license may stand.
CUES = ("licens", "licenc", "copyright", "permission is", "redistribut", "creative commons", "spdx", "warrant")
WORDS = re.compile(r"\w+(?:[.\-]\w+)*")


#: A line without words: notices rarely go on beyond it.
GAP = re.compile(r"\n[^\w\n]*(?=\n)")


@dataclass(frozen=True)
class Match:
    """A confirmed template: where its wording stands, size reduction, and the words that only one side has."""

    name: str
    start: int
    end: int
    block: str
    reduction: float
    same: int
    missing: tuple[str, ...]
    extra: tuple[str, ...]

    def order(self) -> tuple:
        """The match that explains most words comes first."""
        return len(self.missing) + len(self.extra) - self.same, self.name, self.start, self.end


def cues(text: str) -> list[tuple[int, int]]:
    """Places (start, end) of all cue words."""
    low = text.lower()
    if len(low) != len(text):  # some capitals grow in lower case: places would shift
        low = text.translate({c: c + 32 for c in range(65, 91)})
    found = []
    for cue in CUES:
        at = low.find(cue)
        while at >= 0:
            found.append((at, at + len(cue)))
            at = low.find(cue, at + len(cue))
    return sorted(found)


def reach_of(templates: dict[str, str]) -> int:
    """Characters other than white space that a notice can go to each side of its cue: a confirmed one has at
    most as many further words as the longest template has words."""
    return 2 * max((len("".join(t.split())) for t in templates.values()), default=0) + 80


def reaches(text: str, places: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """For each place the stretch with `reach` characters to both sides, white space not counted."""
    solid = [m.start() for m in re.finditer(r"\S", text)] if places else []
    return [(solid[max(0, bisect_left(solid, s) - reach)], solid[min(len(solid), bisect_left(solid, e) + reach) - 1] + 1) for s, e in places]


def line(text: str, start: int, end: int, reach: int) -> tuple[int, int]:
    """The stretch as far as its first and last line go, cut `reach` characters from it."""
    stop = text.find("\n", end)
    return max(text.rfind("\n", 0, start) + 1, start - reach), min(len(text) if stop < 0 else stop, end + reach)


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Stretches (start, end) around cues, overlaps joined."""
    out: list[tuple[int, int]] = []
    for s, e in reaches(text, cues(text), reach):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 9, confirmed: float = 0.9):
        import zstandard as z

        self.templates = {k: WORDS.findall(v.lower()) for k, v in templates.items()}
        self.plain = z.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        self.given = {k: z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(v.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for k, v in sorted(templates.items())}
        self.confirmed = confirmed
        self.reach = reach_of(templates)

    def reduction(self, block: str, name: str) -> float:
        """Bytes saved with a template as a share of the block's own compressed size, both in lower case."""
        raw = block.lower().encode("utf-8", "replace")
        return 1 - len(self.given[name].compress(raw)) / len(self.plain.compress(raw))

    def aligned(self, theirs: list[str], words: list[str]) -> list | None:
        """Runs of equal words, without outer ones that cost more differences than they save."""
        runs = SequenceMatcher(None, theirs, words, autojunk=False).get_matching_blocks()[:-1]
        best = None
        for i in range(len(runs)):
            n = 0
            for j in range(i, len(runs)):
                n += runs[j].size
                cost = len(theirs) + runs[j].b + runs[j].size - runs[i].b - 2 * n, -n
                if n >= self.confirmed * len(theirs) and (best is None or cost < best[0]):
                    best = cost, runs[i : j + 1]
        return best and best[1]

    def matches(self, text: str, start: int, end: int) -> list[Match]:
        """All templates whose wording is in the stretch, up to 1 - confirmed of their words, and that save bytes of its lines.

        A match over several lines has no more extra words than the template has words, so words that
        merely stand near each other confirm nothing.
        """
        found = [(m.group().lower(), start + m.start(), start + m.end()) for m in WORDS.finditer(text[start:end])]
        words, good = [w for w, _, _ in found], []
        there = Counter(words)
        for name, theirs in self.templates.items():
            # counts of words bound what can be equal in order
            able = sum((Counter(theirs) & there).values()) >= self.confirmed * len(theirs)
            same = self.aligned(theirs, words) if able else None
            if not same:
                continue
            a, b = {i for m in same for i in range(m.a, m.a + m.size)}, {i for m in same for i in range(m.b, m.b + m.size)}
            first, last = min(b), max(b)
            missing = tuple(w for i, w in enumerate(theirs) if i not in a)
            extra = tuple(w for i, w in enumerate(words) if first <= i <= last and i not in b)
            s, e = found[first][1], found[last][2]
            if len(extra) > len(theirs) and "\n" in text[s:e]:
                continue
            block = text[slice(*line(text, s, e, self.reach))]
            reduction = self.reduction(block, name)
            if reduction > 0:
                good.append(Match(name, s, e, block, reduction, len(b), missing, extra))
        return good

    def notices(self, text: str) -> list[Match]:
        """Confirmed matches that don't overlap: those that explain most words, in order of place.

        Each cue is looked at in its line, in its paragraph, and as far as it reaches. What was confirmed
        is cut out and cues outside of it are looked at again in what is left, until nothing is found.
        """
        places = cues(text)
        around = list(zip(places, reaches(text, places, self.reach)))
        taken: list[tuple[int, int]] = []
        seen: dict[tuple[int, int], list[Match]] = {}
        out: list[Match] = []

        def fits(m: Match) -> bool:
            at = bisect_left(taken, (m.start, m.end))
            return (at == 0 or taken[at - 1][1] <= m.start) and (at == len(taken) or m.end <= taken[at][0])

        while around:
            stretches, rest = set(), []
            for (s, e), (low, high) in around:
                at = bisect_left(taken, (e,))
                if at and taken[at - 1][1] > s:
                    continue
                low, high = max([low, *[t[1] for t in taken[at - 1 : at]]]), min([high, *[t[0] for t in taken[at : at + 1]]])
                rest.append(((s, e), (low, high)))
                first, last = line(text, s, e, self.reach)
                gaps = [m.end() for m in GAP.finditer(text, low, s)][-1:]
                after = GAP.search(text, e, high)
                stretches |= {(max(first, low), min(last, high)), (low, high), (max([low, *gaps]), after.start() if after else high)}
            around = rest
            for stretch in stretches - seen.keys():
                seen[stretch] = self.matches(text, *stretch)
            n = len(out)
            for m in sorted({m for stretch in stretches for m in seen[stretch]}, key=Match.order):
                if fits(m):
                    insort(taken, (m.start, m.end))
                    out.append(m)
            if len(out) == n:
                break
        return sorted(out, key=lambda m: m.start)


SCHEMA = "doc_id long, n_blocks long, n_matches long, license string, reduction double, n_missing long, n_extra long, block string, licenses array<string>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per document row: blocks, confirmed notices, and the notice that saves most, with its lines as block; and the names of all."""

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                places = blocks(text, scanner.reach) if text else []
                found = scanner.notices(text) if places else []
                top = min(found, key=lambda m: (-m.reduction, m.name, m.block), default=None)
                rows.append((len(places), len(found), *((top.name, round(top.reduction, 6), len(top.missing), len(top.extra), top.block) if top else (None,) * 5), sorted({m.name for m in found})))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, SCHEMA)
