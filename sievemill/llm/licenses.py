"""Licence notices in whole texts by conditional compression.

Candidate blocks are the words around a licence word, on both sides enough to hold the longest template however
it is wrapped.  Each is compressed alone and with every template
as a raw zstandard dictionary; templates are ranked by how much smaller they make the block, and the
winner is confirmed by the exact differences in wording between block and template.

Result: one row for each confirmed notice, with doc_id, start and stop (code points, stop excluded), the
licence, the reduction (share of the notice's compressed size that the template saves), n_words of the
template and n_differences (words missing, added or changed between them).

Defined results: null and empty texts and texts without a notice have no row; a block with several
notices has a row for each; of templates with the same reduction the first by name wins; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

#: Wordings of licence notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Words of which a notice has one, also where a line ends between them.
CUES = re.compile(r"licen[sc]|permission\W+is|redistribut|free\W+software", re.IGNORECASE)
#: Share of a template's words that may differ.
MAY_DIFFER = 0.1
_WORD = re.compile(r"\w+(?:[.-]\w+)*")


class Scanner:
    """Templates with their dictionaries; one for each worker."""

    _own: Scanner | None = None

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [(name, [m.group().lower() for m in _WORD.finditer(text)]) for name, text in templates]
        self.reach = math.ceil((1 + MAY_DIFFER) * max(len(words) for _, words in self.templates))
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, text in templates]

    @classmethod
    def own(cls) -> Scanner:
        if cls._own is None:
            cls._own = cls(TEMPLATES)
        return cls._own

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Start and stop of the stretches within a template's length of a cue."""
        cues = [m.start() for m in CUES.finditer(text)]
        if not cues:
            return []
        words = [m.span() for m in _WORD.finditer(text)]
        begins = [a for a, _ in words]
        out: list[list[int]] = []
        for at in cues:
            i = bisect.bisect_right(begins, at) - 1
            lo, hi = max(0, i - self.reach), min(len(words) - 1, i + self.reach)
            if out and lo <= out[-1][1] + 1:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
        return [(words[lo][0], words[hi][1]) for lo, hi in out]

    def reduction(self, block: str, i: int) -> float:
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        return (alone - len(self.given[i].compress(data))) / alone

    def rank(self, block: str) -> list[tuple[float, int]]:
        """Reduction and number of the templates, best first."""
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        found = [((alone - len(c.compress(data))) / alone, i) for i, c in enumerate(self.given)]
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def differences(self, words: list[str], template: list[str]) -> tuple[int, int, int]:
        """Words that differ, and the words of the block from the first to the last one that agrees."""
        match = [m for m in difflib.SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
        best = (len(template), 0, 0)
        # words of the template that stand far off in the text around the notice don't belong to it
        for i, m in enumerate(match):
            agree = 0
            for n in match[i:]:
                agree += n.size
                stop = n.b + n.size
                best = min(best, (max(len(template), stop - m.b) - agree, m.b, stop), key=lambda x: x[0])
        return best

    def scan(self, text: str | None) -> list[tuple]:
        out = []
        todo = self.blocks(text or "")
        while todo:
            start, stop = todo.pop()
            block = text[start:stop]
            found = list(_WORD.finditer(block))
            words = [m.group().lower() for m in found]
            best = None
            held = Counter(words)
            for _, i in self.rank(block):
                name, template = self.templates[i]
                # no wording has more words in common than the two have without their order
                if len(template) - (Counter(template) & held).total() > MAY_DIFFER * len(template):
                    continue
                differ, a, b = self.differences(words, template)
                if differ <= MAY_DIFFER * len(template) and (best is None or (differ - len(template), differ) < best[0]):
                    best = ((differ - len(template), differ), start + found[a].start(), start + found[b - 1].end(), name, i, len(template), differ)
            if best:
                begin, end, name, i, n, differ = best[1:]
                out.append((begin, end, name, self.reduction(text[begin:end], i), n, differ))
                # what stands before and after may hold other notices
                todo += [(a, b) for lo, hi in ((start, best[1]), (best[2], stop)) if hi - lo > 0 for a, b in [(lo, hi)] if CUES.search(text, a, b)]
        return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner, out = Scanner.own(), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            out += [(doc, *row) for row in scanner.scan(text)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "stop", "license", "reduction", "n_words", "n_differences"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names)

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, start long, stop long, license string, reduction double, n_words long, n_differences long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
