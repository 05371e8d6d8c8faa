"""License notices by conditional compression.

Sentences that hint at a license are candidate blocks. A block is compressed alone and with each
template as a raw zstandard dictionary; templates are ranked by how much they shrink it. The ranked
templates are then compared word by word: the first whose wording stands in the block, but for a
few differing words and none that tells licenses apart, is the license of the block.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.words import slices

#: License id and one usual wording of its notice.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("proprietary", "All rights reserved."),
]
HINT = re.compile(r"licen[sc]|copyright|all rights reserved|public domain|creative commons|redistribut|permission is hereby|spdx", re.I | re.A)
HINT_BYTES = re.compile(rb"licen[sc]|copyright|all rights reserved|public domain|creative commons|redistribut|permission is hereby|spdx")
#: A line end, or a full stop before white space that does not abbreviate "version".
BORDER = re.compile(r"(?<! v)[.!?](?=\s)\s*|\n+")
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Words of a notice that may be missing or changed without naming another license.
LOOSE = frozenset("this work is the a an of to in and or with under by for file except you may not use at your option any later "
                  "licensed released distributed available published provided terms version v license licence source code form subject".split())
LONGEST = 2000


def blocks(text: str) -> list[tuple[int, int]]:
    """Sentences with a hint, as (start, end). They end at line ends, and ``LONGEST`` characters from the hint at most."""
    out: list[tuple[int, int]] = []
    for m in HINT.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        start = max(0, m.start() - LONGEST, out[-1][1] if out else 0)
        for stop in BORDER.finditer(text, start, m.start()):
            start = stop.end()
        start += len(text[start:m.start()]) - len(text[start:m.start()].lstrip())
        stop = BORDER.search(text, m.end(), m.end() + LONGEST)
        end = min(len(text), m.end() + LONGEST)
        if stop:
            end = stop.start() + (text[stop.start()] in ".!?")
        out.append((start, len(text[:end].rstrip()) if end == len(text) else end))
    return out


class LicenseMatcher:
    def __init__(self, templates=tuple(TEMPLATES)):
        self.templates = list(templates)
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.keyed = [zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(
            t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in self.templates]
        self.words = [[w.lower() for w in WORD.findall(t)] for _, t in self.templates]
        self.marks = [set(w) - LOOSE for w in self.words]
        self.telling = set().union(*self.marks)

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share of the block's size saved, template), most first; ties keep the order of the templates."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        saved = [(1 - len(c.compress(raw)) / alone, i) for i, c in enumerate(self.keyed)]
        return sorted(saved, key=lambda s: (-s[0], s[1]))

    def differences(self, block: str, i: int) -> tuple[list[str], bool]:
        """(template words missing from the block, whether the wording is confirmed)."""
        found, words = [w.lower() for w in WORD.findall(block)], self.words[i]
        kept, places = set(), set()
        for a, b, n in SequenceMatcher(None, words, found, autojunk=False).get_matching_blocks():
            kept.update(range(a, a + n))
            places.update(range(b, b + n))
        missing = [w for j, w in enumerate(words) if j not in kept]
        between = {w for j, w in enumerate(found) if j not in places and min(places, default=0) < j < max(places, default=0)}
        strict = not self.marks[i].intersection(missing) and not (self.telling - set(words)) & between
        return missing, strict and len(missing) <= 0.5 * len(words)

    def match(self, block: str) -> tuple[str | None, float, list[str]]:
        """(license or None, share saved, missing words) of the best confirmed template."""
        for saved, i in self.ranked(block):
            if saved <= 0:
                break
            missing, confirmed = self.differences(block, i)
            if confirmed:
                return self.templates[i][0], saved, missing
        return None, 0.0, []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = tuple(TEMPLATES)) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_blocks, n_unknown, licenses, spans).

    ``licenses`` are the distinct ids found, sorted and comma-joined; ``spans`` lists id:start:end (code points, end
    exclusive) by start, with ``unknown`` for blocks that no template confirms. Null and empty texts have none; the same
    text gives the same result, so repeated rows agree.
    """
    def task(batches):
        matcher = LicenseMatcher(templates)
        for part in slices(batches, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                found = []
                if text and HINT_BYTES.search(text.encode().lower()):
                    found = [(a, b, matcher.match(text[a:b])[0] or "unknown") for a, b in blocks(text)]
                names = sorted({n for _, _, n in found} - {"unknown"})
                rows.append((len(found), sum(n == "unknown" for _, _, n in found), ",".join(names), ",".join(f"{n}:{a}:{b}" for a, b, n in found)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_blocks", "n_unknown", "licenses", "spans"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        task, "doc_id long, n_blocks long, n_unknown long, licenses string, spans string")
