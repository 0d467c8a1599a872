"""License scan: TF-IDF cosine of headers and license files to templates, and inheritance from the nearest ancestor directory.

Parts of a whole text are compared, as sparse TF-IDF vectors of their words, with templates of their kind: each line with
notice lines, each block of lines (a comment header, a paragraph; marks of comments are no words) with whole headers, each
run of comment lines, blank ones among them, with short license texts, and the whole document with whole license texts
(folder `licenses`). Years and names between a copyright mark and "All rights reserved" are left out; a line with an owner
counts only where nothing else is found. Words that no template has count in a vector's length;
counts of blocks and documents are damped. A document's own license is that of its best whole text at or above
`threshold`, else of its best such header, else of its best such line. A document with such a whole text, or of which
`file_share` of the words are in such headers and lines, is a license file: it licenses its directory. What has no license
of its own inherits from the nearest directory above it that has one.

Null or empty texts have no license of their own, but may inherit. A null path has no directories. In a directory with
several license files the most frequent license counts, then the first by name. Each row is scanned by itself; repeated
rows each give a row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, scratch_dir

#: Notices by SPDX identifier, a line each.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0", "License: Apache License 2.0", "Apache License, Version 2.0", "The Apache License 2.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "License: MIT", "MIT License", "The MIT License (MIT)"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only", "License: GPL-3.0", "License: GPLv3", "GNU General Public License v3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "License: GPL-2.0", "License: GPLv2", "GNU General Public License v2.0"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only", "License: LGPL-3.0", "GNU Lesser General Public License v3.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause", "License: BSD-3-Clause", "BSD 3-Clause License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "License: MPL-2.0", "Mozilla Public License 2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights", "CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "License: Unlicense", "The Unlicense"],
    "Proprietary": ["All rights reserved"],
}
#: Whole headers by SPDX identifier.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
HEADERS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "GPL-3.0": [_GNU.format(name="GNU General Public License", v=3)],
    "GPL-2.0": [_GNU.format(name="GNU General Public License", v=2)],
    "AGPL-3.0": [_GNU.format(name="GNU Affero General Public License", v=3)],
    "LGPL-3.0": [_GNU.format(name="GNU Lesser General Public License", v=3)],
    "LGPL-2.1": [_GNU.format(name="GNU Lesser General Public License", v="2.1")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MIT": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."],
}
WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
OWNER = re.compile(r"(?i)(?:copyright|\(c\)|\u00a9).{0,300}?(?=\ball rights reserved\b)")
#: How a line of a comment begins.
IN_COMMENT = re.compile(r"\s*(?://|/\*|\*|#|--|;|%|<!--)")
#: What opens or closes a comment on a line.
COMMENT = re.compile(r"^[\s/*#;!%<-]*|[\s*/>-]*$")


def words(line: str) -> list[str]:
    return WORD.findall(OWNER.sub(" ", line).lower())


@cache
def whole_texts() -> dict[str, list[str]]:
    """Whole license texts by SPDX identifier, one each."""
    return {f.name.removesuffix(".txt"): [f.read_text("utf-8")] for f in sorted((resources.files(__package__) / "licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def short_texts(most: int = 400) -> dict[str, list[str]]:
    """Whole texts that stand in headers, too."""
    return {name: texts for name, texts in whole_texts().items() if len(words(texts[0])) <= most}


class Matcher:
    """Unit TF-IDF vectors of the templates, by word. `damped` counts grow by their logarithm, so that common words don't outweigh the rest of a long text."""

    def __init__(self, idf: dict[str, float], unknown: float, templates: dict[str, list[str]] = TEMPLATES, damped: bool = False):
        held = {w for lines in templates.values() for t in lines for w in words(t)}
        self.idf, self.unknown, self.damped, self.lines, self.by_word = {w: x for w, x in idf.items() if w in held}, unknown, damped, [], {}
        for name, lines in templates.items():
            for text in lines:  # a template is of one kind, so its name says which license it is
                v = self.weights(Counter(words(text)))
                norm = math.sqrt(sum(x * x for x in v.values()))
                for w, x in v.items():
                    self.by_word.setdefault(w, []).append((len(self.lines), x / norm))
                self.lines.append(name)

    def weights(self, found: Counter) -> dict[str, float]:
        idf, unknown = self.idf, self.unknown
        return {w: (1 + math.log(c) if self.damped else c) * idf.get(w, unknown) for w, c in found.items()}

    def best(self, found: Counter, threshold: float = 0.0) -> tuple[str | None, float]:
        """Best template and its cosine; none where the known words alone can't reach the threshold."""
        known = [w for w in found if w in self.by_word]
        if not known:
            return None, 0.0
        v = self.weights(found)
        norm = math.sqrt(sum(x * x for x in v.values()))
        if math.sqrt(sum(v[w] ** 2 for w in known)) < threshold * norm * (1 - 1e-9):
            return None, 0.0
        score: dict[int, float] = {}
        for w in known:
            x = v[w] / norm
            for k, y in self.by_word[w]:
                score[k] = score.get(k, 0.0) + x * y
        k = min(score, key=lambda k: (-round(score[k], 12), self.lines[k], k))
        return self.lines[k], min(1.0, round(score[k], 12))


class Scanner:
    """The three comparisons, with the templates' document frequencies."""

    def __init__(self, idf: dict[str, float], unknown: float, threshold: float):
        self.lines, self.short = Matcher(idf, unknown), Matcher(idf, unknown, short_texts(), damped=True)
        self.headers, self.whole = Matcher(idf, unknown, HEADERS, damped=True), Matcher(idf, unknown, whole_texts(), damped=True)
        self.threshold = threshold

    def document(self, text: str | None) -> tuple[str | None, float, float]:
        """License, score, share of words in lines and headers that reach the threshold; all of them where the text is a whole license text."""
        at_least, best, top, owned, inside, all_words = self.threshold, (None, 0.0), (None, 0.0), (0.0, ""), 0, Counter()
        for block in blocks(text or ""):
            found, covered, here = Counter(), 0, 0
            for line in block:
                n = Counter(words(line))
                found.update(n)
                name, s = self.lines.best(n, at_least)
                here += n.total()
                if name and s >= at_least:
                    covered += n.total()
                    if OWNER.search(line):
                        owned = max(owned, (s, name))
                    elif s > best[1] or s == best[1] and name < best[0]:
                        best = (name, s)
            all_words.update(found)
            if len(block) > 1 or covered < here:
                name, s = self.headers.best(found, at_least)
                if name and s >= at_least:
                    covered = here
                    if s > top[1] or s == top[1] and name < top[0]:
                        top = (name, s)
            inside += covered
        for run in comments(text or ""):
            found = Counter(w for line in run for w in words(line))
            name, s = self.short.best(found, at_least)
            if name and s >= at_least:
                inside = max(inside, found.total())
                if s > top[1] or s == top[1] and name < top[0]:
                    top = (name, s)
        name, s = self.whole.best(all_words, at_least)
        if name and s >= at_least:
            return name, s, 1.0
        total = all_words.total()
        first = top if top[0] else best if best[0] or not owned[0] else owned[::-1]
        return *first, inside / total if total else 0.0


def blocks(text: str) -> list[list[str]]:
    """Runs of lines that hold more than marks of comments, whose first and last marks are cut off."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        bare = COMMENT.sub("", line)
        if bare:
            out[-1].append(bare)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def comments(text: str, least: int = 5) -> Iterator[list[str]]:
    """Runs of at least `least` comment lines, those without words among them."""
    run: list[str] = []
    closed = True
    for line in [*text.split("\n"), ""]:
        if IN_COMMENT.match(line) or not closed:
            run.append(line)
            closed = "*/" in line or "-->" in line or closed and "/*" not in line and "<!--" not in line
        elif run:
            if len(run) >= least:
                yield run
            run = []
    if len(run) >= least:
        yield run


def template_idf(docs: DataFrame) -> tuple[dict[str, float], float]:
    """Smoothed inverse document frequencies of the templates' words over all documents, and that of a word in none."""
    vocabulary = sorted({w for templates in (TEMPLATES, HEADERS, whole_texts()) for lines in templates.values() for t in lines for w in words(t)})
    held = frozenset(vocabulary)

    def count(batches):
        n, seen = 0, Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                n += 1
                seen.update(held.intersection(words(t or "")))
        yield pa.RecordBatch.from_pydict({"word": ["", *seen], "n": pa.array([n, *seen.values()], pa.int64())})

    got = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.get("", 0)
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {w: idf(got.get(w, 0)) for w in vocabulary}, idf(0)


def scan(docs: DataFrame, path: Column, threshold: float = 0.75, file_share: float = 0.5, most_sent: int = 100_000) -> DataFrame:
    """doc_id, path, own_license, score, inherited_from, license. At most `most_sent` directories with their licenses are broadcast."""
    scanner, spark, at = Scanner(*template_idf(docs), threshold), docs.sparkSession, scratch_dir(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [scanner.document(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("path"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.float64())], names=["doc_id", "path", "own_license", "score", "share"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text").mapInArrow(run, "doc_id long, path string, own_license string, score double, share double")
    found = save(found.withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", ""))), f"{at}-licenses")
    votes = found.where(F.col("own_license").isNotNull() & F.col("dir").isNotNull() & (F.col("share") >= file_share)).groupBy("dir", "own_license").count()
    given = votes.groupBy(F.col("dir").alias("from")).agg(F.min_by("own_license", F.struct(-F.col("count"), "own_license")).alias("given"))
    # Directories are few beside documents: each is resolved once, by its own ancestors.
    dirs = found.where(F.col("dir").isNotNull()).select("dir").distinct()
    above = dirs.withColumn("parts", F.split("dir", "/")).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("parts")))).withColumn("from", F.array_join(F.slice("parts", 1, F.col("depth")), "/"))
    nearest = save(above.join(given, "from").groupBy("dir").agg(F.max_by(F.struct("from", "given"), "depth").alias("near")), f"{at}-nearest")
    # A directory may hold a third of all rows: sent to every task, the table needs no shuffle of them. Beyond the bound, skewed joins are split at run time.
    out = found.join(F.broadcast(nearest) if nearest.count() <= most_sent else nearest, "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "score", F.when(inherits, F.col("near.from")).alias("inherited_from"), F.coalesce("own_license", "near.given").alias("license"))
