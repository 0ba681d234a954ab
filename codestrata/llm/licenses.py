"""License scans: sparse TF-IDF cosine of runs of lines to licence templates, then inheritance from the nearest ancestor directory.

Candidates are all runs of lines of up to RUN_TERMS terms (and a last line), single lines of any length among them, and licence files as a
whole. Templates are short statements, titles, file headers, SPDX names, and whole texts of short licences. A candidate and a template are sparse vectors of terms; a term weighs its count times ln(1 + documents / (1 + document frequency)),
with frequencies of all terms counted over all files; words outside the templates count in a candidate's norm, so a long line with a few
licence words scores low. A file's own licence is that of its best candidate with cosine of ``threshold`` or more: a licence file as a whole
comes before its runs, and what names no exact licence (a reservation of all rights, the sentence that all BSD licences share) comes last.

The scan knows the templates' frequencies and takes every other word at the least weight any word can have; only candidates that reach the
threshold so, and that no other one of the text beats in any case, have their other words looked up, by a join on the term (``beats``: within its rank). Only runs with
a *telling* term are scored: common terms are left out of the search exactly as far as no run made of them alone could reach the threshold
with any template. So nothing is lost.

A licence file (LICENSE, LICENCE, COPYING, NOTICE, with any suffix) speaks for its directory; of several, the best score counts, then the
least path. A file without a licence of its own inherits from the nearest directory above it, its own included, that has one. Ancestors
are joined per distinct directory, so a directory with a third of all files is one row there.

Edge cases: null and empty texts have no own licence but inherit; a null path neither inherits nor speaks; ties go to the longer template, then to
the licence that sorts last, between runs to the first line, then the shortest run; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small, written

#: (licence, statement): fixed values, the usual short statements, titles and file headers of public licences. ``bsd`` is what all BSD licences share.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("proprietary", "All rights reserved"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("epl-2.0", "Eclipse Public License - v 2.0"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
]
#: The header of the GNU licences, with what they call themselves and their version.
GNU_HEADER = "you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"
GNU = [("gpl-2.0", "General Public License", "2"), ("gpl-3.0", "General Public License", "3"), ("lgpl-2.1", "Lesser General Public License", "2.1"), ("lgpl-3.0", "Lesser General Public License", "3"), ("agpl-3.0", "Affero General Public License", "3")]
TEMPLATES += [(licence, GNU_HEADER.format(name=name, version=version)) for licence, name, version in GNU]
#: Licences by their SPDX names; those of GNU also with a suffix.
SPDX = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "EPL-2.0", "ISC", "MIT", "MPL-2.0", "Unlicense", "Zlib", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
TEMPLATES += [({"Unlicense": "public-domain"}.get(x, x.lower()), f"SPDX-License-Identifier: {x}{end}") for x in SPDX for end in (("", "-only", "-or-later") if "GPL" in x else ("",))]

_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
#: (licence, text): fixed values, whole texts of the short public licences.
TEXTS = [
    ("bsd-2-clause", " ".join(_BSD[:3] + _BSD[4:])),
    ("bsd-3-clause", " ".join(_BSD)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
]
#: What a run of lines with such a licence ranks: these count where nothing more exact is found. Other runs rank 1, a licence file as a whole 0.
VAGUE = {"bsd": 2, "proprietary": 3}
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"

_TERM = re.compile(r"spdx-license-identifier|[a-z0-9]+(?:\.[0-9]+)*")


def terms_of(line: str) -> list[str]:
    return _TERM.findall(line.lower())


VOCABULARY = frozenset(t for _, s in TEMPLATES + TEXTS for t in terms_of(s))


#: A run of lines ends with the line that brings it to so many terms: twice the longest statement's, as a statement may hold other words too.
RUN_TERMS = 2 * max(len(terms_of(s)) for _, s in TEMPLATES)
#: A task sends its counts on when it holds so many terms.
HELD_TERMS = 200_000


def term_frequencies(texts: DataFrame) -> DataFrame:
    """(term, n): texts with each term over all rows of the one column __text, and all texts under ''. Each task counts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for x in batch.column(0):
                found[""] += 1
                found.update(set(terms_of(x.as_py() or "")))
                if len(found) > HELD_TERMS:
                    yield out()
                    found.clear()
        yield out()

    return texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Candidate(NamedTuple):
    """A run of lines, or a file (rank 0): the first line, the best licence with its dot product and its template's terms, the squared norm of template terms, and other terms."""

    rank: int
    license: str
    size: int
    line: int
    dot: float
    known: float
    others: tuple[tuple[str, int], ...]


class Scorer:
    """Weights, template vectors and the search pattern for given frequencies. ``frequency`` may lack terms outside the templates."""

    def __init__(self, total: int, frequency: dict[str, int], threshold: float):
        self.threshold, self.total, self.frequency = threshold, total, frequency
        self.weight = {t: max(1e-9, self.weigh(frequency.get(t, 0))) for t in VOCABULARY}
        self.templates = []
        for licence, s in sorted(TEMPLATES + TEXTS):
            v = {t: n * self.weight[t] for t, n in Counter(terms_of(s)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.templates.append((licence, len(terms_of(s)), {t: x / norm for t, x in v.items()}))
        common: set[str] = set()
        for t in sorted(VOCABULARY, key=lambda t: (self.weight[t], t)):
            if any(sum(x * x for u, x in v.items() if u in common or u == t) >= threshold * threshold * 0.999 for *_, v in self.templates):
                break
            common.add(t)
        by_first: dict[str, list[str]] = {}
        for t in sorted(VOCABULARY - common, key=lambda t: (-len(t), t)):
            by_first.setdefault(t[0], []).append(re.escape(t[1:]))
        self.pattern = re.compile(r"(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in by_first.items()) + r")(?![a-z0-9])")

    def weigh(self, frequency: int) -> float:
        return math.log(1 + self.total / (1 + frequency))

    def candidate(self, counts: Counter, line: int, whole: bool = False) -> Candidate | None:
        """None if the threshold is out of reach even with other terms that are in all texts."""
        least, most = self.weigh(self.total) ** 2, self.threshold * self.threshold * (1 - 1e-9)
        known = sum((n * self.weight[t]) ** 2 for t, n in counts.items() if t in VOCABULARY)
        others = least * sum(n * n for t, n in counts.items() if t not in VOCABULARY)
        if not known or known < most * (known + others):
            return None
        dot, size, licence = max(((round(sum(w * counts[t] * self.weight[t] for t, w in u.items() if t in counts), 12), size, licence) for licence, size, u in self.templates), key=lambda x: x[:2])
        if dot * dot < most * (known + others):
            return None
        return Candidate(0 if whole else VAGUE.get(licence, 1), licence, size, line, dot, known, tuple(sorted((t, n) for t, n in counts.items() if t not in VOCABULARY)))

    def score(self, c: Candidate) -> float:
        return c.dot / math.sqrt(c.known + sum((n * self.weigh(self.frequency.get(t, 0))) ** 2 for t, n in c.others))

    def line(self, line: str) -> tuple[float, str] | None:
        c = self.candidate(Counter(terms_of(line)), 1)
        return (self.score(c), c.license) if c and self.score(c) >= self.threshold else None

    def candidates(self, text: str, whole: bool = False) -> list[Candidate]:
        """Candidates among the runs of lines, and the text as a whole if asked, without those that another one beats in any case."""
        low = text.lower()
        if not self.pattern.search(low):
            return []
        found: dict[tuple, Candidate] = {}
        lines = [(i, terms_of(x), bool(self.pattern.search(x))) for i, x in enumerate(low.split("\n"), 1)]
        lines = [x for x in lines if x[1]]

        def add(c: Candidate | None) -> None:
            if c:
                found.setdefault((c.rank, c.license, c.dot, c.known, c.others), c)

        for at, (first, *_) in enumerate(lines):
            size, told = 0, False
            for _, terms, tells in lines[at:]:
                if size >= RUN_TERMS:
                    break
                size, told = size + len(terms), told or tells
            if not told:
                continue
            counts: Counter = Counter()
            size, told = 0, False
            for _, terms, tells in lines[at:]:
                if size >= RUN_TERMS:
                    break
                counts.update(terms)
                size, told = size + len(terms), told or tells
                if told:
                    add(self.candidate(counts, first))
        if whole:
            add(self.candidate(Counter(t for _, terms, _ in lines for t in terms), lines[0][0], True))
        least, most = self.weigh(self.total) ** 2, self.weigh(0) ** 2
        at_best = {k: c.dot * c.dot / (c.known + least * sum(n * n for _, n in c.others)) for k, c in found.items()}
        at_worst: dict[int, float] = {}
        for c in found.values():
            at_worst[c.rank] = max(at_worst.get(c.rank, 0.0), c.dot * c.dot / (c.known + most * sum(n * n for _, n in c.others)))
        return [c for k, c in found.items() if at_best[k] >= at_worst[c.rank] * (1 - 1e-9)]

    def text(self, text: str, whole: bool = False) -> tuple[str | None, float, int]:
        """(licence, score, number of the first line) of the best candidate."""
        scored = [(round(self.score(c), 12), c) for c in self.candidates(text, whole)]
        score, best = max(((s, c) for s, c in scored if s >= self.threshold), key=lambda x: (-x[1].rank, x[0], x[1].size), default=(0.0, None))
        return (best.license, min(1.0, score), best.line) if best else (None, 0.0, 0)


def _scan(total: int, frequency: dict[str, int], threshold: float):
    others = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("license", pa.string()), ("size", pa.int32()), ("line", pa.int32()), ("dot", pa.float64()), ("known", pa.float64()), ("others", others)]))

    @F.arrow_udf("array<struct<rank: int, license: string, size: int, line: int, dot: double, known: double, others: array<struct<term: string, n: int>>>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = Scorer(total, frequency, threshold)
        for texts, wholes in batches:
            rows = [scorer.candidates(x.as_py() or "", w) for x, w in zip(texts, wholes.to_pylist(), strict=True)]
            yield pa.array([[c._asdict() | {"others": [{"term": t, "n": n} for t, n in c.others]} for c in r] for r in rows], kind)

    return run


def best_candidates(rows: DataFrame, frequencies: DataFrame, total: int, threshold: float) -> DataFrame:
    """(row, candidates) to (row, license, score, line) of rows with a candidate that reaches the threshold; other terms are looked up."""
    c = rows.where(F.size("candidates") > 0).select("row", F.posexplode("candidates").alias("at", "c")).select("row", "at", "c.*")
    terms = c.select("row", "at", F.inline("others"))
    weights = written(frequencies.join(terms.select("term").distinct(), "term", "left_semi"), "weights")
    square = F.pow(F.col("n") * F.log(1 + F.lit(float(total)) / (1 + F.col("df"))), 2)
    norms = terms.join(small(weights.withColumnRenamed("n", "df"), 48), "term").groupBy("row", "at").agg(F.sum(square).alias("rest"))
    score = F.round(F.col("dot") / F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0))), 12)
    scored = c.drop("others").join(norms, ["row", "at"], "left").withColumn("score", score).where(F.col("score") >= threshold)
    return scored.groupBy("row").agg(F.min_by(F.struct("license", F.least("score", F.lit(1.0)).alias("score"), "line"), F.struct("rank", -F.col("score"), -F.col("size"), "at")).alias("b")).select("row", "b.*")


def scan_licenses(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = 0.75) -> DataFrame:
    """For each row of ``files``: key, path, own_license, own_score, own_line, inherited_from (a directory) and license."""
    bound_batches(files.sparkSession)
    frequencies = written(term_frequencies(files.select(F.col(text).alias("__text"))), "terms")
    known = {r.term: r.n for r in frequencies.where(F.col("term").isin("", *sorted(VOCABULARY))).collect()}  # the vocabulary's size
    total = known.pop("", 0)
    name = F.element_at(F.split("path", "/"), -1)
    dir_of = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    speaks = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("__text")).select("*", F.when(F.col("path").isNotNull(), dir_of).alias("dir"), speaks.alias("speaks"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "key", "path", "dir", "speaks", _scan(total, known, threshold)(F.col("__text"), F.col("speaks")).alias("candidates")), "candidates")
    best = written(best_candidates(rows, frequencies, total, threshold), "found")
    own = written(rows.drop("candidates").join(small(best, 60), "row", "left").select("key", "path", "dir", "speaks", "license", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("line", F.lit(0)).alias("line")), "licenses")
    spoken = own.where("speaks AND license IS NOT NULL").groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), "path")).alias("found"))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = own.select("dir").where("dir IS NOT NULL").distinct().select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select(F.col("dir").alias("at"), "depth", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/").alias("dir"))
    near = written(above.join(spoken, "dir").groupBy("at").agg(F.max_by(F.struct("dir", "found"), "depth").alias("near")).select(F.col("at").alias("dir"), "near.found", F.col("near.dir").alias("from")), "directories")
    out = own.join(small(near, 120), "dir", "left")
    return out.select(F.col("key").alias(key), "path", F.col("license").alias("own_license"), F.round("score", 6).alias("own_score"), F.col("line").alias("own_line"), F.when(F.col("license").isNull(), F.col("from")).alias("inherited_from"), F.coalesce("license", "found").alias("license"))
