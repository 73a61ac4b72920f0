"""Licence scan: TF-IDF cosine to licence templates, then inheritance down the directories.

Each line, each paragraph and the whole of a file are compared with every template as sparse TF-IDF vectors; the
one of the most evidence counts, so a whole licence outweighs a paragraph that it shares with another.
Document frequencies are counted over all files, for the templates' terms (a few hundred, whatever the corpus);
a term of no template weighs as one that a single file has. Scanning is a map over the files.

A file without a licence of its own takes that of the nearest directory above that has a licence file. Only
directories, not files, are joined with their ancestors, so a root that covers everything stays cheap.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import table, written

WORD = re.compile(r"\w+")

# Public licence texts, as they stand in licence files and in the headers of sources.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_TWO_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_THIRD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_NOTICE = (
    "This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version."
)
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_FEE_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_FEE_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"


def _gnu(name: str, short: str, version: str, date: str, what: str, *more: str) -> list[str]:
    return [
        f"This work is licensed under the GNU {name}, version {version}", f"Licensed under the GNU {name} v{version}", f"GNU {name} v{version} or later ({short}v{version}+)",
        f"Licensed under the {short} version {version}", f"GNU {name} Version {version}, {date}",
        f"released under the terms of the GNU {name} version {version}, see the file COPYING",
        _NOTICE.format(what=what, stop=":", name=name, version=version), *more,
    ]


def _cc(short: str, long: str, version: str = "4.0", where: str = "International") -> list[str]:
    return [
        f"Licensed under {short} {version}", f"This work is licensed under a Creative Commons {long} {version} {where} License",
        f"Creative Commons {long} {version} {where} ({short} {version})", f"Creative Commons {long} {version} {where} Public License",
    ]


_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute "
        "the Work and such Derivative Works in Source or Object form.",
    ],
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)", "This project is licensed under the MIT License, see the LICENSE file for details",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        _GRANT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS,
        f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    ],
    "GPL-3.0": _gnu(_GPL, "GPL", "3", "29 June 2007", "program", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    "GPL-2.0": _gnu(
        _GPL, "GPL", "2", "June 1991", "program",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to "
        "guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "LGPL-3.0": _gnu(
        _LGPL, "LGPL", "3", "29 June 2007", "library",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, "
        "supplemented by the additional permissions listed below.",
    ),
    "LGPL-2.1": _gnu(
        _LGPL, "LGPL", "2.1", "February 1999", "library",
        "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.",
    ),
    "AGPL-3.0": _gnu(
        _AGPL, "AGPL", "3", "19 November 2007", "program",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation "
        "with the community in the case of network server software.",
    ),
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", _REDISTRIBUTION, f"{_REDISTRIBUTION} {_TWO_CLAUSES} {_BSD_AS_IS}",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", _REDISTRIBUTION, _THIRD_CLAUSE,
        f"{_REDISTRIBUTION} {_TWO_CLAUSES} {_THIRD_CLAUSE} {_BSD_AS_IS}",
    ],
    "ISC": ["Licensed under the ISC License", "ISC License", f"{_FEE}{_FEE_NOTICE}.", _FEE_AS_IS, f"{_FEE}{_FEE_NOTICE}. {_FEE_AS_IS}"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License 2.0", "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM "
        "CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "Zlib": [
        "Licensed under the zlib License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "Unlicense": [
        "Released under the Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal", "Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EUPL-1.2": [
        "Licensed under the EUPL", "Licensed under the EUPL, Version 1.2 or later", "Licensed under the European Union Public Licence, Version 1.2", "EUROPEAN UNION PUBLIC LICENCE v. 1.2",
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); "
        "You may not use this work except in compliance with the Licence.",
    ],
    "0BSD": [
        "BSD Zero Clause License", "Licensed under the Zero-Clause BSD License", f"{_FEE}.", f"{_FEE}. {_FEE_AS_IS}",
    ],
    "MIT-0": [
        "MIT No Attribution", "Licensed under the MIT No Attribution License", f"{_GRANT.removesuffix(', subject to the following conditions:')}.",
        f"{_GRANT.removesuffix(', subject to the following conditions:')}. {_AS_IS}",
    ],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1", "The Apache Software License, Version 1.1"],
    "MPL-1.1": [
        "Mozilla Public License Version 1.1", "Licensed under the Mozilla Public License 1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "EPL-1.0": [
        "Licensed under the Eclipse Public License 1.0", "Eclipse Public License - v 1.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ],
} | {f"CC-{k}-4.0": _cc(f"CC {k}", x) for k, x in _CC.items()} | {f"CC-{k}-3.0": _cc(f"CC {k}", x, "3.0", "Unported") for k, x in _CC.items()}
for _name, _texts in TEMPLATES.items():
    _forms = [f"{_name}-only", f"{_name}-or-later"] if "GPL" in _name else [_name]
    _texts += [f"SPDX-License-Identifier: {x}" for x in _forms]
#: A line that says what a text is not under.
DENIED = re.compile(r"\b(?:not|never|nor|n't)\s+(?:\w+\s+){0,2}(?:licensed|released|distributed|available|covered)\s+(?:\w+\s+)?under\b", re.IGNORECASE)
#: Such a line is one about a licence at this cosine already.
DENIED_LEAST = 0.5
#: Two licences of which the weaker has this share of the other's evidence can't be told apart.
ALIKE = 0.98
#: A directory is wide if it stands above 1 of so many pairs of a directory and one above it; there are fewer than that.
WIDE = 4_096
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"


#: A version number; a year is none.
VERSION = re.compile(r"(?<![\d.])(?!(?:19|20)\d\d(?![\d.]))\d+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def versions(text: str) -> frozenset[str]:
    """The version numbers in a text; 2.0 is 2."""
    return frozenset(x.removesuffix(".0") for x in VERSION.findall(text))


VOCABULARY = {w: k for k, w in enumerate(sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t)}))}


def frequencies(files: DataFrame) -> tuple[int, np.ndarray]:
    """Number of files, and of the files that hold each template term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(VOCABULARY), np.int64)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                df[[VOCABULARY[w] for w in {*words(text.as_py() or "")} if w in VOCABULARY]] += 1
        rows = np.append(np.flatnonzero(df), len(VOCABULARY))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(np.append(df, n)[rows])], names=["term", "n"])

    sums = files.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(VOCABULARY) + 1, np.int64)
    for r in sums:
        df[r["term"]] = r["n"]
    return int(df[-1]), df[:-1]


@dataclass(frozen=True)
class Templates:
    names: list[str]
    weights: np.ndarray
    sizes: np.ndarray
    versions: list[frozenset[str]]


@dataclass(frozen=True)
class Scanner:
    """Weights of terms and templates; its size is that of the templates."""

    files: int
    df: np.ndarray

    @property
    def unknown(self) -> float:
        return math.log((1 + self.files) / 2) + 1 if self.files else 1.0

    def idf(self, term: int) -> float:
        return math.log((1 + self.files) / (1 + self.df[term])) + 1

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray, float]:
        """(template terms, their weights, the squared norm of the other terms)."""
        known = [(VOCABULARY[w], n) for w, n in counts.items() if w in VOCABULARY]
        terms = np.array([t for t, _ in known], np.int64)
        weights = np.array([(1 + math.log(n)) * self.idf(t) for t, n in known])
        return terms, weights, sum((1 + math.log(n)) ** 2 for w, n in counts.items() if w not in VOCABULARY) * self.unknown**2

    def prepared(self) -> Templates:
        whole = [(name, text) for name in sorted(TEMPLATES) for text in TEMPLATES[name]]
        texts = [(name, Counter(words(text))) for name, text in whole]
        weights = np.zeros((len(texts), len(VOCABULARY)))
        for row, (_, counts) in zip(weights, texts):
            terms, w, _ = self.vector(counts)
            row[terms] = w / np.sqrt(w @ w)
        return Templates([n for n, _ in texts], weights, np.array([sum(c.values()) for _, c in texts], float), [versions(t) for _, t in whole])

    def best(self, counts: Counter, templates: Templates, least: float, lines: list[str]) -> tuple[float, float, str, bool] | None:
        """(evidence, cosine, licence, ambiguous) of the templates with a cosine of at least ``least``.

        Version numbers decide: a template that names versions, none of which the text (``lines``) has, while that names
        others, is of another licence.

        The evidence of a template is its cosine to the fourth power times the words that stand against each other;
        ties go to the first name in the alphabet. It is ambiguous if another licence has nearly as much.
        A text whose template terms hold too little of its norm is left at once: no cosine exceeds that share.
        """
        if not any(w in VOCABULARY for w in counts):
            return None
        terms, weights, other = self.vector(counts)
        square = float(weights @ weights)
        if square < least * least * (square + other):
            return None
        cosine = np.round(templates.weights[:, terms] @ weights / math.sqrt(square + other), 12)
        if cosine.max() < least:
            return None
        told = versions(" ".join(lines))
        if told:
            for k in np.flatnonzero(cosine >= least):
                if templates.versions[k] and not templates.versions[k] & told:
                    cosine[k] = 0
        evidence = np.where(cosine >= least, cosine**4 * np.minimum(templates.sizes, sum(counts.values())), 0)
        k = int(evidence.argmax())
        if not evidence[k]:
            return None
        name = templates.names[k]
        second = max((e for e, n in zip(evidence, templates.names) if n != name), default=0)
        return float(evidence[k]), float(cosine[k]), name, bool(second >= ALIKE * evidence[k])

    def scan(self, text: str | None, templates: Templates, least: float) -> tuple[str | None, float, int | None, int, int, bool]:
        """(licence, cosine, first line of it, words of matching lines, words of the text, ambiguous).

        Of the text's lines, paragraphs and whole the one with the most evidence counts, then the first.
        """
        best: tuple[float, float, str, bool, int] | None = None
        total = matched = 0
        paragraph, start, lines = Counter(), 0, 0
        whole, denied, refused = Counter(), False, False
        parts = [*(text or "").split("\n"), ""]

        def offer(counts: Counter, line: int, of: list[str]) -> bool:
            nonlocal best
            got = self.best(counts, templates, least, of)
            if got and (best is None or (-got[0], line, got[2]) < (-best[0], best[4], best[2])):
                best = (*got, line)
            return got is not None

        for number, line in enumerate(parts):
            counts = Counter(words(line))
            if not counts:
                if lines > 1 and not denied:
                    offer(paragraph, start, parts[start:number])
                paragraph, start, lines, denied = Counter(), number + 1, 0, False
                continue
            n = sum(counts.values())
            total += n
            if DENIED.search(line) and self.best(counts, templates, DENIED_LEAST, [line]):
                denied = refused = True
            else:
                matched += n * offer(counts, number, [line])
            paragraph.update(counts)
            lines += 1
            whole.update(counts)
        if not refused:
            offer(whole, 0, parts)
        return (best[2], best[1], best[4], matched, total, best[3]) if best else (None, 0.0, None, matched, total, False)


def scan(files: DataFrame, least: float = 0.75, file_share: float = 0.2, scanner: Scanner | None = None) -> DataFrame:
    """file_id, path, license, cosine, line, ambiguous, is_license_file of every file (file_id, path, text).

    A licence file has a licence and either a name that says so or at least ``file_share`` of its words in
    licence lines. Null and empty texts have no licence, and a line that denies one gives none.
    """
    scanner = scanner or Scanner(*frequencies(files))
    sent = files.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        templates = known.prepared()
        for batch in batches:
            rows = [known.scan(t.as_py(), templates, least) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.bool_()),
                    pa.array([bool(r[0]) and r[3] >= file_share * max(1, r[4]) for r in rows], pa.bool_()),
                ],
                names=["file_id", "path", "license", "cosine", "line", "ambiguous", "mostly"],
            )

    schema = "file_id long, path string, license string, cosine double, line long, ambiguous boolean, mostly boolean"
    found = files.select(F.col("file_id").cast("long"), F.coalesce("path", F.lit("")), "text").mapInArrow(run, schema)
    is_file = F.col("license").isNotNull() & (F.col("mostly") | F.col("path").rlike(LICENSE_FILE))
    return found.select("file_id", "path", "license", "cosine", "line", "ambiguous", is_file.alias("is_license_file"))


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` with inherited_license, inherited_from (a directory) and effective_license.

    The nearest directory at or above the file's own that has a licence file counts; of several licence files
    in a directory, the one of the largest cosine, then of the first path. The root is the directory ''.
    """
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    files = scanned.withColumn("_dir", directory)
    licensed = (
        files.where("is_license_file")
        .groupBy(F.col("_dir").alias("_at"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license"))["license"].alias("_license"))
    )
    depth = F.size(F.split("_dir", "/"))
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("_dir", "/"), 1, k), "/"))
    # every directory is below the root, so its one licence is joined to none of them but added where no other is nearer
    directories = files.select("_dir").distinct().select("_dir", F.posexplode(prefixes).alias("_depth", "_at"))
    root = licensed.where("_at = ''").first()
    root = F.lit(root["_license"] if root else None).cast("string")
    # a directory with a large share of all below it is no key of a shuffle: there are few of them
    directories = written(directories, "directories")
    sizes = directories.groupBy("_at").agg(F.count(F.lit(1)).alias("_below"))
    licensed = written(licensed.where("_at <> ''").join(sizes, "_at"), "licensed")
    wide = F.col("_below") * WIDE > directories.count()
    met = [directories.join(x.drop("_below"), "_at") for x in (F.broadcast(licensed.where(wide)), licensed.where(~wide))]
    below = (
        met[0].unionByName(met[1])
        .groupBy("_dir")
        .agg(F.max(F.struct("_depth", "_at", "_license")).alias("_n"))
        .select("_dir", F.col("_n._license").alias("_license"), F.col("_n._at").alias("_at"))
    )
    nearest = files.select("_dir").distinct().join(below, "_dir", "left")
    nearest = nearest.select(
        "_dir",
        F.coalesce("_license", root).alias("inherited_license"),
        F.coalesce("_at", F.when(root.isNotNull(), F.lit(""))).alias("inherited_from"),
    ).where("inherited_license IS NOT NULL")
    own = F.col("license").isNotNull()
    return (
        files.join(written(nearest, "nearest"), "_dir", "left")
        .drop("_dir")
        .withColumn("inherited_license", F.when(~own, F.col("inherited_license")))
        .withColumn("inherited_from", F.when(~own, F.col("inherited_from")))
        .withColumn("effective_license", F.coalesce("license", "inherited_license"))
    )


def license_scan(files: DataFrame, least: float = 0.75, file_share: float = 0.2) -> DataFrame:
    """Scan and inheritance over files (file_id, path, text): one row for each row. An empty table gives none.

    Rows that repeat a path are files of their own. A null path is a file in the root. Other columns are not read.
    """
    return inherit(written(scan(files.select("file_id", "path", "text"), least, file_share), "scanned"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of repositories: source/lang/thousand/doc_id."""
    docs = table(spark, sf_dir, "documents")
    parts = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("doc_id div 1000").cast("string"), F.col("doc_id").cast("string")]
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", *parts).alias("path"), "text")
    return license_scan(files).withColumnRenamed("file_id", "doc_id")
