"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

One Arrow pass reads whole texts and keeps their licence sentences (header), or all words of a licence file: a file
is one by its name, or if all its words come to a cosine of ``LEAST_FILE`` with the full text of a licence. Templates
are full texts and notices of public licences, and sentences that name one. Document
frequencies of the templates' words are counted over all kept headers (a row for each word of the templates at most).
A header's licence is the template with the highest cosine, if it reaches ``LEAST``. A directory's licence is that of
the licence files in it; a document without a licence of its own inherits from the nearest ancestor directory with
one: distinct directories are joined with their ancestors' licences by path, the deepest wins, and documents join
their directory. Hot directories are folded before that, and joins either broadcast a table of checked size or shuffle
with adaptive splitting.

Defined results: null text counts as empty; a null path is the root directory; ties between templates go to the name
that sorts first; of a directory's licence files those by name come first, then the higher score; repeated rows give repeated results; very long texts form
blocks of their own; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, small, written

#: Least cosine of a header to a template, and of a whole text to a full licence text that makes it a licence file.
LEAST, LEAST_FILE = 0.6, 0.9

#: Names that notices call a licence by, and sentences of its own.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL v3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0-1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["the Unlicense"],
}
TEXTS = {
    "Apache-2.0": ["you may not use this file except in compliance with the License"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
FRAMES = ("Licensed under the {}.", "SPDX-License-Identifier: {}")

_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details.
You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."""


def _gnu(name: str, version: str) -> str:
    return _GNU.format(name, version, name, name)


#: Full texts of short licences, and the notices that the long ones ask to be put into files (fixed public wording).
FULL = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions:
"""
    + _MIT_END,
    "BSD-2-Clause": "BSD 2-Clause License\n" + _BSD_START + "\n" + _BSD_END,
    "BSD-3-Clause": "BSD 3-Clause License\n"
    + _BSD_START
    + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
    + _BSD_END,
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
}


def _trigger() -> re.Pattern[str]:
    """What a licence sentence has: words of notices, a name with a version, or any name behind "under" (plain names such
    as MIT are words of other texts, too). No template fails it."""
    spelt = {n: r"\s+".join(map(re.escape, n.split())) for names in NAMES.values() for n in names}
    versioned = "|".join(s for n, s in spelt.items() if re.search(r"\d", n))
    named = rf"\b(?:{versioned})\b|\bunder\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:{'|'.join(spelt.values())})\b"
    return re.compile(rf"licen[sc]|copyright|spdx|public domain|hereby granted|endorse or promote|{named}", re.IGNORECASE)


_TRIGGER = _trigger()
#: Found apart from the expression, which would try it at every "e".
_WARRANTY = ("express or implied", "EXPRESS OR IMPLIED")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n")
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_FILE = re.compile(r"(?:^|/)(?:licen[sc]e|copying|notice|unlicense)[^/]*$", re.IGNORECASE)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_notice(text: str) -> bool:
    return any(w in text for w in _WARRANTY) or _TRIGGER.search(text) is not None


def sentences() -> list[tuple[str, str]]:
    """(licence, sentence) of single notices, sorted."""
    found = [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FRAMES]
    return sorted(found + [(k, t) for k, texts in TEXTS.items() for t in texts])


def templates() -> list[tuple[str, str]]:
    """(licence, text), sorted: notices of a sentence, and full texts."""
    return sorted(sentences() + list(FULL.items()))


def header_of(path: str | None, text: str | None, file_words: int = 0) -> tuple[str, int] | None:
    """(words of a licence file by name or of a text's licence sentences, 2 for a licence file by name, 1 for a text
    that is nearly a full licence text or, with a licence sentence, has no more than ``file_words`` words, else 0); None
    without any."""
    text = text or ""
    by_name = bool(path and _FILE.search(path))
    if by_name:
        return " ".join(words(text)), 2
    if not has_notice(text):
        return None
    if _FULL.like(text):
        return " ".join(words(text)), 1
    return " ".join(w for s in _SENTENCE.split(text) if has_notice(s) for w in words(s)), int(bool(file_words) and len(text.split(None, file_words)) <= file_words)


class _FullTexts:
    """Full licence texts as unit vectors of word counts, to tell whole texts that are one from texts that name one."""

    def __init__(self) -> None:
        self.rows = []
        for text in FULL.values():
            counts = Counter(words(text))
            self.rows.append((counts, sum(n * n for n in counts.values()) ** 0.5))

    def like(self, text: str, least: float = LEAST_FILE) -> bool:
        distinct = Counter(words(text))
        norm = sum(n * n for n in distinct.values()) ** 0.5
        return any(sum(n * distinct[w] for w, n in counts.items()) >= least * norm * own for counts, own in self.rows)


_FULL = _FullTexts()


_HEADERS = T.StructType([T.StructField("path", T.StringType()), T.StructField("header", T.StringType()), T.StructField("is_file", T.IntegerType())])


def headers(df: DataFrame, id_col: str, path: str, text: str, file_words: int = 0) -> DataFrame:
    """(id, path, header, is_file) of every row; header is null where there is no licence sentence."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *_HEADERS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            paths = block.column("path").to_pylist()
            found = [header_of(p, t, file_words) for p, t in zip(paths, block.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("path"), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else 0 for f in found], pa.int32())],
                names=schema.names,
            )

    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class LicenceModel:
    """Unit TF-IDF rows of the templates, and each licence's first row."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    rows: np.ndarray
    licences: tuple[str, ...]

    @staticmethod
    def build(frequency: dict[str, int], documents: int) -> LicenceModel:
        """``frequency``: in how many of ``documents`` headers a word is; the templates count as headers, too."""
        known = templates()
        split = [words(s) for _, s in known]
        own = Counter(w for s in split for w in set(s))
        vocabulary = {w: i for i, w in enumerate(sorted(own))}
        # the corpus weighs as much as the templates, however large it is
        share = len(split) / max(1, documents)
        idf = np.array([np.log((1 + 2 * len(split)) / (1 + own[w] + min(1.0, share) * frequency.get(w, 0))) for w in vocabulary])
        rows = np.zeros((len(split), len(vocabulary)))
        for i, s in enumerate(split):
            for w, n in Counter(s).items():
                rows[i, vocabulary[w]] = n * idf[vocabulary[w]]
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        return LicenceModel(vocabulary, idf, rows, tuple(k for k, _ in known))

    def best(self, header: str) -> tuple[str, float] | None:
        """The licence with the highest cosine to the header's words that templates know."""
        counts = Counter(self.vocabulary[w] for w in header.split() if w in self.vocabulary)
        if not counts:
            return None
        at = np.fromiter(counts, dtype=np.int64)
        v = np.fromiter(counts.values(), dtype=float) * self.idf[at]
        cosine = self.rows[:, at] @ v / (np.linalg.norm(v) or 1.0)
        i = int(np.argmax(np.round(cosine, 9)))
        return self.licences[i], float(cosine[i])


def frequencies(found: DataFrame) -> tuple[dict[str, int], int]:
    """In how many headers each word of the templates is, and the number of headers. Copies are folded first."""
    known = sorted({w for _, s in templates() for w in words(s)})
    folded = found.where("header is not null").groupBy("header").count()
    split = folded.select(F.explode(F.array_intersect(F.split("header", " "), F.array(*map(F.lit, known)))).alias("word"), "count")
    rows = split.groupBy("word").agg(F.sum("count").alias("n")).collect()  # one row for each known word at most
    total = found.where("header is not null").count()
    return {r["word"]: r["n"] for r in rows}, total


def own_licences(found: DataFrame, model: LicenceModel, least: float = LEAST) -> DataFrame:
    """``found`` with ``licence`` and ``cosine`` of each header; null where it doesn't reach ``least``."""
    schema = T.StructType([*found.schema.fields, T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType())])
    held = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, float] | None] = {}
        for batch in batches:
            out = []
            for h in batch.column("header").to_pylist():
                if h is None:
                    out.append(None)
                    continue
                if h not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    b = held.value.best(h)
                    seen[h] = b if b and b[1] >= least else None
                out.append(seen[h])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o and o[0] for o in out], pa.string()), pa.array([o and o[1] for o in out], pa.float64())], names=schema.names)

    return found.mapInArrow(run, schema)


def directory(path) -> F.Column:
    """The path up to its last slash; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(licensed: DataFrame) -> DataFrame:
    """(dir, near, from_dir) of each directory of ``licensed`` that has a licence in it or above it."""
    files = licensed.where("is_file > 0 and licence is not null")
    holders = files.groupBy("dir").agg(F.max(F.struct("is_file", "cosine", "licence")).alias("top"))
    holders = written(holders.select(F.col("dir").alias("from_dir"), F.col("top.licence").alias("near")), "licence-dirs")
    dirs = licensed.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    )
    paths = dirs.select("dir", F.posexplode(above).alias("depth", "from_dir"))
    met = paths.join(small(holders), "from_dir")
    return met.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "near")).alias("top")).select("dir", "top.from_dir", "top.near")


def licences(df: DataFrame, id_col: str = "doc_id", path: str = "path", text: str = "text", least: float = LEAST, file_words: int = 0) -> DataFrame:
    """(id, path, licence, cosine, basis, from_dir) of every row: ``basis`` is ``own``, ``inherited`` or ``none``. With
    ``file_words``, texts of so many words or fewer that name a licence count as licence files, too."""
    found = written(headers(df, id_col, path, text, file_words), "licence-headers")
    model = LicenceModel.build(*frequencies(found))
    licensed = written(own_licences(found, model, least).withColumn("dir", directory(F.col("path"))), "licence-own")
    near = written(inherited(licensed), "licence-inherited")
    met = licensed.join(small(near), "dir", "left")
    basis = F.when(F.col("licence").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return met.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("licence", "near").alias("licence"),
        "cosine",
        basis.alias("basis"),
        F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """``documents`` have no paths: they are filed as source/language/hundred/id. A licence file among them is one by
    its whole text only."""
    from ._common import documents

    docs = documents(spark, sf_dir)
    folder = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    return licences(docs.select("doc_id", "text", folder.alias("path")))
