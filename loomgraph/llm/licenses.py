"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined with their positions in license templates. A hit votes for the
diagonal (document position less template position) of its template; neighbouring diagonals, which inserted or
missing words part, are merged; a merged run is verified by the share of the template's own words that its hits
cover, each word once, and by the share of its words that they cover.

The hash is perfect: words are numbered by the templates' vocabulary, and a k-gram is the number whose digits its
words are. So equal hashes are equal words, and a k-gram with a word that no template has needs no lookup.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, texts

#: Phrases that stand for a label on their own.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
#: License texts and notices, by name; what is before the colon is the label.
TEMPLATES = {
    "mit:grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "mit:disclaimer": (
        f"{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."
    ),
    "mit:line": "Released under the MIT License",
    "apache:notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License."
    ),
    "apache:line": "Licensed under the Apache License, Version 2.0",
    "gpl:notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "gpl:line": "This work is licensed under the GNU General Public License, version 3",
    "bsd:clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "bsd:disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
    "isc:text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib:text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
    "unlicense:text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc-by:line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: Lower-cases A-Z, keeps 0-9, a-z and bytes beyond ASCII, and turns the rest into blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What marks the row of a document itself among its hits; no k-gram of templates is 0.
_SELF = 0


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def numbers(templates: Mapping[str, list[bytes]], k: int) -> dict[bytes, int]:
    """The templates' words, numbered from 1."""
    out = {w: i for i, w in enumerate(sorted({w for own in templates.values() for w in own}), 1)}
    if (len(out) + 1) ** k >= 1 << 63:
        raise ValueError("the templates have too many words for a perfect hash of k of them")
    return out


def rolling(tokens: list[bytes], k: int, number: Mapping[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs of k words all of which templates have."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    get = number.get
    each = np.fromiter((get(t, 0) for t in tokens), np.int64, len(tokens))
    known, h = np.ones(n, bool), np.zeros(n, np.int64)
    for j in range(k):
        part = each[j : j + n]
        known &= part > 0
        h = h * (len(number) + 1) + part
    at = np.flatnonzero(known)
    return at, h[at]


def phrase_places(tokens: list[bytes], phrases: Mapping[str, str]) -> dict[str, list[int]]:
    """Word positions at which each phrase stands, for the phrases that occur."""
    line = b" " + b" ".join(tokens) + b" "
    out: dict[str, list[int]] = {}
    for phrase in phrases:
        want = b" " + phrase.encode() + b" "
        at, upto, word = line.find(want), 0, 0
        while at >= 0:
            word += line.count(b" ", upto, at)
            upto = at
            out.setdefault(phrase, []).append(word)
            at = line.find(want, at + 1)
    return out


def merge(votes: list[tuple[str, int, int, list[int]]], sizes: Mapping[str, int], k: int, drift: int, least_share: float) -> list[dict]:
    """Verified spans from one document's votes (template, diagonal, first document position, template positions).

    In the order of diagonals, one joins the run before it if it is at most `drift` away and begins within a
    template's length of the run. Each hit stands for k equal words in both. A run is verified if its hits
    cover at least `least_share` of the template's words, each counted once, and of the span's own words.
    """
    out = []
    by_template: dict[str, list] = {}
    for v in votes:
        by_template.setdefault(v[0], []).append(v)
    for template, rows in by_template.items():
        size = sizes[template]
        runs: list[list] = []
        for _, diagonal, first, at in sorted(rows, key=lambda v: (v[1], v[2])):
            begin, end = diagonal + min(at), diagonal + max(at) + k
            run = runs[-1] if runs else None
            if run and diagonal - run[0] <= drift and run[1] - size <= begin <= run[2] + size:
                run[0], run[1], run[2] = diagonal, min(run[1], begin), max(run[2], end)
                run[3].append((diagonal, at))
            else:
                runs.append([diagonal, begin, end, [(diagonal, at)]])
        for _, begin, end, parts in runs:
            of_template = {t + j for _, at in parts for t in at for j in range(k)}
            of_span = {d + t + j for d, at in parts for t in at for j in range(k)}
            share, own = len(of_template) / size, len(of_span) / (end - begin)
            if share >= least_share and own >= least_share:
                out.append({"template": template, "start": begin, "end": end, "share": share})
    return sorted(out, key=lambda s: (s["start"], s["template"]))


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    k: int = 4,
    drift: int = 6,
    least_share: float = 0.6,
) -> DataFrame:
    """Licenses in all rows of docs(doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word (places of phrases), base_labels and labels (sorted
    arrays), spans (array of template, start, end in words, share) and score: the greatest share of a template
    that a verified span covers, 0.5 at least where a phrase stands. A null text is an empty one; repeated rows
    stay; further columns are dropped; an empty table gives no rows. The templates are parameters, so the table
    that is broadcast has as many rows as they have words.
    """
    spark = docs.sparkSession
    cut = {name: words(text) for name, text in templates.items()}
    sizes = {name: len(w) for name, w in cut.items()}
    number = numbers(cut, k)
    table = [(int(h), name, int(i)) for name, w in cut.items() for i, h in zip(*rolling(w, k, number))]
    grams = spark.createDataFrame([(_SELF, "", 0), *table], "hash long, template string, at int")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            rows: list[tuple] = []
            hits, ends, own = [(np.empty(0, np.int64),) * 2], [0], (np.full(1, -1), np.full(1, _SELF))
            for text in texts(batch):
                tokens = words(text)
                found = phrase_places(tokens, phrases)
                places = sorted(x for p in found.values() for x in p)
                rows.append((len(tokens), len(places), places[0] if places else None, places[-1] if places else None, sorted({phrases[p] for p in found})))
                hits += [own, rolling(tokens, k, number)]
                ends.append(ends[-1] + 1 + len(hits[-1][0]))
            columns = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.list_(pa.string())]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            each = pa.StructArray.from_arrays([pa.array(np.concatenate([h[0] for h in hits])), pa.array(np.concatenate([h[1] for h in hits]))], ["pos", "hash"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["row_key", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"])

    own = "row_key long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>"
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")
    read_rows = map_batches(keyed, read, own + ", grams array<struct<pos:long,hash:long>>")
    # The first entry of each row stands for the document itself; it alone carries the document's columns along.
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word")
    each = read_rows.select("*", F.explode("grams").alias("gram")).select("row_key", "gram.*", *columns, "base_labels")
    of_doc = F.col("hash") == _SELF
    thin = each.select("row_key", "pos", "hash", *[F.when(of_doc, F.col(c)).alias(c) for c in columns], F.when(of_doc, F.concat_ws(",", "base_labels")).alias("base_labels"))
    hits = thin.join(F.broadcast(grams), "hash")
    # A diagonal of a template has at most as many hits as the template has words.
    voted = hits.groupBy("row_key", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.collect_list("at").alias("at"), *[F.max(c).alias(c) for c in (*columns, "base_labels")]
    )
    vote = F.when(F.col("template") != "", F.struct("template", "diagonal", "first", "at"))
    by_doc = voted.groupBy("row_key").agg(*[F.max(c).alias(c) for c in (*columns, "base_labels")], F.collect_list(vote).alias("votes"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [x.split(",") if x else [] for x in batch.column(5).to_pylist()]
            spans = [merge([tuple(v.values()) for v in votes], sizes, k, drift, least_share) if votes else [] for votes in batch.column(6).to_pylist()]
            labels = [sorted({*b, *(s["template"].split(":")[0] for s in found)}) for b, found in zip(base, spans)]
            score = [max([0.5 * bool(b), *(s["share"] for s in found)]) for b, found in zip(base, spans)]
            kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
            made = [pa.array(base, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(spans, kind), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<template:string,start:long,end:long,share:double>>, score double"
    return map_batches(by_doc.drop("row_key"), finish, schema)
