"""License scans: named licenses, and an exact set-similarity join of text blocks with license notices.

A block is a window of ``2 * s`` words, one starting at every ``s`` words, so that any run of up to ``s`` words lies
whole in a block, however its lines are wrapped. A template goes to the smallest size ``s`` that holds it, and
matches a block that contains NEAR of its distinct words; a template of fewer than SHORT words must be there
whole, for a share of so few would let another license's name in. All blocks that match are found:

* words are put in the order of their frequency in all documents, rarest first; only words of templates are counted;
* prefix filter: of n words of which ``need`` must be there, one of the rarest ``n - need + 1`` is. Blocks
  without any such word are never made;
* length filter: a block with fewer template words than ``need`` is passed over;
* positional filter: behind the first shared word both sides must have enough words left;
* what is left is counted exactly.

Templates that nearly hold one another are rivals: in one block the one with the larger share stays, then the one
with more words. Everything is one projection of built-in functions over each text, so no key or group can
become hot; the templates are constants.

Null text is an empty one: no words, no labels (empty strings), null places. Repeated rows and null ids give a row each;
other columns are not read.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import read

#: After A-Z are lower-cased: digits, letters, all that is not ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NEAR, SHORT, SIZES = 0.8, 10, (16, 160)

# The notices that the licenses ask for.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORDS), 0)


def prepared(templates=TEMPLATES, near: float = NEAR, short: int = SHORT, sizes=SIZES) -> list[dict]:
    """id, label, tokens (sorted), need, size and rivals of every template."""
    out = []
    for i, (label, text) in enumerate(templates):
        run = re.findall(WORDS, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        tokens = sorted(set(run))
        fit = [s for s in sizes if s >= len(run)]
        if not fit:
            raise ValueError(f"template {i} has {len(run)} words, blocks hold {max(sizes)}")
        out.append({"id": i, "label": label, "tokens": tokens, "need": len(tokens) if len(tokens) < short else math.ceil(near * len(tokens) - 1e-9), "size": fit[0]})
    for t in out:
        t["rivals"] = [u["id"] for u in out if u is not t and u["size"] == t["size"] and len(set(t["tokens"]) & set(u["tokens"])) >= min(t["need"], u["need"])]
    return out


def frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates stands in ``words``; a row per word of them, no more."""
    found = words.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in found.collect()}


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def base_places(words: Column, phrases=PHRASES) -> Column:
    """start (from 0) and label of each place where a phrase's words stand in a row."""
    split = [(p.split(), label) for p, label in phrases]

    def at(w: Column, i: Column) -> Column:
        found = [F.when((w == p[-1]) & (i >= len(p) - 1) & _before(words, i, p[:-1]), F.struct((i - (len(p) - 1)).cast("long").alias("start"), F.lit(label).alias("label"))) for p, label in split]
        return F.when(w.isin([p[-1] for p, _ in split]), F.array_compact(F.array(*found)))

    return F.flatten(F.array_compact(F.transform(words, at)))


def _before(words: Column, i: Column, run: list[str]) -> Column:
    fits = F.lit(True)
    for back, w in enumerate(reversed(run), 1):
        fits = fits & F.coalesce(F.get(words, i - back) == w, F.lit(False))
    return fits


def matches(words: Column, templates: list[dict], count: dict[str, int]) -> Column:
    """id, share and overlap of the templates in each block, with their rivals settled."""
    order = sorted({w for t in templates for w in t["tokens"]}, key=lambda w: (count.get(w, 0), w))
    sizes = sorted({t["size"] for t in templates})
    return F.concat(*[_of_size(words, s, [t for t in templates if t["size"] == s], order) for s in sizes])


def _of_size(words: Column, size: int, templates: list[dict], order: list[str]) -> Column:
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted(t["tokens"], key=rank.__getitem__) for t in templates]
    prefixes = [s[: len(s) - t["need"] + 1] for s, t in zip(sets, templates, strict=True)]
    probes = sorted({w for p in prefixes for w in p})
    vocabulary = _strings(sorted({w for s in sets for w in s}, key=rank.__getitem__))
    table = F.array(*[F.struct(F.lit(t["id"]).alias("id"), F.lit(len(s)).alias("n"), F.lit(t["need"]).alias("need"), _strings(s).alias("tokens"), _strings(p).alias("prefix"), F.array(*map(F.lit, t["rivals"])).cast("array<int>").alias("rivals")) for t, s, p in zip(templates, sets, prefixes, strict=True)])
    hits = F.array_distinct(F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(probes), F.floor(i / size).cast("int")))))
    starts = F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda j: F.array(j, j - 1)))), lambda j: j >= 0)
    blocks = F.transform(starts, lambda j: F.array_intersect(vocabulary, F.slice(words, j * size + 1, F.lit(2 * size))))  # rarest first

    def met(b: Column) -> Column:
        def fits(t: Column) -> Column:
            first = F.get(F.array_intersect(t["prefix"], b), F.lit(0))
            left = F.least(t["n"] - F.array_position(t["tokens"], first), F.size(b) - F.array_position(b, first)) + 1
            return (F.size(b) >= t["need"]) & F.arrays_overlap(t["prefix"], b) & (left >= t["need"])

        shared = F.transform(F.filter(table, fits), lambda t: F.struct(F.size(F.array_intersect(t["tokens"], b)).alias("overlap"), t.alias("t")))
        return F.filter(shared, lambda x: x["overlap"] >= x["t"]["need"])

    def settled(xs: Column) -> Column:
        share = lambda x: x["overlap"].cast("double") / x["t"]["n"]
        beaten = lambda x: F.exists(xs, lambda y: F.array_contains(x["t"]["rivals"], y["t"]["id"]) & ((share(y) > share(x)) | ((share(y) == share(x)) & (y["overlap"] > x["overlap"]))))
        return F.transform(F.filter(xs, lambda x: ~beaten(x)), lambda x: F.struct(x["t"]["id"].alias("id"), share(x).alias("share"), x["overlap"].alias("overlap")))

    return F.array_distinct(F.flatten(F.transform(F.transform(blocks, met), settled)))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, base (start, label), found (id, share, overlap) of every row of ``docs``."""
    ready = prepared(templates)
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    count = frequencies(words, sorted({w for t in ready for w in t["tokens"]}))
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), base_places(F.col("words"), phrases).alias("base"), matches(F.col("words"), ready, count).alias("found"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    names = F.array(*[F.lit(label) for label, _ in TEMPLATES])
    base = F.transform("base", lambda p: p["label"])
    own = F.transform("found", lambda m: F.get(names, m["id"]))
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda p: p["start"])
    best = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)))
    return scan(docs).select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"), best.alias("score"))


def _duck(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _op13_sql() -> str:
    """In DuckDB every block meets every template of its size; no filter goes before the count."""
    ready = prepared()
    table = ", ".join(f"({t['id']}, '{t['label']}', {t['size']}, {t['need']}, {_duck(t['tokens'])}, {t['rivals']}::INT[])" for t in ready)
    phrases = ", ".join(f"({_duck(p.split())}, '{label}')" for p, label in PHRASES)
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {table}) AS v(id, label, size, need, tokens, rivals)),
phrases AS (SELECT * FROM (VALUES {phrases}) AS v(run, label)),
docs AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT k, words, unnest(range(len(words))) AS i FROM docs),
base AS (SELECT k, i, label FROM starts, phrases WHERE words[i + 1 : i + len(run)] = run),
places AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM base GROUP BY k),
blocks AS (SELECT k, size, j, list_distinct(words[j * size + 1 : (j + 2) * size]) AS block FROM (SELECT k, words, size, unnest(range(len(words) // size + 1)) AS j FROM docs, (SELECT DISTINCT size FROM templates))),
met AS (SELECT k, b.size, j, t.id, label, rivals, len(list_intersect(block, tokens)) AS overlap, len(list_intersect(block, tokens))::DOUBLE / len(tokens) AS share FROM blocks b JOIN templates t ON t.size = b.size WHERE len(list_intersect(block, tokens)) >= need),
kept AS (SELECT k, label, share FROM met x WHERE NOT EXISTS (SELECT 1 FROM met y WHERE y.k = x.k AND y.size = x.size AND y.j = x.j AND list_contains(x.rivals, y.id) AND (y.share > x.share OR (y.share = x.share AND y.overlap > x.overlap)))),
own AS (SELECT k, list(DISTINCT label) AS own, max(share) AS share FROM kept GROUP BY k)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels, greatest(CASE WHEN n_base > 0 THEN 1e0 ELSE 0e0 END, coalesce(share, 0e0)) AS score
FROM docs LEFT JOIN places USING (k) LEFT JOIN own USING (k)
"""


OP13_SQL = _op13_sql()
