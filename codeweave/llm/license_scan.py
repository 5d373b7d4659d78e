"""Find licence texts and notices by the Dice coefficient over word bigrams.

A unit is a line, or a whole document of several lines.  Units and templates are normalised (lower
case, every run of other characters than letters and digits is one space) and compared as bags of
word bigrams: dice = 2 * overlap / (n_unit + n_template).  For a threshold t only templates with
n_template * t / (2 - t) <= n_unit <= n_template * (2 - t) / t can reach it, so longer and shorter
units are pruned by their word count before any bigram is made.

With ``passages`` on, notices that are neither a line nor a document are found too: wrapped over lines
of a longer text, or inside a longer line.  A passage is a run of words.  A run that reaches t shares
at least n_template * t / (2 - t) bigrams, so it has one of a few words that cover the rest of the template, and one of a few
bigrams that do; only texts with such a word and bigram are looked at (as lines and documents are): they are written once, and all else reads them.  There, the best run up to each shared bigram follows from
running sums: 2 * overlap - t * n_unit is at least t * n_template.  It is looked for among runs of up to
``REACH`` times the template, and the runs found are scored exactly.  Of runs that overlap the best is
reported; none in a document that matches, in a line that matches, or over such a line of its licence.

The templates are a fixed list, short notices in this module and whole texts in ``licenses`` (some twenty
thousand bigrams), so their table is broadcast; its size does not depend on the data.

Defined cases: null, empty and one-word units match nothing; of templates with equal scores the
first by name is reported; a passage has the line of its first word; repeated rows are reported each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweave import runtime

#: Longest runs, by the template's size, among which a passage is looked for; and the largest size that can match.
REACH = (1.0, 1.2)

TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/"
        "LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-short": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause-short": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ),
    "Unlicense-short": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Lesser General Public License for more details."
    ),
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Affero General Public License for more details."
    ),
    "All-rights-reserved": "Copyright. All rights reserved.",
}
TEMPLATES["MPL-2.0-header"] = TEMPLATES.pop("MPL-2.0")
#: Whole licence texts, by the names of their files.
TEMPLATES |= {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _bigrams(text: str) -> Counter:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scan(df: DataFrame, key: str, text: str, threshold: float = 0.8, templates: dict[str, str] | None = None, passages: bool = False) -> DataFrame:
    """Matches: key, unit ('line', 'document' or 'passage'), line (from 0; null for a document), license, dice."""
    spark, since = df.sparkSession, runtime.staged()
    bags = {name: _bigrams(t) for name, t in (templates or TEMPLATES).items()}
    sizes = {name: sum(bag.values()) for name, bag in bags.items()}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    most = int(max(sizes.values()) * high)
    least = min(sizes.values()) * low
    table = F.broadcast(
        spark.createDataFrame(
            [(name, sizes[name], g, n) for name, bag in bags.items() for g, n in bag.items()],
            "license string, n_template int, gram string, n_in_template int",
        )
    )
    anchors = sorted(set().union(*(_anchors(b, low) for b in bags.values())))
    # No unit of a text without an anchor and a rare bigram can match, and few texts have one, so all else reads only these.
    docs = df.select(F.monotonically_increasing_id().alias("rid"), df[key].alias("k"), df[text].alias("t"))
    docs = docs.withColumn("w", F.split(_norm(F.col("t")), " ")).where(F.exists("w", lambda x: x.isin(anchors)))
    rare = sorted(set().union(*(_rare(b, low) for b in bags.values())))
    docs = runtime.stage(docs.where(F.exists(_pairs(F.col("w"), F.size("w") - 1), lambda x: x.isin(rare))).drop("w"), "anchored")
    lines = docs.select("rid", "k", F.posexplode(F.split("t", "\n")).alias("line", "u"))
    whole = docs.where(F.contains("t", F.lit("\n"))).select("rid", "k", F.lit(-1).alias("line"), F.col("t").alias("u"))
    units = lines.unionByName(whole).select("rid", "k", "line", F.split(_norm(F.col("u")), " ").alias("w"))
    units = units.withColumn("n_unit", F.size("w") - 1).where((F.col("n_unit") >= least) & (F.col("n_unit") <= most) & (F.col("n_unit") > 0))
    units = units.where(F.exists("w", lambda x: x.isin(anchors)))
    grams = units.select("rid", "k", "line", "n_unit", F.explode(_pairs(F.col("w"), F.col("n_unit"))).alias("gram"))
    inside = (F.col("n_unit") >= F.col("n_template") * low) & (F.col("n_unit") <= F.col("n_template") * high)
    met = grams.join(table, "gram").where(inside)
    bag = met.groupBy("rid", "k", "line", "n_unit", "license", "n_template", "gram").agg(
        F.least(F.count(F.lit(1)), F.first("n_in_template")).alias("shared")
    )
    dice = bag.groupBy("rid", "k", "line", "n_unit", "license", "n_template").agg(
        (2.0 * F.sum("shared") / (F.col("n_unit") + F.col("n_template"))).alias("dice")
    ).where(F.col("dice") >= threshold)
    rank = F.row_number().over(Window.partitionBy("rid", "line").orderBy(F.desc("dice"), "license"))
    best = dice.withColumn("_rank", rank).where("_rank = 1")
    out = best.select(
        F.col("k").alias(key),
        F.when(F.col("line") < 0, F.lit("document")).otherwise(F.lit("line")).alias("unit"),
        F.when(F.col("line") >= 0, F.col("line")).alias("line"),
        "license",
        "dice",
    )
    return runtime.settle(out.unionByName(_passages(docs, key, threshold, table)) if passages else out, "licences", since)


def _pairs(words: Column, n: Column) -> Column:
    """The first ``n`` bigrams of an array of words."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _rare(bag: Counter, low: float) -> set[str]:
    """Bigrams without which no text shares ``low`` of them; long ones first."""
    out, left = set(), sum(bag.values())
    need = left * low
    for gram in sorted(bag, key=lambda g: (-len(g), g)):
        if left < need - 1e-9:
            break
        out.add(gram)
        left -= bag[gram]
    return out


def _anchors(bag: Counter, low: float) -> set[str]:
    """Words without which no text shares ``low`` of the bigrams; long words first."""
    rest, out = dict(bag), set()
    left = sum(bag.values())
    need = left * low
    grams = {}
    for g in bag:
        for w in g.split():
            grams.setdefault(w, set()).add(g)
    for word in sorted(grams, key=lambda w: (-len(w), w)):
        if left < need - 1e-9:
            break
        out.add(word)
        left -= sum(rest.pop(g, 0) for g in grams[word])
    return out


def _passages(docs: DataFrame, key: str, threshold: float, table: DataFrame) -> DataFrame:
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    lines = F.transform(F.split("t", "\n"), lambda x: F.filter(F.split(_norm(x), " "), lambda w: w != ""))
    docs = docs.select("rid", "k", lines.alias("lw")).select(
        "rid", "k", F.flatten(F.transform("lw", lambda x, i: F.transform(x, lambda w: F.struct(w.alias("w"), i.alias("i"), F.size(x).alias("n"))))).alias("w")
    )
    n = F.size("w") - 1
    docs = docs.withColumn("n_doc", n).where(n > 0)
    pairs = F.zip_with(
        F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n),
        lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("gram"), a["i"].alias("first"), b["i"].alias("last"), (a["n"] - 1).alias("n_line")),
    )
    grams = docs.select("rid", "k", "n_doc", F.posexplode(pairs).alias("p", "x")).select("rid", "k", "n_doc", "p", "x.*")
    by = Window.partitionBy("rid", "license")
    met = grams.join(table, "gram").withColumn("m", F.count(F.lit(1)).over(by)).where(F.col("m") >= F.col("n_template") * low - 1e-9)
    met = runtime.stage(met, "hits")  # a few hits of the texts that are left, used several times

    def dice(hits: DataFrame, size: str, *unit: str) -> DataFrame:
        keys = [*unit, "license", "n_template", size]
        bag = hits.groupBy(*keys, "gram").agg(F.least(F.count(F.lit(1)), F.first("n_in_template")).alias("shared"))
        score = 2.0 * F.sum("shared") / (F.col(size) + F.col("n_template"))
        return bag.groupBy(*keys).agg(score.alias("dice")).where(F.col("dice") >= threshold)

    order = by.orderBy("p")
    at = met.withColumn("nth", F.row_number().over(order))
    found = []
    for reach in (*REACH, high):
        # The order is scaled so that one frame has the same share of every template.
        x = (F.col("p") * 1e9 / F.greatest(F.floor(F.col("n_template") * reach + 1e-9), F.lit(1))).cast("long")
        frame = by.orderBy("x").rangeBetween(-(10**9) + 1, 0)
        start = F.min(F.struct((2 * (F.col("nth") - 1) - threshold * F.col("p")).alias("a"), (-F.col("p")).alias("p"))).over(frame)
        one = at.withColumn("x", x).withColumn("from", start)
        gain = 2 * F.col("nth") - threshold * (F.col("p") + 1) - F.col("from.a")
        one = one.select("rid", "license", "n_template", (-F.col("from.p")).alias("start"), F.col("p").alias("end"), gain.alias("gain"))
        one = one.where(F.col("gain") >= threshold * F.col("n_template") - 1e-6)
        found.append(one.groupBy("rid", "license", "n_template", "start").agg(F.max_by("end", F.struct("gain", -F.col("end"))).alias("end")))
    runs = found[0].unionByName(found[1]).unionByName(found[2]).distinct().withColumn("n_unit", F.col("end") - F.col("start") + 1)
    hits = met.drop("n_template").join(runs, ["rid", "license"]).where((F.col("p") >= F.col("start")) & (F.col("p") <= F.col("end")))
    scored = dice(hits, "n_unit", "rid", "start", "end")
    # Of overlapping runs the best; then the first by licence, then by place.
    ranked = scored.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct((-F.col("dice")).alias("d"), "license", "start", "end"))).alias("all"))
    apart = lambda a, b: (a["start"] > b["end"] + 1) | (a["end"] + 1 < b["start"])
    none = F.slice("all", F.lit(1), F.lit(0))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc))
    best = ranked.select("rid", F.explode(kept).alias("r")).select("rid", "r.license", "r.start", "r.end", (-F.col("r.d")).alias("dice"))
    ends = met.select("rid", "k", "license", "p", "first", "last")
    best = best.join(ends.select("rid", "k", "license", F.col("p").alias("start"), F.col("first").alias("line")), ["rid", "license", "start"])
    best = best.join(ends.select("rid", "license", F.col("p").alias("end"), F.col("last").alias("to")), ["rid", "license", "end"])
    whole = dice(met, "n_doc", "rid").select("rid").distinct()
    lines = dice(met.where("first = last"), "n_line", "rid", "first").select("rid", F.col("first").alias("own"), F.col("license").alias("theirs"))
    best = best.join(whole, "rid", "left_anti").alias("b").join(
        lines.alias("l"),
        F.expr("b.rid = l.rid and ((b.license = l.theirs and l.own between b.line and b.to) or (b.line = b.to and b.line = l.own))"),
        "left_anti",
    )
    return best.select(F.col("k").alias(key), F.lit("passage").alias("unit"), "line", "license", "dice")
