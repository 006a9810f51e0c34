"""License notices in texts: word-bigram Dice coefficients against templates.

All windows of a text's normalised words are compared with each template, wherever its lines break. A text
without enough of a template's bigrams is ruled out as a whole. Built-in functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: The coefficient from which a passage counts as the notice.
THRESHOLD = 0.8
#: Runs of so many lines, single lines and the whole text are windows that the tests compare with.
RUNS = (2, 4, 8)


def normal_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(text: str) -> set[str]:
    w = normal_words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}  # noqa: B905


def dice(a: set[str], b: set[str]) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams between which a passage can reach the threshold against a template of `size`.

    The coefficient is at most 2 min / (a + b).
    """
    import math

    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every passage that reaches the threshold against some template has at least one.

    Such a passage holds at least threshold / (2 - threshold) of the template's bigrams, so it can't miss all
    bigrams that the chosen words are part of, once these are more than the rest. Long words are preferred.
    """
    out: list[str] = []
    for _, text in templates:
        left = bigrams(text)
        spare = len(left) * (1 - threshold / (2 - threshold)) + 1e-9
        gone: set[str] = set()
        for w in sorted(set(normal_words(text)), key=lambda w: (w not in out, -len(w), w)):
            if len(gone) > spare:
                break
            own = {g for g in left if w in g.split()}
            gone |= own
            if w not in out:
                out.append(w)
    return sorted(out)


def _words(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often a lambda in f refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _neighbours(b: Column) -> Column:
    """For each bigram of a text: its position, the bigram, and where it stands next before (or -1) and after (or the end)."""
    placed = lambda n: F.array_sort(F.transform(_upto(n), lambda i: F.struct(F.get(b, i).alias("g"), i.alias("at"))))

    def one(o: Column, x: Column, n: Column) -> Column:
        here, before, after = F.get(o, x), F.get(o, x - 1), F.get(o, x + 1)
        return F.struct(here["at"].alias("at"), here["g"].alias("g"), F.when(before["g"] == here["g"], before["at"]).otherwise(-1).alias("prev"), F.when(after["g"] == here["g"], after["at"]).otherwise(n).alias("next"))

    return _let(F.size(b), lambda n: _let(placed(n), lambda o: F.array_sort(F.transform(_upto(n), lambda x: one(o, x, n)))))


def _windows(b: Column, near: Column, t: Column, threshold: float) -> Column:
    """The best window of words from each start against the template t, where it reaches the threshold.

    Some best window starts with a bigram of the template that it holds only once: else the window without
    it is as good. So windows end before their first bigram's next place. Those of more distinct bigrams than
    the template's upper bound can't reach the threshold, so 4 * high + 1 places suffice where these hold more.
    """
    marked = F.transform(near, lambda e: F.struct(e["at"].alias("at"), e["prev"].alias("prev"), e["next"].alias("next"), F.array_contains(t["g"], e["g"]).alias("hit")))

    def best(a: Column, e: Column) -> Column:
        reach, far = e["next"] - e["at"], 4 * t["high"] + 1
        length = F.when(reach <= far, reach).when(F.size(F.array_distinct(F.slice(b, e["at"] + 1, far))) > t["high"], far).otherwise(reach)

        def step(s: Column, x: Column) -> Column:
            new = x["prev"] < e["at"]
            n, same = s["n"] + F.when(new, 1).otherwise(0), s["same"] + F.when(new & x["hit"], 1).otherwise(0)
            d = 2 * same / (n + t["size"])
            better = d > s["d"]
            pick = lambda c, name: F.when(better, c).otherwise(s[name]).alias(name)
            return F.struct(n.alias("n"), same.alias("same"), pick(d, "d"), pick(3 * same - n - t["size"], "score"), pick(x["at"], "end"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("same"), F.lit(0.0).alias("d"), F.lit(0).alias("score"), F.lit(-1).alias("end"))
        found = F.aggregate(F.slice(a, e["at"] + 1, length), zero, step)
        return _let(found, lambda f: F.struct((-f["score"]).alias("score"), (-f["d"]).alias("d"), t["name"].alias("name"), e["at"].alias("start"), f["end"].alias("end")))

    return _let(marked, lambda a: F.filter(F.transform(F.filter(a, lambda e: e["hit"]), lambda e: best(a, e)), lambda w: -w["d"] >= threshold))


def _places(windows: Column, reach: int) -> Column:
    """The windows with the highest scores that share no word with a higher one; none is longer than `reach`.

    Kept windows are held by blocks of `reach` places, so a window is compared with those of its own block and the two beside it.
    """
    none = F.filter(windows, lambda w: F.lit(False))
    clash = lambda w, p: (p["start"] <= w["end"] + 1) & (w["start"] <= p["end"] + 1)
    block = lambda w: F.floor(w["start"] / reach).cast("int")
    empty = F.transform(_upto(F.coalesce(F.array_max(F.transform(windows, block)), F.lit(-1)) + 1), lambda _: none)

    def keep(got: Column, w: Column) -> Column:
        near = F.flatten(F.slice(got, F.greatest(block(w), F.lit(1)), 3))
        return F.when(F.exists(near, lambda p: clash(w, p)), got).otherwise(F.transform(got, lambda x, i: F.when(i == block(w), F.concat(x, F.array(w))).otherwise(x)))

    return F.flatten(F.aggregate(F.array_sort(windows), empty, keep))


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, licenses (sorted, distinct), best_license, best_dice, n_passages.

    Passages are all windows of consecutive words of the text, of every length, across line breaks. licenses
    are those that some passage reaches the threshold with. Passages with a word in common are one place, which
    goes to the passage and template with the most bigrams in common less those only one has (a BSD-3 notice
    holds a whole BSD-2 notice). n_passages counts places; best_license and best_dice are those of the place with
    the greatest coefficient, else null; ties go to the first licence in the alphabet. Null and empty
    texts have none; long texts are scanned whole, repeated rows give repeated results, an empty table an
    empty one, and other columns are ignored.
    """
    grams = [(name, sorted(bigrams(t))) for name, t in templates]
    known = F.array(*[F.lit(g) for g in sorted({g for _, gs in grams for g in gs})])
    each = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(bounds(len(gs), threshold)[0]).alias("low"), F.lit(bounds(len(gs), threshold)[1]).alias("high"), F.lit(len(gs)).alias("size"), F.array(*map(F.lit, gs)).alias("g"))
        for name, gs in grams
    ])
    doc = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("t"))
    # most texts have none of the words without which no passage can reach the threshold
    doc = doc.withColumn("t", F.when(F.regexp_like(F.lower("t"), F.lit("|".join(anchors(templates, threshold)))), F.col("t")).otherwise(""))
    pairs = lambda w: F.transform(_upto(F.size(w) - 1), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))
    doc = doc.withColumn("b", _let(_words(F.col("t")), pairs)).drop("t")
    # a text that lacks too many of a template's bigrams has no passage that reaches the threshold
    enough = lambda d: F.filter(each, lambda t: (F.size(d) >= t["low"]) & (F.size(F.array_intersect(d, t["g"])) >= t["low"]))
    doc = doc.withColumn("c", _let(F.array_intersect("b", known), enough))
    b = F.col("b")
    search = _let(_neighbours(b), lambda near: F.flatten(F.transform("c", lambda t: _windows(b, near, t, threshold))))
    doc = doc.withColumn("w", F.when(F.size("c") > 0, search).otherwise(F.array().cast("array<struct<score:int,d:double,name:string,start:int,end:int>>"))).drop("b", "c")
    doc = doc.withColumn("p", _places(F.col("w"), max(4 * bounds(len(gs), threshold)[1] for _, gs in grams) + 2))
    best = F.array_min(F.transform("p", lambda p: F.struct(p["d"].alias("d"), p["name"].alias("name"))))
    return doc.select(
        "doc_id", F.array_sort(F.array_distinct(F.transform("w", lambda w: w["name"]))).alias("licenses"),
        best["name"].alias("best_license"), (-best["d"]).alias("best_dice"), F.size("p").cast("long").alias("n_passages"),
    )


def oracle() -> str:
    """The query op10_license_scans for DuckDB, over documents: every window from every bigram that a template holds."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    grams = [(name, sorted(bigrams(t))) for name, t in TEMPLATES]
    rows = ", ".join(f"({k}, {quote(name)}, {len(gs)}, {bounds(len(gs), THRESHOLD)[0]}, {bounds(len(gs), THRESHOLD)[1]}, [{', '.join(map(quote, gs))}])" for k, (name, gs) in enumerate(grams))
    return f"""
with q(k, name, size, low, high, g) as (values {rows}),
d as (select doc_id, row_number() over () r, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') w from documents),
b as (select r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) b from d where len(w) > 1),
c as (select r, k, name, size, high, g, b from b, q where len(list_intersect(b, g)) >= low),
placed as (select r, unnest(b) gram, unnest(range(len(b))) i, len(b) n from b where r in (select r from c)),
near as (select r, gram, i, n, coalesce(lag(i) over same, -1) prev, coalesce(lead(i) over same, n) follow from placed window same as (partition by r, gram order by i)),
ends as (
  select c.r, c.k, c.name, c.size, c.high, s.i start, e.i last,
         sum(case when e.prev < s.i then 1 else 0 end) over upto n, sum(case when e.prev < s.i and list_contains(c.g, e.gram) then 1 else 0 end) over upto same
  from c join near s on s.r = c.r and list_contains(c.g, s.gram) join near e on e.r = c.r and e.i between s.i and s.follow - 1
  window upto as (partition by c.r, c.k, s.i order by e.i)),
best as (
  select r, name, start, arg_min({{'score': n + size - 3 * same, 'd': -d, 'name': name, 'start': start, 'last': last}}, (-d, last)) x
  from (select *, 2 * same / (n + size) d from ends where n <= high) where d >= {THRESHOLD} group by r, k, name, start),
p as (
  select r, list_sort(list_distinct(list(x.name))) names,
         list_reduce(list_transform(list_sort(list(x)), lambda y: [y]), lambda got, y: case when len(list_filter(got, lambda z: z.start <= y[1].last + 1 and y[1].start <= z.last + 1)) > 0 then got else got || y end) kept
  from best group by r)
select doc_id, coalesce(array_to_string(names, ','), '') licenses, list_sort(list_transform(kept, lambda z: {{'d': z.d, 'name': z.name}}))[1].name best_license,
       -list_sort(list_transform(kept, lambda z: {{'d': z.d, 'name': z.name}}))[1].d best_dice, coalesce(len(kept), 0) n_passages
from d left join p on d.r = p.r"""
