"""License notices in documents, by Dice coefficient over word bigrams.

A text is normalised (A-Z lowered, every run of other characters than a-z, 0-9
and line ends made one space) and read in units: every line, and every paragraph
of several lines, so wrapped notices are met too. A unit's set of word bigrams is
compared with a template's by ``2 x common / (one + other)``. A template of n
bigrams can reach ``DICE`` only in units of ``n x DICE / (2 - DICE)`` to
``n x (2 - DICE) / DICE`` bigrams; other pairs are pruned before any comparison.

A notice that shares its line or paragraph with other words is met too: with the
units' own notices taken out, the runs of words that begin and end with one of a
template's bigrams and have at most as many bigrams as its bound are compared with
it, over the whole text. Of runs that count and overlap the best stands. Every run and every unit that
counts holds one of each of its template's ``needed_words``, so only texts that do are normalised and
read in units, and only those that do as whole words are read in runs. (The SQL twin reads the units alone.)

Everything is one projection of DataFrame functions: no shuffle, no join, no
Python, whatever the sizes or copies in the table. Null or empty text: no notice;
repeated rows each get their result; extra columns are ignored. A unit counts
for its best template, ties for the greater name.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8
#: Wording of public licence notices.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return "".join(c if c in LOWER + "0123456789" else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as texts are."""
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(bigrams: int) -> tuple[float, float]:
    return bigrams * DICE / (2 - DICE), bigrams * (2 - DICE) / DICE


#: Template words that most texts hold.
COMMON = frozenset("a all an and any are as at by conditions copy do free from general in into is it may mit modify no of on or other permit public see software source terms that the this to under use with work version you your".split())


def needed_words(text: str) -> list[list[str]]:
    """Lists of words, of each of which any run that reaches ``DICE`` holds one: the bigrams without them are too few."""
    bigrams = [set(b.split()) for b in template_bigrams(text)]
    least, used, lists = size_bounds(len(bigrams))[0], set(), []
    while True:
        chosen: set[str] = set()
        while len(left := [b for b in bigrams if not b & chosen]) >= least:
            words = {w for b in left for w in b} - used
            if not words:
                return lists
            chosen.add(max(sorted(words), key=lambda w: (w not in COMMON, sum(w in b for b in left), len(w))))
        lists.append(sorted(chosen))
        used |= chosen


def _templates() -> Column:
    rows = []
    for name, text in TEMPLATES:
        bigrams = template_bigrams(text)
        low, high = size_bounds(len(bigrams))
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(int(max(high, (2 - DICE) / DICE * (len(template_words(text)) - 1)))).alias("reach"), F.array(*map(F.lit, bigrams)).alias("bigrams")))
    return F.array(*rows)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def normalised(text: Column) -> Column:
    return F.regexp_replace(lowered(text), r"[^a-z0-9\n]+", " ")


def may_hold(text: Column, around: str = "") -> Column:
    """Whether a text, lowered, holds one of each of some template's ``needed_words``, as one with a notice does.

    A unit that counts shares as many bigrams with its template as a run does. ``around`` is what stands on both sides
    of a word; with nothing there, parts of words are let through as well. Most texts hold no word of any first list, so
    these are looked for first, each once.
    """
    one = lambda words: reduce(or_, [text.contains(f"{around}{w}{around}") for w in words])
    lists = [needed_words(t) for _, t in TEMPLATES]
    first = {f"{around}{w}{around}" for of_template in lists for w in of_template[0]}
    least = sorted(w for w in first if not any(v != w and v in w for v in first))
    return reduce(or_, [text.contains(w) for w in least]) & reduce(or_, [reduce(and_, [one(words) for words in of_template]) for of_template in lists])


def pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def words_of(unit: Column) -> Column:
    return F.filter(F.split(unit, r"[ \n]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_bigrams(plain: Column) -> Column:
    """Bigram sets of a normalised text's units that are large enough for the least template."""
    paragraphs = F.filter(F.split(plain, r"\n ?\n"), lambda p: p.contains("\n"))
    units = F.concat(F.split(plain, r"\n"), paragraphs)
    words = F.transform(units, words_of)
    least = min(size_bounds(len(template_bigrams(t)))[0] for _, t in TEMPLATES)
    words = F.filter(words, lambda w: F.size(w) - 1 >= F.lit(least))
    return F.transform(words, lambda w: F.array_distinct(pairs(w)))


def score(g: Column, t: Column, *more: str) -> Column:
    common = F.size(F.array_intersect(g, t["bigrams"]))
    return F.struct((common * 2.0 / (F.size(g) + F.size(t["bigrams"]))).alias("dice"), t["name"].alias("name"), *(t[m].alias(m) for m in more))


def best_match(g: Column, *more: str) -> Column:
    candidates = F.filter(_templates(), lambda t: F.size(g).between(t["low"], t["high"]))
    return F.array_max(F.filter(F.transform(candidates, lambda t: score(g, t, *more)), lambda m: m["dice"] >= DICE))


def _rest(plain: Column) -> Column:
    """A normalised text with signs in place of the words that units which count share with their template."""
    def without(u: Column, whole: Column) -> Column:
        match = let(words_of(whole), lambda w: F.when(F.size(w) > 1, best_match(F.array_distinct(pairs(w)), "bigrams")))
        return let(match, lambda m: F.when(m.isNull(), u).otherwise(let(words_of(u), lambda w: signed(w, m))))

    def signed(w: Column, match: Column) -> Column:
        both = lambda o, x, i: F.array_contains(o, F.concat_ws(" ", x, F.get(w, i + 1))) | F.array_contains(o, F.concat_ws(" ", F.get(w, i - 1), x))
        return F.array_join(F.transform(w, lambda x, i: F.when(both(match["bigrams"], x, i), F.lit("#")).otherwise(x)), " ")

    lines = lambda p: F.array_join(F.transform(F.split(p, r"\n"), lambda u: without(u, u)), "\n")
    paragraph = lambda p: F.when(p.contains("\n"), let(lines(p), lambda u: without(u, p))).otherwise(lines(p))
    return F.array_join(F.transform(F.split(plain, r"\n ?\n"), paragraph), "\n")


def _runs(g: Column, held: Column, t: Column) -> Column:
    """Runs of the bigrams ``g`` that count for the template; ``held`` are the places and texts of all templates' bigrams."""
    def ends(near: Column) -> Column:
        def run(last: Column, k: Column) -> Column:
            common = F.size(F.array_distinct(F.slice(near, F.lit(1), k + 1)["x"]))
            size = F.size(F.array_distinct(F.slice(g, near[0]["i"] + 1, last["i"] - near[0]["i"] + 1)))
            dice = common * 2.0 / (size + F.size(t["bigrams"]))
            return F.struct(dice.alias("dice"), t["name"].alias("name"), (-near[0]["i"]).alias("back"), last["i"].alias("last"))

        enough = F.size(F.array_distinct(near["x"])) >= t["low"]
        return F.when(enough, F.array_max(F.transform(near, run)))

    def starts(own: Column) -> Column:
        near = lambda h, j: F.filter(F.slice(own, j + 1, t["reach"]), lambda o: o["i"] - h["i"] < t["reach"])
        best = F.transform(own, lambda h, j: let(near(h, j), ends))
        return F.filter(best, lambda m: m["dice"] >= DICE)

    return let(F.filter(held, lambda h: F.array_contains(t["bigrams"], h["x"])), starts)


def runs(plain: Column) -> Column:
    """(dice, name) of the notices of a normalised text that are no unit of their own."""
    every = sorted({b for _, text in TEMPLATES for b in template_bigrams(text)})
    held = lambda g: F.filter(F.transform(g, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: h["x"].isin(every))
    kind = "array<struct<dice:double,name:string,back:int,last:int>>"
    over = lambda a, m: (-a["back"] <= m["last"]) & (-m["back"] <= a["last"])
    take = lambda kept, m: F.when(F.exists(kept, lambda a: over(a, m)), kept).otherwise(F.concat(kept, F.array(m)))

    def counted(g: Column) -> Column:
        found = let(held(g), lambda h: F.flatten(F.transform(_templates(), lambda t: _runs(g, h, t)))).cast(kind)
        best = F.aggregate(F.reverse(F.array_sort(found)), F.array().cast(kind), take)
        return F.transform(best, lambda m: F.struct(m["dice"].alias("dice"), m["name"].alias("name")))

    padded = F.concat(F.lit(" "), F.translate(plain, "\n", " "), F.lit(" "))
    some = let(padded, lambda p: may_hold(p, " "))
    words = lambda r: let(words_of(r), lambda w: F.when(F.size(w) > 1, let(pairs(w), counted)))
    return F.coalesce(F.when(some, words(_rest(plain))), F.array().cast("array<struct<dice:double,name:string>>"))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_notices, best_license, best_dice, licenses`` per row."""
    def notices(plain: Column) -> Column:
        units = F.filter(F.transform(unit_bigrams(plain), lambda g: best_match(g)), lambda m: m.isNotNull())
        return F.concat(units, runs(plain))

    low = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("low"))
    none = F.array().cast("array<struct<dice:double,name:string>>")
    found = low.select("doc_id", F.when(may_hold(F.col("low")), let(normalised(F.col("low")), notices)).otherwise(none).alias("found"))
    best = found.select("doc_id", F.size("found").alias("n_notices"), F.array_max("found").alias("best"), "found")
    names = F.array_sort(F.array_distinct(F.col("found")["name"]))
    return best.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_notices").cast("bigint").alias("n_notices"),
        F.col("best")["name"].alias("best_license"), F.col("best")["dice"].alias("best_dice"), F.array_join(names, ",").alias("licenses"))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`scanned` over ``documents``."""
    rows = []
    for name, text in TEMPLATES:
        bigrams = ", ".join(f"'{b}'" for b in template_bigrams(text))
        rows.append(f"SELECT '{name}' AS name, [{bigrams}] AS bigrams")
    templates = "\nUNION ALL ".join(rows)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g') AS plain FROM documents),
u AS (SELECT r, unnest(list_concat(string_split(plain, chr(10)),
        list_filter(string_split_regex(plain, '\n ?\n'), lambda p: contains(p, chr(10))))) AS unit FROM d),
w AS (SELECT r, row_number() OVER () AS k, list_filter(string_split_regex(unit, '[ \n]+'), lambda x: x <> '') AS words FROM u),
g AS (SELECT r, k, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams
      FROM w WHERE len(words) > 1),
t AS ({templates}),
m AS (SELECT r, k, t.name, len(list_intersect(g.bigrams, t.bigrams)) * CAST(2.0 AS DOUBLE) / (len(g.bigrams) + len(t.bigrams)) AS dice
      FROM g JOIN t ON len(g.bigrams) BETWEEN len(t.bigrams) * {DICE} / (2 - {DICE}) AND len(t.bigrams) * (2 - {DICE}) / {DICE}),
b AS (SELECT r, max({{'dice': dice, 'name': name}}) AS best FROM m WHERE dice >= {DICE} GROUP BY r, k),
h AS (SELECT r, count(*) AS n, max(best) AS best, string_agg(DISTINCT best.name, ',' ORDER BY best.name) AS names FROM b GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_notices, best.name AS best_license, best.dice AS best_dice, coalesce(names, '') AS licenses
FROM d LEFT JOIN h USING (r)"""
