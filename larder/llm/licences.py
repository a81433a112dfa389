"""Licence scans: passages of a text compared with licence templates.

Passages are the lines of a text, its paragraphs (between blank lines) and the whole text. Passage and template are normalised
(letters and digits in lower case, all else single spaces) and compared by Dice's coefficient over the sets of their word
bigrams, twice the common ones over the sum of both sizes. With the limit t, only a template with between t / (2 - t) and (2 - t) / t
times as many bigrams as the passage can reach it: most passages are too long or too short for all templates and are dropped
before anything is compared. The others must have one of the bigrams of which a template can't miss all: any third of them
and one more will do for t = 0.8. What is left is compared with the templates that its size allows.

All steps are SQL functions over the row itself: no shuffle, no Python.

Defined results: a null or empty text has no licence; a text of any length is compared passage by passage, and as a whole; every input row gives one output row, repeated ids included; of templates
with one coefficient the first by name wins; an empty table gives an empty result; other columns pass through
untouched, except those with the names of the result's own columns, which are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

# The notices as their licences word them.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
    "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "This work has been dedicated to the public domain under the Creative Commons CC0 1.0 Universal license.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_OTHER = "[^\\p{L}\\p{N}]+"


def normalised(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needed(found: list[str], limit: float) -> list[str]:
    """Bigrams of which a passage that reaches ``limit`` has one at least: the longest ones."""
    most_missed = math.floor(len(found) * (1 - limit / (2 - limit)) + 1e-9)
    return sorted(found, key=lambda b: (-len(b), b))[: most_missed + 1]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def scan_licences(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, limit: float = 0.8, text: str = "text"
) -> DataFrame:
    """``docs`` with ``licence`` (the best template's name), ``dice``, its coefficient, and ``licences``, all that reach the limit."""
    sets = {name: bigrams(normalised(templates[name])) for name in sorted(templates)}
    low, high = limit / (2 - limit), (2 - limit) / limit
    # a set of n bigrams takes n + 1 words at least; repeated bigrams take more words, not fewer
    fewest = math.ceil(min(map(len, sets.values())) * low - 1e-9)
    most = math.floor(max(map(len, sets.values())) * high + 1e-9)
    keys = _strings(sorted({key for found in sets.values() for key in needed(found, limit)}))
    known = F.array(*[F.struct(F.lit(name).alias("name"), _strings(found).alias("bigrams")) for name, found in sets.items()])

    def words(passage: Column) -> Column:
        plain = F.btrim(F.regexp_replace(F.lower(passage), _OTHER, " "))
        return F.split(plain, " ")

    def pairs(found: Column) -> Column:
        return F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.size(found) - 1),
                lambda i: F.concat(F.get(found, i - 1), F.lit(" "), F.get(found, i)),
            )
        )

    body = F.coalesce(F.col(text), F.lit(""))
    passages = F.array_distinct(F.concat(F.split(body, "\n"), F.split(body, "\n[ \t\r]*\n\\s*"), F.array(body)))
    # a passage of w words has more than w characters; longer ones than any template allows need no splitting
    sized = F.filter(passages, lambda p: F.length(p) > fewest)
    split = F.filter(F.transform(sized, words), lambda w: F.size(w) > fewest)
    grouped = F.filter(
        F.transform(split, pairs),
        lambda b: (F.size(b) >= fewest) & (F.size(b) <= most) & F.arrays_overlap(b, keys),
    )

    def against(found: Column) -> Column:
        fits = F.filter(
            known,
            lambda t: (F.size(t["bigrams"]) >= F.size(found) * F.lit(low) - 1e-9)
            & (F.size(t["bigrams"]) <= F.size(found) * F.lit(high) + 1e-9),
        )
        scored = F.transform(
            fits,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(t["bigrams"], found)) / (F.size(t["bigrams"]) + F.size(found))).alias("dice"),
                t["name"].alias("name"),
            ),
        )
        return F.filter(scored, lambda s: s["dice"] >= limit)

    found = docs.select(F.struct(*docs.columns).alias("_row"), F.flatten(F.transform(grouped, against)).alias("_hits"))
    best = F.array_max(F.transform("_hits", lambda s: s["dice"]))
    first = F.array_min(F.transform(F.filter("_hits", lambda s: s["dice"] == F.col("_best")), lambda s: s["name"]))
    made = {
        "licence": first,
        "dice": F.col("_best"),
        "licences": F.array_sort(F.array_distinct(F.transform("_hits", lambda s: s["name"]))),
    }
    kept = [F.col(f"_row.`{name}`").alias(name) for name in docs.columns if name not in made]
    return found.withColumn("_best", best).select(*kept, *[column.alias(name) for name, column in made.items()])
