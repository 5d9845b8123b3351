"""Licence scans: normalised text compared with licence templates by Dice coefficient over word bigrams.

A text is read as passages (its lines, its sentences and the whole of it) and as windows: runs of consecutive words of any
length, across line ends and within sentences. Either is lower-cased, cut into runs of letters and digits, and stands as the set
of its word bigrams. Templates whose number of bigrams cannot reach the wanted coefficient with that of a passage or window
are passed over: `2 min(a, b) / (a + b) >= least` bounds a by b. A window that is near a template stays near without
bigrams at its ends that the template lacks, so only windows between two of the template's bigrams are compared.

What is near a template shares so many bigrams with it that it cannot lack all of a chosen few (`signal_bigrams`): a text
that has none of them is passed over before it is cut up. All steps are column expressions over one row, so
the scan is a single map without a shuffle, and no hot licence, source or copy gathers anywhere.

Result: the template nearest to any passage or window (license, dice), all licences that something is near to, in the order
of the templates (licenses, joined by commas), and the number of near passages (n_passages). Defined results: null, empty and
one-word texts, and texts with nothing near any template, have license null, dice 0 and no licenses; of equally near
templates the first in the list counts; copies and repeated rows are scanned one by one. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
# Letters from which a word alone is looked for.
LONG_WORD = 6

# The sentences by which public licences are declared or granted, as their publishers word them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ),
    (
        "MIT",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "BSD-2-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    ("proprietary", "All rights reserved"),
]


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def passages(text: Column) -> Column:
    """Lines, sentences and the whole of a text, each once."""
    lines = F.split(text, "\n")
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")
    return F.array_distinct(F.concat(F.array(text), lines, sentences))


def bigrams(passage: Column) -> Column:
    """The set of word bigrams of a passage; empty under two words."""
    return F.array_distinct(bigram_list(passage))


def bigram_list(passage: Column) -> Column:
    """The word bigrams of a passage in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = F.transform(
        F.array(words),
        lambda w: F.zip_with(
            F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)
        ),
    )
    return F.element_at(pairs, 1)


def fewest_shared(count: int, least: float) -> int:
    """How many of a template's bigrams anything near to it has at least."""
    return math.ceil(least * (sizes_within(count, least)[0] + count) / 2 - 1e-9)


def signal_bigrams(templates: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Bigrams of which anything near one of the templates has at least one.

    Of a template's bigrams more are taken than anything near may lack, those with long words first.
    """
    found: set[str] = set()
    for _, pairs in templates:
        by_word = sorted(pairs, key=lambda pair: (-max(map(len, pair.split())), pair))
        found |= set(by_word[: len(pairs) - fewest_shared(len(pairs), least) + 1])
    return sorted(found)


def has_signal(lowered: Column, pairs: list[str]) -> Column:
    """Whether a lower-cased text may have one of the bigrams: it has a long word of theirs, or the two words in a row."""
    long_words = {max(pair.split(), key=len) for pair in pairs if max(map(len, pair.split())) >= LONG_WORD}
    tests = [F.contains(lowered, F.lit(w)) for w in sorted(long_words) if not any(o != w and o in w for o in long_words)]
    for pair in pairs:
        one, two = pair.split()
        if max(len(one), len(two)) < LONG_WORD:
            in_a_row = F.rlike(lowered, F.lit(rf"{one}[^\p{{L}}\p{{N}}]+{two}"))
            tests.append(F.contains(lowered, F.lit(one)) & F.contains(lowered, F.lit(two)) & in_a_row)
    return reduce(Column.__or__, tests)


def best_window(found: Column, pairs: list[str], least: float) -> Column:
    """The largest coefficient of a window of the bigrams found with a template; 0 if none can reach `least`."""
    count, (low, high) = len(pairs), sizes_within(len(pairs), least)
    wanted = F.array(*map(F.lit, pairs))

    def held(at: Column) -> Column:
        return F.coalesce(F.array_contains(wanted, F.get(found, at - 1)), F.lit(False))

    def dice(window: Column) -> Column:
        own = F.array_distinct(window)
        return 2.0 * F.size(F.array_intersect(own, wanted)) / (F.size(own) + count)

    starts = F.filter(F.sequence(F.lit(1), F.size(found)), held)
    windows = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(F.filter(F.sequence(i + low - 1, i + high - 1), held), lambda j: dice(F.slice(found, i, j - i + 1))),
        )
    )
    near = F.size(F.array_intersect(found, wanted)) >= fewest_shared(count, least)
    return F.coalesce(F.when(near, F.array_max(windows)), F.lit(0.0))


def sizes_within(count: int, least: float) -> tuple[int, int]:
    """The numbers of bigrams that a passage may have to reach `least` with a template of `count`."""
    return math.ceil(least * count / (2 - least) - 1e-9), math.floor((2 - least) * count / least + 1e-9)


def scan(docs: DataFrame, least: float = LEAST, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, license, dice (6 digits), licenses and n_passages of every document."""
    known = [(name, template_bigrams(text)) for name, text in templates or TEMPLATES]
    bounds = [sizes_within(len(pairs), least) for _, pairs in known]
    fewest, most = min(low for low, _ in bounds), max(high for _, high in bounds)
    signal = has_signal(F.col("_lowered"), signal_bigrams(known, least))
    lowered = docs.select("doc_id", "text", F.lower("text").alias("_lowered"))
    signalled = lowered.select("doc_id", F.when(signal, F.col("text")).alias("text"))
    # Sets outside every template's bounds end here, before any is compared.
    sets = F.filter(F.transform(passages(F.col("text")), bigrams), lambda s: F.size(s).between(fewest, most))

    def nearest(found: Column) -> Column:
        near = [
            F.when(
                F.size(found).between(low, high),
                2.0 * F.size(F.array_intersect(found, F.array(*map(F.lit, pairs)))) / (F.size(found) + len(pairs)),
            ).otherwise(0.0)
            for (_, pairs), (low, high) in zip(known, bounds)
        ]
        return F.array(*near)

    spoken = F.col("text").isNotNull()
    cut = signalled.select(
        "doc_id",
        F.when(spoken, F.filter(F.transform(sets, nearest), lambda d: F.array_max(d) >= least)).alias("near"),
        F.when(spoken, bigram_list(F.col("text"))).alias("pairs"),
    )
    windows = F.array(*[best_window(F.col("pairs"), pairs, least) for _, pairs in known])
    compared = cut.select("doc_id", "near", F.when(F.col("pairs").isNotNull(), windows).alias("windows"))
    # For each template the nearest passage or window.
    highest = F.aggregate("near", F.col("windows"), lambda held, one: F.zip_with(held, one, lambda a, b: F.greatest(a, b)))
    scanned = compared.select("doc_id", F.size("near").alias("n"), highest.alias("dice"))
    names = F.array(*[F.lit(name) for name, _ in known])
    reached = F.transform(F.arrays_zip(names.alias("name"), F.col("dice").alias("dice")), lambda t: F.when(t["dice"] >= least, t["name"]))
    best = F.array_max("dice")
    found = F.coalesce(best >= least, F.lit(False))
    return scanned.select(
        "doc_id",
        F.when(found, F.element_at(names, F.array_position("dice", best).cast("int"))).alias("license"),
        F.when(found, F.round(best, 6)).otherwise(0.0).alias("dice"),
        F.when(found, F.array_join(F.array_distinct(F.array_compact(reached)), ",")).otherwise("").alias("licenses"),
        F.when(found, F.greatest(F.col("n"), F.lit(0))).otherwise(0).cast("long").alias("n_passages"),
    )


def _duck_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql(least: float = LEAST) -> str:
    """The scan of `documents` as DuckDB SQL: every passage and every window with every template."""
    known = [(name, template_bigrams(text)) for name, text in TEMPLATES]
    rows = ",\n".join(
        f"({at}, '{name}', {_duck_list(pairs)}, {sizes_within(len(pairs), least)[0]}, {sizes_within(len(pairs), least)[1]})"
        for at, (name, pairs) in enumerate(known)
    )
    normal = "string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
        WITH templates(place, name, pairs, low, high) AS (VALUES {rows}),
        numbered AS (SELECT row_number() OVER () AS line, doc_id, coalesce(text, '') AS text FROM documents),
        passages AS (
            SELECT line, unnest(list_distinct(list_concat([text], string_split(text, chr(10)),
                string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))))) AS passage
            FROM numbered
        ), words AS (
            SELECT line, passage, {normal.format("passage")} AS w FROM passages
        ), sets AS (
            SELECT line, passage,
                list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs
            FROM words WHERE len(w) >= 2
        ), near AS (
            SELECT line, passage, place, name, 2.0 * len(list_intersect(s.pairs, t.pairs)) / (len(s.pairs) + len(t.pairs)) AS dice
            FROM sets s JOIN templates t ON len(s.pairs) BETWEEN t.low AND t.high
        ), whole AS (
            SELECT line, {normal.format("text")} AS w FROM numbered
        ), runs AS (
            SELECT line, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM whole WHERE len(w) >= 2
        ), places AS (
            SELECT line, unnest(pairs) AS pair, generate_subscripts(pairs, 1) AS spot FROM runs
        ), template_pairs AS (
            SELECT place, unnest(pairs) AS pair FROM templates
        ), held AS (
            SELECT line, place, spot FROM places JOIN template_pairs USING (pair)
        ), windows AS (
            SELECT a.line, a.place, t.name, t.pairs, list_distinct(r.pairs[a.spot:b.spot]) AS own
            FROM held a JOIN held b ON b.line = a.line AND b.place = a.place
            JOIN templates t ON t.place = a.place AND b.spot - a.spot + 1 BETWEEN t.low AND t.high
            JOIN runs r ON r.line = a.line
        ), reached AS (
            SELECT line, place, name, dice FROM near WHERE dice >= {least}
            UNION ALL
            SELECT line, place, name, dice FROM (
                SELECT line, place, name, 2.0 * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS dice FROM windows
            ) WHERE dice >= {least}
        ), by_name AS (
            SELECT line, name, min(place) AS place FROM reached GROUP BY line, name
        ), listed AS (
            SELECT line, string_agg(name, ',' ORDER BY place) AS licenses FROM by_name GROUP BY line
        ), best AS (
            SELECT line, max(dice) AS dice, arg_max(name, struct_pack(d := dice, p := -place)) AS name FROM reached GROUP BY line
        ), counts AS (
            SELECT line, count(DISTINCT passage) AS n FROM near WHERE dice >= {least} GROUP BY line
        )
        SELECT doc_id, name AS license, round(coalesce(dice, 0.0), 6)::DOUBLE AS dice, coalesce(licenses, '') AS licenses,
            coalesce(n, 0)::BIGINT AS n_passages
        FROM numbered LEFT JOIN best USING (line) LEFT JOIN listed USING (line) LEFT JOIN counts USING (line)
    """
