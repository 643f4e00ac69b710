"""8. Licence scans by sentence rules.

A text is cut into units at sentence ends and blank lines, a unit into its lines. Each line, and each run of
lines up to the unit's end (a sentence that is wrapped, be it below a title or a copyright line), and each
line up to its first opening parenthesis, is normalised (lower case, runs of other characters than a-z and 0-9
become one space) and looked up among known licence sentences. What follows "SPDX-License-Identifier:" on a line is an
expression: each licence in it (joined by AND, OR, WITH an exception, in parentheses, with ``+`` for later versions)
is an identifier of its own, after those of the sentences; exceptions add none. A blank line starts no sentence. The identifiers found, in order of the text, are matched against ordered licence
rules: a rule fits where its identifiers follow one another in that sequence. Where a longer rule fits over
the whole place of a shorter one, only the longer counts (three BSD clauses are not also two). A licence that
is named twice is told once; licences come in order of name.

Everything happens inside the row: no shuffle, no join. Only texts with one of the anchor words are cut;
every rule has a sentence that holds one of them (checked when the module loads), so none is missed. A run
of more lines than the longest known sentence has words can't be one and isn't looked up, nor a line that doesn't start
with a known sentence's first word.

Defined results: null, empty and blank texts have no licence. One row per input row, repeated rows alike.
Very long texts are taken whole. Only id and text are read, whatever other columns there are. Empty tables
give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm import common as C

#: Known licence sentences by identifier.
SENTENCES = {
    "gpl-3-later": "either version 3 of the License, or (at your option) any later version",
    "agpl-line": "Licensed under the GNU Affero General Public License v3.0",
    "agpl-under": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "apache-asf-line": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")",
    "apache-asf-notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "apache-line-2": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "artistic-line": "Licensed under the Artistic License 2.0",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-line": "Licensed under the BSD License",
    "bsd-line-2": "Licensed under the BSD 2-Clause License",
    "bsd-line-3": "Licensed under the BSD 3-Clause License",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "bsl-line": "Distributed under the Boost Software License, Version 1.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-2": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "This work is dedicated to the public domain under the CC0 1.0 license",
    "cddl-line": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-2-later": "either version 2 of the License, or (at your option) any later version",
    "gpl-2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-2-version": "version 2 of the License",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3-line-2": "Licensed under the GNU General Public License v3.0",
    "gpl-3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl-under": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-2-under": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "lgpl-21-later": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-under": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-line": "Released under the MIT License",
    "mit-line-2": "Licensed under the MIT License",
    "mit-name": "The MIT License",
    "mit-name-2": "MIT License",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mpl-1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "zero-bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
#: Licences that an expression after "SPDX-License-Identifier:" may name.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
]
#: How an expression names them: also without "-only", or with "+" for "-or-later"; other licences' "+" adds nothing.
_NAMES = {n.lower(): f"spdx/{x}" for x in SPDX for n in (x, f"{x}+", x.removesuffix("-only"), x.replace("-or-later", "+"))}
#: Licences by the identifiers that follow one another.
RULES = [
    ("0BSD", ["zero-bsd"]),
    ("AGPL-3.0", ["agpl-line"]), ("AGPL-3.0-or-later", ["agpl-under", "gpl-3-later"]),
    ("Apache-2.0", ["apache-line"]), ("Apache-2.0", ["apache-line-2"]), ("Apache-2.0", ["apache-line-2", "apache-comply"]), ("Apache-2.0", ["apache-line-2", "apache-comply", "apache-copy"]),
    ("Artistic-2.0", ["artistic-line"]),
    ("BSD", ["bsd-line"]), ("BSD-2-Clause", ["bsd-line-2"]), ("BSD-3-Clause", ["bsd-line-3"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSL-1.0", ["bsl-line"]), ("BSL-1.0", ["bsl-grant"]),
    ("CC-BY-4.0", ["cc-by"]), ("CC-BY-4.0", ["cc-by-2"]), ("CC-BY-NC-4.0", ["cc-by-nc"]), ("CC-BY-NC-4.0", ["cc-by-nc-2"]), ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]), ("CC-BY-SA-4.0", ["cc-by-sa"]), ("CC-BY-SA-4.0", ["cc-by-sa-2"]), ("CC0-1.0", ["cc0"]),
    ("CDDL-1.0", ["cddl-line"]), ("EPL-1.0", ["epl-1"]), ("EPL-2.0", ["epl-2"]),
    ("GPL-2.0-only", ["gpl-2-only"]), ("GPL-2.0-only", ["gpl-under", "gpl-2-version"]), ("GPL-2.0-or-later", ["gpl-under", "gpl-2-later"]),
    ("GPL-3.0", ["gpl-3-line"]), ("GPL-3.0", ["gpl-3-line-2"]), ("GPL-3.0-only", ["gpl-3-only"]), ("GPL-3.0-or-later", ["gpl-under", "gpl-3-later"]),
    ("ISC", ["isc-grant"]),
    ("LGPL-2.0-or-later", ["lgpl-2-under", "gpl-2-later"]), ("LGPL-2.1-or-later", ["lgpl-under", "lgpl-21-later"]), ("LGPL-3.0-or-later", ["lgpl-under", "gpl-3-later"]),
    ("MIT", ["mit-line"]), ("MIT", ["mit-line-2"]), ("MIT", ["mit-grant"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice"]), ("MIT", ["mit-name-2", "mit-grant", "mit-notice"]),
    ("MPL-1.1", ["mpl-1"]), ("MPL-2.0", ["mpl-2"]),
    ("Unlicense", ["unlicense-free"]), ("Unlicense", ["unlicense-free", "unlicense-grant"]),
    ("WTFPL", ["wtfpl"]), ("Zlib", ["zlib-grant"]),
]
RULES += [("Apache-2.0", ["apache-asf"]), ("Apache-2.0", ["apache-asf", "apache-asf-notice", "apache-asf-line"]), ("Apache-2.0", ["apache-asf", "apache-asf-notice", "apache-asf-line", "apache-comply"])]
#: Words of which every rule holds one.
ANCHORS = ["licen", "permission", "copyright", "redistribut", "public domain"]

_SPDX = r"spdx-license-identifier:[ \t]*([^\n]*)"
_UNITS, _LINES = r"[.!?;:]+(?=\s|$)|\n[ \t\r]*\n", r"\n"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


# a sentence ends at punctuation before white space, so its own inner full stops ("v. 2.0") cut it like a text
def _parts(sentence: str) -> list[str]:
    return [p for p in map(normal, re.split(r"[.!?;:]+(?=\s|$)", sentence)) if p]


def known(sentences: dict[str, str]) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Normal forms with their identifiers, and the identifiers that stand for each sentence."""
    ids: dict[str, str] = {}
    return ids, {name: [ids.setdefault(p, f"{name}/{i}") for i, p in enumerate(_parts(s))] for name, s in sentences.items()}


def _check(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
    if missing := [r for r in rules if not any(a in normal(sentences[s]) for s in r[1] for a in ANCHORS)]:
        raise ValueError(f"no anchor word in {missing}")


_check(SENTENCES, RULES)


def _sequence(text: Column, forms: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    pairs = F.create_map(*[F.lit(x) for p in forms.items() for x in p])
    most = max(len(x.split()) for x in forms)
    starts = rf"^[^a-z0-9]*(?:{'|'.join(sorted({x.split()[0] for x in forms}))})(?![a-z0-9])"
    look = lambda s: F.try_element_at(pairs, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))

    def of_lines(lines: Column) -> Column:
        def at(line: Column, i: Column) -> Column:
            rest = F.when((F.size(lines) - i > 1) & (F.size(lines) - i <= most), look(F.array_join(F.slice(lines, i + 1, F.size(lines)), " ")))
            short = F.when(F.contains(line, F.lit("(")), look(F.substring_index(line, "(", 1)))
            return F.when(line.rlike(starts), F.coalesce(look(line), rest, short))

        return F.transform(lines, at)

    # units are cut into lines first: an expression inside the inner function would be evaluated again for each line
    units = F.transform(F.split(F.lower(text), _UNITS, -1), lambda unit: F.split(unit, _LINES, -1))
    return F.array_compact(F.flatten(F.transform(units, of_lines)))


def _expressions(text: Column) -> Column:
    """Identifiers of the licences in the expressions of a text, in order."""
    pairs = F.create_map(*[F.lit(x) for p in _NAMES.items() for x in p])
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_SPDX), F.lit(1)), lambda e: F.split(F.regexp_replace(e, r"\bwith\s+\S+", " "), r"[^a-z0-9.+-]+", -1))
    return F.array_compact(F.transform(F.flatten(words), lambda w: F.try_element_at(pairs, w)))


def _fits(ids: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Where each rule fits: (first, last, name). ``rules`` give identifiers."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)))

    def of(name: str, want: list[str]) -> Column:
        wanted = F.array(*[F.lit(w) for w in want])
        places = F.filter(starts, lambda i: F.slice(ids, i, len(want)) == wanted)
        return F.when(F.array_contains(ids, want[0]), F.transform(places, lambda i: F.struct(i.alias("a"), (i + (len(want) - 1)).alias("z"), F.lit(name).alias("name"))))

    return F.flatten(F.array_compact(F.array(*[of(n, w) for n, w in rules])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per input row: id, n_licenses, licenses (names joined by a comma), sentence_ids (joined by a space)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    _check(sentences, rules)
    forms, parts = known(sentences)
    wanted = [(name, [i for s in rule for i in parts[s]]) for name, rule in rules] + [(x, [f"spdx/{x}"]) for x in SPDX]
    df = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text"))
    none = F.array().cast("array<string>")
    low = F.lower("text")
    ids = F.concat(_sequence(F.col("text"), forms), F.when(F.contains(low, F.lit("spdx-license-identifier:")), _expressions(F.col("text"))).otherwise(none))
    df = df.withColumn("ids", F.when(low.rlike("|".join(ANCHORS)), ids).otherwise(none)).drop("text")
    df = df.withColumn("fits", F.when(F.size("ids") > 0, _fits(F.col("ids"), wanted)))
    inside = lambda x, y: (y["a"] <= x["a"]) & (y["z"] >= x["z"]) & (y["z"] - y["a"] > x["z"] - x["a"])
    left = F.filter("fits", lambda x: ~F.exists("fits", lambda y: inside(x, y)))
    df = df.select("doc_id", "ids", F.coalesce(F.array_sort(F.array_distinct(F.transform(left, lambda x: x["name"]))), none).alias("found"))
    return df.select(F.col("doc_id").alias(id_col), F.size("found").cast("long").alias("n_licenses"), F.array_join("found", ",").alias("licenses"), F.array_join("ids", " ").alias("sentence_ids"))
