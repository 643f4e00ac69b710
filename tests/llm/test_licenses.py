import random
import re

from loomquery.llm import licenses as L


def cleaned(s):
    return " ".join(re.findall("[a-z0-9]+", s.lower()))


def brute(text, sentences=L.SENTENCES, rules=L.RULES):
    """Licences by words: every known part found line by line or as the lines up to a unit's end, then the longest fits."""
    names, parts = {}, {}
    for n, s in sentences.items():
        parts[n] = [cleaned(p) for p in re.split(r"[.!?;:]+(?=\s|$)", s) if cleaned(p)]
        names |= dict.fromkeys(parts[n])
    if not re.search("licen|permission|copyright|redistribut|public domain", (text or "").lower()):
        return ""
    found, named = [], []
    for expression in re.findall(r"spdx-license-identifier:[ \t]*([^\n]*)", text.lower()):
        skip = False
        for w in re.findall(r"[a-z0-9.+-]+", expression):
            named += [] if skip else [x for x in L.SPDX if w in (x.lower(), f"{x.lower()}+", x.lower().removesuffix("-only"), x.lower().replace("-or-later", "+"))]
            skip = w == "with"
    for unit in re.split(r"[.!?;:]+(?=\s|$)|\n[ \t\r]*\n", text.lower()):
        lines = unit.split("\n")
        for i, line in enumerate(lines):
            if not cleaned(line):
                continue
            for s in (cleaned(line), cleaned(" ".join(lines[i:])), *([cleaned(line.split("(")[0])] if "(" in line else [])):
                if s in names:
                    found.append(s)
                    break
    fits = []
    for name, rule in rules:
        want = [p for s in rule for p in parts[s]]
        fits += [(i, i + len(want), name) for i in range(len(found)) if found[i : i + len(want)] == want]
    left = [f for f in fits if not any(g[0] <= f[0] and g[1] >= f[1] and g[1] - g[0] > f[1] - f[0] for g in fits)]
    return ",".join(sorted({f[2] for f in left} | set(named)))


def told(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in sorted(L.scan(df, **kw).collect(), key=lambda r: r["doc_id"])]


S = L.SENTENCES
MIT = f"Copyright someone.\n\n{S['mit-grant']}:\n\n{S['mit-notice']}.\n"
BSD = f"{S['bsd-grant']}:\n\n1. {S['bsd-source']}.\n\n2. {S['bsd-binary']}.\n"
BSD3 = BSD + f"\n3. {S['bsd-endorse']}.\n"


def wrapped(text, width):
    out = []
    for paragraph in text.split("\n\n"):
        line = ""
        for w in paragraph.split():
            if len(line) + len(w) > width:
                out.append(line.strip())
                line = ""
            line += " " + w
        out += [line.strip(), ""]
    return "\n".join(out)


def test_scan(spark):
    cases = {
        "words.\nReleased under the MIT License.": "MIT",
        "x ***\nLicensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        MIT: "MIT",
        wrapped(MIT, 60): "MIT",
        S["mit-notice"]: "",
        "We license nothing. Permission denied": "",
        "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!\nReleased under the MIT License.": "Apache-2.0,MIT",
        BSD: "BSD-2-Clause",
        BSD3: "BSD-3-Clause",
        wrapped(BSD3, 70): "BSD-3-Clause",
        BSD3 + "\nAnd also:\n" + BSD: "BSD-2-Clause,BSD-3-Clause",
        "The tool\nCopyright (c) 2020 Someone\n" + wrapped("This program is free software; " + S["gpl-under"] + "; " + S["gpl-2-version"] + ".", 50): "GPL-2.0-only",
        "This program is free software: " + S["gpl-under"] + ", " + S["gpl-3-later"] + ".": "",
        "This program is free software: " + S["gpl-under"] + "; " + S["gpl-3-later"] + ".": "GPL-3.0-or-later",
        wrapped("This library is free software; " + S["lgpl-under"] + "; " + S["lgpl-21-later"] + ".", 72): "LGPL-2.1-or-later",
        "# SPDX-License-Identifier: AGPL-3.0-or-later\nimport this": "AGPL-3.0-or-later",
        "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
        "SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
        "SPDX-License-Identifier: (GPL-2.0 WITH Classpath-exception-2.0) AND (mit OR bsd-3-clause)": "BSD-3-Clause,GPL-2.0-only,MIT",
        "/* SPDX-License-Identifier: LGPL-2.1-or-later */ int main;\nSPDX-License-Identifier: Unknown-1.0\nMIT": "LGPL-2.1-or-later",
        "SPDX-License-Identifier:\nMIT": "",
        "Released under the MIT license (see LICENSE).": "MIT",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements": "Apache-2.0",
        wrapped(S["apache-asf"] + ". " + S["apache-asf-notice"] + ". " + S["apache-asf-line"] + "; " + S["apache-comply"] + ".", 70): "Apache-2.0",
        "MIT\nis a place with a copyright": "",
        S["unlicense-free"] + ".\n\n" + wrapped(S["unlicense-grant"], 65): "Unlicense",
        "": "",
    }
    assert dict(zip(cases, told(spark, list(cases)), strict=True)) == cases
    assert told(spark, [None]) == [""]


def test_matches_brute_force(spark):
    """Random texts of known sentences, titles and other lines in random order, wrapping and case."""
    rng = random.Random(8)
    other = ["SPDX-License-Identifier: MIT AND (GPL-3.0+ OR Zlib WITH x-1.0)", "spdx-license-identifier: Apache-2.0+ or 0bsd", "Licensed under the MIT License (the file)", "Copyright (c) 2019 A. Person", "All rights reserved", "some words", "Title", "", "1", "see https://example.com/a.b?c"]
    texts = []
    for _ in range(250):
        rows = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                rows += [S[s] for s in rng.choice(L.RULES)[1]]
            else:
                rows.append(rng.choice([*other, *S.values()]))
        text = "".join(r + rng.choice([".\n", ";\n", "\n", "\n\n", ". ", ":\n  "]) for r in rows)
        if rng.random() < 0.5:
            text = re.sub(" ", lambda _: rng.choice([" "] * 8 + ["\n"]), text)
        texts.append(text.upper() if rng.random() < 0.2 else text)
    got = told(spark, texts)
    assert got == [brute(t) for t in texts] and len(set(got)) > 25


def test_order_matters(spark):
    sentences, rules = {"a": "license part one", "b": "license part two"}, [("AB", ["a", "b"])]
    assert told(spark, ["License part one. License part two.", "License part two. License part one."], sentences=sentences, rules=rules) == ["AB", ""]


def test_rows_of_trouble(spark, trouble, empty):
    got = L.scan(trouble).collect()
    assert len(got) == 13 and {(r["n_licenses"], r["licenses"]) for r in got} == {(0, "")} and L.scan(empty).count() == 0
    long = "no end of lines about a license\n" * 20_000 + "Released under the MIT License"
    assert told(spark, [long, long]) == ["MIT", "MIT"]


def test_every_rule_names_known_sentences():
    assert all(i in L.SENTENCES for _, ids in L.RULES for i in ids)
