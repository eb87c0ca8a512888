"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences three times: with line ends as sentence ends, with
all lines joined, and by paragraphs (wrapped notices): there, lines without comment
marks are joined, and blank lines, copyright lines, list items and titles are
sentences of their own. A sentence is normalised: ASCII lower case, every
run of other characters than letters and digits is one space, a copyright line
is cut to ``copyright notice``,
phrases that put a work under a licence are cut to ``under``, and a pointer to the
licence file at the end is cut off. The normalised sentence is looked up in the
table of known licence sentences and becomes its identifier. A rule is an
ordered list of identifiers; it applies where the identifiers of one cut hold
it as a subsequence; ``FOLDS`` are identifiers in a row that count as one. The
licences of all rules that apply are reported. An SPDX expression (``MIT OR
Apache-2.0``) refers to each licence in it; what follows ``WITH`` is an exception.

``sql`` has the first two cuts and the sentences and rules of ``TEXTS`` and
``NAMES`` only; the scan also has the third cut, ``NOTICES``, ``FOLDS`` and
``NOTICE_RULES``. They are equal where a text holds none of those.

Only texts with one of the ``ANCHORS`` are cut; every known sentence has one, so
the others have no known sentence. Nothing is shuffled and no row is dropped.

Cases: a null or empty text has no sentence and no licence; null and repeated
ids are kept as they are; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names by identifier, phrases that refer to a licence, sentences of licence texts, ordered rules.
NAMES = {
    "MIT": ["MIT License", "MIT Licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
REFERENCE = "^(this (work|software|project|file|program|code|document|library) is )?(licensed|released|distributed|available|published) under (the terms of )?(the |a |an )?"
POINTER = " see (the |)(licen[cs]e|copying)( md| txt|)( file|)( for (more |)(details|information)|)$"
COPYRIGHT = "^(c )?copyright( .*)?$"
TEXTS = {
    "rights-reserved": "All rights reserved.",
    "copyright": "Copyright notice",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-grant": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}
TEXT_RULES = {
    "All-Rights-Reserved": ["rights-reserved"],
    "MIT": ["mit-grant", "mit-notice"],
    "Apache-2.0": ["apache-grant", "apache-copy"],
    "BSD-2-Clause": ["bsd-grant", "bsd-source", "bsd-binary"],
    "ISC": ["isc-grant"],
    "Unlicense": ["public-domain"],
}
ANCHORS = ["licens", "licenc", "copyright", "rights reserved", "permission", "redistribution", "obtain a copy", "public domain", "software is provided", " under ", "advertising materials"]

# Fixed values of the scan only: sentences of notices, identifiers in a row that are one, rules.
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License", "LGPL-2": "GNU Library General Public License"}
VERSIONS = {"GPL-2.0": ("GPL", "2"), "GPL-3.0": ("GPL", "3"), "LGPL-2.0": ("LGPL-2", "2"), "LGPL-2.1": ("LGPL", "2.1"), "LGPL-3.0": ("LGPL", "3"), "AGPL-3.0": ("AGPL", "3")}
LATER = ["either version {} of the License, or (at your option) any later version.", "version {} of the License.", "version {}."]
NOTICES = {
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-name",
    "Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-name",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd-advert",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v2.0.": "ref-MPL-2.0",
    "Mozilla Public License Version 2.0": "ref-MPL-2.0",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/": "ref-Apache-2.0",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "ref-GPL-2.0",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "ref-GPL-3.0",
    "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991": "ref-LGPL-2.0",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "ref-LGPL-2.1",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "ref-LGPL-3.0",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "ref-AGPL-3.0",
}
FOLDS = [(["bsd-binary", "bsd-advert", "bsd-name"], "bsd-4"), (["bsd-binary", "bsd-advert"], "bsd-4"), (["bsd-binary", "bsd-name"], "bsd-3")]
FOLDS += [([f"terms-{gnu}", f"version-{v}"], f"ref-{spdx}") for spdx, (gnu, v) in VERSIONS.items()]
NOTICE_RULES = [("LGPL-2.0", ["ref-LGPL-2.0"]), ("LGPL-2.1", ["ref-LGPL-2.1"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-3"]), ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-4"])]
#: The named holders of a clause, and the same in the form of ``NOTICES``.
HOLDERS = r"neither the names? of [^\n]{1,200}?nor (?:the names? of )?[^\n]{1,100}?may be used to endorse or promote products derived from this software without specific,? prior written permission"
ONE_HOLDER = "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
#: Patterns and replacements that make the third cut, in order, over text in lower case.
PARAGRAPHS = [
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*(?:/\*+|\*+/?|//+!?|#+|;+|--+|%+|>+|(?:dnl|rem)(?=[ \t]|$))[ \t]*", ""),
    (r"[^a-z0-9]*\bat:?[^a-z0-9]*https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?[^\sa-z0-9]*", " at http://www.apache.org/licenses/license-2.0\n\n"),
    (r"\n(?:[^a-z0-9\n]*\n)+", "\n\n"),
    (r"(?m)^([^a-z0-9\n]*(?:(?:\(c\)|©)[ \t]*)?copyright[ \t]*(?:\(c\)|©|[:,]?[ \t]*[\[<{(]?(?:[0-9]{4}|yyyy|year)|the [^\n]*authors)[^\n]*)$", "\n$1\n"),
    (r"(?:\A|\n\n)([^a-z0-9\n]*(?:copyright [^\n]*|(?:the )?(?:mit|isc|(?:new |modified |simplified )?bsd|bsd [234]-clause) licen[sc]e(?: \([a-z0-9 -]+\))?[^a-z0-9\n]*))(?=\n)", "\n\n$1\n"),
    (r"(?m)^[^a-z0-9\n]*(?:\([0-9a-d]\)|[0-9a-d][.)])[ \t]+", "\n"),
    (r"[ \t]*(?<!\n)\n(?!\n)[ \t]*", " "),
    (r"[ \t]+", " "),
    (r"\((?:hereinafter )?(?:the )?[\"'“”‘’]*licen[sc]e[\"'“”‘’]*\)|[(<]+https?://[^\s()<>]*[)>]+", ""),
    (r"\bv\. ?(?=[0-9])", "v"),
    (r"(free software foundation), (?=either version|version)", "$1; "),
    (HOLDERS, ONE_HOLDER),
]


def normal(sentence: str) -> str:
    """The normal form of a sentence; ``_normal`` is the same for columns."""
    s = re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")
    return re.sub(POINTER, "", re.sub(REFERENCE, "under ", re.sub(COPYRIGHT, "copyright notice", s)))


def sentences() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    known = {normal(t): k for k, t in TEXTS.items()}
    for spdx, names in NAMES.items():
        known |= {normal(f"Licensed under the {name}"): f"ref-{spdx}" for name in names}
        known[normal(f"SPDX-License-Identifier={spdx}")] = f"ref-{spdx}"
    return known


def notices() -> dict[str, str]:
    """Normalised sentence -> identifier, of those that the scan has besides ``sentences``."""
    known = {normal(t): k for t, k in NOTICES.items()}
    for gnu, name in GNU.items():
        known |= {normal(f"{you} redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"): f"terms-{gnu}" for you in ("you can", "you may")}
    known |= {normal(text.format(v)): f"version-{v}" for _, v in VERSIONS.values() for text in LATER}
    for spdx in [*NAMES, *VERSIONS]:
        known |= {normal(f"SPDX-License-Identifier={spdx}{more}"): f"ref-{spdx}" for more in ("", "-only", "-or-later", "+")}
        if spdx.startswith("CC-BY"):
            place = f"creativecommons.org/licenses/{spdx[3:-4].lower()}/{spdx[-3:]}"
            known |= {normal(f"To view a copy of this license, visit {scheme}{place}{end}"): f"ref-{spdx}" for scheme in ("http://", "https://") for end in ("", "/legalcode")}
    return known


def rules() -> list[tuple[str, list[str]]]:
    """(licence, ordered identifiers)."""
    return [(k, [f"ref-{k}"]) for k in NAMES] + list(TEXT_RULES.items())


def _normal(s: Column) -> Column:
    plain = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, COPYRIGHT, "copyright notice"), REFERENCE, "under "), POINTER, "")


def _identifiers(text: Column, known: Column) -> Column:
    """``,id;,id;`` of the known sentences in order."""
    text = F.regexp_replace(text, "(spdx-license-identifier) *: *", "$1=")
    cut = F.split(F.regexp_replace(text, r"([.!?;:])[ \t\r\n]+", "$1\n"), "\n", -1)
    ids = F.filter(F.transform(cut, lambda s: F.element_at(known, _normal(s))), lambda i: i.isNotNull())
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), i, F.lit(";"))), "")


def _expressions(text: Column, known: Column) -> Column:
    """``,id;,id;`` of the licences in SPDX expressions of two operands or more."""
    lines = F.filter(F.regexp_extract_all(text, F.lit(r"spdx-license-identifier *: *([^\n\r]*)"), F.lit(1)), lambda e: e.rlike(r"[ )](or|and|with)[ (]|\("))
    operands = F.flatten(F.transform(lines, lambda e: F.split(F.regexp_replace(e, r" +with +[^ ()]+", ""), r"[()]| +(?:or|and)(?= |\()")))
    ids = F.transform(operands, lambda o: F.element_at(known, _normal(F.concat(F.lit("spdx-license-identifier="), F.trim(F.regexp_replace(o, r"[^a-z0-9.+ -]", " "))))))
    return F.array_join(F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.concat(F.lit(","), i, F.lit(";"))), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_sentences (recognised line by line), licenses (sorted, joined by a comma)."""
    known = F.create_map(*[F.lit(x) for kv in (notices() | sentences()).items() for x in kv])
    raw = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    has = F.lit(False)
    for a in ANCHORS:
        has = has | F.contains("text", F.lit(a))
    ids = lambda t: F.when(has, _identifiers(F.regexp_replace(t, HOLDERS, ONE_HOLDER), known)).otherwise("")
    cut = raw.select("id", ids(F.col("text")).alias("lines"), ids(F.regexp_replace("text", r"[ \t\r]*\n[ \t\r]*", " ")).alias("joined"), ids(_paragraphs(F.col("text"))).alias("paragraphs"), F.when(F.contains("text", F.lit("spdx-license-identifier")), _expressions(F.col("text"), known)).otherwise("").alias("expressions"))
    size = F.length("lines") - F.length(F.replace("lines", F.lit(";"), F.lit("")))
    cut = cut.select("id", size.cast("long").alias("n"), *[_folded(F.col(c)).alias(c) for c in ("lines", "joined")], _folded(F.concat("paragraphs", "expressions")).alias("paragraphs"))
    found = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("rule")) for name, pattern in _patterns(rules() + NOTICE_RULES)])
    like = lambda r: F.call_function("like", F.col("lines"), r.rule) | F.call_function("like", F.col("joined"), r.rule) | F.call_function("like", F.col("paragraphs"), r.rule)
    matched = F.transform(F.filter(found, like), lambda r: r["name"])
    return cut.select(F.col("id").alias(id_col), F.col("n").alias("n_sentences"), F.array_join(F.array_sort(F.array_distinct(matched)), ",").alias("licenses"))


def _paragraphs(text: Column) -> Column:
    """The third cut's text: a sentence a line, wrapped lines joined."""
    for pattern, new in PARAGRAPHS:
        text = F.regexp_replace(text, pattern, new)
    return text


def _folded(ids: Column) -> Column:
    for row, one in FOLDS:
        ids = F.replace(ids, F.lit("".join(f",{i};" for i in row)), F.lit(f",{one};"))
    return ids


def _patterns(of: list[tuple[str, list[str]]] | None = None) -> list[tuple[str, str]]:
    """(licence, LIKE pattern over ``,id;,id;`` that holds its identifiers in order)."""
    return [(name, "%" + "%".join(f",{i};" for i in ids) + "%") for name, ids in of or rules()]


def sql() -> str:
    """The scan in DuckDB SQL over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"{q(k)}: {q(v)}" for k, v in sentences().items())
    patterns = ", ".join(f"({q(n)}, {q(p)})" for n, p in _patterns())
    each = lambda t: (
        f"list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '(spdx-license-identifier) *: *', '\\1=', 'g'), '([.!?;:])[ \\t\\r\\n]+', '\\1\n', 'g'), chr(10)), "
        f"lambda s: known[regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), {q(COPYRIGHT)}, 'copyright notice'), {q(REFERENCE)}, 'under '), {q(POINTER)}, '')]), "
        "lambda i: i IS NOT NULL), lambda i: ',' || i || ';')"
    )
    return f"""
WITH k AS (SELECT MAP {{{known}}} AS known),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, known FROM documents, k),
c AS (SELECT doc_id, {each("t")} AS a, {each("regexp_replace(t, '[ \\t\\r]*\\n[ \\t\\r]*', ' ', 'g')")} AS b FROM d),
r(name, rule) AS (VALUES {patterns})
SELECT doc_id, len(a)::BIGINT AS n_sentences,
       coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM r WHERE array_to_string(a, '') LIKE rule OR array_to_string(b, '') LIKE rule), '') AS licenses
FROM c
"""
