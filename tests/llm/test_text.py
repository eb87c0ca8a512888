"""BPE, language, decontamination, licences, token counts against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from roamer.llm import bpe, decontam, langid, licenses, token_counts


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())


@pytest.mark.parametrize("chunk", [10, bpe.CHUNK])
def test_bpe_equals_the_library(docs, odd, bpe_path, chunk):
    t = Tokenizer.from_file(bpe_path)
    for df in (odd, docs) if chunk > 10 else (odd,):
        want = sorted(((r[0], *encoded(t, r[1])) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted((tuple(r) for r in bpe.digests(df, bpe_path, chunk=chunk).collect()), key=str) == want
    assert bpe.digests(odd.limit(0), bpe_path).count() == 0


def test_bpe_round_trip(odd, bpe_path):
    back = bpe.decode(bpe.encode(odd, bpe_path), bpe_path).collect()
    assert sorted(map(str, (tuple(r) for r in back))) == sorted(str((r[0], r[1] or "")) for r in odd.select("doc_id", "text").collect())


def test_packing():
    x = np.array([0, 1, 254, 255, 256, 70_000, 2**32 - 1])
    assert bpe.unpack(bpe.pack(x)).tolist() == x.tolist() and not len(bpe.unpack(bpe.pack(np.empty(0))))


def test_language_held_out_accuracy(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_language_cases(odd):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}
    kept = langid.recognised(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2})
    assert langid.recognised(odd.limit(0)).count() == 0


def brute_vector(text, dimensions):
    """One trigram after the other, in plain Python integers."""
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} "]
    chars = [c for i, c in enumerate(low) if c != " " or i == 0 or low[i - 1] != " "]
    out = [0] * dimensions
    vectors = {c: langid.letter_vector(ord(c), dimensions).tolist() for c in set(chars)}
    for x, y, z in zip(chars, chars[1:], chars[2:]):
        a, b, c = vectors[x], vectors[y], vectors[z]
        for d in range(dimensions):
            out[d] += a[d - 2] * b[d - 1] * c[d]
    return out


def test_vectors_are_bound_in_order(monkeypatch):
    a = langid.text_vectors(["abc"], 256)[0]
    b = langid.text_vectors(["cba"], 256)[0]
    assert not np.array_equal(a, b) and np.array_equal(a, langid.text_vectors(["A-B c".replace("-B c", "bc")], 256)[0])
    rnd = random.Random(3)
    texts = ["", "12 3", "Ab", "été  Straße ΑΒΓ", "".join(rnd.choice("ab é中文字ÅZ. 1") for _ in range(300)), "".join(chr(0x4E00 + rnd.randrange(2000)) for _ in range(400))]
    want = [brute_vector(t, 64) for t in texts]
    for block, size in ((1 << 20, 4096), (50, 7), (1, 1)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "SLICE", size)
        got, totals = langid.text_vectors(texts, 64)
        assert got.astype(int).tolist() == want and totals[0] == totals[1] - 0 == 0 and totals[2] == 2


def test_predictions_equal_brute_force(docs):
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if len(r.text or "") < 1500]
    size = 32
    some = docs.sparkSession.createDataFrame(rows[:120], "doc_id long, text string, lang string")
    prototypes = langid.learned(some, dimensions=size)
    sums = {}
    for r in rows[:120]:
        if r.lang is not None and r.text is not None:
            sums[r.lang] = [x + y for x, y in zip(sums.get(r.lang, [0] * size), brute_vector(r.text, size))]
    assert prototypes == {k: v for k, v in sorted(sums.items()) if any(v)}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for r in langid.predict(some, prototypes, ["doc_id", "text"], dimensions=size).collect():
        v = brute_vector(r.row.text or "", size)
        cosine = {k: sum(x * y for x, y in zip(v, p)) / (norm(p) * (norm(v) or 1)) for k, p in prototypes.items()}
        best = max(cosine.values())
        if any(c.isalpha() for c in r.row.text or ""):
            assert abs(cosine[r.lang] - best) < 1e-9 and abs(r.score - min(1, max(0, best))) < 1e-5
        else:
            assert (r.lang, r.score) == ("und", 0)


def test_language_memory_of_texts_without_common_trigrams():
    """Random ideographs, 340 texts of a thousand and one of 300,000, in a process of their own."""
    code = (
        "import random, resource, sys; from roamer.llm import langid; rnd = random.Random(1); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
        "some = lambda n: ''.join(map(chr, rnd.choices(range(0x4E00, 0x9FA5), k=n)));"
        "langid.text_vectors([some(1000) for _ in range(340)], 1024); langid.text_vectors([some(300_000)], 1024);"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    import subprocess
    import sys

    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 600_000


def brute_template(text):
    """(words in lower case, slot types), word by word: 1 number, 2 name, 3 unit."""
    out, first = [], True
    for raw in re.findall(r"[^ \t-\r]+", text or ""):
        core = re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", raw)
        if not core:
            continue
        low = core.lower()
        kind = 2 if not first and re.match(r"[A-Z][a-z]|[À-Þ][a-z\x80-\U0010ffff]", core) else 0
        kind = 3 if low in decontam.UNITS else kind
        kind = 1 if re.fullmatch(r"[0-9.,:/-]*[0-9][0-9.,:/-]*", core) else kind
        out.append((low, kind))
        first = raw[-1] in ".!?:;"
    return out


def brute_contaminated(docs, items, k=5, cover=80):
    """Every placing of an item over a document without gaps: windows whose words or slots meet, with slots in one-to-one relation."""
    def window(x, names):
        typed = [("", t) if t and (names or t != 2) else (w, 0) for w, t in x]
        return tuple((w, 0) for w, _ in x) if all(t for _, t in typed) else tuple(typed)

    out = set()
    parsed = [(d, brute_template(t)) for d, t in docs]
    whole = {d: {window(x[p : p + k], n) for p in range(len(x) - k + 1) for n in (True, False)} for d, x in parsed}
    for i, t in items:
        own = brute_template(t)
        n = len(own) - k + 1
        if n < 1:
            continue
        begin = window([(own[0][0], 2), *own[1:k]], True)
        mine = [{window(own[q : q + k], names) for names in (True, False)} | ({begin} if q == 0 else set()) for q in range(n)]
        for d, x in parsed:
            if 100 * sum(bool(m & whole[d]) for m in mine) < cover * n:
                continue
            for g in range(-n + 1, len(x) - k + 1):
                there, back, covered = {}, {}, 0
                for q in range(max(0, -g), min(n, len(x) - k + 1 - g)):
                    if not mine[q] & {window(x[g + q : g + q + k], names) for names in (True, False)}:
                        continue
                    slots = [(x[g + r][1] or own[r][1], own[r][0], x[g + r][0]) for r in range(q, q + k) if x[g + r][1] or own[r][1]]
                    a, b = dict(there), dict(back)
                    if all(a.setdefault((s, u), v) == v and b.setdefault((s, v), u) == u for s, u, v in slots):
                        there, back, covered = a, b, covered + 1
                if 100 * covered >= cover * n:
                    out.add((d, i))
                    break
    return out


def test_decontamination_equals_brute_force(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == brute_contaminated([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got
    clean = {r.doc_id for r in decontam.clean(docs, items).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_slots_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    names, verbs, things, units = ["Tom", "Ann", "Kim", "Zoé"], ["bought", "sold", "carried"], ["apples", "pears", "clips"], ["km", "kg", "dollars"]
    some = lambda: f"{rnd.choice(names)} yesterday {rnd.choice(verbs)} {rnd.randint(1, 4)} {rnd.choice(things)} and {rnd.randint(1, 4)} {rnd.choice(things)} for {rnd.randint(1, 4)} {rnd.choice(units)} near {rnd.choice(names)}"
    items = [(f"q{i}", some() + rnd.choice([".", " today with " + some()])) for i in range(25)]
    far = " other words here." * 15  # so far apart that sentences are occurrences of their own
    docs = [(str(i), (far + " ").join(rnd.choice([some(), some().lower(), "Other words."]) for _ in range(rnd.randint(1, 3)))) for i in range(150)] + [("copy", items[0][1]), (None, items[1][1].upper())]
    want = brute_contaminated(docs, items)
    for bits in (28, 15):
        monkeypatch.setattr(decontam, "FILTER_BITS", bits)
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
        assert got == want and len(want) > 20


def test_repetitive_texts():
    import time

    for item, doc, is_in in (("word " * 600, "word " * 20_000, True), ("5 apples " * 300, "".join(f"{i} apples " for i in range(10_000)), False), ("".join(f"{i} apples " for i in range(300)), "".join(f"{i} apples " for i in range(10_000)), True)):
        began = time.time()
        assert bool(decontam.matched(doc, [decontam.forms(item)])) == is_in
        assert time.time() - began < 60


def test_reparameterised_questions(spark, odd):
    items = spark.createDataFrame([(1, "Yesterday Tom bought 12 apples and 7 pears for 12 dollars at the market near Paris today."), (2, None), (3, "tiny item here")], "item_id long, text string")
    texts = [
        (1, "Intro. Yesterday Tom bought 12 apples and 7 pears for 12 dollars at the market near Paris today. End"),
        (2, "Yesterday Anna bought 30 apples and 9 pears for 30 euros at the market near Rome today."),
        (3, "Yesterday Anna bought 30 apples and 9 pears for 31 euros at the market near Rome today."),
        (4, "nothing of that sort"), (5, None), (6, "so yesterday Yesterday Tom bought 12 apples and 7 pears for 12 dollars at the market near Paris today"), (7, "tiny item here"),
    ]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.reparameterised) for r in decontam.contaminated(d, items).collect()}
    assert got == {1: (1, False), 2: (1, True), 6: (1, False), 7: (3, False)}
    assert decontam.contaminated(d, items.limit(0)).count() == 0
    assert decontam.clean(odd, items).columns == odd.columns and decontam.clean(odd, items).count() == odd.count()


def test_licences(spark, odd):
    full = "\n".join([licenses.TEXTS["mit-grant"], "", licenses.TEXTS["mit-notice"]])
    texts = [(1, "x\nLicensed under the Apache License, Version 2.0. More"), (2, full), (3, licenses.TEXTS["mit-grant"]), (4, "Intro.\nThis software is released under the\n  MIT License."), (5, "// SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT"), (6, None), (7, "the MIT License is a license")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "Apache-2.0", 2: "MIT", 3: "", 4: "MIT", 5: "MIT", 6: "", 7: ""}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0
    assert all(any(a.strip() in s for a in licenses.ANCHORS) for s in licenses.sentences())


def test_edits_equal_encoding_anew(bpe_path):
    t, c = Tokenizer.from_file(bpe_path), token_counts.Counter(bpe.tokenizer_json(bpe_path))
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "s", "re", "1", "23", "!", "<|endoftext|>", "<|", "|>", "endoftext", "é", "中", "🙂", "\t", "the ", "word"]
    some = lambda n: "".join(rnd.choice(parts) for _ in range(n))
    for _ in range(200):
        text = some(rnd.choice([0, 1, 3, 20, 400, 1500]))
        words = list(c.split(text))
        tree = token_counts.Tree.of(words, c.counts(words))
        for _ in range(4):
            at, removed, new = rnd.randint(0, len(text) + 1), rnd.choice([0, 1, 2, 5, 50]), some(rnd.choice([0, 1, 2, 30]))
            tree.edit((at, removed, new), c)
            at = min(at, len(text))
            text = text[:at] + new + text[at + removed :]
            assert tree.text() == text and tree.tokens == len(t.encode(text, add_special_tokens=False))
            assert tree.segments == sum(1 for _ in tree.leaves())


def test_only_the_region_of_an_edit_is_encoded(bpe_path):
    c = token_counts.Counter(bpe.tokenizer_json(bpe_path))
    words = list(c.split("some words " * 5000))
    tree = token_counts.Tree.of(words, c.counts(words))
    assert tree.edit((30_000, 3, "other"), c) < 20


def test_recount(docs, odd, bpe_path):
    t = Tokenizer.from_file(bpe_path)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    for df in (docs, odd):
        texts = {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}
        got = token_counts.recount(df, bpe_path, token_counts.redactions).collect()
        assert len(got) == df.count()
        for r in got:
            x = texts[r.doc_id]
            assert r.n_tokens == n(x)
            for at, removed, new in token_counts.redactions(x):
                x = x[:at] + new + x[at + removed :]
            assert r.n_tokens_edited == n(x)
    kept = token_counts.trees(odd, bpe_path).selectExpr("*", "array(named_struct('at', 2, 'removed', 1, 'inserted', 'new')) AS edits")
    for r in token_counts.updated(kept, bpe_path, "edits").collect():
        assert r.n_tokens == n("".join(r.segments)) == sum(r.tokens)


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
APACHE = """   Copyright 2020 Jane Doe

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
"""
BSD = """Copyright 2020 Google Inc.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""
BSD_NAME = """   * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
GNU = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU {} as published by
    the Free Software Foundation, either version {} of the License, or
    (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""


def test_wrapped_licence_texts(spark):
    gpl = [GNU.format(n, v) for n, v in (("General Public License", 3), ("Lesser General Public License", 2.1), ("Affero General Public License", 3))]
    comment = "".join(f" * {line}".rstrip() + "\n" for line in APACHE.splitlines())
    old = gpl[0].replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
    # The MPL 1.1's header shares Apache's sentences but for the place of the copy.
    mpl1 = APACHE.replace("Apache License, Version 2.0", "Mozilla Public License Version 1.1").replace("www.apache.org/licenses/LICENSE-2.0", "www.mozilla.org/MPL/")
    texts = [MIT, MIT.split("\n\n", 1)[1], MIT.split("\n\n", 1)[1].replace("Doe\n\n", "Doe\n"), APACHE, comment, BSD, BSD + BSD_NAME, *gpl, old, MPL, mpl1, gpl[0] + gpl[1].replace("2.1", "3")]
    want = ["MIT", "MIT", "MIT", "Apache-2.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "MPL-2.0", "", "GPL-3.0,LGPL-3.0"]
    # With both BSD texts, both are there.
    texts, want = [*texts, BSD + "\n" + BSD + BSD_NAME], [*want, "BSD-2-Clause,BSD-3-Clause"]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert all(any(a.strip() in s for a in licenses.ANCHORS) for s in licenses.notices() if not s.startswith("version "))


def test_case_line_breaks_and_longer_names(spark):
    question = "Natalia sold clips to 48 of her friends in April, and then Natalia sold half as many clips to Tom and Zoé in May. How many clips did Natalia sell to Tom altogether in April and May?"
    items = spark.createDataFrame([(1, question)], "item_id long, text string")
    words = question.split()
    wrapped = "\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4))
    other = question.replace("Tom", "Mary Ann").replace("48", "50")
    texts = [question, question.lower(), question.upper(), wrapped, question.lower().replace("48", "96"), other, "Well, " + question, question.replace("clips", "books").replace("April", "autumn")]
    got = {r.doc_id: (r.n_matched == r.n_windows, r.reparameterised) for r in decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    assert {d: c for d, (_, c) in got.items()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True, 6: False}
    assert all(got[d][0] for d in (0, 1, 2, 3))


def test_expressions_pointers_and_deeds(spark):
    deed = "This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/."
    kinds = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nd": "Attribution-NoDerivatives"}
    cases = [
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR BSD-3-Clause) AND ISC */", "BSD-3-Clause,GPL-2.0,ISC"),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("# SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1"),
        ("SPDX-License-Identifier: MITRE OR Unknown-1.0", ""), ("We like MIT or Apache-2.0.", ""),
        ("This project is licensed under the MIT license - see the LICENSE file for details.", "MIT"),
        ("This project is licensed under the Apache License 2.0; see LICENSE.md", "Apache-2.0"),
        ("See the LICENSE file for details.", ""),
        *((deed.format(name, short), f"CC-{short.upper()}-4.0") for short, name in kinds.items()),
        ("To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/legalcode", "CC-BY-SA-4.0"),
        ("To view a copy of this picture, visit https://creativecommons.org/licenses/by-sa/4.0/", ""),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_odd_rows_have_the_licences_of_sql(odd):
    import duckdb

    rows = odd.select("doc_id", "text").where("doc_id is not null").toPandas()
    c = duckdb.connect()
    c.register("documents", rows)
    want = sorted(c.execute(licenses.sql()).fetchall())
    assert sorted(tuple(r) for r in licenses.scan(odd).where("doc_id is not null").select("doc_id", "n_sentences", "licenses").collect()) == want
