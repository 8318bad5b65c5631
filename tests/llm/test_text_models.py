import hashlib
import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from captionloom.llm import bpe, language, license_scan, lm_score, toxicity
from captionloom.llm.common import id_crc

RANKS = bpe.read_ranks(bpe.default_path())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_pieces_merge_as_the_library_does():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x500), *range(0x2000, 0x2070), *range(0x3000, 0x3100), 0x1F600, 0x4E00, 0xFEFF]]
    find = regex.compile(public_tokenizers.PATTERN).findall
    for _ in range(800):
        t = "".join(rng.choice(pool if rng.random() < 0.5 else list("abcde  \n\t'sre12")) for _ in range(rng.randint(0, 80)))
        assert [x for p in find(t) for x in bpe.merge_piece(p.encode(), RANKS)] == LIBRARY.encode_ordinary(t)
    for t in ("a" * 3000, "ab" * 2000, "é" * 999):
        assert bpe.merge_piece(t.encode(), RANKS) == LIBRARY.encode_ordinary(t)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_encode_and_decode_round_trip(request, which):
    df = request.getfixturevalue(which)
    want = Counter()
    for r in df.collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digested(df, RANKS, public_tokenizers.PATTERN).collect())) == want


def test_encode_nothing_and_decode_null(spark, nothing):
    assert bpe.digested(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    got = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>"), RANKS).collect()
    assert [bytes(r["decoded"]) for r in got] == [b"", b""]


def test_small_piece_memory_changes_nothing(docs, monkeypatch):
    want = Counter(map(str, bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()))
    digests = Counter(bpe.digested(docs, RANKS, public_tokenizers.PATTERN).collect())
    monkeypatch.setattr(bpe, "MEMORY", 3000)
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    assert Counter(bpe.digested(docs, RANKS, public_tokenizers.PATTERN).collect()) == digests
    assert Counter(map(str, bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect())) == want


# ------------------------------------------------------------------ toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    path = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_chain_on_held_out_labels(labelled):
    docs, labels = labelled
    held = id_crc("doc_id", 4) == 1
    chain = toxicity.train(docs, labels.where(~held), toxicity.default_categories())
    assert [link.name for link in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    got = toxicity.predict(docs, chain).join(labels.where(held).withColumnRenamed("toxic", "truth"), "doc_id").select("toxic", "truth").collect()
    table = Counter((bool(r["truth"]), r["toxic"]) for r in got)
    assert table[True, True] / (table[True, True] + table[True, False]) > 0.85
    assert table[False, True] / (table[False, True] + table[False, False]) < 0.02


def test_chain_gradient_and_out_of_fold(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [("bad " if y else "good ") + " ".join(rng.choice(["one", "two", "six"], 5)) for y in (k % 2 for k in range(60))]
    labels = np.array([[k % 2, float(k % 2)] for k in range(60)])
    labels[:5, 0] = np.nan
    chain = toxicity.fit_chain(texts, labels, ["first", "second"], np.arange(60) % 3)
    p = toxicity.probabilities(texts, chain)
    assert (p[1::2, 1] > chain.threshold).all() and (p[::2, 1] < chain.threshold).all()
    assert chain.links[1].earlier[0] > 0  # the earlier category says something about the later


def test_toxicity_without_labels_or_classes(spark, docs, odd, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(docs, none, toxicity.default_categories())
    assert toxicity.predict(odd, chain).where("toxic").count() == 0
    one = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, None, 0), (None, 1, 1), (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(odd, one, toxicity.default_categories())
    got = toxicity.predict(odd, chain)
    assert got.count() == odd.count() and got.where("toxic").count() == 0
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    assert toxicity.predict(nothing, chain).count() == 0
    kept = toxicity.drop_toxic(odd, chain)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# ------------------------------------------------------------------ languages


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = id_crc("doc_id", 3) == 1
    model = language.fit(docs.where(~held))
    got = language.identify(docs, model).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(r["shares"]) - 1) < 0.02 and r["lang_pred"] == r["languages"][0] for r in got)


def test_language_shares_of_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    clean = {lang: docs.where(F.col("lang") == lang).orderBy(F.desc(F.length("text"))).first()["text"].split()[:300] for lang in ("en", "de", "fr")}
    half = spark.createDataFrame([(1, " ".join(clean["en"][:200] + clean["de"][:100]))], "doc_id bigint, text string")
    r = language.identify(half, model).first()
    assert r["languages"][:2] == ["en", "de"] and r["score"] == pytest.approx(2 / 3, abs=0.12)
    q = np.array([[1.0, 0.1, 0.1], [1.0, 0.1, 0.1], [0.1, 1.0, 0.1]])
    pi, ll = language.proportions(q, np.array([2.0, 1.0, 3.0]), np.array([0]), np.ones((1, 3)))
    best = max((2 + 1) * math.log(a + 0.1 * (1 - a)) + 3 * math.log(1 - a + 0.1 * a) for a in np.linspace(0, 1, 2001))
    assert ll[0] == pytest.approx(best, abs=1e-3) and pi[0, 0] == pytest.approx(0.5, abs=0.01)


def test_language_odd_rows(odd, nothing):
    got = {r["doc_id"]: r for r in language.identify(odd, language.fit(odd)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 10)] == ["und"] * 4 and got[1]["score"] == 0
    assert got[4]["lang_pred"] in ("en", "de", "es") and len(got) == 12
    digits = odd.sparkSession.createDataFrame([(1, "½ ² Ⅷ 12"), (2, "½ ² ok 12")], "doc_id bigint, text string")
    assert [r["lang_pred"] == "und" for r in language.identify(digits, language.fit(odd)).orderBy("doc_id").collect()] == [True, False]
    empty = language.fit(nothing)
    assert empty.languages == [] and {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(nothing, empty).count() == 0


# ------------------------------------------------------------------ licenses

MIT = """/* Copyright (c) 2020 Someone
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software. */"""


def test_license_rules_in_order(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    source = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    binary = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    names = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    texts = [
        MIT, bsd + source + binary, bsd + source + binary + names, bsd + binary + source, "some | table\nReleased under the MIT License.\nmore",
        "x. SPDX-License-Identifier: Apache-2.0\n# Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
        "I like the MIT license.", "Released under the MIT License", None, "", "software " * 50_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["licenses"] for r in license_scan.scan(df).orderBy("doc_id").collect()]
    want = [["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], [], ["MIT"], ["Apache-2.0", "CC-BY-NC-4.0"], ["GPL-3.0"], [], ["MIT"], [], [], []]
    assert got == want


def test_every_known_sentence_has_a_trigger():
    for text in license_scan.SENTENCES:
        assert regex.search(license_scan.TRIGGER, text), text
    used = {x for _, seq in license_scan.RULES for x in seq}
    assert used <= set(license_scan.known().values())
    names = [(n, k) for k, each in (license_scan.NAMES | license_scan.OR_LATER).items() for n in each]
    assert len({n for n, _ in names}) == len(names)  # no name stands for two licenses


def test_every_published_text_is_its_license(spark):
    """As it stands, in capitals, wrapped anew behind comment marks, and after other text."""
    def wrapped(text):
        return "\n *\n".join("\n".join(" * " + line for line in textwrap.wrap(part, 60)) for part in regex.split(r"\n\s*\n", text))

    shapes = [lambda t: t, str.upper, wrapped, lambda t: f"Some words before.\n\n{t}\n\nAnd after."]
    rows = [(i * len(shapes) + k, name, shape(t)) for i, (name, _, _, t) in enumerate(license_scan.PUBLISHED) for k, shape in enumerate(shapes)]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df).collect()}
    assert [(name, got[i], t) for i, name, t in rows if got[i] != [name]] == []


def test_headers_of_files_in_the_wild(spark):
    gpl = """# Foo - a program\n# Copyright (C) 2001, 2002 Somebody\n#\n# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,"""
    gpl3 = """Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
    Software Foundation, either version 3 of the License, or (at your option) any later version."""
    lgpl = """/* This library is free software; you can redistribute it and/or\n modify it under the terms of the GNU Lesser General Public
 License as published by the Free Software Foundation; either\n version 2.1 of the License, or (at your option) any later version. */"""
    only = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as x."
    kernel = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published
    by the Free Software Foundation; version 2 of the License."""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
    regents = """Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:
1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.\n3. Neither the name of The Regents of the University of X, Inc nor the names of
   its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
    apache = """// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at\n//\n//     https://www.apache.org/licenses/LICENSE-2.0\n"""
    cases = [(gpl, ["GPL-2.0-or-later"]), (gpl3, ["GPL-3.0-or-later"]), (lgpl, ["LGPL-2.1-or-later"]), (only, []), (kernel, ["GPL-2.0"]), (mpl, ["MPL-2.0"]),
             (regents, ["BSD-3-Clause"]), (apache, ["Apache-2.0"]), (gpl + "\n\n" + mpl, ["GPL-2.0-or-later", "MPL-2.0"]),
             ("Licensed under the EUPL v1.2\n", ["EUPL-1.2"]), ("SPDX-License-Identifier: CC-BY-NC-ND-3.0", ["CC-BY-NC-ND-3.0"]),
             ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_license_odd_rows(odd, nothing):
    assert license_scan.scan(odd).where("size(licenses) > 0").count() == 0 and license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(nothing).count() == 0


# ------------------------------------------------------------------ language-model scores


def plain_scores(rows, order=3, b=0.5, m=20.0):
    """``rows``: (id, text, trained). Counts of all grams in one dictionary, probabilities by recursion."""
    words = [(["<", *(w.decode() for w in (t or "").encode().lower().split()), ">"], k) for _, t, k in rows]
    counts = Counter()
    for w, k in words:
        if k:
            counts.update(tuple(w[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(w)))
    ones = {g: c for g, c in counts.items() if len(g) == 1 and g != ("<",)}
    n, v = sum(ones.values()), len(ones)

    def p(context, x):
        if not context:
            return max(1, ones.get((x,), 0)) / (n + 1)
        left = counts[context]
        return (1 - b) * counts[(*context, x)] / (left + m) + (b + (1 - b) * m / (left + m)) * p(context[1:], x)

    out = []
    for (i, _, _), (w, _) in zip(rows, words, strict=True):
        base = sum(math.log10((ones.get((x,), 0) + 1) / (n + v + 1)) for x in w[1:])
        total = sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w)))
        out.append((i, len(w) - 1, sum((x,) in ones for x in w[1:]), n, round(base, 5), round(total, 5)))
    return Counter(out)


@pytest.mark.parametrize(("chunk_bytes", "order", "piece"), [(1 << 12, 3, 7), (12 << 20, 3, 256), (1 << 13, 2, 5), (1 << 13, 5, 11)])
@pytest.mark.parametrize("which", ["docs", "odd", "untrained"])
def test_scores_match_plain_counts(request, monkeypatch, which, chunk_bytes, order, piece):
    monkeypatch.setattr(lm_score, "PIECE", piece)
    df = request.getfixturevalue("odd" if which == "untrained" else which)
    df = df.withColumn("trained", F.lit(False) if which == "untrained" else id_crc("doc_id", 7) != 2)
    rows = [(r["doc_id"], r["text"], r["trained"]) for r in df.collect()]
    assert which == "untrained" or all(k == (zlib.crc32(str("" if i is None else i).encode()) % 7 != 2) for i, _, k in rows)
    got = lm_score.score(df, "trained", order=order, chunk_bytes=chunk_bytes, bucket_keys=1 << 10).collect()
    key = lambda r: (str(r[0]), *r[1:4])
    want = sorted(plain_scores(rows, order).elements(), key=lambda r: (key(r), r[4:]))
    got = sorted(map(tuple, got), key=lambda r: (key(r), r[4:]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(g[k] == pytest.approx(w[k], abs=1e-4) for g, w in zip(got, want, strict=True) for k in (4, 5))


def test_arcs_and_failure_arcs_of_the_automaton():
    """Every arc, failure arc and weight of a small automaton against the counts, and a walk along them."""
    texts = ["a b a c", "a b b", "c a b a", "b", "a b a b c d a"]
    known = [True, True, True, True, False]
    grams = lm_score.grams_of(pa.table({"text": texts, "trained": known}), 3, 40)
    counts = Counter()
    for t, k in zip(texts, known, strict=True):
        w = ["<", *t.split(), ">"]
        counts.update(tuple(w[i - n + 1 : i + 1]) for n in (1, 2, 3) for i in range(n - 1, len(w)) if k)
    words = {}
    at = 0
    for t in texts:
        for w in ["<", *t.split(), ">"]:
            words[at] = w
            at += 1
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<",))
    machine = lm_score.automaton(grams, grams.counts, n, 0.5, 20.0)
    name = {0: ()}
    for k in range(3):
        for i, end in enumerate(grams.place[k]):
            name[machine.base[k] + i] = tuple(words[j] for j in range(end - k, end + 1))
    longest = lambda g: next(g[i:] for i in range(len(g) + 1) if not g[i:] or (counts[g[i:]] and len(g[i:]) < 3 and g[-1] != ">"))

    def p(c, x):
        if not c:
            return max(1, counts[(x,)]) / (n + 1)
        return 0.5 * counts[(*c, x)] / (counts[c] + 20) + (0.5 + 0.5 * 20 / (counts[c] + 20)) * p(c[1:], x)

    for arc, g in name.items():
        if not arc:
            continue
        assert machine.arc_known[arc] == (counts[g] > 0 or len(g) == 1)
        if machine.arc_known[arc]:
            assert name[machine.arc_to[arc]] == longest(g)
            assert g[-1] == "<" or machine.arc_weight[arc] == pytest.approx(math.log10(p(g[:-1], g[-1])))
        if len(g) < 3 and counts[g] and g[-1] != ">":  # a state
            assert name[machine.fail_to[arc]] == longest(g[1:])
            assert machine.fail_weight[arc] == pytest.approx(math.log10(0.5 + 0.5 * 20 / (counts[g] + 20)))
    got = lm_score.traverse(machine, grams)
    for j, w in words.items():
        if w != "<":
            back = max(i for i in words if i <= j and words[i] == "<")
            assert got[j] == pytest.approx(math.log10(p(tuple(words[i] for i in range(max(back, j - 2), j)), w)))


def test_scores_of_nothing(nothing):
    assert lm_score.score(nothing.withColumn("trained", F.lit(True)), "trained").count() == 0


def test_what_follows_a_state_adds_up_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b", "b"])]
    train = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("trained", F.lit(True))
    words = ["a", "b", "c", "unknown"]
    # after "a b": log p of "a b w" less that of "a b" without what follows w
    asked = [(100 + k, f"a b {w}", False) for k, w in enumerate(words)] + [(200, "a b", False)]
    got = {r["doc_id"]: r["score"] for r in lm_score.score(train.union(spark.createDataFrame(asked, "doc_id bigint, text string, trained boolean")), "trained").collect()}
    plain = {r[0]: r for r in plain_scores([(*r, True) for r in rows] + asked)}
    assert all(got[i] == pytest.approx(plain[i][5], abs=1e-4) for i in got)
    grams = lm_score.grams_of(pa.table({"text": [t for _, t in rows] + [f"a b {w}" for w in words], "trained": [True] * 4 + [False] * 4}), 3, 40)
    ones = Counter(x for _, t in rows for x in [*t.split(), ">"])
    machine = lm_score.automaton(grams, grams.counts, sum(ones.values()), 0.5, 20.0)
    each = lm_score.traverse(machine, grams)
    follows = {w: each[grams.starts[4 + k] + 3] for k, w in enumerate(words)}
    follows[">"] = each[grams.starts[2] + 4]  # "c a b" ends after "a b"
    assert sum(10**x for x in follows.values()) == pytest.approx(1)