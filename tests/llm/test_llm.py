"""Each operator against a brute-force version, and with nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from voxlake.llm import bpe, ego_join, exact_dedup, jaccard_join, language_id, license_scan, mixing, pii_surrogates, suffix_dedup, token_rollup
from voxlake.llm.common import shared_folder
from voxlake.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, token string"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def frame(spark, texts, langs=None, sources=None):
    """Documents with extra columns whose names operators use inside."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i % len(langs or [1])] if langs is None else langs[i], (sources or ["s"] * len(texts))[i], None, 7, "k", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    base = words(rng, 300, 5000)
    near = base.split()
    near[7] = "changed"
    return [None, "", "   ", "a", "A", "same text", "same  text ", "same text", base, base + " more", " ".join(near), words(rng, 20_000, 9000), "zz" * 40_000, "\x00 \x1c nul", "dïfférent tëxt 123"]


def test_exact_dedup(spark, odd_texts):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, odd_texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(odd_texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    assert got == want


def test_exact_dedup_many_partitions_and_rounds(spark):
    docs = frame(spark, [f"t{i % 37}" for i in range(500)]).repartition(20)
    rows = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    assert sum(r.kept for r in rows) == 37 and all(r.keep_id == r.doc_id % 37 for r in rows)


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["x", "y"])
    rows = exact_dedup.exact_dedup(docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("bigint")))).collect()
    assert len(rows) == 6 and {r.group_size for r in rows} == {3} and [r.kept for r in rows if r.doc_id is None] == [False, False]


def repeats(raws, n):
    count = Counter(r[p : p + n] for r in raws.values() for p in range(len(r) - n + 1))
    out = {}
    for i, r in raws.items():
        gone = bytearray(len(r))
        for p in range(len(r) - n + 1):
            if count[r[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        runs = sum(1 for j in range(len(r)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [8192, 2])
def test_suffix_dedup(spark, crowd):
    rng = random.Random(5)
    shared = words(rng, 120)
    texts = [None, "", "short", "ab" * 300, "a" * 700, shared, shared, "x" + shared[:250] + words(rng, 40), words(rng, 40) + shared[100:399] + "é" * 50, words(rng, 30) + shared[100:299] + words(rng, 9), words(rng, 30) + shared[100:298] + "!", words(rng, 3000, 9000)]
    texts += [words(rng, 5) + shared[200:450] + words(rng, 5) for _ in range(6)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, texts), crowd=crowd).collect()}
    assert got == repeats({i: (t or "").encode() for i, t in enumerate(texts)}, 200)


def test_suffix_dedup_of_hot_keys(spark):
    rng = random.Random(6)
    shared = words(rng, 80)
    texts = [words(rng, 6, 9000) + shared[(i % 3) * 20 :] + words(rng, 6, 9000) for i in range(90)] + [words(rng, 90, 9000) for _ in range(30)]
    docs = frame(spark, texts)
    found = suffix_dedup.suffix_dedup(docs, crowd=2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()}
    assert got == repeats({i: t.encode() for i, t in enumerate(texts)}, 200)
    sampled = docs.select(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("id")).where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(suffix_dedup.SAMPLE)) == 0)
    assert sampled.count() > 2  # so that there were hot keys


def test_suffix_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(1)
    for size in (2, 3, 200):
        t = rng.integers(2, size + 2, 400).astype(np.uint16)
        t[[99, 250, 399]] = 0
        order = suffix_dedup.suffix_order(t, np.ones(400, bool), 400)
        keys = [tuple(t[i:].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(400)) and keys == sorted(keys)


def brute_components(sets, linked):
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and linked(sets[a], sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def plain_shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, odd_texts, n, percent):
    rng = random.Random(11)
    texts = list(odd_texts)
    for _ in range(12):  # chains of growing edits: some pairs link, others only through a third
        w = words(rng, 120, 3000).split()
        for _ in range(5):
            texts.append(" ".join(w))
            w[rng.randrange(len(w))] = f"e{rng.random()}"
            w.insert(rng.randrange(len(w)), "ins")
    sets = {i: plain_shingles(t, n) for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(frame(spark, texts), n_words=n, percent=percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_join_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 8)
    rng = random.Random(2)
    base = words(rng, 100, 3000).split()
    texts = []
    for i in range(80):
        w = list(base)
        w[i % 90] = f"x{i}"
        texts.append(" ".join(w))
    sets = {i: plain_shingles(t, 3) for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(frame(spark, texts), n_words=3, percent=90).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (7, 7), (500, 400), (500, 401)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 300: 100, 200: 100, 500: 400, 400: 400, 401: 400}


def test_ego_join(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 16))
    x = np.concatenate((x, x[:30] + 0.05 * rng.standard_normal((30, 16)), x[:5], 3 * x[:2])).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.ego_join(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    want = brute_components({i: i for i in range(len(x))}, lambda a, b: near[a, b])
    assert got == {**{i: (int(near[i].sum()), want[i], want[i] == i) for i in range(len(x))}, **{i: (0, i, True) for i in range(900, 904)}}


def test_ego_join_edges(spark):
    """Huge and tiny components, vectors of unlike lengths, repeated and null ids, columns with clashing names."""
    rows = [(1, [1e200, 1e200], 0, "x"), (2, [1e200, 1e200], 0, "x"), (3, [1e-200, 1e-200], 0, "x"), (4, [5e-324, 0.0], 0, "x"), (5, [1.0, -0.0], 0, "x"), (6, [1.0, 0.0, 0.0], 0, "x"), (7, [2.0, 0.0, 0.0], 0, "x"), (8, [], 0, "x"), (None, [1.0, 1.0], 0, "x"), (9, [0.0, 1.0], 0, "x"), (9, [0.0, 1.0], 0, "x"), (9, [1.0, 1.0], 0, "x")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.ego_join(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, part int, other string")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 6, False), 8: (0, 8, True), 9: (0, 9, True)}


def test_ego_join_intervals(spark, monkeypatch):
    """Many small intervals with several groups of partners give what brute force gives."""
    for name, value in (("INTERVAL", 16), ("PARTNERS", 2)):
        monkeypatch.setattr(ego_join, name, value)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((40, 12))
    x = np.concatenate([base + 0.1 * rng.standard_normal(base.shape) for _ in range(6)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in ego_join.ego_join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    want = brute_components({i: i for i in range(len(x))}, lambda a, b: near[a, b])
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}


def test_join_intervals_recursion(monkeypatch):
    monkeypatch.setattr(ego_join, "LEAF", 4)
    x = np.random.default_rng(0).standard_normal((50, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = ego_join.join_intervals(x, x, True, 0.8, np.eye(5)[:, ::-1].copy())
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(50) for b in range(a + 1, 50) if x[a] @ x[b] >= 0.8}


def test_bpe(spark, odd_texts):
    texts = [*odd_texts, "it's   we'll\n\n x\t", "日本語 текст ½²", "word " * 50]
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(frame(spark, texts), PATH, PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i


def test_bpe_fold_and_heap_agree(spark):
    ranks = bpe.read_ranks(PATH)
    some = [" thntndredble", "ñüße", "a", " ", "zzzzzzzzzzzz", "antidisestablishmentarianism"]
    table = bpe.RankMap(ranks)
    row = spark.createDataFrame([(some,)], "w array<string>").select(table.encode(F.col("w")).alias("ids")).first()
    assert [list(ids) for ids in row.ids] == [bpe.merge_huge(w.encode(), ranks) for w in some]


def test_bpe_splitter():
    split = bpe.splitter(PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    for t in ("it's ½ a² \xa0\x85 b", "x \x1c\x1d y", "ё й  日本 ", "a\n\n  b"):
        assert [w.encode() for w in split(t)] == [b"".join(encoding.decode_single_token_bytes(i) for i in encoding.encode_ordinary(w)) for w in split(t)] and "".join(split(t)) == t


def test_language_id(spark):
    rng = random.Random(9)
    vocab = {"en": "the of and to in is was that for with".split(), "de": "der die und das nicht ist eine mit für".split(), "fr": "le la les des est une pour dans que".split()}
    langs = [rng.choice(list(vocab)) for _ in range(240)]
    texts = [" ".join(rng.choice(vocab[k]) for _ in range(60)) for k in langs]
    docs = frame(spark, [*texts, None, "", "123 456", "the" * 30_000], [*langs, "en", None, "de", None])
    rows = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    held = [i for i in range(240) if rows[i].held_out]
    assert 20 < len(held) < 90 and np.mean([rows[i].lang_pred == langs[i] for i in held]) > 0.95
    assert [rows[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and rows[240].score == 0 and all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in rows.values()} <= {"en", "de", "fr", "und"}


def test_language_id_gradients():
    rng = np.random.default_rng(0)
    m = language_id.new_model(["a", "b"], hidden=3)
    x, y, w = rng.integers(0, 256, (7, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((7, 4), np.float32)
    w[5:, 2] = 0
    _, grads = language_id.gradients(m, x, y, w)
    for p, g in zip(m.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, losses = p[at], []
        for step in (1e-2, -1e-2):
            p[at] = kept + step
            losses.append(language_id.gradients(m, x, y, w)[0])
        p[at] = kept
        assert abs((losses[0] - losses[1]) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(5, 40)) + rng.choice(["", " @x", " a=b"]) for _ in range(600)]
    docs = frame(spark, [*texts, None, ""], [rng.choice(["en", "de", None]) for _ in range(602)], [rng.choice("abc") for _ in range(602)])
    target = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "value string, share double")
    rows = mixing.mix(docs, targets={"source": target}).collect()
    mass = defaultdict(float)
    for r in rows:
        mass[r.source] += r.tokens * r.probability
    total = sum(mass.values())
    assert all(abs(mass[k] / total - s) < 1e-6 for k, s in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert len(rows) == 602 and all(not r.sampled for r in rows if r.tokens == 0) and 0 < sum(r.sampled for r in rows) < 602


def test_token_rollup(spark):
    docs = frame(spark, ["a b c", "d e", None, "f"], sources=["x", "x", "y", None])
    rollup = token_rollup.TokenRollup(spark, shared_folder(spark, "rollup"))
    n = token_rollup.count_words()
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", token_rollup.inserts(docs, "w", n)) and not rollup.commit("b1", token_rollup.inserts(docs, "w", n))
    rollup.commit("b2", token_rollup.deletes(docs.where("doc_id = 0"), "w", n))
    rollup.commit("b3", token_rollup.revisions(docs.where("doc_id = 1"), ("w", n), ("p", n + 5)))
    rollup.check()
    got = {(r.source, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert got == {("x", "p"): (1, 7), ("y", "w"): (1, 0), ("(none)", "w"): (1, 1)}
    with pytest.raises(ValueError):
        rollup.commit("../x", docs)


def test_license_scan(spark):
    texts = [None, "", "Some text.\nLicensed under the Apache License, Version 2.0.\nmore", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License. Licensed under CC BY-NC 4.0.", "licensed software without warranty"]
    rows = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    assert [rows[i].licenses for i in range(6)] == [[], [], ["Apache-2.0"], ["GPL-3.0-only"], ["MIT", "CC-BY-NC-4.0"], []]
    assert [rows[i].permissive for i in range(6)] == [None, None, True, False, False, None] and rows[4].sentence_ids == ["MITRef:", "CCRef:4.0"]


_GPL = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
_APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
_BSD3 = _BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
_CC = "This work is licensed under a Creative Commons\n%s 4.0 International License."

#: Each rule, the known sentences of its text, and the text as it is wrapped in real files.
WRAPPED = [
    ("GPL-3.0-or-later", 3, _GPL % (":", ",", 3)), ("GPL-2.0-or-later", 3, _GPL % (";", ";", 2)), ("GPL-3.0-only", 1, "This work is licensed under the GNU General\nPublic License, version 3."), ("GPL-2.0-only", 1, "Licensed under the GNU General Public\nLicense, version 2."),
    ("LGPL-3.0-only", 1, "Licensed under the GNU Lesser General\nPublic License, version 3."), ("LGPL-2.1-only", 1, "Licensed under the GNU Lesser General\nPublic License, version 2.1."), ("Apache-2.0", 5, _APACHE), ("MIT", 3, _MIT), ("BSD-3-Clause", 4, _BSD3), ("BSD-2-Clause", 3, _BSD2),
    ("CC-BY-NC-4.0", 1, _CC % "Attribution-NonCommercial"), ("CC-BY-SA-4.0", 1, _CC % "Attribution-ShareAlike"), ("CC-BY-4.0", 1, _CC % "Attribution"), ("MPL-2.0", 1, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


_LGPL = (_GPL % (";", ";", 3)).replace("program", "library").replace("GNU General", "GNU Lesser General")
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted%s

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES."""
WRAPPED += [
    ("LGPL-3.0-or-later", 3, _LGPL), ("LGPL-2.1-or-later", 3, _LGPL.replace("version 3", "version 2.1")), ("AGPL-3.0-or-later", 3, (_GPL % (":", ",", 3)).replace("GNU General", "GNU Affero General")),
    ("AGPL-3.0-only", 1, "Licensed under the GNU Affero General\nPublic License, version 3."), ("ISC", 2, _ISC % ", provided that the above\ncopyright notice and this permission notice appear in all copies."), ("0BSD", 2, _ISC % "."),
    ("BSL-1.0", 1, "Distributed under the Boost Software\nLicense, Version 1.0."), ("Zlib", 1, "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
    ("Unlicense", 1, "This is free and unencumbered software released into\nthe public domain."), ("EPL-2.0", 1, "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0"),
]
_TAGGED = [(name, 1, f"SPDX-License-Identifier: {name}") for name, _ in license_scan.TAGS]


def test_license_rules_are_all_tried():
    tagged = {name for name, _, _ in _TAGGED}
    assert [name for name, _, _ in license_scan.RULES] == [*(name for name, _, _ in WRAPPED), *(name for name, _, _ in _TAGGED if name not in {n for n, _, _ in WRAPPED})] and len(tagged) == 34


def test_license_sql_agrees_with_the_scan(spark, tmp_path):
    """Wrapped texts, several licences in one text, long and repeated ones, through the registered SQL."""
    import duckdb

    texts = [None, "", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", _MIT + "\n\n" + _APACHE, "x y. " * 50_000 + _MIT + " word" * 50_000, _MIT, _MIT, _GPL % (":", ",", 4), "İI ſ Licensed under CC BY 4.0.", "spdx-license-identifier: mitten"]
    texts += [text for _, _, text in (*WRAPPED, *_TAGGED)] + ["\r\n".join("# " + line for line in text.split("\n")) for _, _, text in WRAPPED] + ["".join(f" * {line}\n" for line in text.split("\n")) for _, _, text in WRAPPED]
    docs = frame(spark, texts)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    columns = ["doc_id", "sentence_ids", "licenses", "n_known", "n_unmatched", "permissive"]
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({license_scan.license_sql()})").fetchall()
    got = license_scan.license_scan(docs).withColumns({c: F.array_join(c, ",") for c in ("sentence_ids", "licenses")}).select(columns).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.n_known > 0 for r in got) > 100


def test_license_scan_of_wrapped_texts(spark):
    signs = [("", "", ""), ("/*\n", " * ", "\n */"), ("", "// ", ""), ("", "# ", ""), ("", ";; ", ""), ("", "REM ", "")]
    texts = [a + "\n".join(sign + line for line in text.split("\n")) + b for _, _, text in WRAPPED + _TAGGED for a, sign, b in signs] + [_MIT.replace("\n", "\r\n")]
    rows = {r.doc_id: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    for i, (name, n, text) in enumerate((*[x for x in WRAPPED + _TAGGED for _ in signs], WRAPPED[7])):
        assert (rows[i].licenses, rows[i].n_known, rows[i].n_unmatched) == ([name], n, 0), texts[i]
    none = ["This text tells how code that was once released under the MIT License is read.", "released | under the MIT", "the License. You may"]
    assert not any(r.n_known for r in license_scan.license_scan(frame(spark, none)).collect())


def test_pii_surrogates(spark):
    mail = "write to Jo.Do@mail7.example.com or 4111 1111 1111 1111, +1 (784) 555-8120"
    texts = [mail, mail.upper(), "clean text of words", None, "ip 10.2.3.4 password=abcdef123456", "Frau Klein met Mr Smith and Frau Klein", "token = \"96d17ded865a61704b5b8dc58aafba7d26a3c1ef\""]
    rows = {r.doc_id: r for r in pii_surrogates.pii_surrogates(frame(spark, texts)).collect()}
    assert rows[2].text == texts[2] and rows[3].text == "" and not rows[2].entities
    for value in ("Jo.Do", "4111", "784", "10.2.3.4", "abcdef123456", "Klein", "Smith", "96d17ded"):
        assert all(value.lower() not in r.text.lower() for r in rows.values())
    assert rows[0].text.lower().split(" or ")[0].split()[-1] == rows[1].text.lower().split(" or ")[0].split()[-1]
    names = re.findall(r"(?:Frau|Mr) (\w+)", rows[5].text)
    assert names[0] == names[2] != names[1] and re.search(r'"[0-9a-f]{40}"', rows[6].text) and re.search(r"\d{4} \d{4} \d{4} \d{4}", rows[0].text)


def test_pii_numbers_that_are_no_cards_stay(spark):
    clean = ["order 9807915762804490 came", "order 1234 5678 9012 3456, box 1234567890123", "9807915762804490 9807915762804490"]
    mixed = ["12 4111111111111111 is paid", "9807915762804490 4111111111111111", "call 784-555-8120 1234 now"]
    rows = {r.doc_id: r for r in pii_surrogates.pii_surrogates(frame(spark, clean + mixed)).collect()}
    assert [rows[i].text for i in range(3)] == clean and not any(rows[i].entities for i in range(3))
    assert [[e.kind for e in rows[i].entities] for i in (3, 4, 5)] == [["card"], ["card"], ["phone"]]
    assert all("4111111111111111" not in rows[i].text and "784-555" not in rows[i].text for i in (3, 4, 5)) and rows[4].text.startswith("9807915762804490 ")


@pytest.mark.parametrize("phone", ["+33 1 23 45 67 89", "+49 30 1234567", "+34 612 34 56 78", "+1 5551234567", "0151 23456789", "+1 (784) 555-8120", "01 23 45 67 89", "(030) 1234567", "784-555-8120"])
def test_pii_phones_of_many_groupings(phone):
    text = f"call {phone}, or write"
    assert [(text[s:e], kind) for s, e, kind, _, _ in pii_surrogates.detect(text)] == [(phone, "phone")]
    new, _ = pii_surrogates.replace(text, b"k", {})
    assert phone not in new and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)


@pytest.mark.parametrize("phone", ["+33 1 23 45 67 89", "+1 (487) 555-7209", "+49 30 1234567"])
def test_pii_addresses_after_phones(phone):
    assert [kind for _, _, kind, _, _ in pii_surrogates.detect(f"{phone} 97.51.17.173 and")] == ["phone", "ip"]
    assert pii_surrogates.detect("+1 5551234567 4736")[0][1] == 13


def test_pii_leaves_other_numbers():
    assert not any(pii_surrogates.detect(t) for t in ("on 01-02-2024 at 12:30", "2024-01-02", "pi is 3.14159265358", "+5 or -3 points", "0.5 12345678"))


def test_pii_persons_without_titles(spark):
    texts = ["John Smith came. Mr John Smith left; JOHN SMITH\nand Smith's dog, not Smithers. Is Mr Brown in? Brown is.", "Mr Smith", "Dr Smith", "the Dr is in, is it", "Dr John Smith", "Mrs Anna Maria O'Neil"]
    rows = {r.doc_id: r.text for r in pii_surrogates.pii_surrogates(frame(spark, texts)).collect()}
    assert not re.search("john|smith\\b|brown", rows[0], re.I) and "Smithers" in rows[0] and "'s dog" in rows[0]
    assert rows[1].split()[1] == rows[2].split()[1] and rows[4].removeprefix("Dr ") == rows[0].split(" came")[0] == re.search("Mr (.*) left", rows[0])[1]
    assert rows[3].endswith(", is it") and not re.search("Anna|Maria|Neil", rows[5])


def test_pii_names_grow_with_attempts():
    names = [[pii_surrogates.surrogate(b"k", "person", v, "", n) for n in (0, 3, 40)] for v in ("smith", "john smith", "иванов")]
    assert all(len(a) < len(b) < len(c) for a, b, c in names)
    a, b = (pii_surrogates.surrogate(b"k", "email", "a@b.com", "", n) for n in (0, 5))
    assert len(b) == len(a) + 5


def test_pii_surrogates_are_no_entities(spark):
    """A surrogate that is somebody's name in the corpus is drawn again, whatever its case."""
    taken = pii_surrogates.surrogate(b"k", "person", "john smith").lower()
    rows = [("person", v, "") for v in ("john smith", taken, "ann brown")]
    odd = {r.value: r.attempt for r in pii_surrogates.collisions(spark.createDataFrame(rows, "kind string, value string, attributes string"), b"k").collect()}
    names = [pii_surrogates.surrogate(b"k", "person", v, "", odd.get(v, 0)).lower() for _, v, _ in rows]
    assert odd["john smith"] >= 1 and len(set(names)) == 3 and not set(names) & {v for _, v, _ in rows}


def test_pii_distinct_and_coreferent(spark):
    """Brute force: over all mentions of a corpus one entity has one surrogate, and two entities of a kind have two."""
    rng = random.Random(5)
    people = [f"{a} {b}" for a in ("John", "Ann", "Max") for b in ("Smith", "Brown", "Stone")]
    texts = [" ".join(f"{rng.choice(['Mr', 'Dr', 'Frau'])} {rng.choice(people)} wrote to {rng.choice('abc')}@host{rng.randrange(3)}.{rng.choice(['com', 'org'])} from 10.0.{rng.randrange(4)}.7 today." for _ in range(4)) for _ in range(60)] + ["long " * 30_000 + "a@host1.com"]
    texts.append(texts[0])
    rows = {r.doc_id: r for r in pii_surrogates.pii_surrogates(frame(spark, texts)).collect()}
    pairs = defaultdict(set)
    for i, text in enumerate(texts):
        old, new = pii_surrogates.detect(text), rows[i].text
        shift = 0
        for (start, end, kind, value, _), after in zip(old, [*old[1:], (len(text), 0, "", "", "")], strict=True):
            rest = text[end : after[0]]
            at = new.index(rest, start + shift) if rest else len(new)
            pairs[kind, value].add(new[start + shift : at].lower())
            shift = at - end
    assert all(len(names) == 1 for names in pairs.values())
    assert len({(kind, *names) for (kind, _), names in pairs.items()}) == len(pairs) and rows[61].text == rows[0].text


def test_pii_ibans_keep_their_check_sum():
    new = pii_surrogates.surrogate(b"k", "iban", "DE89370400440532013000")
    assert new[:2] == "DE" and len(new) == 22 and new[4:] != "370400440532013000" and pii_surrogates._mod97(new[4:] + new[:4]) == 1


def test_pii_formats_are_permuted():
    seen = {pii_surrogates.surrogate(b"k", "ssn", f"{i:09d}") for i in range(3000)}
    assert len(seen) == 3000 and all(re.fullmatch(r"\d{9}", s) for s in seen)


def test_pii_collisions_draw_again(spark):
    values = [f"jo@mail.{host}" for host in ("one.com", "two.com", "three.org")] + ["ann@mail.one.com"]
    odd = {r.value: r.attempt for r in pii_surrogates.collisions(spark.createDataFrame([("email", v, "") for v in values], "kind string, value string, attributes string"), b"k").collect()}
    names = [pii_surrogates.surrogate(b"k", "email", v, "", odd.get(v, 0)) for v in values]
    assert len(odd) == 2 and len(set(names)) == 4


def test_shingles_of_all_documents_are_counted(spark):
    """No document is left out of the counts, and frequent shingles are told apart however many there are."""
    steps = jaccard_join.count_steps(np.array([0, 1, 15, 16, 17, 18, 31, 32, 255, 256, 10**6, 2**32, 2**34 - 1, 2**40]))
    assert steps.tolist() == [0, 1, 15, 16, 16, 17, 23, 24, 47, 48, 16 + 15 * 8 + 7, 16 + 28 * 8, 255, 255]
    assert (np.diff(jaccard_join.count_steps(np.arange(100_000)).astype(int)) >= 0).all()
    often = {"one two three": 40, "four five six": 300, "seven eight nine": 3000, "ten eleven twelve": 1}
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(t for t, n in often.items() for _ in range(n))], "id bigint, text string").repartition(5)
    counts = jaccard_join.token_counts(texts, 3)
    for text, n in often.items():
        place = int(jaccard_join.shingle_set(text, 3)[0]) >> 64 - jaccard_join.COUNTER_BITS
        assert counts[place] == jaccard_join.count_steps(np.array([n]))[0]
    assert np.count_nonzero(counts) == len(often)


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, suffix_dedup.suffix_dedup, jaccard_join.jaccard_join, lambda d: bpe.bpe_digests(d, PATH, PATTERN)])
def test_batches_of_any_size(spark, odd_texts, run):
    """What crosses the bounds of Arrow batches comes out as within one batch."""
    docs = frame(spark, odd_texts * 3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = Counter(map(tuple, run(docs).collect()))
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        assert Counter(map(tuple, run(docs).collect())) == whole
    finally:
        spark.conf.set(name, before)


def test_rollup_two_writers(spark):
    """Two writers that both look before either commits count a batch once; so does a reader while both folders are there."""
    path = shared_folder(spark, "rollup")
    changes = token_rollup.inserts(frame(spark, ["a b", "c " * 50_000, "a b", None]), "w", token_rollup.count_words())
    one, two = token_rollup.TokenRollup(spark, path), token_rollup.TokenRollup(spark, path)
    for writer in ("1", "2"):
        token_rollup.signed(changes).write.parquet(f"{path}/_aside/b-{writer}")
    assert one._settle("b", "2", f"{path}/_aside/b-2")
    assert one.totals().collect()[0].tokens == 50_004
    fs, source = two._files(f"{path}/_aside/b-1")
    fs.rename(source, two._files(f"{path}/batch_id=b/writer=1")[1])
    assert [(r.docs, r.tokens) for r in two.totals().collect()] == [(4, 50_004)] and not two.commit("b", changes)
    token_rollup.signed(changes).write.parquet(f"{path}/_aside/b-3")
    assert not two._settle("b", "3", f"{path}/_aside/b-3") and two._writers("b") == ["1", "2"]
    assert token_rollup.TokenRollup(spark, shared_folder(spark, "rollup")).totals().count() == 0


@pytest.mark.parametrize("run", [
    exact_dedup.exact_dedup, suffix_dedup.suffix_dedup, jaccard_join.jaccard_join, language_id.language_id, mixing.mix, license_scan.license_scan, pii_surrogates.pii_surrogates,
    lambda d: bpe.bpe_digests(d, PATH, PATTERN), lambda d: ego_join.ego_join(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, ["x"]).where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    vocab = {"en": "the of and to in is was that for with".split(), "de": "der die und das nicht ist eine mit für".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(vocab[lang]) + str(rng.randrange(300)) for _ in range(60)), lang, rng.choice("ab"), 1))
    rows += [(200, rows[0][1], "en", "a", 1), (201, rows[1][1] + " end", rows[1][2], "a", 1), (202, "12 34", None, "a", 1), (203, None, "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        counts.append(len(kept[-1]))
    assert kept[0] == {*range(120), 200, 201} and kept[1] == {*range(120), 201} and kept[2] == set(range(120)) and kept[3] < kept[2] and kept[4] == kept[3] and kept[3]
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: (r.n_tokens, r.ids_sha256) for r in docs.collect()}


def test_pipeline_stages_decide_by_rows(spark):
    import corpus_pipeline

    rng = random.Random(4)
    a, b, c, d = (words(rng, 80, 5000) for _ in range(4))
    rows = [(None, a), (None, b), (1, c), (1, c), (2, d), (2, c), (3, a + " more"), (4, "  " + d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    exact = corpus_pipeline.drop_copies(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == Counter([(None, a), (None, b), (1, c), (3, a + " more"), (4, "  " + d)])
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter([(None, b), (1, c), (2, d), (3, a + " more")])


def test_jaccard_join_compares_the_smallest_text_of_an_id(spark):
    rng = random.Random(6)
    texts = [words(rng, 60, 5000) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 10, t) for i, t in enumerate(texts)] + [(i + 10, "~ " + words(rng, 60, 5000)) for i in range(6)]
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), n_words=3, percent=80).collect()}
    assert found == {i: i % 10 for i in (*range(6), *range(10, 16))}


def test_parity_masks_never_overstate_differences():
    rng = np.random.default_rng(8)
    for size in (0, 1, 5, 150, 3000):
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        y = np.unique(np.concatenate((x[: len(x) * 9 // 10], rng.integers(0, 2**63, size // 8, dtype=np.uint64))))
        bits = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(jaccard_join.parity_mask(x), jaccard_join.parity_mask(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_jaccard_index_leaves_out_near_sets_that_cannot_link(spark):
    """Sets of one large cluster that share too little for a link do not meet, however many they are; linked ones do."""
    common, own = list(range(1000, 1340)), 60
    rows = [(i, list(range(10_000 + i * 100, 10_000 + i * 100 + own)) + common) for i in range(150)]
    rows += [(900, common[:40] + list(range(5000, 5360))), (901, common[:39] + [99_999] + list(range(5000, 5360)))]
    n = jaccard_join.prefix_size(400, 80)
    sets = [(i, i, 0.0, i, len(x), *jaccard_join.parity_mask(jaccard_join.mix64(np.array(x, np.uint64))), x[:n]) for i, x in rows]
    sets = spark.createDataFrame(sets, "id bigint, leader bigint, radius double, part bigint, size int, m0 bigint, m1 bigint, prefix array<bigint>")
    assert [(r.a, r.b) for r in jaccard_join.index_pairs(sets, 80).collect()] == [(900, 901)]
