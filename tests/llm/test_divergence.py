"""Differences between sources against a plain count, and odd inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term string, g int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 9, "t", 1) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


def brute(rows, least, top=50):
    low = {i: i + 32 for i in range(65, 91)}
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        langs[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def got(df):
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    terms = [f"{a}{b}" for a in "abcdefgé中Ω" for b in "xyzÄñ"]
    out = []
    for _ in range(400):
        source = f"s{int(rng.paretovariate(0.7)) % 11}"
        at = int(source[1:])
        out.append((rng.choice([" ", ".", "7"]).join(rng.choices(terms[at : at + 25], k=rng.randrange(30))), rng.choice(["en", "de", None]), source))
    return [*out, (None, "xx", None), ("", "xx", ""), ("...", "en", "empty"), ("A a À à", None, None), ("lonely", "zz", "one")]


def test_against_counts(spark, rows):
    docs = frame(spark, rows).repartition(6)
    assert got(divergence.source_divergence(docs, least_docs=5)) == brute(rows, 5)
    assert got(divergence.source_divergence(docs, least_docs=5, top=3)) == brute(rows, 5, 3)
    assert got(divergence.source_divergence(docs.union(docs), least_docs=5)) == brute(rows * 2, 5)
    assert got(divergence.source_divergence(docs, least_docs=10**6)) == brute(rows, 10**6)
    assert divergence.source_divergence(docs.where("false")).count() == 0


def test_blocks_chunks_and_spans(spark, rows):
    """Small blocks, chunks and spans give the same sums, and so do counts handed on early."""
    docs = frame(spark, rows).select("lang", "source", F.coalesce("text", F.lit("")).alias("text")).na.fill("")
    counts = divergence.term_counts(docs, 5, held=20)
    named = divergence.groups(docs, counts)
    values = divergence.pair_values(divergence.packed(counts, named, 4), named, 4, 2, 3)
    assert {(r.lang, r.source, r["item"], r.value) for r in values.collect()} == {(lang, s, item, v) for lang, s, part, item, v, _ in brute(rows, 5) if part == "pair"}


def test_long_texts_are_split_in_pieces(spark, monkeypatch):
    text = ("Ab é1" * 7 + "x" * 50 + " ") * 200
    whole = [t for t in text.encode().translate(divergence._LETTERS).split(b" ") if t]
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert [t for piece in divergence._terms(text.encode().translate(divergence._LETTERS)) for t in piece if t] == whole
    rows = [("word " * 200_000, "en", "a"), ("z" * 3_000_000, "en", "b"), ("word", "en", "b")]
    assert got(divergence.source_divergence(frame(spark, rows), least_docs=1)) == brute(rows, 1)


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        total, v = rng.randrange(8 * 10**15), rng.randrange(1, 10**6)
        n = [rng.randrange(total + 1), total, 0]
        assert divergence.shares(np.array(n, np.int64), total, v).tolist() == [1 + 10**9 * (x + 5) // (total + 5 * v) for x in n]
