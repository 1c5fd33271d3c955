"""Spelling variants against all pairs of words, and odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from voxlake.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, key string, band int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "w", 5, "k", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts, ids=None, least=7, least_n=2, one_in=31, times=10):
    low = {i: i + 32 for i in range(65, 91)}
    counts = Counter()
    for i, text in zip(ids or range(len(texts)), texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= least_n}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_against_all_pairs(spark):
    rng = random.Random(5)
    letters = "abcdeé÷Èxyzß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(25)]
    texts = []
    for _ in range(60):
        words = []
        for w in rng.choices(base, weights=[3**-i + 0.01 for i in range(len(base))], k=80):
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.2 else w)
        texts.append(rng.choice([" ", "-", "1"]).join(words))
    want = brute(texts, one_in=5)
    assert got(spelling.spelling_variants(frame(spark, texts), one_in=5)) == want
    assert sum(v[3] for v in want.values()) > 100 and any(v[0] for v in want.values())


def test_chains_lead_to_the_last_form(spark):
    texts = ["abcdefgh " * 2, "abcdefgx " * 20, "abcdefyx " * 200, "abcdezyx " * 2000]
    want = brute(texts)
    assert got(spelling.spelling_variants(frame(spark, texts))) == want
    assert want["abcdefgh"][1] == "abcdezyx"


def test_odd_texts(spark):
    texts = [None, "", "  ", "short", "balloon balloons ballon balloon", "balloons " * 20_000, "z" * 50_000 + " " + "z" * 50_000, "Éclairés éclairés Éclairés", "x" * 7 + "İ" + "y" * 7, "a" * 7 + " " + "a" * 8, "a" * 7 + " " + "a" * 8]
    ids = [None, 1, 2, 3, 4, 5, 6, None, 8, 9, 9]
    docs = frame(spark, texts, ids)
    assert got(spelling.spelling_variants(docs)) == brute(texts, ids)
    assert got(spelling.spelling_variants(docs.union(docs))) == brute(texts * 2, ids * 2)
    assert spelling.spelling_variants(docs.where("false")).count() == 0
    assert spelling.spelling_variants(docs.where("doc_id = 3")).count() == 0


def test_linked_words_share_a_band_and_a_half(spark):
    """Whatever the edit, one band of the masks is the same."""
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßÿÀ") for _ in range(rng.randrange(7, 12)))
        i = rng.randrange(len(w))
        pairs.append((w, rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "é" + w[i + 1 :]])))
    df = spark.createDataFrame(pairs, "a string, b string").select(spelling.parity_mask(F.col("a")).bitwiseXOR(spelling.parity_mask(F.col("b"))).alias("x"))
    assert all(bin(r.x & (1 << 64) - 1).count("1") <= 2 for r in df.collect())
