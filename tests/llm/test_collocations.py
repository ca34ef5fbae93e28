import random
import re
from collections import Counter

import numpy as np
import pytest

from cmdlens.llm import collocations

from .cases import awkward, frame

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count=10, top=2000, share=50):
    """The contract with Python's dictionaries and integers."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, w[i:i + k]) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    held = {(lang, w[i:i + 2]) for (lang, w), a in cand.items() if len(w) == 3 for i in (0, 1) if 100 * a >= share * f[lang, w[i:i + 2]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) in held:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.mine(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n, length):
    r = random.Random(seed)
    vocab = ["a", "A", "b", "the", "\x01x", "é", "the\x02", "z" * 40, "日本", "k", "of", "new york", "York new city"]
    return [(i, "".join(r.choices(vocab, [8, 3, 4, 20, 1, 2, 1, 1, 1, 3, 9, 5, 5])[0] + r.choice([" ", " ", " ", "\t", "  ", ", ", "\n"])
                        for _ in range(length)), r.choice(["en", "en", None, "und"]), None) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"per_partition": 40, "block": 64, "slice_bytes": 50}, {"top": 3, "min_count": 2, "held_share": 80}])
def test_collocations_against_brute_force(spark, options):
    """Small blocks, slices and partitions: phrases over block ends, groups over partition ends."""
    rows = [(*r, None, 1, "s", "t", 0, None) for r in corpus(1, 60, 40)]
    want = brute(rows, options.get("min_count", 10), options.get("top", 2000), options.get("held_share", 50))
    assert want and mined(frame(spark, rows).repartition(4), **options) == want


def test_awkward_rows_long_text_and_a_hot_word(spark):
    rows = awkward() * 12
    assert mined(frame(spark, rows)) == brute(rows)
    hot = [(1, "the cat " * 50_000 + ". ".join(["the dog barks"] * 3000), "en", None, None, 1, "s", "t", 0, None)]
    assert mined(frame(spark, hot), block=4096, per_partition=500) == brute(hot)
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, None, None, None, None, 1, "s", "t", 0, None)])) == []


def test_many_languages_share_a_task(spark):
    rows = [(i, "to be or not to be " * 6, f"l{i % 40}", None, None, 1, "s", "t", 0, None) for i in range(120)]
    assert mined(frame(spark, rows).coalesce(1), block=256) == brute(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    r = random.Random(2)
    rows = [(a, a + r.randrange(10 ** 14), a + r.randrange(10 ** 13)) for a in (r.randrange(10, 10 ** 15) for _ in range(200))]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [x[0] for x in df.select(collocations._score(df.a, df.l, df.r)).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_packed_runs_come_back():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 62, 1000))
    third, counts = np.arange(1000, dtype=np.int64) % 7, np.arange(1000, dtype=np.int64) + 1
    back = collocations._unpacked(collocations._packed(keys, third, counts))
    assert all((x == y).all() for x, y in zip(back, (keys, third, counts)))
