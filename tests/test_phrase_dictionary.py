import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cmdlens.operators import phrase_dictionary
from cmdlens.operators.byte_match import TextFinder, WordMatcher
from cmdlens.operators.phrase import phrase_match
from cmdlens.operators.phrase_dictionary import match_phrases, word_matches


def typo(r, w):
    i = r.randrange(len(w) + 1)
    return r.choice([w[:i] + r.choice("abé") + w[i:], w[:max(0, i - 1)] + w[i:], w[:max(0, i - 1)] + r.choice("xyü") + w[i:]])


def test_many_phrases_equal_each_phrase_alone(spark):
    r = random.Random(11)
    vocab = ["a", "b", "git", "commit", "status", "kubectl", "déploiement", "configuration", "internationalisation", "infrastructure-as-code", "日本語"]
    def command():
        words = [r.choice(vocab) for _ in range(r.randrange(1, 9))]
        return r.choice([" ", "/", "=", " | "]).join(typo(r, w) if r.random() < 0.4 else w for w in words)
    rows = [(i, command()) for i in range(250)] + [(900, None), (901, ""), (902, "GIT COMMIT"), (903, "commit git commit")]
    phrases = [(k, " ".join(typo(r, w) if r.random() < 0.3 and len(w) > 1 else w for w in r.choices(vocab, k=r.randrange(1, 4)))) for k in range(60)]
    phrases += [(100, "  Git   Commit "), (101, "   "), (102, ""), (103, "commit commit"), (104, "a"), (105, "git commit")]
    df = spark.createDataFrame(rows, "hash long, cmd string").repartition(3)
    got = {(x.hash, x.phrase_id): x.exact for x in match_phrases(df, phrases).collect()}
    want = {}
    for start in range(0, len(phrases), 11):          # a few phrases per plan
        block = phrases[start:start + 11]
        cols = [c for i, p in block for c in (phrase_match(F.col("cmd"), p)[0].alias(f"m{i}"), phrase_match(F.col("cmd"), p)[1].alias(f"e{i}"))]
        for x in df.select("hash", *cols).collect():
            want.update({(x.hash, i): x[f"e{i}"] for i, _ in block if x[f"m{i}"]})
    assert got == want and len(want) > 300


def test_word_matches_against_all_pairs(spark):
    r = random.Random(2)
    words = {w.encode().decode("latin-1"): max(1, len(w.encode()) // 5) for w in
             ["a", "ab", "status", "deployment", "configuration", "internationalisation", "abcdefghijklmnopqrstuvwxyz"]}
    tokens = sorted({t for w in words for _ in range(60) for t in [typo(r, typo(r, typo(r, w)))] if t} | {"q", "xx", "prefix-status-x"})
    tokens = [t.encode().decode("latin-1") for t in tokens]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {(x.token, x.word) for x in word_matches(df, words).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]
    assert got == {(t, w) for t in tokens for w, e in words.items() if w in t or distance(t, w) <= e}


def test_no_phrase_and_no_row(spark):
    df = spark.createDataFrame([(1, "x")], "hash long, cmd string")
    assert match_phrases(df, [(1, " ")]).collect() == [] and match_phrases(df, []).collect() == []
    assert match_phrases(df.limit(0), [(1, "x")]).collect() == []


def test_frequent_word_of_many_phrases(spark):
    """A word that every token matches and every phrase holds: 240 million (token, phrase) pairs, few results."""
    rows = [(i, " ".join(["a"] * 400 + [f"end{i:04d}"])) for i in range(200)]
    phrases = [(k, f"a a zq{k:05d}") for k in range(3000)] + [(9000 + k, f"a a END{k:04d}") for k in range(3)]
    begun = time.time()
    got = {(x.hash, x.phrase_id): x.exact for x in match_phrases(spark.createDataFrame(rows, "hash long, cmd string").repartition(4), phrases).collect()}
    assert {k for k, exact in got.items() if exact} == {(i, 9000 + i) for i in range(3)}
    near = {(i, 9000 + k) for i in range(200) for k in range(3) if sum(x != y for x, y in zip(f"{i:04d}", f"{k:04d}")) <= 1}
    assert set(got) >= near and all(p >= 9000 for _, p in got)
    assert time.time() - begun < 90


def test_rows_of_one_key_and_phrases_of_one_id(spark):
    """Rows of a key (null is one) count together, by the places of their tokens; an id with many texts comes once."""
    rows = [(1, "git x"), (1, "y commit"), (2, "git"), (None, "kubectl a"), (None, "b pods"), (3, None)]
    phrases = [(7, "git commit"), (7, "git"), (8, "y x"), (9, "x commit"), (10, "kubectl pods"), (11, "get commit"), (12, "| |"), (13, "b pods")]
    got = {(x.hash, x.phrase_id): x.exact for x in match_phrases(spark.createDataFrame(rows, "hash long, cmd string").repartition(4), phrases).collect()}
    assert got == {(1, 7): True, (2, 7): True, (1, 8): False, (None, 10): False, (1, 11): False, (None, 12): False, (1, 12): False, (None, 13): True,
                   (None, 8): False, (1, 9): False}      # one letter is an edit from another
    same_texts = match_phrases(spark.createDataFrame([(1, "git commit")], "hash long, cmd string"), [(k, p) for k, (_, p) in enumerate(phrases)])
    assert {(x.hash, x.phrase_id) for x in same_texts.collect()} == {(1, 0), (1, 1), (1, 5)}
    assert match_phrases(spark.createDataFrame([(1, None), (2, "")], "hash long, cmd string").coalesce(1), phrases).collect() == []


def test_many_words_and_no_exchange_of_what_is_found(spark):
    """18,000 distinct words: they are looked up, not listed in the plan; what is found is not dealt out again."""
    r = random.Random(3)
    def word():
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(6, 12)))
    phrases = [(k, f"{word()} {word()} {word()}") for k in range(6000)]
    rows = [(k, " ".join([word()] * 20 + [p.replace(" ", f" {word()} ")])) for k, p in phrases[:300]] + [(9000, f"-{phrases[5][1]}-")]
    begun = time.time()
    found = match_phrases(spark.createDataFrame(rows, "hash long, cmd string").repartition(4), phrases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {(x.hash, x.phrase_id): x.exact for x in found.collect()}
    assert got == {**{(k, k): False for k in range(300)}, (9000, 5): True}
    assert time.time() - begun < 40
    assert "Exchange" not in plan[:plan.index("MapInArrow")] and plan.count("Exchange hashpartitioning") == 1


def test_chunks_keep_the_rows_of_a_key_together(monkeypatch):
    monkeypatch.setattr(phrase_dictionary, "CHUNK_BYTES", 60)
    keys = [None, None, 1, 1, 1, 1, 1, 2, 3, 4, 4, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 2], pa.int64()), pa.array([b"x" * 9, None])], ["_k", "_t"]) for i in range(0, 12, 2)]
    parts = [(k.to_pylist(), t.to_pylist()) for k, t in phrase_dictionary._chunks(iter(batches))]
    assert sum((k for k, _ in parts), []) == keys and sum((t for _, t in parts), []) == [b"x" * 9, None] * 6
    assert len(parts) > 2 and all(a[0][-1] != b[0][0] for a, b in zip(parts, parts[1:]))


def test_byte_strings_against_each_alone():
    r = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def ranges(strings):
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    for some in range(4):
        def string(n):
            return bytes(r.choice(b"ab\x00\xff"[:some + 2 if some < 3 else 2]) for _ in range(n))
        words = sorted({string(r.choice([1, 2, 3, 5, 7, 9, 10, 12, 14, 15, 17, 22, 31])) for _ in range(25)})
        edits = [max(1, len(w) // 5) if some else r.randrange(len(w) + 2) for w in words]
        tokens = sorted({t for w in words for t in (w[:-1], w + string(1), string(2) + w[3:], string(3) + w, w[:2] + string(2) + w[5:], w[2:7] + w[8:]) if t})
        counts, word = WordMatcher(words, edits).match(*ranges(tokens))
        got = set(zip(np.repeat(np.arange(len(tokens)), counts).tolist(), word.tolist()))
        assert got == {(i, j) for i, t in enumerate(tokens) for j, w in enumerate(words) if w in t or distance(t, w) <= edits[j]}
        texts = [string(r.randrange(60)) for _ in range(30)]
        for step in (3, 1 << 18):
            text, word = TextFinder(words).find(*ranges(texts), step)
            assert list(zip(text.tolist(), word.tolist())) == [(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t]
