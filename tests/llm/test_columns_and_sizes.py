"""Columns that clash with the operators' own names, extreme ids, many languages, very long texts."""

import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from cmdlens.llm import anchor_dedup, chunk_dedup, hd_langid, line_spread, simhash_dedup, suffix_quality

from .cases import awkward, frame, removed_windows, simple

SCRATCH = ["_verdict", "_row_key", "_Row_Key", "_pseudonyms", "_key", "_v", "_order", "__verdict"]


def test_scratch_names_of_the_caller_stay(spark):
    df = frame(spark, awkward()).select("*", *[F.lit(i).alias(n) for i, n in enumerate(SCRATCH) if n != "_Row_Key"])
    for out in (suffix_quality.keep_good(df), chunk_dedup.drop_duplicates(df), simhash_dedup.drop_near_duplicates(df, 3, 3),
                corpus_pipeline.pseudonyms(spark, df, "")):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[n] == i for r in rows for i, n in enumerate(SCRATCH) if n != "_Row_Key")
    # names are compared without case, as Spark does
    df = frame(spark, awkward()).withColumn("_Row_Key", F.lit(7))
    assert {r["_Row_Key"] for r in chunk_dedup.drop_duplicates(df).collect()} == {7}


def test_smallest_doc_id_is_not_null(spark):
    r = random.Random(1)
    passage = " ".join(r.choice("abcdefgh") for _ in range(60))
    least = -(1 << 63)
    pairs = [(least, passage + " tail"), (None, passage), (least, "x"), (0, passage), ((1 << 63) - 1, passage + " z"), (least + 1, "y")]
    got = sorted((tuple(x) for x in anchor_dedup.digests(simple(spark, pairs)).collect()), key=str)
    assert got == removed_windows(pairs)
    assert sum(x[0] == least for x in got) == 2 and sum(x[0] is None for x in got) == 1


def test_any_number_of_languages(spark):
    """Blocks of prototypes give what one block gives, and more languages than a block holds are scored."""
    r = random.Random(5)
    letters = [chr(c) for c in range(0x400, 0x400 + 40)] + [chr(c) for c in range(0x61, 0x7b)]
    def prose(k, n):
        mine = random.Random(k).sample(letters, 8)
        return " ".join("".join(r.choice(mine) for _ in range(5)) for _ in range(n))
    rows = [(i, prose(i % 9, 30), f"l{i % 9}") for i in range(90)] + [(200, None, "l1"), (201, "12 34", "l2"), (202, "123", "only digits")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = hd_langid.predict(df, hd_langid.learn(df.select("text", "lang"))).orderBy("doc_id").collect()
    few = list(hd_langid.learn(df.select("text", "lang"), block=2))
    assert [len(b) for b in few] == [2, 2, 2, 2, 1]
    again = hd_langid.predict(df, few).orderBy("doc_id").collect()
    assert [(x.doc_id, x.lang_pred, round(x.score, 9)) for x in again] == [(x.doc_id, x.lang_pred, round(x.score, 9)) for x in one]
    assert [x.lang_pred for x in one if x.doc_id < 90] == [f"l{i % 9}" for i in range(90)]
    assert {x.lang_pred for x in one if x.doc_id >= 200} == {"und"}


def test_more_than_two_thousand_languages(spark):
    words = [(i, f"{chr(0x4e00 + i)}{chr(0x4e00 + 7 * i % 2500)}{chr(0x4e00 + 3 * i % 2500)}") for i in range(2100)]
    df = spark.createDataFrame([(i, f"{w} {w}", f"lang{i:05d}") for i, w in words], "doc_id long, text string, lang string")
    sizes = []

    def counted(blocks):
        for b in blocks:
            sizes.append(len(b))
            yield b
    got = hd_langid.predict(df.limit(50), counted(hd_langid.learn(df.select("text", "lang"), 64)), 64).collect()
    assert sizes == [2000, 100] and len(got) == 50
    assert sum(x.lang_pred == x.lang for x in got) >= 49


def brute_lines(pairs, bad):
    out = []
    for d, t, _ in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") not in bad]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_boilerplate_in_long_texts_takes_time_linear_in_lines(spark):
    frequent = [f"notice {i}" for i in range(3000)]
    pairs = [(i, "\n".join(frequent), f"site{i}") for i in range(9)]
    r = random.Random(2)
    pairs += [(100 + i, "\n".join(r.choice([f"  {r.choice(frequent)}\t", "", "own line %d" % r.randrange(10 ** 6)]) for _ in range(40_000)), "site1")
              for i in range(3)]
    df = spark.createDataFrame(pairs, "doc_id long, text string, source string")
    began = time.time()
    got = sorted(tuple(x) for x in line_spread.remove_boilerplate(df).collect())
    assert time.time() - began < 60
    assert got == sorted(brute_lines(pairs, set(frequent)))


def test_boilerplate_edges(spark):
    notice = [(i, "a\nnotice\n\nb", f"s{i}") for i in range(9)]
    pairs = notice + [(20, "notice", "s1"), (21, "notice\nnotice", "s1"), (22, "x\nnotice", None), (23, "notice\nx", "s2"), (24, "", "s1"),
                      (25, None, "s1"), (26, "\n\n", "s3"), (21, "notice\nnotice", "s1")]
    df = spark.createDataFrame(pairs, "doc_id long, text string, source string")
    got = sorted(tuple(x) for x in line_spread.remove_boilerplate(df).collect())
    assert got == sorted(brute_lines(pairs, {"a", "notice", "b"}))


def test_long_texts_through_the_other_operators(spark):
    """Texts of a megabyte: whole, and equal to what short rules say."""
    r = random.Random(9)
    long = "".join(r.choice("abcdefghij .\n") for _ in range(1_000_000))
    df = simple(spark, [(1, long), (2, long + " "), (3, "z" * 1_000_000), (4, "short text")])
    groups = {x.doc_id: (x.keep_id, x.group_size) for x in chunk_dedup.deduplicate(df).collect()}
    assert groups == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    words = [w for w in long.split()]
    cut = {x.doc_id: (x.n_words, x.n_removed) for x in anchor_dedup.digests(df).collect()}
    assert cut[2] == (len(words), len(words)) and cut[3] == (1, 0)
    near = {x.doc_id: x.component_id for x in simhash_dedup.near_duplicates(df, 3, 3).collect()}
    assert near[1] == near[2] == 1
