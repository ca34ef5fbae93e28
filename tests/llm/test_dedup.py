import random

import numpy as np
import pytest
import xxhash

from cmdlens.llm import anchor_dedup, chunk_dedup, line_spread, simhash_dedup
from cmdlens.llm.common import keep_rows, text_key

from .cases import awkward, classes, frame, removed_windows, simhash, simple


def groups(rows):
    """op5's contract by brute force: {(doc_id, text): (keep, size)} for rows with distinct keys."""
    out = {}
    for d, t, *_ in rows:
        norm = "".join((t or "").translate({c: None for c in b" \t\n\x0b\x0c\r"}))
        out.setdefault(norm, []).append((-len(t or ""), d is None, d, t))
    return out


def test_exact_dedup_awkward_rows(spark):
    rows = awkward()
    df = frame(spark, rows)
    for digest_chars in (32, 1):  # one hex digit: digests collide, recipes of the chunks themselves take over
        out = chunk_dedup.deduplicate(df, digest_chars).collect()
        assert len(out) == len(rows)
        want = groups(rows)
        assert sum(r.kept for r in out) == len(want)
        assert sorted(r.group_size for r in out) == sorted(len(v) for v in want.values() for _ in v)
        keep = {min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2] for v in want.values()}
        assert {r.keep_id for r in out} == keep
    assert chunk_dedup.has_collision(chunk_dedup.cut_texts(df, 1)) and not chunk_dedup.has_collision(chunk_dedup.cut_texts(df))
    kept = chunk_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(groups(rows))
    assert chunk_dedup.deduplicate(frame(spark, [])).count() == 0


def test_chunks_are_cut_by_content(spark):
    from pyspark.sql import functions as F
    r = random.Random(2)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz.,!") for _ in range(60_000))
    df = simple(spark, [(1, text), (2, "inserted" + text), (3, "語" * 10_000), (4, "")])
    parts = [x.c for x in df.orderBy("doc_id").select(chunk_dedup.chunks(chunk_dedup.normalised(F.col("text"))).alias("c")).collect()]
    assert ["".join(p) for p in parts] == [text, "inserted" + text, "語" * 10_000, ""]
    assert all(len(c) <= chunk_dedup.MAX_CHUNK for p in parts for c in p)
    assert len(set(parts[0]) & set(parts[1])) > 0.8 * len(parts[0])  # one insertion leaves the other chunks


def test_keep_rows_takes_one_of_equal_rows(spark):
    df = simple(spark, [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None)])
    keys = df.filter("text = 'a' or text is null").select(text_key(df.doc_id, df.text).alias("_key"))
    assert sorted(map(str, keep_rows(df, keys).select("doc_id", "text").collect())) == sorted(
        map(str, simple(spark, [(1, "a"), (None, None)]).select("doc_id", "text").collect()))


def test_substring_dedup_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    base = [r.choice(["a", "b", "é", "c", "dd", "ee", "ff"]) for _ in range(400)]
    pairs = []
    for i in range(120):
        s, n, k = r.randint(0, 300), r.randint(0, 90), r.random()
        w = base[s:s + n]
        if k < .3:
            w = w + [r.choice("abc") for _ in range(10)] + base[s + 3:s + 60]
        if k > .9:
            w = ["x"] * r.randint(0, 70)
        if k > .95:
            w = ["x", "y"] * 40
        if w and r.random() < .5:
            w[r.randrange(len(w))] = f"Z{r.randint(0, 9)}"
        pairs.append((i * 3, r.choice([" ", "\n", "  "]).join(w)))
    pairs += [(1, None), (2, ""), (None, " ".join(base[:50])), (700, "one"), (701, " ".join(base) * 3), (702, " ".join(base) * 3)]
    want = removed_windows(pairs)
    for limit in (24 << 20, 2000):  # one block, many blocks
        monkeypatch.setattr(anchor_dedup._blocks, "__defaults__", (limit,))
        got = sorted(map(tuple, anchor_dedup.digests(simple(spark, pairs)).collect()), key=str)
        assert got == want


def test_substring_dedup_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = anchor_dedup.digests(simple(spark, [(5, text)] * 3 + [(None, text)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 60), (False, 60), (False, 60), (True, 0)]
    rows = anchor_dedup.digests(frame(spark, awkward())).collect()
    assert len(rows) == len(awkward()) and anchor_dedup.digests(frame(spark, [])).count() == 0


def test_difference_cover():
    d = {(a - b) % anchor_dedup.PERIOD for a in anchor_dedup.COVER for b in anchor_dedup.COVER}
    assert d == set(range(anchor_dedup.PERIOD))


def test_line_spread(spark):
    rows = [(i, f"  Share this page \nbody {i}\n\ncommon to two", None, f"s{i % (12 if i < 30 else 1)}", None, 1, "", "", 0, None) for i in range(40)]
    rows += [(100, None, None, "s1", None, 1, "", "", 0, None), (101, "", None, None, None, 1, "", "", 0, None),
             (102, "Share this page\tx", None, None, None, 1, "", "", 0, None)]
    df = frame(spark, rows)
    for lines, least in (({"Share this page", "common to two"}, 12), (set(), 13)):
        out = {r.doc_id: r for r in line_spread.remove_boilerplate(df, "source", least).collect()}
        assert len(out) == len(rows)
        for i in range(40):
            kept = [x for x in f"  Share this page \nbody {i}\n\ncommon to two".split("\n") if x.strip() not in lines]
            assert (out[i].kept_text, out[i].n_lines, out[i].n_removed) == ("\n".join(kept), 4, 4 - len(kept))
        assert (out[100].kept_text, out[100].n_lines, out[101].n_removed, out[102].n_removed) == ("", 1, 0, 0)
    assert line_spread.remove_boilerplate(frame(spark, [])).count() == 0
    assert line_spread.remove_boilerplate(frame(spark, awkward())).count() == len(awkward())


def test_exact_counts_decide_near_the_threshold(spark):
    """A wide band sends every line to the exact count: same lines."""
    rows = [(i, "a\nb", None, f"s{i % 9}", None, 1, "", "", 0, None) for i in range(30)] + [(99, "b\nc", None, "s99", None, 1, "", "", 0, None)]
    df = frame(spark, rows)
    for band in (0.0, 0.15, 0.9):
        assert line_spread.boilerplate(df, min_sites=9, band=band).count() == 2
        assert line_spread.boilerplate(df, min_sites=10, band=band).count() == 1


@pytest.mark.parametrize("bits,group", [(1, 65_536), (3, 65_536), (3, 6), (3, 2), (5, 65_536), (5, 4), (2, 4)])
def test_simhash_links_against_brute_force(spark, bits, group):
    r = random.Random(bits)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        x = r.choice(fps)
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash_dedup.links(df, bits, group)
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= bits for e in edges.collect())
    label = {r.fp: r.label for r in simhash_dedup.components(edges).collect()}
    want = classes(fps, bits)
    got = [label.get(x, x) for x in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_crowded_variants_are_dealt_by_their_other_bits(spark):
    """Fingerprints equal in one half: no group of the index holds them all, no link is lost."""
    from pyspark.sql import functions as F
    r = random.Random(12)
    fps = [r.getrandbits(32) << 32 | 0xBEEF for _ in range(1500)]
    fps += [x ^ 1 << r.randrange(32, 64) ^ 1 << r.randrange(64) for x in fps[:300]]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    assert simhash_dedup.variants(df).groupBy("v").count().agg(F.max("count")).first()[0] > 1500
    sizes = simhash_dedup.variants(df, group=200).groupBy("v").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200
    label = {x.fp: x.label for x in simhash_dedup.components(simhash_dedup.links(df, group=200)).collect()}
    got = [label.get(int(np.uint64(x).astype(np.int64)), x) for x in fps]
    want = classes(fps)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) < len(fps)


def test_dense_group_is_linear_and_exact():
    """A large ball around one fingerprint: fewer edges than members, same components."""
    r = random.Random(9)
    centre = r.getrandbits(64)
    fps = set()
    while len(fps) < 1500:
        x = centre
        for b in r.sample(range(64), r.randint(0, 7)):
            x ^= 1 << b
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    edges = simhash_dedup._forest(fps, 3)
    assert len(edges) < len(fps)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        assert int(fps[a] ^ fps[b]).bit_count() <= 3
        parent[find(a)] = find(b)
    want = classes([int(x) for x in fps])
    assert len({(w, find(i)) for i, w in enumerate(want)}) == len(set(want))


def test_simhash_documents(spark):
    rows = awkward()
    df = frame(spark, rows)
    out = simhash_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    fps = [simhash(r[1], xxhash.xxh64_intdigest) for r in rows]
    want = classes(fps)
    least = {}
    for (d, *_), c in zip(rows, want):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    expected = sorted(str((r[0], f"{f:016x}", least.get(c))) for r, f, c in zip(rows, fps, want))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in out) == expected
    kept = simhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(want))
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0
