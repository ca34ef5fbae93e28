import hashlib
import random

import numpy as np
import pytest

from cmdlens.llm import laesa_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, parts string, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "p", "e") for i, v, lab in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract with Python's integers: [(vec_id, code, error, label_error)], digest."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[v[j * w:(j + 1) * w] for j in range(parts)] for _, v, _ in kept]
    books = [[cut[i][j] for i in range(min(entries, len(kept)))] for j in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(books[j])) for j, p in enumerate(c)] for c in cut]
    for _ in range(rounds):
        at = assign()
        for j in range(parts):
            for k in range(len(books[j])):
                mine = [cut[i][j] for i in range(len(cut)) if at[i][j][1] == k]
                if mine:
                    books[j][k] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), lab) for (i, _, lab), a in zip(kept, assign())]
    by_label = {}
    for _, _, e, lab in out:
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[lab]) for i, c, e, lab in out], digest


def rows_of(df):
    rows = df.collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=str), {r.codebooks_sha256 for r in rows}


def check(spark, rows):
    want, digest = brute(rows)
    got, digests = rows_of(laesa_codes.encode(frame(spark, rows).repartition(3)))
    assert got == sorted(want, key=str) and digests == ({digest} if want else set())


def test_codes_against_brute_force(spark):
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)], r.choice([None, 0, 1])) for i in range(300)]
    rows += [(400 + i, rows[0][1], 7) for i in range(150)]      # a hot vector
    check(spark, rows)


def test_unusable_vectors_nulls_and_ties(spark):
    r = random.Random(4)
    good = [(i, [float(r.randrange(-2, 3)) / 4096 for _ in range(8)], i % 2) for i in range(40)]   # many equal distances
    bad = [(50, None, 1), (51, [], 1), (52, [float("nan")] + [0.0] * 7, 1), (53, [float("inf")] * 8, None), (54, [None] * 8, 0)]
    check(spark, good + bad + [(None, [0.5] * 8, None), (3, [0.25] * 8, 0), (3, [0.25] * 8, 0)])
    check(spark, good[:3])          # fewer vectors than entries
    check(spark, bad)
    check(spark, [])


def test_large_components_are_exact(spark):
    r = random.Random(6)
    check(spark, [(i, [r.uniform(-1, 1) * 10.0 ** r.randrange(0, 6) for _ in range(16)], 0) for i in range(60)])


def test_vectors_of_other_lengths_are_an_error(spark):
    with pytest.raises(ValueError):
        laesa_codes.encode(frame(spark, [(1, [0.0] * 9, 0)]))
    with pytest.raises(Exception, match="differ in length"):
        laesa_codes.encode(frame(spark, [(i, [0.0] * 8, 0) for i in range(20)] + [(30, [0.0] * 16, 0)])).collect()


def test_bounds_prune_exact_evaluations():
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (16, 8))
    parts = centres[r.integers(0, 16, 2000)] + r.integers(-300, 300, (2000, 8))
    pivots = laesa_codes.choose_pivots(centres, 8)
    at, best, evaluated = laesa_codes.nearest(parts, laesa_codes._roots(parts, pivots).astype(np.float32), centres, pivots)
    d = ((parts[:, None] - centres[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    assert evaluated < 0.2 * d.size
