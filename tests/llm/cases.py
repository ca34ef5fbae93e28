"""Small documents that hold the awkward cases, and brute-force versions of the contracts."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pii int, size string, shard string, kept int, hash int"


def words(text):
    return WORD.findall(text or "")


def awkward(seed=7):
    """Nulls everywhere, empty, long, equal and repeated rows; extra columns with clashing names."""
    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "λ", "mu"]

    def prose(n):
        return "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))

    base = prose(120)
    texts = [None, "", " \n\t ", "one", "a b", base, base, base.replace(" ", "  "), base + " tail", prose(40) + base[:400],
             prose(3000), "x " * 200, "日本語 テキスト", "mail me@example.com or 4111 1111 1111 1111", prose(25), prose(60)]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3]) for i, t in enumerate(texts)]
    rows += [(5, base, "en", "s1"), (5, base, "en", "s1"), (None, base, None, None), (None, None, None, None), (None, prose(30), "fr", "s2")]
    return [(d, t, lang, src, len(t) if t is not None else None, 1, "s", "t", 0, None) for d, t, lang, src in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def simple(spark, pairs, lang=None, source="s"):
    return frame(spark, [(d, t, lang, source, None, 1, "s", "t", 0, None) for d, t in pairs])


def removed_windows(pairs, window=20):
    """op4's contract on rows in order of doc_id (null first)."""
    seen, out = set(), []
    for d, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            if k in seen:
                gone[p:p + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def simhash(text, xxh):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not low:
        return 0
    shingles = [b" ".join(low[i:i + 3]) for i in range(max(1, len(low) - 2))]
    hashes = [xxh(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, bits=3):
    """Representative of each index: components of links at ``bits`` or fewer differing bits."""
    parent = list(range(len(fingerprints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fingerprints))]
