"""Secret scan: known forms, and a battery of randomness tests (DataFrame functions only).

Known forms (assignments, access keys, hexadecimal digests) are spans by rule.
Other tokens are judged by how random they look. A token's *encoding* is the
smallest alphabet that holds it; three statistics compare it with what names,
paths and words spelled in that alphabet look like (the null hypothesis):

* chi-squared against a uniform alphabet: text repeats its letters,
* runs of letters of one class (lower, upper, digit): text changes class rarely,
* serial correlation of neighbours' places in the alphabet: text stays near.

Each is standardised by its null moments at the token's length, so a short token
cannot reach a small p-value; the three, each up to ``Z_MAX`` so that none outweighs
the others (``a1b2c3...`` changes class at every sign), are combined (Stouffer) and the
discoveries are chosen per length class by the Benjamini-Hochberg step-up rule
over all tokens of the corpus, which bounds the expected share of false ones in
each class: many long random tokens do not loosen the rule for short ones.

The rule needs the whole distribution of p-values, but only their counts: p is
rounded up to one of ``P_BINS`` values, so a table of length classes x bins (a
fixed size) takes the place of a sort of all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# kind, pattern, test of a match; in the order in which kinds are listed
ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?")
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
MIN_VALUE = 6
# a run fails its length exactly where no part of it could pass, so the length may be asked for while matching
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

# A candidate is a whole run of the widest alphabet, not a name that a value follows. An assignment
# that begins before it is passed over, so that no candidate lies in its value.
_SIGN = r"A-Za-z0-9+/_-"
TOKEN = rf"(?<![{_SIGN}])[{_SIGN}]{{20,}}+={{0,2}}(?!=*[\"']?\x20*[:=])"
CANDIDATE = rf"(?:{ASSIGN}{ASSIGN_VALUE})|{TOKEN}"

# encoding: signs of a token, and its alphabet in order. First that matches; letters and digits must both occur.
ENCODINGS = [
    ("hex", r"[0-9A-F]+|[0-9a-f]+", "0123456789abcdef"),
    ("base32", r"[A-Z2-7]+", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", r"[0-9A-Z]+|[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"[0-9A-Za-z+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"[0-9A-Za-z_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
# What text spelled in an alphabet looks like: chance that two of its signs are equal, sum of cubed
# shares, chance that neighbours differ in class, correlation of neighbours. Parameters of the null.
_TWO_CASES = (0.058, 0.0046, 0.35, 0.30)
NULL = {"hex": (0.13, 0.022, 0.25, 0.20), "base32": (0.065, 0.0055, 0.12, 0.20), "base36": (0.065, 0.0055, 0.12, 0.20),
        "base62": _TWO_CASES, "base64": _TWO_CASES, "base64url": _TWO_CASES}
LENGTH_CLASSES = [24, 32, 40, 64, 128]     # upper ends (exclusive) of all classes but the last
ALPHA = 0.01                               # false share of the discoveries in a length class
Z_MAX = 4.0
BIN_PER_DECADE, P_BINS = 50, 1000          # p-values 10^(-bin/50), down to 10^-20
_STEP = 128


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _offsets(lengths: Column) -> Column:
    """Sums of the lengths before each item: per block of items, then inside it (linear up to the
    number of blocks, whose running sums are copied)."""
    def total(xs):
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def in_block(block, before):
        return F.transform(block, lambda _, i: before + total(F.slice(block, 1, i)))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(_STEP)), lambda at: F.slice(lengths, at, _STEP))

    def with_sums(b):
        sums = F.aggregate(F.transform(b, total), F.array(F.lit(0)),
                           lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + s))
        return _let(sums, lambda before: F.flatten(F.transform(b, lambda x, i: in_block(x, F.get(before, i)))))
    return _let(blocks, with_sums)


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct(value, start)> of the leftmost, non-overlapping matches; start in code points."""
    def located(found):
        def placed(gaps):
            # before match i: gaps 0..i and matches 0..i-1
            steps = F.transform(found, lambda v, i: F.char_length(F.get(gaps, i)) + F.char_length(v))
            return _let(steps, lambda st: _let(_offsets(st), lambda before: F.transform(
                found, lambda v, i: F.struct(v.alias("value"), (F.get(before, i) + F.char_length(F.get(gaps, i))).alias("start")))))
        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), placed)).otherwise(
            F.array().cast("array<struct<value:string,start:int>>"))
    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), located)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (the rational approximation in 1 / (1 + 0.2316419 z))."""
    x = F.abs(z)
    t = F.lit(1.0) / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _inferred(token: Column) -> Column:
    """Index of the first encoding that holds the token, null if none does or it lacks letters or digits."""
    at = F.when(~token.rlike("[0-9]") | ~token.rlike("[A-Za-z]"), F.lit(None).cast("int"))
    for i, (_, signs, _) in enumerate(ENCODINGS):
        at = at.when(token.rlike(f"^(?:{signs})$"), F.lit(i))
    return at


def _parameters() -> Column:
    """Alphabet and null moments of each encoding."""
    def one(name, alphabet):
        pair, triple, change, near = NULL[name]
        return F.struct(
            F.lit(alphabet).alias("alphabet"), F.lit(alphabet == alphabet.lower()).alias("one_case"),
            F.lit(pair).alias("pair"), F.lit(triple).alias("triple"), F.lit(change).alias("change"), F.lit(near).alias("near"))
    return F.array(*(one(name, alphabet) for name, _, alphabet in ENCODINGS))


def _battery(token: Column, e: Column) -> Column:
    """Combined standardised statistic of a token in its encoding; larger is more random."""
    n = F.char_length(token).cast("double")
    folded = F.when(e["one_case"], F.lower(token)).otherwise(token)

    # chi-squared = size / n * (sum of squared counts) - n, standardised by its moments under the text's
    # shares: both are the same linear function of the sum of squares
    def squares_of(s):
        return F.aggregate(F.split(e["alphabet"], ""), F.lit(0.0), lambda acc, c: acc + F.pow(
            (F.char_length(s) - F.char_length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0)))
    squares = _let(folded, squares_of)
    pairs = n * (n - 1)
    excess = e["triple"] - e["pair"] * e["pair"]
    z_chi = (n + pairs * e["pair"] - squares) / F.sqrt(2 * pairs * e["pair"] * (1 - e["pair"]) + 4 * pairs * (n - 2) * excess)

    def class_of(c):
        return F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
    changes = F.aggregate(
        F.split(token, ""), F.struct(F.lit(0.0).alias("n"), F.lit(-1).alias("last")),
        lambda acc, c: _let(class_of(c), lambda k: F.struct(
            (acc["n"] + (k != acc["last"]).cast("double")).alias("n"), k.alias("last"))), lambda acc: acc["n"] - 1)
    z_runs = (changes - (n - 1) * e["change"]) / F.sqrt((n - 1) * e["change"] * (1 - e["change"]))

    def z_serial(v):
        sums = F.aggregate(
            v, F.struct(*(F.lit(0.0).alias(x) for x in ("s", "q", "p", "last"))), lambda a, x: F.struct(
                (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["p"] + a["last"] * x).alias("p"), x.alias("last")))

        def of(a):
            mean = a["s"] / n
            spread = a["q"] / n - mean * mean
            # sum of (x_i - mean)(x_{i+1} - mean)
            cross = a["p"] - mean * (2 * a["s"] - F.get(v, F.lit(0)) - a["last"]) + (n - 1) * mean * mean
            r = F.when(spread > 0, F.greatest(F.lit(-0.99), F.least(F.lit(0.99), cross / (n - 1) / spread))).otherwise(0.99)
            # Fisher's transform of the correlation, against that of text
            return _let(r, lambda c: (F.atanh(e["near"]) - F.atanh(c)) * F.sqrt(n - 3))
        return _let(sums, of)

    places = F.transform(F.split(folded, ""), lambda c: F.instr(e["alphabet"], c).cast("double"))
    return sum(F.least(z, F.lit(Z_MAX)) for z in (z_chi, z_runs, _let(places, z_serial))) / 3 ** 0.5


def p_bin(token: Column) -> Column:
    """Bin of a token's p-value, rounded up; null for a token of no encoding."""
    def of(index):
        z = _let(F.get(_parameters(), index), lambda e: _battery(token, e))
        return _let(z, lambda x: F.least(F.lit(P_BINS - 1), F.greatest(F.lit(0), F.floor(
            -BIN_PER_DECADE * F.log10(F.greatest(_normal_tail(x), F.lit(1e-300)))).cast("int"))))
    return _let(_inferred(token), lambda i: F.when(i.isNotNull(), of(i)))


def _length_class(n: Column) -> Column:
    out = F.when(n < LENGTH_CLASSES[0], 0)
    for i, end in enumerate(LENGTH_CLASSES[1:], 1):
        out = out.when(n < end, i)
    return out.otherwise(len(LENGTH_CLASSES))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(kind: int, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["value"])).cast("int").alias("end")))


def examined(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``' doc_id with ``base`` (spans of the known forms) and ``tokens``: (start, end, length
    class, p-value bin) of each token that is tested."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_values = F.filter(spans_of(text, ASSIGN + ASSIGN_VALUE), lambda m: F.char_length(
        F.regexp_extract(m["value"], f"^{ASSIGN}({ASSIGN_VALUE})$", 1)) >= MIN_VALUE)
    base = F.concat(_spans(0, long_values), _spans(1, spans_of(text, ACCESS)), _spans(2, spans_of(text, HEX)))
    free = F.filter(spans_of(text, CANDIDATE), lambda m: ~m["value"].rlike(f"^{ASSIGN}|{ACCESS}|{HEX}"))
    tokens = F.transform(free, lambda m: _let(F.rtrim(m["value"], F.lit("=")), lambda t: F.struct(
        m["start"].alias("start"), (m["start"] + F.char_length(m["value"])).cast("int").alias("end"),
        _length_class(F.char_length(t)).alias("size"), p_bin(t).alias("bin"))))
    return docs.select("doc_id", base.cast(_SPAN).alias("base"), F.filter(tokens, lambda t: t["bin"].isNotNull()).alias("tokens"))


def thresholds(tokens: DataFrame, alpha: float = ALPHA) -> dict[int, int]:
    """Benjamini-Hochberg per length class: the least bin whose p-values are discoveries, by class.

    ``tokens``: one row (size, bin) per tested token. With m tokens in a class and k of them at a
    p-value or below, the largest p with p <= alpha * k / m is taken.
    """
    counts = tokens.groupBy("size", "bin").agg(F.count(F.lit(1)).alias("n"))   # at most classes x bins rows
    below = Window.partitionBy("size").orderBy(F.col("bin").desc())
    ranked = counts.select("size", "bin", F.sum("n").over(below).alias("k"), F.sum("n").over(Window.partitionBy("size")).alias("m"))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BIN_PER_DECADE) * F.col("m") <= F.lit(alpha) * F.col("k"))
    return {r["size"]: r["bin"] for r in passed.groupBy("size").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start, kind, end) in order of
    start and kind; ``kind`` counts through ``KINDS``, offsets are code points, the end is exclusive.

    ``spans`` adds to ``base`` the tokens that the randomness tests discover (kind ``random``);
    these never overlap a span of ``base``. Null text counts as empty and has no span, nor has empty
    text; texts of any length are read whole; repeated rows are tested and returned each; an empty
    table gives no row; other columns are not read.
    """
    seen = stored(examined(docs, text_col), "secret-tokens")
    bins = thresholds(seen.select(F.explode("tokens").alias("t")).select("t.size", "t.bin"), alpha)
    least = F.array(*(F.lit(bins.get(i, P_BINS)) for i in range(len(LENGTH_CLASSES) + 1)))
    found = F.transform(F.filter("tokens", lambda t: t["bin"] >= F.get(least, t["size"])), lambda t: F.struct(
        t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return seen.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", found.cast(_SPAN))).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
