"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
trigram is bound as rho^2(a) * rho(b) * c, where rho rotates a vector by one
place; a text is the bundle (sum) of its trigrams' vectors, a language the bundle
of its texts. A text gets the language whose prototype has the highest cosine.

Trigrams are taken inside words: one for each letter, a word's ends counting as
a boundary symbol. Whole texts count; letters are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS = 1024
BLOCK_CHARS = 1 << 19         # characters counted together
BLOCK_TEXTS = 512             # texts counted together: bounds the count matrix
BIND = 4096                   # trigrams bound at a time
BLOCK_LANGUAGES = 2000        # prototypes scored at once: 2000 x 1024 x 8 bytes in a task
UNKNOWN = "und"


def letter_vector(code_point: int, dims: int = DIMENSIONS) -> np.ndarray:
    """The random vector of a letter (of a word's end: 32)."""
    rng = np.random.Generator(np.random.Philox(key=code_point + (1 << 40)))
    return (rng.integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.int8)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(symbol sequence, document of each symbol, code points of the symbols).

    Symbol 0 is the boundary: every run of other characters, and both ends of a text.
    """
    flat = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    seen = np.zeros(int(flat.max()) + 1, bool)
    seen[flat] = True
    alphabet, table = [32], np.zeros(len(seen), np.int64)
    number: dict[str, int] = {}
    for c in np.flatnonzero(seen).tolist():
        if chr(c).isalpha():
            low = chr(c).lower()[0]
            if low not in number:
                number[low] = len(alphabet)
                alphabet.append(ord(low))
            table[c] = number[low]
    sym = table[flat]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (doc[1:] != doc[:-1])
    return sym[keep], doc[keep], alphabet


def _trigrams(texts: list[str]):
    """(document, index of trigram) of each letter, the distinct trigrams, code points."""
    sym, doc, alphabet = _symbols(texts)
    mid = np.flatnonzero(sym != 0)
    base = len(alphabet)
    code = (sym[mid - 1] * base + sym[mid]) * base + sym[mid + 1]
    if base ** 3 <= 1 << 22:
        present = np.zeros(base ** 3, bool)
        present[code] = True
        distinct = np.flatnonzero(present)
        index = (np.cumsum(present) - 1)[code]
    else:
        distinct, index = np.unique(code, return_inverse=True)
    parts = np.stack([distinct // (base * base), distinct // base % base, distinct % base])
    return doc[mid], index, parts, alphabet


def bundle(texts: list[str], group: np.ndarray, n_groups: int, dims: int = DIMENSIONS) -> np.ndarray:
    """Bundled vectors of ``n_groups`` groups of texts (text i counts to ``group[i]``)."""
    doc, index, parts, alphabet = _trigrams(texts)
    out = np.zeros((n_groups, dims), np.float64)
    if not len(doc):
        return out
    letters = np.stack([letter_vector(c, dims) for c in alphabet])
    once, twice = np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
    key = np.sort(index * n_groups + group[doc])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    tri, who = key[first] // n_groups, key[first] % n_groups
    for at in range(0, parts.shape[1], BIND):
        a, b, c = parts[:, at:at + BIND]
        bound = (twice[a] * once[b] * letters[c]).astype(np.float32)
        lo, hi = np.searchsorted(tri, [at, at + BIND])
        counts = np.zeros((n_groups, len(a)), np.float32)
        counts[who[lo:hi], tri[lo:hi] - at] = count[lo:hi]
        out += counts @ bound
    return out


def _text_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > BLOCK_CHARS or i - start >= BLOCK_TEXTS):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def learn(labelled: DataFrame, dims: int = DIMENSIONS, block: int = BLOCK_LANGUAGES) -> Iterator[dict[str, np.ndarray]]:
    """Prototype of each language of ``labelled(text, lang)``, in order of the names and in blocks of
    bounded size; null texts add nothing.

    Each task bundles its texts by language; the sums of the tasks are added by
    (language, dimension) with partial sums before the exchange.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                ["lang", "vec"])

        for batch in batches:
            texts, langs = ([x or "" for x in batch.column(k).to_pylist()] for k in (0, 1))
            for a, b in _text_blocks(texts):
                names = sorted(set(langs[a:b]))
                group = np.array([names.index(x) for x in langs[a:b]])
                for name, v in zip(names, bundle(texts[a:b], group, len(names), dims)):
                    sums[name] = sums[name] + v if name in sums else v
            if len(sums) > block:
                yield flush()
                sums = {}
        if sums:
            yield flush()

    rows = labelled.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(
        run, "lang string, vec array<double>")
    total = rows.select("lang", F.posexplode("vec").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    packed = stored(total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("vec")), "language-prototypes")
    # the driver holds one block at a time; a language whose texts hold no letter has no direction to compare with
    held: dict[str, np.ndarray] = {}
    for r in packed.orderBy("lang").toLocalIterator():
        v = np.array([x["v"] for x in r["vec"]])
        if np.any(v):
            held[r["lang"]] = v
        if len(held) >= block:
            yield held
            held = {}
    if held:
        yield held


def predict(docs: DataFrame, prototypes: Iterable[dict[str, np.ndarray]], dims: int = DIMENSIONS) -> DataFrame:
    """``docs(doc_id, text, ...)`` without its text, plus lang_pred and score (the cosine, at least 0).

    ``prototypes``: blocks in order of the names. A block after the first is one more pass over the
    texts in the same task, which keeps the better of the two best; any number of languages is scored.
    Null texts and texts without a letter get ``und`` and score 0, as all do when
    nothing was learned. Equal cosines go to the first name in order.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    others = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in [*others, "text"]]).add("lang_pred", StringType()).add("score", DoubleType())
    rows = docs.select(*others, "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(-2.0).alias("score"))
    for block in prototypes:
        rows = rows.mapInArrow(_better(block, len(others), dims), schema)
    return rows.select(*others, "lang_pred", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("score"))


def _better(prototypes: dict[str, np.ndarray], at: int, dims: int):
    """Rows whose language and cosine are replaced where a prototype of the block has a higher one."""
    names = list(prototypes)
    matrix = np.stack([v / np.linalg.norm(v) for v in prototypes.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            lang, score = batch.column(at + 1).to_pylist(), batch.column(at + 2).to_numpy().copy()
            for a, b in _text_blocks(texts):
                v = bundle(texts[a:b], np.arange(b - a), b - a, dims)
                norm = np.linalg.norm(v, axis=1)
                cosine = v @ matrix.T / np.maximum(norm, 1e-300)[:, None]
                best = cosine.argmax(1)
                for i in np.flatnonzero(norm > 0).tolist():
                    c = float(cosine[i, best[i]])
                    if c > score[a + i]:
                        lang[a + i], score[a + i] = names[best[i]], c
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at + 1], pa.array(lang, pa.string()), pa.array(score)], batch.schema.names)
    return run


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the other folds.

    A row's fold is crc32 of its doc_id's text modulo ``folds``; rows with a null
    doc_id belong to no fold: never learned from, not held out. Whole texts count, however long; any
    number of languages is learned and scored.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = docs.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    known = docs.filter(fold != held_out).select("text", "lang")
    return predict(rows, learn(known))
