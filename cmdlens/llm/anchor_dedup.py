"""Substring deduplication with difference-cover anchors.

Two equal stretches of ``WINDOW`` words share, whatever their positions, an
aligned place whose position in both documents lies in the difference cover
modulo ``PERIOD``. Only short windows (*anchors*) at cover positions are hashed
and exchanged. A repeated anchor is extended: the full windows that contain it
get 95-bit fingerprints, and every occurrence but the first of a fingerprint is
removed, so no pair of occurrences is ever formed.

Both exchanges first look inside their own batch: of rows with one hash only the
first travels under that hash; the others are known repeats already and travel
as position ranges under a key of their own. A frequent passage thus has at most
one row per batch, and long copies shrink to few ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_runs, stored, text_key

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)          # every difference modulo 13 occurs between two of these
FILTER_BITS = 1 << 24         # of the membership filters sent to every task
NO_ID = -(1 << 63)            # stands for a null doc_id, which comes before all others; kh tells it from the number

_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: bytes) -> list[bytes]:
    return raw.split()  # bytes split on exactly the six ASCII white space characters


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """128-bit hash of each word, as two columns."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def _window_hash(h: np.ndarray, at: np.ndarray, width: int, half: int) -> np.ndarray:
    """Hash of the ``width`` words from each position of ``at``."""
    out = np.zeros(len(at), np.uint64)
    m = np.uint64(1)
    for i in range(width):
        m = np.uint64((int(m) * _MULT[half] + 2 * i + 1) & ((1 << 64) - 1)) | np.uint64(1)
        out += h[at + i, half] * m
    return _mix(out)


def _ranges(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions as ranges lo..hi, both included."""
    if not len(pos):
        return pos, pos
    cut = np.flatnonzero(np.diff(pos) > 1)
    return pos[np.append(0, cut + 1)], pos[np.append(cut, len(pos) - 1)]


def _marked(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in some range lo..hi."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, lo, 1)
    np.add.at(delta, hi + 1, -1)
    return np.cumsum(delta[:-1]) > 0


# Exchanged rows are narrow. Anchors: h holds 48 hash bits, then the kind; p a position, or a range's
# first position and length. Windows: h holds 63 hash bits, the last bit marks a range; c holds 32 more
# hash bits and the position, or a range's length and first position.
_ANCHOR = "h long, doc long, kh long, p long"
_WINDOW = "h long, c long, doc long, kh long"
# A range of positions in one text: r holds the first and the last, 32 bits each.
_RANGE = "doc long, kh long, r long"
_LOW = (1 << 32) - 1


def _rows(names: str, *cols) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols]
    return pa.RecordBatch.from_arrays(arrays, [n.split()[0] for n in names.split(", ")])


def _known_ranges(owner: np.ndarray, pos: np.ndarray, doc: np.ndarray, kh: np.ndarray):
    """Known positions as ranges: (a key of their own, doc, kh, first, length)."""
    docs, starts = np.unique(owner, return_index=True)
    parts = [(d, *_ranges(p)) for d, p in zip(docs.tolist(), np.split(pos, starts[1:]))]
    lo = np.concatenate([p[1] for p in parts])
    size = np.concatenate([p[2] for p in parts]) - lo + 1
    who = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
    spread = _mix(doc[who].view(np.uint64) * np.uint64(_MULT[1]) + kh[who].view(np.uint64)
                  + lo.astype(np.uint64) * np.uint64(_MULT[0]))
    return spread, doc[who], kh[who], lo, size


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 24 << 20) -> Iterator[pa.Table]:
    """Arrow batches joined up to a number of bytes: repeats are first sought inside a block."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _named(docs: DataFrame) -> DataFrame:
    """(doc, kh, text): sort id and, where doc_ids are not unique, a hash of the row. The hash is
    negative for a null doc_id and not for the smallest long, so that null comes first."""
    some = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = some.filter((F.col("n") > 1) | F.col("doc_id").isNull() | (F.col("doc_id") == NO_ID)).limit(1).count() > 0
    kh = F.xxhash64(text_key(F.col("doc_id"), F.col("text"))) if repeated else F.lit(0).cast("bigint")
    kh = (F.when(F.col("doc_id").isNull(), kh.bitwiseOR(F.lit(NO_ID)))
          .when(F.col("doc_id") == NO_ID, kh.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(kh))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), kh.alias("kh"), "text")


def _membership(ranges: DataFrame) -> np.ndarray:
    """Bits of the texts that occur in ``ranges``: a filter of fixed size (2 MB) that never misses one."""
    slot = F.pmod(F.xxhash64("doc", "kh"), F.lit(FILTER_BITS)) + 1
    rows = (ranges.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * len(r["bits"])
        out[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _texts(named: DataFrame, member: np.ndarray) -> DataFrame:
    """(doc, kh, z): compressed texts of the documents that may occur in the ranges."""
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            slot = b.column(3).to_numpy()
            b = b.take(pa.array(np.flatnonzero(member[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)))
            z = pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], ["doc", "kh", "z"])

    return named.select("*", _slot()).mapInArrow(run, "doc long, kh long, z binary")


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc", "kh"), F.lit(FILTER_BITS)).alias("slot")


def anchors(named: DataFrame, window: int = WINDOW) -> DataFrame:
    """Anchor rows of all documents; see the module text for the kinds.

    kind 0: a hash seen once in its block; 1: the first of several there;
    2: a range of anchor positions already known to repeat. 48 hash bits filter:
    at 10^13 anchors one in thirty passes for a repeat by chance, and is verified.
    """
    width = window - PERIOD + 1
    cover = np.array(COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            doc, kh = (t.column(k).to_numpy() for k in (0, 1))
            hs, owner, pos = [], [], []
            for d, text in enumerate(t.column(2).to_pylist()):
                words = _words((text or "").encode("utf-8", "surrogatepass"))
                if len(words) < window:
                    continue
                h = _word_hashes(words)
                n = len(words) - width + 1
                at = (np.arange(0, n + PERIOD, PERIOD)[:, None] + cover).ravel()
                at = at[at < n]
                hs.append(_window_hash(h, at, width, 0))
                pos.append(at)
                owner.append(np.full(len(at), d))
            if not hs:
                continue
            h, owner, pos = np.concatenate(hs) >> np.uint64(16), np.concatenate(owner), np.concatenate(pos)
            _, first, number, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            key = h[first] << np.uint64(16) | (count > 1).astype(np.uint64)
            yield _rows(_ANCHOR, key, doc[owner[first]], kh[owner[first]], pos[first])
            known = count[number] > 1
            if known.any():
                spread, d, k, lo, size = _known_ranges(owner[known], pos[known], doc, kh)
                yield _rows(_ANCHOR, spread & ~np.uint64(0xFFFF) | np.uint64(2), d, k, size << 32 | lo)

    return named.mapInArrow(run, _ANCHOR)


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """Ranges of anchor positions whose hash occurs more than once."""
    def run(batches):
        for h, doc, kh, p in key_runs(batches, shift=16):
            kind = h & 0xFFFF
            same = np.zeros(len(h), bool)
            i = np.flatnonzero(kind < 2)  # range rows share a hash with others only by chance
            eq = h[i][1:] >> 16 == h[i][:-1] >> 16
            same[i[1:]] |= eq
            same[i[:-1]] |= eq
            # the first of several in its block is in a range row already
            out = (kind == 2) | (same & (kind == 0))
            lo = p & _LOW
            hi = lo + np.where(kind == 2, (p >> 32) - 1, 0)
            yield _rows(_RANGE, doc[out], kh[out], (lo << 32 | hi)[out])

    key = F.shiftright("h", 16)
    return rows.repartition(key).sortWithinPartitions("h").mapInArrow(run, _RANGE)


def _per_text(ranges: DataFrame) -> DataFrame:
    """One row per text with its distinct ranges (at most its length)."""
    return ranges.groupBy("doc", "kh").agg(F.collect_set("r").alias("ranges"))


def _bounds(ranges: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    r = np.array(ranges or [], np.int64)
    return r >> 32, r & _LOW


def candidate_windows(texts: DataFrame, ranges: DataFrame, window: int = WINDOW) -> DataFrame:
    """Full windows that contain a repeated anchor: of those equal in a block the
    first, and ranges of window starts that have an earlier occurrence in it."""
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for t in _blocks(batches, 12 << 20):
            doc, kh = (t.column(k).to_numpy() for k in (0, 1))
            order = np.lexsort((kh, doc))  # documents in order, so the first occurrence comes first
            t, doc, kh = t.take(pa.array(order)), doc[order], kh[order]
            z, found = t.column(2).to_pylist(), t.column(3).to_pylist()
            h1, h2, owner, pos = [], [], [], []
            for d in range(len(doc)):
                if d and doc[d] == doc[d - 1] and kh[d] == kh[d - 1]:
                    continue  # a repeated row is the same place in the order
                words = _words(unpack(z[d], max_output_size=1 << 31))
                n = len(words) - window + 1
                lo, hi = _bounds(found[d])
                at = np.flatnonzero(_marked(np.maximum(lo - PERIOD + 1, 0), np.minimum(hi, n - 1), n))
                h = _word_hashes(words)
                h1.append(_window_hash(h, at, window, 0))
                h2.append(_window_hash(h, at, window, 1))
                pos.append(at)
                owner.append(np.full(len(at), d))
            if not h1:
                continue
            a, b, owner, pos = (np.concatenate(c) for c in (h1, h2, owner, pos))
            a, b = a & ~np.uint64(1), b >> np.uint64(32)
            order = np.lexsort((np.arange(len(a)), b, a))
            repeat = np.zeros(len(a), bool)
            repeat[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            f = ~repeat
            yield _rows(_WINDOW, a[f], b[f] << np.uint64(32) | pos[f].astype(np.uint64), doc[owner[f]], kh[owner[f]])
            if repeat.any():
                spread, d, k, lo, size = _known_ranges(owner[repeat], pos[repeat], doc, kh)
                yield _rows(_WINDOW, spread | np.uint64(1), size << 32 | lo, d, k)

    return texts.join(_per_text(ranges), ["doc", "kh"]).mapInArrow(run, _WINDOW)


def later_windows(rows: DataFrame) -> DataFrame:
    """Ranges of window starts whose words also start earlier."""
    def run(batches):
        for h, c, doc, kh in key_runs(batches):
            lo, high, known = c & _LOW, c >> 32, h & 1 == 1
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (high[1:] != high[:-1]) | known[1:]
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            out = known | (doc != doc[first]) | (kh != kh[first]) | (lo != lo[first])
            hi = lo + np.where(known, high - 1, 0)
            yield _rows(_RANGE, doc[out], kh[out], (lo << 32 | hi)[out])

    dealt = rows.repartition("h").sortWithinPartitions(
        "h", F.shiftright("c", 32), "doc", "kh", F.col("c").bitwiseAND(F.lit(_LOW)))
    return dealt.mapInArrow(run, _RANGE)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text.

    A word goes if a window of ``window`` words over it also starts earlier: in a
    document with a smaller doc_id (null first), or earlier in the same one;
    texts that share a doc_id are ordered by a hash of the text. Of rows equal in
    doc_id and text, all but one lose every word that any window covers. Null,
    empty and shorter texts lose nothing. Kept words are joined by one blank. A null doc_id
    is told from any number, the smallest included. A text of any length is taken whole; it and its
    words are held in memory together.
    """
    named = _named(docs)
    # written without grouping: the filter needs them first, and the join groups and meets them in one exchange
    repeats = stored(repeated_anchors(anchors(named, window)), "repeated-anchors")
    windows = candidate_windows(_texts(named, _membership(repeats)), repeats, window)
    later = stored(later_windows(windows), "later-windows")
    member = _membership(later)

    def whole(batches):
        """Texts that no range concerns: nothing is removed, nothing is exchanged."""
        for b in batches:
            slot = b.column(3).to_numpy()
            b = b.take(pa.array(np.flatnonzero(~(member[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)))
            words = [_words((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int64()),
                 pa.array(np.zeros(len(words), np.int64)), _joined(words)], ["doc", "kh", "n_words", "n_removed", "kept_text"])

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for z, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = _words(unpack(z, max_output_size=1 << 31))
                n_words.append(len(words))
                gone = np.zeros(len(words), bool)
                if found:
                    lo, hi = _bounds(found)
                    gone = _marked(lo, hi + window - 1, len(words))
                n_removed.append(int(gone.sum()))
                kept.append([w for w, g in zip(words, gone.tolist()) if not g])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), _joined(kept)],
                ["doc", "kh", "n_words", "n_removed", "kept_text"])

    schema = "doc long, kh long, n_words long, n_removed long, kept_text string"
    out = (named.select("*", _slot()).mapInArrow(whole, schema)
           .union(_texts(named, member).join(_per_text(later), ["doc", "kh"], "left").mapInArrow(cut, schema)))
    return out.withColumn("doc_id", F.when((F.col("doc") != NO_ID) | (F.col("kh") >= 0), F.col("doc"))).select(
        "doc_id", "n_words", "n_removed", "kept_text", "kh")


def _joined(texts: list[list[bytes]]) -> pa.Array:
    return pa.array([b" ".join(w).decode("utf-8", "replace") for w in texts], pa.string())


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, one row per row of ``docs``."""
    rows = remove_repeats(docs, window).withColumn("kept_sha256", F.sha2("kept_text", 256))
    # rows equal in doc_id and text: the first keeps its words, the others lose all that windows cover
    once = rows.groupBy("doc_id", "kh", "n_words", "n_removed", "kept_sha256").agg(F.count(F.lit(1)).alias("copies"))
    each = once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    again = (F.col("copy") > 1) & (F.col("n_words") >= window)
    return each.select(
        "doc_id", "n_words", F.when(again, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
