"""Product codes of vectors, with codebooks trained under LAESA pivots.

Vectors become integers (``floor(scale * x)``) and are cut into equal parts; each
part position has a codebook of its own, trained by Lloyd rounds in integers. A
few entries of the first codebook are *pivots* for good: the distances of every
part to them are computed once and stored with the vectors. In a round the
distances of the pivots to the entries follow from the codebook alone, and by the
triangle inequality their difference to a part's stored distances bounds the
distance of part and entry from below. Entries are taken in the order of these
bounds, and exact integer distances are evaluated only until the bound of the
next entry exceeds the best distance found.

What leaves a task per round is a sum and a count per codebook entry, whatever
the number of vectors; the codebooks (parts x entries x part length integers) are
all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
PIVOTS = 8
LONG_MAX = (1 << 63) - 1
SAFE = 1 << 26         # components up to here have squared distances within 64 bits (parts of up to 1,024 components)
SLACK = 1e-6           # relative room for rounding (distances are stored as floats); bounds only prune, integers decide

_PREPARED = "vec_id long, label {label}, parts array<long>, pivots array<float>"
_SUMS = "part int, entry int, place int, total decimal(38,0), n long"


def _matrix(column: pa.ListArray, dtype) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), saturating at 64 bits."""
    y = np.floor(x.astype(np.float64) * scale)
    if not y.size or np.abs(y).max() < 2.0 ** 62:
        return y.astype(np.int64)
    return np.array([[max(-LONG_MAX - 1, min(LONG_MAX, int(v))) for v in row] for row in y], np.int64)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if squared distances fit 64 bits, else with Python's integers."""
    if all(not a.size or max(abs(int(a.max())), abs(int(a.min()))) <= SAFE for a in arrays):
        return list(arrays)
    return [a.astype(object) for a in arrays]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _roots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (double) of parts (n, d) to pivots (p, d): (n, p)."""
    parts, pivots = _exact(parts, pivots)
    return np.sqrt(np.stack([_squared(parts, p) for p in pivots], axis=1).astype(np.float64))


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries far from one another: the first, then always the one farthest from those taken."""
    taken = [0]
    while len(taken) < min(count, len(entries)):
        far = _roots(entries, entries[taken]).min(axis=1)
        taken.append(int(far.argmax()))
    return entries[taken]


def nearest(parts: np.ndarray, roots: np.ndarray, entries: np.ndarray, pivots: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of each part, ties to the lower
    index, and the number of exact distances evaluated."""
    n = len(parts)
    to_entries = _roots(pivots, entries)                                     # pivots x entries
    lower = np.zeros((n, len(entries)))
    for p in range(len(pivots)):
        a, b = roots[:, p, None], to_entries[None, p]
        np.maximum(lower, np.abs(a - b) - SLACK * (a + b + 1), out=lower)
    lower *= lower
    order = np.argsort(lower, axis=1, kind="stable")
    parts, entries = _exact(parts, entries)
    at = np.zeros(n, np.int64)
    best = np.zeros(n, parts.dtype)
    rows, evaluated = np.arange(n), 0
    for step in range(len(entries)):
        e = order[rows, step]
        if step:
            # a bound above the best distance ends a row's search: later bounds are no lower
            open_ = lower[rows, e] <= best[rows].astype(np.float64) * (1 + SLACK)
            rows, e = rows[open_], e[open_]
        if not len(rows):
            break
        d = _squared(parts[rows], entries[e])
        evaluated += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (e < at[rows])) if step else np.ones(n, bool)
        best[rows[better]], at[rows[better]] = d[better], e[better]
    return at, best, evaluated


def usable(vector: Column) -> Column:
    """Whether a vector is present, not empty and all its components are finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _prepared(kept: DataFrame, label_type: str, pivots: np.ndarray, scale: int) -> DataFrame:
    """Integer parts of each vector and their distances to the pivots."""
    n_parts, _, width = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ints = _integers(_matrix(b.column(2), np.float64), scale)
            cut = ints.reshape(len(ints), n_parts, width)
            roots = np.concatenate([_roots(cut[:, j], pivots[j]) for j in range(n_parts)], axis=1).astype(np.float32)
            offsets = [pa.array(np.arange(len(ints) + 1, dtype=np.int32) * a.shape[1]) for a in (ints, roots)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(offsets[0], pa.array(ints.ravel())),
                 pa.ListArray.from_arrays(offsets[1], pa.array(roots.ravel()))], ["vec_id", "label", "parts", "pivots"])

    return kept.select("vec_id", "label", "vector").mapInArrow(run, _PREPARED.format(label=label_type))


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: np.ndarray):
    """(batch, parts, index per part, squared distance per part) of each batch of prepared vectors."""
    n_parts, _, width = books.shape
    for b in batches:
        if not b.num_rows:
            continue
        cut = _matrix(b.column("parts"), np.int64).reshape(b.num_rows, n_parts, width)
        roots = _matrix(b.column("pivots"), np.float64).reshape(b.num_rows, n_parts, -1)
        found = [nearest(cut[:, j], roots[:, j], books[j], pivots[j])[:2] for j in range(n_parts)]
        yield b, cut, np.stack([f[0] for f in found], axis=1), [f[1] for f in found]


def _next_books(prepared: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts assigned to them; unused entries stay."""
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(books.shape, object), np.zeros((n_parts, n_entries), np.int64)
        for _, cut, at, _ in _assigned(batches, books, pivots):
            # int64 sums of a batch: rows x SAFE stays far below 2^63; larger components are summed as integers
            (cut,) = _exact(cut)
            for j in range(n_parts):
                for e in np.unique(at[:, j]):
                    mine = cut[at[:, j] == e, j]
                    totals[j, e] += mine.sum(axis=0).astype(object)
                    counts[j, e] += len(mine)
        used = np.argwhere(counts > 0)
        if len(used):
            rows = [(j, e, k, Decimal(int(totals[j, e, k])), counts[j, e]) for j, e in used for k in range(width)]
            part, entry, place, total, n = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
                 pa.array(total, pa.decimal128(38, 0)), pa.array(n, pa.int64())], ["part", "entry", "place", "total", "n"])

    sums = (prepared.select("parts", "pivots").mapInArrow(run, _SUMS)
            .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    out = books.copy()
    for r in sums.collect():  # at most parts x entries x part length rows
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS
          ) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """(prepared vectors, codebooks, pivots) after all rounds; None if no vector is usable.

    The codebooks start as the parts of the vectors with the smallest ids (a null
    id comes last, equal ids go by the vector).
    """
    label = F.col(label_col)
    kept = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"),
                          ).filter(usable(F.col("vector")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    if not first:
        return None
    size = len(first[0].vector)
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    if any(len(r.vector) != size for r in first):
        raise ValueError("vectors differ in length")
    # books[part][entry][place]
    books = _integers(np.array([r.vector for r in first], np.float64), scale).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    fixed = np.stack([choose_pivots(b, pivots) for b in books])
    same_size = kept.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast(vectors.schema[vector_col].dataType)))
    prepared = stored(_prepared(same_size, kept.schema["label"].dataType.simpleString(), fixed, scale), "vector-parts")
    for _ in range(rounds):
        books = _next_books(prepared, books, fixed)
    return prepared, books, fixed


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """One row per usable vector: vec_id, label, code, error, label_error, codebooks_sha256.

    ``code`` has two hex digits per part, the index of its entry; ``error`` is the
    sum of the parts' squared distances; ``label_error`` is the error summed over
    the vectors of a label (nulls are a label of their own). ``options`` are those
    of :func:`train`.

    Rows whose vector is null, empty or holds a null, NaN or infinite component
    are left out; a null id or label is kept as such, rows with equal ids and
    repeated rows are encoded each, other columns are not read. Fewer vectors than
    entries make shorter codebooks; no vector gives no row. Vectors that differ in
    length are an error. Components beyond 64 bits saturate there, and so does an
    error (a label's error beyond 64 bits is null).
    """
    trained = train(vectors, id_col, vector_col, label_col, **options)
    label_type = vectors.schema[label_col].dataType.simpleString()
    if trained is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id bigint, label {label_type}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    prepared, books, pivots = trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, at, squared in _assigned(batches, books, pivots):
            width = 2 * at.shape[1]
            digits = at.astype(np.uint8).tobytes().hex()
            total = sum(s.astype(object) for s in squared) if any(s.dtype == object for s in squared) else sum(squared)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array([digits[i:i + width] for i in range(0, len(digits), width)], pa.string()),
                 pa.array([min(int(t), LONG_MAX) for t in total], pa.int64())], ["vec_id", "label", "code", "error"])

    coded = stored(prepared.mapInArrow(run, f"vec_id bigint, label {label_type}, code string, error bigint"), "vector-codes")
    discard(prepared)
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label"))).select(
        "vec_id", "c.label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
