"""Phrase collocations from sorted count streams (external stream estimation layout).

Words are numbered first: blocks of text send their vocabularies through one
sorted merge, which gives every frequent word of a language its count and its
number in the order of (language, word). Blocks then count their phrases of two
and three words in numbers and send them as sorted, compressed runs to ranges of
(first word, second word) of about equal token counts, where the runs are merged.

Of the merged counts two sorted streams are made. In *prefix order* (first word
first, an absent word before any other) a phrase is preceded by its first words:
merging the streams of one, two and three words in lockstep, a reader that
remembers the last count of each length knows the counts of all first parts of
the phrase at hand, and the rows up to the next phrase of two words are its
extensions to the right. In *suffix order* (last word first) the same pass gives
the counts of the last parts and the extensions to the left. No table of counts
is hashed or kept in memory, and no count is looked up.

Streams are range-partitioned by all their words, so even the phrases of one word
are spread over many tasks. A task that starts in the middle of a group does not
know the counts before it; it says what it has seen last, and these few numbers
per partition (at most the number of partitions in all) complete the others'
first and last rows.

Words and phrases rarer than a candidate leave as soon as their whole count is
known: a part or a neighbour that matters is never rarer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, discard, stored

MIN_COUNT = 10         # least count of a candidate
TOP = 2000             # phrases returned per language
SCORE = 1_000_000
HELD_SHARE = 50        # a candidate goes if a longer one has at least this share (%) of its count
BITS = 21              # three word numbers fit one 63-bit key
BLOCK = 1 << BITS      # words counted together by a task
SLICE = 4 << 20        # bytes of text split into words at once
PER_PARTITION = 2_000_000   # rows of a stream's partition, tokens of a range
WORDS_PER_PARTITION = 400_000   # rows of the vocabulary's merge

BREAKS = b".,;:!?\n\x0b\x0c\r"
# A-Z to a-z; any break to one sign, which no word holds
_TABLE = bytes.maketrans(bytes(range(65, 91)) + BREAKS, bytes(range(97, 123)) + b"." * len(BREAKS))


class _Block:
    """Word numbers of one language in reading order; 0 is a break."""

    def __init__(self, lang: str, head: list[bytes]):
        self.lang, self.size, self.ids = lang, 0, []
        self.numbers = _Numbers()
        self.numbers[b"."]
        self.add(head)

    def add(self, tokens: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def rows(self, number: int, open_end: bool) -> tuple[Iterator[pa.RecordBatch], list[bytes]]:
        """A row for the block's word numbers, one per word. With ``open_end`` the text goes on, so
        phrases that start at the last two words are left to the next block, which gets these words."""
        ids = np.concatenate(self.ids)
        words = list(self.numbers)
        m = len(ids) - (min(2, len(ids)) if open_end else 0)
        counts = np.bincount(ids[:m], minlength=len(words))[1:]
        return self._rows(number, m, ids, words, counts), [words[i] for i in ids[m:]]

    def _rows(self, number, m, ids, words, counts) -> Iterator[pa.RecordBatch]:
        def batch(id_, word, n, packed):
            k = len(id_)
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * k, pa.int64()), pa.array([self.lang] * k, pa.string()), pa.array(id_, pa.int32()),
                 word, pa.array(n, pa.int64()), packed], ["block", "lang", "id", "word", "n", "ids"])
        yield batch([len(ids)], pa.nulls(1, pa.string()), [m], pa.array([pa.compress(ids.astype("<i4").tobytes(), "zstd", asbytes=True)], pa.binary()))
        text = pa.array(words[1:], pa.binary()).view(pa.string())
        for at in range(0, len(counts), 65536):
            k = len(counts[at:at + 65536])
            yield batch(np.arange(at + 1, at + 1 + k), text.slice(at, k), counts[at:at + 65536], pa.nulls(k, pa.binary()))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words and breaks of a translated text, some megabytes at a time."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and text[end] not in b" \t.":
            end += 1
        # bytes.split() takes tabs and blanks only: the other white space has become breaks
        yield text[start:end].replace(b".", b" . ").split()
        start = end


def blocks_of(docs: DataFrame, block: int = BLOCK, slice_bytes: int = SLICE) -> DataFrame:
    """Texts as blocks of word numbers: per block one row with its numbers (``ids``; ``id`` of them,
    phrases start at the first ``n``) and one row per word (``id``, ``word``, ``n`` occurrences)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, _Block] = {}
        number = TaskContext.get().partitionId() << 32
        held = 0

        def closed(b: _Block):
            nonlocal number, held
            rows, tail = b.rows(number, open_end=True)
            number += 1
            held -= b.size - len(tail)
            open_blocks[b.lang] = _Block(b.lang, tail)
            return rows

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).view(pa.binary())
            for lang in pc.unique(langs).to_pylist():
                joined = b".".join(texts.filter(pc.equal(langs, lang)).to_pylist()).translate(_TABLE) + b"."
                for tokens in _slices(joined, slice_bytes):
                    while tokens:
                        b = open_blocks.get(lang) or open_blocks.setdefault(lang, _Block(lang, []))
                        room = block - 1 - b.size
                        b.add(tokens[:room])
                        held += len(tokens[:room])
                        tokens = tokens[room:]
                        if b.size >= block - 1:
                            yield from closed(b)
                    if held > 2 * block:  # many languages, none full: the largest goes
                        yield from closed(max(open_blocks.values(), key=lambda x: x.size))
        for b in open_blocks.values():
            yield from b.rows(number, open_end=False)[0]
            number += 1

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "block long, lang string, id int, word string, n long, ids binary")


def vocabulary(blocks: DataFrame, least: int, partitions: int) -> DataFrame:
    """(lang, word, f, number, before): words with ``least`` occurrences or more, numbered from 1 in the
    order of (lang, word); ``before`` sums the counts of the words that come before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in _merged(batches, 2):
            batch = batch.filter(pc.greater_equal(batch.column(2), least))
            n = batch.num_rows
            if n:
                f = batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(number + np.arange(n)), pa.array(before + np.cumsum(f) - f), pa.array([part] * n, pa.int32())],
                    ["lang", "word", "f", "number", "before", "part"])
                number, before = number + n, before + int(f.sum())

    words = blocks.filter("word is not null").select("lang", "word", "n")
    merged = stored(words.repartitionByRange(partitions, "lang", "word").sortWithinPartitions("lang", "word").mapInArrow(
        run, "lang string, word string, f long, number long, before long, part int"), "phrase-words")
    offsets, n, total = [], 0, 0
    for r in merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).orderBy("part").collect():
        offsets.append((r.part, n, total))
        n, total = n + r.n, total + r.f
    small = merged.sparkSession.createDataFrame(offsets, "part int, n0 long, f0 long")  # one row per partition
    return merged.join(F.broadcast(small), "part").select(
        "lang", "word", "f", (F.col("number") + F.col("n0") + 1).alias("number"), (F.col("before") + F.col("f0")).alias("before"))


def _packed(keys: np.ndarray, third: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: differences of the keys, third words, counts."""
    columns = [np.diff(keys, prepend=0).astype("<i8"), third.astype("<i4"), counts.astype("<i8")]
    return len(keys).to_bytes(8, "little") + pa.compress(b"".join(
        np.ascontiguousarray(c.view(np.uint8).reshape(len(keys), -1).T).tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(run[:8], "little")
    raw = np.frombuffer(pa.decompress(run[8:], 20 * n, "zstd"), np.uint8)

    def column(start, width, dtype):
        return np.ascontiguousarray(raw[start * n:(start + width) * n].reshape(width, n).T).view(dtype).ravel()
    return np.cumsum(column(0, 8, "<i8")), column(8, 4, "<i4"), column(12, 8, "<i8")


def phrase_runs(blocks: DataFrame, words: DataFrame, per_range: int = PER_PARTITION) -> DataFrame:
    """(range, run): each block's phrases of two and three frequent words as sorted runs, one per range.

    Ranges split the pairs (first, second word) in their order, a first word by its count and the
    second by its share of the language's words, so a very common first word fills several.
    """
    langs = words.groupBy("lang").agg(F.min("before").alias("start"), F.sum("f").alias("total"))
    known = words.join(langs, "lang").select(
        "lang", "word", F.col("number").cast("int").alias("number"), "before", "f",
        ((F.col("before") - F.col("start")) / F.col("total")).alias("share"))
    mine = blocks.filter("word is not null").select("block", "lang", "id", "word").join(known, ["lang", "word"]).select(
        "block", "id", "number", "before", "f", "share")
    ids = blocks.filter("ids is not null").select(F.col("block").alias("at"), F.col("id").alias("size"), "n", "ids")

    def run(numbered: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[int, bytes] = {}
        if block.num_rows and numbered.num_rows:
            size, m = block["size"][0].as_py(), block["n"][0].as_py()
            seq = np.frombuffer(pa.decompress(block["ids"][0].as_py(), 4 * size, "zstd"), "<i4")
            numbered = numbered.sort_by("number")
            number, before, f, share = (numbered[c].to_numpy() for c in ("number", "before", "f", "share"))
            rank = np.zeros(max(int(seq.max(initial=0)), int(numbered["id"].to_numpy().max())) + 1, np.int64)
            rank[numbered["id"].to_numpy()] = np.arange(1, len(number) + 1)   # 0: a break or a rare word
            at = np.concatenate([rank[seq], np.zeros(2, np.int64)])
            first, second, third = at[:m], at[1:m + 1], at[2:m + 2]
            two = (first > 0) & (second > 0)
            keys = (first << 2 * BITS | second << BITS)[two]
            keys, counts = np.unique(np.concatenate([keys, (keys | third[two])[third[two] > 0]]), return_counts=True)
            i, j, k = (keys >> 2 * BITS) - 1, (keys >> BITS & (BLOCK - 1)) - 1, (keys & (BLOCK - 1)) - 1
            where = (before[i] + np.floor(f[i] * share[j]).astype(np.int64)) // per_range
            pairs = number[i].astype(np.int64) << 31 | number[j]
            thirds = np.where(k >= 0, number[k], 0)
            cuts = [*np.flatnonzero(np.diff(where, prepend=-1)), len(keys)]
            out = {int(where[s]): _packed(pairs[s:e], thirds[s:e], counts[s:e]) for s, e in zip(cuts, cuts[1:])}
        return pa.table({"range": pa.array(list(out), pa.int64()), "run": pa.array(list(out.values()), pa.binary())})

    return mine.groupBy("block").cogroup(ids.groupBy("at")).applyInArrow(run, "range long, run binary")


def merged_phrases(runs: DataFrame, least: int) -> DataFrame:
    """(k1, k2, k3, f): word numbers and whole counts of the phrases that occur ``least`` times or more."""
    def run(table: pa.Table) -> pa.Table:
        pairs, thirds, counts = (np.concatenate(c) for c in zip(*(_unpacked(r.as_py()) for r in table["run"])))
        order = np.lexsort((thirds, pairs))
        pairs, thirds, counts = pairs[order], thirds[order], counts[order]
        starts = np.flatnonzero((np.diff(pairs, prepend=-1) != 0) | (np.diff(thirds, prepend=-1) != 0))
        f = np.add.reduceat(counts, starts)
        pairs, thirds, f = pairs[starts][f >= least], thirds[starts][f >= least], f[f >= least]
        return pa.table({"k1": pairs >> 31, "k2": pairs & ((1 << 31) - 1), "k3": thirds.astype(np.int64), "f": f})

    return runs.groupBy("range").applyInArrow(run, "k1 long, k2 long, k3 long, f long")


def _merged(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows with equal keys (the first columns) become one, their counts (next column) summed."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(pair) for pair in zip(held.columns, batch.columns)], held.schema.names)
        n = batch.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for c in batch.columns[:n_keys]:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(batch.column(n_keys).to_numpy(), starts)
        cols = [c.take(pa.array(starts)) for c in batch.columns[:n_keys]]
        out = pa.RecordBatch.from_arrays([*cols, pa.array(sums, pa.int64())], batch.schema.names[:n_keys + 1])
        held = out.slice(len(starts) - 1)
        if len(starts) > 1:
            yield out.slice(0, len(starts) - 1)
    if held is not None:
        yield held


class _Lockstep:
    """One pass over the merged streams of one, two and three words in their common order."""

    def __init__(self) -> None:
        self.last = [None, None]    # last counts of one and of two words
        self.lead = 0               # largest count of three words before any shorter phrase
        self.headed = False         # whether a shorter phrase was seen

    def step(self, order: np.ndarray, f: np.ndarray):
        """Per row: counts of the first word and of the first two (-1: not known here), largest
        extension; and the rows of shorter phrases, the largest count of three words before them."""
        at = np.arange(len(f))
        heads = []
        for o in (1, 2):
            i = np.maximum.accumulate(np.where(order == o, at, -1))
            before = -1 if self.last[o - 1] is None else self.last[o - 1]
            heads.append(np.where(i >= 0, f[i], before))
            if i[-1] >= 0:
                self.last[o - 1] = int(f[i[-1]])
        ext = np.zeros(len(f), np.int64)
        starts = np.flatnonzero(order < 3)
        threes = np.where(order == 3, f, 0)
        lead = int(threes[:starts[0]].max(initial=0)) if len(starts) else int(threes.max(initial=0))
        if len(starts):
            ext[starts] = np.maximum.reduceat(threes, starts)
        return heads[0], heads[1], ext, starts, lead


_LINE = ["f", "head1", "head2", "ext", "n_words", "part"]


def _noted(stream: DataFrame, keys: list[str], extra: list[str], partitions: int) -> DataFrame:
    """The stream (all columns long, no phrase twice, absent words 0) with head1 and head2, the counts of
    the first one and two words in the order of ``keys``, and ext, the largest count of a phrase that
    goes on by one word; n_words is the phrase's length.

    One sort; what a partition cannot know by itself comes from its neighbours' last lines.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), _Lockstep()

        def made(cols: list[np.ndarray], h1, h2, ext, order, ended=False):
            k = len(cols[0])
            values = [*cols, h1, h2, ext, order, np.full(k, part)]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(np.asarray(v, np.int64)) for v in values), pa.array([ended] * k, pa.bool_())],
                [*keys, "f", *extra, *_LINE[1:], "ended"])

        waiting = None     # a phrase of two words that may go on: (its columns, head1, ext so far)
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            order = sum((c > 0).astype(np.int64) for c in cols[:n])
            h1, h2, ext, starts, lead = state.step(order, cols[n])
            if waiting is not None:
                waiting = (*waiting[:2], max(waiting[2], lead))
            elif not state.headed:
                state.lead = max(state.lead, lead)
            rest = np.arange(len(order))
            if len(starts):
                if waiting is not None:
                    yield made(waiting[0], [waiting[1]], [-1], [waiting[2]], [2])
                    waiting = None
                state.headed = True
                s = int(starts[-1])
                if order[s] == 2:
                    waiting = ([c[s:s + 1] for c in cols], int(h1[s]), int(ext[s]))
                    rest = np.delete(rest, s)
            if len(rest):
                yield made([c[rest] for c in cols], h1[rest], h2[rest], ext[rest], order[rest])
        if waiting is not None:
            yield made(waiting[0], [waiting[1]], [-1], [waiting[2]], [2], ended=True)
        # the partition's last line: n_words 0; f: its lead; head1, head2: its last counts; ended: whether any head
        last = [-1 if x is None else x for x in state.last]
        blank = [np.zeros(1, np.int64)] * (n + 1 + len(extra))
        blank[n] = np.array([state.lead])
        yield made(blank, [last[0]], [last[1]], [0], [0], ended=state.headed)

    sorted_ = stream.select(*keys, "f", *extra).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"{c} long" for c in [*keys, "f", *extra, *_LINE[1:]]) + ", ended boolean"
    rows = stored(sorted_.mapInArrow(run, schema), "phrase-stream")

    # carried over from earlier partitions: last counts; from later ones: extensions of a phrase left open
    lines = sorted(rows.filter("n_words = 0").select("part", "f", "head1", "head2", "ended").collect())
    carried, c1, c2 = [], -1, -1
    for part, _, last1, last2, _ in lines:
        carried.append([part, c1, c2, 0])
        c1, c2 = last1 if last1 >= 0 else c1, last2 if last2 >= 0 else c2
    more = 0
    for i in range(len(lines) - 1, -1, -1):
        carried[i][3] = more
        more = lines[i][1] if lines[i][4] else max(more, lines[i][1])
    small = rows.sparkSession.createDataFrame(carried, "part long, c1 long, c2 long, more long")  # one row per partition

    def known(head, carry):
        return F.when(F.col(head) >= 0, F.col(head)).otherwise(F.col(carry)).alias(head)
    return rows.filter("n_words > 0").join(F.broadcast(small), "part").select(
        *keys, "f", *extra, "n_words", known("head1", "c1"), known("head2", "c2"),
        F.when(F.col("ended"), F.greatest("ext", "more")).otherwise(F.col("ext")).alias("ext"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCORE * a * a / (left * right)) in 38-digit integers."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    n, d = (F.lit(SCORE).cast("decimal(7,0)") * a).cast("decimal(38,0)"), (left * right).cast("decimal(38,0)")
    return F.call_function("div", (n * a).cast("decimal(38,0)"), d)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, held_share: int = HELD_SHARE,
         per_partition: int = PER_PARTITION, block: int = BLOCK, slice_bytes: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of two and three words per language.

    A text is lower-cased (A-Z) and cut at ``.,;:!?`` and line ends; a phrase lies
    within a piece, its words between blanks and tabs. ``a`` counts its
    occurrences, ``l`` and ``r`` those of its two parts at the cut with the lowest
    score (the earlier cut on ties), ``n`` all words of the language. A phrase of
    two words goes if a longer one that holds it has at least ``held_share``
    percent of its count. Ties of score and ``a`` go by the phrase's bytes.

    Null text counts as empty, a null language as ``und`` (joined with any so
    named); repeated rows count each; texts of any length are read in slices; an
    empty table has no row; columns other than ``lang`` and ``text`` are not read.
    """
    blocks = stored(blocks_of(docs, block, slice_bytes), "phrase-blocks")
    size = blocks.filter("word is not null").groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    totals = stored(size, "language-words")
    rows = totals.agg(F.sum("rows")).first()[0] or 0
    words = stored(vocabulary(blocks, min_count, bucket_count(rows, min(per_partition, WORDS_PER_PARTITION))), "phrase-vocabulary")
    singles = words.select(F.col("number").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.lit(0).cast("bigint").alias("k3"), "f")
    phrases = merged_phrases(phrase_runs(blocks, words, per_partition), min_count)
    streams = stored(singles.unionByName(phrases), "phrase-counts")
    discard(blocks)
    partitions = bucket_count(streams.count(), per_partition)

    prefix = _noted(streams, ["k1", "k2", "k3"], [], partitions)
    three, two = F.col("n_words") == 3, F.col("n_words") == 2
    turned = prefix.select(
        F.when(three, F.col("k3")).when(two, F.col("k2")).otherwise(F.col("k1")).alias("s1"),
        F.when(three, F.col("k2")).when(two, F.col("k1")).otherwise(F.lit(0)).cast("bigint").alias("s2"),
        F.when(three, F.col("k1")).otherwise(F.lit(0)).cast("bigint").alias("s3"),
        "f", F.col("head1").alias("l1"), F.col("head2").alias("l2"), F.col("ext").alias("ext_right"))
    both = _noted(stored(turned, "prefix-stream"), ["s1", "s2", "s3"], ["l1", "l2", "ext_right"], partitions)

    a = F.col("f")
    held = two & (F.greatest("ext", "ext_right") * 100 >= a * held_share)
    # cut after one word: the rest is the last word of two, the last two of three; after two words: the last of three
    early = _score(a, F.col("l1"), F.when(two, F.col("head1")).otherwise(F.col("head2")))
    late = F.when(three, _score(a, F.col("l2"), F.col("head1")))
    found = both.filter((F.col("n_words") > 1) & ~held).withColumns({"early": early, "late": late})
    is_late = F.coalesce(F.col("late") < F.col("early"), F.lit(False))
    found = found.select(
        "s1", "s2", "s3", "n_words", a.alias("a"), F.when(is_late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(is_late | two, F.col("head1")).otherwise(F.col("head2")).alias("r"),
        F.when(is_late, F.col("late")).otherwise(F.col("early")).alias("score"))

    def named(df, key, name):
        return df.join(words.select(F.col("number").alias(key), F.col("word").alias(name)), key)
    found = stored(named(found.join(words.select(F.col("number").alias("s1"), "lang", F.col("word").alias("t1")), "s1"), "s2", "t2"), "phrases")
    rest = ["lang", "a", "l", "r", "score"]
    spelled = found.filter("n_words = 2").select(F.concat_ws(" ", "t2", "t1").alias("phrase"), *rest).unionByName(
        named(found.filter("n_words = 3"), "s3", "t3").select(F.concat_ws(" ", "t3", "t2", "t1").alias("phrase"), *rest))
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # row_number() <= top is cut in each task before the exchange
    best = spelled.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return best.join(totals.select("lang", "n"), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
