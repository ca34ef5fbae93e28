"""Many phrases at once: edit distances are computed per distinct token, not per row.

The rules are those of :mod:`.phrase`. Texts are dealt by their key, and a task does the
rest for some ten million bytes of text at a time (numpy, :mod:`.byte_match`). The distinct
tokens meet the distinct words of all phrases once: a word is contained in a token (every
piece of the token looked up) or within its edit distance, found by equal *deletion
variants* -- strings within d edits of one another share a string that deleting at most d
characters of either gives. Words of 15 bytes and more allow three edits and have too many
variants; of such a word cut into one piece more than its edits, one piece is left
unchanged. Then each text follows the phrases' prefixes, shared by the phrases, from those
it holds to their continuations only. Texts are searched for whole phrases beside that.
Only what is found leaves the task, and is dealt out no more: no row per token, word or
phrase is exchanged.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.text import SHELL_TOKEN_SPLIT, edit_threshold
from .byte_match import TextFinder, WordMatcher
from .phrase import _latin1_literal, normalize_phrase
from .util import spread

PART_BYTES = 24_000_000   # text of a task
CHUNK_BYTES = 32_000_000  # text that meets the words at a time
BATCH_ROWS = 1 << 18      # rows of a batch of results
_NEVER = np.iinfo(np.int32).max
_DELIMITER = np.array([re.fullmatch(SHELL_TOKEN_SPLIT, chr(i)) is not None for i in range(256)])
_KEPT: dict[str, object] = {}   # what a worker process has built for its last phrases


def _kept(call: str, build):
    """``build()``, kept until another call's tasks come: a worker's tasks share it."""
    if call not in _KEPT:
        _KEPT.clear()
        _KEPT[call] = build()
    return _KEPT[call]


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array; null is empty."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def word_matches(tokens: DataFrame, words: dict[str, int]) -> DataFrame:
    """(token, word) for every word (a Latin-1 view, with its number of edits) that a token contains or is near to."""
    names, edits, call = [w.encode("latin-1") for w in words], list(words.values()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _kept(call, lambda: WordMatcher(names, edits))
        all_words = pa.array(list(words), pa.string())
        for batch in batches:
            counts, word = matcher.match(*_buffers(batch.column(1)))
            token = np.repeat(np.arange(len(counts)), counts)
            for lo in range(0, len(token), BATCH_ROWS):
                part = slice(lo, lo + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(token[part])), all_words.take(pa.array(word[part]))], ["token", "word"])
    return tokens.select("token", F.encode("token", "ISO-8859-1").alias("b")).mapInArrow(run, "token string, word string").distinct()


class PhrasePrefixes:
    """The phrases' prefixes by length, each once, those that continue the same one together."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, words: int, owner: np.ndarray):
        """``flat``: the words of all phrases one after another, as numbers below ``words``."""
        starts = np.cumsum(sizes) - sizes
        at, self.levels = np.zeros(len(sizes), np.int64), []
        for depth in range(sizes.max()):
            here = np.flatnonzero(sizes > depth)
            known, place = np.unique(at[here] * words + flat[starts[here] + depth], return_inverse=True)
            at[here] = place
            parent, word = np.divmod(known, words)
            if depth:       # of each prefix one word shorter: where its continuations start, and how many there are
                count = np.bincount(parent, minlength=len(self.levels[-1]["word"]))
                self.levels[-1] |= {"next": np.cumsum(count) - count, "nexts": count}
            last = here[sizes[here] == depth + 1]
            last = last[np.argsort(at[last], kind="stable")]
            ends = np.bincount(at[last], minlength=len(word))
            self.levels.append({"word": word, "phrase": owner[last], "end": np.cumsum(ends) - ends, "ends": ends})
        self.first = np.full(words, _NEVER, np.int32)
        self.last = np.full(words, -1, np.int32)
        self.wanted = np.zeros(words, bool)

    def found(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Owners of the phrases whose words occur in order: ``words[i]`` is matched at ``places[i]``, places ascending.

        A prefix is met at the next place of its last word after the place where the shorter one was. Mostly this
        is the word's first place, or there is none after; only else the places are searched."""
        self.first[words[::-1]] = places[::-1]      # the last one written stays
        self.last[words] = places
        out = [np.zeros(0, np.int64)]
        for depth, level in enumerate(self.levels):
            if depth:
                before = self.levels[depth - 1]
                nexts = before["nexts"][live]
                node, after = _ranges(before["next"][live], nexts), np.repeat(met, nexts)
                word = level["word"][node]
                ok = np.flatnonzero(self.last[word] > after)
                live = node[ok]
                if "next" in level:
                    word, after = word[ok], after[ok]
                    met = self.first[word]
                    again = np.flatnonzero(met <= after)
                    if len(again):
                        met[again] = self._next(words, places, word[again], after[again])
            else:
                met = self.first[level["word"]]
                live = np.flatnonzero(met != _NEVER)
                met = met[live]
            if not len(live):
                break
            out.append(level["phrase"][_ranges(level["end"][live], level["ends"][live])])
        self.first[words] = _NEVER
        self.last[words] = -1
        return np.concatenate(out)

    def _next(self, words, places, word, after):
        """The next place after ``after`` of each word; it has one."""
        self.wanted[word] = True
        some = np.flatnonzero(self.wanted[words])
        self.wanted[word] = False
        keys = np.sort((words[some] << 32) | places[some])
        return keys[np.searchsorted(keys, (word << 32) | (after.astype(np.int64) + 1))] & 0xFFFFFFFF


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of the ranges ``first[i] .. first[i] + counts[i] - 1``."""
    ends = np.cumsum(counts)
    out = np.repeat(first - ends + counts, counts)
    out += np.arange(len(out))
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(non-empty tokens of all texts, how many tokens come before each text and at the end)."""
    inside = ~_DELIMITER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(data[inside])])
    return tokens, np.searchsorted(starts, offsets)


class _Phrases:
    """Phrases (distinct ids' numbers, normalized texts as bytes, words) to look for in chunks of rows."""

    def __init__(self, owner: np.ndarray, texts: list[bytes], flat: np.ndarray, sizes: np.ndarray, words: list[bytes], edits: list[int]):
        distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        of = np.array([distinct[t] for t in texts])
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of)
        self.same, self.sames, self.holders = np.cumsum(counts) - counts, counts, owner[order]   # ids by text
        self.unique = len(np.unique(owner)) == len(owner)
        self.finder, self.matcher = TextFinder(list(distinct)), WordMatcher(words, edits)
        self.prefixes = PhrasePrefixes(flat, sizes, len(words), owner)

    def rows(self, keys: pa.Array, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row of a key, numbers of the ids found, whether exactly) of rows sorted by key."""
        data, offsets = _buffers(texts)
        number = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        groups = np.flatnonzero(np.diff(number, prepend=-1))
        ends = np.append(groups[1:], len(number))
        tokens, before = _tokens(data, offsets)
        coded = tokens.dictionary_encode()
        token = coded.indices.to_numpy()
        count, word = self.matcher.match(*_buffers(coded.dictionary))
        start = np.cumsum(count) - count
        text, string = self.finder.find(data, offsets)
        text = np.searchsorted(groups, text, "right") - 1
        exact_at = np.searchsorted(text, np.arange(len(groups) + 1))
        for g, (lo, hi) in enumerate(zip(groups.tolist(), ends.tolist())):
            mine = token[before[lo]:before[hi]]
            if hi - lo == 1:
                place = np.arange(len(mine), dtype=np.int32)
            else:       # rows of one key: their tokens by place
                place = np.concatenate([np.arange(n, dtype=np.int32) for n in np.diff(before[lo:hi + 1])])
                order = np.argsort(place, kind="stable")
                mine, place = mine[order], place[order]
            counts = count[mine]
            found = self.prefixes.found(word[_ranges(start[mine], counts)].astype(np.int64), np.repeat(place, counts))
            if not self.unique:
                found = np.unique(found)
            exact = np.zeros(len(found), bool)
            whole = string[exact_at[g]:exact_at[g + 1]]
            if len(whole):
                whole = np.unique(self.holders[_ranges(self.same[whole], self.sames[whole])])
                found = np.union1d(found, whole)
                exact = np.isin(found, whole)
            if len(found):
                yield lo, found, exact


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts) of about ``CHUNK_BYTES``; the rows of a key, which follow one another, stay together."""
    held, size = [], 0

    def joined():
        table = pa.Table.from_batches(held)
        return table.column(0).combine_chunks(), table.column(1).cast(pa.large_binary()).combine_chunks()
    for batch in batches:
        if not batch.num_rows:
            continue
        if size + batch.nbytes > CHUNK_BYTES and held:
            keys, texts = joined()
            number = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cut = int(np.flatnonzero(np.diff(number, prepend=-1))[-1])
            if cut:
                yield keys[:cut], texts[:cut]
            rest = pa.RecordBatch.from_arrays([keys[cut:], texts[cut:].cast(held[0].schema.field(1).type)], schema=held[0].schema)
            held, size = [rest], rest.nbytes
        held.append(batch)
        size += batch.nbytes
    if held:
        yield joined()


def _consumed(key_name: str, ids: list, id_type: str, *of):
    """mapInArrow function: (key, phrase id, exact) of the phrases that the rows of each key hold."""
    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(ids, pa.int64() if id_type == "long" else pa.string())
        phrases = None
        for keys, texts in _chunks(batches):
            phrases = phrases or _kept(call, lambda: _Phrases(*of))
            held: list[tuple] = []

            def batch(held):
                at = np.repeat([r for r, _, _ in held], [len(f) for _, f, _ in held])
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), names.take(pa.array(np.concatenate([f for _, f, _ in held]))),
                                                   pa.array(np.concatenate([e for _, _, e in held]))], [key_name, "phrase_id", "exact"])
            n = 0
            for row, found, exact in phrases.rows(keys, texts):
                for lo in range(0, len(found), BATCH_ROWS):
                    held.append((row, found[lo:lo + BATCH_ROWS], exact[lo:lo + BATCH_ROWS]))
                    n += len(held[-1][1])
                    if n >= BATCH_ROWS:
                        yield batch(held)
                        held, n = [], 0
            if held:
                yield batch(held)
    return run


def match_phrases(rows: DataFrame, phrases: list[tuple], key_col: str = "hash", text_col: str = "cmd") -> DataFrame:
    """(key, phrase id, exact) of every row that a phrase matches, exactly or with typos.

    ``phrases``: (id, text) pairs, as loaded by a user; ``key_col`` names a row. A phrase of white space
    matches nothing, as does a null text.
    """
    normal = [(i, normalize_phrase(p)) for i, p in phrases]
    normal = [(i, p) for i, p in normal if p]
    if not normal:
        return rows.select(key_col).limit(0).select(key_col, F.lit(None).cast("string").alias("phrase_id"), F.lit(False).alias("exact"))
    id_type = "long" if isinstance(normal[0][0], int) else "string"
    words = {_latin1_literal(x): edit_threshold(x) for _, p in normal for x in p.split()}
    number = {w: i for i, w in enumerate(words)}
    ids = {i: n for n, i in enumerate(dict.fromkeys(i for i, _ in normal))}
    texts = rows.select(F.col(key_col).alias("_k"), F.lower(F.col(text_col)).alias("_t"))
    dealt = spread(texts, "_t", PART_BYTES, "_k").sortWithinPartitions("_k").select("_k", F.col("_t").cast("binary").alias("_t"))
    out = StructType([StructField(key_col, dealt.schema["_k"].dataType), StructField("phrase_id", LongType() if id_type == "long" else StringType()),
                      StructField("exact", BooleanType())])
    split = [[number[_latin1_literal(x)] for x in p.split()] for _, p in normal]
    return dealt.mapInArrow(_consumed(
        key_col, list(ids), id_type, np.array([ids[i] for i, _ in normal]), [p.encode("utf-8", "surrogateescape") for _, p in normal],
        np.concatenate([np.array(x, np.int64) for x in split]), np.array([len(x) for x in split]), [w.encode("latin-1") for w in words], list(words.values())), out)
