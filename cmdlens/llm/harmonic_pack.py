"""Harmonic packing of tokenised documents into fixed-size training sequences.

Class k holds pieces of length in (C/(k+1), C/k]; a sequence of class k holds
exactly k of them, so workers fill sequences of their own, class by class, with
no search. A document is cut into full sequences; what is left is taken whole if
its class wastes at most ``MAX_WASTE`` of a sequence, else a piece of exactly the
next class's size is cut off first (that class then wastes nothing). Pieces
shorter than C/``CLASSES`` form one last class that is filled next-fit.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, per_worker, stored

CAPACITY = 1024
CLASSES = 32
MAX_WASTE = 0.03
PER_WORKER = 20_000           # pieces that one worker packs by itself (half a sequence per class stays open)
MEMO_WORDS = 250_000          # cached words of a tokenising worker, kept while other stages run in it; as many again are kept from before
END_ID = 0

_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, _order string, _own long")


def cut_lengths(n: int, capacity: int = CAPACITY, classes: int = CLASSES, max_waste: float = MAX_WASTE) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        k = capacity // r
        if k >= classes or k * r >= (1 - max_waste) * capacity:
            out.append(r)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        r -= piece
    return out


class _Tokens(dict):
    """Token ids of texts, as little-endian bytes, through a bounded memo of words.

    The tokenizer's pre-tokens never run from a non-white character into white
    space, so a text may be cut before any blank or line feed that follows one;
    the parts' ids, joined, are the text's ids. The memo maps a word to the ids of
    a blank and the word, and, under a key of its own, what follows a line feed to
    the ids from the line feed on; words with a line feed inside are made of these
    and not kept. A full memo becomes the old one, from which words in use come back. Plain words are one pre-token and go to the tokenizer's
    model directly, anything else through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.unsafe = re.compile(r"\s ").search
        self.cut = re.compile(r"(?<=\S)(?=[ \n])").split
        self.feed = self._encoded("\n")
        # Latin letters; ASCII signs; and, from a line feed on, the rest
        self.word = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)(\n(?s:.)*)?").fullmatch
        self.line = re.compile(r"\n([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)(\n(?s:.)*)?").fullmatch
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text. A batch's words are told apart by Arrow, so each distinct one is looked up once."""
        if len(self) > MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        unsafe = [self.unsafe(t) is not None for t in texts]  # a blank after white space: no cut before it
        parts = [(t, "", "") if u else t.partition(" ") for t, u in zip(texts, unsafe)]
        words = pc.split_pattern(pa.array([rest if blank else None for _, blank, rest in parts], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        distinct = pa.array([self[w] for w in coded.dictionary.to_pylist()], pa.large_binary())
        joined = distinct.take(coded.indices)
        at = np.concatenate([[0], np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False), dtype=np.int64)])[words.offsets.to_numpy()].tolist()
        ids = memoryview(joined.buffers()[2] or b"")
        for (first, _, _), u, start, end in zip(parts, unsafe, at, at[1:]):
            if u:
                yield b"".join([self[p[1:]] if p[0] == " " and len(p) > 1 else self._whole(p) for p in self.cut(first) if p])
            else:
                yield self._whole(first) + ids[start:end]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        if word.isascii() and word.isalpha():
            ids = self._letters(" ", word)
        elif m := self.word(word):
            body, tail, rest = m.groups()
            # letters, then signs: two pre-tokens; a line feed after them opens a new part
            ids = self[body] if tail or rest else self._letters(" ", body)
            if tail:
                ids += self.tail(tail)
            if rest:
                return ids + self.after(rest)
        else:
            ids = self._whole(" " + word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def after(self, rest: str) -> bytes:
        """Ids of a part that starts with a line feed and has no blank."""
        key = "\0" + rest
        ids = self.get(key) or self.old.get(key)
        if ids is None:
            m = self.line(rest)
            if not m:
                ids = self._encoded(rest)
            else:
                letters, tail, more = m.groups()
                if more:
                    return self.after("\n" + letters + tail) + self.after(more)
                ids = self.feed + self._letters("", letters)
                if tail:
                    ids += self.tail(tail)
        if len(rest) <= 64:
            self[key] = ids
        return ids

    def tail(self, signs: str) -> bytes:
        key = "\0" + signs  # no word of one cut part and a tail share a key: a tail has no letter
        ids = self.get(key)
        if ids is None:
            ids = self._encoded(signs)
            if len(signs) <= 64:
                self[key] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        if text[:1] == "\n" and text[1:].isalpha() and text.isascii():
            return self.feed + self._letters("", text[1:])
        return self._encoded(text)

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, before: str, letters: str) -> bytes:
        """Ids of a pre-token: letters of the Latin blocks, after a blank or nothing."""
        if letters.isascii():
            symbols = "\u0120" + letters if before else letters
        else:
            symbols = (before + letters).encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()


def _tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenised and cut documents: doc_id, start, length, ids_crc32, doc_tokens, class, ids hash order,
    and the number of a piece's own sequence if no second piece of its length fits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _tokenizer_path(tokenizer_path)
        tokens = per_worker(("tokens", path), lambda: _Tokens(path))
        sequence = TaskContext.get().partitionId() << 36   # of the full sequences, which take one piece each
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            doc_ids, keys = batch.column(0), batch.column(2).to_pylist()
            rows: list[tuple] = []
            for d, (key, ids) in enumerate(zip(keys, tokens([t or "" for t in batch.column(1).to_pylist()]))):
                ids = memoryview(ids + end)
                n, start = len(ids) // 4, 0
                for length in cut_lengths(n, capacity):
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    cls = min(CLASSES, capacity // length)
                    rows.append((d, start, length, crc, n, cls, key, sequence if cls == 1 else None))
                    sequence += cls == 1
                    start += length
            if not rows:
                continue
            d, start, length, crc, n, cls, key, own = (list(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(d, pa.int32())).cast(pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int32()), pa.array(key, pa.string()), pa.array(own, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "_order", "_own"])

    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                        F.hex(F.xxhash64("doc_id", "text")).alias("_order"))
    return small.mapInArrow(run, _SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY,
         per_worker: int = PER_WORKER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class.

    A null text counts as empty and is, like any empty text, its end id alone. A
    text of any length is cut into full sequences. Repeated rows are packed each;
    rows equal in all columns are interchangeable. A worker's bucket is chosen by
    a hash of the row, so no class or document makes one task larger.
    """
    p = stored(pieces(docs, tokenizer_path, capacity), "pieces")
    n_buckets = bucket_count(p.filter("class > 1").count(), per_worker)
    # a piece that fills its sequence alone needs no neighbours
    alone = p.filter("class = 1").select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                         (F.col("_own") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), "class")
    p = p.filter("class > 1").withColumn("_bucket", F.pmod(F.xxhash64("_order", "start"), F.lit(n_buckets)))
    order = ["_order", "start", "ids_crc32"]
    in_class = Window.partitionBy("_bucket", "class").orderBy(*order)
    # fixed count: the i-th piece of class k goes to sequence i // k
    rank = F.row_number().over(in_class) - 1
    # last class, next-fit on a running total: a sequence closes once another longest piece might not fit
    longest = capacity // CLASSES
    total = F.coalesce(F.sum("length").over(in_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fill = F.floor(total / F.lit(capacity - longest + 1))
    p = p.withColumn("_bin", F.when(F.col("class") < CLASSES, F.floor(rank / F.col("class"))).otherwise(fill))
    # bin numbers stay below 2^31 per bucket and class
    sequence = (F.col("_bucket") * (CLASSES + 1) + F.col("class")) * F.lit(1 << 31).cast("bigint") + F.col("_bin")
    p = p.withColumn("sequence_id", sequence * 2)
    before = Window.partitionBy("_bucket", "class", "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return alone.unionByName(p.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"), "class"))
