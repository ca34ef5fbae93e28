"""SentencePiece encoding and decoding as a weighted transducer in the tropical semiring.

Compiled from a model file: the normaliser (the model's character map as a rewriting
transducer that takes the longest rule at each place, white space to the blank mark,
dummy prefix or suffix), the pieces as a transducer whose arcs read a piece and write
its id, and byte fallback, whose arcs read an unknown character and write its UTF-8
bytes. The normaliser writes one output only; an input composed with these is a lattice over its characters; the
encoding is the lattice's shortest path.

Weights. In a unigram model an arc weighs minus the piece's score. A BPE model
gives no weight to a piece by itself: its result is fixed by the order of merges.
There the state also holds the last piece, and an arc weighs 0 if merging the
pair of pieces leaves them as they are, else infinity. Merges at a boundary
depend on the two adjacent pieces only, so a sequence is the model's encoding
exactly if every adjacent pair is stable; one path of finite weight exists, and
one survivor per character position finds it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker

BLANK = "▁"
MEMO_SEGMENTS = 1_000_000     # some 150 MB of a worker
MEMO_PAIRS = 400_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def character_rules(charsmap: bytes) -> dict[str, str]:
    """Rewriting rules of a model's precompiled character map.

    The map is a length, a double-array trie of UTF-8 keys and the outputs, ended by zero bytes
    each. The trie is walked a level at a time, all children of a level at once.
    """
    size = int.from_bytes(charsmap[:4], "little")
    units = np.frombuffer(charsmap[4:4 + size], "<u4").astype(np.int64)
    outputs = charsmap[4 + size:]

    def children(of: np.ndarray) -> np.ndarray:  # where the children of these units lie
        return of >> 10 << ((of & 0x200) >> 6)

    rules, labels = {}, np.arange(1, 256)
    nodes, keys = children(units[:1]), [b""]
    while len(nodes):
        at = nodes[:, None] ^ labels
        found = (at < len(units)) & ((units[np.minimum(at, len(units) - 1)] & 0x800000FF) == labels)
        parent, child = np.nonzero(found)
        unit = units[at[parent, child]]
        nodes = at[parent, child] ^ children(unit)
        keys = [keys[p] + bytes([c + 1]) for p, c in zip(parent.tolist(), child.tolist())]
        for i in np.flatnonzero(unit & 0x100).tolist():
            start = int(units[nodes[i]] & 0x7FFFFFFF)
            rules[keys[i].decode()] = outputs[start:outputs.index(b"\0", start)].decode()
    return rules


class Rewriter:
    """The character map as a transducer: at each place the longest rule is taken, other characters pass."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules
        self.states = {k[:n] for k in rules for n in range(1, len(k) + 1)}
        single = "".join(re.escape(k) for k in rules if len(k) == 1)
        second = "".join(sorted({re.escape(k[1]) for k in rules if len(k) > 1}))
        # a rule starts at a character with a rule of its own, or before some rule's second character
        starts = ([f"[{single}]"] if single else []) + ([f".(?=[{second}])"] if second else [])
        self.start = re.compile("|".join(starts) or "(?!)", re.DOTALL)

    def outputs(self, text: str) -> Iterator[tuple[str, bool]]:
        """The outputs in order, and whether a rule wrote them."""
        done, at, n = 0, 0, len(text)
        while found := self.start.search(text, at):
            at = found.start()
            end, stop = at + 1, None
            while end <= n and text[at:end] in self.states:
                if text[at:end] in self.rules:
                    stop = end
                end += 1
            if stop is None:
                at += 1
                continue
            if done < at:
                yield text[done:at], False
            yield self.rules[text[at:stop]], True
            done = at = stop
        if done < n:
            yield text[done:], False


class PieceTransducer:
    """Encoder and decoder compiled from a SentencePiece model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if not norm.escape_whitespaces:
            raise NotImplementedError("only models that write white space as the blank mark are compiled")
        if spec.model_type not in (UNIGRAM, BPE) or any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise NotImplementedError("only unigram and BPE models without user-defined or unused pieces are compiled")
        self.bpe = spec.model_type == BPE
        suffixed = spec.treat_whitespace_as_suffix
        self.prefix, self.suffix = norm.add_dummy_prefix and not suffixed, norm.add_dummy_prefix and suffixed
        self.squeeze, self.bos_blank = norm.remove_extra_whitespaces, norm.add_dummy_prefix or norm.remove_extra_whitespaces
        self.rewriter = Rewriter(character_rules(norm.precompiled_charsmap)) if norm.precompiled_charsmap else None
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unk = self.types.index(UNKNOWN)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.fallback = spec.byte_fallback and len(self.bytes_) == 256
        self.longest = max(map(len, self.ids), default=1)
        self.unk_cost = 10.0 - min(self.scores.values(), default=0.0)
        # pieces' prefixes: the states of the piece transducer
        self.states = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        # a cut is safe where no piece runs from another character into a blank
        self.cuttable = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        # an id's text as bytes; control and unknown ids write nothing of their own
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.encode() if t == NORMAL else b" \xe2\x81\x87 " if t == UNKNOWN else b""
                    for p, t in zip(self.pieces, self.types)]
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.whole: dict[str, bool] = {}  # bounded by the vocabulary and single characters

    def normalise(self, text: str) -> str:
        outputs = list(self.rewriter.outputs(text)) if self.rewriter else [(text, False)]
        if not text or self.squeeze and all(x and not x.strip(" ") for x, _ in outputs):
            return ""
        text = self._squeezed(outputs) if self.squeeze else "".join(x for x, _ in outputs)
        if self.squeeze and not text:
            return BLANK if self.suffix else ""
        return ((" " if self.prefix else "") + text + (" " if self.suffix else "")).replace(" ", BLANK)

    def _squeezed(self, outputs: list[tuple[str, bool]]) -> str:
        """A space at the text's ends or after a space goes, but for those inside one rule's output."""
        out, after_space = [], True
        for x, by_rule in outputs:
            if not by_rule:
                x = re.sub(" +", " ", x)
            if after_space:
                x = x.lstrip(" ")
            if x:
                out.append(x)
                after_space = x.endswith(" ")
        return "".join(out).rstrip(" ")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        body = self.normalise(text)
        if self.cuttable:
            # a blank that follows another character opens a segment
            parts = [BLANK + x for x in body.split(BLANK)]
            parts[0] = parts[0][1:]
            segments, run = [], ""
            for x in parts:
                if len(x) == 1 and x == BLANK:
                    run += x
                elif x:
                    segments.append(run + x if run else x)
                    run = ""
            if run:
                segments.append(run)
        else:
            segments = [body] if body else []
        memo = self.memo
        if len(memo) > MEMO_SEGMENTS:
            memo.clear()
        out = []
        for s in segments:
            ids = memo.get(s)
            if ids is None:
                ids = b"".join([self._part(x) for x in self._cut(s)])
                if len(s) <= 64:
                    memo[s] = ids
            out.append(ids)
        return b"".join(out)

    def _cut(self, s: str) -> list[str]:
        """Parts of a segment: no piece holds the two characters around a cut, so every
        path of the lattice passes there and the parts' shortest paths join up."""
        inside = self.inside
        if not self.fallback:  # unknown characters in a row share one id, wherever they stand
            return [s]
        cuts = [i for i in range(1, len(s)) if s[i - 1:i + 1] not in inside]
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)])] if cuts else [s]

    def _part(self, s: str) -> bytes:
        ids = self.memo.get(s)
        if ids is None:
            ids = self._shortest(s)
            if len(s) <= 64:
                self.memo[s] = ids
        return ids

    def _shortest(self, s: str) -> bytes:
        path = self._stable_path(s) if self.bpe else self._lightest_path(s)
        out: list[int] = []
        for a, b in path:
            piece = s[a:b]
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.fallback:
                out.extend(self.bytes_[x] for x in piece.encode("utf-8", "surrogatepass"))
            elif not (out and out[-1] == self.unk):  # unknown characters in a row are one unknown
                out.append(self.unk)
        return np.array(out, "<u4").tobytes()

    def _arcs(self, s: str, a: int) -> Iterator[int]:
        """Ends of the pieces that start at ``a`` (any single character is an arc)."""
        n, known = len(s), False
        for b in range(a + 1, min(n, a + self.longest) + 1):
            piece = s[a:b]
            if piece not in self.states:
                break
            if piece in self.ids:
                known |= b == a + 1
                yield b
        if not known:
            yield a + 1

    def _stable_path(self, s: str) -> list[tuple[int, int]]:
        """One survivor per position: the last piece of the encoding of the text up to it."""
        n = len(s)
        start, last = [-1] * (n + 1), [""] * (n + 1)  # the last piece that ends at a position
        states, ids, longest = self.states, self.ids, self.longest
        for a in range(n):
            if a and start[a] < 0:
                continue
            left = last[a]
            known = self._after(left)
            for b in range(a + 1, min(n, a + longest) + 1):
                piece = s[a:b]
                if b > a + 1:
                    if piece not in states:
                        break
                    if piece not in ids:
                        continue
                if start[b] < 0:
                    stable = known.get(piece)
                    if stable is None:
                        stable = known[piece] = self._stable(left, piece)
                    if stable:
                        start[b], last[b] = a, piece
        return _backtrack(start, n)

    def _after(self, left: str) -> dict[str, bool]:
        """The memo of which pieces are stable after ``left``; all memos are bounded together."""
        known = self.pairs.get(left)
        if known is None:
            if self.n_pairs > MEMO_PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            known = self.pairs[left] = {}
        return known

    def _stable(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends with these two pieces (weight 0)."""
        self.n_pairs += 1
        return (not left or self._whole(right)) and self._merge(left + right) == ([left, right] if left else [right])

    def _whole(self, piece: str) -> bool:
        """Whether a piece's own characters merge to it."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self._merge(piece) == [piece]
        return known

    def _merge(self, s: str) -> list[str]:
        """Merges of a short string: always the best-scored adjacent pair, leftmost first."""
        parts, scores = list(s), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _lightest_path(self, s: str) -> list[tuple[int, int]]:
        n = len(s)
        cost, start = [float("inf")] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        for a in range(n):
            for b in self._arcs(s, a):
                w = cost[a] + (-self.scores[s[a:b]] if s[a:b] in self.scores else self.unk_cost)
                if w < cost[b]:
                    cost[b], start[b] = w, a
        return _backtrack(start, n)

    def decode(self, ids: bytes) -> str:
        """Text of ids given as by :meth:`encode`; bytes that form no UTF-8 read U+FFFD each."""
        raw = self.raw
        body = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            text = _decode_each(body)
        text = text.replace(BLANK, " ")
        # only a piece's blank mark is the dummy prefix, a blank written as a byte is not
        for i in np.frombuffer(ids, "<u4").tolist() if self.bos_blank else ():
            blank = self.types[i] == NORMAL and self.pieces[i].startswith(BLANK)
            if blank:
                text = text[1:]
            if self.types[i] not in (NORMAL, CONTROL) or not (blank and self.squeeze and self.pieces[i] == BLANK) and self.raw[i]:
                break
            if blank and not self.squeeze:
                break
        return text


def _backtrack(start: list[int], n: int) -> list[tuple[int, int]]:
    path = []
    while n > 0:
        path.append((start[n], n))
        n = start[n]
    return path[::-1]


def _decode_each(body: bytes) -> str:
    out, at = [], 0
    while at < len(body):
        try:
            out.append(body[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(body[at:at + e.start].decode("utf-8"))
            out.append("�")
            at += e.start + 1
    return "".join(out)


def _model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ids, n_bytes (fallback ids), ids_crc32,
    ids (array; null unless ``with_ids``), decoded.

    Null and empty texts have no ids and decode to the empty text. Texts of any
    length are encoded whole: memory grows with one text and the bounded memos.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _model_path(model_path)
        machine = per_worker(("piece-transducer", path), lambda: PieceTransducer(Path(path).read_bytes()))
        is_byte = np.array([t == BYTE for t in machine.types])
        for batch in batches:
            ids, decoded, n_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                raw = machine.encode(text or "")
                ids.append(np.frombuffer(raw, "<u4"))
                n_bytes.append(int(is_byte[ids[-1]].sum()))
                decoded.append(machine.decode(raw))
            sizes = np.array([len(x) for x in ids], np.int64)
            arrays = pa.nulls(len(ids), pa.list_(pa.int32()))
            if with_ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                arrays = pa.ListArray.from_arrays(
                    offsets, pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32), pa.int32()))
            crc = [zlib.crc32(x.tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(n_bytes, pa.int64()), pa.array(crc, pa.int64()),
                 arrays, pa.array(decoded, pa.string())],
                ["doc_id", "n_ids", "n_bytes", "ids_crc32", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_ids long, n_bytes long, ids_crc32 long, ids array<int>, decoded string")
