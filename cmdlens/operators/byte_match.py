"""Many byte strings at once, in numpy: words in or near tokens, whole phrases in texts.

Every lookup goes by a 64-bit number of a piece of bytes, first to a table of flags and
only for the few places flagged there to the sorted numbers; what is found is compared
byte by byte (words within an edit distance: by the distance itself), so equal numbers of
different bytes cost time, never a wrong row. The cost per place does not depend on the
number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

VARIANT_EDITS = 2         # words that allow more edits are met by their pieces
BLOCK = 1 << 20           # candidates, or bytes of tokens, looked at together
TOKENS = 1 << 16          # tokens looked at together
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_INVERSE_2 = np.uint64(pow(_BASE, -2, 1 << 64))
_BASE = np.uint64(_BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def expand(first: np.ndarray, counts: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the range, value) of the ranges ``first[i] .. first[i] + counts[i] - 1``, about ``most`` at a time."""
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        c = counts[lo:hi]
        of = np.repeat(np.arange(lo, hi), c)
        yield of, np.arange(len(of)) + np.repeat(first[lo:hi] - (ends[lo:hi] - c - before), c)
        lo = hi


class Lookup:
    """Entries by 64-bit number; a number may have many entries."""

    def __init__(self, numbers: np.ndarray):
        self.order = np.argsort(numbers, kind="stable")
        self.known, self.first, self.counts = np.unique(numbers[self.order], return_index=True, return_counts=True)
        bits = min(24, max(10, int(8 * len(self.known)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[(self.known * _MIX) >> self.shift] = True

    def find(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``numbers``, entry) of all equal numbers."""
        at = np.flatnonzero(self.flags[(numbers * _MIX) >> self.shift])
        n = numbers[at]
        known = np.searchsorted(self.known[:-1], n)      # the last one for those beyond all
        same = np.flatnonzero(self.known[known] == n)
        at, known = at[same], known[same]
        for of, entry in expand(self.first[known], self.counts[known]):
            yield at[of], self.order[entry]


def _rows(strings: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(strings), np.uint8).reshape(-1, length)


def _prefix_numbers(rows: np.ndarray) -> list[np.ndarray]:
    """Numbers of the first 0, 1, ... bytes of each row, by their places."""
    out = [np.zeros(len(rows), np.uint64)]
    for c, power in enumerate(_powers(_BASE, rows.shape[1])):
        out.append(out[-1] + (rows[:, c].astype(np.uint64) + np.uint64(1)) * power)
    return out


def _deletions(rows: np.ndarray, edits: int) -> Iterator[np.ndarray]:
    """Numbers of the rows and of what is left when 1 or up to 2 bytes are deleted."""
    p, n = _prefix_numbers(rows), rows.shape[1]
    yield p[n]
    for i in range(n):
        yield p[i] + (p[n] - p[i + 1]) * _INVERSE
        for j in range(i + 1, n if edits > 1 else 0):
            yield p[i] + (p[j] - p[i + 1]) * _INVERSE + (p[n] - p[j + 1]) * _INVERSE_2


def within_edits(tokens: np.ndarray, words: np.ndarray, sizes: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether row i of ``tokens`` is within ``edits[i]`` of the first ``sizes[i]`` bytes of row i of ``words``.

    Only the diagonals within the edits are followed; a size is within the edits of the tokens' length."""
    n, k = tokens.shape[1], int(edits.max())
    kind = np.uint8 if n + 2 * k < 250 else np.int32
    padded = np.zeros((words.shape[1] + n + 2 * k + 2, len(words)), np.uint8)       # word byte j in row j + k
    padded[k:k + words.shape[1]] = words.T
    text, far = np.ascontiguousarray(tokens.T), kind(n + k + 1)
    row = np.full((2 * k + 2, len(words)), far, kind)                               # diagonal d in row d + k, one beyond
    row[k:2 * k + 1] = np.arange(k + 1, dtype=kind)[:, None]
    for i in range(1, n + 1):
        new = np.full_like(row, far)
        differs = (padded[i - 1:i + 2 * k] != text[i - 1]).astype(kind)
        for d in range(max(0, k - i), 2 * k + 1):
            best = np.minimum(row[d] + differs[d], row[d + 1] + kind(1)) if i + d - k > 0 else row[d + 1] + kind(1)
            new[d] = np.minimum(best, new[d - 1] + kind(1)) if d else best
        row = new
        np.minimum(row, far, out=row)
    return row[sizes - n + k, np.arange(len(words))] <= edits


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The distinct values of some parts at a time."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) > BLOCK:
            yield np.unique(np.concatenate(held))
            held = []
    if held:
        yield np.unique(np.concatenate(held))


class WordMatcher:
    """Words, each with its number of edits, against tokens: a word is contained in a token or within its edits of it."""

    def __init__(self, words: list[bytes], edits: list[int]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.edits = np.array(edits, np.int64)
        widest = int(self.size.max())
        self.bytes = np.zeros((len(words), widest), np.uint8)
        self.contained, self.near, self.pieces = {}, {}, {}
        variants: dict[int, list] = {}
        pieces: dict[int, list] = {}
        for length in np.unique(self.size):
            which = np.flatnonzero(self.size == length)
            rows = _rows([words[i] for i in which], int(length))
            self.bytes[which, :length] = rows
            self.contained[int(length)] = (Lookup(_prefix_numbers(rows)[-1]), which)
            for k in np.unique(self.edits[which]):
                mine = self.edits[which] == k
                if k <= VARIANT_EDITS:
                    for v in _deletions(rows[mine], int(k)):
                        variants.setdefault(int(k), []).append((v, which[mine]))
                else:
                    cuts = [q * int(length) // (int(k) + 1) for q in range(int(k) + 2)]
                    for a, b in zip(cuts, cuts[1:]):
                        if a == b:      # a word that allows as many edits as it has bytes: any token of its length may do
                            pieces.setdefault(0, []).append((np.zeros(mine.sum(), np.uint64), which[mine], a))
                        else:
                            pieces.setdefault(b - a, []).append((_prefix_numbers(rows[mine][:, a:b])[-1], which[mine], a))
        for k, found in variants.items():
            sizes = self.size[np.concatenate([w for _, w in found])]
            self.near[k] = (Lookup(np.concatenate([v for v, _ in found])), np.concatenate([w for _, w in found]), sizes.min(), sizes.max())
        for length, found in pieces.items():
            which = np.concatenate([w for _, w, _ in found])
            self.pieces[length] = (Lookup(np.concatenate([v for v, _, _ in found])), which, np.concatenate([np.full(len(w), a) for _, w, a in found]),
                                   (self.size[which] - self.edits[which]).min(), (self.size[which] + self.edits[which]).max())

    def match(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many words each token matches, their numbers by token); token i is ``data[offsets[i]:offsets[i + 1]]``.

        A word may come twice."""
        counts, words = np.zeros(len(offsets) - 1, np.int64), [np.zeros(0, np.int32)]
        lo = 0
        while lo < len(counts):
            hi = max(lo + 1, min(lo + TOKENS, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1))
            found = [*self._matched(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])]
            token = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in found)])
            order = np.argsort(token, kind="stable")
            words.append(np.concatenate([np.zeros(0, np.int32), *(w for _, w in found)])[order])
            counts[lo:hi] = np.bincount(token, minlength=hi - lo)
            lo = hi
        return counts, np.concatenate(words)

    def _matched(self, data, offsets):
        sizes = np.diff(offsets)
        yield from self._containing(data, offsets, sizes)
        reach = int((self.size + self.edits).max())
        for n in np.unique(sizes[sizes <= reach]):
            mine = np.flatnonzero(sizes == n)
            rows = data[offsets[mine][:, None] + np.arange(n)]
            for pairs in _gathered(token * len(self.size) + word for token, word in self._candidates(rows, int(n))):
                token, word = np.divmod(pairs, len(self.size))
                ok = np.abs(self.size[word] - n) <= self.edits[word]
                token, word = token[ok], word[ok]
                if len(token):
                    most = int(self.size[word].max())
                    ok = within_edits(rows[token], self.bytes[word, :most], self.size[word], self.edits[word])
                    yield mine[token[ok]].astype(np.int32), word[ok].astype(np.int32)

    def _containing(self, data, offsets, sizes):
        token_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        left = np.repeat(offsets[1:], sizes) - np.arange(len(data))
        for lo in range(0, len(data), BLOCK):
            hi = min(len(data), lo + BLOCK)
            piece = data[lo:hi + self.bytes.shape[1]].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * _powers(_BASE, len(piece)), dtype=np.uint64)])
            back = _powers(_INVERSE, hi - lo)
            at = np.arange(hi - lo)
            for length, (lookup, which) in sorted(self.contained.items()):
                at = at[left[lo + at] >= length]
                for i, entry in lookup.find((sums[at + length] - sums[at]) * back[at]):
                    place, word = lo + at[i], which[entry]
                    same = np.ones(len(place), bool)
                    for c in range(length):
                        same &= data[place + c] == self.bytes[word, c]
                    yield token_of[place[same]], word[same].astype(np.int32)

    def _candidates(self, rows, n):
        for k, (lookup, which, least, most) in self.near.items():
            if least - k <= n <= most + k:
                for v in _deletions(rows, k):
                    for token, entry in lookup.find(v):
                        yield token, which[entry]
        prefixes = None
        for length, (lookup, which, place, least, most) in self.pieces.items():
            if least <= n <= most and length <= n:
                prefixes = prefixes or _prefix_numbers(rows)
                back = _powers(_INVERSE, n + 1)
                for s in range(n - length + 1):
                    for token, entry in lookup.find((prefixes[s + length] - prefixes[s]) * back[s]):
                        near = np.abs(place[entry] - s) <= self.edits[which[entry]]
                        yield token[near], which[entry[near]]


class TextFinder:
    """Which of many byte strings texts hold: a string is met by that of its windows of 8 (4, or fewer) bytes that
    the fewest strings have, then compared whole."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.classes = []
        widths = np.where(self.size >= 8, 8, np.where(self.size >= 4, 4, self.size))
        for width in np.unique(widths):
            which = np.flatnonzero(widths == width)
            of, place = next(expand(self.start[which], self.size[which] - width + 1, 1 << 62))
            numbers = _windows(self.bytes, int(width))[place]
            _, inverse, counts = np.unique(numbers, return_inverse=True, return_counts=True)
            order = np.lexsort((place, counts[inverse], of))
            best = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
            self.classes.append((int(width), Lookup(numbers[best]), which, place[best] - self.start[which]))

    def find(self, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(text, string) numbers, each once; text i is ``data[offsets[i]:offsets[i + 1]]``."""
        found = [np.zeros(0, np.int64)]
        for width, lookup, which, place in self.classes:
            for lo in range(0, len(data) - width + 1, step):
                for at, entry in lookup.find(_windows(data[lo:lo + step + width - 1], width)):
                    start, string = lo + at - place[entry], which[entry]
                    text = np.searchsorted(offsets, lo + at, "right") - 1
                    ok = (start >= offsets[text]) & (start + self.size[string] <= offsets[text + 1])
                    start, string, text = start[ok], string[ok], text[ok]
                    c = 0
                    while len(start) and c < self.size[string].max():
                        inside = c < self.size[string]
                        same = ~inside
                        same[inside] = data[start[inside] + c] == self.bytes[self.start[string[inside]] + c]
                        start, string, text, c = start[same], string[same], text[same], c + 1
                    found.append(text * len(self.size) + string)
        return np.divmod(np.unique(np.concatenate(found)), len(self.size))


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """The bytes of every window, as a number."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    out = data[:len(data) - width + 1].astype(np.uint64)
    done = 1
    while done < width:     # 2, 4, 8 bytes from two halves; 3 from 2 and 1
        if 2 * done <= width:
            if done == 1:
                wide = data.astype(np.uint64)
            wide = wide[:-done] | (wide[done:] << np.uint64(8 * done))
            done *= 2
            out = wide
        else:
            out = out[:len(data) - width + 1] | (data[done:done + len(data) - width + 1].astype(np.uint64) << np.uint64(8 * done))
            done += 1
    return out
