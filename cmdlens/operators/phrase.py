"""Exact and typo-tolerant phrase matching (all native higher-order functions).

Exact: the trimmed, lower-cased phrase is a substring of the lower-cased
command. Fuzzy: the phrase words are consumed greedily, in order, over the
command's shell tokens; a token consumes the current word when it contains
it or is within ``max(1, bytes // 5)`` byte edits of it. The command matches
when every word is consumed. Results list exact matches before fuzzy ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_view, edit_threshold, shell_tokens


def normalize_phrase(phrase: str) -> str:
    # same character classes the matcher trims and splits on
    return phrase.strip().lower()


def phrase_exact(cmd: Column, phrase: str) -> Column:
    p = normalize_phrase(phrase)
    if not p:
        return F.lit(False)
    return F.contains(F.lower(cmd), F.lit(p))


def _latin1_literal(word: str) -> str:
    """A query word as the Latin-1 view of its UTF-8 bytes."""
    return word.encode("utf-8").decode("latin-1")


def phrase_fuzzy(cmd: Column, phrase: str) -> Column:
    """True when all phrase words are consumed in order by the command's tokens.

    Tokens come from the Latin-1 (one character per byte) view of the
    lower-cased command, computed once per row, so ``contains`` and the
    bounded ``levenshtein(token, word, threshold)`` work on bytes with no
    per-token re-encoding. Each word is a literal in its own branch, so the
    edit-distance threshold is a constant and the DP stops early.
    """
    p = normalize_phrase(phrase)
    words = p.split()
    if not words:
        return F.lit(False)
    n = len(words)

    def word_hit(tok, k):
        w = F.lit(_latin1_literal(words[k]))
        return F.contains(tok, w) | (F.levenshtein(tok, w, edit_threshold(words[k])) >= 0)

    def step(qi, tok):
        hit = F.lit(False)
        for k in reversed(range(n)):
            hit = F.when(qi == k, word_hit(tok, k)).otherwise(hit)
        return F.when(qi < n, F.when(hit, qi + 1).otherwise(qi)).otherwise(qi)

    tokens = shell_tokens(byte_view(F.lower(cmd)))
    consumed = F.aggregate(tokens, F.lit(0), step)
    return consumed == n


def phrase_match(cmd: Column, phrase: str) -> tuple[Column, Column]:
    """(matched, exact) columns for one phrase."""
    exact = phrase_exact(cmd, phrase)
    fuzzy = phrase_fuzzy(cmd, phrase)
    return exact | fuzzy, exact
