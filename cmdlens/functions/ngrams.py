"""Byte trigrams packed into 24-bit integers.

Three consecutive bytes b0 b1 b2 of a string become
``b0 << 16 | b1 << 8 | b2``. Inputs shorter than three bytes have none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import byte_view


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trigrams(text: Column | str) -> Column:
    """array<int> of every byte trigram of ``text`` in order (duplicates kept);
    empty for inputs under three bytes."""
    return F.transform(trigram_windows(text), lambda g: pack_gram(g))


def distinct_trigrams(text: Column | str) -> Column:
    """Set of byte trigrams of ``text`` (what the inverted index stores)."""
    return F.transform(distinct_trigram_strings(text), lambda g: pack_gram(g))


def trigram_windows(text: Column | str) -> Column:
    """Every 3-byte window of ``text`` as a 3-character Latin-1 string, in order.

    One native regex pass: a zero-width lookahead captures every overlapping
    window (DOTALL, so line breaks count as bytes too).
    """
    return F.regexp_extract_all(byte_view(text), F.lit("(?s)(?=(.{3}))"), 1)


def distinct_trigram_strings(text: Column | str) -> Column:
    """Distinct 3-byte windows of ``text`` (3-character Latin-1 strings)."""
    return F.array_distinct(trigram_windows(text))


def pack_gram(gram3: Column | str) -> Column:
    """int value of a 3-character Latin-1 window: b0 << 16 | b1 << 8 | b2."""
    g = _as_col(gram3)
    return (F.ascii(F.substring(g, 1, 1)) * 65536 + F.ascii(F.substring(g, 2, 1)) * 256
            + F.ascii(F.substring(g, 3, 1))).cast("int")


def trigrams_of(text: str) -> list[int]:
    """Driver-side trigrams of a query literal (keywords are tiny)."""
    b = text.encode("utf-8")
    return [(b[i] << 16) | (b[i + 1] << 8) | b[i + 2] for i in range(len(b) - 2)]


def gram_bytes(gram: int) -> bytes:
    """The three bytes a packed trigram stands for."""
    return bytes([(gram >> 16) & 0xFF, (gram >> 8) & 0xFF, gram & 0xFF])
