"""String helpers: byte views, tokens, program names, keywords, edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import byte_view


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_length(text: Column | str) -> Column:
    return F.octet_length(_as_col(text))


def byte_levenshtein(a: Column | str, b: Column | str) -> Column:
    """Unit-cost edit distance over bytes (é vs e is 2, not 1)."""
    return F.levenshtein(byte_view(a), byte_view(b))


def edit_threshold(word: str) -> int:
    """Allowed edit distance for a query word: max(1, byte length // 5)."""
    return max(1, len(word.encode("utf-8")) // 5)


# Fixed delimiter set of shell tokens: space, tab and / = : , ; | & ( ) [ ] { } < >
# (newline is not a delimiter).
SHELL_TOKEN_SPLIT = r"[ \t/=:,;|&()\[\]{}<>]+"


def shell_tokens(text: Column | str) -> Column:
    """Non-empty tokens of ``text`` split on the shell delimiter set."""
    return F.filter(F.split(_as_col(text), SHELL_TOKEN_SPLIT), lambda t: t != "")


def whitespace_fields(text: Column | str) -> Column:
    """Non-empty fields split on Unicode white space."""
    return F.filter(F.split(_as_col(text), r"(?U)\s+"), lambda t: t != "")


def program_name(cmd: Column | str) -> Column:
    """First whitespace field that is not a VAR=value assignment, after its
    last '/'; the whole command when every field is an assignment or none exist.
    """
    c = _as_col(cmd)
    first = F.get(F.filter(whitespace_fields(c), lambda t: ~t.contains("=")), 0)
    return F.coalesce(F.substring_index(first, "/", -1), c)


def split_keywords(query: Column | str) -> Column:
    """Whitespace split of a query string into keywords."""
    return whitespace_fields(query)


def split_keywords_py(query: str) -> list[str]:
    """Driver-side keyword split (``str.split`` splits on Unicode white space)."""
    return query.split()
