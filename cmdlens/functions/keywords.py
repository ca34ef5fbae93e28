"""Which of many literal keywords a text holds, in one pass over the text.

Every place of the text gives one window of fixed width. Its head -- the first
bytes, as many as the shortest keyword has -- is looked up in the set of the
keywords' heads; only windows found there are cut at the keywords' lengths and
looked up in the set of keywords. The sets are hashed once per task, so the cost
per place depends on the keywords' lengths, not on their number. Keywords longer
than a window are looked up by their first ``WIDTH`` bytes, and only texts that
hold one of these are cut at the full lengths. Where no keyword holds a blank or line
feed, the text is first cut at these, and of equal pieces one is looked at.

Everything is in bytes (a Latin-1 view of the UTF-8 text).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import byte_view

WIDTH = 16


def _view(s: str) -> str:
    return s.encode("utf-8", "surrogateescape").decode("latin-1")


def _windows(view: Column, least: int, most: int) -> Column:
    """Every window of up to ``most`` bytes (at least ``least`` near the end), in order."""
    return F.regexp_extract_all(view, F.lit("(?s)(?=(.{%d,%d}))" % (least, most)), 1)


def _whole_cuts(view: Column, keywords: list[str], length: int) -> Column:
    """The windows of one length that are keywords."""
    known = [k for k in keywords if len(k) == length]
    return F.filter(_windows(view, length, length), lambda w: w.isin(known))


def _cuts(keywords: list[str], width: int):
    """(length of the head, lengths of the cuts, what a cut may be) of Latin-1 keywords."""
    cuts = sorted({min(len(k), width) for k in keywords})
    return cuts[0], cuts, sorted({k[:width] for k in keywords})


def _at_a_hit(view: Column, keywords: list[str], width: int):
    """(windows whose head is a keyword's, their cuts that are keywords or start a longer one)."""
    head, cuts, known = _cuts(keywords, width)
    windows = F.filter(_windows(view, head, cuts[-1]), lambda w: F.substring(w, 1, head).isin([k[:head] for k in known]))

    def found(w):
        return F.filter(F.array(*[F.substring(w, 1, n) for n in cuts]), lambda c: c.isin(known))
    return windows, found


def found_keywords(text: Column | str, keywords: list[str], width: int = WIDTH) -> Column:
    """array<string>: the distinct non-empty keywords that ``text`` holds, sorted; null for null text."""
    words = sorted({_view(k) for k in keywords if k})
    text = F.col(text) if isinstance(text, str) else text
    if not words:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    view = byte_view(text)
    if not any(" " in w or "\n" in w for w in words):
        # no keyword crosses a blank or line feed: one copy of each long enough piece between them says it all
        least = min(map(len, words))
        view = F.array_join(F.filter(F.array_distinct(F.split(view, "[ \n]")), lambda t: F.char_length(t) >= least), " ")
    windows, found = _at_a_hit(view, words, width)
    cuts = F.array_distinct(F.flatten(F.transform(windows, found)))
    long_words = [w for w in words if len(w) > width]

    def whole(heads: Column) -> Column:
        short = F.filter(heads, lambda c: c.isin([w for w in words if len(w) <= width])) if len(long_words) < len(words) \
            else F.array().cast("array<string>")
        if not long_words:
            return short
        tails = F.array_distinct(F.flatten(F.array(*[_whole_cuts(view, long_words, n) for n in sorted({len(k) for k in long_words})])))
        return F.when(F.exists(heads, lambda c: c.isin([w[:width] for w in long_words])), F.concat(short, tails)).otherwise(short)

    def text_of(view_: Column) -> Column:
        return F.encode(view_, "ISO-8859-1").cast("string")
    result = F.get(F.transform(F.array(cuts), whole), F.lit(0))
    return F.when(text.isNotNull(), F.array_sort(F.transform(result, text_of)))


def holds_any(text: Column | str, keywords: list[str], width: int = WIDTH) -> Column:
    """Whether ``text`` holds any non-empty keyword."""
    words = sorted({_view(k) for k in keywords if k})
    text = F.col(text) if isinstance(text, str) else text
    if not words:
        return F.lit(False)
    long_words = [w for w in words if len(w) > width]
    short = [w for w in words if len(w) <= width]
    view = byte_view(text)
    hit = F.lit(False)
    if short:
        windows, found = _at_a_hit(view, short, width)
        hit = F.exists(windows, lambda w: F.size(found(w)) > 0)
    if long_words:
        windows, _ = _at_a_hit(view, long_words, width)
        full = [F.size(_whole_cuts(view, long_words, n)) > 0 for n in sorted({len(k) for k in long_words})]
        any_full = full[0]
        for f in full[1:]:
            any_full = any_full | f
        hit = hit | ((F.size(windows) > 0) & any_full)
    return F.coalesce(hit, F.lit(False))
