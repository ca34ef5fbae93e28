"""Driver-side translation of user patterns into Java regular expressions.

Patterns are a handful of user strings; translating them once on the driver
lets every row be tested by the JVM ``rlike`` inside codegen.

* glob (``glob:`` prefix): ``*`` = any run of non-'/', ``?`` = one non-'/',
  ``[...]`` / ``[^...]`` classes with ranges, ``\\`` escapes, whole string.
* regex (``regex:`` prefix): RE2 syntax searched anywhere in the command. Java's
  dialect differs, so the pattern is parsed by RE2's rules and written anew with
  no flags left to interpretation: every character, class, anchor and repetition
  carries the meaning its flags give it in RE2. What RE2 rejects is reported.
"""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


def _lit(ch: str) -> str:
    """Escape one literal character for a Java regex."""
    if ch.isalnum() or ord(ch) > 127 or ch in " _":
        return ch
    if ch == "\n":
        return "\\n"
    if ch == "\t":
        return "\\t"
    if ch == "\r":
        return "\\r"
    if ord(ch) < 32 or ord(ch) == 127:
        return "\\x{%x}" % ord(ch)
    return "\\" + ch


def _class_lit(ch: str) -> str:
    if ch.isalnum() or ord(ch) > 127:
        return ch
    if ord(ch) < 32 or ord(ch) == 127:
        return "\\x{%x}" % ord(ch)
    return "\\" + ch


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex equivalent to a path-style glob; PatternError if malformed."""
    out: list[str] = []
    i, n = 0, len(glob)

    def esc_char(j: int) -> tuple[str, int]:
        # one (possibly escaped) class character starting at j
        if j >= n:
            raise PatternError("unterminated character class")
        c = glob[j]
        if c in "-]":
            raise PatternError("bad character range")
        if c == "\\":
            j += 1
            if j >= n:
                raise PatternError("dangling escape")
            c = glob[j]
        j += 1
        if j >= n:
            raise PatternError("unterminated character class")
        return c, j

    while i < n:
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "\\":
            if i + 1 >= n:
                raise PatternError("dangling escape")
            out.append(_lit(glob[i + 1]))
            i += 2
        elif c == "[":
            i += 1
            negated = i < n and glob[i] == "^"
            if negated:
                i += 1
            ranges: list[tuple[str, str]] = []
            while True:
                if i < n and glob[i] == "]" and ranges:
                    i += 1
                    break
                lo, i = esc_char(i)
                hi = lo
                if glob[i] == "-":
                    hi, i = esc_char(i + 1)
                ranges.append((lo, hi))
            valid = [(lo, hi) for lo, hi in ranges if lo <= hi]
            body = "".join(_class_lit(lo) if lo == hi else f"{_class_lit(lo)}-{_class_lit(hi)}"
                           for lo, hi in valid)
            if negated:
                out.append(f"[^{body}]" if body else "(?s:.)")
            else:
                out.append(f"[{body}]" if body else "(?!)")
        else:
            out.append(_lit(c))
            i += 1
    return "\\A" + "".join(out) + "\\z"


# POSIX bracket classes and their ASCII meaning (RE2 semantics).
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x{0}-\\x{7f}",
    "blank": "\\t\\x{20}", "cntrl": "\\x{0}-\\x{1f}\\x{7f}", "digit": "0-9", "graph": "\\x{21}-\\x{7e}",
    "lower": "a-z", "print": "\\x{20}-\\x{7e}", "punct": "\\x{21}-\\x{2f}\\x{3a}-\\x{40}\\x{5b}-\\x{60}\\x{7b}-\\x{7e}",
    "space": "\\t\\n\\x{b}\\f\\r\\x{20}", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
PERL_CLASSES = {"d": "0-9", "s": "\\t\\n\\f\\r\\x{20}", "w": "0-9A-Za-z_"}
CONTROL_ESCAPES = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
MAX_REPEAT = 1000
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_BOUNDARY = f"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"
_CATEGORY = re.compile(r"(?:C[cfos]?|L[lmotu]?|M[cen]?|N[dlo]?|P[cdefios]?|S[ckmo]?|Z[lps]?)$")


class _Re2Parser:
    """Recursive descent over an RE2 expression; each method returns Java syntax."""

    def __init__(self, expr: str):
        self.s, self.i = expr, 0
        self.flags = frozenset()

    def parse(self) -> str:
        out = self.alternatives()[0]
        if self.i < len(self.s):
            raise PatternError("unexpected )")
        return out

    def peek(self, text: str) -> bool:
        return self.s.startswith(text, self.i)

    def alternatives(self) -> tuple[str, int]:
        """(Java, largest product of nested repeat counts); flags set inside end with the group."""
        outer, parts, most = self.flags, [], 1
        while True:
            java, count = self.sequence()
            parts.append(java)
            most = max(most, count)
            if not self.peek("|"):
                break
            self.i += 1
        self.flags = outer
        return "|".join(parts), most

    def sequence(self) -> tuple[str, int]:
        out, most = [], 1
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            if self.peek("\\Q"):
                end = self.s.find("\\E", self.i + 2)
                text = self.s[self.i + 2:] if end < 0 else self.s[self.i + 2:end]
                self.i = len(self.s) if end < 0 else end + 2
                if not text:
                    continue
                out.extend(self.char(ord(c)) for c in text[:-1])
                atom, count = self.char(ord(text[-1])), 1
            else:
                atom, count = self.atom()
            if atom is None:
                if self.repeat(consume=False):
                    raise PatternError("repetition after a flag group is not supported")
                continue
            java, count = self.repeated(atom, count)
            out.append(java)
            most = max(most, count)
        return "".join(out), most

    def repeat(self, consume: bool = True) -> tuple[str, int] | None:
        """A repetition operator here, as (Java, its largest count); None if there is none."""
        c = self.s[self.i:self.i + 1]
        if c and c in "*+?":
            self.i += consume
            return c, 1
        m = re.compile(r"\{([0-9]+)(,([0-9]*))?\}").match(self.s, self.i)
        if not m:
            return None
        lo, hi = int(m[1]), int(m[3]) if m[3] else None
        if lo > MAX_REPEAT or hi is not None and (hi > MAX_REPEAT or hi < lo):
            raise PatternError("invalid repeat count")
        if consume:
            self.i = m.end()
        return m[0], max(1, lo, hi or 0)

    def repeated(self, atom: str, count: int) -> tuple[str, int]:
        op = self.repeat()
        if op is None:
            return atom, count
        lazy = self.peek("?")
        self.i += lazy
        if self.repeat(consume=False):
            raise PatternError("invalid nested repetition operator")
        count *= op[1]
        if count > MAX_REPEAT:
            raise PatternError("invalid repeat count")
        return f"(?:{atom}){op[0]}" + ("?" if lazy != ("U" in self.flags) else ""), count

    def char(self, code: int) -> str:
        java = "\\x{%x}" % code
        return f"(?iu:{java})" if "i" in self.flags else java

    def group_class(self, items: str, negated: bool) -> str:
        java = f"[{'^' if negated else ''}{items}]"
        return f"(?iu:{java})" if "i" in self.flags else java

    def atom(self) -> tuple[str | None, int]:
        c = self.s[self.i]
        if self.repeat(consume=False):
            raise PatternError("missing argument to repetition operator")
        self.i += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket(), 1
        if c == "\\":
            return self.escape(), 1
        if c == ".":
            return ("(?s:.)" if "s" in self.flags else "[^\\n]"), 1
        if c == "^":
            return ("(?:\\A|(?<=\\n))" if "m" in self.flags else "\\A"), 1
        if c == "$":
            return ("(?=\\n|\\z)" if "m" in self.flags else "\\z"), 1
        return self.char(ord(c)), 1

    def group(self) -> tuple[str | None, int]:
        outer = self.flags
        if self.peek("?"):
            named = re.compile(r"\?P?<(\w+)>").match(self.s, self.i)
            if named:
                self.i = named.end()
            else:
                m = re.compile(r"\?([imsU]*)(-([imsU]+))?([:)])").match(self.s, self.i)
                if not m:
                    raise PatternError("invalid or unsupported group syntax")
                self.i = m.end()
                self.flags = (outer | set(m[1])) - set(m[3] or "")
                if m[4] == ")":
                    return None, 1
        java, count = self.alternatives()
        if not self.peek(")"):
            raise PatternError("missing closing )")
        self.i += 1
        self.flags = outer
        return f"(?:{java})", count

    def escape(self) -> str:
        c = self.s[self.i:self.i + 1]
        simple = {"A": "\\A", "z": "\\z", "b": _BOUNDARY, "B": _NO_BOUNDARY}
        if c in simple and c:
            self.i += 1
            return simple[c]
        items = self.class_escape()
        if items is not None:
            return self.group_class(items, False)
        return self.char(self.char_escape())

    def class_escape(self) -> str | None:
        """\\d \\S \\pL and the like, as items of a Java class; None if something else."""
        c = self.s[self.i:self.i + 1]
        if c and c.lower() in PERL_CLASSES:
            self.i += 1
            return f"[{'^' if c.isupper() else ''}{PERL_CLASSES[c.lower()]}]"
        if c in ("p", "P"):
            m = re.compile(r"[pP](?:([A-Z])|\{(\^?)([A-Za-z_]+)\})").match(self.s, self.i)
            if not m:
                raise PatternError("invalid character class range")
            self.i = m.end()
            name, negated = m[1] or m[3], (c == "P") != bool(m[2])
            if name == "Any":
                return "[^\\x{0}-\\x{10ffff}]" if negated else "[\\x{0}-\\x{10ffff}]"
            java = name if _CATEGORY.match(name) else "Is" + name  # a script; the JVM rejects unknown ones
            return f"\\{'P' if negated else 'p'}{{{java}}}"
        return None

    def char_escape(self) -> int:
        """Code point of an escaped single character."""
        c = self.s[self.i:self.i + 1]
        self.i += 1
        if not c:
            raise PatternError("trailing backslash")
        if c in CONTROL_ESCAPES:
            return CONTROL_ESCAPES[c]
        if c in "01234567":
            m = re.compile(r"[0-7]{1,3}").match(self.s, self.i - 1)
            if c != "0" and len(m[0]) == 1:
                raise PatternError("back-references are not supported")
            self.i = m.end()
            return int(m[0], 8)
        if c == "x":
            m = re.compile(r"([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\}").match(self.s, self.i)
            code = int(m[1] or m[2], 16) if m else 1 << 30
            if code > 0x10FFFF:
                raise PatternError("invalid escape sequence")
            self.i = m.end()
            return code
        if ord(c) < 128 and not c.isalnum():
            return ord(c)
        raise PatternError(f"invalid escape \\{c}")

    def bracket(self) -> str:
        negated = self.peek("^")
        self.i += negated
        items, first = [], True
        while first or not self.peek("]"):
            if self.i >= len(self.s):
                raise PatternError("missing closing ]")
            first = False
            if self.peek("[:"):
                end = self.s.find(":]", self.i + 2)
                if end >= 0:
                    name = self.s[self.i + 2:end]
                    if name.lstrip("^") not in POSIX_CLASSES or name.startswith("^^"):
                        raise PatternError("invalid character class range")
                    items.append(f"[{'^' if name.startswith('^') else ''}{POSIX_CLASSES[name.lstrip('^')]}]")
                    self.i = end + 2
                    continue
            if self.peek("\\"):
                self.i += 1
                cls = self.class_escape()
                if cls is not None:
                    items.append(cls)
                    continue
                self.i -= 1
            lo = self.class_char()
            hi = lo
            if self.peek("-") and self.s[self.i + 1:self.i + 2] not in ("]", ""):
                self.i += 1
                hi = self.class_char()
                if hi < lo:
                    raise PatternError("invalid character class range")
            items.append("\\x{%x}-\\x{%x}" % (lo, hi))
        self.i += 1
        return self.group_class("".join(items), negated)

    def class_char(self) -> int:
        c = self.s[self.i:self.i + 1]
        if not c:
            raise PatternError("missing closing ]")
        self.i += 1
        return self.char_escape() if c == "\\" else ord(c)


def re2_to_java(expr: str) -> str:
    """Java expression whose ``find`` gives RE2's answers; PatternError if RE2 rejects it."""
    return _Re2Parser(expr).parse()
