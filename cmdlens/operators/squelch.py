"""Noise filtering by exact, glob and regex patterns.

The pattern list is compiled once on the driver into a single boolean column:
an ``isin`` hash-set test for exact patterns OR'ed with one ``rlike`` per glob /
regex. Rows matching any pattern are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PatternError, glob_to_regex, re2_to_java

# The built-in list of mundane commands (exact matches), in order.
DEFAULT_SQUELCH = [
    "cd", "cd ..", "cd ~", "pwd",
    "ls", "ls -l", "ls -la", "ls -al", "ls -lah", "ls -ltr", "ll", "la",
    "exit", "clear", "history",
    "echo", "cat", "man", "which", "whoami", "date", "top", "htop",
]

GLOB_PREFIX = "glob:"
REGEX_PREFIX = "regex:"


def active_list(clear_defaults: bool = False, user_patterns: list[str] | None = None) -> list[str]:
    """Defaults followed by user patterns, or user patterns only (no de-duplication)."""
    user = list(user_patterns or [])
    return user if clear_defaults else DEFAULT_SQUELCH + user


@dataclass
class CompiledPatterns:
    exact: list[str] = field(default_factory=list)
    regexes: list[str] = field(default_factory=list)   # Java regexes for rlike
    warnings: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.exact or self.regexes)


def _java_compiles(regex: str) -> str | None:
    """Ask the JVM's regex engine (the one ``rlike`` uses) whether it compiles."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    jvm = getattr(spark, "_jvm", None) if spark is not None else None
    if jvm is None:  # no local JVM handle (e.g. Spark Connect): checked at query time
        return None
    try:
        jvm.java.util.regex.Pattern.compile(regex)
    except Exception as exc:  # py4j wraps the PatternSyntaxException
        return str(exc).splitlines()[0]
    return None


def compile_patterns(raw_patterns: list[str]) -> CompiledPatterns:
    """Parse raw strings; malformed ones become warnings and are skipped."""
    out = CompiledPatterns()
    for raw in raw_patterns:
        if raw.startswith(REGEX_PREFIX):
            kind, body = "regex", raw[len(REGEX_PREFIX):]
        elif raw.startswith(GLOB_PREFIX):
            kind, body = "glob", raw[len(GLOB_PREFIX):]
        else:
            out.exact.append(raw)
            continue
        try:
            java = re2_to_java(body) if kind == "regex" else glob_to_regex(body)
        except PatternError as exc:
            out.warnings.append(f"noise pattern {raw!r} skipped, its {kind} is malformed: {exc}")
            continue
        err = _java_compiles(java)
        if err:
            out.warnings.append(f"noise pattern {raw!r} skipped, its {kind} is malformed: {err}")
            continue
        out.regexes.append(java)
    return out


def noise_predicate(cmd: Column, compiled: CompiledPatterns) -> Column | None:
    """True when ``cmd`` matches any pattern; None for an empty list."""
    terms: list[Column] = []
    if compiled.exact:
        terms.append(cmd.isin(sorted(set(compiled.exact))))
    for rx in compiled.regexes:
        terms.append(cmd.rlike(rx))
    if not terms:
        return None
    pred = terms[0]
    for t in terms[1:]:
        pred = pred | t
    return pred


def squelch(df: DataFrame, patterns: list[str] | CompiledPatterns | None,
            col: str = "cmd") -> DataFrame:
    """Drop rows whose ``col`` matches any pattern (no-op for an empty list)."""
    if patterns is None:
        return df
    compiled = patterns if isinstance(patterns, CompiledPatterns) else compile_patterns(patterns)
    pred = noise_predicate(F.col(col), compiled)
    if pred is None:
        return df
    # NULL never matches, so it is kept
    return df.filter(~F.coalesce(pred, F.lit(False)))
