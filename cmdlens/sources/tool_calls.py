"""Agent tool-call hook payloads (JSON) -> command events.

``{"tool_name": str, "tool_input": {str: str}, "cwd": str}`` becomes a
display command ``[Tool] arg`` (or ``[Tool]`` when the argument is empty),
the tool's category and the tool name. Absent fields count as empty. A payload
yields no row if it is no JSON object, if text follows the object, if
``tool_name`` or ``cwd`` is present but no string, if the tool is skipped, or,
for a tool with an argument, if ``tool_input`` is no object or the argument no
string. Other tools may carry any input. Fields stay separate columns, so
commands holding tabs or newlines are carried intact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.category import (DEFAULT_TOOL_CATEGORY, SKIPPED_TOOLS, TOOL_ARG_KEY,
                                  TOOL_CATEGORY, literal_map)

# Python's str.strip() white space: Unicode White_Space plus \x1c-\x1f.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def parse_tool_json(js: Column | str) -> Column:
    """The payload as a variant; NULL if it is no JSON value."""
    return F.try_parse_json(F.col(js) if isinstance(js, str) else js)


def _type(v: Column) -> Column:
    """Type name of a variant (VOID: a JSON null), NULL if absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps refer to without computing them again: a generator
    of one row is a step that the optimizer does not merge with its neighbours."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def tool_calls(df: DataFrame, json_col: str = "js") -> DataFrame:
    """Parsed tool calls: tool, category, display, tool_cwd (+ all input columns)."""
    def string_or_absent(kind):
        return kind.isNull() | (kind == "STRING")

    def field(path):
        return F.try_variant_get("_tc", path, "variant")

    def text(name):
        return F.coalesce(F.try_variant_get(name, "$", "string"), F.lit(""))

    t = _once(df, _tc=parse_tool_json(json_col), _whole=ends_with_value(F.col(json_col)))
    t = t.filter(F.coalesce(F.col("_whole") & (_type(F.col("_tc")) == "OBJECT"), F.lit(False)))
    t = _once(t, _name=field("$.tool_name"), _input=field("$.tool_input"), _cwd=field("$.cwd"))
    t = t.filter(string_or_absent(_type(F.col("_name"))) & string_or_absent(_type(F.col("_cwd"))))
    t = _once(t, tool=text("_name"), tool_cwd=text("_cwd")).filter(~F.col("tool").isin(SKIPPED_TOOLS))
    # only a tool with an argument looks at its input
    key = F.element_at(literal_map(TOOL_ARG_KEY), F.col("tool"))
    fields = F.try_variant_get("_input", "$", "map<string,variant>")
    t = _once(t, _in=F.when(key.isNotNull(), _type(F.col("_input"))),
              _arg=F.when(key.isNotNull(), F.try_element_at(fields, key)))
    t = t.filter((F.col("_in").isNull() | (F.col("_in") == "OBJECT")) & string_or_absent(_type(F.col("_arg"))))
    t = _once(t, _text=F.regexp_replace(text("_arg"), _STRIP, ""))
    tag = F.concat(F.lit("["), F.col("tool"), F.lit("]"))
    t = t.withColumns({
        "category": F.coalesce(F.element_at(literal_map(TOOL_CATEGORY), F.col("tool")), F.lit(DEFAULT_TOOL_CATEGORY)),
        "display": F.when(F.col("_text") != "", F.concat(tag, F.lit(" "), F.col("_text"))).otherwise(tag)})
    return t.drop("_tc", "_whole", "_name", "_input", "_cwd", "_in", "_arg", "_text")


def ends_with_value(js: Column) -> Column:
    """Whether a text that starts with a JSON value holds nothing after it.

    The text is put into an array: an array of exactly one element parses only
    if the text is one value, and a second value or loose text breaks it.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), js, F.lit("]")))
    return wrapped.isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull()


def tool_events(df: DataFrame, json_col: str = "js", source: str = "agent",
                ts_col: str = "ts_ms", id_col: str = "event_id") -> DataFrame:
    """Tool calls as command events tagged with ``source``, tool and category."""
    tc = tool_calls(df, json_col)
    return tc.select(F.col(id_col).alias("event_id"), F.col("display").alias("cmd"),
                     F.col("tool_cwd").alias("cwd"), F.col(ts_col).alias("ts_ms"),
                     F.lit(source).alias("source"), "tool", "category")
