"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark plans: where the Spark side uses a
single-pass formulation (search tiers, hashlet adjacency, bucketed prefix
joins), the SQL follows the reference's direct, sequential definition
(separate tier queries with fallback, brute-force prefix matching), so
agreement is evidence both are right. Tables ``events``, ``documents`` etc.
are views registered by the caller.
"""

from __future__ import annotations

from ..sources.fixtures import BASE_COMMANDS, EVENT_TOOL

# Fixed values, stated here again so that an error in the library's tables shows: what the derived
# logs hold of programs and tools, and the built-in noise list.
PROGRAM_CATEGORY = {
    "git": "vcs", "docker": "containers", "kubectl": "containers", "make": "build", "go": "build", "python3": "build",
    "curl": "network", "vim": "editor", "ls": "shell"}
SKIPPED_TOOLS = ["TodoWrite"]
TOOL_ARG_KEY = {"Bash": "command", "Read": "file_path", "Grep": "pattern", "WebFetch": "url"}
TOOL_CATEGORY = {"Bash": "shell", "Read": "file", "Grep": "search", "WebFetch": "web", "CronList": "cron"}
NOISE = ["cd", "cd ..", "cd ~", "pwd", "ls", "ls -l", "ls -la", "ls -al", "ls -lah", "ls -ltr", "ll", "la", "exit", "clear", "history",
         "echo", "cat", "man", "which", "whoami", "date", "top", "htop"]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


COMMAND_EVENTS = f"""
command_events AS (
  SELECT event_id,
         CASE WHEN event_id % 12 IN (1, 8) THEN base
              ELSE base || ' ' || event_type || ' ' || CAST(event_id // 120 AS VARCHAR) END AS cmd,
         CASE WHEN event_id % 17 = 0 THEN ''
              ELSE '/home/u' || CAST(user_id AS VARCHAR) || '/proj' END AS cwd,
         epoch_us(ts) // 1000 AS ts_ms,
         CASE WHEN event_id % 5 = 0 THEN 'agent' ELSE '' END AS source,
         CASE WHEN event_id % 5 = 0 THEN 'Bash' ELSE '' END AS tool,
         CASE WHEN event_id % 5 = 0 THEN 'shell' ELSE '' END AS category
  FROM (SELECT *, {str_list(BASE_COMMANDS)}[event_id % 12 + 1] AS base FROM events) e
)"""


def history_cte(events_cte: str = "command_events", name: str = "history") -> str:
    def sticky(col):
        return (f"coalesce(arg_max({col}, (ts_ms, event_id)) FILTER (WHERE {col} <> ''), '') "
                f"AS {col}")
    return f"""
{name} AS (
  SELECT sha256(cmd) AS hash, cmd,
         arg_max(cwd, (ts_ms, event_id)) AS cwd,
         max(ts_ms) AS ts_ms,
         {sticky('source')}, {sticky('tool')}, {sticky('category')}
  FROM {events_cte} GROUP BY cmd
)"""


HISTORY = history_cte()


def with_history(*extra: str) -> str:
    return "WITH " + ",".join([COMMAND_EVENTS, HISTORY, *extra])


def trigram_rows(table: str, key: str, text: str) -> str:
    """Distinct (ngram, key) of every byte trigram of ``text``."""
    return f"""
SELECT DISTINCT ('0x' || substr(hex(encode({text})), 2 * i - 1, 6))::INTEGER AS ngram, {key}
FROM (SELECT {key}, {text}, unnest(generate_series(1, strlen({text}) - 2)) AS i FROM {table}) t"""


def program_sql(col: str = "cmd") -> str:
    fields = f"list_filter(regexp_split_to_array({col}, '\\s+'), lambda t: t <> '' AND NOT contains(t, '='))"
    return f"coalesce(regexp_extract(({fields})[1], '[^/]*$'), {col})"


def category_map_cte(name: str = "category_map") -> str:
    rows = ", ".join(f"({q(p)}, {q(c)})" for p, c in PROGRAM_CATEGORY.items())
    return f"\n{name}(program, category) AS (VALUES {rows})"


def category_sql(prog_col: str, map_name: str = "category_map") -> str:
    return (f"coalesce((SELECT m.category FROM {map_name} m WHERE m.program = {prog_col}), 'other')")


def source_pred(source: str | None, col: str = "source") -> str:
    if source == "all":
        return "TRUE"
    if source in (None, "", "user"):
        return f"{col} = ''"
    return f"{col} = {q(source)}"


def noise_sql(exact: list[str] | None = None, regexes: list[str] | None = None,
              col: str = "cmd") -> str:
    """TRUE when ``col`` is noise; regexes are RE2 (DuckDB's engine)."""
    terms = []
    if exact:
        terms.append(f"{col} IN {in_list(exact)}")
    for rx in regexes or []:
        terms.append(f"regexp_matches({col}, {q(rx)})")
    return "(" + " OR ".join(terms) + ")" if terms else "FALSE"


DEFAULT_NOISE = noise_sql(NOISE)


def find_sql(keywords: list[str], limit: int = 5, cwd: str | None = None,
             source: str = "user", noise: str = "FALSE") -> str:
    """Sequential tiers exactly as the reference runs them."""
    from ..functions.ngrams import trigrams_of

    long_kws = [k for k in keywords if len(k.encode()) > 2]
    grams = sorted({g for k in long_kws for g in trigrams_of(k)})
    kws = [k for k in keywords if k]
    scan = " OR ".join(f"contains(cmd, {q(k)})" for k in kws) or "FALSE"
    gram_in = ", ".join(str(g) for g in grams) or "NULL"
    local = f"cwd = {q(cwd)}" if cwd else "FALSE"
    tiers = []
    if cwd and grams:
        tiers.append((1, f"({local}) AND rnk > 0", "rnk DESC, ts_ms DESC, hash"))
    if cwd:
        tiers.append((2, f"({local}) AND ({scan})", "ts_ms DESC, hash"))
    if grams:
        tiers.append((3, "rnk > 0", "rnk DESC, ts_ms DESC, hash"))
    tiers.append((4, f"({scan})", "ts_ms DESC, hash"))
    parts, prev = [], []
    for t, pred, order in tiers:
        parts.append(f"t{t} AS (SELECT *, {t} AS tier, CASE WHEN {t} IN (1, 3) THEN rnk ELSE 0 END AS rank_key "
                     f"FROM base WHERE {pred} ORDER BY {order} LIMIT {limit})")
        prev.append(t)
    picks = []
    for i, (t, _, _) in enumerate(tiers):
        guard = " AND ".join(f"NOT EXISTS (SELECT 1 FROM t{p})" for p, _, _ in tiers[:i]) or "TRUE"
        picks.append(f"SELECT * FROM t{t} WHERE {guard}")
    if not kws:
        return ("SELECT hash, cmd, cwd, ts_ms, 0 AS annotation_type, source, FALSE AS is_global, "
                "0 AS rank, 0 AS pos FROM (" + with_history() + " SELECT * FROM history) WHERE FALSE")
    global_flag = "tier >= 3" if cwd else "FALSE"
    clear = f"CASE WHEN {global_flag} THEN cwd ELSE '' END" if cwd else "cwd"
    return with_history(
        f"\nidx AS ({trigram_rows('history', 'hash', 'cmd')})",
        f"\nranks AS (SELECT hash, count(*) AS rnk FROM idx WHERE ngram IN ({gram_in}) GROUP BY hash)",
        f"\nbase AS (SELECT h.*, coalesce(r.rnk, 0) AS rnk FROM history h LEFT JOIN ranks r USING (hash) "
        f"WHERE {source_pred(source, 'h.source')})",
        *["\n" + p for p in parts],
        "\npicked AS (" + " UNION ALL ".join(picks) + ")",
        f"\nkept AS (SELECT * FROM picked WHERE NOT {noise})",
    ) + f"""
SELECT hash, cmd, {clear} AS cwd, ts_ms, 0 AS annotation_type, source,
       {global_flag} AS is_global, CAST(rank_key AS INTEGER) AS rank,
       CAST(row_number() OVER (ORDER BY rank_key DESC, ts_ms DESC, hash) AS INTEGER) AS pos
FROM kept"""


def fuzzy_sql(col: str, phrase: str) -> str:
    """Greedy in-order word consumption over shell tokens (list_reduce)."""
    words = phrase.strip().lower().split()
    if not words:
        return "FALSE"
    n = len(words)
    words_l = str_list(words)
    thr = "[" + ", ".join(str(max(1, len(w.encode()) // 5)) for w in words) + "]"
    toks = (f"list_filter(regexp_split_to_array(lower({col}), '[ \\t/=:,;|&()\\[\\]{{}}<>]+'), "
            "lambda t: t <> '')")
    step = (f"lambda qi, tok: CASE WHEN qi < {n} AND (contains(tok, {words_l}[qi + 1]) OR "
            f"levenshtein(tok, {words_l}[qi + 1]) <= {thr}[qi + 1]) THEN qi + 1 ELSE qi END")
    return f"(list_reduce({toks}, {step}, 0) = {n})"


def exact_sql(col: str, phrase: str) -> str:
    p = phrase.strip().lower()
    if not p:
        return "FALSE"
    return f"contains(lower({col}), {q(p)})"


def tool_json_cte() -> str:
    tool_map = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in EVENT_TOOL.items()) + "}"
    return f"""
tool_json AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts_ms,
         CASE WHEN event_id % 13 = 0 THEN substr(js, 1, 15) ELSE js END AS js
  FROM (
    SELECT event_id, ts,
           json_object('tool_name', tool,
                       'tool_input', json_object(
                          CASE tool WHEN 'Read' THEN 'file_path' WHEN 'Bash' THEN 'command'
                                    WHEN 'WebFetch' THEN 'url' WHEN 'Grep' THEN 'pattern' ELSE 'x' END,
                          CASE WHEN event_id % 11 = 0 THEN '   '
                               ELSE '  src/u' || CAST(user_id AS VARCHAR) || '/f' || CAST(event_id // 40 AS VARCHAR) || '.go ' END),
                       'cwd', '/home/u' || CAST(user_id AS VARCHAR) || '/proj')::VARCHAR AS js
    FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'CronList' ELSE element_at({tool_map}, event_type)[1] END AS tool
          FROM events) e
  ) x
),
tool_parsed AS (
  SELECT event_id, ts_ms, tool,
         coalesce({_tool_cat_case('tool')}, 'other') AS category,
         CASE WHEN arg <> '' THEN '[' || tool || '] ' || arg ELSE '[' || tool || ']' END AS display,
         coalesce(json_extract_string(js, '$.cwd'), '') AS cwd
  FROM (
    SELECT event_id, ts_ms, js, coalesce(json_extract_string(js, '$.tool_name'), '') AS tool,
           coalesce(regexp_replace(json_extract_string(js, '$.tool_input.' || {_tool_key_case("json_extract_string(js, '$.tool_name')")}),
                                   '^\\s+|\\s+$', '', 'g'), '') AS arg
    FROM tool_json
    WHERE json_valid(js) AND json_type(js) = 'OBJECT'
      AND coalesce(json_type(js, '$.tool_input'), 'OBJECT') = 'OBJECT'
  ) p
  WHERE tool NOT IN {in_list(SKIPPED_TOOLS)}
)"""


def _tool_key_case(col: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TOOL_ARG_KEY.items())
    return f"(CASE {col} {whens} ELSE '__none__' END)"


def _tool_cat_case(col: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TOOL_CATEGORY.items())
    return f"(CASE {col} {whens} END)"
