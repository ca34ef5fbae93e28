"""Registered queries (Spark) and their DuckDB oracles, keyed alike.

Every query reads the driver's test tables (``events``, ``documents``) or data
Spark derives from them, over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.category import category
from ..functions.hashing import command_hash
from ..functions.text import program_name
from ..functions.timefmt import relative_time
from ..operators import hashlet, index, ingest, maintenance, search, stats
from ..operators.phrase import phrase_match
from ..operators.filters import scope
from ..operators.squelch import DEFAULT_SQUELCH, squelch
from ..operators.util import materialize
from ..sources import fixtures, store, tool_calls
from ..streaming import ingest as streaming
from ..session import checkpoint_path
from . import commands
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def events(spark, sf):
    return fixtures.load(spark, sf, "events")


def history(spark, sf) -> DataFrame:
    return ingest.ingest(fixtures.command_events(events(spark, sf)))


def stored_history(spark, sf) -> DataFrame:
    """The ingested history written once (as a deployment stores it) for
    queries that read it from several branches."""
    return materialize(history(spark, sf))


def documents(spark, sf):
    return fixtures.load(spark, sf, "documents")


H = O.with_history


# --------------------------------------------------------------------------- ingest
@register("ingest_latest", H() + "\nSELECT hash, cmd, cwd, ts_ms, source, tool, category FROM history")
def ingest_latest(spark, sf):
    return history(spark, sf)


@register("ingest_sticky_tag", H() + """
SELECT hash, 'source' AS key, source AS value FROM history WHERE source <> ''
UNION ALL SELECT hash, 'tool', tool FROM history WHERE tool <> ''
UNION ALL SELECT hash, 'category', category FROM history WHERE category <> ''""")
def ingest_sticky_tag(spark, sf):
    return ingest.meta_table(history(spark, sf))


@register("command_hash", """
SELECT doc_id, sha256(text) AS hash, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents""")
def command_hash_q(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", command_hash("text").alias("hash"), F.octet_length("text").alias("n_bytes"))


@register("base64_roundtrip", H() + """
SELECT hash, to_base64(encode(cmd)) AS cmd_b64, to_base64(encode(cwd)) AS cwd_b64, cmd, cwd, ts_ms
FROM history""")
def base64_roundtrip(spark, sf):
    h = history(spark, sf)
    raw = store.encode_history(h)
    back = store.decode_history(raw)
    return raw.select("hash", F.col("cmd").alias("cmd_b64"), F.col("cwd").alias("cwd_b64")).join(
        back, "hash")


@register("base64_documents", """
SELECT doc_id, CAST(length(to_base64(encode(text))) AS INTEGER) AS b64_len, TRUE AS roundtrip_ok FROM documents""")
def base64_documents(spark, sf):
    from ..functions.hashing import b64_decode, b64_encode
    d = documents(spark, sf).select("doc_id", "text", b64_encode("text").alias("b64"))
    return d.select("doc_id", F.length("b64").alias("b64_len"),
                    (b64_decode("b64") == F.col("text")).alias("roundtrip_ok"))


# --------------------------------------------------------------------------- trigrams
@register("ngram_index", H() + "\nSELECT ngram, hash FROM (" + O.trigram_rows("history", "hash", "cmd") + ")")
def ngram_index(spark, sf):
    return index.build_index(history(spark, sf))


@register("ngram_doc_freq", "SELECT ngram, count(*) AS doc_freq FROM ("
          + O.trigram_rows("documents", "doc_id", "text") + ") GROUP BY ngram")
def ngram_doc_freq(spark, sf):
    idx = index.build_index(documents(spark, sf), text_col="text", key_col="doc_id")
    return index.gram_doc_freq(idx, key_col="doc_id")


# --------------------------------------------------------------------------- search
FIND_CASES = {
    "find_ranked": dict(keywords=["git", "status"]),
    "find_short_scan": dict(keywords=["go", "ps"]),
    "find_local": dict(keywords=["make", "view"], cwd="/home/u7/proj"),
    "find_fallback_global": dict(keywords=["kubectl", "view"], cwd="/home/nobody"),
    "find_all_sources": dict(keywords=["ls", "fzf"], source="all", limit=8),
}
for _name, _case in FIND_CASES.items():
    def _mk(case):
        def run(spark, sf):
            return commands.find(history(spark, sf), case["keywords"], limit=case.get("limit", 5),
                                 cwd=case.get("cwd"), source=case.get("source", "user"))
        return run
    register(_name, O.find_sql(_case["keywords"], _case.get("limit", 5), _case.get("cwd"),
                               _case.get("source", "user")))(_mk(_case))

SQUELCH_AFTER = ["regex:^git status"]


@register("find_squelched_after_limit",
          O.find_sql(["git"], 5, None, "user", O.noise_sql(regexes=["^git status"])))
def find_squelched_after_limit(spark, sf):
    return commands.find(history(spark, sf), ["git"], limit=5, squelch_patterns=SQUELCH_AFTER)


BATCH_SQL = H(
    """
queries AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || event_type AS qid,
         [event_type, CAST(user_id AS VARCHAR)] AS keywords,
         CASE WHEN user_id % 3 = 0 THEN '' ELSE '/home/u' || CAST(user_id AS VARCHAR) || '/proj' END AS qcwd
  FROM events)""",
    "\nidx AS (" + O.trigram_rows("history", "hash", "cmd") + ")",
    """
qkw AS (SELECT qid, unnest(keywords) AS kw FROM queries)""",
    """
qgram AS (SELECT DISTINCT qid, ngram FROM (""" + O.trigram_rows(
        "(SELECT qid, kw FROM qkw WHERE strlen(kw) > 2)", "qid", "kw") + """))""",
    """
ranks AS (SELECT qid, hash, count(*) AS rnk FROM qgram JOIN idx USING (ngram) GROUP BY qid, hash)""",
    """
qinfo AS (SELECT q.qid, q.qcwd, EXISTS (SELECT 1 FROM qkw k WHERE k.qid = q.qid AND strlen(k.kw) > 2) AS has_long
          FROM queries q)""",
    """
pairs AS (
  SELECT i.qid, i.qcwd, i.has_long, h.hash, h.cmd, h.cwd, h.ts_ms, h.source,
         coalesce(r.rnk, 0) AS rnk,
         EXISTS (SELECT 1 FROM qkw k WHERE k.qid = i.qid AND k.kw <> '' AND contains(h.cmd, k.kw)) AS scan,
         (i.qcwd <> '' AND h.cwd = i.qcwd) AS local
  FROM qinfo i CROSS JOIN history h
  LEFT JOIN ranks r ON r.qid = i.qid AND r.hash = h.hash
  WHERE h.source = '')""",
    """
tiered AS (
  SELECT *, 1 AS tier FROM pairs WHERE has_long AND local AND rnk > 0
  UNION ALL SELECT *, 2 FROM pairs WHERE local AND scan
  UNION ALL SELECT *, 3 FROM pairs WHERE has_long AND rnk > 0
  UNION ALL SELECT *, 4 FROM pairs WHERE scan)""",
    """
best AS (SELECT qid, min(tier) AS tier FROM tiered GROUP BY qid)""",
    """
chosen AS (
  SELECT t.*, CASE WHEN t.tier IN (1, 3) THEN t.rnk ELSE 0 END AS rank_key
  FROM tiered t JOIN best b USING (qid, tier))""",
    """
limited AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank_key DESC, ts_ms DESC, hash) AS rn
                 FROM chosen) WHERE rn <= 5)""") + """
SELECT qid, hash, cmd, CASE WHEN qcwd <> '' AND tier < 3 THEN '' ELSE cwd END AS cwd, ts_ms,
       0 AS annotation_type, source, (qcwd <> '' AND tier >= 3) AS is_global,
       CAST(rank_key AS INTEGER) AS rank, CAST(rn AS INTEGER) AS pos
FROM limited"""


@register("batch_search", BATCH_SQL)
def batch_search(spark, sf):
    ev = events(spark, sf)
    h = stored_history(spark, sf)
    return commands.batch_search(h, fixtures.search_queries(ev), limit=5)


@register("batch_search_indexed", BATCH_SQL)
def batch_search_indexed(spark, sf):
    """Same queries against a prebuilt trigram index table: the index of the
    numbered history is written with the stored layout (range-sorted by trigram)
    to the shared folder and read back as a table."""
    ev = events(spark, sf)
    h = index.numbered(history(spark, sf))
    path = checkpoint_path(spark, "ngram-index")
    store.write_index(index.build_index(h, key_col="seq"), path)
    return commands.batch_search(h, fixtures.search_queries(ev), limit=5, idx=spark.read.parquet(path))


# --------------------------------------------------------------------------- history / cat / phrase
HIST_COLS = "hash, cmd, cwd, ts_ms, source"
DEFAULT_NOISE = O.DEFAULT_NOISE


@register("history_user", H() + f"\nSELECT {HIST_COLS} FROM history WHERE source = '' AND NOT {DEFAULT_NOISE}")
def history_user(spark, sf):
    return commands.history(history(spark, sf), squelch_patterns=DEFAULT_SQUELCH)


@register("history_local", H() + f"""
SELECT hash, cmd, '' AS cwd, ts_ms, source FROM history
WHERE cwd = '/home/u7/proj' AND source = '' AND NOT {DEFAULT_NOISE}""")
def history_local(spark, sf):
    return commands.history(history(spark, sf), cwd="/home/u7/proj", squelch_patterns=DEFAULT_SQUELCH)


@register("history_all_reversed", H() + f"\nSELECT {HIST_COLS} FROM history")
def history_all_reversed(spark, sf):
    return commands.history(history(spark, sf), source="all", reverse=True)


PHRASE_EXACT = "Make Build"
PHRASE_FUZZY = "kubctl pod viw"
PHRASE_CAT = "git comit fix"


def _phrase_sql(phrase: str, where: str = "source = ''", noise: str = DEFAULT_NOISE) -> str:
    ex, fz = O.exact_sql("cmd", phrase), O.fuzzy_sql("cmd", phrase)
    return H() + f"""
SELECT {HIST_COLS}, {ex} AS exact FROM history
WHERE {where} AND NOT {noise} AND ({ex} OR {fz})"""


@register("phrase_exact", _phrase_sql(PHRASE_EXACT))
def phrase_exact(spark, sf):
    return commands.filtered_history(history(spark, sf), PHRASE_EXACT, squelch_patterns=DEFAULT_SQUELCH)


@register("phrase_fuzzy", _phrase_sql(PHRASE_FUZZY))
def phrase_fuzzy(spark, sf):
    return commands.filtered_history(history(spark, sf), PHRASE_FUZZY, squelch_patterns=DEFAULT_SQUELCH)


DOC_PHRASE = "enchè ouan du"


@register("phrase_fuzzy_documents", f"""
SELECT doc_id, {O.exact_sql('text', DOC_PHRASE)} AS exact FROM documents
WHERE {O.exact_sql('text', DOC_PHRASE)} OR {O.fuzzy_sql('text', DOC_PHRASE)}""")
def phrase_fuzzy_documents(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    matched, exact = phrase_match(F.col("text"), DOC_PHRASE)
    return d.select("doc_id", exact.alias("exact"), matched.alias("_m")).filter("_m").drop("_m")


@register("cat_limit", H() + f"""
SELECT {HIST_COLS}, FALSE AS exact, CAST(row_number() OVER (ORDER BY ts_ms, hash) AS INTEGER) AS pos
FROM (SELECT * FROM history WHERE source = '' ORDER BY ts_ms DESC, hash DESC LIMIT 20)
WHERE NOT {DEFAULT_NOISE}""")
def cat_limit(spark, sf):
    return commands.cat(history(spark, sf), limit=20, squelch_patterns=DEFAULT_SQUELCH)


@register("cat_phrase", _phrase_sql(PHRASE_CAT))
def cat_phrase(spark, sf):
    return commands.cat(history(spark, sf), phrase=PHRASE_CAT, squelch_patterns=DEFAULT_SQUELCH)


# --------------------------------------------------------------------------- noise filters
SQ_EXACT = ["fzf", "ls", "docker ps view 10", "git status click 1"]
SQ_GLOB = ["glob:git status *", "glob:make build v*", "glob:curl http:*"]
SQ_GLOB_RE2 = ["^git status [^/]*$", "^make build v[^/]*$", "^curl http:[^/]*$"]
SQ_REGEX = ["regex:^kubectl .* (view|click) [0-9]$", "regex:python3?\\s", "regex:\\.\\.\\.$"]
SQ_REGEX_RE2 = ["^kubectl .* (view|click) [0-9]$", "python3?\\s", "\\.\\.\\.$"]


def _squelch_sql(noise: str, source: str = "all") -> str:
    return H() + f"\nSELECT {HIST_COLS} FROM history WHERE {O.source_pred(source)} AND NOT {noise}"


def _squelch_q(patterns, source="all"):
    def run(spark, sf):
        h = scope(history(spark, sf), source=source)
        return squelch(h, patterns).select("hash", "cmd", "cwd", "ts_ms", "source")
    return run


register("squelch_exact", _squelch_sql(O.noise_sql(SQ_EXACT)))(_squelch_q(SQ_EXACT))
register("squelch_glob", _squelch_sql(O.noise_sql(regexes=SQ_GLOB_RE2)))(_squelch_q(SQ_GLOB))
register("squelch_regex", _squelch_sql(O.noise_sql(regexes=SQ_REGEX_RE2)))(_squelch_q(SQ_REGEX))
register("squelch_defaults", _squelch_sql(DEFAULT_NOISE))(_squelch_q(DEFAULT_SQUELCH))
register("squelch_mixed", _squelch_sql(O.noise_sql(["fzf"], [SQ_GLOB_RE2[0], SQ_REGEX_RE2[0]])))(
    _squelch_q(["fzf", SQ_GLOB[0], SQ_REGEX[0]]))


# --------------------------------------------------------------------------- tool calls
@register("tool_calls_parsed", "WITH " + O.tool_json_cte() + """
SELECT event_id, tool, category, display, cwd FROM tool_parsed""")
def tool_calls_parsed(spark, sf):
    tc = tool_calls.tool_calls(fixtures.tool_call_json(events(spark, sf)))
    return tc.select("event_id", "tool", "category", "display", F.col("tool_cwd").alias("cwd"))


TOOL_HISTORY_SQL = "WITH " + O.tool_json_cte() + """,
tool_events AS (SELECT event_id, display AS cmd, cwd, ts_ms, 'agent' AS source, tool, category FROM tool_parsed),
""" + O.history_cte("tool_events", "thistory").lstrip() + """
SELECT hash, cmd, cwd, ts_ms, source, tool, category FROM thistory
WHERE source = 'agent' AND tool = 'Read'"""


@register("tool_history", TOOL_HISTORY_SQL)
def tool_history(spark, sf):
    ev = tool_calls.tool_events(fixtures.tool_call_json(events(spark, sf)))
    return commands.tool_history(ingest.ingest(ev), tool="Read", tag="agent")


# --------------------------------------------------------------------------- hashlets
PREFIXES_SQL = """
prefixes AS (
  SELECT DISTINCT prefix FROM (
    SELECT substr(hash, 1, n) AS prefix FROM history, (SELECT unnest(generate_series(1, 8)) AS n) g
    UNION ALL SELECT upper(substr(hash, 1, 7)) FROM history
    UNION ALL SELECT 'g' || substr(hash, 2, 5) FROM history
    UNION ALL SELECT substr(sha256(cmd || '#'), 1, 10) FROM history
    UNION ALL SELECT '' FROM history))"""


@register("resolve_prefixes", H(PREFIXES_SQL) + """,
m AS (
  SELECT p.prefix, count(h.hash) AS n, min(h.hash) AS hh
  FROM prefixes p LEFT JOIN history h
    ON lower(p.prefix) <> '' AND regexp_full_match(lower(p.prefix), '[0-9a-f]+')
       AND starts_with(h.hash, lower(p.prefix))
  GROUP BY p.prefix)
SELECT m.prefix,
       CASE WHEN m.prefix = '' THEN 'empty'
            WHEN NOT regexp_full_match(lower(m.prefix), '[0-9a-f]+') THEN 'invalid'
            WHEN m.n = 0 THEN 'not_found' WHEN m.n > 1 THEN 'ambiguous' ELSE 'found' END AS status,
       h.hash, h.cmd, h.cwd, h.ts_ms, h.source
FROM m LEFT JOIN history h ON m.n = 1 AND h.hash = m.hh""")
def resolve_prefixes(spark, sf):
    h = stored_history(spark, sf)
    return commands.resolve_prefixes(h, fixtures.hash_prefixes(h))


@register("hashlet_min_len", H() + """,
lens AS (SELECT unnest(generate_series(4, 64)) AS l),
ok AS (SELECT l FROM lens WHERE (SELECT count(DISTINCT substr(hash, 1, l)) FROM history) = (SELECT count(*) FROM history))
SELECT CAST(CASE WHEN (SELECT count(*) FROM history) <= 1 THEN 4 ELSE coalesce((SELECT min(l) FROM ok), 64) END AS INTEGER) AS min_len""")
def hashlet_min_len(spark, sf):
    return hashlet.min_hashlet_len(history(spark, sf))


# --------------------------------------------------------------------------- statistics
STATS_BASE = f"\nbase AS (SELECT * FROM history WHERE source = '' AND NOT {DEFAULT_NOISE})"


def _stats_base(spark, sf):
    return commands.analyze_base(history(spark, sf), squelch_patterns=DEFAULT_SQUELCH)


@register("stats_overview", H(STATS_BASE) + f"""
SELECT count(*) AS total_commands, count(DISTINCT cmd) AS unique_commands,
       count(DISTINCT {O.program_sql()}) AS unique_programs,
       min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms,
       CAST(CASE WHEN count(*) > 0 THEN count(*) / greatest(1.0, (max(ts_ms) - min(ts_ms)) / 86400000.0) ELSE 0.0 END
         AS DOUBLE) AS avg_per_day
FROM base""")
def stats_overview(spark, sf):
    return stats.overview(_stats_base(spark, sf))


def _top_sql(label_sql: str, n: int, where: str = "TRUE") -> str:
    return H(STATS_BASE, O.category_map_cte()) + f"""
SELECT label, count FROM (
  SELECT {label_sql} AS label, count(*) AS count FROM base WHERE {where} GROUP BY 1)
ORDER BY count DESC, label LIMIT {n}"""


register("top_commands", _top_sql("cmd", 15))(lambda s, sf: stats.top_list(_stats_base(s, sf), "commands"))
register("top_programs", _top_sql(O.program_sql(), 15))(lambda s, sf: stats.top_list(_stats_base(s, sf), "programs"))
register("top_categories", _top_sql(O.category_sql(O.program_sql()), 10))(
    lambda s, sf: stats.top_list(_stats_base(s, sf), "categories"))
register("top_dirs", _top_sql("cwd", 10, "cwd <> ''"))(lambda s, sf: stats.top_list(_stats_base(s, sf), "dirs"))


@register("top_list_view", H(STATS_BASE) + f"""
SELECT CAST(row_number() OVER (ORDER BY count DESC, label) AS INTEGER) AS rank, label, count,
       CAST(100.0 * count / (SELECT count(*) FROM base) AS DOUBLE) AS share_pct
FROM (SELECT label, count FROM (SELECT {O.program_sql()} AS label, count(*) AS count FROM base GROUP BY 1)
      ORDER BY count DESC, label LIMIT 15)""")
def top_list_view(spark, sf):
    return stats.top_list_view(_stats_base(spark, sf), "programs")


@register("hourly_distribution", H(STATS_BASE) + """
SELECT CAST(h.hour AS INTEGER) AS hour, coalesce(c.count, 0) AS count
FROM (SELECT unnest(generate_series(0, 23)) AS hour) h
LEFT JOIN (SELECT hour(make_timestamp(ts_ms * 1000)) AS hour, count(*) AS count FROM base GROUP BY 1) c
  USING (hour)""")
def hourly_distribution(spark, sf):
    return stats.hourly_distribution(_stats_base(spark, sf))


@register("daily_distribution", H(STATS_BASE) + """
SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS count FROM base GROUP BY 1""")
def daily_distribution(spark, sf):
    return stats.daily_distribution(_stats_base(spark, sf))


@register("activity_heatmap", H(STATS_BASE) + """,
anchor AS (SELECT CAST(date_trunc('week', max(CAST(make_timestamp(ts_ms * 1000) AS DATE))) AS DATE) AS monday FROM base),
grid AS (SELECT CAST(i // 7 AS INTEGER) AS week, CAST(i % 7 AS INTEGER) AS dow,
                CAST(monday - INTERVAL (51 * 7) DAY + INTERVAL (i) DAY AS DATE) AS day
         FROM anchor, (SELECT unnest(generate_series(0, 52 * 7 - 1)) AS i) g),
daily AS (SELECT CAST(make_timestamp(ts_ms * 1000) AS DATE) AS day, count(*) AS count FROM base GROUP BY 1)
SELECT week, dow, strftime(day, '%Y-%m-%d') AS day, coalesce(count, 0) AS count,
       CASE WHEN coalesce(count, 0) >= 21 THEN 5 WHEN coalesce(count, 0) >= 11 THEN 4
            WHEN coalesce(count, 0) >= 6 THEN 3 WHEN coalesce(count, 0) >= 3 THEN 2
            WHEN coalesce(count, 0) >= 1 THEN 1 ELSE 0 END AS level
FROM grid LEFT JOIN daily USING (day)""")
def activity_heatmap(spark, sf):
    return stats.activity_heatmap(_stats_base(spark, sf))


@register("relative_time", H() + """
SELECT hash,
  CASE WHEN d // 86400000 > 0 THEN CASE WHEN d // 86400000 = 1 THEN '1 day ago' ELSE CAST(d // 86400000 AS VARCHAR) || ' days ago' END
       WHEN d // 3600000 > 0 THEN CASE WHEN d // 3600000 = 1 THEN '1 hour ago' ELSE CAST(d // 3600000 AS VARCHAR) || ' hours ago' END
       WHEN d // 60000 > 0 THEN CASE WHEN d // 60000 = 1 THEN '1 minute ago' ELSE CAST(d // 60000 AS VARCHAR) || ' minutes ago' END
       ELSE 'A few moments ago' END AS when_label
FROM (SELECT hash, greatest((SELECT max(ts_ms) FROM history) - ts_ms, 0) AS d FROM history)""")
def relative_time_q(spark, sf):
    h = history(spark, sf)
    as_of = h.select(F.max("ts_ms")).scalar()
    return h.select("hash", relative_time(F.col("ts_ms"), as_of).alias("when_label"))


@register("command_categories", H(O.category_map_cte()) + f"""
SELECT hash, {O.program_sql()} AS program, {O.category_sql(O.program_sql())} AS category_label FROM history""")
def command_categories(spark, sf):
    h = history(spark, sf)
    return h.select("hash", program_name("cmd").alias("program"), category("cmd").alias("category_label"))


# --------------------------------------------------------------------------- prune
MARKS_SQL = O.category_map_cte() + f""",
marks AS (SELECT hash FROM history WHERE {O.category_sql(O.program_sql())} = 'containers'),
unmarks AS (SELECT hash FROM history WHERE contains(cmd, 'view')),
annotations AS (SELECT hash, 1 AS type, 'prune' AS "desc" FROM marks WHERE hash NOT IN (SELECT hash FROM unmarks))"""


def _marked(spark, sf):
    h = stored_history(spark, sf)
    empty = spark.createDataFrame([], "hash string, type int, desc string")
    mark = h.filter(category("cmd") == "containers").select("hash")
    unmark = h.filter(F.col("cmd").contains("view")).select("hash")
    ann = maintenance.unmark_prune(maintenance.mark_prune(empty, mark), unmark)
    return h, ann


@register("unmark", H(MARKS_SQL) + "\nSELECT hash, type, \"desc\" FROM annotations")
def unmark_q(spark, sf):
    return _marked(spark, sf)[1]


@register("prune_candidates", H(MARKS_SQL) + """
SELECT hash, cmd, ts_ms FROM history WHERE hash IN (SELECT hash FROM annotations)""")
def prune_candidates(spark, sf):
    h, ann = _marked(spark, sf)
    return maintenance.prune_candidates(h, ann).select("hash", "cmd", "ts_ms")


@register("prune_count", H(MARKS_SQL) + """
SELECT count(*) AS pruned FROM history WHERE hash IN (SELECT hash FROM annotations)""")
def prune_count(spark, sf):
    h, ann = _marked(spark, sf)
    return maintenance.prune_count(h, ann)


@register("prune_apply", H(MARKS_SQL) + """
SELECT hash, cmd FROM history WHERE hash NOT IN (SELECT hash FROM annotations)""")
def prune_apply(spark, sf):
    h, ann = _marked(spark, sf)
    new_h, _, _, _ = maintenance.prune_apply(h, None, ann)
    return new_h.select("hash", "cmd")


@register("prune_index", H(MARKS_SQL, "\nidx AS (" + O.trigram_rows("history", "hash", "cmd") + ")") + """
SELECT ngram, hash FROM idx WHERE hash NOT IN (SELECT hash FROM annotations)""")
def prune_index(spark, sf):
    h, ann = _marked(spark, sf)
    _, new_idx, _, _ = maintenance.prune_apply(h, index.build_index(h), ann)
    return new_idx


# --------------------------------------------------------------------------- streaming
def _event_stream(spark, sf):
    schema = fixtures.load(spark, sf, "events").schema
    # the table may be one file or a folder of part files; a glob path reads either
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{sf.rstrip('/')}/events.parque[t]"))
    return fixtures.command_events(stream)


@register("stream_latest", ORACLE["ingest_latest"])
def stream_latest(spark, sf):
    out = checkpoint_path(spark, "stream-latest-table")
    qy = streaming.start_latest(_event_stream(spark, sf), out,
                                state_partitions=spark.sparkContext.defaultParallelism)
    qy.awaitTermination()
    return streaming.read_latest(spark, out).select("hash", "cmd", "cwd", "ts_ms", "source", "tool", "category")


@register("stream_index", ORACLE["ngram_index"])
def stream_index(spark, sf):
    out = checkpoint_path(spark, "stream-index-table")
    qy = streaming.start_index(_event_stream(spark, sf), out,
                               state_partitions=spark.sparkContext.defaultParallelism)
    qy.awaitTermination()
    return spark.read.parquet(out).select("ngram", "hash")


# --------------------------------------------------------------------------- more surface
@register("stats_grouping_sets", H(STATS_BASE, O.category_map_cte()) + f""",
rows AS (
  SELECT cmd AS commands, {O.program_sql()} AS programs, {O.category_sql(O.program_sql())} AS categories,
         CASE WHEN cwd <> '' THEN cwd END AS dirs,
         CAST(hour(make_timestamp(ts_ms * 1000)) AS VARCHAR) AS hour,
         strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day
  FROM base)
SELECT dimension, label, count FROM (
  SELECT CASE WHEN grouping(commands) = 0 THEN 'commands' WHEN grouping(programs) = 0 THEN 'programs'
              WHEN grouping(categories) = 0 THEN 'categories' WHEN grouping(dirs) = 0 THEN 'dirs'
              WHEN grouping(hour) = 0 THEN 'hour' ELSE 'day' END AS dimension,
         coalesce(commands, programs, categories, dirs, hour, day) AS label, count(*) AS count
  FROM rows GROUP BY GROUPING SETS ((commands), (programs), (categories), (dirs), (hour), (day)))
WHERE NOT (dimension = 'dirs' AND label IS NULL)""")
def stats_grouping_sets(spark, sf):
    return stats.stats_all(_stats_base(spark, sf))


@register("tool_history_category", TOOL_HISTORY_SQL.replace("WHERE source = 'agent' AND tool = 'Read'",
                                                            "WHERE source = 'agent' AND category = 'search'"))
def tool_history_category(spark, sf):
    ev = tool_calls.tool_events(fixtures.tool_call_json(events(spark, sf)))
    return commands.tool_history(ingest.ingest(ev), category="search", tag="agent")


@register("history_tagged", H() + f"\nSELECT {HIST_COLS} FROM history WHERE source = 'agent' AND NOT {DEFAULT_NOISE}")
def history_tagged(spark, sf):
    return commands.history(history(spark, sf), source="agent", squelch_patterns=DEFAULT_SQUELCH)


@register("find_reversed", O.find_sql(["docker", "view"], 5, "/home/u11/proj").replace(
    "ORDER BY rank_key DESC, ts_ms DESC, hash) AS INTEGER) AS pos",
    "ORDER BY rank_key ASC, ts_ms ASC, hash DESC) AS INTEGER) AS pos"))
def find_reversed(spark, sf):
    return commands.find(history(spark, sf), ["docker", "view"], limit=5, cwd="/home/u11/proj", reverse=True)


CAT_LIMIT_PHRASE = "git statu"


@register("cat_limit_phrase", H() + f"""
SELECT {HIST_COLS}, {O.exact_sql('cmd', CAT_LIMIT_PHRASE)} AS exact,
       CAST(row_number() OVER (ORDER BY {O.exact_sql('cmd', CAT_LIMIT_PHRASE)} DESC, ts_ms, hash) AS INTEGER) AS pos
FROM (SELECT * FROM history WHERE source = '' ORDER BY ts_ms DESC, hash DESC LIMIT 300)
WHERE NOT {DEFAULT_NOISE}
  AND ({O.exact_sql('cmd', CAT_LIMIT_PHRASE)} OR {O.fuzzy_sql('cmd', CAT_LIMIT_PHRASE)})""")
def cat_limit_phrase(spark, sf):
    return commands.cat(history(spark, sf), phrase=CAT_LIMIT_PHRASE, limit=300,
                        squelch_patterns=DEFAULT_SQUELCH)


@register("line_source_ingest", """
SELECT DISTINCT sha256(cmd) AS hash, cmd, '/docs' AS cwd FROM (
  SELECT regexp_replace(line, '\\r$', '') AS cmd
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
WHERE cmd <> ''""")
def line_source_ingest(spark, sf):
    """Documents written as a plain-text command log to the shared folder,
    read back one command per line and ingested."""
    path = checkpoint_path(spark, "line-log")
    documents(spark, sf).select("text").write.text(path)
    lines = store.read_lines(spark, path, ts_ms=0)
    return ingest.ingest(lines, default_cwd="/docs").select("hash", "cmd", "cwd")


@register("history_view", H(f"""
hits AS (SELECT {HIST_COLS} FROM history WHERE source = '' AND NOT {DEFAULT_NOISE})""", """
lens AS (SELECT unnest(generate_series(4, 64)) AS l),
ok AS (SELECT l FROM lens WHERE (SELECT count(DISTINCT substr(hash, 1, l)) FROM hits) = (SELECT count(*) FROM hits)),
n AS (SELECT CASE WHEN (SELECT count(*) FROM hits) <= 1 THEN 4 ELSE coalesce((SELECT min(l) FROM ok), 64) END AS n)""") + """
SELECT hash, cmd, cwd, ts_ms, source, substr(hash, 1, (SELECT n FROM n)) AS hashlet,
  CASE WHEN d // 86400000 > 0 THEN CASE WHEN d // 86400000 = 1 THEN '1 day ago' ELSE CAST(d // 86400000 AS VARCHAR) || ' days ago' END
       WHEN d // 3600000 > 0 THEN CASE WHEN d // 3600000 = 1 THEN '1 hour ago' ELSE CAST(d // 3600000 AS VARCHAR) || ' hours ago' END
       WHEN d // 60000 > 0 THEN CASE WHEN d // 60000 = 1 THEN '1 minute ago' ELSE CAST(d // 60000 AS VARCHAR) || ' minutes ago' END
       ELSE 'A few moments ago' END AS when_label
FROM (SELECT *, greatest((SELECT max(ts_ms) FROM hits) - ts_ms, 0) AS d FROM hits)""")
def history_view(spark, sf):
    """User history with per-result hash prefixes and relative-time labels."""
    hits = commands.history(history(spark, sf), squelch_patterns=DEFAULT_SQUELCH)
    return commands.hit_view(hits)


# --------------------------------------------------------------------------- occurrence mode
EVENTS_BASE = f"\nbase AS (SELECT * FROM command_events WHERE source = '' AND NOT {DEFAULT_NOISE})"


def _event_base(spark, sf):
    """Statistics over the raw event log (true frequencies): same operators,
    the occurrence table as input."""
    ev = fixtures.command_events(events(spark, sf))
    return commands.analyze_base(ev, squelch_patterns=DEFAULT_SQUELCH)


@register("stats_overview_events", "WITH " + O.COMMAND_EVENTS + "," + EVENTS_BASE + f"""
SELECT count(*) AS total_commands, count(DISTINCT cmd) AS unique_commands,
       count(DISTINCT {O.program_sql()}) AS unique_programs,
       min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms,
       CAST(CASE WHEN count(*) > 0 THEN count(*) / greatest(1.0, (max(ts_ms) - min(ts_ms)) / 86400000.0) ELSE 0.0 END
         AS DOUBLE) AS avg_per_day
FROM base""")
def stats_overview_events(spark, sf):
    return stats.overview(_event_base(spark, sf))


@register("top_programs_events", "WITH " + O.COMMAND_EVENTS + "," + EVENTS_BASE + f"""
SELECT label, count FROM (
  SELECT {O.program_sql()} AS label, count(*) AS count FROM base GROUP BY 1)
ORDER BY count DESC, label LIMIT 15""")
def top_programs_events(spark, sf):
    return stats.top_list(_event_base(spark, sf), "programs")


@register("ingest_incremental", ORACLE["ingest_latest"])
def ingest_incremental(spark, sf):
    """Ingest the older half of the event log (by time), then merge the newer
    half into that history with the upsert rules; equals a full ingest."""
    ev = fixtures.command_events(events(spark, sf))
    mid = ev.select(((F.min("ts_ms") + F.max("ts_ms")) / 2).alias("m")).scalar()
    older = ingest.ingest(ev.filter(F.col("ts_ms") <= mid))
    newer = ingest.ingest(ev.filter(F.col("ts_ms") > mid))
    return ingest.merge_history(older, newer)


@register("find_marked", H(MARKS_SQL) + """
SELECT f.hash, f.cmd, f.cwd, f.ts_ms,
       CASE WHEN f.hash IN (SELECT hash FROM annotations) THEN 1 ELSE 0 END AS annotation_type,
       f.source, f.is_global, f.rank, f.pos
FROM (""" + O.find_sql(["docker", "ps"], 8, None, "user") + ") f")
def find_marked(spark, sf):
    """Ranked search over a history with prune marks: hits carry the mark."""
    h, ann = _marked(spark, sf)
    return commands.find(h, ["docker", "ps"], limit=8, annotations=ann)


# --------------------------------------------------------------------------- byte strings
_BAD_BYTES = "encode(text) || '\\xFF\\xFE\\x41'::BLOB"


def _byte_commands(spark, sf) -> DataFrame:
    """Documents as commands that end in bytes that form no UTF-8."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE41")))
    return documents(spark, sf).select("doc_id", raw.cast("string").alias("cmd"))


@register("command_hash_bytes", f"SELECT doc_id, sha256({_BAD_BYTES}) AS hash FROM documents")
def command_hash_bytes(spark, sf):
    return _byte_commands(spark, sf).select("doc_id", command_hash("cmd").alias("hash"))


@register("decode_bad_bytes", f"""
SELECT doc_id, hex({_BAD_BYTES}) AS cmd_hex, CAST(doc_id AS BIGINT) AS ts_ms FROM documents""")
def decode_bad_bytes(spark, sf):
    """Stored rows of such commands, written, read back and decoded: every byte stays."""
    c = _byte_commands(spark, sf)
    raw = store.encode_history(c.select(F.col("doc_id").cast("string").alias("hash"), "cmd", F.lit("").alias("cwd"),
                                        F.col("doc_id").alias("ts_ms")))
    path = checkpoint_path(spark, "raw-bytes")
    raw.write.parquet(path)
    back = store.decode_history(store.read_history_raw(spark, path))
    return back.select(F.col("hash").cast("long").alias("doc_id"), F.hex(F.col("cmd").cast("binary")).alias("cmd_hex"), "ts_ms")


@register("ngram_index_bytes", f"""
SELECT ngram, count(*) AS doc_freq FROM (
  SELECT DISTINCT ('0x' || substr(hex(b), 2 * i - 1, 6))::INTEGER AS ngram, doc_id
  FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - 2)) AS i
        FROM (SELECT doc_id, {_BAD_BYTES} AS b FROM documents)))
GROUP BY ngram""")
def ngram_index_bytes(spark, sf):
    idx = index.build_index(_byte_commands(spark, sf), key_col="doc_id")
    return index.gram_doc_freq(idx, key_col="doc_id")


# --------------------------------------------------------------------------- tool-call payloads
# (event_id % 12 -> payload); the last four yield a row. Each kind's text is fixed but for the event id.
_PAYLOADS = [
    '{"tool_name":"Bash","tool_input":{"command":null},"cwd":"/w"}',
    '{"tool_name":"Bash","tool_input":{"command":7},"cwd":"/w"}',
    '{"tool_name":null,"tool_input":{},"cwd":"/w"}',
    '{"tool_name":"Bash","tool_input":{"command":"ls"},"cwd":null}',
    '{"tool_name":"Bash","tool_input":null,"cwd":"/w"}',
    "{'tool_name':'Bash','tool_input':{'command':'ls'},'cwd':'/w'}",
    '{"tool_name":"Bash","tool_input":{"command":"ls"},"cwd":"/w"} trailing',
    '["tool_name"]',
    '{"tool_name":"CronList","tool_input":5,"cwd":"/w"}',
    '{"tool_name":"Bash","tool_input":{"command":" ls # "},"cwd":"/w"}',
    '{"tool_name":"Grep"}',
    '{"tool_input":{"command":"x"}}',
]


@register("tool_calls_malformed", """
SELECT event_id,
  CASE k WHEN 8 THEN 'CronList' WHEN 9 THEN 'Bash' WHEN 10 THEN 'Grep' ELSE '' END AS tool,
  CASE k WHEN 8 THEN 'cron' WHEN 9 THEN 'shell' WHEN 10 THEN 'search' ELSE 'other' END AS category,
  CASE k WHEN 8 THEN '[CronList]' WHEN 9 THEN '[Bash] ls ' || event_id WHEN 10 THEN '[Grep]' ELSE '[]' END AS display,
  CASE k WHEN 8 THEN '/w' WHEN 9 THEN '/w' ELSE '' END AS cwd
FROM (SELECT event_id, event_id % 12 AS k FROM events) WHERE k >= 8""")
def tool_calls_malformed(spark, sf):
    e = events(spark, sf)
    kind = F.element_at(F.array(*[F.lit(x) for x in _PAYLOADS]), (F.col("event_id") % len(_PAYLOADS) + 1).cast("int"))
    js = F.replace(kind, F.lit("#"), F.col("event_id").cast("string"))
    tc = tool_calls.tool_calls(e.select("event_id", js.alias("js")))
    return tc.select("event_id", "tool", "category", "display", F.col("tool_cwd").alias("cwd"))


# --------------------------------------------------------------------------- metadata through prune and merge
@register("prune_reindex_tag", "WITH " + O.COMMAND_EVENTS + "," + O.history_cte("(SELECT * FROM command_events WHERE event_id % 2 = 0)", "older").lstrip()
          + "," + O.history_cte("(SELECT event_id, cmd, cwd, ts_ms, '' AS source, '' AS tool, '' AS category FROM command_events)", "again").lstrip() + """
SELECT a.hash, a.cmd, a.ts_ms, coalesce(o.source, '') AS source, coalesce(o.tool, '') AS tool,
       coalesce(o.category, '') AS category
FROM again a LEFT JOIN older o USING (hash)""")
def prune_reindex_tag(spark, sf):
    """Half of the log is ingested and pruned; its metadata rows stay, so the whole log, indexed again without
    tags, gets the old tags back."""
    ev = fixtures.command_events(events(spark, sf))
    older = ingest.ingest(ev.filter(F.col("event_id") % 2 == 0))
    marks = maintenance.mark_prune(spark.createDataFrame([], "hash string, type int, desc string"), older.select("hash"))
    _, _, _, meta = maintenance.prune_apply(older, None, marks, ingest.meta_table(older))
    bare = ev.select("event_id", "cmd", "cwd", "ts_ms")
    return ingest.ingest(bare, prior_meta=meta).select("hash", "cmd", "ts_ms", "source", "tool", "category")


@register("ingest_incremental_overlap", ORACLE["ingest_latest"])
def ingest_incremental_overlap(spark, sf):
    """Two batches interleaved in time, merged by each tag's own order; equals a full ingest."""
    ev = fixtures.command_events(events(spark, sf))
    parts = [ingest.ingest(ev.filter(F.col("event_id") % 3 == 0), with_order=True),
             ingest.ingest(ev.filter(F.col("event_id") % 3 != 0), with_order=True)]
    return ingest.merge_history(*parts).select("hash", "cmd", "cwd", "ts_ms", "source", "tool", "category")


# --------------------------------------------------------------------------- stored layout
def _read_back(spark, sf) -> DataFrame:
    path = checkpoint_path(spark, "history-layout")
    store.write_history(history(spark, sf), path)
    return store.read_history(spark, path)


@register("find_stored", ORACLE["find_local"])
def find_stored(spark, sf):
    case = FIND_CASES["find_local"]
    return commands.find(_read_back(spark, sf), case["keywords"], cwd=case["cwd"])


@register("history_stored_local", ORACLE["history_local"])
def history_stored_local(spark, sf):
    return commands.history(_read_back(spark, sf), cwd="/home/u7/proj", squelch_patterns=DEFAULT_SQUELCH)


@register("stored_missing_cwd", H() + "\nSELECT hash, cmd, '' AS cwd, ts_ms FROM history")
def stored_missing_cwd(spark, sf):
    """Rows stored before the directory column existed read it as empty."""
    path = checkpoint_path(spark, "raw-old")
    store.encode_history(history(spark, sf)).drop("cwd").write.parquet(path)
    return store.decode_history(store.read_history_raw(spark, path))


# --------------------------------------------------------------------------- arguments
@register("build_meta", H() + """
SELECT hash, CAST(length(list_filter([source, tool, category], lambda x: x <> '')) AS INTEGER) AS n_tags,
       source AS meta_source, tool AS meta_tool, category AS meta_category FROM history""")
def build_meta_q(spark, sf):
    m = ingest.build_meta("source", "tool", "category")
    h = history(spark, sf).select("hash", m.alias("m"))

    def tag(key):
        return F.coalesce(F.col("m")[key], F.lit("")).alias(f"meta_{key}")
    return h.select("hash", F.size("m").alias("n_tags"), tag("source"), tag("tool"), tag("category"))


@register("split_keywords", """
SELECT doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') AS keywords FROM documents""")
def split_keywords_q(spark, sf):
    from ..functions.text import split_keywords
    return documents(spark, sf).select("doc_id", split_keywords("text").alias("keywords"))


@register("find_blank", H("""
queries AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || event_type AS qid, event_type, user_id % 2 = 0 AS blank FROM events)""",
                          "\nidx AS (" + O.trigram_rows("history", "hash", "cmd") + ")", """
wanted AS (SELECT event_type, list(DISTINCT ngram) AS g FROM (""" + O.trigram_rows(
    "(SELECT DISTINCT event_type FROM events)", "event_type", "event_type") + """) GROUP BY event_type)""", """
matching AS (
  SELECT w.event_type, count(DISTINCT i.hash) AS n FROM wanted w JOIN idx i ON list_contains(w.g, i.ngram)
  JOIN history h ON h.hash = i.hash AND h.source = '' GROUP BY w.event_type)""") + """
SELECT qid, CASE WHEN blank THEN 0 ELSE least(5, coalesce(n, 0)) END AS hits FROM queries LEFT JOIN matching USING (event_type)""")
def find_blank(spark, sf):
    """Queries of which every other user's holds blank keywords only: these find nothing, the others their hits."""
    ev = events(spark, sf)
    q = fixtures.search_queries(ev).select(
        "qid", F.when(F.element_at("keywords", 2).cast("long") % 2 == 0, F.array(F.lit(""), F.lit("")))
        .otherwise(F.array(F.element_at("keywords", 1), F.lit(""))).alias("keywords"), F.lit("").alias("cwd"))
    q = materialize(q, "blank-queries")
    hits = commands.batch_search(stored_history(spark, sf), q).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return q.join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("hits"))


@register("find_default_limit", O.find_sql(["git", "status"], 5))
def find_default_limit(spark, sf):
    """A limit of 0 or less means 5."""
    return commands.find(history(spark, sf), ["git", "status"], limit=-3)


# the configured limit is kept within 5 and 20
for _name, _limit, _clamped in (("find_limit_clamped", 50, 20), ("find_limit_raised", 2, 5)):
    def _mk_clamped(limit):
        return lambda spark, sf: commands.find(history(spark, sf), ["git", "status"], limit=limit, clamp=True)
    register(_name, O.find_sql(["git", "status"], _clamped))(_mk_clamped(_limit))


@register("find_limit_large", O.find_sql(["git", "view"], 5_000_000))
def find_limit_large(spark, sf):
    """A limit beyond a top-k's reach: every hit of the best tier, with its position."""
    return commands.find(history(spark, sf), ["git", "view"], limit=5_000_000)


MANY_KEYWORDS = 5_000
_KEYWORD_WORDS = "SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS w FROM documents"


@register("find_many_keywords", f"""
WITH words AS ({_KEYWORD_WORDS}),
kws AS (SELECT list(w) AS k FROM (SELECT w FROM words WHERE strlen(w) >= 4 ORDER BY md5(w), w LIMIT {MANY_KEYWORDS})),
found AS (SELECT doc_id, list_sort(list_filter(k, lambda w: contains(text, w))) AS f FROM documents, kws)
SELECT doc_id, CAST(len(f) AS INTEGER) AS n_found, md5(array_to_string(f, chr(10))) AS found_md5 FROM found WHERE len(f) > 0""")
def find_many_keywords(spark, sf):
    """5,000 words of the documents looked for in every document, in one pass over each text."""
    d = documents(spark, sf)
    words = d.select(F.explode(F.split("text", "[ \n]+")).alias("w")).filter(F.octet_length("w") >= 4).distinct()
    # the query's keywords: a list that a user would type or load
    kws = [r.w for r in words.orderBy(F.md5("w"), "w").limit(MANY_KEYWORDS).collect()]
    hits = search.keyword_hits(d.select("doc_id", "text"), kws, "text")
    return hits.select("doc_id", F.size("found").alias("n_found"), F.md5(F.array_join("found", "\n")).alias("found_md5"))


# --------------------------------------------------------------------------- statistics in a zone with daylight saving
# The log's month stretched over fourteen, so that both changes of the clock fall into it.
STRETCH, ORIGIN_MS, ZONE = 14, 1_704_067_200_000, "Europe/Berlin"
_LAST_SUNDAY = "(make_date(y, {m}, 31) - CAST(dayofweek(make_date(y, {m}, 31)) AS INTEGER) + TIME '01:00:00')"
ZONED = f"""
utc AS (SELECT make_timestamp((({ORIGIN_MS} + (ts_ms - {ORIGIN_MS}) * {STRETCH})) * 1000) AS t FROM base),
zoned AS (
  SELECT t + CASE WHEN t >= {_LAST_SUNDAY.format(m=3)} AND t < {_LAST_SUNDAY.format(m=10)} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS t
  FROM (SELECT t, CAST(year(t) AS INTEGER) AS y FROM utc))"""


def _stretched_base(spark, sf):
    return _stats_base(spark, sf).withColumn("ts_ms", F.lit(ORIGIN_MS) + (F.col("ts_ms") - F.lit(ORIGIN_MS)) * STRETCH)


@register("stats_local_zone", H(STATS_BASE, ZONED) + """
SELECT 'hour' AS dimension, CAST(h.hour AS VARCHAR) AS label, coalesce(c.count, 0) AS count
FROM (SELECT unnest(generate_series(0, 23)) AS hour) h
LEFT JOIN (SELECT hour(t) AS hour, count(*) AS count FROM zoned GROUP BY 1) c USING (hour)
UNION ALL
SELECT 'day', strftime(t, '%Y-%m-%d'), count(*) FROM zoned GROUP BY 2""")
def stats_local_zone(spark, sf):
    """Hours and days in a zone whose clock changes twice within the log."""
    base = _stretched_base(spark, sf)
    hours = stats.hourly_distribution(base, tz=ZONE).select(F.lit("hour").alias("dimension"), F.col("hour").cast("string").alias("label"), "count")
    days = stats.daily_distribution(base, tz=ZONE).select(F.lit("day").alias("dimension"), F.col("day").alias("label"), "count")
    return hours.unionByName(days)


_HEATMAP_LOCAL = ORACLE["activity_heatmap"].replace("CAST(make_timestamp(ts_ms * 1000) AS DATE)", "CAST(t AS DATE)").replace("FROM base", "FROM zoned")


@register("heatmap_local_zone", _HEATMAP_LOCAL.replace(STATS_BASE, STATS_BASE + "," + ZONED))
def heatmap_local_zone(spark, sf):
    return stats.activity_heatmap(_stretched_base(spark, sf), tz=ZONE)


@register("squelch_user_list", _squelch_sql(O.noise_sql(O.NOISE + ["make build", "fzf"], [SQ_GLOB_RE2[0]])))
def squelch_user_list(spark, sf):
    """The built-in list and the user's patterns, concatenated."""
    from ..operators.squelch import active_list
    return _squelch_q(active_list(user_patterns=["make build", "fzf", SQ_GLOB[0]]))(spark, sf)


@register("activity_heatmap_104w", ORACLE["activity_heatmap"].replace("(51 * 7)", "(103 * 7)").replace("52 * 7 - 1", "104 * 7 - 1"))
def activity_heatmap_104w(spark, sf):
    return stats.activity_heatmap(_stats_base(spark, sf), weeks=104)


@register("cat_limit_large", H() + f"""
SELECT {HIST_COLS}, FALSE AS exact, CAST(row_number() OVER (ORDER BY ts_ms, hash) AS INTEGER) AS pos
FROM (SELECT * FROM history WHERE source = '' ORDER BY ts_ms DESC, hash DESC LIMIT 5000000)
WHERE NOT {DEFAULT_NOISE}""")
def cat_limit_large(spark, sf):
    """A limit beyond a top-k's reach: positions come from a distributed order."""
    return commands.cat(history(spark, sf), limit=5_000_000, squelch_patterns=DEFAULT_SQUELCH)


# --------------------------------------------------------------------------- streaming sources
def _drained(stream: DataFrame, spark, tag: str) -> DataFrame:
    out = checkpoint_path(spark, tag)
    streaming.start_latest(stream, out, state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return streaming.read_latest(spark, out)


LOG_FILE_BYTES = 256_000_000


def _as_log_files(lines: DataFrame, spark, tag: str, file_bytes: int = LOG_FILE_BYTES) -> str:
    """One text column written as log files of bounded size, at least four: one task writes a file, whatever the table."""
    path = checkpoint_path(spark, tag)
    size = lines.select(F.sum(F.octet_length(lines.columns[0]).cast("long"))).first()[0] or 0
    lines.repartition(max(4, -(-size // file_bytes))).write.text(path)
    return path


@register("stream_lines", ORACLE["line_source_ingest"].replace("'/docs'", "'/stream'"))
def stream_lines(spark, sf):
    """Documents written as line logs in several files, streamed one file per micro-batch."""
    path = _as_log_files(documents(spark, sf).select("text"), spark, "line-stream")
    lines = streaming.line_stream(spark, path, cwd="/stream", files_per_batch=1)
    return _drained(lines, spark, "line-stream-table").select("hash", "cmd", "cwd")


@register("stream_tool_calls", "WITH " + O.tool_json_cte() + """
SELECT DISTINCT sha256(display) AS hash, display AS cmd, 'agent' AS source, tool, category FROM tool_parsed""")
def stream_tool_calls(spark, sf):
    """Hook payloads in several files, streamed one file per micro-batch."""
    path = _as_log_files(fixtures.tool_call_json(events(spark, sf)).select("js"), spark, "tool-stream")
    calls = streaming.tool_call_stream(spark, path, files_per_batch=1)
    return _drained(calls, spark, "tool-stream-table").select("hash", "cmd", "source", "tool", "category")


# --------------------------------------------------------------------------- regex dialect
DIALECT = ["a\\vb", "(?U)\\w{3,}\\.", "(?m:on$)|the$", "(?P<my_name>\\.)$", "{.*}", "a{,2}", "\\p{Greek}", "\\12The",
           "[[:^alpha:]]{4}", "[\\S]{30}", "(?i)É\\b", "\\bTh[^e]", "(?s)an.in", "^The.and", "\\Qof.\\E", "[\\x41-\\x43]\\D+\\z"]


@register("squelch_regex_dialect", "SELECT doc_id, " + ", ".join(
    f"regexp_matches(text, {O.q(p)}) AS m{i}" for i, p in enumerate(DIALECT)) + " FROM documents")
def squelch_regex_dialect(spark, sf):
    """Constructs on which the JVM's dialect differs, one column each, over whole documents."""
    from ..functions.patterns import re2_to_java
    return documents(spark, sf).select(
        "doc_id", *[F.col("text").rlike(re2_to_java(p)).alias(f"m{i}") for i, p in enumerate(DIALECT)])


from . import registry_stores  # noqa: E402,F401  (registers its queries)
