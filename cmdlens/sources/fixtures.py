"""Command-log inputs derived from the driver's test tables.

No test table holds shell commands, so these builders map ``events`` rows to
the schemas the operators expect (command events, tool-call JSON, search
queries, hash prefixes). They only shape rows; no operator logic lives here.
The same derivations are written in SQL in ``cmdlens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Base commands chosen by event_id % 12 (see FIXTURES.md §4).
BASE_COMMANDS = [
    "git status", "ls -la", "docker ps", "make build", "FOO=bar go test ./...",
    "/usr/bin/python3 run.py", "curl http://h/x", "kubectl get pods", "ls",
    "vim main.go", "fzf", "git commit -m fix",
]
# Commands carry the number of their run of so many events: some repeat, and new
# ones appear for as long as the log goes on.
EVENTS_PER_NUMBER = 120
# residues that keep the bare command (so the default noise list drops them)
BARE_RESIDUES = (1, 8)
AGENT_TAG = ("agent", "Bash", "shell")

# Tool-call fixture: tool per event type and argument text.
EVENT_TOOL = {"view": "Read", "click": "Bash", "purchase": "WebFetch",
              "signup": "TodoWrite", "error": "Grep"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def command_events(events: DataFrame) -> DataFrame:
    """events -> (event_id, cmd, cwd, ts_ms, source, tool, category)."""
    eid = F.col("event_id")
    base = F.element_at(F.array(*[F.lit(c) for c in BASE_COMMANDS]), (eid % 12 + 1).cast("int"))
    cmd = F.when((eid % 12).isin(*BARE_RESIDUES), base).otherwise(
        F.concat(base, F.lit(" "), F.col("event_type"), F.lit(" "), F.floor(eid / EVENTS_PER_NUMBER).cast("string")))
    cwd = F.when(eid % 17 == 0, F.lit("")).otherwise(
        F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/proj")))
    ts_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    tagged = eid % 5 == 0
    tags = [F.when(tagged, F.lit(v)).otherwise(F.lit("")).alias(k)
            for k, v in zip(("source", "tool", "category"), AGENT_TAG)]
    return events.select(eid.alias("event_id"), cmd.alias("cmd"), cwd.alias("cwd"),
                         ts_ms.alias("ts_ms"), *tags)


def tool_call_json(events: DataFrame) -> DataFrame:
    """events -> (event_id, ts_ms, js): hook payloads incl. skipped tools,
    blank arguments and truncated (malformed) JSON."""
    eid = F.col("event_id")
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TOOL.items() for x in kv]),
                          F.col("event_type"))
    tool = F.when(eid % 9 == 0, F.lit("CronList")).otherwise(mapped)
    key = (F.when(tool == "Read", F.lit("file_path")).when(tool == "Bash", F.lit("command"))
           .when(tool == "WebFetch", F.lit("url")).when(tool == "Grep", F.lit("pattern"))
           .otherwise(F.lit("x")))
    arg = F.when(eid % 11 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  src/u"), F.col("user_id").cast("string"), F.lit("/f"),
                 F.floor(eid / 40).cast("string"), F.lit(".go ")))
    cwd = F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/proj"))
    js = F.to_json(F.struct(tool.alias("tool_name"), F.create_map(key, arg).alias("tool_input"),
                            cwd.alias("cwd")))
    js = F.when(eid % 13 == 0, F.substring(js, 1, 15)).otherwise(js)
    return events.select(eid.alias("event_id"),
                         F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), js.alias("js"))


def search_queries(events: DataFrame) -> DataFrame:
    """One keyword query per (user, event type): [event_type, user_id], scoped to the user's directory (global for every third user)."""
    pairs = events.select("user_id", "event_type").distinct()
    cwd = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/proj")))
    return pairs.select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("qid"),
        F.array(F.col("event_type"), F.col("user_id").cast("string")).alias("keywords"),
        cwd.alias("cwd"))


def hash_prefixes(history: DataFrame) -> DataFrame:
    """Prefixes to resolve: 1-8 leading characters of every hash, upper-cased
    and non-hex variants, prefixes of hashes not in the history, and ''."""
    h = F.col("hash")
    lengths = history.select(h, F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    plain = lengths.select(F.substring(h, 1, F.col("n")).alias("prefix"))
    upper = history.select(F.upper(F.substring(h, 1, 7)).alias("prefix"))
    bad = history.select(F.concat(F.lit("g"), F.substring(h, 2, 5)).alias("prefix"))
    missing = history.select(F.substring(F.sha2(F.concat(F.col("cmd"), F.lit("#")), 256), 1, 10)
                             .alias("prefix"))
    empty = history.select(F.lit("").alias("prefix"))
    return plain.unionByName(upper).unionByName(bad).unionByName(missing).unionByName(empty).distinct()
