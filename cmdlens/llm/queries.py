"""Registered queries of the training-data operators, with SQL where it can express them.

Each query applies its operator to the whole table with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (anchor_dedup, chunk_dedup, collocations, feistel_pii, harmonic_pack, hd_langid, kd_shard, laesa_codes,
               line_spread, piece_fst, secret_scan, simhash_dedup, suffix_quality)
from .common import documents, tuned

# A deployment passes a secret of its own.
PSEUDONYM_KEY = "documents-pseudonyms-v1"


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pseudonymised text, and the pseudonyms written (kind, pseudonym)."""
    return feistel_pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)


def op2_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and suffix-array repetition verdict of each document."""
    return suffix_quality.assess(documents(spark, sf_dir))


def op3_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by the transducer (with count, byte-fallback count and checksum) and the decoded
    text's length and digest: those of the document itself, unless it holds the blank mark."""
    rows = piece_fst.encode_documents(documents(spark, sf_dir))
    return rows.select("doc_id", "n_ids", "n_bytes", "ids_crc32", "ids", F.char_length("decoded").cast("bigint").alias("decoded_chars"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept words of each document."""
    return anchor_dedup.digests(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, p, w[p:p + 19] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (
  SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(p, p + 20)) AS i FROM later) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(array_to_string(
         CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and kept row of each document, equal up to ASCII white space."""
    return chunk_dedup.deduplicate(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, min(struct_pack(n := -n_cp, i := doc_id)) AS f FROM d GROUP BY norm)
SELECT d.doc_id, g.f.i AS keep_id, g.group_size, d.doc_id = g.f.i AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed cross-site boilerplate lines and digest of the rest of each document."""
    return line_spread.remove_boilerplate(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
bad AS (
  SELECT list(x) AS bad FROM (
    SELECT x FROM (SELECT source, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l)
    WHERE x <> '' GROUP BY x HAVING count(DISTINCT source) >= 8)),
k AS (
  SELECT doc_id, len(lines)::BIGINT AS n_lines, list_filter(lines, lambda x:
    NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM l, bad)
SELECT doc_id, n_lines, (n_lines - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


def op7_kd_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 0..23 of nearly equal bytes and slot of each document."""
    return kd_shard.shard(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    return simhash_dedup.near_duplicates(documents(spark, sf_dir), 3, 3).select(
        "doc_id", "fingerprint", "component_id")


def op9_hd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and cosine of each document, learned from three of four folds."""
    return hd_langid.identify(documents(spark, sf_dir))


def op10_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all tokenised documents packed into sequences of 1024 ids."""
    return harmonic_pack.pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: counts and digest of the known forms, and all spans with those the tests add."""
    rows = secret_scan.scan(documents(spark, sf_dir))
    return rows.select(
        "doc_id", *(secret_scan.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return collocations.mine(documents(spark, sf_dir))


OP12_SQL = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x
    FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents))),
w AS (
  SELECT lang, a, lead(a, 1) OVER piece AS b, lead(a, 2) OVER piece AS c
  FROM (SELECT lang, piece, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM p) WINDOW piece AS (PARTITION BY piece ORDER BY i)),
g AS MATERIALIZED (
  SELECT lang, a, NULL AS b, NULL AS c, a AS g, count(*) AS f FROM w GROUP BY lang, a UNION ALL
  SELECT lang, a, b, NULL, concat_ws(' ', a, b), count(*) FROM w WHERE b IS NOT NULL GROUP BY lang, a, b UNION ALL
  SELECT lang, a, b, c, concat_ws(' ', a, b, c), count(*) FROM w WHERE c IS NOT NULL GROUP BY lang, a, b, c),
f AS MATERIALIZED (SELECT * FROM g WHERE f >= 10),
cut AS (
  SELECT lang, g, f, 1 AS k, a AS x, concat_ws(' ', b, c) AS y FROM f WHERE b IS NOT NULL UNION ALL
  SELECT lang, g, f, 2, concat_ws(' ', a, b), c FROM f WHERE c IS NOT NULL),
best AS (
  SELECT t.lang, t.g, t.f AS a, x.f AS l, y.f AS r, ((1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut t JOIN f x ON x.lang = t.lang AND x.g = t.x JOIN f y ON y.lang = t.lang AND y.g = t.y
  QUALIFY row_number() OVER (PARTITION BY t.lang, t.g ORDER BY score, k) = 1),
held AS (
  SELECT lang, g, max(f) AS longer FROM (
    SELECT lang, concat_ws(' ', a, b) AS g, f FROM f WHERE c IS NOT NULL UNION ALL
    SELECT lang, concat_ws(' ', b, c), f FROM f WHERE c IS NOT NULL) GROUP BY lang, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE b IS NULL GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, g) AS rank, g AS phrase, b.a, l, r, n, score
FROM best b JOIN n USING (lang) LEFT JOIN held h USING (lang, g)
WHERE longer IS NULL OR len(regexp_extract_all(g, ' ')) = 2 OR 100 * longer < 50 * b.a
QUALIFY rank <= 2000
"""


def op13_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code, error and label error of each vector, with the digest of the trained codebooks."""
    vectors = tuned(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return laesa_codes.encode(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds as a chain of materialised tables: all distances, their least, the floored means."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, v, len(v) // {parts} AS width, row_number() OVER (ORDER BY vec_id, v) AS rn
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))),
x AS MATERIALIZED (
  SELECT rn, (i - 1) // width AS part, (i - 1) % width AS place, v[i] AS val
  FROM (SELECT rn, width, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, (rn - 1)::BIGINT AS entry, place, val FROM x WHERE rn <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT rn, part, min(struct_pack(d := d, e := entry)) AS best
  FROM (SELECT x.rn, x.part, b.entry, sum((x.val - b.val) * (x.val - b.val)) AS d
        FROM x JOIN b{k} b ON x.part = b.part AND x.place = b.place GROUP BY ALL) GROUP BY rn, part)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, b.val)::BIGINT AS val
  FROM b{k} b LEFT JOIN (SELECT x.part, a.best.e AS entry, x.place, sum(x.val) AS s, count(*) AS n
                         FROM x JOIN a{k} a ON x.rn = a.rn AND x.part = a.part GROUP BY ALL) m
  ON b.part = m.part AND b.entry = m.entry AND b.place = m.place)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
  SELECT rn, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rn)
"""


OP13_SQL = _op13_sql()


QUERIES = {f.__name__: f for f in (
    op1_feistel_pii, op2_suffix_quality, op3_piece_fst, op4_anchor_dedup, op5_chunk_dedup, op6_line_spread,
    op7_kd_shard, op8_simhash_dedup, op9_hd_langid, op10_harmonic_pack, op11_secret_scan, op12_collocations,
    op13_laesa_codes)}

ORACLE = {"op4_anchor_dedup": OP4_SQL, "op5_chunk_dedup": OP5_SQL, "op6_line_spread": OP6_SQL, "op12_collocations": OP12_SQL,
          "op13_laesa_codes": OP13_SQL}
