"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text without ASCII white space is cut where its own characters say so (three
characters in a row from fixed classes, a chunk has at least ``MIN_CHUNK`` and at
most ``MAX_CHUNK`` characters). A text's *recipe* is the ordered list of its
chunks' digests; equal texts have equal recipes. Texts are cut and hashed once and
written as chunks; the long texts move through one shuffle only, chunk by chunk and already combined in each task, to *verify* the
identifiers: a digest may stand for one chunk text only. If any digest stands
for two, recipes are lists of the chunk texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, keep_rows, stored, text_key

MIN_CHUNK, MAX_CHUNK = 512, 4096


def _cut_pattern() -> str:
    """Lazy chunk up to a cut: its last three characters have code points 1, 4 and 2 modulo 8.

    Classes cover U+0021..U+024F; text of other scripts is cut at ``MAX_CHUNK``
    characters, which depends on content from the last cut on.
    """
    def chars(residue):
        return "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x250) if c % 8 == residue) + "]"
    return f"(?s).{{{MIN_CHUNK - 3},{MAX_CHUNK - 3}}}?{chars(1)}{chars(4)}{chars(2)}|.{{{MAX_CHUNK}}}|.+"


CUT = _cut_pattern()


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CUT), F.lit(0))


def digest(chunk: Column, digest_chars: int) -> Column:
    return F.substring(F.sha2(chunk, 256), 1, digest_chars)


def cut_texts(docs: DataFrame, digest_chars: int = 32) -> DataFrame:
    """One row per row of ``docs``, each text normalised, cut and hashed once: _key, doc_id, n_cp,
    text_sha256, chunks, recipe (the chunks' digests)."""
    named = docs.select(text_key(F.col("doc_id"), F.col("text")).alias("_key"), "doc_id",
                        F.char_length(F.coalesce("text", F.lit(""))).alias("n_cp"), normalised(F.col("text")).alias("norm"))
    cut = named.select("_key", "doc_id", "n_cp", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
    return cut.withColumn("recipe", F.transform("chunks", lambda c: digest(c, digest_chars)))


def has_collision(cut: DataFrame) -> bool:
    """Whether some digest stands for two chunk texts (compares the texts themselves).

    Each task first reduces its chunks to one row per digest, so frequent chunks
    are not moved again and again.
    """
    each = cut.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("x")).select(
        F.col("x.recipe").alias("d"), F.col("x.chunks").alias("chunk"))
    by_digest = each.groupBy("d").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return by_digest.agg(F.max((F.col("lo") != F.col("hi")).cast("int")).alias("c")).first()["c"] == 1


def deduplicate(docs: DataFrame, digest_chars: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, _key.

    Of equal texts the row with the most code points in the original text stays,
    then the one with the smallest doc_id (a null doc_id comes last). Null and
    empty texts form one group with an empty recipe. Of rows equal in doc_id and
    text exactly one is marked kept. Texts of any length are cut whole.
    """
    cut = stored(cut_texts(docs, digest_chars), "chunked-texts")
    recipe = F.col("chunks" if has_collision(cut) else "recipe").alias("recipe")
    rows = cut.select("_key", "doc_id", "n_cp", "text_sha256", recipe)
    # rows equal in doc_id and text count once here and come back at the end
    tuples = stored(rows.groupBy("_key", "doc_id", "n_cp", "text_sha256", "recipe")
                    .agg(F.count(F.lit(1)).alias("copies")), "chunk-recipes")
    discard(cut)
    order = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("z"),
                     F.col("doc_id").alias("doc_id"), F.col("_key").alias("_key"))
    # written, so that the join has an exchange on either side and may split a large group of copies
    groups = stored(tuples.groupBy("recipe").agg(F.min(order).alias("first"), F.sum("copies").alias("group_size")),
                    "recipe-groups")
    joined = tuples.join(groups, "recipe")
    return joined.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", "text_sha256",
        F.size("recipe").alias("n_chunks"), "_key", (F.col("_key") == F.col("first._key")).alias("_first"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")
    ).select("doc_id", "keep_id", "group_size", (F.col("_first") & (F.col("_copy") == 1)).alias("kept"),
             "text_sha256", "n_chunks", "_key")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts."""
    return keep_rows(docs, deduplicate(docs).filter("kept"))
