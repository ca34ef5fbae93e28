"""Inverted trigram index and the batch (many-queries) search that uses it.

The index is one row per distinct (trigram, command): ``explode`` of the
per-row set of 3-byte windows, so building it is a narrow transformation (no
shuffle) on already de-duplicated history.

Batch search ranks with joins instead of one scan per query. Queries sharing
a keyword set share the work. The trigrams that are asked for meet the index
first and leave it as postings (trigram, command, time). Not every command that
shares a trigram with a set is counted: the newest commands that hold two of a set's
rarest trigrams give a first top n per set, and its last rank is a bound that all
others must reach. Of a set of m trigrams and bound b, a command with that rank holds
two of the m - b + 2 rarest, so only commands that hold such a pair are met (one of
the m - b + 1 rarest, where the pairs would be many), and they are ranked
where they meet the set: a row leaves for the next exchange only if it reaches the bound. Keywords of one or two bytes (the substring-scan path) meet a small
index of 1- and 2-byte substrings; the newest n of a set are among the newest n
of its substrings, so each substring is cut to its newest n before sets are
formed. Commands go by number (``numbered``: newest first), not by hash: eight bytes name
one in the index, the postings and the candidates, and the hash comes back with
the text. Local tiers are restricted to the (set, directory) pairs that some query
asks for. Joins carry no broadcast hints: Spark plans them from measured sizes
and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import byte_view, raw_bytes
from ..functions.ngrams import distinct_trigram_strings, pack_gram, trigrams
from ..schema import HITS_COLUMNS
from .filters import scope
from .search import normalize_limit
from .squelch import squelch
from .util import materialize


def build_index(history: DataFrame, text_col: str = "cmd", key_col: str = "hash",
                keep: tuple[str, ...] | None = None) -> DataFrame:
    """(ngram int, key) for every distinct byte trigram of every row.

    Windows are extracted and de-duplicated per row in one native pass, then
    exploded; only (window, key) rows leave the generator -- the text column
    is not carried -- and the int packing runs in whole-stage codegen.
    """
    cols = list(keep) if keep else [key_col]
    rows = history.select(*dict.fromkeys([*cols, text_col]))
    windows = rows.select(*cols, F.explode(distinct_trigram_strings(F.col(text_col))).alias("_g"))
    return windows.select(pack_gram("_g").alias("ngram"), *cols)


def numbered(history: DataFrame) -> DataFrame:
    """History with a number ``seq`` per row, newest first (ties by hash), written once.

    The numbers rise with (ts_ms desc, hash) and have gaps: rows are sorted into ranges and a
    range's rows are counted where they lie, so one exchange and no window does it. An index
    keyed by ``seq`` takes 8 bytes per row where the hash takes 64.
    """
    order = [F.col("ts_ms").desc(), F.col("hash").asc()]
    rows = history.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.withColumn("seq", F.monotonically_increasing_id()), "numbered")


def gram_doc_freq(index: DataFrame, key_col: str = "hash") -> DataFrame:
    """Number of rows (documents / commands) containing each trigram."""
    return index.groupBy("ngram").agg(F.count(key_col).alias("doc_freq"))


def short_gram_index(history: DataFrame, keep: tuple[str, ...] = ("hash",)) -> DataFrame:
    """(sgram, *keep): every distinct 1- and 2-byte substring of ``cmd``
    (Latin-1 byte strings), from two native regex passes per row."""
    lat = byte_view("cmd")
    ones = F.regexp_extract_all(lat, F.lit("(?s)(.)"), 1)
    twos = F.regexp_extract_all(lat, F.lit("(?s)(?=(..))"), 1)
    grams = F.array_distinct(F.concat(ones, twos))
    return history.select(F.explode(grams).alias("sgram"), *keep)


def _top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Exact top-n rows per group. ``row_number() <= n`` is planned as a partial
    WindowGroupLimit before the shuffle, so a group holding a third of all rows
    sends at most n rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _query_keys(queries: DataFrame) -> DataFrame:
    """qid, qcwd plus the query's trigram set and 1-2 byte keyword set, each with
    a 128-bit digest as key (queries sharing keywords share the work); an empty
    set has an empty key."""
    kws = F.filter(F.col("keywords"), lambda k: k.isNotNull())
    long_kws = F.filter(kws, lambda k: F.octet_length(k) > 2)
    grams = F.array_sort(F.array_distinct(F.flatten(F.transform(long_kws, lambda k: trigrams(k)))))
    short_kws = F.filter(kws, lambda k: (F.octet_length(k) >= 1) & (F.octet_length(k) <= 2))
    shorts = F.array_sort(F.array_distinct(F.transform(short_kws, lambda k: byte_view(k))))
    q = queries.select("qid", F.coalesce(F.col("cwd"), F.lit("")).alias("qcwd"),
                       grams.alias("_grams"), shorts.alias("_shorts"))

    def digest(items: Column) -> Column:
        return F.when(F.size(items) > 0, F.md5(F.array_join(items, ","))).otherwise(F.lit(""))

    return q.select(
        "qid", "qcwd", "_grams", "_shorts",
        digest(F.transform("_grams", lambda g: g.cast("string"))).alias("gk"),
        digest(F.transform("_shorts", lambda x: F.hex(F.encode(x, "ISO-8859-1")))).alias("sk"))


# Newest postings of a trigram, and of a pair of trigrams, that give the first bound, as multiples of the limit.
FIRST_POSTINGS = 4
FIRST_OF_PAIR = 16
# A set is met by the pairs of its rarest trigrams if this many of them are enough, else by single trigrams.
PAIRED = 4

def _newest() -> list[Column]:
    return [F.col("ts_ms").desc(), F.col("hash").asc()]


def asked_postings(index: DataFrame, sets: DataFrame, places: DataFrame) -> DataFrame:
    """(place, ngram, hash, ts_ms, _has): the index's postings of the asked trigrams, for each place
    ('' stands for everywhere) where a set asks for them, with all asked trigrams of the command; written once."""
    # the trigrams meet the index before the history does; a command's leave as one row
    commands = (index.join(sets.select("ngram").distinct(), "ngram").groupBy("hash").agg(F.collect_set("ngram").alias("_has"))
                .join(places, "hash"))
    here = commands.select(F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("cwd", F.lit(""))))).alias("place"), "hash", "ts_ms", "_has")
    rows = here.select("place", F.explode("_has").alias("ngram"), "hash", "ts_ms", "_has")
    return materialize(rows.join(sets.select("place", "ngram").distinct(), ["place", "ngram"], "left_semi"), "postings")


def _by_rarity(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """(gk, place, _by): each set's trigrams that occur at all, rarest first."""
    freq = postings.groupBy("place", "ngram").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.array_sort(F.collect_set(F.struct("df", "ngram")))
    return (sets.join(freq, ["place", "ngram"]).groupBy("gk", "place").agg(rarest.alias("_r"))
            .select("gk", "place", F.col("_r.ngram").alias("_by")))


def _paired(sets: DataFrame, upto: Column) -> DataFrame:
    """``sets`` with every pair (ga, gb) of a set's ``upto`` rarest trigrams, ga the rarer."""
    heads = F.slice("_by", F.lit(1), upto)
    pairs = F.flatten(F.transform(heads, lambda a, i: F.transform(
        F.slice("_by", i + 2, F.greatest(upto - i - 1, F.lit(0))), lambda b: F.struct(a.alias("ga"), b.alias("gb")))))
    return sets.withColumn("_p", F.explode(pairs)).select("*", "_p.ga", "_p.gb").drop("_p")


def _pair_postings(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(place, ga, gb, hash, ts_ms, _has) of the commands that hold both trigrams of an asked pair."""
    partners = pairs.select("place", "ga", "gb").groupBy("place", "ga").agg(F.collect_set("gb").alias("_gb"))
    met = postings.withColumnRenamed("ngram", "ga").join(partners, ["place", "ga"])
    return met.select("place", "ga", F.explode(F.array_intersect("_has", "_gb")).alias("gb"), "hash", "ts_ms", "_has")


def _rank() -> Column:
    return F.size(F.array_intersect("_has", "_by")).cast("bigint").alias("rank")


_RANKED = ["gk", "place", "hash", "ts_ms", "rank"]


def _best(rows: DataFrame, n: int) -> DataFrame:
    """The best n commands of each set. A command met by several pairs comes as equal rows, which share a
    place in the order: each task cuts its rows to n commands before the exchange, and repeats go after it."""
    w = Window.partitionBy("gk", "place").orderBy(F.col("rank").desc(), *_newest())
    top = rows.select(*_RANKED).withColumn("_rn", F.dense_rank().over(w)).filter(F.col("_rn") <= n)
    return top.select(*_RANKED).distinct()


def _of_pairs(postings: DataFrame, sets: DataFrame, upto: int, newest: int, n: int) -> DataFrame:
    """The best n of each set among the newest commands that hold two of its ``upto`` rarest trigrams."""
    pairs = _paired(sets, F.least(F.size("_by"), F.lit(upto)))
    rows = _top_per_group(_pair_postings(postings, pairs), ["place", "ga", "gb"], _newest(), newest)
    met = rows.join(pairs, ["place", "ga", "gb"]).select("gk", "place", "hash", "ts_ms", _rank())
    return materialize(_best(met, n), "of-pairs")


def first_candidates(postings: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(gk, place, hash, ts_ms, rank): n commands of each set, or all that share a trigram with it, if these are fewer.

    They are the best among the newest that hold a set's two rarest trigrams; unless n of these hold all its
    trigrams, among those that hold two of its rarest; where these are fewer than n, of each trigram as well.
    """
    keys = ["gk", "place"]
    sets = materialize(_by_rarity(postings, sets), "sets")
    rare = _of_pairs(postings, sets, 2, FIRST_OF_PAIR * n, n)

    def state(found: DataFrame) -> DataFrame:
        return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_low"))
    unsure = sets.join(state(rare), keys, "left").filter((F.coalesce("_n", F.lit(0)) < n) | (F.col("_low") < F.size("_by"))).select(*keys, "_by")
    unsure = materialize(unsure, "unsure")
    more = _of_pairs(postings, unsure, PAIRED, FIRST_POSTINGS * n, n)
    few = unsure.join(state(more).filter(F.col("_n") >= n), keys, "left_anti")
    newest = _top_per_group(postings, ["place", "ngram"], _newest(), FIRST_POSTINGS * n)
    single = (newest.join(few.withColumn("ngram", F.explode("_by")), ["place", "ngram"])
              .select("gk", "place", "hash", "ts_ms", _rank()))
    rest = rare.join(unsure.select(*keys), keys, "left_semi").unionByName(more).unionByName(single)
    return rare.join(unsure.select(*keys), keys, "left_anti").select(*_RANKED).unionByName(_best(rest, n))


def further_candidates(postings: DataFrame, sets: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """(gk, place, hash, ts_ms, rank): commands outside ``first`` that reach a set's n-th best rank.

    ``first`` (ranked): gk, place, hash, ts_ms, rank. A set with fewer than n of them has no others:
    a trigram with n postings gives n commands.
    """
    order = Window.partitionBy("gk", "place").orderBy(F.col("rank").desc(), *_newest())
    bound = first.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == n).select(
        "gk", "place", F.col("rank").alias("bound"), F.col("ts_ms").alias("since"))
    m = F.size("_by")
    bounded = _by_rarity(postings, sets).join(bound, ["gk", "place"]).withColumn("_upto", (m - F.col("bound") + 2).cast("int"))
    by_pair = (F.col("bound") >= 2) & (F.col("_upto") <= PAIRED)
    pairs = _paired(bounded.filter(by_pair), F.col("_upto"))
    alone = bounded.filter(~by_pair).select(
        "*", F.posexplode(F.slice("_by", F.lit(1), F.least(m, F.col("_upto") - 1))).alias("_at", "ngram"))
    # ranks are taken where the rows meet: only those that reach the bound leave
    reaches = (F.col("rank") > F.col("bound")) | ((F.col("rank") == F.col("bound")) & (F.col("ts_ms") >= F.col("since")))
    recent = (F.col("bound") < m) | (F.col("ts_ms") >= F.col("since"))
    met = (_pair_postings(postings, pairs).join(pairs, ["place", "ga", "gb"]).filter(recent)
           .select("gk", "place", "hash", "ts_ms", "bound", "since", _rank())
           .unionByName(postings.join(alone, ["place", "ngram"]).select("gk", "place", "hash", "ts_ms", "bound", "since", _rank())))
    return (met.filter(reaches).select(*_RANKED).distinct()
            .join(first.select("gk", "place", "hash"), ["gk", "place", "hash"], "left_anti").select(*_RANKED))


def ranked_top(index: DataFrame, places: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Exact top n commands per (set, place) by rank, then newest, then hash.

    ``sets``: gk, place, ngram, one row per trigram; ``places``: hash, cwd, ts_ms.
    Result: gk, place, hash, ts_ms, rank.
    """
    sets = materialize(sets.distinct(), "asked-trigrams")
    postings = asked_postings(index, sets, places)
    first = materialize(first_candidates(postings, sets, n), "first-candidates")
    return _best(first.unionByName(further_candidates(postings, sets, first, n)), n)


def batch_search(history: DataFrame, queries: DataFrame, limit: int | None = 5,
                 source: str | None = "user", index: DataFrame | None = None,
                 annotations: DataFrame | None = None, squelch_patterns=None) -> DataFrame:
    """Run many keyword queries at once with the single-query tier rules.

    ``queries``: qid, keywords array<string>, cwd string ('' or NULL = global).
    Output: qid + hit columns + is_global, rank, pos (1-based per query).

    Only each tier's top ``limit`` rows can be returned, so candidates are
    the exact top-``limit`` per keyword set (global tiers) and per keyword set
    and directory (local tiers), computed once per distinct keyword set and
    joined to the queries that use it.

    ``index``: (ngram, seq) of a history that has been ``numbered``, or (ngram, hash) of any.
    """
    n = normalize_limit(limit)
    by_seq = index is None or "seq" in index.columns
    if index is not None and by_seq and "seq" not in history.columns:
        raise ValueError("an index by seq needs the numbered history it was built from")
    # the keyed query table feeds six branches: written once, read six times
    q = materialize(_query_keys(queries), "batch-queries")
    qk = q.select("qid", "qcwd", "gk", "sk")
    local_q = qk.filter(F.col("qcwd") != "")
    hist = scope(history, source=source)
    hist = (hist if "seq" in hist.columns else numbered(hist)).select("seq", "hash", "cmd", "cwd", "ts_ms", "source")
    # the number stands for the hash up to the last join: it has the same order among equal times
    places = hist.select(F.col("seq").alias("hash"), "cwd", "ts_ms")

    # rank = distinct query trigrams present, once per distinct trigram set, everywhere and in the asked directories
    asked = q.filter(F.col("gk") != "").select(
        "gk", "_grams", F.explode(F.array_distinct(F.array(F.lit(""), "qcwd"))).alias("place"))
    in_sets = asked.select("gk", "place", F.explode("_grams").alias("ngram"))
    idx = build_index(hist, key_col="seq") if index is None else index
    if not by_seq:
        idx = idx.join(in_sets.select("ngram").distinct(), "ngram", "left_semi").join(hist.select("hash", "seq"), "hash")
    idx = idx.select("ngram", F.col("seq").alias("hash"))
    best = materialize(ranked_top(idx, places, in_sets, n).withColumnRenamed("hash", "seq"), "ranked-top")
    t3 = best.filter(F.col("place") == "").select("gk", "seq", "rank")
    t1 = best.filter(F.col("place") != "").select("gk", F.col("place").alias("cwd"), "seq", "rank")

    # substring hits of 1-2 byte keywords: cut per substring, then per distinct set
    ssets = q.filter(F.col("sk") != "").select("sk", F.explode("_shorts").alias("sgram")).distinct()
    sidx = short_gram_index(hist, keep=("seq", "cwd")).join(
        ssets.select("sgram").distinct(), "sgram", "left_semi")
    sorder = [F.col("seq").asc()]
    newest = _top_per_group(sidx, ["sgram"], sorder, n).select("sgram", "seq")
    t4 = _top_per_group(newest.join(ssets, "sgram").select("sk", "seq").distinct(), ["sk"], sorder, n)
    asked_s = (local_q.filter(F.col("sk") != "").select("sk", F.col("qcwd").alias("cwd")).distinct()
               .join(ssets, "sk"))
    near = _top_per_group(sidx.join(asked_s.select("sgram", "cwd").distinct(), ["sgram", "cwd"], "left_semi"),
                          ["sgram", "cwd"], sorder, n)
    t2 = _top_per_group(near.join(asked_s, ["sgram", "cwd"]).select("sk", "cwd", "seq").distinct(),
                        ["sk", "cwd"], sorder, n)

    c1 = local_q.join(t1.withColumnRenamed("cwd", "qcwd"), ["gk", "qcwd"]).select(
        "qid", "qcwd", "seq", "rank", F.lit(1).alias("tier"))
    c2 = local_q.join(t2.withColumnRenamed("cwd", "qcwd"), ["sk", "qcwd"]).select(
        "qid", "qcwd", "seq", F.lit(0).cast("long").alias("rank"), F.lit(2).alias("tier"))
    c3 = qk.join(t3, "gk").select("qid", "qcwd", "seq", "rank", F.lit(3).alias("tier"))
    c4 = qk.join(t4, "sk").select(
        "qid", "qcwd", "seq", F.lit(0).cast("long").alias("rank"), F.lit(4).alias("tier"))
    cand = (c1.unionByName(c2).unionByName(c3).unionByName(c4)
            .groupBy("qid", "qcwd", "seq").agg(F.min("tier").alias("tier"), F.max("rank").alias("rank")))

    # at most 4 x limit candidates per query get the history's text
    rows = cand.join(hist, "seq")
    scored = rows.withColumn(
        "rank_key", F.when(F.col("tier").isin(1, 3), F.col("rank")).otherwise(F.lit(0)))
    per_q = Window.partitionBy("qid")
    top = _top_per_group(scored, ["qid"], [F.col("tier").asc(), F.col("rank_key").desc(),
                                           F.col("ts_ms").desc(), F.col("hash").asc()], n)
    top = top.withColumn("_best", F.min("tier").over(per_q)).filter(F.col("tier") == F.col("_best"))
    if annotations is not None:
        ann = annotations.select("hash", F.col("type").alias("_atype"))
        top = top.join(ann, "hash", "left").withColumn(
            "annotation_type", F.coalesce(F.col("_atype"), F.lit(0)))
    else:
        top = top.withColumn("annotation_type", F.lit(0))
    top = squelch(top, squelch_patterns)
    top = top.withColumn("is_global", (F.col("qcwd") != "") & (F.col("tier") >= 3))
    top = top.withColumn("cwd", F.when((F.col("qcwd") != "") & ~F.col("is_global"), F.lit(""))
                         .otherwise(F.col("cwd")))
    pos = F.row_number().over(per_q.orderBy(F.col("rank_key").desc(), F.col("ts_ms").desc(),
                                            F.col("hash").asc()))
    return top.withColumn("pos", pos).select(
        "qid", *HITS_COLUMNS, "is_global", F.col("rank_key").cast("int").alias("rank"), "pos")
