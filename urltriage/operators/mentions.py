"""Similarity join of strings and brand mentions in texts."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from urltriage.functions.similarity import (
    jaro_winkler,
    levenshtein_similarity,
    may_reach_jaro_winkler,
    required_jaro,
)
from urltriage.functions.text import NOT_WORD, WORD
from urltriage.session import shared_folder

# Letters from rare to frequent; any order is correct, this one keeps keys rare.
_RARE_FIRST = "zqjxkvbpygfwmucldrhsnioate"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000
# Keyed rows of the shorter list that are sent to all tasks at most; a value of
# 8 characters has some 50 keys, one of 60 characters some 10,000.
BROADCAST_KEYS = 500_000
# Lists up to this length become literals that are compared with every value or text.
LITERALS = 32


def _need(own: Column, other: Column, min_jw: float, min_lev: float | None) -> Column:
    """Least number of shared characters of a qualifying pair of these lengths."""
    c = 3.0 * required_jaro(min_jw) - 1.0
    bound = F.lit(c) * own * other / (own + other)
    if min_lev is not None:
        bound = F.least(bound, F.lit(min_lev) * F.greatest(own, other))
    return F.floor(bound - F.lit(1e-9)).cast("int") + 1


def _keyed(
    values: DataFrame,
    name: str,
    own: str,
    other: str,
    partner_lengths: list[int],
    min_jw: float,
    min_lev: float | None,
    max_len_diff: int | None,
) -> DataFrame:
    """Rows (value, own length, partner length, key) under which values can meet.

    Both strings are read as multisets of characters in one fixed order.  If
    they share at least n characters, their first (length - n + 2) characters
    share at least two, so a common pair of those is a complete join key: no
    qualifying pair is missed, and strings that merely have similar lengths do
    not meet.
    """
    renamed = F.call_function("translate", F.col(name), F.lit(_RARE_FIRST), F.lit(_ALPHABET))
    gap = F.abs(F.col(own) - F.col(other))
    near = F.lit(True) if max_len_diff is None else gap <= max_len_diff
    need = _need(F.col(own), F.col(other), min_jw, min_lev)
    sized = (
        values.withColumns({own: F.length(name), "_c": F.array_sort(F.split(renamed, ""))})
        .withColumn(
            # Repeated characters are told apart by their occurrence number.  A
            # hash clash would only add a candidate, and candidates are verified.
            "_t",
            F.transform(
                "_c",
                lambda ch, i: F.xxhash64(ch, i - F.array_position("_c", ch)),
            ),
        )
        .withColumn(other, F.explode(F.array(*[F.lit(n) for n in partner_lengths])))
        .withColumn("_n", need)
        .filter(near & (F.col("_n") <= F.least(own, other)))
        .withColumn("_p", F.slice("_t", F.lit(1), F.col(own) - F.col("_n") + F.least("_n", F.lit(2))))
    )
    pairs = F.flatten(
        F.transform(
            "_p",
            lambda x, i: F.transform(
                F.slice("_p", i + 2, F.size("_p")), lambda y: F.shiftleft(x, 1).bitwiseXOR(y)
            ),
        )
    )
    keys = F.when(F.col("_n") == 1, F.col("_p")).otherwise(pairs)
    return sized.select(name, own, other, F.explode(keys).alias("_k"))


def _lengths(values: DataFrame, name: str) -> dict[int, int]:
    """Rows per string length: a handful of numbers whatever the row count."""
    rows = values.groupBy(F.length(name).alias("n")).count().collect()
    return {r["n"]: r["count"] for r in rows}


def _reach(lengths: list[int], min_jw: float, min_lev: float | None = None) -> tuple[int, int] | None:
    """Lengths of strings that can meet one of these lengths at all; None: any."""
    shrink = 3.0 * required_jaro(min_jw) - 2.0
    shrink = shrink if min_lev is None else min(shrink, min_lev)
    if shrink <= 0:
        return None
    return int(min(lengths) * shrink), int(max(lengths) / shrink) + 1


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    min_jw: float,
    min_lev: float | None = None,
    max_len_diff: int | None = None,
) -> DataFrame:
    """Pairs with Jaro-Winkler > ``min_jw`` or Levenshtein similarity > ``min_lev``.

    Uses the first column of each side, on distinct values; the right side is
    the shorter list (its lengths and size are read first).  It is an exact
    equi-join on character signatures (no cross join, no cap), followed by a
    cheap bound and then the distances.  A short right side is broadcast; else
    Spark joins by shuffle.  Up to ``LITERALS`` values cost less than the
    signatures: the bound meets each of them.  Returns both values, ``jw``, ``lev``.
    """
    lname, rname = left.columns[0], right.columns[0]

    def distinct_values(df: DataFrame, name: str) -> DataFrame:
        return df.select(name).filter(F.length(name) > 0).distinct()

    bounds = (min_jw, min_lev, max_len_diff)
    lefts, rights = distinct_values(left, lname), distinct_values(right, rname)
    by_length = _lengths(rights, rname)
    right_lengths = sorted(by_length) or [0]
    reach = _reach(right_lengths, min_jw, min_lev)
    if reach is not None:
        lefts = lefts.filter(F.length(lname).between(*reach))
        left_lengths = list(range(max(reach[0], 1), reach[1] + 1))
    else:
        left_lengths = sorted(_lengths(lefts, lname)) or [0]
    # The work is heavy per row and the values are few bytes, so adaptive
    # execution would merge them into too few tasks.
    lefts = lefts.repartition(_tasks(left))
    if sum(by_length.values()) <= LITERALS:
        listed = F.array(*[F.lit(r[rname]) for r in rights.collect()]).cast("array<string>")
        pairs = lefts.withColumn(rname, F.explode(listed))
        if max_len_diff is not None:
            pairs = pairs.filter(F.abs(F.length(lname) - F.length(rname)) <= max_len_diff)
    else:
        keyed_left = _keyed(lefts, lname, "_ll", "_lr", right_lengths, *bounds)
        keyed_right = _keyed(rights, rname, "_lr", "_ll", left_lengths, *bounds)
        if keyed_right.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            keyed_right = F.broadcast(keyed_right)
        pairs = keyed_left.join(keyed_right, ["_ll", "_lr", "_k"])
    a, b = f"`{lname}`", f"`{rname}`"
    plausible = may_reach_jaro_winkler(a, b, min_jw)
    if min_lev is not None:
        plausible = f"{plausible} OR {levenshtein_similarity(a, b)} > {min_lev}D"
    # Scored where the pair is found, in parallel; a pair can meet under several
    # keys, so the few that qualify are made distinct at the end.
    scored = pairs.filter(plausible).selectExpr(
        a, b, f"{jaro_winkler(a, b)} AS jw", f"{levenshtein_similarity(a, b)} AS lev"
    )
    wanted = F.col("jw") > min_jw
    if min_lev is not None:
        wanted = wanted | (F.col("lev") > min_lev)
    return scored.filter(wanted).distinct()


def _brand_forms(brands: DataFrame) -> DataFrame:
    """Shape of each brand: words in it, and non-word characters at its ends."""
    b = F.col("brand")
    return brands.withColumns(
        {
            "_words": F.regexp_count(b, F.lit(f"{WORD}+")),
            "_lead": b.rlike(f"^{NOT_WORD}"),
            "_trail": b.rlike(f"{NOT_WORD}$"),
        }
    ).filter(F.col("_words") > 0)


def _apart(positions: Column, size: Column) -> Column:
    """Number of runs of ``size`` words at sorted word positions, without overlapping ones."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-(2**30)).alias("end"))

    def step(state: Column, at: Column) -> Column:
        free = at >= state["end"]
        return F.struct(
            (state["n"] + free.cast("int")).alias("n"),
            F.when(free, (at + size).cast("int")).otherwise(state["end"]).alias("end"),
        )

    return F.aggregate(positions, start, step)["n"]


def _form_pattern(words: int, lead: bool, trail: bool) -> str:
    """Zero-width pattern whose group 1 is every text run of that shape."""
    body = f"{WORD}+(?:{NOT_WORD}+{WORD}+){{{words - 1}}}"
    if lead:
        return f"(?<={WORD})(?=({NOT_WORD}+{body}{NOT_WORD}+)(?={WORD}))" if trail else (
            f"(?<={WORD})(?=({NOT_WORD}+{body})(?!{WORD}))"
        )
    start = f"(?<!{WORD})"
    if trail:
        return f"{start}(?=({body}{NOT_WORD}+)(?={WORD}))"
    return f"{start}(?=({body})(?!{WORD}))"


def _holds_run(low: Column, forms: list[Row]) -> Column:
    """False only for lower-case texts that have none of these brands as whole words."""

    def one(form: Row) -> Column:
        brand = re.escape(form["brand"])
        # The brand goes first in the pattern: a plain search, which most texts end with.
        start = "" if form["_lead"] else f"(?<!{WORD}{brand})"
        end = "" if form["_trail"] else f"(?!{WORD})"
        return F.contains(low, F.lit(form["brand"])) & low.rlike(f"{brand}{end}{start}")

    return functools.reduce(operator.or_, map(one, forms))


def brand_mentions(
    texts: DataFrame,
    brands: DataFrame,
    id_col: str,
    text_col: str,
    min_jw: float = 0.9,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Exact plus fuzzy mentions per (text, brand); pairs without one are absent.

    The count is the number of whole-word occurrences of the brand plus the
    number of words more similar than ``min_jw`` (an exact word counts twice).
    ``fuzzy_matches`` lists those words in text order.

    Similarity runs once per distinct word of the corpus.  The words that match
    some brand are few; they are written out, counted, and broadcast only if
    the count allows, so that the words of the texts are not shuffled.
    """
    spark = texts.sparkSession
    low = F.col("_low")
    lowered = texts.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    words = F.regexp_extract_all(low, F.lit(f"{WORD}+"), F.lit(0))
    names = brands.select(F.lower("brand").alias("brand")).filter(F.col("brand") != "").distinct()

    # Words too short or too long for any brand are left out by the join.
    vocabulary = lowered.select(F.explode(F.array_distinct(words)).alias("term"))
    fuzzy = similar_pairs(vocabulary, names, min_jw).select(
        "term", "brand", F.lit(0).alias("exact"), F.lit(1).alias("fuzzy")
    )
    exact = names.select(
        F.col("brand").alias("term"), "brand", F.lit(1).alias("exact"), F.lit(0).alias("fuzzy")
    )
    lookup = (
        fuzzy.unionByName(exact)
        .groupBy("term", "brand")
        .agg(F.max("exact").alias("exact"), F.max("fuzzy").alias("fuzzy"))
    )
    folder = shared_folder(spark, "brand-terms")
    lookup.write.parquet(folder)
    lookup = spark.read.schema("term string, brand string, exact int, fuzzy int").parquet(folder)
    sizes = lookup.agg(F.count(F.lit(1)), F.min(F.length("term")), F.max(F.length("term"))).first()
    lookup = lookup.withColumn("_size", F.regexp_count("brand", F.lit(f"{WORD}+")))
    if sizes[0] <= broadcast_rows:
        lookup = F.broadcast(lookup)

    # Brands of several words, or with punctuation at an end, need text runs of
    # their shape besides the single words.  Shapes are few by nature.
    forms = _brand_forms(names).filter((F.col("_words") > 1) | F.col("_lead") | F.col("_trail"))
    shapes = forms.select("_words", "_lead", "_trail").distinct().collect()
    runs = [
        F.regexp_extract_all(low, F.lit(_form_pattern(s["_words"], s["_lead"], s["_trail"])), F.lit(1))
        for s in shapes
    ]
    if runs:
        # Making runs is heavy per text; few texts have one of a short list of brands.
        listed = forms.limit(LITERALS + 1).collect()
        every = F.concat(words, *runs)
        words = every if len(listed) > LITERALS else F.when(_holds_run(low, listed), every).otherwise(words)
    # Positions are taken before the words of other lengths are left out.
    terms = lowered.select(id_col, F.posexplode(words).alias("_pos", "term")).filter(
        F.length("term").between(sizes[1] or 0, sizes[2] or 0)
    )
    found = terms.join(lookup, "term")
    exact_one = (F.col("exact") == 1) & (F.col("_size") == 1)
    exact_run = (F.col("exact") == 1) & (F.col("_size") > 1)
    runs_at = F.array_sort(F.collect_list(F.when(exact_run, F.col("_pos"))))
    return (
        found.groupBy(id_col, "brand")
        .agg(
            (
                F.sum(exact_one.cast("int") + F.col("fuzzy"))
                + _apart(runs_at, F.max("_size"))
            ).alias("mentions"),
            F.array_sort(
                F.collect_list(F.when(F.col("fuzzy") == 1, F.struct("_pos", "term")))
            ).alias("_f"),
        )
        .select(
            id_col,
            "brand",
            (F.col("mentions") > 0).alias("present"),
            "mentions",
            F.transform("_f", lambda x: x["term"]).alias("fuzzy_matches"),
        )
    )
