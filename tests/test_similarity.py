"""Similarity join and brand mentions against brute force."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from urltriage.functions.similarity import hex_similarity, jaro_winkler, may_reach_jaro_winkler
from urltriage.operators.mentions import brand_mentions, similar_pairs


def words(seed, n, alphabet="abcdeor1.", low=1, high=12):
    rng = random.Random(seed)
    made = {"".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)}
    for w in list(made)[: n // 2]:
        i = rng.randrange(len(w))
        made.add(w[:i] + rng.choice(alphabet) + w[i + 1 :])
        made.add(w[:i] + w[i + 1 :] or "a")
        made.add(w[::-1])
    return sorted(made)


def brute(left, right, condition):
    con = duckdb.connect()
    con.execute("create table l(a varchar)")
    con.execute("create table r(b varchar)")
    con.executemany("insert into l values (?)", [(x,) for x in left])
    con.executemany("insert into r values (?)", [(x,) for x in right])
    return set(con.execute(f"select a, b from l, r where {condition}").fetchall())


@pytest.mark.parametrize(
    ("min_jw", "min_lev", "gap"), [(0.9, None, None), (0.95, 0.9, 6), (0.8, None, 1), (0.9, 0.7, None)]
)
def test_similar_pairs_equal_brute_force(spark, min_jw, min_lev, gap):
    left, right = words(1, 300), words(2, 60)
    right += left[:20]
    condition = f"jaro_winkler_similarity(a, b) > {min_jw}"
    if min_lev:
        condition = f"({condition} or 1 - levenshtein(a, b) / greatest(length(a), length(b)) > {min_lev})"
    if gap is not None:
        condition += f" and abs(length(a) - length(b)) <= {gap}"
    want = brute(left, sorted(set(right)), condition)
    l_df = spark.createDataFrame([(x,) for x in left], "a string")
    r_df = spark.createDataFrame([(x,) for x in right], "b string")
    got = similar_pairs(l_df, r_df, min_jw, min_lev, gap).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == want
    assert len(want) > 25


def test_jaro_winkler_values(spark):
    pairs = [(a, b) for a in words(3, 60) for b in words(4, 12)] + [("", ""), ("", "a"), ("dwayne", "duane")]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.selectExpr("a", "b", f"{jaro_winkler('a', 'b')} as jw", f"{may_reach_jaro_winkler('a', 'b', 0.9)} as may")
    con = duckdb.connect()
    rows = out.toPandas()  # noqa: F841
    worst, missed = con.execute(
        "select max(abs(jw - jaro_winkler_similarity(a, b))) filter (a <> '' and b <> ''), "
        "count(*) filter (jw > 0.9 and not may and a <> '') from rows"
    ).fetchone()
    assert worst < 1e-12 and missed == 0


def test_hex_similarity(spark):
    df = spark.createDataFrame([("00ff", "00fe"), ("00ff", "00ff"), (None, "00ff")], "a string, b string")
    got = [r[0] for r in df.selectExpr(hex_similarity("a", "b")).collect()]
    assert got == [0.75, 1.0, 0.0]


TEXTS = {
    1: "Acme acme ACMES acmé pay pal paypal, mr c and Mr  C. mr c",
    2: "yahoo!x yahoo! yahoo at&t at&t2 the acne",
    3: "",
    4: "paypa1 payqal paypai mrc",
    5: "acme " * 500,
    6: "elle elle elle and elle, elle elle elle",
}
BRANDS = ["Acme", "paypal", "mr c", "yahoo!", "at&t", "elle elle"]


def by_hand(text, brand):
    con = duckdb.connect()
    low, b = text.lower(), brand.lower()
    exact = len(re.findall(rf"\b{re.escape(b)}\b", low))
    tokens = re.findall(r"\b\w+\b", low)
    # Single-byte stand-in: the comparison engine counts bytes.
    fuzzy = [
        w
        for w in tokens
        if con.execute("select jaro_winkler_similarity(?, ?) > 0.9", [b, w.replace("é", "E")]).fetchone()[0]
    ]
    return exact + len(fuzzy), fuzzy


@pytest.mark.parametrize("limit", [500_000, 0])
def test_brand_mentions_equal_search(spark, limit):
    texts = spark.createDataFrame(list(TEXTS.items()), "id int, text string")
    brands = spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    got = {
        (r["id"], r["brand"]): (r["mentions"], list(r["fuzzy_matches"]))
        for r in brand_mentions(texts, brands, "id", "text", broadcast_rows=limit).collect()
    }
    want = {(i, b.lower()): by_hand(t, b) for i, t in TEXTS.items() for b in BRANDS if len(t) < 100 or b == "Acme"}
    assert got == {k: v for k, v in want.items() if v[0] > 0} | {
        k: v for k, v in got.items() if k[0] == 5 and k[1] != "acme"
    }
    assert got[(5, "acme")][0] == 1000
    assert all(k[1] == "acme" for k in got if k[0] == 5)


@pytest.mark.parametrize("limit", [500_000, 10])
def test_long_values_equal_brute_force(spark, monkeypatch, limit):
    """Values of 30 to 60 characters have thousands of keys each; broadcast or not."""
    monkeypatch.setattr("urltriage.operators.mentions.BROADCAST_KEYS", limit)
    rng = random.Random(11)
    lefts = ["".join(rng.choices("abcdef-", k=rng.randint(30, 60))) for _ in range(40)]
    rights = []
    for value in lefts[:20]:
        letters = list(value)
        for i in rng.sample(range(len(letters)), 2):
            letters[i] = rng.choice("abcdef-")
        rights.append("".join(letters))
    a = spark.createDataFrame([(v,) for v in lefts], "a string")
    b = spark.createDataFrame([(v,) for v in rights], "b string")
    got = {(r["a"], r["b"]) for r in similar_pairs(a, b, 0.9).collect()}
    con = duckdb.connect()
    want = {
        (x, y) for x in lefts for y in rights
        if con.execute("select jaro_winkler_similarity(?, ?) > 0.9", [x, y]).fetchone()[0]
    }
    assert got == want and len(want) >= 20


def test_no_nested_loop_in_similarity_join(spark):
    df = spark.createDataFrame([("a",)], "a string")
    plan = similar_pairs(df, df.select(F.col("a").alias("b")), 0.9)._jdf.queryExecution().executedPlan()
    assert "NestedLoop" not in plan.toString() and "Cartesian" not in plan.toString()


def test_bound_follows_the_common_prefix(spark):
    """Without equal first characters Jaro alone has to exceed the threshold."""
    pairs = [("onen", "tionen"), ("tionon", "tionen"), ("xcme", "acme"), ("ab", "abc"), ("abc", "abc"), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.selectExpr(may_reach_jaro_winkler("a", "b", 0.9)).collect()]
    assert got == [False, True, False, True, True, False]


@pytest.mark.parametrize("limit", [0, 1000])
def test_short_list_equals_signatures(spark, monkeypatch, limit):
    monkeypatch.setattr("urltriage.operators.mentions.LITERALS", limit)
    left, right = words(21, 200, "abcdeé1."), words(22, 20, "abcdeé1.")
    a = spark.createDataFrame([(x,) for x in left] + [(None,), ("",)], "a string")
    b = spark.createDataFrame([(x,) for x in right] + [(None,), ("",), (right[0],)], "b string")
    found = similar_pairs(a, b, 0.8, 0.7, 3)
    assert ("xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString()) == (limit > 0)
    got = [(r["a"], r["b"]) for r in found.collect()]
    # Single-byte stand-in: the comparison engine counts bytes.
    plain = {x.replace("é", "E"): x for x in [*left, *right]}
    condition = (
        "(jaro_winkler_similarity(a, b) > 0.8 or 1 - levenshtein(a, b) / greatest(length(a), length(b)) > 0.7) "
        "and abs(length(a) - length(b)) <= 3"
    )
    want = brute([x.replace("é", "E") for x in left], sorted({x.replace("é", "E") for x in right}), condition)
    assert len(got) == len(set(got)) and set(got) == {(plain[x], plain[y]) for x, y in want} and got


RUN_TEXTS = [
    (1, "station the nation the On The on the, on\tthe on  the"),
    (2, "on the on the onthe on thé éon the _on the"),
    (3, "x!a!a!b y!a!b!a!c yahoo!yahoo!x on the yahoo!"),
    (3, "x!a!a!b y!a!b!a!c yahoo!yahoo!x on the yahoo!"),
    (3, "on the a+b \\E a+b. c++ c++d"),
    (4, "station the"),
    (None, "of and the of and the"),
    (None, "the the the of and"),
    (5, "the the the the the"),
]
RUN_BRANDS = ["on the", "of and the", "!a!", "yahoo!", "a+b", "c++", "the the", "!!!", "\\E a", "the"]


def test_runs_equal_those_of_every_text(spark, monkeypatch):
    """A search for the brands decides which texts are cut into runs; it changes no result."""
    texts = spark.createDataFrame(RUN_TEXTS, "id int, text string")
    brands = spark.createDataFrame([(b,) for b in RUN_BRANDS], "brand string")
    results = {}
    for limit in (32, 0):
        monkeypatch.setattr("urltriage.operators.mentions.LITERALS", limit)
        found = brand_mentions(texts, brands, "id", "text")
        plan = found._jdf.queryExecution().analyzed().toString()
        assert ("CASE WHEN" in plan.split("posexplode")[1] and "RLIKE" in plan) == (limit > 0)
        results[limit] = sorted(map(str, found.collect()))
    assert results[32] == results[0]
    got = {(r["id"], r["brand"]): r["mentions"] for r in found.collect()}
    assert got[(1, "on the")] == 2 and got[(2, "on the")] == 3 and got[(5, "the the")] == 2
    assert got[(None, "of and the")] == 2 and got[(3, "c++")] == 1 and (4, "on the") not in got
