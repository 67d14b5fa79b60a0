"""Results life cycle, hot keys and invariance."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from urltriage.operators import candidates as S
from urltriage.operators import facts as D
from urltriage.operators import results as K
from urltriage.plans import fixtures as fx
from urltriage.plans.domain_triage import triage_domains
from urltriage.sources import readers, writers
from urltriage.streaming.incremental import results_so_far, triage_stream

SF = "/root/testdata/sf0.001"
AS_OF = fx.AS_OF


def options(spark):
    return {"keywords": fx.keywords(spark), "suffixes": fx.suffixes(spark)}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def hits(spark):
    return fx.derive(spark, SF, "fx_hits").selectExpr(
        "keyword", "cast(rank as int) as rank", "original_url", "title", "snippet"
    ).cache()


@pytest.fixture(scope="module")
def results(spark, hits):
    found = triage_domains(hits, fx.facts(spark, SF), AS_OF, **options(spark))
    return K.storable(found, AS_OF).cache()


def test_scores_are_bounded(results):
    assert results.filter(~F.col("score").between(0, 100)).count() == 0


def test_second_run_finds_nothing_new(spark, hits, results):
    again = triage_domains(hits, fx.facts(spark, SF), AS_OF, prior=results, **options(spark))
    assert again.count() == 0


def test_upsert_is_idempotent(results):
    once = K.upsert_results(results, results, AS_OF)
    twice = K.upsert_results(once, results, AS_OF)
    assert rows(once) == rows(twice) == rows(results.select(*once.columns))


@pytest.mark.parametrize("parts", [1, 7])
def test_row_order_and_partitions_do_not_matter(spark, hits, results, parts):
    shuffled = hits.orderBy(F.xxhash64("original_url", F.lit(parts))).repartition(parts)
    got = K.storable(triage_domains(shuffled, fx.facts(spark, SF), AS_OF, **options(spark)), AS_OF)
    assert rows(got) == rows(results)


def test_invalid_rows_are_not_stored(spark):
    df = spark.createDataFrame(
        [("k", "u", -5), ("", "u2", 1), (None, "u3", 1), ("k", "", 1)],
        "keyword string, normalized_url string, score int",
    )
    got = K.storable(df, AS_OF).collect()
    assert [(r["normalized_url"], r["score"]) for r in got] == [("u", 0)]


def test_weak_suspicious_rows_stay_out_of_the_report(spark, tmp_path):
    df = K.storable(
        spark.createDataFrame(
            [("k", "u1", 49, True), ("k", "u2", 50, True), ("k", "u3", 90, False)],
            "keyword string, normalized_url string, score int, suspicious boolean",
        ),
        AS_OF,
    )
    assert [r["normalized_url"] for r in K.suspicious(df).collect()] == ["u2"]
    path = str(tmp_path / "none")
    assert not writers.export_suspicious_csv(df, path, 95)
    assert not (tmp_path / "none").exists()


def test_csv_keeps_quotes_lines_and_blanks(spark, tmp_path):
    value = 'a "quoted", line\nbreak '
    df = spark.createDataFrame([(value, ["x", 'y"z'], None)], "t string, r array<string>, n string")
    writers.export_csv(df, str(tmp_path / "c"))
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "c")).first()
    assert (back["t"], back["r"], back["n"]) == (value, '["x","y\\"z"]', None)


def test_history_replaces_a_repeated_run(spark, tmp_path):
    path = str(tmp_path / "h")
    df = spark.createDataFrame(
        [("u", None, "b", 0.5, "suspect", ["r"], datetime(2025, 1, 1), 1.0, "{}")],
        "url string, brand string, base_domain string, score double, category string, reasons array<string>, "
        "analyzed_at timestamp, analysis_time_s double, content_analysis string",
    )
    writers.append_analysis(df, path, "a")
    writers.append_analysis(df, path, "a")
    assert writers.read_history(spark, path).count() == 1
    # Another run at the same instant, for other brands of the same page.
    both = df.withColumn("brand", F.lit("acme")).union(df.withColumn("brand", F.lit("paypal")))
    writers.append_analysis(both, path, "b")
    assert writers.read_history(spark, path).count() == 3
    with pytest.raises(ValueError, match="run id"):
        writers.append_analysis(df, path, "a/b")


def test_verdicts_keep_facts(spark):
    facts = spark.createDataFrame([("a.com", "R", 2), ("b.com", "S", 1)], "base_domain string, registrar string, mx_count int")
    verdicts = spark.createDataFrame([("a.com", 70), ("c.com", 5), ("", 1)], "base_domain string, score int")
    got = {tuple(r) for r in D.update_facts(facts, verdicts).collect()}
    assert got == {("a.com", "R", 2, 70), ("b.com", "S", 1, None), ("c.com", None, None, 5)}
    again = D.update_facts(D.update_facts(facts, verdicts), spark.createDataFrame([("a.com", 9)], "base_domain string, score int"))
    assert again.filter("base_domain = 'a.com'").first()["score"] == 9


def test_unlisted_keywords_come_last(spark):
    hits = spark.createDataFrame(
        [("new", 1, "https://x.com/", "t", "s"), ("old", 5, "https://x.com/", "t", "s")],
        "keyword string, rank int, original_url string, title string, snippet string",
    )
    keywords = spark.createDataFrame([("old", 0)], "keyword string, seq int")
    facts = fx.facts(spark, SF).limit(0)
    assert [r["keyword"] for r in triage_domains(hits, facts, AS_OF, keywords=keywords).collect()] == ["old"]


def test_dns_of_a_domain_with_many_answers(spark):
    many = spark.range(30_000).selectExpr(
        "'Hot.com' as domain", "'A' as rrtype", "cast(1 + id % 3 as int) as resolver_rank",
        "concat('10.0.0.', id % 4, '.') as value", "cast(id % 7 as int) as ttl", "if(id % 3 = 0, 'timeout', 'ok') as status",
    )
    none = spark.createDataFrame(
        [("none.com", "MX", 1, "m", 1, "timeout")],
        "domain string, rrtype string, resolver_rank int, value string, ttl int, status string",
    )
    got = {r["base_domain"]: r for r in D.rollup_dns(many.union(none)).collect()}
    hot, empty = got["hot.com"], got["none.com"]
    assert (hot["ip"], hot["ttl"]) == ([f"10.0.0.{i}" for i in range(4)], 0)
    assert (empty["mx_records"], empty["mx_count"], empty["ip"], empty["ttl"]) == ([], 0, [], None)


def test_readers(spark, tmp_path, hits):
    hits.write.parquet(str(tmp_path / "serp"))
    assert rows(readers.read_serp(spark, str(tmp_path / "serp"))) == rows(hits)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"abc")
    manifest = spark.createDataFrame([("https://x.com/a.png", "a.png")], "src string, path string")
    named = readers.read_images(spark, str(tmp_path / "img"), manifest).first()
    assert (named["src"], bytes(named["content"])) == ("https://x.com/a.png", b"abc")
    image = readers.read_images(spark, str(tmp_path / "img")).first()
    assert image["src"].endswith("a.png") and bytes(image["content"]) == b"abc"
    pages = spark.createDataFrame(
        [("u", 200, "u", " x ", None), ("v", 200, "v", "  ", None), ("w", None, "w", None, "timeout")],
        "url string, status int, final_url string, html string, error string",
    )
    pages.write.parquet(str(tmp_path / "pages"))
    got = {r["url"]: (r["ok"], r["error"]) for r in readers.read_pages(spark, str(tmp_path / "pages")).collect()}
    assert got == {"u": (True, None), "v": (False, "HTTP 200"), "w": (False, "timeout")}


def test_hot_url_shrinks_before_the_shuffle(spark):
    """A third of all rows share one URL: one row per task is shuffled for it."""
    n = 60_000
    hot = F.when(F.col("id") % 3 == 0, F.lit("https://hot.com/")).otherwise(
        F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".com/"))
    )
    sites = spark.range(n).select(
        F.lit("k").alias("keyword"), F.lit(0).alias("keyword_seq"), F.col("id").cast("int").alias("rank"),
        hot.alias("original_url"), hot.alias("normalized_url"), F.lit("t").alias("title"), F.lit("s").alias("snippet"),
    )
    first = K.first_per_url(sites)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") == 1
    assert first.count() == n - n // 3 + 1
    assert first.filter("normalized_url = 'https://hot.com/'").first()["rank"] == 0


def test_hot_domain_join_is_split(spark, tmp_path):
    """Adaptive execution splits the partition of a hot domain in the facts join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        base = F.when(F.col("id") % 3 == 0, F.lit("hot.com")).otherwise(
            F.concat(F.lit("d"), (F.col("id") % 5000).cast("string"), F.lit(".com"))
        )
        sites = spark.range(0, 200_000, 1, 8).select("id", base.alias("base_domain"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        facts = sites.select("base_domain").distinct().withColumns(
            {"registrar": F.lit("R"), "last_updated": F.lit(AS_OF).cast("timestamp")}
        )
        facts.write.parquet(str(tmp_path / "facts"))
        joined = D.fresh_facts(sites, spark.read.parquet(str(tmp_path / "facts")), AS_OF)
        assert joined.filter("cache_hit").count() == 200_000
        df = joined.select("id", "pad", "registrar")
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [10, 5000, None])
def test_hot_brand_is_dealt_out_by_query(spark, limit):
    links = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("acme")).otherwise(F.lit("other")).alias("brand"),
        (F.col("id") / 2000).cast("int").alias("query_seq"), F.col("id").cast("int").alias("pos"),
        F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".com/")).alias("url"),
    )
    top = S.first_candidates(S.filter_candidates(links), limit)
    got = top.filter("brand = 'acme'").orderBy("position").collect()
    assert [r["url"] for r in got] == [f"https://h{3 * i}.com/" for i in range(6667)][:limit]
    assert [r["position"] for r in got] == list(range(1, len(got) + 1))


def test_stream_equals_batch_and_survives_a_restart(spark, hits, results, tmp_path):
    incoming, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    facts = fx.facts(spark, SF)

    def advance():
        triage_stream(
            spark, incoming, out, state, facts, AS_OF, report_dir=str(tmp_path / "report"), **options(spark)
        ).awaitTermination()

    hits.filter("keyword = 'acme'").coalesce(1).write.mode("append").parquet(incoming)
    advance()
    first = results_so_far(spark, out).count()
    assert first > 0
    advance()
    assert results_so_far(spark, out).count() == first
    hits.filter("keyword = 'paypal'").coalesce(1).write.mode("append").parquet(incoming)
    advance()
    got = results_so_far(spark, out)
    assert got.select("batch_id").distinct().count() >= 2
    assert rows(got.select(*results.columns)) == rows(results)
    report = spark.read.options(header=True, escape='"').csv(str(tmp_path / "report"))
    assert report.count() == K.suspicious(results).count()
    # Another checkpoint is another stream: it adds nothing and replaces nothing.
    triage_stream(spark, incoming, out, str(tmp_path / "state2"), facts, AS_OF, **options(spark)).awaitTermination()
    assert rows(results_so_far(spark, out).select(*results.columns)) == rows(results)
