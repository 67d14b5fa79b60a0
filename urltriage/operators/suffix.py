"""Registrable domain of a host from a table of public-suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urltriage import config
from urltriage.functions.text import sql_text


# Rules beyond this count are joined without a broadcast hint.
BROADCAST_RULES = 200_000


def inline_table(spark: SparkSession, rows, columns: str) -> DataFrame:
    """Small table of text values as part of the plan (its size is then known)."""
    values = ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def default_suffixes(spark: SparkSession) -> DataFrame:
    return inline_table(spark, config.DEFAULT_SUFFIXES, "suffix, rule_type")


def with_registrable_domain(
    df: DataFrame,
    host_col: str = "host",
    suffixes: DataFrame | None = None,
    max_labels: int | None = None,
) -> DataFrame:
    """Add suffix, domain_core, subdomain and base_domain.

    The rules are looked up once per possible suffix length, as equi-joins on
    the tail of the host.  The rule table is counted first: up to
    ``BROADCAST_RULES`` it is broadcast, so the (large) left side is never
    shuffled by keys as hot as ``com``; beyond that Spark joins by shuffle,
    where adaptive execution splits the hot tails.
    """
    if suffixes is None:
        suffixes = default_suffixes(df.sparkSession)
        n_rules = len(config.DEFAULT_SUFFIXES)
        max_labels = max(s.count(".") + 1 for s, _ in config.DEFAULT_SUFFIXES)
    else:
        deepest = F.max(F.size(F.split(F.regexp_replace("suffix", r"^[*!][.]?", ""), "[.]")))
        n_rules, measured = suffixes.agg(F.count("*"), deepest).first()
        max_labels = max_labels or measured or 1

    rules = (
        suffixes.select(
            F.lower(F.regexp_replace("suffix", r"^(\*[.]|!)", "")).alias("_key"), "rule_type"
        )
        .groupBy("_key")
        .agg(
            F.bool_or(F.col("rule_type") == "exact").alias("_exact"),
            F.bool_or(F.col("rule_type") == "wildcard").alias("_wild"),
            F.bool_or(F.col("rule_type") == "exception").alias("_exc"),
        )
    )
    host = F.col(host_col)
    n_labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    out = df.withColumn("_n", F.when(host == "", F.lit(0)).otherwise(F.coalesce(n_labels, F.lit(0))))
    exact_lengths, exception_lengths = [], []
    for i in range(1, max_labels + 1):
        tail = F.when(F.col("_n") >= i, F.substring_index(host, ".", -i))
        side = rules.select(
            F.col("_key").alias(f"_k{i}"),
            F.col("_exact").alias(f"_e{i}"),
            F.col("_wild").alias(f"_w{i}"),
            F.col("_exc").alias(f"_x{i}"),
        )
        if n_rules <= BROADCAST_RULES:
            side = F.broadcast(side)
        out = out.join(side, tail == F.col(f"_k{i}"), "left")
        exact_lengths.append(F.when(F.col(f"_e{i}"), F.lit(i)))
        exact_lengths.append(F.when(F.col(f"_w{i}") & (F.col("_n") > i), F.lit(i + 1)))
        exception_lengths.append(F.when(F.col(f"_x{i}"), F.lit(i - 1)))
    longest = F.greatest(*exact_lengths, F.lit(0))
    out = out.withColumn("_s", F.coalesce(*exception_lengths, longest))

    n, s = F.col("_n"), F.col("_s")
    suffix = F.when(s > 0, F.call_function("substring_index", host, F.lit("."), -s)).otherwise("")
    own = F.when(s > 0, n - s).otherwise(n)
    labels = F.split(host, "[.]")
    is_address = host.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    core = F.when(is_address, host).when(own > 0, F.get(labels, own - 1)).otherwise(F.lit(""))
    sub = F.when(is_address | (own < 2), F.lit("")).otherwise(
        F.call_function("substring_index", host, F.lit("."), own - 1)
    )
    return (
        out.withColumns({"suffix": suffix, "domain_core": core, "subdomain": sub})
        .withColumn(
            "base_domain",
            F.when(s > 0, F.concat("domain_core", F.lit("."), "suffix")).otherwise(
                F.coalesce(host, F.lit(""))
            ),
        )
        .select(*df.columns, "suffix", "domain_core", "subdomain", "base_domain")
    )
