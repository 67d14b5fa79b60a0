"""Quality by hierarchical empirical Bayes.

A logistic classifier on the style of a text gives each document evidence of its
own. The means of these probabilities by site and by path within a site are shrunk:
a path towards its site, a site towards the whole corpus, the more the fewer
documents there are. How strongly is estimated from how much sites, and paths
within them, really differ. A document's own share is taken out of the prior that
its site and path give to it, so that no evidence counts twice.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urltriage.llm.common import col, fresh, stored

FEATURES = (
    "length",
    "vocabulary",
    "top_word",
    "doubled",
    "repeated_lines",
    "upper",
    "symbols",
    "exclaims",
    "digits",
    "word_length",
)
#: Rows that are looked at for each row of the sample; enough to be sure to fill it.
SPARE = 1.2
#: Characters of a text whose words are counted together.
SLAB_CHARS = 1 << 20

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*@^~|<>{}[]\\_=+/"


@dataclass(frozen=True)
class Prior:
    #: Labelled documents the classifier is fitted on, at most.
    sample: int = 20_000
    #: Documents with a lower probability of quality are rejected.
    reject_below: float = 0.5
    #: Penalty of squared weights.
    ridge: float = 1.0
    #: Bounds of the weight, in documents, of what stands above a site or path.
    least_weight: float = 1.0
    most_weight: float = 10_000.0


def style(text: str | None) -> tuple[float, ...]:
    """Features of a text; all zero for null and white space."""
    text = text or ""
    counts: Counter = Counter()
    words = doubled = letters = 0
    for begin in range(0, len(text), SLAB_CHARS):
        part = text[begin : begin + SLAB_CHARS].split()
        counts.update(part)
        words += len(part)
        letters += sum(map(len, part))
        doubled += sum(map(str.__eq__, part, part[1:]))
    if not words:
        return (0.0,) * len(FEATURES)
    data = text.encode()
    lines = [x for x in text.split("\n") if x]

    def share(of: bytes) -> float:
        return (len(data) - len(data.translate(None, of))) / letters

    return (
        math.log1p(words),
        math.log1p(len(counts)) / math.log1p(words),
        max(counts.values()) / words,
        doubled / words,
        1 - len(set(lines)) / len(lines),
        share(_UPPER),
        share(_SYMBOLS),
        share(b"!?"),
        share(_DIGITS),
        letters / words / 10,
    )


def styles(docs: DataFrame, id_col: str, text_col: str, site_col: str, path_col: str | None) -> DataFrame:
    """``doc_id``, ``text_sha256``, ``site``, ``path`` and the features of every whole text."""
    text = col(text_col)
    source = docs.select(
        col(id_col).alias("doc_id"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"),
        col(site_col).cast("string").alias("site"),
        (col(path_col) if path_col else F.lit(None)).cast("string").alias("path"),
        text.alias("text"),
    )
    kept = source.drop("text")
    schema = kept.select("*", *(F.lit(0.0).alias(f) for f in FEATURES)).schema

    def run(batches):
        for batch in batches:
            rows = np.array([style(t) for t in batch.column(4).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def _design(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, x * x), axis=1)


def fit(features: DataFrame, labels: DataFrame, label_col: str, prior: Prior) -> tuple[list[float], float]:
    """Weights of features and their squares with the constant last; prior log odds of the sample.

    The sample is bounded: the labelled documents with the smallest hash. Labels that
    are null count for nothing. Without both classes, there are no weights.
    """
    labelled = labels.select(col("doc_id").alias("doc_id"), col(label_col).alias("label")).where("label is not null")
    known = features.join(labelled, "doc_id").select(
        *FEATURES,
        F.col("label").cast("int").alias("label"),
        # Uniform from 0 to 1.
        (F.xxhash64("doc_id", "text_sha256").cast("double") / 2.0**64 + 0.5).alias("h"),
    )
    # Drops most rows where they are, so that tasks don't each send a whole sample.
    share = SPARE * prior.sample / max(1, known.count())
    rows = known.where(F.col("h") <= share).orderBy("h", "label", *FEATURES).limit(prior.sample).collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(rows) == 0 or y.min() == y.max():
        return [], 0.0
    x = _design(np.array([[r[f] for f in FEATURES] for r in rows]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    weights = np.zeros(z.shape[1])
    penalty = np.full(len(weights), prior.ridge)
    penalty[-1] = 1e-6
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (y - p) - penalty * weights
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    own = weights[:-1] / scale
    constant = weights[-1] - float(own @ mean)
    return [*own.tolist(), constant], math.log(y.mean() / (1 - y.mean()))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _evidence(weights: list[float], prior_odds: float) -> Column:
    """Log likelihood ratio of a document's own style."""
    if not weights:
        return F.lit(0.0)
    terms = [F.col(f) for f in FEATURES] + [F.col(f) * F.col(f) for f in FEATURES]
    score = F.lit(weights[-1])
    for w, t in zip(weights[:-1], terms, strict=True):
        score = score + F.lit(w) * t
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score)) - prior_odds


def _weight(means: DataFrame, above: str, prior: Prior) -> float:
    """Weight in documents of the mean ``above`` for groups with ``total`` and ``n``.

    Moments of a beta distribution: what the group means differ beyond chance.
    """
    m = F.col("total") / F.col("n")
    centre = F.col(above)
    found = means.agg(
        F.sum(F.col("n") * (m - centre) ** 2).alias("between"),
        F.sum(centre * (1 - centre)).alias("chance"),
        F.sum(F.col("n") * centre * (1 - centre)).alias("scale"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    if not found["groups"] or found["between"] is None:
        return prior.most_weight
    spread = found["between"] - found["chance"]
    if spread <= 0 or found["n"] <= found["groups"]:
        return prior.most_weight
    # between = chance + (n - groups) * variance of the true means
    share = spread * found["n"] / (found["scale"] * (found["n"] - found["groups"]))
    return min(prior.most_weight, max(prior.least_weight, 1 / share - 1)) if share > 0 else prior.most_weight


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    path_col: str | None = "lang",
    label_col: str = "quality",
    prior: Prior = Prior(),
) -> DataFrame:
    """Probability of quality of every document, and whether it is kept.

    ``labels`` has ``doc_id`` and ``label_col`` (1 good, 0 bad). Columns: ``doc_id``,
    ``site``, ``path``, ``own_evidence`` (log odds), ``site_quality``,
    ``path_quality`` (shrunk means without the document itself), ``quality``, ``kept``,
    ``text_sha256``. Rows of a null site or path form a group of their own. Null and
    empty texts have the style of an empty text. Without labels of both classes all
    are kept. Repeated rows and null ids stay. An empty table gives an empty result.
    """
    features = stored(styles(docs, id_col, text_col, site_col, path_col), "quality-styles")
    weights, prior_odds = fit(features, labels, label_col, prior)
    own = _evidence(weights, prior_odds)
    base = stored(
        features.select(
            "doc_id", "text_sha256", "site", "path", own.alias("own_evidence"), _sigmoid(own + prior_odds).alias("p")
        ),
        "quality-evidence",
    )
    paths = stored(
        base.groupBy("site", "path").agg(F.sum("p").alias("total"), F.count(F.lit(1)).alias("n")), "quality-paths"
    )
    sites = stored(paths.groupBy("site").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), "quality-sites")
    whole = sites.agg(F.sum("total"), F.sum("n")).first()
    mean = whole[0] / whole[1] if whole[1] else 0.5
    site_weight = _weight(sites.withColumn("above", F.lit(mean)), "above", prior)
    shrunk = (F.col("total") + site_weight * mean) / (F.col("n") + site_weight)
    above = sites.select(F.col("site").alias("of"), shrunk.alias("above"))
    path_weight = _weight(paths.join(above, F.col("site").eqNullSafe(F.col("of"))), "above", prior)
    groups = stored(
        paths.select(
            F.col("site").alias("g_site"), F.col("path").alias("g_path"), F.col("total").alias("p_total"), F.col("n").alias("p_n")
        ).join(
            sites.select(F.col("site").alias("s_site"), F.col("total").alias("s_total"), F.col("n").alias("s_n")),
            F.col("g_site").eqNullSafe(F.col("s_site")),
        ),
        "quality-groups",
    )
    joined = base.join(
        groups, F.col("site").eqNullSafe(F.col("g_site")) & F.col("path").eqNullSafe(F.col("g_path"))
    )
    site_quality = (F.col("s_total") - F.col("p") + site_weight * mean) / (F.col("s_n") - 1 + site_weight)
    path_quality = (F.col("p_total") - F.col("p") + path_weight * F.col("site_quality")) / (
        F.col("p_n") - 1 + path_weight
    )
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_quality")))
    return (
        joined.withColumn("site_quality", site_quality)
        .withColumn("path_quality", path_quality)
        .withColumn("quality", _sigmoid(_logit(bounded) + F.col("own_evidence")))
        .withColumn("kept", F.lit(not weights) | (F.col("quality") >= prior.reject_below))
        .select(
            "doc_id",
            "site",
            "path",
            "own_evidence",
            "site_quality",
            "path_quality",
            "quality",
            "kept",
            "text_sha256",
        )
    )


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the documents that ``score_quality`` rejects; columns stay as they are."""
    scored = score_quality(docs, labels, id_col, text_col, **options)
    sha, kept_id, kept_sha = fresh(docs.columns, "sha", "kept_id", "kept_sha")
    kept = stored(scored.where("kept").select("doc_id", "text_sha256").distinct(), "quality-kept").toDF(kept_id, kept_sha)
    marked = docs.withColumn(sha, F.sha2(F.coalesce(col(text_col), F.lit("")), 256))
    return marked.join(
        kept, col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi"
    ).drop(sha)
