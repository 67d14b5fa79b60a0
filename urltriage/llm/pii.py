"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators with high recall propose spans that may overlap: the four strict kinds,
and looser ones (written-out addresses, loosely written numbers, secrets behind a
key word). Each candidate becomes a few coarse format and context features. Strict
matches and their validators label a part of the candidates; the labelled ones are
counted by feature combination over the whole corpus, and small regression trees
are boosted on that table of counts, whose size the features bound. A threshold for
each generator is calibrated on documents that the trees were not fitted on.
Candidates above it are added to the valid strict matches, which always stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urltriage.llm.common import col, fresh, stored

# The strict kinds. Possessive repetition and the look-behind keep the work linear and
# the stack flat on long runs; the matches are those of the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser generators, with bounded repetition.
LOOSE = {
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}",
    "number": r"(?<![0-9])[(+]?[0-9](?:[ ()./-]{0,2}[0-9]){6,24}(?![0-9])",
    "secret": r"(?i)(?:token|key|secret|password|passwd|pwd) ?[=:] ?[\"']?[A-Za-z0-9+/_.-]{8,256}",
}
GENERATORS = {**STRICT, **LOOSE}
KINDS = list(GENERATORS)
#: Characters without which a generator can't match, so that most texts are not scanned.
NEEDS = {
    "email": ["@"],
    "phone": ["+"],
    "handle": ["@", "(at)", "[at]"],
    "secret": ["=", ":"],
}

IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CUES = {
    1: r"(?i)(?:tel|phone|call|fax|mobile|contact|whatsapp)\W*\w*\W*$",
    2: r"(?i)(?:mail|reach|write)\W*\w*\W*$",
    3: r"(?i)(?:card|visa|account|konto|iban|ssn|payment)\W*\w*\W*$",
    4: r"(?i)(?:\bip|host|server|address|version)\W*\w*\W*$",
}
#: Characters of context in front of a candidate.
CONTEXT = 24

#: Features of a candidate; each has few values, so the table of counts stays small.
FEATURES = ("generator", "digits", "marks", "letters", "plus", "glued", "cue")

#: Lower edges of the bins of ``digits``, and the first bin with the digits of a card.
DIGIT_EDGES = (1, 7, 10, 13, 17)
CARD_DIGITS = 4
#: Scores are sums in another order here and there; smaller differences don't count.
ROUNDING = 1e-6

REDACTED = {k: f"[{k.upper()}]" for k in KINDS}


@dataclass(frozen=True)
class Boosting:
    rounds: int = 24
    depth: int = 2
    rate: float = 0.4
    ridge: float = 1.0
    #: Share of true candidates required among those above a threshold.
    precision: float = 0.97


def _found(text: Column, kind: str) -> tuple[Column, Column]:
    """Matches of a generator, and what stands between them."""
    pattern = GENERATORS[kind]
    needs = NEEDS.get(kind)
    might = F.lit(True) if needs is None else None
    for part in needs or ():
        has = F.contains(text, F.lit(part))
        might = has if might is None else might | has
    if needs is None:
        might = F.col("has_digit")
    none = F.array().cast("array<string>")
    return (
        F.when(might, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        F.when(might, F.split(text, pattern, -1)).otherwise(none),
    )


def _spans(kind: str) -> Column:
    matches, gaps = F.col(f"{kind}_matches"), F.col(f"{kind}_gaps")

    def candidate(match: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("generator"),
            match.alias("match"),
            F.length(before).alias("gap"),
            F.length(match).alias("size"),
            F.right(before, F.lit(CONTEXT)).alias("before"),
            F.left(after, F.lit(1)).alias("after"),
        )

    return F.transform(matches, candidate)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        value = F.substring(backwards, i, F.lit(1)).cast("int")
        doubled = F.when(value > 4, value * 2 - 9).otherwise(value * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(generator: Column, match: Column) -> Column:
    """Whether a strict match passes its kind's validator."""
    digits = _digits(match)
    count = F.length(digits)
    return (
        F.when(generator == KINDS.index("email"), F.lit(True))
        .when(generator == KINDS.index("ip"), match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
        .when(
            (generator == KINDS.index("card")) & count.between(14, 19), _luhn(digits)
        )
        .when(generator == KINDS.index("phone"), count.between(10, 15))
        .otherwise(F.lit(False))
    )


def _bins(value: Column, *edges: int) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (value >= edge).cast("int")
    return out


def _features(candidates: DataFrame) -> DataFrame:
    match, before, after = F.col("match"), F.col("before"), F.col("after")
    alnum = "[A-Za-z0-9]"
    cue = F.lit(0)
    for k, pattern in CUES.items():
        cue = F.when(before.rlike(pattern), F.lit(k)).otherwise(cue)
    return candidates.select(
        "rid",
        "fold",
        "generator",
        "start",
        "stop",
        "valid",
        _bins(F.length(_digits(match)), *DIGIT_EDGES).alias("digits"),
        _bins(F.length(F.regexp_replace(match, alnum, "")), 1, 2, 3, 5).alias("marks"),
        _bins(F.length(F.regexp_replace(match, "[^A-Za-z]", "")), 1, 4, 12).alias("letters"),
        F.startswith(match, F.lit("+")).cast("int").alias("plus"),
        (
            F.coalesce(F.right(before, F.lit(1)).rlike(alnum), F.lit(False)).cast("int")
            + F.coalesce(after.rlike(alnum), F.lit(False)).cast("int")
        ).alias("glued"),
        cue.alias("cue"),
    )


def _labelled(candidates: DataFrame) -> DataFrame:
    """Adds ``covered`` (overlaps a valid strict match) and ``label`` (null: unknown)."""
    order = Window.partitionBy("rid").orderBy("start", "stop", "generator")
    strict_stop = F.when(F.col("valid"), F.col("stop"))
    strict_start = F.when(F.col("valid"), F.col("start"))
    generator = F.col("generator")
    covered = (
        F.coalesce(F.max(strict_stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
        > F.col("start")
    ) | (
        F.coalesce(F.min(strict_start).over(order.rowsBetween(1, Window.unboundedFollowing)), F.col("stop"))
        < F.col("stop")
    )
    secret = generator == KINDS.index("secret")
    return candidates.withColumn("covered", covered).withColumn(
        "label",
        F.when(generator < len(STRICT), F.col("valid").cast("int"))
        .when(secret & (F.col("digits") >= 1) & (F.col("letters") >= 2), F.lit(1))
        .when(secret, F.lit(0))
        .when(F.col("covered"), F.lit(1))
        # A number as long as a card's that no validator accepts, or a part of a word.
        .when((F.col("digits") >= CARD_DIGITS) | (F.col("glued") > 0), F.lit(0)),
    )


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (``rid``, ``doc_id``, ``text_sha256``) and candidates of all generators.

    Both are written to the shared folder; ``rid`` tells repeated rows apart.
    """
    text = F.col("text")
    source = docs.select(
        col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")
    ).withColumn("has_digit", text.rlike("[0-9]"))
    parts = [c.alias(f"{k}_{n}") for k in KINDS for c, n in zip(_found(text, k), ("matches", "gaps"), strict=True)]
    matched = source.select("doc_id", F.sha2(text, 256).alias("text_sha256"), *parts)
    scanned = stored(
        matched.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            "text_sha256",
            F.concat(*(_spans(k) for k in KINDS)).alias("found"),
        ),
        "pii-found",
    )
    along = Window.partitionBy("rid", "generator").orderBy("pos")
    stop = F.sum(F.col("gap") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        scanned.where(F.size("found") > 0)
        .select("rid", F.posexplode("found").alias("pos", "c"))
        .select("rid", "pos", "c.*")
        .repartition("rid")
        .withColumn("stop", stop)
        .withColumn("start", F.col("stop") - F.col("size"))
        .withColumn("fold", F.pmod(F.xxhash64("rid"), F.lit(2)).cast("int"))
        .withColumn("valid", _valid(F.col("generator"), F.col("match")))
    )
    # A secret is its value, without the key word.
    lead = F.length(F.regexp_extract("match", "^[^=:]*[=:] ?[\"']?", 0))
    placed = placed.withColumn(
        "start",
        F.when(F.col("generator") == KINDS.index("secret"), F.col("start") + lead).otherwise(F.col("start")),
    )
    return scanned.drop("found"), stored(_labelled(_features(placed)), "pii-candidates")


# ---------------------------------------------------------------- trees on a table of counts

Cell = tuple[tuple[int, ...], float, float]  # feature values, true and false candidates


def _leaf(rows: list, config: Boosting) -> float:
    gradient = sum(g for _, g, _ in rows)
    curvature = sum(h for _, _, h in rows)
    return config.rate * gradient / (curvature + config.ridge)


def _gain(rows: Iterable, config: Boosting) -> float:
    rows = list(rows)
    return sum(g for _, g, _ in rows) ** 2 / (sum(h for _, _, h in rows) + config.ridge)


def _grow(rows: list, depth: int, config: Boosting):
    """A tree as a number, or (feature, value, tree if equal, tree if not)."""
    best, split = _gain(rows, config) + 1e-9, None
    if depth:
        for f in range(len(FEATURES)):
            for value in sorted({x[f] for x, _, _ in rows}):
                yes = [r for r in rows if r[0][f] == value]
                no = [r for r in rows if r[0][f] != value]
                if yes and no and (gain := _gain(yes, config) + _gain(no, config)) > best:
                    best, split = gain, (f, value, yes, no)
    if split is None:
        return _leaf(rows, config)
    f, value, yes, no = split
    return f, value, _grow(yes, depth - 1, config), _grow(no, depth - 1, config)


def _apply(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, value, yes, no = tree
        tree = yes if x[f] == value else no
    return tree


def boost(cells: list[Cell], config: Boosting = Boosting()) -> list:
    """Trees whose sum is the log odds of a true candidate."""
    trees: list = []
    scores = [0.0] * len(cells)
    for _ in range(config.rounds if cells else 0):
        rows = []
        for (x, true, false), score in zip(cells, scores, strict=True):
            p = 1 / (1 + math.exp(-score))
            rows.append((x, true * (1 - p) - false * p, (true + false) * p * (1 - p)))
        trees.append(tree := _grow(rows, config.depth, config))
        scores = [s + _apply(tree, x) for (x, _, _), s in zip(cells, scores, strict=True)]
    return trees


def calibrate(cells: list[Cell], trees: list, config: Boosting = Boosting()) -> dict[int, float]:
    """For each generator the lowest score above which the required share is true.

    A generator without a labelled candidate takes the threshold of all together.
    """

    def threshold(chosen: list[Cell]) -> float:
        scored = sorted(((sum(_apply(t, x) for t in trees), true, false) for x, true, false in chosen), reverse=True)
        out, trues, total = math.inf, 0.0, 0.0
        for k, (score, true, false) in enumerate(scored):
            trues, total = trues + true, total + true + false
            tied = k + 1 < len(scored) and scored[k + 1][0] == score
            if not tied and trues >= config.precision * total:
                out = score
        return out

    pooled = threshold(cells)
    out = {}
    for k in range(len(KINDS)):
        own = [c for c in cells if c[0][0] == k]
        out[k] = threshold(own) if own else pooled
    return out


def _as_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, value, yes, no = tree
    return F.when(F.col(FEATURES[f]) == value, _as_column(yes)).otherwise(_as_column(no))


def fit(candidates: DataFrame, config: Boosting = Boosting()) -> tuple[list, dict[int, float]]:
    """Trees and thresholds from the labelled candidates of the whole corpus.

    Only counts by feature combination reach the driver, some thousand at most.
    """
    counts = (
        candidates.where("label is not null")
        .groupBy("fold", *FEATURES)
        .agg(F.sum("label").alias("true"), F.sum(1 - F.col("label")).alias("false"))
        .collect()
    )
    cells = sorted((r["fold"], tuple(r[f] for f in FEATURES), float(r["true"]), float(r["false"])) for r in counts)
    trees = boost([c[1:] for c in cells if c[0] == 0], config)
    return trees, calibrate([c[1:] for c in cells if c[0] == 1], trees, config)


def select(candidates: DataFrame, trees: list, thresholds: dict[int, float]) -> DataFrame:
    """Spans: all valid strict matches, and other candidates above their threshold.

    Strict matches that fail their validator are known to be none. Added spans that
    overlap a valid strict match are left out. Columns: ``rid``, ``generator``,
    ``start``, ``stop``, ``strict``.
    """
    score = F.lit(0.0)
    for tree in trees:
        score = score + _as_column(tree)
    needed = F.lit(math.inf)
    for k, t in thresholds.items():
        needed = F.when(F.col("generator") == k, F.lit(t - ROUNDING)).otherwise(needed)
    loose = F.col("generator") >= len(STRICT)
    chosen = F.col("valid") | (loose & ~F.col("covered") & (score >= needed))
    return candidates.where(chosen).select("rid", "generator", "start", "stop", F.col("valid").alias("strict"))


def _kind_name(generator: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), generator)


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Boosting = Boosting()
) -> DataFrame:
    """Personal data of every row and whole text.

    Columns: ``doc_id``; ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (valid strict
    matches); ``base_sha256`` of these as kind:start:end, by start and kind;
    ``spans`` (all spans, written in the same way; code points, end exclusive);
    ``text_sha256``. Null text counts as empty; texts without a span have zeros and
    an empty list; repeated rows and null ids stay. An empty table gives an empty
    result. Other columns are ignored.
    """
    documents, candidates = propose(docs, id_col, text_col)
    spans = select(candidates, *fit(candidates, config))
    written = F.concat_ws(":", _kind_name(F.col("generator")), F.col("start"), F.col("stop"))
    entry = F.struct("start", "generator", "stop", written.alias("written"))

    def listed(entries: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(entries), lambda e: e["written"]), ",")

    strict = F.col("strict")
    per_document = spans.groupBy("rid").agg(
        *(
            F.count(F.when(strict & (F.col("generator") == k), F.lit(1))).alias(f"n_{name}")
            for k, name in enumerate(STRICT)
        ),
        F.collect_list(F.when(strict, entry)).alias("base"),
        F.collect_list(entry).alias("all"),
    )
    joined = documents.join(per_document, "rid", "left")
    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in STRICT),
        F.sha2(F.coalesce(listed(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"),
        "text_sha256",
    )


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Boosting = Boosting()
) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets.

    Spans that overlap are replaced together, by the kind of the first of them. All
    columns and rows stay; a null text stays null.
    """
    documents, candidates = propose(docs, id_col, text_col)
    spans = select(candidates, *fit(candidates, config))
    order = Window.partitionBy("rid").orderBy("start", "generator", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") >= reach, F.lit(True))
    runs = (
        spans.withColumn("begins", begins)
        .withColumn("run", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.max(F.when(F.col("begins"), F.col("generator"))).alias("generator"),
        )
        .withColumn(
            "from", F.coalesce(F.lag("stop").over(Window.partitionBy("rid").orderBy("run")), F.lit(0))
        )
    )
    per_document = runs.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "from", "stop", "generator"))).alias("runs")
    )
    id_name, sha, own_sha, runs_name = fresh(docs.columns, "id", "sha", "own_sha", "runs")
    # Rows with the same id and text have the same spans, so one of them stands for all.
    marked = (
        documents.join(per_document, "rid")
        .dropDuplicates(["doc_id", "text_sha256"])
        .select(
            F.col("doc_id").alias(id_name), F.col("text_sha256").alias(sha), F.col("runs").alias(runs_name)
        )
    )
    marked = stored(marked, "pii-runs")
    text, found = col(text_col), F.col(runs_name)
    labels = F.array(*(F.lit(REDACTED[k]) for k in KINDS))

    def replaced(run: Column) -> Column:
        gap = F.substring(text, (run["from"] + 1).cast("int"), (run["start"] - run["from"]).cast("int"))
        return F.concat(gap, F.get(labels, run["generator"]))

    rest = F.substring(text, (F.element_at(found, -1)["stop"] + 1).cast("int"), F.lit(2**31 - 1))
    redacted = F.when(found.isNull(), text).otherwise(
        F.concat(F.array_join(F.transform(found, replaced), ""), rest)
    )
    joined = docs.withColumn(own_sha, F.sha2(F.coalesce(text, F.lit("")), 256)).join(
        marked, col(id_col).eqNullSafe(F.col(id_name)) & (F.col(own_sha) == F.col(sha)), "left"
    )
    return joined.select(
        *(redacted.alias(c) if c.lower() == text_col.lower() else col(c) for c in docs.columns)
    )
