"""String similarity from built-in functions.

Spark has ``levenshtein`` built in; Jaro-Winkler is composed here from array
functions.  It is interpreted per pair, so callers put a cheap built-in bound
(:func:`may_reach_jaro_winkler`) in front and evaluate it on survivors only.

The functions take and give SQL text: arguments may be columns or the variable
of a surrounding lambda, and one parse replaces hundreds of calls to the JVM.
"""

from __future__ import annotations

BOOST_ABOVE = 0.7
PREFIX_WEIGHT = 0.1
MAX_PREFIX = 4


def levenshtein_similarity(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {longest} = 0 THEN 1D ELSE 1D - levenshtein({a}, {b}) / {longest} END"


def required_jaro(min_jw: float, prefix: int = MAX_PREFIX) -> float:
    """Least Jaro value from which the boost of a common prefix can still exceed ``min_jw``."""
    if not BOOST_ABOVE < min_jw <= 1.0:
        raise ValueError("the bound holds for thresholds above 0.7 only")
    boost = PREFIX_WEIGHT * prefix
    return (min_jw - boost) / (1.0 - boost)


def may_reach_jaro_winkler(a: str, b: str, min_jw: float) -> str:
    """False only for pairs that cannot exceed ``min_jw``.

    Characters of one side that occur at all on the other bound the number of
    matches m from above, and Jaro is at most (m/|a| + m/|b| + 1) / 3.  The
    fewer first characters are equal, the higher Jaro has to be.  Lengths and
    prefixes go first: most pairs end there.  Nothing is divided by a length.
    """
    common_a = f"length({a}) - length(translate({a}, {b}, ''))"
    common_b = f"length({b}) - length(translate({b}, {a}, ''))"
    least = [f"{3.0 * required_jaro(min_jw, p) - 1.0 - 1e-9!r}D" for p in range(MAX_PREFIX + 1)]
    differ = " ".join(f"WHEN left({a}, {p + 1}) != left({b}, {p + 1}) THEN {least[p]}" for p in range(MAX_PREFIX))
    least_sum = f"CASE {differ} ELSE {least[MAX_PREFIX]} END"
    enough = " AND ".join(
        f"({m}) * (1D * length({a}) + length({b})) > ({least_sum}) * length({a}) * length({b})"
        for m in (f"least(length({a}), length({b}))", common_b, common_a)
    )
    return f"({enough})"


def jaro_winkler(a: str, b: str) -> str:
    """Jaro-Winkler similarity in 0..1 (prefix weight 0.1, up to four characters)."""
    # Positions of b matched by the characters of a, in the order of a.
    matched = """
      aggregate(sequence(0, size(jp.a) - 1), CAST(array() AS ARRAY<INT>), (ju, ji) -> concat(ju, slice(filter(
        CASE WHEN greatest(0, ji - jp.reach) <= least(size(jp.b) - 1, ji + jp.reach)
          THEN sequence(greatest(0, ji - jp.reach), least(size(jp.b) - 1, ji + jp.reach))
          ELSE CAST(array() AS ARRAY<INT>) END,
        jj -> get(jp.b, jj) = get(jp.a, ji) AND NOT array_contains(ju, jj)), 1, 1)))"""
    reach = f"greatest(0, CAST(floor(greatest(length({a}), length({b})) / 2) AS INT) - 1)"
    split = f"named_struct('a', split({a}, ''), 'b', split({b}, ''), 'reach', {reach})"
    found = f"transform(array({split}), jp -> named_struct('a', jp.a, 'b', jp.b, 'used', {matched}))"
    moved = (
        "floor(size(filter(zip_with(transform(jm.used, jj -> get(jm.b, jj)), "
        "transform(array_sort(jm.used), jj -> get(jm.b, jj)), (jx, jy) -> jx != jy), jd -> jd)) / 2)"
    )
    jaro = (
        "(size(jm.used) / size(jm.a) + size(jm.used) / size(jm.b) + "
        f"(size(jm.used) - {moved}) / size(jm.used)) / 3D"
    )
    prefix = (
        "size(filter(sequence(1, least(size(jm.a), size(jm.b), "
        f"{MAX_PREFIX})), jk -> slice(jm.a, 1, jk) = slice(jm.b, 1, jk)))"
    )
    scores = (
        f"transform({found}, jm -> CASE WHEN size(jm.used) = 0 THEN named_struct('j', 0D, 'p', 0) "
        f"ELSE named_struct('j', {jaro}, 'p', {prefix}) END)"
    )
    boosted = (
        f"get(transform({scores}, js -> CASE WHEN js.j > {BOOST_ABOVE}D "
        f"THEN js.j + js.p * {PREFIX_WEIGHT}D * (1D - js.j) ELSE js.j END), 0)"
    )
    return (
        f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1D "
        f"WHEN length({a}) = 0 OR length({b}) = 0 THEN 0D WHEN {a} = {b} THEN 1D ELSE {boosted} END"
    )


def typosquat_score(brand: str, core: str) -> str:
    """0.6 Levenshtein + 0.4 Jaro-Winkler; 0 when equal or blank."""
    b, d = f"lower({brand})", f"lower({core})"
    blank = f"coalesce({b}, '') = '' OR {d} IS NULL OR {b} = {d}"
    mixed = f"0.6D * ({levenshtein_similarity(b, d)}) + 0.4D * ({jaro_winkler(b, d)})"
    return f"CASE WHEN {blank} THEN 0D ELSE {mixed} END"


def hex_similarity(a: str, b: str) -> str:
    """1 minus the share of differing digits of two equally long hex digests."""
    differing = f"size(filter(zip_with(split({a}, ''), split({b}, ''), (hx, hy) -> hx != hy), hd -> hd))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0D ELSE 1D - {differing} / length({a}) END"
