"""One row per key as plain max/min aggregates.

They combine on the map side, so a key that holds much of the input shrinks to
one row per task before the shuffle.  A window with row_number would send all
its rows to one task instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], aggregate) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    # Remaining columns break ties, so the result does not depend on row order.
    row = aggregate(F.struct(*order, *rest)).alias("_row")
    picked = df.groupBy(*keys).agg(row)
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def latest_per_key(df: DataFrame, keys, order: list[str]) -> DataFrame:
    return _pick(df, [keys] if isinstance(keys, str) else list(keys), order, F.max)


def first_per_key(df: DataFrame, keys, order: list[str]) -> DataFrame:
    return _pick(df, [keys] if isinstance(keys, str) else list(keys), order, F.min)
