"""Weighted rules as data, evaluated in narrow steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """Adds ``points`` and ``reason`` when the condition holds (null is no).

    All three are SQL text over the columns of the scored table.
    """

    when: str
    points: str | int | float
    reason: str | None
    strong: bool = False


@dataclass(frozen=True)
class Fired:
    """Rules whose conditions have become boolean columns."""

    rules: Sequence[Rule]
    columns: Sequence[str]

    def points(self) -> str:
        parts = zip(self.rules, self.columns, strict=True)
        return " + ".join(f"CASE WHEN {c} THEN {_number(r.points)} ELSE 0 END" for r, c in parts)

    def reasons(self) -> str:
        parts = zip(self.rules, self.columns, strict=True)
        texts = [f"CASE WHEN {c} THEN {r.reason} END" for r, c in parts if r.reason is not None]
        return f"array_compact(array({', '.join(texts)}))"

    def strong(self) -> str:
        parts = zip(self.rules, self.columns, strict=True)
        return " OR ".join(c for r, c in parts if r.strong) or "false"


def _number(points: str | int | float) -> str:
    return f"{points!r}D" if isinstance(points, float) else f"({points})"


def fire(df: DataFrame, rules: Sequence[Rule], prefix: str) -> tuple[DataFrame, Fired]:
    """Evaluate each condition once, into columns ``<prefix>0``, ``<prefix>1``...

    Points, reasons and the strong flag then refer to the columns, so no
    condition is repeated in the generated code.
    """
    names = [f"{prefix}{i}" for i in range(len(rules))]
    flags = [f"coalesce({r.when}, false) AS {n}" for n, r in zip(names, rules, strict=True)]
    return df.selectExpr("*", *flags), Fired(rules, names)
