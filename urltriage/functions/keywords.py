"""Whole-word keyword search with every dictionary entry counted on its own.

One pass over the text finds, at each word start, the longest entry there.
Entries that are a beginning of it (``verify`` in ``verify account``) occur at
the same place and are added from a small fixed map, so the counts equal those
of one search per entry.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from urltriage.functions.text import WORD, text_array

SNIPPET_WINDOW = 50
SNIPPET_LENGTH = 100
SNIPPETS = 5


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _entry(keyword: str, skip: int = 0) -> str:
    # A boundary lies between a word and a non-word character.
    end = f"(?!{WORD})" if _is_word(keyword[-1]) else f"(?={WORD})"
    return _quoted(keyword[skip:]) + end


def occurrence_pattern(keywords) -> str:
    """Pattern for a text with a blank in front; group 1 is the longest keyword
    at a word start."""
    ordered = sorted(set(keywords), key=lambda k: (k[0], -len(k), k))
    if not all(_is_word(k[0]) for k in ordered):
        raise ValueError("keywords have to start with a letter, digit or underscore")
    branches = [
        f"{first}(?:{'|'.join(_entry(k, 1) for k in group)})"
        for first, group in groupby(ordered, key=lambda k: k[0])
    ]
    firsts = "".join(sorted({re.escape(k[0]) for k in ordered}))
    # Consumes the character before the word; the cheap classes come first.
    return f"[^a-z](?=[{firsts}])(?<!{WORD})(?=({'|'.join(branches)}))"


def contained_entries(keywords) -> dict[str, list[str]]:
    """Keyword -> itself and the entries that occur at its beginning."""
    entries = sorted(set(keywords))
    result = {}
    for k in entries:
        inside = [
            s
            for s in entries
            if s == k or (k.startswith(s) and _is_word(s[-1]) != _is_word(k[len(s)]))
        ]
        if len(inside) > 1:
            result[k] = inside
    return result


def occurrences(text: Column, keywords) -> Column:
    """Every occurrence of every keyword in a lowercased text, as an array."""
    padded = F.concat(F.lit(" "), text)
    found = F.regexp_extract_all(padded, F.lit(occurrence_pattern(keywords)), F.lit(1))
    nested = contained_entries(keywords)
    if not nested:
        return found

    def expand(k: Column) -> Column:
        parts = F.create_map(
            *[x for key, inside in nested.items() for x in (F.lit(key), text_array(inside))]
        )
        return F.when(k.isin(*nested), F.try_element_at(parts, k)).otherwise(F.array(k))

    return F.flatten(F.transform(found, expand))


def count_in(found: Column, family) -> Column:
    return F.size(F.filter(found, lambda k: k.isin(*family)))


def distinct_in(found: Column, family) -> Column:
    return F.array_sort(F.array_intersect(found, text_array(family)))


def snippets(text: Column, found: Column, families) -> Column:
    """First five keyword contexts, by (keyword, position).

    At most five keywords and five positions of each can matter, so the text
    is split at most five times however often keywords occur.
    """
    first = F.slice(distinct_in(found, families), 1, SNIPPETS)

    def contexts(keyword: Column) -> Column:
        pattern = F.concat(F.lit(f"(?<!{WORD})\\Q"), keyword, F.lit(f"\\E(?!{WORD})"))
        named = F.array(F.struct(F.split(text, pattern, SNIPPETS + 1).alias("p"), F.length(keyword).alias("n")))
        starts = F.flatten(
            F.transform(
                named,
                lambda v: F.when(
                    F.size(v["p"]) > 1,
                    F.transform(
                        F.sequence(F.lit(1), F.size(v["p"]) - 1),
                        lambda i: F.aggregate(
                            F.slice(v["p"], F.lit(1), i), F.lit(0), lambda acc, s: acc + F.length(s)
                        )
                        + (i - 1) * v["n"],
                    ),
                ).otherwise(F.array().cast("array<int>")),
            )
        )
        return F.transform(
            starts,
            lambda s: F.substring(
                F.trim(
                    F.substring(
                        text,
                        F.greatest(s - SNIPPET_WINDOW, F.lit(0)) + 1,
                        F.least(s, F.lit(SNIPPET_WINDOW)) + F.length(keyword) + SNIPPET_WINDOW,
                    )
                ),
                1,
                SNIPPET_LENGTH,
            ),
        )

    return F.slice(F.flatten(F.transform(first, contexts)), 1, SNIPPETS)
