from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re", "su") for b in ("ba", "de", "fi", "go") for c in ("", "n", "s", "rt")]


@pytest.fixture
def prose():
    """Makes text of n words from a seed."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        words = rng.choices(WORDS, k=n)
        return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))

    return make
