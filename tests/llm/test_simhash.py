from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from urltriage.llm.components import components
from urltriage.llm.simhash import drop_near_copies, embed, fingerprint, links, manhattan, near_duplicates


def brute_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint(spark, prose, monkeypatch):
    texts = [None, "", " \t\n", "One", "one two THREE", "a b c d", "Ä ä É 中文 x\x0by\x1cz q", prose(1, 500)]
    for text in texts:
        assert fingerprint(text) == brute_fingerprint(text), text
    monkeypatch.setattr("urltriage.llm.simhash.SLAB", 64)
    assert fingerprint(prose(1, 500)) == brute_fingerprint(prose(1, 500))
    # The database's own hash is the same function.
    assert spark.sql("select xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a ^ (rng.integers(0, 2**63, 2000, dtype=np.uint64) & rng.integers(0, 2**63, 2000, dtype=np.uint64))
    assert (manhattan(embed(a), embed(b)) <= np.bitwise_count(a ^ b)).all()


def near_fingerprints(seed, n):
    """Chains and dense groups of fingerprints at small distances, and strangers."""
    rng = random.Random(seed)
    out = [0, 2**64 - 1]
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8, 120])):
            base = x if rng.random() < 0.5 else out[-1]
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                base ^= 1 << bit
            out.append(base)
    return sorted(set(out))


def test_components_equal_brute_force(spark):
    for seed, block in ((1, 16_384), (2, 16)):
        fps = near_fingerprints(seed, 700)
        signed = [x - 2**64 if x >= 2**63 else x for x in fps]
        edges = links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block).distinct()
        at = {x: i for i, x in enumerate(signed)}
        got = {at[r["node"]]: at[r["root"]] for r in components(edges).collect()}
        want = brute_components(fps)
        groups = {}
        for i in range(len(fps)):
            groups.setdefault(got.get(i, i), set()).add(want[i])
        assert len(groups) == len(set(want)) and all(len(g) == 1 for g in groups.values())


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, prose):
    base = prose(3, 300)
    words = base.split()
    rows = [(10, base), (7, " ".join([*words[:150], "changed", *words[151:]])), (3, prose(4, 300)), (5, None), (4, ""), (6, " \n"),
            (None, base), (3, prose(4, 300)), (8, "one two"), (9, "ONE two")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())
    assert near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark, prose):
    base, other = prose(3, 300), prose(5, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    assert (fingerprint(base) ^ fingerprint(near)).bit_count() <= 4
    rows = [
        *[(None, prose(20 + i, 200)) for i in range(3)],  # null ids without a copy
        (None, prose(30, 200)), (None, prose(30, 200)),  # copies without any id
        (None, base), (1, base), (2, near), (2, other),  # 2 is a copy and the only one of another text
        (7, prose(40, 200)), (7, prose(40, 200)), (7, prose(41, 200)),
    ]
    assert len(set(brute_components([brute_fingerprint(t) for _, t in rows]))) == 8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [*[(None, prose(20 + i, 200)) for i in range(3)], (None, prose(30, 200)), (1, base), (2, other), (7, prose(40, 200)), (7, prose(41, 200))]
    assert sorted(map(tuple, drop_near_copies(docs).collect()), key=str) == sorted(want, key=str)
