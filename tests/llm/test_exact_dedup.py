from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from urltriage.llm.exact_dedup import BLOCK_KEYS, drop_exact_copies, exact_dedup

# Clashing column names must not matter.
SCHEMA = "doc_id long, text string, rid string, identity string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [k for k in ids if k is not None]
        sha = hashlib.sha256((t or "").encode()).hexdigest()
        out.append((i, max(known) if known else None, len(ids), sha))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, " a"), (None, "a"), (None, "q"), (None, "q"),
    (7, "abcabc"), (8, "abcabd"), (9, "abcabc"), (10, "abcabcabc"), (11, "é😀é😀é😀x"), (12, "é😀é😀é😀x"), (13, "\n\n\n\n"),
    (14, "abcabcabcabcabcabcabcabcabc"), (15, "abcabcabcabcabcabcabcabcabc"), (16, "abcabcabcabcabcabcabcabcab"),
]


def test_equals_brute_force(spark):
    for block in (1, 2, 3, 4096):
        got = exact_dedup(frame(spark, ROWS), block_chars=block)
        assert plain(got) == expected(ROWS), block
        kept = [r for r in got.collect() if r["kept"]]
        assert len(kept) == len({t or "" for _, t in ROWS})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_colliding_keys_are_noticed(spark):
    """A key that stands for two contents gives way to the next one."""
    keys = (lambda b: F.length(b).cast("long"), lambda b: F.ascii(b).cast("long"), *BLOCK_KEYS[2:])
    got = exact_dedup(frame(spark, ROWS), block_chars=3, block_keys=keys)
    assert plain(got) == expected(ROWS)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "c")]
    got = exact_dedup(frame(spark, rows)).collect()
    assert sorted((r["text_sha256"][:4], r["group_size"]) for r in got if r["kept"]) == sorted(
        (hashlib.sha256(t.encode()).hexdigest()[:4], n) for t, n in (("a", 2), ("b", 1), ("c", 2))
    )
    assert sorted(r["text"] for r in drop_exact_copies(frame(spark, rows)).collect()) == ["a", "b", "c"]
    none = frame(spark, ROWS).limit(0)
    assert exact_dedup(none).count() == 0
    assert drop_exact_copies(none).count() == 0


def test_copies_leave_all_columns(spark):
    docs = frame(spark, ROWS)
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({t or "" for _, t in ROWS})


def test_long_texts_and_a_hot_group(spark):
    long = "".join(chr(97 + i % 23) for i in range(300_000))
    rows = [(1, long), (2, long), (3, long + "x"), (4, "x" + long)] + [(i, "hot") for i in range(5, 400)]
    assert plain(exact_dedup(frame(spark, rows))) == expected(rows)


def test_no_python_on_the_way(spark):
    plan = exact_dedup(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
