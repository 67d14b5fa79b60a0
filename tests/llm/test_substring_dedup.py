from __future__ import annotations

import random

import numpy as np

from urltriage.llm.substring_dedup import Passages, chunks, cut_points, drop_repeats, repeated_passages


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))


def planted(seed=1, pairs=40):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(pairs):
        passage = words(rng, 60)
        for _ in range(2):
            rows.append((k, f"{words(rng, rng.randint(1, 90))} {passage} {words(rng, 30)}"))
            k += 1
    return rows, [(1000 + i, words(rng, 150)) for i in range(200)]


def test_planted_passages(spark):
    rows, clean = planted()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows + clean], "doc_id long, text string, start int")
    got = repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    texts = dict(rows)
    for r in got:
        passage = texts[r["doc_id"]][r["start"] : r["stop"]]
        # A word at an edge may be shared by chance.
        assert passage.split(" ", 3)[-1].rsplit(" ", 3)[0] in texts[r["doc_id"] ^ 1] and r["n_words"] >= 24
        assert r["doc_id"] & ~1 in r["first_doc_ids"]
        assert r["removed_words"] >= 20 if r["doc_id"] % 2 else r["removed_words"] <= 4
    left = {r["doc_id"]: r["text"] for r in drop_repeats(docs).collect()}
    assert all(left[i] == t for i, t in clean)
    assert all(len(left[i]) > len(t) - 20 for i, t in rows if i % 2 == 0)
    assert all(len(left[i]) < len(t) - 100 for i, t in rows if i % 2)


def test_shifted_and_edited_texts_share_chunks(spark):
    rng = random.Random(2)
    text = words(rng, 400)
    docs = spark.createDataFrame([(1, text), (2, "inserted words " + text), (3, text[:900] + "é change " + text[900:])], "doc_id long, text string")
    found = {i: set() for i in (1, 2, 3)}
    for r in chunks(docs, "doc_id", "text", Passages()).collect():
        found[r["doc_id"]].add(r["digest"])
    for other in (2, 3):
        assert len(found[1] & found[other]) > 0.9 * len(found[1])


def test_chunks_cover_the_text(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["a", "é😀 ü" * 50, words(rng, 300), "x" * 5000, "Same Same " * 400, " \n ", "中文" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for slab in (1 << 22, 100):
        monkeypatch.setattr("urltriage.llm.substring_dedup.SLAB_BYTES", slab)
        for i, text in enumerate(texts):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            cuts, _ = cut_points(data, Passages())
            assert all(0 < c < len(data) and data[c] & 0xC0 != 0x80 for c in cuts), i
    rows = sorted(map(tuple, chunks(docs, "doc_id", "text", Passages()).select("doc_id", "no", "start", "stop", "words").collect()))
    for i, text in enumerate(texts):
        own = [r for r in rows if r[0] == i]
        assert [r[1] for r in own] == list(range(len(own)))
        assert own[0][2] == 0 and own[-1][3] == len(text)
        assert all(a[3] == b[2] for a, b in zip(own, own[1:], strict=False))


def test_digests_come_without_positions(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(1, words(rng, 90)), (2, "中文" * 200), (3, "é a" * 40)], "doc_id long, text string")
    whole = chunks(docs, "doc_id", "text", Passages())
    lean = chunks(docs, "doc_id", "text", Passages(), positions=False)
    assert lean.columns == ["digest", "doc_id"]
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, whole.select("digest", "doc_id").collect()))


def test_odd_rows(spark):
    rng = random.Random(4)
    t = words(rng, 80)
    rows = [(1, t), (1, t), (None, t), (2, None), (3, ""), (4, f"{words(rng, 30)} {words(rng, 30)}"), (5, (words(rng, 40) + " ") * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeated_passages(docs).count() == 0, "one document, repeated; and repeats within a document"
    assert drop_repeats(docs).count() == len(rows)
    assert repeated_passages(docs.limit(0)).count() == 0
    more = docs.union(spark.createDataFrame([(9, t)], "doc_id long, text string"))
    assert {r["doc_id"] for r in repeated_passages(more).collect()} == {1, 9}


def unspaced(rng, kind, n):
    if kind == "base64":
        return "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    first, size = (0x4E00, 3000) if kind != "thai" else (0x0E01, 46)
    signs = [chr(first + rng.randrange(size)) for _ in range(n)]
    if kind == "wide space":
        signs[5::12] = "\u3000" * len(signs[5::12])
    return "".join(signs)


def test_text_without_white_space(spark):
    rng, rows, clean, whole = random.Random(5), [], [], []
    for kind in ("chinese", "thai", "wide space", "base64"):
        for _ in range(10):
            passage = unspaced(rng, kind, 400)
            rows += [unspaced(rng, kind, rng.randint(50, 300)) + passage + unspaced(rng, kind, 90) for _ in range(2)]
        whole += [unspaced(rng, kind, 500)] * 2
        clean += [unspaced(rng, kind, 1000) for _ in range(10)]
    texts = [*rows, *whole, *clean]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == set(range(len(rows) + len(whole)))
    for r in got:
        assert texts[r["doc_id"]][r["start"] + 20 : r["stop"] - 20] in texts[r["doc_id"] ^ 1] and r["n_words"] >= 24
    left = {r["doc_id"]: r["text"] for r in drop_repeats(docs).collect()}
    assert all(left[i] == t for i, t in enumerate(texts) if i >= len(rows) + len(whole))
    # A sign at an edge may be shared by chance.
    assert all(len(left[i]) > len(t) - 20 for i, t in enumerate(texts) if i % 2 == 0)
    assert all(len(left[i]) < len(texts[i]) - 250 for i in range(1, len(rows), 2))
    assert not any(left[i] for i in range(len(rows) + 1, len(rows) + len(whole), 2))
