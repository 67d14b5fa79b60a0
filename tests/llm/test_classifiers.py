from __future__ import annotations

import random

from pyspark.sql import functions as F

from urltriage.llm.language import Sample, count_ngrams, identify
from urltriage.llm.quality import Prior, drop_low_quality, score_quality, style

SYLLABLES = {"en": ["the", "ing", "and", "er"], "fr": ["eau", "oux", "que", "é"], "de": ["sch", "ung", "ich", "ä"]}


def text_in(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_language_of_held_out_documents(spark):
    rng = random.Random(1)
    rows = [(i, text_in(lang := rng.choice(list(SYLLABLES)), rng, rng.randint(3, 60)), lang, "c") for i in range(900)]
    rows += [(2000, None, "en", "c"), (2001, "12 34 !", "en", "c"), (2002, "the ing", None, "c"), (None, "eau que oux", "fr", "c"),
             (2003, "", "en", "c"), (2004, text_in("de", rng, 20_000), "de", "c"), (2004, "sch ung", "de", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(docs, sample=Sample(texts=80)).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows}
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 2000]
    assert len(held) > 200 and sum(r["lang_pred"] == want[r["doc_id"]] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [by_id[i]["lang_pred"] for i in (2000, 2001, 2003)] == ["und"] * 3
    assert (by_id[None]["held_out"], by_id[None]["lang_pred"]) == (False, "fr")
    expected = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("h")).collect()}
    assert all(r["held_out"] == (expected[r["doc_id"]] or False) for r in got)


def test_language_without_training(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify(docs).collect()} == {"und"}
    assert identify(docs.limit(0)).count() == 0


def test_ngrams_of_slabs(monkeypatch):
    text = text_in("fr", random.Random(2), 50)
    whole = count_ngrams(text)
    assert whole.sum() > 3 * 50
    assert (count_ngrams(text.upper()) == whole).all()


def shout(rng, n):
    return " ".join(w.upper() + "!!" for w in text_in("en", rng, n).split())


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0 if i % 3 else i % 2 == 0  # more bad ones at site0
        rows.append((i, shout(rng, 40) if bad else text_in("en", rng, 40), f"site{i % 3}" if i % 7 else None, "en", "c"))
        if i % 2:
            labels.append((i, 0 if bad else 1))
    rows += [(1000, None, "site1", None, "c"), (1001, "", "rare", "en", "c"), (None, text_in("en", rng, 30), "rare", "fr", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, site string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in score_quality(docs, known).collect()}
    assert len(got) == len(rows)
    for i in range(600):
        bad = i % 5 == 0 if i % 3 else i % 2 == 0
        assert got[i]["kept"] != bad, i
    assert got[3]["site_quality"] < got[1]["site_quality"]
    left = drop_low_quality(docs, known)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if r["kept"]}
    assert all(r["kept"] for r in score_quality(docs, known.limit(0)).collect())
    assert score_quality(docs.limit(0), known).count() == 0
    few = score_quality(docs, known, prior=Prior(sample=100)).collect()
    assert sum(r["kept"] != got[r["doc_id"]]["kept"] for r in few) < 6


def test_style_of_slabs(monkeypatch):
    assert style(None) == style(" \n") == (0.0,) * 10
    long = "word " * 1000
    assert style(long)[2] == 1.0 and style(long)[3] > 0.99
