from __future__ import annotations

import public_tokenizers
import pytest

from urltriage.llm.lengths import at_limits, length_histogram, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_sums(spark):
    lengths = [0, 0, 3, 3, 3, 900, 1023, 1024, 1025, 5000, 5000, 70_000]
    hist = length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    got = {r["n_tokens"]: r for r in hist.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        within = [x for x in lengths if x <= n]
        assert r["n_docs"] == lengths.count(n)
        assert (r["docs_within"], r["tokens_within"]) == (len(within), sum(within))
        assert (r["docs_beyond"], r["tokens_beyond"]) == (len(lengths) - len(within), sum(lengths) - sum(within))
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(len(within) / len(lengths))
    for r in at_limits(hist, [0, 2, 4, 1024, 10**6]).collect():
        limit = r["context"]
        assert r["truncated_tokens"] == sum(min(x, limit) for x in lengths)
        assert r["docs_within"] == sum(x <= limit for x in lengths)


def test_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0), (None, "a" * 40_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r["n_tokens"]: r["n_docs"] for r in token_counts(docs, PATH).collect()}
    assert got[0] == 2 and got[2] == 2 and sum(got.values()) == 5
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_groups_are_refused():
    with pytest.raises(TypeError):
        length_histogram(None, group_cols=("lang",))
