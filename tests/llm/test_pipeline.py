from __future__ import annotations

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare
from urltriage.llm import queries
from urltriage.llm.common import stored, table
from urltriage.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ok, note, _ = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note


def test_stages(spark):
    """Each stage against what a direct computation finds in its own input."""
    docs = table(spark, SF, "documents")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in out["quality"][1]}
    assert len(kept & bad) <= 1 and len(good - kept) <= 1
    before, after = out["exact_dedup"]
    largest = {}
    for r in before:
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in after} == set(largest.values())
    before, after = out["near_dedup"]
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in before}
    left = {r["doc_id"] for r in after}
    for i, f in prints.items():
        near = [j for j, g in prints.items() if (f ^ g).bit_count() <= 4]
        assert (i in left) == (i == min(near)) or len(near) > 2
    before, after = out["pii"]
    assert len(before) == len(after)
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", r["text"]) for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = out["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r["length"] for r in after) == total
    whole = {r["doc_id"] for r in after}
    assert whole == {r["doc_id"] for r in before}
