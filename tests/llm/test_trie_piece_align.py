from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from urltriage.llm.align import Aligner, align_documents
from urltriage.llm.piece import PieceBpe, piece_digests
from urltriage.llm.trie import EMPTY_SHA, ArtNode, conversation_trie, insert

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "ab ▁\n\t日é😀xyz.,'<|endoftext|>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- op12 ---------------------------------------------------------------------


def test_backtracking_equals_the_library():
    rng = random.Random(3)
    mine, library = PieceBpe(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", " ", "  a  b ", "x" * 5000, "the quick brown fox " * 200, "\u0000 ok", "▁▁▁ y"]
    for text in texts:
        ids = mine.encode(text)
        assert ids == library.encode(text), repr(text)
        assert mine.decode(ids) == library.decode(ids), repr(text)


def test_piece_digests_in_spark(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = [(1, "hello  world"), (2, None), (3, ""), (None, "日本 😀"), (1, "hello  world"), (5, "z" * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    got = sorted(piece_digests(docs, PIECE).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [tuple(r) for r in got] == want
    assert piece_digests(docs.limit(0), PIECE).count() == 0


def test_parts_are_shared_and_bounded(monkeypatch):
    mine, library = PieceBpe(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert mine.split("▁▁word,▁word.7日") == ["▁▁word", ",", "▁word", ".", "7", "日"]
    monkeypatch.setattr("urltriage.llm.piece.REMEMBERED", 20)
    monkeypatch.setattr("urltriage.llm.piece.PAIRS", 50)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("aerionst é,.7\n", k=rng.randint(0, 60)))
        ids = library.encode(text)
        assert mine.digests(text) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))), repr(text)
        assert mine.encode(text) == ids
        assert len(mine.digested) <= 20 and len(mine.digested.older) <= 80 and len(mine.parts) <= 20


def test_pair_checks_equal_merging_anew():
    mine, rng = PieceBpe(PIECE), random.Random(6)
    pieces = [p for p in rng.sample(sorted(mine.score), 1500) if mine.merged(list(p)) == [p]]
    for left, right in zip(pieces, pieces[1:], strict=False):
        assert mine.compatible[left][right] == (mine.merged(list(left + right)) == [left, right])


# -- op13 ---------------------------------------------------------------------


def brute_alignment(text, tool: Aligner):
    """Groups and links from the whole token lists, without windows or memory."""
    a, b = tool.tokens(text)
    if not a:
        return 0, 0, 0, "", Counter()
    spans = []
    for ids, size in ((a, tool.a_bytes), (b, tool.b_bytes)):
        at, out = 0, []
        for t in ids:
            out.append((at, at + len(size[t])))
            at += len(size[t])
        spans.append(out)
    shared = {e for _, e in spans[0]} & {e for _, e in spans[1]}
    groups, prev = [], 0
    for e in sorted(shared):
        ga = [t for t, (s, f) in zip(a, spans[0], strict=True) if s >= prev and f <= e]
        gb = [t for t, (s, f) in zip(b, spans[1], strict=True) if s >= prev and f <= e]
        groups.append((ga, gb, e))
        prev = e
    links = Counter(
        (x, y)
        for x, (s1, f1) in zip(a, spans[0], strict=True)
        for y, (s2, f2) in zip(b, spans[1], strict=True)
        if s1 < f2 and s2 < f1
    )
    text_groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
    return len(a), len(b), len(groups), sha(text_groups), links


def test_windows_equal_the_whole_alignment():
    rng = random.Random(7)
    tool = Aligner(BYTE, PIECE)
    words = ["the", "quick", "bröwn", "fox's", "日本", "  ", "\n", "1234", "can't", "<|endoftext|>", "😀", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "a▁b", "  lead", "end  ", "Ünïcödé"]
    for text in texts:
        assert tool.document(text) == brute_alignment(text, tool), repr(text)


def test_remembered_windows_are_bounded(monkeypatch):
    monkeypatch.setattr("urltriage.llm.align.REMEMBERED", 50)
    rng, tool = random.Random(8), Aligner(BYTE, PIECE)
    signs = "ab1 \n',.st(é" + "\t\xa0\u3000\x1c日"
    texts = ["".join(rng.choices(signs[: rng.choice([5, 12, 17])], k=rng.randint(0, 40))) for _ in range(600)]
    texts += ["don't 'tis, x''s a1b2", "<|endoftext|> a<|endoftext|>", " ", "\n", "x" * 3000]
    for text in texts:
        assert tool.document(text) == brute_alignment(text, tool), repr(text)
        assert len(tool.windows) <= 50 and len(tool.older) <= 50 + 40
    assert not any(len(w) > 64 for w in tool.windows)


def test_windows_are_shared_between_words_and_marks():
    tool = Aligner(BYTE, PIECE)
    tool.document("word, word. (word")
    assert set(tool.windows) == {" word", ",", ".", " (", "word"}


def test_large_pair_table_is_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta, beta"), (2, "beta can't"), (3, None)], "doc_id long, text string")
    few = sorted(map(tuple, align_documents(docs, BYTE, PIECE).collect()))
    monkeypatch.setattr("urltriage.llm.align.BROADCAST_PAIRS", 1)
    monkeypatch.setattr("urltriage.llm.align.BATCH_LINKS", 1)
    assert sorted(map(tuple, align_documents(docs, BYTE, PIECE).collect())) == few


def test_alignment_counts_in_spark(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gam", "ma", "δέλτα", "can't", "7", "x"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(60)]
    rows += [(60, None), (61, ""), (None, "alpha beta"), (3, rows[3][1]), (62, "a▁b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit(0))
    got = align_documents(docs, BYTE, PIECE).collect()
    tool = Aligner(BYTE, PIECE)
    per = [brute_alignment(t, tool) for _, t in rows]
    holders = Counter(pair for *_, links in per for pair in links)
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    want = []
    for (doc_id, _), (n_a, n_b, n_g, digest, links) in zip(rows, per, strict=True):
        want.append(
            (
                doc_id, n_a, n_b, n_g, sum(links.values()),
                sum(m for (x, y), m in links.items() if holders[(x, y)] == best[x]),
                sum(m * holders[p] for p, m in links.items()), digest,
            )
        )
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert align_documents(docs.limit(0), BYTE, PIECE).count() == 0


# -- op11 ---------------------------------------------------------------------


def brute_trie(rows):
    """Nodes by the contract, from plain lists."""
    turns = defaultdict(list)
    ids = set()
    for conv_id, turn, role, text in rows:
        if conv_id is None:
            continue
        ids.add(conv_id)
        turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    for t in turns.values():
        t.sort()
    rebuilt = {}
    for c in ids:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -((-c) % 100))
        own = [(r, x) for *_, r, x in turns[c]]
        head = [(r, x) for *_, r, x in turns.get(base, [])][:h]
        rebuilt[c] = tuple(head + own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, ms in members.items():
        d = len(node)
        kids = [k for k in members if len(k) == d + 1 and k[:d] == node]
        sub = [k for k in members if k[:d] == node]
        leaves = sum(1 for k in sub if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in sub))
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in sub)
        ends = sorted(c for c in ms if len(rebuilt[c]) == d)
        out.append(
            (
                min(ms), d, min(members[node[:-1]]) if d else None, len(ms), len(kids), leaves, saved,
                sha(",".join(map(str, ends))),
            )
        )
    return sorted(out, key=lambda r: (r[1], r[0], r[3], r[7]))


def test_art_layouts_grow_and_keep_children():
    root = ArtNode()
    for byte in range(256):
        insert(root, bytes([byte, 7]), byte)
    assert root.capacity == 256 and len(root.children()) == 256
    assert [c.value for c in root.children()] == list(range(256))
    insert(root, b"\x05\x07\x01", "deeper")
    assert root.find(5).find(1).value == "deeper"


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_trie_equals_brute_force(spark, partitions):
    rng = random.Random(partitions)
    texts = ["hi", "hello", "", None, "bye", "ok ok", "Ünï"]
    rows = []
    for c in [0, 1, 2, 5, 100, 101, 102, 150, 200, 205, 300, 301, 399, 7]:
        for turn in range(rng.randint(0, 6)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(None, 1, "user", "hi"), (9, None, None, None), rows[0], rows[0]]
    for c in range(400, 440):  # many copies of one conversation
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "answer")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "depth", F.lit(0)
    )
    got = conversation_trie(df, partitions=partitions).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[1], r[0], r[3], r[7])) == brute_trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(df).count() == 0
    only_null = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert conversation_trie(only_null).count() == 0


def test_turnless_conversations_are_in_the_root(spark):
    rows = [(c, None, None, None) for c in range(1, 12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_trie(df).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[1], r[0], r[3], r[7])) == brute_trie(rows)
    assert [r.n_convs for r in got if r.depth == 0] == [11]
