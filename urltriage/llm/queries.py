"""Registered queries of the corpus operators and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from urltriage.llm.align import align_documents
from urltriage.llm.bpe import encode_digests
from urltriage.llm.common import table
from urltriage.llm.exact_dedup import exact_dedup
from urltriage.llm.language import identify
from urltriage.llm.lengths import token_counts
from urltriage.llm.packing import pack
from urltriage.llm.piece import piece_digests
from urltriage.llm.pii import find_pii
from urltriage.llm.quality import score_quality
from urltriage.llm.simhash import near_duplicates
from urltriage.llm.substring_dedup import repeated_passages
from urltriage.llm.topk import top_k
from urltriage.llm.trie import conversation_trie
from urltriage.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op9_exact_dedup",
    """select doc_id,
    max(doc_id) over w as keep_id,
    count(*) over w as group_size,
    doc_id = max(doc_id) over w as kept,
    sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by block naming."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("identity")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by SimHash and segment popcounts."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into windows of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found by strict patterns and boosted candidates."""
    return find_pii(table(spark, sf_dir, "documents")).drop("text_sha256")


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents within their source and language."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("text_sha256")


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded with a byte-level vocabulary."""
    return encode_digests(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


@query(
    "op10_topk",
    """with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.x) = len(c.x)
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest inner products of each query vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents by nearest centroids."""
    return identify(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with totals for every limit."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


@query("op11_conversation_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of rebuilt conversations by adaptive radix trees."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_sentencepiece")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded by a SentencePiece BPE model, by backtracking."""
    return piece_digests(table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned by whitespace anchors, with corpus-wide link counts."""
    return align_documents(
        table(spark, sf_dir, "documents"),
        tokenizers.path("byte_bpe_50k.json"),
        tokenizers.path("piece_bpe_32k.model"),
    )
