"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks. Equal blocks get the same integer name,
different blocks different ones. Then the names of adjacent pairs are named in the
same way, level by level, until one integer is left for each text. Two texts have
the same integer exactly if they are identical.

Names come from sorting. A block is sorted by a 64-bit key of its content, so that
only keys travel with the documents. That the key stands for one content only is
verified on the distinct blocks of the whole table; if two contents share a key,
the run is repeated with a longer key and at last with the content itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urltriage.llm.common import col, fresh, stored

#: Characters of a block.
BLOCK_CHARS = 4096
#: Groups in which names are ranked; a name is level, group and rank in one long.
RANK_GROUPS = 1 << 14

#: Sort keys of a block, tried in this order; the last one is the content.
BLOCK_KEYS: tuple[Callable[[Column], Column], ...] = (
    lambda b: F.xxhash64(b),
    lambda b: F.sha2(b, 256),
    lambda b: b,
)

NO_PARTNER = -1


def _blocks(text: Column, block_chars: int) -> Column:
    # The pattern runs over the text once; repeated substring() would rescan it.
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _ambiguous(blocks: DataFrame) -> bool:
    """Whether a key of ``blocks`` (key, block) stands for two contents."""
    contents = blocks.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return not contents.where("n > 1").isEmpty()


def _named(rows: DataFrame, parts: Sequence[str], level: int) -> DataFrame:
    """Replaces ``parts`` by one integer name: equal parts, equal name."""
    order = Window.partitionBy("rank_group").orderBy(*parts)
    names = (
        rows.select(*parts)
        .distinct()
        .withColumn("rank_group", F.pmod(F.xxhash64(*parts), F.lit(RANK_GROUPS)))
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .select(
            *parts,
            (
                F.lit(level << 56)
                + F.shiftleft(F.col("rank_group"), 40)
                + F.col("rank")
            ).alias("name"),
        )
    )
    return rows.join(names, list(parts)).drop(*parts)


def _paired(rows: DataFrame) -> DataFrame:
    even = F.col("pos") % 2 == 0
    return (
        rows.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        .agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_PARTNER)).alias("right"),
            F.ceil(F.first("n") / 2).cast("int").alias("n"),
        )
    )


def name_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    block_keys: Sequence[Callable[[Column], Column]] = BLOCK_KEYS,
) -> DataFrame:
    """One row per document: ``rid``, ``doc_id``, ``text_sha256``, ``identity``.

    ``identity`` is equal exactly where the texts are identical. Null counts as the
    empty text. ``rid`` tells repeated rows apart. Other columns are ignored.
    """
    source = docs.select(
        col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")
    )
    for block_key in block_keys:
        blocks = source.select(F.explode(_blocks(F.col("text"), block_chars)).alias("block"))
        if not _ambiguous(blocks.select(block_key(F.col("block")).alias("key"), "block")):
            break
    else:
        raise ValueError("the last block key does not tell the blocks apart")
    coded = stored(
        source.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.sha2(F.col("text"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("text"), block_chars), block_key).alias("keys"),
        ),
        "block-keys",
    )
    longest = coded.agg(F.max(F.size("keys"))).first()[0] or 1
    rows = coded.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    rows = stored(_named(rows, ["key"], 0), "block-names")
    done = [rows.where("n = 1")]
    # A level for each halving of the longest text; few rows are left after the first ones.
    for level in range(1, (longest - 1).bit_length() + 1):
        rows = stored(_named(_paired(rows.where("n > 1")), ["left", "right"], level), "pair-names")
        done.append(rows.where("n = 1"))
    identities = done[0]
    for part in done[1:]:
        identities = identities.unionByName(part)
    return coded.drop("keys").join(identities.select("rid", F.col("name").alias("identity")), "rid")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Groups of identical texts, one row per document, dropped ones too.

    Columns: ``doc_id``, ``keep_id`` (largest id of the group), ``group_size``,
    ``kept``, ``text_sha256``, ``identity``. Null text counts as empty. A null id
    is smaller than any other; if a group has its largest id in several rows,
    one of them stays. An empty table gives an empty result. Other columns are
    ignored.
    """
    named = stored(name_texts(docs, id_col, text_col, **options), "text-names")
    # Written, so that both sides of the join are plain shuffles and a large group can be split.
    groups = stored(
        named.groupBy("identity").agg(
            F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size")
        ),
        "text-groups",
    )
    return named.join(groups, "identity").select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        "text_sha256",
        "identity",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text, all columns as they are."""
    kept = stored(exact_dedup(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256"), "kept")
    sha, kept_id, kept_sha = fresh(docs.columns, "sha", "kept_id", "kept_sha")
    kept = kept.toDF(kept_id, kept_sha)
    marked = docs.withColumn(sha, F.sha2(F.coalesce(col(text_col), F.lit("")), 256))
    out = marked.join(
        kept, (col(id_col).eqNullSafe(F.col(kept_id))) & (F.col(sha) == F.col(kept_sha)), "left_semi"
    )
    # Rows that share both id and text all pass the join above; which one of them stays is open.
    ids = docs.groupBy(col(id_col).alias("id")).count().where("count > 1")
    if not ids.isEmpty():
        id_sha = [c for c in out.columns if c.lower() in (id_col.lower(), sha.lower())]
        out = out.dropDuplicates(id_sha)
    return out.drop(sha)
