"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

Pass one marks the filter positions of every text's hash and keeps those that two or more rows
marked. Pass two looks each row up there: a row with an unmarked position has no copy and passes
straight through; only the others shuffle, and are grouped by their full hash. Filter errors
send a few single rows into the shuffle, which finds them single; they never change a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh_column, materialise, text_or_empty

# A filter is a table of blocks of 32,768 positions (4 KB, the size of Spark's bitmaps). All
# positions of a hash lie in one block, so a look-up is one join with the broadcast blocks.
BLOCK_POSITIONS = 1 << 15
POSITIONS = 3
BITS_PER_ROW = 24
MAX_FILTER_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """Without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def filter_blocks(rows: int, max_bytes: int = MAX_FILTER_BYTES) -> int:
    """Blocks for ``rows`` rows at ``BITS_PER_ROW``, at most ``max_bytes`` in all: the bound of the broadcast."""
    wanted = math.ceil(max(rows, 1) * BITS_PER_ROW / BLOCK_POSITIONS)
    return max(1, min(wanted, max_bytes * 8 // BLOCK_POSITIONS))


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def _position(digest: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BLOCK_POSITIONS))


def repeated_positions(digests: DataFrame, digest_col: str, blocks: int, least: int = 2) -> DataFrame:
    """Pass one: per block a bitmap of the positions that at least ``least`` rows marked."""
    d = F.col(digest_col)
    marks = digests.select(
        _block(d, blocks).alias("block"),
        F.explode(F.array_distinct(F.array(*[_position(d, k) for k in range(POSITIONS)]))).alias("position"),
    )
    often = marks.groupBy("block", "position").count().where(F.col("count") >= least)
    return often.groupBy("block").agg(F.expr("bitmap_construct_agg(position)").alias("bits"))


def is_set(bits: Column, position: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` holds the position."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def possibly_repeated(digests: DataFrame, digest_col: str, repeated: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Pass two: adds ``flag``, false only where fewer rows than pass one asked for have the hash."""
    d, key, bits = F.col(digest_col), fresh_column(digests.columns, "block"), fresh_column(digests.columns, "bits")
    small = repeated.select(F.col("block").alias(key), F.col("bits").alias(bits))  # at most MAX_FILTER_BYTES
    joined = digests.withColumn(key, _block(d, blocks)).join(F.broadcast(small), key, "left")
    hit = F.lit(True)
    for k in range(POSITIONS):
        hit = hit & is_set(F.col(bits), _position(d, k))
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(key, bits)


def mark_copies(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """Every row with ``keep_id, group_size, kept, text_sha256`` (columns of these names are replaced).

    Texts are equal when identical after deleting white space (``normalised``); a null text counts
    as empty. Of equal texts the row with the most code points stays, then the smallest id (null
    ids last), then the first read: of rows alike in all three exactly one is kept.
    ``carry`` names the input columns to return (all by default). An empty table gives no rows.

    The rows are staged once with their hash, so both passes and every retry see the same rows.
    """
    own = ["keep_id", "group_size", "kept", "text_sha256"]
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in own]
    names = {n: fresh_column(df.columns + own, n) for n in ("digest", "size", "row", "flag", "key")}
    digest, size, row, flag, key = names.values()
    text = text_or_empty(text_col)
    staged = materialise(
        df.select(
            *carry, F.col(id_col).alias(key), F.sha2(normalised(text), 256).alias(digest), F.length(text).alias(size),
            F.monotonically_increasing_id().alias(row),
        ),
        "hashed",
    )
    blocks = filter_blocks(staged.count(), max_filter_bytes)
    repeated = materialise(repeated_positions(staged, digest, blocks), "filter")
    flagged = possibly_repeated(staged, digest, repeated, blocks, flag)

    def result(rows: DataFrame, keep: Column, group: Column, kept: Column) -> DataFrame:
        return rows.select(
            *carry, keep.alias("keep_id"), group.cast("long").alias("group_size"), kept.alias("kept"),
            F.col(digest).alias("text_sha256"),
        )

    single = result(flagged.where(~F.col(flag)), F.col(key), F.lit(1), F.lit(True))
    others = flagged.where(flag)
    best = F.struct((-F.col(size)).alias("s"), F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(row).alias("r"))
    # Counts combine before the shuffle, so a group of many copies is a row a task there. The groups
    # are staged: then Spark can split such a group in the join, which it cannot below an aggregate.
    groups = materialise(others.groupBy(digest).agg(F.count(F.lit(1)).alias("_group"), F.min(best).alias("_best")), "groups")
    joined = others.join(groups, digest)
    return single.unionByName(result(joined, F.col("_best.k"), F.col("_group"), F.col("_best.r") == F.col(row)))


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``mark_copies`` keeps, with the columns of ``df``."""
    own = {"keep_id", "group_size", "kept", "text_sha256"}
    if own & {c.lower() for c in df.columns}:
        packed = df.select(F.struct(*df.columns).alias("_whole"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        marked = mark_copies(packed, id_col="_id", text_col="_text", carry=["_whole"])
        return marked.where("kept").select("_whole.*")
    return mark_copies(df, id_col=id_col, text_col=text_col).where("kept").select(*df.columns)
