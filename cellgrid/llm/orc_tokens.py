"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Files hold the documents in ascending id order (one id range a file), so stripes and row groups
carry disjoint id ranges; a look-up by id reads a few row groups of one file, a scan reads
stripes in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_tokens import encoder
from .common import record_batch, text_or_empty
from .segment_pool import byte_batches, with_end

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_orc_tokens(
    df: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None, stripe_bytes: int = 64 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01,
) -> None:
    """Encode every whole text, append ``end_id`` and write ORC files in ascending id order.

    A null text counts as empty and gives the end id alone. Null ids come first; rows that share
    an id each keep a row, in the order of a hash of the text. Other columns are left out. An
    empty table gives files without rows. ``files`` is the number of id ranges (the session's
    shuffle partitions by default); a retried task writes the same file again.
    """
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        coder, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in byte_batches(batches, 1):
            flat, counts = with_end(*coder.encode(batch.column(1)), end_id)
            ends = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int32)))
            yield record_batch({
                "doc_id": (batch.column(0), pa.int64()), "part": (np.full(len(counts), part), pa.int32()),
                "start_in_part": (start + ends - counts, pa.int64()), "n_tokens": (counts, pa.int64()),
                "ids": (ids, None),
            })
            start += int(ends[-1]) if len(ends) else 0

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # The keys that Spark samples are short; rows that share an id may meet a range border.
    order = ["doc_id", F.xxhash64("text")]
    ranged = texts.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    (
        ranged.mapInArrow(encode, FILE_SCHEMA)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_rows)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_orc_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: the ids of all documents before, in file and row order.

    Offsets are prefix sums over the totals of the files: one number a file comes to the driver.
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    small = spark.createDataFrame(offsets, "part int, part_offset long")  # one row a file
    return rows.join(F.broadcast(small), "part").select(
        "doc_id", (F.col("part_offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; id statistics and Bloom filters skip the other stripes and row groups."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_checksums(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(3)
            flat = np.asarray(lists.values, dtype="<i4")
            at = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield record_batch({
                "doc_id": (batch.column(0), None), "start": (batch.column(1), None),
                "n_tokens": (batch.column(2), None), "ids_crc32": (crc, pa.int64()),
            })

    ordered = rows.select("doc_id", "start", "n_tokens", "ids")
    return ordered.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
