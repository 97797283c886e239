"""Concatenate and cut: documents follow one another in one id stream, cut into fixed windows.

Pass one encodes the texts and keeps each task's running starts; prefix sums over the task totals
then give every document its place in the stream. Pass two cuts at the window borders by
arithmetic, without a shuffle: a document that crosses borders gives one record a window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .byte_tokens import encoder
from .common import materialise, record_batch, row_batches, text_or_empty
from .segment_pool import byte_batches, with_end

STAGE_SCHEMA = "doc_id long, part int, start_in_part long, n long, ids binary"
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def pack(
    df: DataFrame, tokenizer: str, *, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents in windows of ``window`` ids; only the last window is not full.

    Each document is its ids, then ``end_id``; a null text counts as empty and gives the end id
    alone, so every row has at least one piece. Rows that share an id are separate documents.
    Other columns are left out. Columns: ``PIECE_SCHEMA``; ``ids`` are little-endian unsigned
    16-bit integers when the vocabulary allows, else 32-bit, and left out unless ``with_ids``.
    An empty table gives no piece.
    """
    spark = df.sparkSession

    def encode(batches):
        coder, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = "<u2" if max(len(coder.lengths) - 1, end_id) < 1 << 16 else "<u4"
        for batch in byte_batches(batches, 1):
            flat, counts = with_end(*coder.encode(batch.column(1)), end_id)
            flat, ends = flat.astype(width), np.cumsum(counts)
            at = pa.py_buffer((np.concatenate([[0], ends]) * flat.itemsize).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, at, pa.py_buffer(flat)])
            yield record_batch({
                "doc_id": (batch.column(0), None), "part": (np.full(len(counts), part), pa.int32()),
                "start_in_part": (start + ends - counts, pa.int64()), "n": (counts, pa.int64()), "ids": (ids, None),
            })
            start += int(ends[-1]) if len(ends) else 0

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    staged = materialise(texts.mapInArrow(encode, STAGE_SCHEMA), "encoded")

    totals = staged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a task
    offsets, at = [], 0
    for part, n in totals:
        offsets.append((part, at))
        at += n
    small = spark.createDataFrame(offsets, "part int, part_offset long")

    def cut(batches):
        for batch in row_batches(batches):
            ids_of, begins, counts = batch.column(3), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            doc, start, length, crc, tokens, sequence, offset, piece = [], [], [], [], [], [], [], []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                raw, n, g = ids_of[i].as_buffer(), int(counts[i]), int(begins[i])
                width = raw.size // n
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                a = 0
                while a < n:
                    b = min(n, a + window - (g + a) % window)
                    doc.append(doc_id)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                    tokens.append(n)
                    sequence.append((g + a) // window)
                    offset.append((g + a) % window)
                    if with_ids:
                        piece.append(ids[a:b].tobytes())
                    a = b
            out = {
                "doc_id": (doc, pa.int64()), "start": (start, pa.int64()), "length": (length, pa.int64()),
                "ids_crc32": (crc, pa.int64()), "doc_tokens": (tokens, pa.int64()),
                "sequence_id": (sequence, pa.int64()), "offset": (offset, pa.int64()),
            }
            if with_ids:
                out["ids"] = (piece, pa.binary())
            yield record_batch(out)

    placed = staged.join(F.broadcast(small), "part").select(
        "doc_id", (F.col("part_offset") + F.col("start_in_part")).alias("begin"), "n", "ids"
    )
    return placed.mapInArrow(cut, PIECE_SCHEMA if with_ids else PIECE_SCHEMA.rpartition(",")[0])


def boundary_records(pieces: DataFrame) -> DataFrame:
    """The pieces that continue a document from the window before."""
    return pieces.where(F.col("start") > 0)
