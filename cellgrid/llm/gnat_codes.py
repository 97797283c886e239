"""Vector codes: every part of a vector gets the index of its nearest codebook entry, found in a geometric near-neighbour tree.

A tree holds the entries of one part position. Its nodes keep a few entries as split points; every
other entry belongs to its nearest split point, and each split point stores the range of its
distances to the entries of every child. A query computes its distances to the split points, and a
child whose range lies wholly outside (distance - best, distance + best) holds no entry that is as near as
the best so far, so the whole subtree is passed over. Ranges are widened by more than the rounding of the square roots and
the test is strict, so entries that tie are always met; squared distances, which decide, are integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, record_batch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
ARITY = 4  # split points of a node
SLACK = 2.0**-40  # relative; square roots of 62-bit integers are off by less than 2**-51


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances (len(x), len(y)) of integer rows, exact."""
    gap = x[:, None, :] - y[None, :, :]
    return np.einsum("qed,qed->qe", gap, gap)


@dataclass
class Node:
    points: np.ndarray  # split points, a row each
    index: np.ndarray  # their places in the codebook
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # [i, j]: range of distances from split point i to child j
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    children: list = field(default_factory=list)  # None where a child has no entry but its split point


def build(entries: np.ndarray, index: np.ndarray | None = None, arity: int = ARITY) -> Node:
    """The tree over the rows of ``entries``; split points are chosen far from each other, from the lowest index on."""
    index = np.arange(len(entries)) if index is None else index
    if len(entries) <= arity:
        return Node(entries, index)
    chosen, far = [0], squared(entries, entries[:1])[:, 0]
    while len(chosen) < arity and far.max() > 0:  # entries equal to a split point make no further one
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(entries, entries[chosen[-1:]])[:, 0])
    if len(chosen) == 1:
        return Node(entries, index)
    gaps = squared(entries[chosen], entries)
    owner = gaps.argmin(axis=0)
    owner[chosen] = np.arange(len(chosen))
    roots = np.sqrt(gaps.astype(np.float64))
    node = Node(entries[chosen], index[chosen], np.zeros((len(chosen),) * 2), np.zeros((len(chosen),) * 2))
    rest = np.ones(len(entries), dtype=bool)
    rest[chosen] = False
    for j in range(len(chosen)):
        members = np.flatnonzero(rest & (owner == j))
        if len(members):
            node.low[:, j] = roots[:, members].min(axis=1) * (1 - SLACK)
            node.high[:, j] = roots[:, members].max(axis=1) * (1 + SLACK)
        node.children.append(build(entries[members], index[members], arity) if len(members) else None)
    return node


def nearest(tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per query the index of its nearest entry (ties: the lower index), its squared distance, and how many distances were computed in all."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    place = np.zeros(len(queries), dtype=np.int64)
    computed = 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal computed
        gaps = squared(queries[rows], node.points)
        computed += gaps.size
        for i, at in enumerate(node.index):
            closer = (gaps[:, i] < best[rows]) | ((gaps[:, i] == best[rows]) & (at < place[rows]))
            best[rows[closer]], place[rows[closer]] = gaps[closer, i], at
        roots = np.sqrt(gaps.astype(np.float64))
        for j, child in enumerate(node.children):
            if child is None:
                continue
            reach = np.sqrt(best[rows].astype(np.float64))[:, None] * (1 + SLACK)  # of the best so far, so it shrinks child by child
            outside = (roots * (1 - SLACK) - reach > node.high[:, j]) | (roots * (1 + SLACK) + reach < node.low[:, j])
            near = rows[~outside.any(axis=1)]
            if len(near):
                visit(child, near)

    if len(queries) and len(tree.points):
        visit(tree, np.arange(len(queries)))
    return place, best, computed


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)


def _cut(batch_column: pa.Array, parts: int) -> np.ndarray:
    """(parts, rows, components of a part)"""
    x = _matrix(batch_column)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).swapaxes(0, 1))


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as ``array<int>``; null where the vector can have no code."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    # So that 4 * dimensions * bound**2, the greatest error there can be, fits a long.
    bound = F.lit(2.0**30) / F.sqrt(F.size(vector).cast("double"))
    codable = F.coalesce(F.forall(scaled, lambda x: F.coalesce(F.abs(x) <= bound, F.lit(False)) & ~F.isnan(x)), F.lit(False))
    return F.when(codable & (F.size(vector) > 0), F.transform(scaled, lambda x: F.floor(x).cast("int")))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Per part position the parts of the rows with the smallest ids: as many rows as ``entries`` come to the driver."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    x = np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), parts, -1)
    return [np.ascontiguousarray(x[:, p]) for p in range(parts)]


def refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: assign all parts, replace each used entry by the floored mean of its parts.

    A task adds up its rows and passes on one row an entry, so what is shuffled and collected follows the codebooks.
    """
    parts, width = len(books), books[0].shape[1]

    def add(batches):
        trees = [build(b) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for p, x in enumerate(_cut(batch.column(0), parts)):
                place, _, _ = nearest(trees[p], x)
                count[p] += np.bincount(place, minlength=len(count[p]))
                np.add.at(total[p], place, x)
        used = [(p, e) for p in range(parts) for e in np.flatnonzero(count[p])]
        yield record_batch({
            "part": ([p for p, _ in used], pa.int32()), "entry": ([int(e) for _, e in used], pa.int32()),
            "n": ([int(count[p][e]) for p, e in used], pa.int64()), "sums": ([total[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
        })

    sums = vectors.select("v").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    books = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # parts * entries rows at most
        books[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return books


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vectors`` with ``code`` (two hex digits a part) and ``error``, instead of ``v``."""
    parts, others = len(books), [f for f in vectors.schema.fields if f.name != "v"]

    def encode(batches):
        trees = [build(b) for b in books]
        for batch in batches:
            n = batch.num_rows
            codes, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
            for p, x in enumerate(_cut(batch.column(0), parts) if n else ()):
                codes[:, p], gap, _ = nearest(trees[p], x)
                error += gap
            digits = codes.tobytes().hex()
            text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            rest = {f.name: (batch.column(i + 1), None) for i, f in enumerate(others)}
            yield record_batch({**rest, "code": (text, pa.string()), "error": (error, pa.int64())})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["code string", "error long"])
    return vectors.select("v", *[f.name for f in others]).mapInArrow(encode, schema)


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def decode(code: str, books: list[np.ndarray]) -> list[int]:
    """The integer vector a code stands for."""
    return [int(x) for b, at in zip(books, bytes.fromhex(code)) for x in b[at]]


def encode_vectors(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that can be coded; other columns are left out.

    Codebooks start as the parts of the rows with the smallest ids (null ids last, then by vector; repeated rows count as rows) and are refined
    ``rounds`` times over all rows. Dropped are rows whose vector is null or empty or holds null or non-finite
    components, and, since an error must fit a long, those with a component of more than 2**30 / sqrt(dimensions) after
    scaling. Vectors must be cut into equal parts: those whose length is no multiple of ``parts``, or not the length of the vector with the smallest
    id, are dropped too. Fewer rows than ``entries`` give as many entries as rows. ``label_error`` adds ``error`` over equal
    labels, nulls together (null if the sum exceeds a long). An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = df.sparkSession
    made = df.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), integer_vector(F.col(vector_col), scale).alias("v"),
    ).where(F.col("v").isNotNull() & (F.size("v") % parts == 0))
    vectors = materialise(made, "integers")
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("width")).first()
    vectors = vectors.where(F.size("v") == (first.width if first else 0))
    if first is None:
        names = vectors.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return names.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit(codebooks_digest([])))
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds):
        books = refined(vectors, books)
    found = materialise(coded(vectors, books), "codes")
    # Errors combine before the shuffle; both sides of the join are stored or small, so a label of many rows can be split.
    totals = materialise(found.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "same"), "label-errors")
    joined = found.join(totals, F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
