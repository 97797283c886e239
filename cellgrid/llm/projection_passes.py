"""Near-duplicate vectors by passes of sorted projections.

In each pass every vector gets the bits of many random projections as one key, all are sorted by
it, and each is compared with the bounded window of vectors before it; close vectors share long
key prefixes and so stand near each other in some pass. Links of all passes are joined to
components. Within a component every pair is then counted exactly, so the windows bound the search for
neighbours, not their number.

The number of passes follows from the number of distinct vectors, for which ``passes_for`` gives the share of pairs that
all passes miss. Vectors that crowd in one direction need more than that: the links of half the passes are held against the
components of the others, and a sample is compared with all vectors. Passes are added until both lie inside components, or until comparing all
pairs costs no more than the passes made; then all are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, materialise, record_batch
from .components import connected_components

COSINE = 0.9
PASSES = 24
KEY_BITS = 60
WINDOW = 256
RECALL = 0.99  # share of links to be found, by the model of passes_for and in the sample
LEAST_RECALL = 0.97  # by one half of the passes held against the other, which is a rough measure
SAMPLE = 1024  # vectors that are compared with all others to measure it
PAIR_BLOCK = 2048  # vectors that one task compares with as many others when all pairs are compared
BLOCK = 1024  # vectors of a component that one task counts against as many others
SEED = 11


def passes_for(vectors: int, cosine: float, window: int) -> int:
    """Passes that find ``RECALL`` of the pairs at ``cosine`` among so many vectors without a preferred direction.

    A bit of the key agrees with probability p for such a pair and 1/2 for others, so log2(vectors / window) common
    bits leave no more than a window's vectors between the two.
    """
    agree = 1 - math.acos(cosine) / math.pi
    hit = agree ** math.log2(max(1.0, vectors / window))
    return 1 if hit >= RECALL else math.ceil(math.log(1 - RECALL) / math.log1p(-hit))


def _planes(number: int, dim: int) -> np.ndarray:
    """Directions of pass ``number``; the same in every task."""
    return np.random.default_rng((SEED, number, dim)).standard_normal((dim, KEY_BITS))


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit vectors; different lengths are padded with zeros, which changes no cosine."""
    rows = [np.frombuffer(r, dtype="<f8") for r in raw]
    x = np.zeros((len(rows), max(map(len, rows), default=1)))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    # Scaled by the greatest component first: squares of huge or tiny ones would leave the range.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct_vectors(df: DataFrame, vector_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Stage tables: rows with their vector's digest; one row a distinct vector with its number of rows.

    Vectors of one direction are different here unless equal in every component.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.withColumn("vector", F.when(_valid(vector), F.transform(vector, lambda x: x + F.lit(0.0)))).withColumn(
        "digest", F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256)
    )

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            raw = [None if v is None else np.asarray(v, dtype="<f8").tobytes() for v in lists.to_pylist()]
            yield record_batch({
                "id": (batch.column(0), None), "raw": (raw, pa.binary()), "digest": (batch.column(2), None), "row": (batch.column(3), None),
            })

    packed = rows.select("id", "vector", "digest", F.monotonically_increasing_id().alias("row")).mapInArrow(
        pack, "id long, raw binary, digest string, row long"
    )
    staged = scratch.stage(packed, "vectors")
    nodes = staged.where("raw IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("row"))
    nodes = scratch.stage(nodes, "nodes")
    chosen = staged.select("row", "raw").join(nodes.select("row", "rows"), "row")
    return staged.join(nodes.select("digest", F.col("row").alias("node")), "digest", "left").drop("digest", "raw"), scratch.stage(chosen, "distinct")


def _window_links(x: np.ndarray, rows: np.ndarray, cosine: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between each vector and the ``window`` before it, thinned to a tree: (row, least row it reaches)."""
    n = len(rows)
    label = np.arange(n)
    for at in range(0, n, window):
        low, high = max(0, at - window), min(n, at + window)
        near = x[at:high] @ x[low:high].T >= cosine
        places = np.arange(low, high)
        near &= (places[None, :] <= np.arange(at, high)[:, None]) & (places[None, :] >= np.arange(at, high)[:, None] - window)
        while True:  # roots of linked vectors are joined, not the vectors alone, so that older trees are kept whole
            root = label[low:high]
            while (label[root] != root).any():
                root = label[root]
            label[low:high] = root
            mine = np.minimum(root[at - low :], np.where(near, root[None, :], n).min(axis=1))
            back = np.minimum(root, np.where(near, mine[:, None], n).min(axis=0))
            back[at - low :] = np.minimum(back[at - low :], mine)
            if (back == root).all():
                break
            np.minimum.at(label, root, back)
    while (label[label] != label).any():
        label = label[label]
    linked = label != np.arange(n)
    return rows[linked], rows[label[linked]]


def _passes(chosen: DataFrame, cosine: float, passes: range, window: int, parts: int, scratch: Scratch) -> DataFrame:
    """Tree links ``a, b`` found by the passes of these numbers."""

    def keys(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            x = _unit(raw)
            bits = np.left_shift(np.int64(1), np.arange(KEY_BITS, dtype=np.int64)[::-1])
            for number in passes:
                key = (x @ _planes(number, x.shape[1]) > 0) @ bits
                yield record_batch({
                    "pass": ([number] * len(raw), pa.int32()), "key": (key, pa.int64()), "row": (batch.column(0), None), "raw": (raw, pa.binary()),
                })

    keyed = chosen.select("row", "raw").mapInArrow(keys, "pass int, key long, row long, raw binary")
    order = ["pass", "key", "row"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def compare(batches):
        """Links inside the task, and its first and last vectors of each pass for the borders."""
        part, number = TaskContext.get().partitionId(), None
        tail: tuple[list[int], list[bytes]] = [], []  # the last ``window`` vectors of the pass so far
        head: tuple[list[int], list[bytes]] = [], []

        def border(side: int, at: int, rows: tuple[list[int], list[bytes]]) -> pa.RecordBatch:
            n = len(rows[0])
            return record_batch({
                "a": (rows[0], pa.int64()), "b": ([None] * n, pa.int64()), "pass": ([number] * n, pa.int32()),
                "border": ([at] * n, pa.int32()), "place": ([side * window + i for i in range(n)], pa.int32()), "raw": (rows[1], pa.binary()),
            })

        for batch in batches:
            passes_of = batch.column(0).to_numpy()
            for value in np.unique(passes_of):
                here = np.flatnonzero(passes_of == value)
                part_of = batch.slice(int(here[0]), len(here))
                if value != number:
                    if number is not None:
                        yield border(1, part, head)
                        yield border(0, part + 1, tail)
                    number, tail, head = int(value), ([], []), ([], [])
                rows, raw = part_of.column(2).to_pylist(), part_of.column(3).to_pylist()
                if len(head[0]) < window:
                    more = window - len(head[0])
                    head = head[0] + rows[:more], head[1] + raw[:more]
                rows, raw = tail[0] + rows, tail[1] + raw
                a, b = _window_links(_unit(raw), np.array(rows), cosine, window)
                n = len(a)
                yield record_batch({
                    "a": (a, pa.int64()), "b": (b, pa.int64()), "pass": ([None] * n, pa.int32()), "border": ([None] * n, pa.int32()),
                    "place": ([None] * n, pa.int32()), "raw": ([None] * n, pa.binary()),
                })
                tail = rows[-window:], raw[-window:]
        if number is not None:
            yield border(1, part, head)
            yield border(0, part + 1, tail)

    made = scratch.stage(ordered.mapInArrow(compare, "a long, b long, pass int, border int, place int, raw binary"), "passes")

    def meet(key, table):
        """The last vectors of one task and the first of the next: at most two windows."""
        if table.num_rows == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        table = table.sort_by("place")
        a, b = _window_links(_unit(table.column("raw").to_pylist()), table.column("a").to_numpy(), cosine, window)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    borders = made.where("border IS NOT NULL").groupBy("pass", "border").applyInArrow(meet, "a long, b long")
    return made.where("border IS NULL").select("a", "b").unionAll(borders)


def _sampled_links(chosen: DataFrame, found: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """``row, component, other, links``: links of the sampled vectors with all others, counted by the component of the other."""
    placed = chosen.join(found.withColumnRenamed("node", "row"), "row", "left").select("row", "raw", F.coalesce("component", "row").alias("component"))
    placed = scratch.stage(placed, "placed")
    sample = placed.orderBy(F.xxhash64(F.lit(SEED), "row"), "row").limit(SAMPLE).collect()
    rows, raws = np.array([r.row for r in sample], dtype=np.int64), [bytes(r.raw) for r in sample]
    own = np.array([r.component for r in sample], dtype=np.int64)

    def compare(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _unit(raws + batch.column(1).to_pylist())
            near = x[: len(rows)] @ x[len(rows) :].T >= cosine
            near &= rows[:, None] != batch.column(0).to_numpy()[None, :]
            one, two = np.nonzero(near)
            pairs, links = np.unique(np.stack([one, batch.column(2).to_numpy()[two]]), axis=1, return_counts=True)
            yield record_batch({
                "row": (rows[pairs[0]], pa.int64()), "component": (own[pairs[0]], pa.int64()), "other": (pairs[1], pa.int64()),
                "links": (links, pa.int64()),
            })

    made = placed.mapInArrow(compare, "row long, component long, other long, links long")
    return scratch.stage(made.groupBy("row", "component", "other").agg(F.sum("links").alias("links")), "sampled")


def _all_pairs(chosen: DataFrame, vectors: int, cosine: float) -> DataFrame:
    """Tree links ``a, b`` of all pairs, compared in blocks of bounded size."""
    blocks = math.ceil(vectors / PAIR_BLOCK)
    dealt = chosen.select("row", "raw", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "row", "raw"
    )

    def compare(key, table):
        rows = table.column("row").to_numpy()
        a, b = _window_links(_unit(table.column("raw").to_pylist()), rows, cosine, max(1, len(rows))) if len(rows) else (rows, rows)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("one", "two").applyInArrow(compare, "a long, b long")


def _inside(links: DataFrame, found: DataFrame) -> tuple[int, int]:
    """How many of the ``links`` there are, and how many lie inside the components ``found``."""
    first, second = (found.select(F.col("node").alias(n), F.col("component").alias(f"component_{n}")) for n in ("a", "b"))
    both = links.distinct().join(first, "a", "left").join(second, "b", "left")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("component_a") == F.col("component_b")).cast("int")).alias("inside")).first()
    return row.n, row.inside or 0


def _components(chosen: DataFrame, cosine: float, passes: int, window: int, parts: int, scratch: Scratch) -> DataFrame:
    """``node, component`` by as many passes as the vectors need.

    The second half of the passes is held against the first: the share of its links that lie inside the first half's components is what
    one half finds of all links, however rare they are. A sample compared with all vectors sees what no pass finds.
    """
    vectors = chosen.count()
    step, done, older = max(passes, passes_for(vectors, cosine, window)), 0, None
    while True:
        half = done + (step + 1) // 2
        first = _passes(chosen, cosine, range(done, half), window, parts, scratch)
        links = first if older is None else older.unionAll(first)
        found = scratch.stage(connected_components(links, scratch.stage), "components")
        if half < done + step:
            second = scratch.stage(_passes(chosen, cosine, range(half, done + step), window, parts, scratch), "links")
            made, inside = _inside(second, found)
            missed = 1 - inside / made if made else 0.0
            if made > inside:
                links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(second)
                found = scratch.stage(connected_components(links, scratch.stage), "components")
        else:
            missed = 0.0
        # Two equal halves miss a link independently; later on the first half is the greater one, and this errs to the safe side.
        by_passes = 1 - (missed**2 if older is None else missed)
        done += step
        sampled = _sampled_links(chosen, found, cosine, scratch)
        within = F.sum(F.when(F.col("component") == F.col("other"), F.col("links")).otherwise(0)) / F.sum("links")
        recall = sampled.groupBy("row").agg(within.alias("share")).agg(F.avg("share")).first()[0]
        enough = by_passes >= LEAST_RECALL and (recall is None or recall >= RECALL)
        if enough and (recall is None or recall == 1):
            return found
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(
            sampled.select(F.col("component").alias("a"), F.col("other").alias("b"))
        )
        whole = not enough and done * 2 * window >= vectors
        if whole:
            links = links.unionAll(_all_pairs(chosen, vectors, cosine))
        if whole or enough:
            return scratch.stage(connected_components(links, scratch.stage), "components")
        # Not the sample's own links: they would raise what is measured next.
        older, step = found.select(F.col("node").alias("a"), F.col("component").alias("b")), done


def _counts(chosen: DataFrame, found: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """``row, links``: how many rows (with copies) link with a vector, without its own copies.

    A component's core are the vectors within half the linking angle of one member: all pairs of
    them link, by the triangle inequality, and are counted without being compared. All other
    pairs are compared in blocks of bounded size; a block pair gives one number a vector.
    """
    core_cosine = math.cos(math.acos(cosine) / 2) + 1e-9
    placed = chosen.join(found.withColumnRenamed("node", "row"), "row")
    centres = placed.where("row = component").select("component", F.col("raw").alias("centre"))
    placed = placed.join(centres, "component")

    def near_centre(batches):
        for batch in batches:
            raw, centre = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            cos = (_unit(raw + centre)[: len(raw)] * _unit(raw + centre)[len(raw) :]).sum(axis=1) if raw else np.zeros(0)
            yield record_batch({
                **{n: (batch.column(i), None) for i, n in enumerate(("component", "row", "rows", "raw"))}, "core": (cos >= core_cosine, pa.bool_()),
            })

    cored = scratch.stage(
        placed.select("component", "row", "rows", "raw", "centre").mapInArrow(
            near_centre, "component long, row long, rows long, raw binary, core boolean"
        ),
        "cored",
    )
    sizes = cored.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("rows")).otherwise(0)).alias("core_rows"), F.sum(F.lit(1) - F.col("core").cast("int")).alias("outer"),
        F.count(F.lit(1)).alias("nodes"),
    )
    sizes = scratch.stage(sizes, "sizes")
    within_core = cored.where("core").join(sizes, "component").select("row", (F.col("core_rows") - F.col("rows")).alias("links"))

    # Pairs with at least one vector outside the core: outer blocks against all blocks of the component.
    open_rows = cored.join(sizes.where("outer > 0"), "component")
    blocks = F.ceil(F.col("nodes") / BLOCK).cast("int")
    dealt = open_rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "row", "rows", "raw", "core"
    )

    def count(key, table):
        if table.num_rows == 0:
            return pa.table({"row": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        one, two = key[1].as_py(), key[2].as_py()
        block = table.column("block").to_numpy()
        core = np.asarray(table.column("core").to_pylist(), dtype=bool)
        x, rows = _unit(table.column("raw").to_pylist()), table.column("rows").to_numpy()
        links = np.zeros(len(rows), dtype=np.int64)
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            hit = x[part] @ x[right].T >= cosine
            hit &= ~(core[part][:, None] & core[right][None, :])
            if one == two:
                hit &= part[:, None] != right[None, :]
            links[part] += hit @ rows[right]
            if one != two:
                links[right] += rows[part] @ hit
        return pa.table({"row": table.column("row"), "links": pa.array(links)})

    counted = pairs.groupBy("component", "one", "two").applyInArrow(count, "row long, links long")
    return within_core.unionAll(counted).groupBy("row").agg(F.sum("links").alias("links"))


def near_vectors(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Cosines are in double precision. Vectors that are null, zero or hold null or non-finite
    components link with nothing, copies of them included. Repeated rows and equal vectors link with each other.
    ``component_id`` is the least id reachable by links; ``kept`` where it is the row's own. A
    row without id is its own, has a null component alone, and is kept. Vectors of different lengths are compared as if the
    shorter had zeros at its end. Other columns are left out; an empty table gives no rows. ``passes`` is the least number
    of passes; more are made where the vectors need them.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("input"))
    rows, chosen = _distinct_vectors(named, "input", scratch)
    rows = scratch.stage(rows, "rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _components(chosen, cosine, passes, window, parts, scratch)
    counts = scratch.stage(_counts(chosen, found, cosine, scratch), "counts")
    nodes = chosen.select(F.col("row").alias("node"), "rows").join(found, "node", "left").join(counts.withColumnRenamed("row", "node"), "node", "left")
    nodes = nodes.select(
        "node", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    joined = materialise(rows.join(nodes, "node", "left"), "joined")
    scratch.clear()
    least = joined.where("node IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"))
    return joined.join(least, "component", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
        F.when(F.col("node").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("least"))).alias("kept"),
    )
