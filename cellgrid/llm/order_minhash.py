"""Near-duplicates by order min-hash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number, so all
are distinct. A sketch takes the few shingles least under a random hash and keeps them in text order;
equal sketches need the same shingles in the same order. Candidates share one of many sketches.
A pair's similarity is that of the best order-preserving match of labelled shingles:
matched / (all of both - matched). Links need 0.8; classes are the components of the links.

Equal word sequences are one node from the start, as are texts without words that hold the same signs. In a bucket all members are compared with a leader.
Where members are left in different components that might still link, those outside the largest one are compared with all, in blocks of
bounded size. So groups of copies cost a comparison or two a member, and no link that a bucket holds between components is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, claim_memory, fresh_column, materialise, record_batch, row_batches, text_or_empty
from .components import SALTS, connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SAMPLED = 6
SKETCHES = 36
SUBSET_SHINGLES = 8  # texts up to so many shingles also have the key of all but one of them
MEMORY_WORDS = 500_000

_WORDS = re.compile(r"\w+").findall
_KNOWN: dict[str, int] = {}


def word_ids(text: str) -> np.ndarray:
    """64-bit hashes of the lower-case words."""
    if len(_KNOWN) > MEMORY_WORDS:
        _KNOWN.clear()
    words = _WORDS(text.lower())
    for w in set(words).difference(_KNOWN):
        _KNOWN[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def labelled_shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of (shingle, occurrence number) in text order; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - width + 1, dtype=np.uint64)
        for o in range(width):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[o : n - width + 1 + o])
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        if first.all():
            return h
        begin = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        label = np.empty(len(h), dtype=np.uint64)
        label[order] = (np.arange(len(h)) - begin).astype(np.uint64)
        return np.where(label > 0, _mixed(h + label * np.uint64(0xD1B54A32D192ED03)), h)


_MULTIPLIERS = np.random.default_rng(21).integers(1 << 62, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXPECTED = 24  # places below the threshold tried first


def _least_places(h: np.ndarray, sampled: int) -> np.ndarray:
    """Per row the places of its ``sampled`` least values, ascending places."""
    n = h.shape[1]
    if n > 4 * _EXPECTED:
        row, place = np.nonzero(h < np.uint64(int(_EXPECTED / n * (1 << 64))))
        begin = np.searchsorted(row, np.arange(len(h) + 1))
        if np.diff(begin).min() >= sampled:
            order = np.lexsort((h[row, place], row))
            return np.sort(place[order[begin[:-1, None] + np.arange(sampled)]], axis=1)
    return np.sort(np.argpartition(h, sampled - 1, axis=1)[:, :sampled], axis=1)


def _keys(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One hash a row of shingles, from the row's start value on."""
    for k in range(rows.shape[1]):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def sketches(shingles: np.ndarray, sampled: int = SAMPLED, number: int = SKETCHES) -> np.ndarray:
    """``number`` hashes, each of the ``sampled`` shingles least under its own hash, in text order.

    Shingle hashes are well mixed, so odd multiples of them order the shingles at random. Where both texts of a link have at most
    ``SUBSET_SHINGLES`` shingles, one is the other or lacks one shingle of it: texts of so few have the key of all their shingles, and those of
    five or more, up to one more than that, the keys of all but one, so such a link is never missed.
    """
    n = len(shingles)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    found = []
    with np.errstate(over="ignore"):
        if n > sampled:
            step = max(1, (1 << 21) // n)  # rows at a time, so that long texts stay small in memory
            places = [_least_places(shingles[None, :] * _MULTIPLIERS[i : min(i + step, number), None], sampled) for i in range(0, number, step)]
            found.append(_keys(shingles[np.concatenate(places)], _MULTIPLIERS[:number].copy()))
        if n <= SUBSET_SHINGLES:
            found.append(_keys(shingles[None, :], np.array([n], dtype=np.uint64)))
        if 5 <= n <= SUBSET_SHINGLES + 1:
            found.append(_keys(np.stack([np.delete(shingles, k) for k in range(n)]), np.full(n, n - 1, dtype=np.uint64)))
    return np.concatenate(found).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two labelled sequences if it reaches ``least``, else 0."""
    return compare(a, b, least)[0]


def compare(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> tuple[float, float]:
    """Similarity of two labelled sequences if it reaches ``least``, else 0; and the Jaccard distance of their sets.

    A match that reaches ``least`` leaves at most (1 - least) / (1 + least) of all shingles out, and so
    never pairs places further apart than that number: the band. In the band, each shingle
    pairs with one other, so the best match is the longest rising run of places.
    """
    total = len(a) + len(b)
    if total == 0:
        return 1.0, 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    distance = 1 - len(at_a) / (total - len(at_a))
    needed = least / (1 + least) * total - 1e-9
    band = (1 - least) / (1 + least) * total + 1e-9
    near = np.abs(at_a - at_b) <= band
    if near.sum() < needed:
        return 0.0, distance
    places = at_a[near][np.argsort(at_b[near], kind="stable")]
    if (places[1:] > places[:-1]).all():
        matched = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            i = bisect_left(tails, p)
            if i == len(tails):
                tails.append(p)
            else:
                tails[i] = p
        matched = len(tails)
    return (matched / (total - matched) if matched >= needed else 0.0), distance


STAGE = "digest string, size int, words binary, sketches array<long>"


def _sketched(df: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """One row a document with its sketches, and half of each word's hash, enough to verify candidates."""
    rows = df.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    )

    def run(batches):
        claim_memory("order_minhash", _KNOWN.clear)
        for batch in row_batches(batches):
            digest, size, raw, found = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = word_ids(text)
                shingles = labelled_shingles(words)
                # Without words, the signs besides white space tell texts apart.
                digest.append(xxhash.xxh128_hexdigest(words.tobytes() if len(words) else "".join(text.split()).encode("utf-8", "replace")))
                size.append(len(shingles))
                raw.append((words >> np.uint64(32)).astype("<u4").tobytes())
                found.append(sketches(shingles))
            yield record_batch({
                "row": (batch.column(0), None), "doc_id": (batch.column(1), None), "digest": (digest, pa.string()),
                "size": (size, pa.int32()), "words": (raw, pa.binary()), "sketches": (found, pa.list_(pa.int64())),
            })

    return rows.mapInArrow(run, f"row long, doc_id long, {STAGE}")


def _compared(pairs: DataFrame, staged: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The staged pairs (a, b) with ``linked`` and ``distance``. All words shuffle once at most, those of pairs again."""
    involved = pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct()
    texts = scratch.stage(staged.select("row", "words").join(scratch.stage(involved, "involved"), "row", "left_semi"), "texts")
    joined = pairs.join(texts.select(F.col("row").alias("b"), F.col("words").alias("words_b")), "b").join(
        texts.select(F.col("row").alias("a"), F.col("words").alias("words_a")), "a"
    )

    def run(batches):
        seen: dict[bytes, np.ndarray] = {}  # a leader's shingles serve many pairs

        def shingles(raw: bytes) -> np.ndarray:
            return labelled_shingles(np.frombuffer(raw, dtype="<u4").astype(np.uint64))

        def of_leader(raw: bytes) -> np.ndarray:
            if raw not in seen:
                if len(seen) > 200:
                    seen.clear()
                seen[raw] = shingles(raw)
            return seen[raw]

        for batch in row_batches(batches, 256):
            found = [compare(shingles(x), of_leader(y), least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield record_batch({
                "a": (batch.column(0), None), "b": (batch.column(1), None), "linked": ([s > 0 for s, _ in found], pa.bool_()),
                "distance": ([d for _, d in found], pa.float64()),
            })

    return joined.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long, linked boolean, distance double")


BLOCK = 256  # members of an open bucket that one task compares with as many others
COLUMNS = 8192  # shingles counted at a time


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles (distinct within a text) of all pairs."""
    sizes = [len(s) for s in (*left, *right)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values := np.concatenate([*left, *right]), kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    counts = np.diff(np.r_[first, len(values)])
    column = np.repeat(np.where(counts > 1, np.cumsum(counts > 1) - 1, -1), counts)  # shingles of one text have none
    owner, column = owner[column >= 0], column[column >= 0]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        marks = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
        marks[owner[low:high], column[low:high] - at] = 1
        out += marks[: len(left)] @ marks[len(left) :].T
    return out


def block_links(rows: np.ndarray, component: np.ndarray, raw: list[bytes], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between the texts at places ``left`` and ``right`` that join different components, thinned to a tree.

    The share of common shingles, which no order-preserving match exceeds, is counted for all pairs at once; only
    pairs that reach ``least`` and are not joined yet are aligned.
    """
    shingles = [labelled_shingles(np.frombuffer(r, dtype="<u4").astype(np.uint64)) for r in raw]
    sizes = np.array([len(s) for s in shingles])
    common = _common_counts([shingles[i] for i in left], [shingles[i] for i in right])
    needed = least * (sizes[left][:, None] + sizes[right][None, :]) / (1 + least) - 1e-6 * sizes.max()
    joined = {int(c): int(c) for c in component}

    def root(c: int) -> int:
        while joined[c] != c:
            joined[c] = c = joined[joined[c]]
        return c

    links = []
    for i, j in zip(*np.nonzero((common >= needed) & (component[left][:, None] != component[right][None, :]))):
        x, y = int(left[i]), int(right[j])
        p, q = root(int(component[x])), root(int(component[y]))
        if p != q and similarity(shingles[x], shingles[y], least) > 0:
            joined[max(p, q)] = min(p, q)
            links.append((int(rows[x]), int(rows[y])))
    return links


def _salted_join(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Inner join on ``bucket``, of which ``buckets`` has one row each; the rows of one bucket are dealt to several tasks."""
    spread = buckets.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["bucket", "salt"]).drop("salt")


def _open_links(rest: DataFrame, found: DataFrame, staged: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links ``a, b`` between members of one bucket that are in different components so far.

    A bucket is settled unless the distances to its first member of two components come close enough for a
    link. In an open one the members of its largest component are compared with all others, and those with each other, in
    blocks of bounded size: a task gets two blocks, whatever the bucket holds.
    """
    reach = 1 - least + 1e-9
    placed = rest.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    placed = scratch.stage(placed, "placed")
    spans = placed.groupBy("bucket", "component").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("low", "component").rowsBetween(Window.unboundedPreceding, -1)
    close = F.col("low") - F.max("high").over(before) <= reach
    unsettled = spans.withColumn("close", close).groupBy("bucket").agg(
        F.max("close").alias("close"), F.max(F.struct("n", "component")).alias("core"), F.sum("n").alias("n")
    ).where("close")
    unsettled = scratch.stage(
        unsettled.select(
            "bucket", F.col("core.component").alias("core"), F.ceil(F.col("core.n") / BLOCK).cast("int").alias("core_blocks"),
            F.ceil((F.col("n") - F.col("core.n")) / BLOCK).cast("int").alias("other_blocks"),
        ),
        "unsettled",
    )
    going = scratch.stage(_salted_join(placed.select("bucket", "row", "component"), unsettled), "going")
    involved = scratch.stage(going.select("row").distinct(), "involved")
    texts = scratch.stage(staged.select("row", "words").join(involved, "row", "left_semi"), "texts")

    in_core = F.col("component") == F.col("core")
    block = F.pmod(F.xxhash64("row"), F.when(in_core, F.col("core_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # (one, two): a block of others against one of the core (numbered from -1 down) or of others.
    with_core = F.transform(upto("core_blocks"), lambda j: F.struct(F.col("block").alias("one"), (-1 - j).alias("two")))
    with_others = F.transform(upto("other_blocks"), lambda k: F.struct(F.least("block", k).alias("one"), F.greatest("block", k).alias("two")))
    of_core = F.transform(upto("other_blocks"), lambda i: F.struct(i.alias("one"), (-1 - F.col("block")).alias("two")))
    meetings = F.when(in_core, of_core).otherwise(F.concat(with_core, with_others))
    dealt = going.withColumn("block", block).join(texts, "row").select(
        "bucket", "row", "component", "words", F.when(in_core, -1 - F.col("block")).otherwise(F.col("block")).alias("own"), F.explode(meetings).alias("m")
    ).select("bucket", "row", "component", "words", "own", "m.one", "m.two")

    def compare(key, table):
        one, two = key[1].as_py(), key[2].as_py()
        own = table.column("own").to_numpy()
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        links = []
        if len(left) and len(right):
            raw = table.column("words").to_pylist()
            links = block_links(table.column("row").to_numpy(), table.column("component").to_numpy(), raw, left, right, least)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return scratch.stage(dealt.groupBy("bucket", "one", "two").applyInArrow(compare, "a long, b long").distinct(), "open-links")


def _linked(staged: DataFrame, nodes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``node, component`` of the ``nodes`` (rows of ``staged``) that link with another.

    First every member of a bucket is compared with the bucket's first. Jaccard distance is a metric and no
    more than one minus the similarity, so members whose distances to the first differ by more than a link allows
    cannot link. The rest is compared where it is in different components.
    """
    members = staged.select("row", "sketches").join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    members = members.select("row", F.explode(F.array_distinct("sketches")).alias("bucket"))
    first = members.groupBy("bucket").agg(F.min("row").alias("leader"), F.max("row").alias("last")).where("leader < last").drop("last")
    # Buckets of two or more, each row with its bucket's first member.
    shared = scratch.stage(members.join(first, "bucket").where("row <> leader"), "buckets")
    pairs = scratch.stage(shared.select(F.col("row").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    compared = scratch.stage(_compared(pairs, staged, least, scratch), "compared")
    links = compared.where("linked").select("a", "b")
    found = scratch.stage(connected_components(links, scratch.stage), "components")
    rest = shared.join(compared.select(F.col("a").alias("row"), F.col("b").alias("leader"), "distance"), ["row", "leader"]).drop("leader")
    more = _open_links(rest, found, staged, least, scratch)
    if more.isEmpty():
        return found
    # A component so far is a star around its least node.
    links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)
    return scratch.stage(connected_components(links, scratch.stage), "components")


def near_classes(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, least: float = SIMILARITY
) -> DataFrame:
    """``row, doc_id, class_id, class_size, kept`` of every row; ``class_id`` is the class's least id, and one row of it is kept.

    Words are runs of letters, digits and underscores in lower case; a null text counts as empty,
    and texts without words link where they are equal but for white space. A text under five words is one shingle, so
    it links with equal ones only. Null ids come last in a class; of rows with one id the first
    read is kept. Repeated rows are one class. An empty table gives no rows. ``row`` is
    ``row_col``, a unique number a row, or is given here; other columns are left out.
    """
    scratch = Scratch(df.sparkSession)
    staged = scratch.stage(_sketched(df, id_col, text_col, row_col), "sketched")
    # Equal word sequences: the first row stands for all.
    nodes = staged.groupBy("digest").agg(F.min("row").alias("node"))
    copies = scratch.stage(nodes, "nodes")
    found = _linked(staged, copies, least, scratch)
    classes = scratch.stage(
        copies.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("class")), "classes"
    )
    member = staged.select("row", "doc_id", "digest").join(classes, "digest").select("row", "doc_id", "class")
    member = materialise(member, "members")
    best = materialise(
        member.groupBy("class").agg(
            F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("best")
        ),
        "best",
    )
    scratch.clear()
    return member.join(best, "class").select(
        "row", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept")
    )


def drop_near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the columns of ``df``."""
    key = fresh_column(df.columns, "row")
    whole = materialise(df.withColumn(key, F.monotonically_increasing_id()), "whole")
    marked = near_classes(whole.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(key).alias("row")), row_col="row", least=least)
    dropped = marked.where(~F.col("kept")).select(F.col("row").alias(key))
    return whole.join(dropped, key, "left_anti").drop(key)
