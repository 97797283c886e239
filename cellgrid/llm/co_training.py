"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

Each view is a logistic model of its own features: words, closing signs and shares of token kinds on one side, language, source, length and
lines on the other. In every round both views score all unlabelled documents; the ones a view is most sure of, a fixed number a
round, are what the other view learns from next. At the end both are calibrated on labelled rows kept aside, and their log odds are combined to
score every document.

Features are extracted once, to a stage table; rounds and the last scoring read that. What comes to the driver is the bounded sample of
labelled rows and the pseudo-labelled rows of the rounds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import claim_memory, materialise, row_batches
from .conv_toxicity import held_out

MAX_LABELLED = 10_000
ROUNDS = 4
PER_ROUND = 400  # pseudo-labels a view gives in a round, in the classes' proportion
SURE = 0.95
CONTENT_BUCKETS = 1 << 16
META_BUCKETS = 64
BINS = 12
MEMORY_TOKENS = 120_000
LAYOUT = ("chars", "lines", "per_line")  # numbers of the metadata view: length, lines, tokens a line
KINDS = ("upper", "digits", "symbols", "bare", "length", "distinct", "most")  # of the content view: shares of its tokens
NUMBERS = len(LAYOUT) + len(KINDS)

_TOKENS: dict[str, tuple[int, int, int, int, int, int]] = {}


def _token(token: str) -> tuple[int, int, int, int, int, int]:
    """Buckets of the word and of its closing signs, then flags: upper case, digits, closing signs, no letters."""
    core = token.rstrip(".,;:!?\"'()[]{}<>|#$%&*@~^+=-_/\\")
    signs = token[len(core) :]
    letters = any(c.isalpha() for c in core)
    # One full stop or comma is ordinary; the bucket holds what is not.
    odd = signs not in ("", ".", ",", ";", ":", "?", "!", ")", '"', "'")
    return (
        zlib.crc32(core.lower().encode("utf-8", "replace")) % (CONTENT_BUCKETS - 256),
        CONTENT_BUCKETS - 256 + zlib.crc32(signs.encode("utf-8", "replace")) % 256,
        len(core) > 1 and core.isupper(), any(c.isdigit() for c in core), odd, not letters,
    )


def features(text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and signs, their weights (unit length), and a row of numbers: layout, token kinds, then buckets of lang and source."""
    text = text or ""
    counts = Counter(text.split())
    if len(_TOKENS) > MEMORY_TOKENS:
        _TOKENS.clear()
    for t in counts:
        if t not in _TOKENS:
            _TOKENS[t] = _token(t)
    n = sum(counts.values())
    meta = np.zeros(NUMBERS + 2)
    named = [zlib.crc32(f"{k}={v}".encode("utf-8", "replace")) % META_BUCKETS for k, v in (("lang", lang), ("source", source))]
    meta[NUMBERS:] = named
    lines = text.count("\n") + 1
    meta[:3] = np.log1p(len(text)), np.log1p(lines), np.log1p(n / lines)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), meta
    rows = np.array([_TOKENS[t] for t in counts], dtype=np.int64)
    weight = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    meta[3:7] = weight @ rows[:, 2:] / n
    meta[7:10] = len(text) / n, len(counts) / n, weight.max() / n
    buckets, back = np.unique(rows[:, :2].ravel(), return_inverse=True)
    value = np.log1p(np.bincount(back, weights=np.repeat(weight, 2)))
    return buckets, value / np.sqrt(value @ value), meta


class Sparse:
    """Rows of (bucket, weight) pairs, one after the other."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        self.buckets, self.values, self.sizes, self.ends = buckets, values, sizes, np.cumsum(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, values and the position in ``rows`` of each pair."""
        sizes = self.sizes[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.ends[rows] - sizes, sizes)
        return self.buckets[at], self.values[at], owner


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def raw(self, x: Sparse, rows: np.ndarray) -> np.ndarray:
        b, v, owner = x.take(rows)
        return np.bincount(owner, weights=v * self.weights[b], minlength=len(rows)) + self.bias

    def logit(self, x: Sparse, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x, rows) + self.shift, -12, 12)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, rows: np.ndarray, y: np.ndarray, size: int, *, epochs: int = 15, batch: int = 128, seed: int = 3) -> Logistic:
    """Logistic regression by Adagrad; the classes weigh the same."""
    rng, model, seen = np.random.default_rng(seed), Logistic(np.zeros(size), 0.0), np.full(size, 1e-6)
    seen_bias = 1e-6
    share = min(max(float(y.mean()), 0.02), 0.98) if len(y) else 0.5
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            b, v, owner = x.take(rows[part])
            z = np.bincount(owner, weights=v * model.weights[b], minlength=len(part)) + model.bias
            g = weight[part] * (_sigmoid(z) - y[part]) / len(part)
            grad = np.bincount(b, weights=v * g[owner], minlength=size)
            touched = np.flatnonzero(grad)
            seen[touched] += grad[touched] ** 2
            model.weights[touched] -= 0.3 * grad[touched] / np.sqrt(seen[touched])
            seen_bias += g.sum() ** 2
            model.bias -= 0.3 * g.sum() / np.sqrt(seen_bias)
    return model


def newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    """Logistic regression on a few columns by Newton steps, drawn towards ``start``."""
    w = start.copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * (w - start))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of ``y`` on ``z``."""
    scale = max(1e-6, float(np.abs(z).mean())) if len(z) else 1.0
    w = newton(np.stack([z / scale, np.ones(len(z))], axis=1), y, np.array([1.0, 0.0]))
    return float(max(w[0], 1e-3) / scale), float(w[1])


def binned(numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of the rows' numbers, all counted on."""
    bins = np.stack([np.searchsorted(edges[k], numbers[:, k], side="right") for k in range(NUMBERS)], axis=1) if len(numbers) else np.zeros((0, NUMBERS), np.int64)
    return bins + np.arange(NUMBERS) * BINS


META_SIZE = NUMBERS * BINS + 2 * META_BUCKETS
CONTENT_SIZE = CONTENT_BUCKETS + NUMBERS * BINS


class Batch:
    """Rows of features, and both views of them."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, sizes: np.ndarray, numbers: np.ndarray):
        self.buckets, self.weights, self.sizes, self.numbers = buckets, weights, sizes, numbers

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Batch:
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return cls(
            join([b for b, _, _ in rows], np.int64), join([v for _, v, _ in rows], np.float64), np.array([len(b) for b, _, _ in rows], dtype=np.int64),
            np.array([m for _, _, m in rows]).reshape(len(rows), NUMBERS + 2),
        )

    @classmethod
    def from_arrow(cls, batch: pa.RecordBatch) -> Batch:
        buckets, weights, numbers = (batch.column(n) for n in ("buckets", "weights", "numbers"))
        return cls(
            buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64),
            pc.list_value_length(buckets).to_numpy(zero_copy_only=False).astype(np.int64),
            numbers.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, NUMBERS + 2),
        )

    def __len__(self) -> int:
        return len(self.sizes)

    def views(self, edges: np.ndarray) -> tuple[Sparse, Sparse]:
        """Content: words and signs, then bins of the token kinds. Metadata: bins of the layout, buckets of language and source."""
        n, bins, k = len(self), binned(self.numbers, edges), len(KINDS)
        ends = np.cumsum(self.sizes)
        at = np.repeat(ends, k)
        kinds = np.full(n * k, np.sqrt(0.5 / k))
        content = Sparse(
            np.insert(self.buckets, at, CONTENT_BUCKETS + bins[:, len(LAYOUT) :].reshape(-1)), np.insert(self.weights * np.sqrt(0.5), at, kinds), self.sizes + k
        )
        base = NUMBERS * BINS
        named = np.concatenate([bins[:, : len(LAYOUT)], base + self.numbers[:, NUMBERS:].astype(np.int64) + [0, META_BUCKETS]], axis=1)
        return content, Sparse(named.reshape(-1), np.full(named.size, 1 / np.sqrt(named.shape[1])), np.full(n, named.shape[1], dtype=np.int64))


@dataclass
class CoModel:
    """Both views with their calibration, and that of their sum; about a megabyte, whatever the corpus."""

    content: Logistic
    meta: Logistic
    edges: np.ndarray  # bins of the numbers
    shares: tuple[float, float, float]  # of the views' log odds in the combined ones, and a constant

    def combined(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return self.shares[0] * content + self.shares[1] * meta + self.shares[2]

    def view_logits(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        every, (content, meta) = np.arange(len(batch)), batch.views(self.edges)
        return self.content.logit(content, every), self.meta.logit(meta, every)

    def logits(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        content, meta = self.view_logits(batch)
        return content, meta, self.combined(content, meta)


class CoTrainer:
    """The driver's part: what each view has learnt from, and models fitted to it.

    A quarter of the labelled rows is kept aside for calibration. Rows: ids in ascending order, their features, 0 or 1.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, edges: np.ndarray, seed: int = 3):
        self.edges, self.seed = edges, seed
        self.usable = len(labels) > 0 and labels.min() < labels.max()
        if not self.usable:
            return
        shuffled = np.random.default_rng(seed).permutation(len(labels))
        aside, used = shuffled[: len(labels) // 4], shuffled[len(labels) // 4 :]
        if min(len(set(labels[aside].tolist())), len(set(labels[used].tolist()))) < 2:
            aside = used = np.arange(len(labels))  # too few rows to keep some aside
        pick = lambda places: [rows[i] for i in places]
        self.aside, self.aside_y = Batch.of(pick(aside)).views(edges), labels[aside]
        self.share = float(labels[used].mean())
        self.taught = [(pick(used), labels[used]), (pick(used), labels[used])]

    def wanted(self) -> tuple[int, int]:
        """How many documents of each class (1, then 0) a view labels in a round, at most."""
        return round(PER_ROUND * self.share), round(PER_ROUND * (1 - self.share))

    def models(self) -> CoModel:
        """Fitted and calibrated views."""
        if not self.usable:
            return CoModel(Logistic(np.zeros(CONTENT_SIZE), 2.0), Logistic(np.zeros(META_SIZE), 2.0), self.edges, (0.5, 0.5, 0.0))
        views = []
        for k, size in enumerate((CONTENT_SIZE, META_SIZE)):
            rows, y = self.taught[k]
            model = fit(Batch.of(rows).views(self.edges)[k], np.arange(len(rows)), y, size, seed=self.seed)
            every = np.arange(len(self.aside_y))
            model.slope, model.shift = calibrate(model.raw(self.aside[k], every), self.aside_y)
            views.append(model)
        logits = [views[k].logit(self.aside[k], np.arange(len(self.aside_y))) for k in (0, 1)]
        shares = newton(np.stack([*logits, np.ones(len(self.aside_y))], axis=1), self.aside_y, np.array([0.5, 0.5, 0.0]))
        return CoModel(views[0], views[1], self.edges, tuple(float(w) for w in shares))

    def teach(self, by: int, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int]) -> None:
        """What view ``by`` (0 content, 1 metadata) is sure of, for the other."""
        old_rows, old_y = self.taught[1 - by]
        self.taught[1 - by] = old_rows + rows, np.concatenate([old_y, np.array(labels, dtype=old_y.dtype)])


def surest(p: np.ndarray, ids: np.ndarray, wanted: tuple[int, int]) -> list[tuple[int, np.ndarray]]:
    """(class, places) of the rows a view is sure of, surest first, ties by id, at most ``wanted`` a class."""
    found = []
    for label, most, key in ((1, wanted[0], -p), (0, wanted[1], p)):
        order = np.lexsort((ids, key))[:most]
        found.append((label, order[(p[order] >= SURE) if label else (p[order] <= 1 - SURE)]))
    return found


FEATURES = "row long, y int, buckets array<int>, weights array<float>, numbers array<double>"


def stage_features(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", max_labelled: int = MAX_LABELLED, carry: list[str] | None = None,
) -> DataFrame:
    """Stage table of every row's features with a number ``row``, ``y`` (the label to learn from, else null) and the ``carry`` columns.

    At most ``max_labelled`` labelled ids outside the held-out fifth, by a hash of the id, have a ``y``. All other rows count as
    unlabelled: those with a null id, a null label, a held-out one or one beyond the bound.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    learn = known.where(F.col("_y").isNotNull() & ~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    carry = carry or []
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"),
        F.col(source_col).cast("string").alias("_source"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    ).withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(learn), "_id", "left")  # max_labelled rows
    kept = [f"_c{i}" for i in range(len(carry))]
    ordered = rows.select("row", F.col("_y").alias("y"), "_text", "_lang", "_source", *kept)

    def extract(batches):
        claim_memory("co_training", _TOKENS.clear)
        for batch in row_batches(batches):
            made = [features(*r) for r in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([b for b, _, _ in made], pa.list_(pa.int32())),
                    pa.array([v for _, v, _ in made], pa.list_(pa.float32())), pa.array([m for _, _, m in made], pa.list_(pa.float64())),
                    *batch.columns[5:],
                ],
                names=["row", "y", "buckets", "weights", "numbers", *kept],
            )

    schema = T.StructType(T._parse_datatype_string(FEATURES).fields + [T.StructField(k, docs.schema[c].dataType) for k, c in zip(kept, carry)])
    return materialise(ordered.mapInArrow(extract, schema), "features")


def _rows_of(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    columns = (table.column(c) for c in ("buckets", "weights", "numbers"))
    return [(np.asarray(b.values, dtype=np.int64), np.asarray(v.values, dtype=np.float64), np.asarray(m.values)) for b, v, m in zip(*columns)]


def bin_edges(staged: DataFrame) -> np.ndarray:
    """Per number the values at equal ranks of all rows (sketched)."""
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = staged.agg(*[F.percentile_approx(F.col("numbers")[k], steps, F.lit(1000)).alias(f"n{k}") for k in range(NUMBERS)]).first()
    return np.array([row[k] if row[k] is not None else [0.0] * (BINS - 1) for k in range(NUMBERS)])


def _confident(staged: DataFrame, model: CoModel, wanted: tuple[int, int], taken: set[int]) -> pa.Table:
    """``view, label, row`` and features of the rows each view is surest of, among all unlabelled ones not ``taken`` yet.

    A task passes on no more than a round takes, so what Spark ranks is small, and so is what is ranked away.
    """
    gone = np.array(sorted(taken), dtype=np.int64)

    def run(batches):
        best: dict[tuple[int, int], pa.Table] = {}
        for batch in row_batches(batches):
            table = pa.Table.from_batches([batch])
            free = ~np.isin(batch.column("row").to_numpy(), gone)
            if not free.any():
                continue
            table = table.filter(pa.array(free)).combine_chunks()
            for view, z in enumerate(model.view_logits(Batch.from_arrow(table.to_batches()[0]))):
                p, ids = _sigmoid(z), table.column("row").to_numpy()
                for label, places in surest(p, ids, wanted):
                    part = table.take(pa.array(places)).append_column("p", pa.array(p[places]))
                    old = best.get((view, label))
                    part = part if old is None else pa.concat_tables([old, part])
                    order = [("p", "descending" if label else "ascending"), ("row", "ascending")]
                    best[view, label] = part.sort_by(order).slice(0, wanted[0 if label else 1])
        for (view, label), table in best.items():
            for part in table.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([view] * part.num_rows, pa.int32()), pa.array([label] * part.num_rows, pa.int32()), *part.columns],
                    names=["view", "label", *part.schema.names],
                )

    free = staged.where("y IS NULL").select("row", "buckets", "weights", "numbers")
    found = free.mapInArrow(run, "view int, label int, row long, buckets array<int>, weights array<float>, numbers array<double>, p double")
    rank = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.when(F.col("label") == 1, -F.col("p")).otherwise(F.col("p")), "row"))
    most = F.when(F.col("label") == 1, wanted[0]).otherwise(wanted[1])
    ranked = found.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") <= max(wanted)))
    return ranked.toArrow().sort_by([("view", "ascending"), ("label", "descending"), ("rank", "ascending")])


def co_train(staged: DataFrame, *, rounds: int = ROUNDS, seed: int = 3) -> CoModel:
    """Without both classes among the labels every score is 0.5 or more: all stay."""
    labelled = (staged.where("y IS NOT NULL").select("row", "y", "buckets", "weights", "numbers")).toArrow().sort_by("row")
    trainer = CoTrainer(_rows_of(labelled), np.asarray(labelled.column("y")).astype(int), bin_edges(staged), seed)
    model, taken = trainer.models(), set()
    for _ in range(rounds if trainer.usable else 0):
        found = _confident(staged, model, trainer.wanted(), taken)
        if not found.num_rows:
            break
        rows, views, marks = _rows_of(found), found.column("view").to_pylist(), found.column("label").to_pylist()
        for view in (0, 1):
            mine = [i for i, v in enumerate(views) if v == view]
            trainer.teach(view, [rows[i] for i in mine], [marks[i] for i in mine])
        taken |= set(found.column("row").to_pylist())
        model = trainer.models()
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, *, rounds: int = ROUNDS, seed: int = 3, **columns) -> CoModel:
    """The model of ``docs``; see ``stage_features`` for the columns and for what counts as labelled."""
    return co_train(stage_features(docs, labels, **columns), rounds=rounds, seed=seed)


SCORE_FIELDS = (("quality", "double"), ("content_score", "double"), ("metadata_score", "double"), ("predicted", "int"))


def _scored(staged: DataFrame, model: CoModel, carry: list[str], types: list[T.DataType], only_kept: bool) -> DataFrame:
    """The ``carry`` columns of a feature table with their scores, or without them the kept rows."""
    shared = staged.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(c, t) for c, t in zip(carry, types)]
    schema = T.StructType(fields + ([] if only_kept else [T.StructField(n, T._parse_datatype_string(t)) for n, t in SCORE_FIELDS]))

    def run(batches):
        m = shared.value
        for batch in row_batches(batches):
            content, meta, both = m.logits(Batch.from_arrow(batch))
            kept = both >= 0
            columns = [batch.column(f"_c{i}") for i in range(len(fields))]
            if not only_kept:
                columns += [pa.array(_sigmoid(z)) for z in (both, content, meta)] + [pa.array(kept.astype(np.int32))]
            out = pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
            yield out.filter(pa.array(kept)) if only_kept else out

    return staged.select("buckets", "weights", "numbers", *[f"_c{i}" for i in range(len(carry))]).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, *, carry: list[str], only_kept: bool = False, rounds: int = ROUNDS, **columns) -> DataFrame:
    """Train on ``docs`` and score them, from one extraction of features.

    Every row with its ``carry`` columns, ``quality`` (0 to 1), both views' scores and ``predicted`` (1 from 0.5 on); ``only_kept`` returns the
    predicted rows, without the scores. A carried column of such a name is left out then. Null text, language or source are
    values like any other (a null text counts as empty). A row in, a row out, repeated ones too; an empty table gives no rows.
    """
    own = {n for n, _ in SCORE_FIELDS}
    carry = [c for c in carry if only_kept or c.lower() not in own]
    staged = stage_features(docs, labels, carry=carry, **columns)
    return _scored(staged, co_train(staged, rounds=rounds), carry, [docs.schema[c].dataType for c in carry], only_kept)


def score_quality(
    docs: DataFrame, model: CoModel, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    carry: list[str] | None = None, only_kept: bool = False,
) -> DataFrame:
    """Scores of any rows by a model, as ``quality_scores`` gives them; all columns are carried by default."""
    own = {n for n, _ in SCORE_FIELDS}
    carry = [c for c in (docs.columns if carry is None else carry) if only_kept or c.lower() not in own]
    inputs = [F.col(text_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), *[F.col(c) for c in carry]]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in carry]
    schema = T.StructType(fields + ([] if only_kept else [T.StructField(n, T._parse_datatype_string(t)) for n, t in SCORE_FIELDS]))

    def run(batches):
        m = shared.value
        claim_memory("co_training", _TOKENS.clear)
        for batch in row_batches(batches):
            content, meta, both = m.logits(Batch.of([features(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]))
            kept = both >= 0
            columns = [batch.column(i + 3) for i in range(len(fields))]
            if not only_kept:
                columns += [pa.array(_sigmoid(z)) for z in (both, content, meta)] + [pa.array(kept.astype(np.int32))]
            out = pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
            yield out.filter(pa.array(kept)) if only_kept else out

    # Inputs go first under positions, so that names may clash.
    return docs.select(*[c.alias(f"_{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)
