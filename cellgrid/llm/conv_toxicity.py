"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding has three hashed parts: two of the whole word, so that two words meet only if
both hashes do, and one of its first letters, for inflected forms. Filters of several
widths run over the word sequence, each keeps its greatest response over the whole text
(max pooling), and a logistic layer weighs them. Thresholds are calibrated for each language,
which is guessed from the text's own function words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import record_batch, row_batches, text_or_empty

MAX_LABELLED = 12_000
PARTS = ((0, 17), (17, 17), (48, 16))  # first bit and number of bits of each part's bucket in a word id
PREFIX_LETTERS = 4
PART_DIM = 6
DIM = PART_DIM * len(PARTS)
WIDTHS = (1, 2, 3)
FILTERS = 12
STEPS = 1800
MEMORY_WORDS = 500_000
LEAST_POSITIVES = 15  # a language with fewer in the calibration part takes the common threshold

# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for are with this be from have they his not by at".split(),
    "de": "der die und das ist nicht mit den von zu ein eine auf dem sich des im für auch als wird".split(),
    "fr": "le la les de des et un une du que qui dans est pour pas sur au par ce il avec".split(),
    "es": "el la los las de y que en un una por con se del al su para no es como más".split(),
}

_WORDS = re.compile(r"\w+").findall


def word_id(word: str) -> int:
    """48 bits of the word's hash, then 16 of its prefix's."""
    prefix = xxhash.xxh64_intdigest(word[:PREFIX_LETTERS], seed=1)
    return xxhash.xxh64_intdigest(word) & ((1 << 48) - 1) | (prefix & 0xFFFF) << 48


class WordIds:
    """Texts to word ids, with a bounded memory of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = _WORDS(text.lower())
        if len(self.known) > MEMORY_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = word_id(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


_WORD_IDS = WordIds()
_LANGUAGES = sorted(FUNCTION_WORDS)
_MARKS: list[np.ndarray] = []


def guess_language(ids: np.ndarray) -> int:
    """Index in the sorted languages by function words that only one language has most of; -1 without any."""
    if not _MARKS:
        for name in _LANGUAGES:
            _MARKS.append(np.array([word_id(w) for w in FUNCTION_WORDS[name]], dtype=np.uint64))
    hits = [int(np.isin(ids, m).sum()) for m in _MARKS]
    return int(np.argmax(hits)) if max(hits, default=0) else -1


class Batch:
    """Texts as one run of vocabulary indexes; padding (the index after the last word) parts the texts."""

    def __init__(self, docs: list[np.ndarray], vocabulary: np.ndarray):
        gap, pad = max(WIDTHS) - 1, len(vocabulary)
        pieces, starts, at = [], [], 0
        for d in docs:
            p = np.full(max(1, len(d)) + gap, pad, dtype=np.int64)
            p[: len(d)] = d
            pieces.append(p)
            starts.append(at)
            at += len(p)
        self.vocabulary = vocabulary
        self.flat = np.concatenate(pieces)
        self.starts = np.array(starts)
        self.ends = np.append(self.starts[1:], at) - gap
        self.n = at - gap

    @classmethod
    def of_ids(cls, docs: list[np.ndarray]) -> Batch:
        vocabulary, flat = np.unique(np.concatenate(docs), return_inverse=True)
        return cls(np.split(flat, np.cumsum([len(d) for d in docs])[:-1]), vocabulary)


@dataclass
class ConvModel:
    """Weights and thresholds; a few MB at most, whatever the corpus."""

    tables: list[np.ndarray]  # per part: (buckets, PART_DIM)
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[int, float] = field(default_factory=dict)  # in logits, by language index; -1 is common

    @classmethod
    def new(cls, seed: int) -> ConvModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            [draw(1 << bits, PART_DIM, scale=0.1) for _, bits in PARTS],
            [draw(w, DIM, FILTERS, scale=(2.0 / (w * DIM)) ** 0.5) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * FILTERS, scale=0.3), 0.0,
        )

    @staticmethod
    def buckets(ids: np.ndarray) -> list[np.ndarray]:
        return [((ids >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in PARTS]

    def embed(self, ids: np.ndarray) -> np.ndarray:
        """A row a word, and one of zeros for the padding."""
        parts = [t[b] for t, b in zip(self.tables, self.buckets(ids))]
        return np.concatenate([np.concatenate(parts, axis=1), np.zeros((1, DIM), np.float32)])

    def responses(self, rows: np.ndarray, batch: Batch):
        """Per width, the filters' responses at every place of the batch."""
        for filters, bias in zip(self.filters, self.biases):
            products = [rows @ f for f in filters]  # a word's part of a response does not depend on its neighbours
            out = products[0][batch.flat[: batch.n]]
            for o in range(1, len(products)):
                out += products[o][batch.flat[o : batch.n + o]]
            yield out + bias

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros(0, np.float32)
        batch = Batch.of_ids(docs)
        borders = np.stack([batch.starts, batch.ends], axis=1).ravel()[:-1]
        top = [np.maximum.reduceat(r, borders, axis=0)[::2] for r in self.responses(self.embed(batch.vocabulary), batch)]
        return np.maximum(np.concatenate(top, axis=1), 0) @ self.out + self.out_bias

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Calibrated so that each language's threshold is 0.5."""
        shift = np.array([self.thresholds.get(guess_language(d), self.thresholds.get(-1, 0.0)) for d in docs])
        return 1 / (1 + np.exp(-np.clip(self.logits(docs).astype(np.float64) - shift, -30, 30)))

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.filters, *self.biases, self.out]


class _Adam:
    """Adam; ``rows`` updates some rows of a table only."""

    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, key: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        scale = np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        value[at] -= self.rate * scale * m[at] / (np.sqrt(v[at]) + 1e-7)


def train(
    docs: list[np.ndarray], labels: np.ndarray, *, epochs: int | None = None, batch: int = 32, rate: float = 0.01, seed: int = 7
) -> ConvModel:
    """Fit on word-id arrays; a fifth of the rows is kept out to choose the epoch and the thresholds.

    ``epochs``: by default enough for ``STEPS`` steps, 6 to 20.
    """
    model = ConvModel.new(seed)
    labels = labels.astype(np.float32)
    if not len(docs) or labels.min() == labels.max():
        model.out[:] = 0  # one class only: the same score for all
        model.thresholds = {-1: 0.0 if len(docs) and labels[0] == 1 else 1.0}
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    cut = len(docs) // 5
    held, used = order[:cut], order[cut:]
    if not (0 < labels[held].sum() < len(held)):
        held, used = order, order.copy()  # too few rows to keep some out
    share = float(labels[used].mean())
    weight = np.where(labels == 1, min(6.0, 0.5 / share), 1.0).astype(np.float32)
    model.out_bias = float(np.log(share / (1 - share)))
    epochs = epochs or min(20, max(6, -(-STEPS * batch // len(used))))
    adam, best = _Adam(rate), (np.inf, [], 0.0, np.zeros(0))
    bias = np.array([model.out_bias], np.float32)
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            rows = used[at : at + batch]
            _update(model, adam, bias, Batch.of_ids([docs[i] for i in rows]), labels[rows], weight[rows])
        z = np.concatenate([model.logits([docs[i] for i in held[k : k + 64]]) for k in range(0, len(held), 64)])
        loss = float(np.mean(np.logaddexp(0, z) - labels[held] * z))
        if loss < best[0]:
            best = loss, [w.copy() for w in model.weights()], model.out_bias, z
    for weights, chosen in zip(model.weights(), best[1]):
        weights[:] = chosen
    model.out_bias, z = best[2], best[3]
    languages = np.array([guess_language(docs[i]) for i in held])
    model.thresholds = {-1: best_threshold(z, labels[held])}
    for k in range(len(_LANGUAGES)):
        mine = languages == k
        positives = int(labels[held][mine].sum())
        if positives >= LEAST_POSITIVES and positives < mine.sum():
            model.thresholds[k] = best_threshold(z[mine], labels[held][mine])
    return model


def best_threshold(z: np.ndarray, labels: np.ndarray) -> float:
    """The logit of the best F1; in the middle of the gap below the last row it takes."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + labels.sum())
    ranked = z[order]
    ends = np.append(ranked[:-1] > ranked[1:], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = ranked[k + 1] if k + 1 < len(ranked) else ranked[k] - 2
    return float((ranked[k] + below) / 2)


def _update(model: ConvModel, adam: _Adam, bias: np.ndarray, batch: Batch, y: np.ndarray, weight: np.ndarray) -> None:
    """One step; only the words at the greatest responses get a gradient."""
    adam.t += 1
    rows = model.embed(batch.vocabulary)
    top, where = [], []
    for response in model.responses(rows, batch):
        at = np.stack([response[a:b].argmax(axis=0) + a for a, b in zip(batch.starts, batch.ends)])
        where.append(at)
        top.append(response[at, np.arange(FILTERS)])
    active = np.maximum(np.concatenate(top, axis=1), 0)
    z = active @ model.out + model.out_bias
    gz = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
    gtop = np.outer(gz, model.out) * (active > 0)
    grows, grads = np.zeros_like(rows), []
    for k, f in enumerate(model.filters):
        g, gf = gtop[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
        for o in range(len(f)):
            words = batch.flat[where[k] + o]
            gf[o] = np.einsum("ijd,ij->dj", rows[words], g)
            np.add.at(grows, words.ravel(), (g[..., None] * f[o].T[None]).reshape(-1, DIM))
        grads.append((gf, g.sum(axis=0)))
    adam.step("out", model.out, active.T @ gz + 1e-4 * model.out)
    adam.step("out_bias", bias, np.array([gz.sum()], np.float32))
    model.out_bias = float(bias[0])
    for k, (gf, gb) in enumerate(grads):
        adam.step(f"f{k}", model.filters[k], gf + 1e-4 * model.filters[k])
        adam.step(f"b{k}", model.biases[k], gb)
    touched = np.flatnonzero(np.abs(grows[:-1]).sum(axis=1))
    for k, (table, buckets) in enumerate(zip(model.tables, model.buckets(batch.vocabulary[touched]))):
        unique, back = np.unique(buckets, return_inverse=True)
        g = np.zeros((len(unique), PART_DIM), np.float32)
        np.add.at(g, back, grows[touched][:, k * PART_DIM : (k + 1) * PART_DIM])
        adam.step(f"e{k}", table, g, unique)


def held_out(id_col) -> object:
    """True for rows whose labels no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = MAX_LABELLED, seed: int = 7,
) -> ConvModel:
    """Fit on labelled rows outside the held-out fifth: at most ``max_labelled``, chosen by a hash of the id.

    Rows with a null id, label or unlabelled are not used; a label given twice counts by its
    maximum. Only word hashes of the chosen rows come to the driver. Without labels every score is the same.
    """
    wanted = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    )

    def words(batches):
        for batch in row_batches(batches):
            ids = [_WORD_IDS.of(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield record_batch({"id": (batch.column(0), None), "y": (batch.column(1), None), "words": (ids, pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(wanted), "_id")
    table = rows.select(F.col("_id").cast("long").alias("id"), F.col("_y").alias("y"), F.col("_text").alias("text")).mapInArrow(
        words, "id long, y int, words array<long>"
    ).toArrow().sort_by("id")
    arrays = [np.asarray(x.values, dtype=np.int64).view(np.uint64) for x in table.column("words")]
    return train(arrays, np.asarray(table.column("y")), seed=seed)


def score_toxicity(
    docs: DataFrame, model: ConvModel, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from the whole text alone.

    A null text counts as empty; empty texts get the score of a text without words. A row in, a
    row out, repeated ones too; other columns are left out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in row_batches(batches, 64):
            s = m.scores([_WORD_IDS.of(t) for t in batch.column(2).to_pylist()])
            yield record_batch({
                "doc_id": (batch.column(0), None), "held_out": (batch.column(1), None), "score": (s, pa.float64()),
                "predicted": ((s >= 0.5).astype(np.int32), pa.int32()),
            })

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
