import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellgrid.llm import co_training, conv_toxicity
from cellgrid.llm.common import table
from tests.conftest import TESTDATA

from .helpers import SCHEMA, awkward_rows, sentence, with_clashes

SMALL = f"{TESTDATA}/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def labelled(n=700, seed=6):
    """Plain documents; every fifth is junk by signs and layout, every sixth is toxic by a rare word or its forms."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words, junk, toxic = sentence(rng, rng.randint(20, 80)).split(), i % 5 == 0, i % 6 == 0
        if toxic:
            words.insert(rng.randint(0, len(words)), "vilewo" + rng.choice(["", "rd", "rds", "x", "rdly"]))
        if junk:
            words = [w + rng.choice(["###", "&&&", "$$$"]) for w in words]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = labelled()
    known = [(None, 1, 1), (3, None, None), *labels[:500], labels[0]]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(known, LABELS), {i: (q, t) for i, q, t in labels}


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_rows_not_learnt_from(spark, frames):
    docs, known, truth = frames
    scored = co_training.score_quality(docs, co_training.fit_quality(docs, known)).collect()
    unseen = [r for r in scored if is_held(r.doc_id) or r.doc_id >= 500]
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in unseen]) > 0.98
    assert all(0 <= r.quality <= 1 and r.predicted == (r.quality >= 0.5) for r in scored)


def test_quality_on_test_table(spark):
    got = entry.queries()["op1_co_training"](spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").where("held_out").collect()
    good = [r.predicted for r in got if r.quality is not None and r["predicted"] is not None]
    assert len(good) > 50


def brute_co_training(rows, labels, rounds, edges):
    """All rows in one place: scores of every row, and the pseudo-labels of the rounds as (round, view, row, label)."""
    learn = sorted({i for i, q in labels.items() if q is not None and not is_held(i)})
    y = {k: labels[r[0]] for k, r in enumerate(rows) if r[0] in learn}
    made = [co_training.features(r[1], r[2], r[3]) for r in rows]
    made = [(b, v.astype(np.float32).astype(float), m) for b, v, m in made]
    for k in range(co_training.NUMBERS):  # the bins hold as many rows as sketched ranks allow
        ranked = np.sort([m[k] for _, _, m in made])
        for i, edge in enumerate(edges[k]):
            at = (i + 1) / 12 * len(rows)
            assert np.searchsorted(ranked, edge, "left") - 2 <= at <= np.searchsorted(ranked, edge, "right") + 2
    known = sorted(y)
    trainer = co_training.CoTrainer([made[k] for k in known], np.array([y[k] for k in known]), edges)
    model, given, taken = trainer.models(), [], set()
    for number in range(rounds):
        free = [k for k in range(len(rows)) if k not in y and k not in taken]
        logits = model.view_logits(co_training.Batch.of([made[k] for k in free]))
        new = []
        for view, z in enumerate(logits):
            p = 1 / (1 + np.exp(-z))
            good = sorted((k for k in range(len(free)) if p[k] >= 0.95), key=lambda k: (-p[k], free[k]))[: trainer.wanted()[0]]
            bad = sorted((k for k in range(len(free)) if p[k] <= 0.05), key=lambda k: (p[k], free[k]))[: trainer.wanted()[1]]
            new += [(number, view, free[k], 1) for k in good] + [(number, view, free[k], 0) for k in bad]
        if not new:
            break
        for view in (0, 1):
            mine = [(k, label) for _, v, k, label in new if v == view]
            trainer.teach(view, [made[k] for k, _ in mine], [label for _, label in mine])
        given += new
        taken |= {k for _, _, k, _ in new}
        model = trainer.models()
    return 1 / (1 + np.exp(-model.logits(co_training.Batch.of(made))[2])), given


@pytest.mark.parametrize("parts", [1, 5])
def test_rounds_equal_brute_force(spark, monkeypatch, parts):
    """The same pseudo-labels in every round, and the same scores, as with all rows in one place."""
    monkeypatch.setattr(co_training, "PER_ROUND", 60)
    docs, labels = labelled(500, 9)
    docs = [(i, t, ("en", "de")[i % 5 == 0], "s", 1) for i, t, *_ in docs] + [(None, "null id", "en", "s", 1), (3, docs[3][1], "en", "s", 1)]
    known = [(i, q, t) for i, q, t in labels[:80]] + [(None, 1, 1), (90, None, None)]
    truth = {i: q for i, q, _ in known if i is not None}
    given = []
    teach = co_training.CoTrainer.teach
    monkeypatch.setattr(co_training.CoTrainer, "teach", lambda self, by, rows, marks: (given.append((by, len(rows), sum(marks))), teach(self, by, rows, marks))[1])
    found, bin_edges = [], co_training.bin_edges
    monkeypatch.setattr(co_training, "bin_edges", lambda staged: (found.append(bin_edges(staged)), found[-1])[1])
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, parts), SCHEMA)
    got = co_training.quality_scores(df, spark.createDataFrame(known, LABELS), carry=["doc_id", "text"], rounds=3).collect()
    by_spark, given[:] = list(given), []
    want, pseudo = brute_co_training(docs, truth, 3, found[0])
    by_hand, given = given, by_spark
    assert given == by_hand and len({k for _, _, k, _ in pseudo}) > 100
    texts = {}
    for (i, t, *_), q in zip(docs, want):
        texts[i, t] = q
    assert len(got) == len(docs) and max(abs(r.quality - texts[r.doc_id, r.text]) for r in got) < 1e-6


def test_quality_takes_awkward_rows(spark, frames):
    docs, known, _ = frames
    model = co_training.fit_quality(docs, known)
    rows = with_clashes(spark.createDataFrame(awkward_rows(), SCHEMA))
    assert co_training.score_quality(rows, model).count() == len(awkward_rows())
    kept = co_training.score_quality(rows, model, only_kept=True)
    assert kept.columns == rows.columns
    assert kept.count() == co_training.score_quality(rows, model).where("predicted = 1").count()
    assert co_training.score_quality(rows.limit(0), model).count() == 0
    empty = co_training.fit_quality(rows.limit(0), known.limit(0))
    assert co_training.score_quality(rows, empty).where("predicted = 1").count() == len(awkward_rows())


def test_toxicity_on_rows_not_learnt_from(spark, frames):
    docs, known, truth = frames
    scored = conv_toxicity.score_toxicity(docs, conv_toxicity.fit_toxicity(docs, known)).collect()
    unseen = [r for r in scored if r.held_out or r.doc_id >= 500]
    assert all(r.held_out == is_held(r.doc_id) for r in scored)
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_toxicity_never_reads_held_out_labels(spark, frames):
    docs, known, _ = frames
    flipped = known.withColumn("toxic", F.when(conv_toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (conv_toxicity.fit_toxicity(docs, x) for x in (known, flipped))
    assert all((x == y).all() for x, y in zip(a.weights(), b.weights())) and a.thresholds == b.thresholds


def test_toxicity_ignores_other_columns(spark, frames):
    docs, known, _ = frames
    model = conv_toxicity.fit_toxicity(docs, known)
    other = docs.select((F.col("doc_id") + 7000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("other").alias("source"))
    scores = [sorted(r.score for r in conv_toxicity.score_toxicity(d, model).collect()) for d in (docs, other)]
    assert scores[0] == scores[1]


def test_toxicity_takes_awkward_rows(spark, frames):
    docs, known, _ = frames
    model = conv_toxicity.fit_toxicity(docs, known)
    rows = with_clashes(spark.createDataFrame(awkward_rows(), SCHEMA))
    got = conv_toxicity.score_toxicity(rows, model)
    assert got.count() == len(awkward_rows()) and got.where("score IS NULL").count() == 0
    assert conv_toxicity.score_toxicity(rows.limit(0), model).count() == 0
    none = conv_toxicity.fit_toxicity(rows.limit(0), known.limit(0))
    assert {r.predicted for r in conv_toxicity.score_toxicity(rows, none).collect()} == {0}


def test_pooling_equals_plain_convolution():
    rng = np.random.default_rng(0)
    model = conv_toxicity.ConvModel.new(1)
    docs = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 2, 3, 50)]
    got = model.logits(docs)
    for doc, logit in zip(docs, got):
        rows = np.concatenate([model.embed(doc)[:-1], np.zeros((3, conv_toxicity.DIM))])
        top = []
        for f, bias in zip(model.filters, model.biases):
            responses = [sum(rows[p + o] @ f[o] for o in range(len(f))) + bias for p in range(max(1, len(doc)))]
            top.append(np.max(responses, axis=0))
        assert abs(np.maximum(np.concatenate(top), 0) @ model.out + model.out_bias - logit) < 1e-3
