"""Leaf-wise trees against a plain version that looks at the rows of one leaf at a time."""

import math
import random

import numpy as np
import pytest

from cellgrid.operators import leafwise

UNIT = 2**24
SCHEMA = "CellID long, a double, b double, flat double, target_1h double, target_2h double"


def rows_of(seed, n=600, cells=9):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        cell, a, b = rng.randrange(cells), rng.randrange(12) / 2, float(rng.randrange(5))
        level = 50 * (cell % 4) + 20 * (a > 3) * (b < 2) + 5 * b + rng.random() * 10
        out.append((cell * 11, a, b, 1.0, level, level * (1 + (a < 1))))
    return out


def brute(rows, target, trees, leaves, step, least):
    """Predictions of the log of the target after ``trees`` trees."""
    x = [[r[1], r[2], r[3]] for r in rows]
    cat = [r[0] for r in rows]
    y = [round(math.log1p(r[target]) * UNIT) for r in rows]
    start = sum(y) / len(y) / UNIT
    p = [start] * len(rows)

    def best(members, g):
        found = None
        total, n = sum(g[i] for i in members) / UNIT, len(members)
        for f in range(4):
            if f < 3:
                groups = {}
                for i in members:
                    groups.setdefault(x[i][f], []).append(i)
                order, penalty = sorted(groups), 0.0
            else:
                groups = {}
                for i in members:
                    groups.setdefault(cat[i], []).append(i)
                order = sorted(groups, key=lambda c: (sum(g[i] for i in groups[c]) / UNIT / (len(groups[c]) + 10.0), c))
                penalty = 10.0
            low = []
            for place, value in enumerate(order, 1):
                low = low + groups[value]
                high_n = n - len(low)
                if len(low) < least or high_n < max(least, 1) or (f == 3 and min(place, len(order) - place) > 32):
                    continue
                lg = sum(g[i] for i in low) / UNIT
                hg = (sum(g[i] for i in members) - sum(g[i] for i in low)) / UNIT
                gain = lg**2 / (len(low) + penalty) + hg**2 / (high_n + penalty) - total**2 / n
                if gain > 1e-9 and (found is None or gain > found[0]):
                    found = gain, set(low), penalty
        return found

    for _ in range(trees):
        g = [round((p[i] - y[i] / UNIT) * UNIT) for i in range(len(rows))]
        open_leaves = [(list(range(len(rows))), best(range(len(rows)), g), 0.0)]
        while len(open_leaves) < leaves and any(b for _, b, _ in open_leaves):
            at = max((i for i, leaf in enumerate(open_leaves) if leaf[1]), key=lambda i: open_leaves[i][1][0])
            members, (_, low, penalty), _ = open_leaves.pop(at)
            for part in ([i for i in members if i in low], [i for i in members if i not in low]):
                open_leaves.append((part, best(part, g), penalty))
        if len(open_leaves) == 1:
            break
        for members, _, penalty in open_leaves:
            value = -step * (sum(g[i] for i in members) / UNIT) / (len(members) + penalty)
            for i in members:
                p[i] += value
    return p


@pytest.mark.parametrize("seed, trees, leaves, least, parts", [(1, 3, 6, 20, 1), (2, 12, 4, 1, 7), (3, 2, 15, 50, 3)])
def test_equals_one_leaf_at_a_time(spark, seed, trees, leaves, least, parts):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    models = leafwise.fit_leafwise(df, (1, 2), inputs=["a", "b", "flat"], trees=trees, leaves=leaves, step_size=0.3, min_leaf_rows=least)
    scored = leafwise.predict_leafwise(df, models).collect()
    for h in (1, 2):
        expected = sorted((r[:4], round(max(math.expm1(p), 0), 6)) for r, p in zip(rows, brute(rows, 3 + h, trees, leaves, 0.3, least)))
        got = sorted(((r.CellID, r.a, r.b, r.flat), round(r[f"prediction_{h}h"], 6)) for r in scored)
        assert [g[0] for g in got] == [e[0] for e in expected]
        assert np.allclose([g[1] for g in got], [e[1] for e in expected], rtol=1e-6)
        assert all(len(s) <= leaves - 1 for s, _ in models[h].trees) and len(models[h].trees) == trees


def test_categories_are_split_by_gradient_not_by_number(spark):
    """Cells 0, 20, 40 .. are high, those between low: one split by cell tells them apart, cut by number would need many."""
    rows = [(c * 10, 0.0, 0.0, 0.0, 100.0 if c % 2 == 0 else 1.0, 1.0) for c in range(30) for _ in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = leafwise.fit_leafwise(df, (1,), inputs=["a", "b", "flat"], trees=1, leaves=2, step_size=1.0)[1]
    (splits, _), = model.trees
    assert splits[0].feature == 3 and set(np.flatnonzero(splits[0].left)) in ({*range(0, 30, 2)}, {*range(1, 30, 2)})
    assert model.importances() == [("a", 0), ("b", 0), ("flat", 0), ("CellID", 1)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    models = leafwise.fit_leafwise(empty, (1, 2), inputs=["a", "b", "flat"], trees=2)
    strange = [(None, None, float("nan"), 1.0, 5.0, 5.0), (999, 1.0, 1.0, 1.0, 5.0, 5.0)]
    assert [r.prediction_1h for r in leafwise.predict_leafwise(spark.createDataFrame(strange, SCHEMA), models).collect()] == [0.0, 0.0]
    rows = rows_of(4, 200) + [(0, 1.0, 1.0, 1.0, None, 1.0), (None, 1.0, None, 1.0, 3.0, 3.0)]
    models = leafwise.fit_leafwise(spark.createDataFrame(rows, SCHEMA), (1, 2), inputs=["a", "b", "flat"], trees=2, min_leaf_rows=5)
    scored = leafwise.predict_leafwise(spark.createDataFrame(strange, SCHEMA), models).collect()
    assert all(r.prediction_1h > 0 for r in scored) and leafwise.predict_leafwise(empty, models).count() == 0
    with pytest.raises(ValueError):
        leafwise.fit_leafwise(spark.createDataFrame(rows, SCHEMA), (1,), inputs=["a"], max_categories=3)


def test_constant_target_needs_no_tree(spark):
    rows = [(c, float(i), 0.0, 0.0, 7.0, 7.0) for c in range(3) for i in range(60)]
    models = leafwise.fit_leafwise(spark.createDataFrame(rows, SCHEMA), (1,), inputs=["a", "b", "flat"], trees=5)
    assert models[1].trees == []
    assert {round(r.prediction_1h, 6) for r in leafwise.predict_leafwise(spark.createDataFrame(rows, SCHEMA), models).collect()} == {7.0}


def test_few_rows_are_one_task_and_horizons_grow_at_their_own_pace(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(5), SCHEMA).repartition(7)
    passes, one_pass = [], leafwise._histograms

    def watched(rows, *rest):
        passes.append(rows.rdd.getNumPartitions())
        return one_pass(rows, *rest)

    monkeypatch.setattr(leafwise, "_histograms", watched)

    def fitted(horizons):
        passes.clear()
        models = leafwise.fit_leafwise(df, horizons, inputs=["a", "b", "flat"], trees=12, leaves=6, step_size=0.3, min_leaf_rows=20)
        return [(h, m.trees[-1][1]) for h, m in models.items()], len(passes)

    (first, n_first), (second, n_second) = fitted((1,)), fitted((2,))
    both, n_both = fitted((1, 2))
    assert set(passes) == {1} and n_both == max(n_first, n_second) and both == first + second
    monkeypatch.setattr(leafwise, "ROWS_A_TASK", 0)
    assert fitted((1, 2)) == (both, n_both) and max(passes) > 1
