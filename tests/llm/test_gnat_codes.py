import hashlib
import math
import random

import numpy as np
import pytest

from cellgrid.llm import gnat_codes

from .helpers import with_clashes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows are (id, vector, label); plain loops over Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(r[1])[p] for r in kept[:entries]] for p in range(parts)]

    def assign(v):
        out = []
        for p, x in enumerate(cut(v)):
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p])))
        return out

    for _ in range(rounds):
        members = [[[] for _ in b] for b in books]
        for r in kept:
            for p, (_, i) in enumerate(assign(r[1])):
                members[p][i].append(cut(r[1])[p])
        books = [
            [[sum(c) // len(m) for c in zip(*m)] if m else books[p][i] for i, m in enumerate(members[p])] for p in range(parts)
        ]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, labels = [], {}
    for i, v, lab in kept:
        found = assign(v)
        error = sum(d for d, _ in found)
        labels[lab] = labels.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    return sorted(((i, c, e, labels[lab], digest) for i, c, e, lab in out), key=str)


def vectors(n, seed=3, dim=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        v = [round(x + rng.gauss(0, 0.2), 3) for x in rng.choice(centres)]
        rows.append((i * 3, v, rng.choice([1, 1, 1, 2, None])))
    return rows


def awkward():
    rows = vectors(60)
    rows += [rows[5], rows[5], (None, rows[7][1], None), (-4, [0.0] * 16, 3)]  # repeated rows, a null id, zeros
    rows += [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [0.0] * 15, 1), (1004, [None] + [0.0] * 15, 2)]
    rows += [(1005, [1.0] * 8, 1), (1006, [1.0] * 15, 1), (1007, [-1e-9] * 16, 1), (1008, [1e-9] * 16, 1)]
    return rows


def result(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("rows", [awkward(), vectors(7), vectors(300, 9), [(i, [0.5] * 8, 1) for i in range(40)]], ids=["awkward", "few", "many", "equal"])
def test_equals_brute_force(spark, rows):
    assert result(gnat_codes.encode_vectors(with_clashes(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_other_sizes(spark):
    rows = vectors(50, 4, 12)
    got = gnat_codes.encode_vectors(spark.createDataFrame(rows, SCHEMA), parts=3, entries=40, rounds=2, scale=10)
    assert result(got) == brute(rows, 3, 40, 2, 10)


def test_no_rows_that_can_be_coded(spark):
    for rows in ([], [(1, None, 1), (2, [], 2), (3, [float("nan")] * 8, 3)]):
        assert result(gnat_codes.encode_vectors(spark.createDataFrame(rows, SCHEMA))) == []


def test_components_whose_error_has_no_long_are_dropped(spark):
    rows = vectors(20, 5) + [(500, [1e30] * 16, 1), (501, [2.0**15] * 16, 1), (502, [-(2.0**15)] * 16, 1)]
    got = result(gnat_codes.encode_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert {r[0] for r in got} == {r[0] for r in rows} - {500} and got == brute([r for r in rows if r[0] != 500])


@pytest.mark.parametrize("spread", [3, 40, 5000, 2**26])
def test_tree_finds_the_lowest_of_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (64, 4))
    entries[40:50] = entries[10:20]  # ties between entries
    queries = np.concatenate([rng.integers(-spread, spread + 1, (2000, 4)), entries])
    place, gap, computed = gnat_codes.nearest(gnat_codes.build(entries), queries)
    exact = gnat_codes.squared(queries, entries)
    assert (gap == exact.min(axis=1)).all() and (place == exact.argmin(axis=1)).all()
    assert computed < exact.size


def test_subtrees_are_passed_over():
    rng = np.random.default_rng(1)
    centres = rng.integers(-50_000, 50_000, (4, 8))
    entries = np.concatenate([c + rng.integers(-50, 50, (16, 8)) for c in centres])
    queries = np.concatenate([c + rng.integers(-60, 60, (100, 8)) for c in centres])
    _, _, computed = gnat_codes.nearest(gnat_codes.build(entries), queries)
    assert computed < 0.6 * len(queries) * len(entries)


def test_code_is_decoded_to_its_entries():
    books = [np.array([[1, 2], [3, 4]]), np.array([[5, 6], [7, 8]])]
    assert gnat_codes.decode("0100", books) == [3, 4, 5, 6]


def test_entries_beyond_two_digits_are_refused(spark):
    with pytest.raises(ValueError):
        gnat_codes.encode_vectors(spark.createDataFrame([], SCHEMA), entries=257)
