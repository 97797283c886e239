import math
import random
from collections import defaultdict

import numpy as np
import pytest

from cellgrid.llm import order_minhash, projection_passes
from cellgrid.llm.components import connected_components

from .helpers import SCHEMA, awkward_rows, sentence, with_clashes


def classes_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(i, 99) for i in range(40)] + [(50, 51)],
    [(random.Random(i).randint(0, 99), random.Random(i + 500).randint(0, 99)) for i in range(70)],
])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes_of(100, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}


def brute_similarity(a, b):
    """Longest common subsequence of labelled five-word shingles by the plain table, without a band."""
    def labelled(text):
        words = order_minhash._WORDS(text.lower())
        seen, out = defaultdict(int), []
        for i in range(max(1, len(words) - 4) if words else 0):
            s = tuple(words[i : i + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    x, y = labelled(a), labelled(b)
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    total = len(x) + len(y) - row[-1]
    return row[-1] / total if total else 1.0


def variants(seed, copies=14, words=150):
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 12])):
            at = rng.randrange(len(text))
            kind = rng.random()
            if kind < 0.4:
                text[at] = "edit" + str(rng.random())[2:6]
            elif kind < 0.6:
                del text[at]
            elif kind < 0.8:
                text.insert(at, rng.choice(base))
            else:
                other = rng.randrange(len(text))
                text[at], text[other] = text[other], text[at]
        yield " ".join(text)


def test_similarity_equals_plain_table():
    texts = list(variants(3, 12)) + list(variants(4, 4, 12)) + ["a b a b a b a b a b a b a b", "a b a b a b a b a b a b a", "one", ""]
    for a in texts:
        for b in texts:
            want = brute_similarity(a, b)
            got = order_minhash.similarity(*(order_minhash.labelled_shingles(order_minhash.word_ids(t)) for t in (a, b)))
            assert abs(got - (want if want >= 0.8 else 0)) < 1e-9


def test_classes_equal_brute_force(spark):
    rows = awkward_rows()
    passage = sentence(random.Random(9), 40)
    for k in range(4):
        rows += [(1000 + 100 * k + i, t, "en", "s", 1) for i, t in enumerate(variants(k))]
    rng = random.Random(8)
    rows += [(4990, "!?!", "en", "s", 1), (4991, " !? !", "en", "s", 1), (4992, "???", "en", "s", 1), (4993, "!!!", "en", "s", 1)]
    rows += [(4900 + i, t, "en", "s", 1) for i, t in enumerate(v for n in range(8, 15) for v in variants(n, 4, n))]
    rows += [(5000 + i, passage + " " + sentence(rng, 45), "en", "s", 1) for i in range(25)]
    texts = [r[1] or "" for r in rows]
    short = [t if len(t) < 30_000 else "" for t in texts]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if texts[i] == texts[j] or (bool(order_minhash._WORDS(short[i])) and bool(order_minhash._WORDS(short[j])) and brute_similarity(texts[i], texts[j]) >= 0.8)
        or not order_minhash._WORDS(texts[i] + texts[j]) and "".join(texts[i].split()) == "".join(texts[j].split())
    ]
    root = classes_of(len(rows), links)
    members = defaultdict(list)
    for i, r in enumerate(root):
        members[r].append(rows[i][0])
    want = sorted(sorted(map(str, m)) for m in members.values())
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = order_minhash.near_classes(df).collect()
    by_class, kept = defaultdict(list), defaultdict(int)
    for r in got:
        by_class[r.class_id].append(str(r.doc_id))
        kept[r.class_id] += r.kept
    assert sorted(map(sorted, by_class.values())) == want and set(kept.values()) == {1}
    assert all(len(by_class[r.class_id]) == r.class_size for r in got)
    assert all(c == min((int(x) for x in m if x != "None"), default=None) for c, m in by_class.items())
    once = order_minhash.drop_near_copies(df)
    assert once.columns == df.columns and once.count() == len(want)
    assert order_minhash.near_classes(df.limit(0)).count() == 0


def test_one_word_edits_are_found(spark):
    """A large group of near copies of one text is one class, though most pairs share few sketches."""
    rng = random.Random(12)
    base = sentence(rng, 200).split()
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(200)] = f"w{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(text), "en", "s", 1))
    assert {r.class_id for r in order_minhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


@pytest.mark.parametrize("block", [order_minhash.BLOCK, 7])
def test_fringe_of_a_large_group(spark, monkeypatch, block):
    """Copies with few to many edits: some link with many others, some with few or none, whatever blocks they meet in."""
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rng = random.Random(21)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            text[rng.randrange(120)] = f"w{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(text), "en", "s", 1))
    shingles = [order_minhash.labelled_shingles(order_minhash.word_ids(r[1])) for r in rows]
    shared = [set(order_minhash.sketches(s)) for s in shingles]
    links = [(i, j) for i in range(160) for j in range(i) if shared[i] & shared[j] and order_minhash.similarity(shingles[i], shingles[j])]
    root = classes_of(160, links)
    assert 5 < len(set(root)) < 150
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    least = {c: min(i for i in range(160) if root[i] == c) for c in set(root)}
    assert [got[i] for i in range(160)] == [least[c] for c in root]


def test_common_counts_equal_sets():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint64)) for _ in range(40)]
    got = order_minhash._common_counts(texts[:15], texts[15:])
    assert (got == [[len(set(a.tolist()) & set(b.tolist())) for b in texts[15:]] for a in texts[:15]]).all()


@pytest.mark.parametrize("n", range(5, order_minhash.SUBSET_SHINGLES + 2))
def test_short_texts_one_word_apart_share_a_sketch(n):
    """For one, eight words against nine: four of five shingles, similarity exactly 0.8."""
    for seed in range(1000):
        longer = np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64)
        for k in range(n):
            shorter = np.delete(longer, k)
            assert order_minhash.similarity(shorter, longer) >= 0.8
            assert set(order_minhash.sketches(shorter)) & set(order_minhash.sketches(longer))


@pytest.mark.parametrize("n, gone, fresh", [(10, 2, 0), (9, 1, 1), (18, 2, 2), (45, 5, 5), (180, 20, 20), (100, 20, 0)])
def test_share_of_links_at_the_bound_that_meet(n, gone, fresh):
    """Pairs of similarity 0.8, or just above, share a sketch at least 99 times of 100."""
    met, tries = 0, 1000
    for seed in range(tries):
        rng = np.random.default_rng((seed, n))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.insert(np.delete(a, rng.choice(n, gone, replace=False)), rng.integers(0, n - gone + 1, fresh), rng.integers(0, 1 << 63, fresh, dtype=np.uint64))
        assert order_minhash.similarity(a, b) >= 0.8
        met += bool(set(order_minhash.sketches(a)) & set(order_minhash.sketches(b)))
    assert met >= 0.99 * tries


def test_texts_of_signs_are_one_class_only_if_equal(spark):
    texts = ["🙂 🙂", "🙂🙂\n", "🙂", "!!!", "! !\t!", "???", "", None, " \n", "one 🙂", "one"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, 2, 3, 3, 5, 6, 6, 6, 9, 9]


def brute_vectors(rows, cosine):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [i for i, (_, v) in enumerate(rows) if usable(v)]
    width = max((len(rows[i][1]) for i in good), default=1)
    x = np.array([np.pad(np.array(rows[i][1], dtype=np.float64), (0, width - len(rows[i][1]))) for i in good]).reshape(len(good), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    links = [(good[a], good[b]) for a, b in zip(*np.nonzero(near)) if a != b]
    degree = defaultdict(int)
    for a, _ in links:
        degree[a] += 1
    root = classes_of(len(rows), links)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(str((rows[i][0], degree[i], least[root[i]], rows[i][0] == least[root[i]])) for i in range(len(rows)))


@pytest.mark.parametrize("noise", [0.03, 0.12])
def test_vectors_equal_brute_force(spark, monkeypatch, noise):
    """Tight groups lie in a core; wide ones have pairs on both sides of the bound, in several blocks."""
    monkeypatch.setattr(projection_passes, "BLOCK", 40)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(120)]
    for c in range(4):
        centre = rng.standard_normal(16)
        rows += [(1000 + 200 * c + i, (centre + noise * rng.standard_normal(16)).tolist()) for i in range([3, 20, 60, 150][c])]
    rows += [(5000 + i, rows[0][1]) for i in range(5)] + [(5000, rows[0][1]), (None, rows[0][1])]
    rows += [(6000, None), (6001, [0.0] * 16), (6002, [1.0, float("nan")]), (6003, [1.0, None]), (6004, [float("inf")]), (6005, []), (6006, None)]
    rows += [(7000, [2.0] * 3), (7001, [1.0] * 3 + [0.0] * 5), (7002, [1e300] * 3), (7003, [1e-300] * 3)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = projection_passes.near_vectors(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_vectors(rows, 0.9)
    assert projection_passes.near_vectors(df.limit(0)).count() == 0


def test_recall_of_links_near_the_bound(spark):
    """Single pairs just above the bound, without a group to help, against brute force: at least nine in ten."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        a, b = rng.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.901 + 0.05 * rng.random()
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert projection_passes.near_vectors(df, window=64).where("n_links > 0").count() >= 0.9 * len(rows)


def linked_in_window(x, window, cosine=0.9):
    near = x @ x.T >= cosine
    return [(i, j) for i in range(len(x)) for j in range(max(0, i - window), i) if near[i, j]]


def test_later_blocks_bridge_older_trees():
    """Two trees of one block, joined by links of the next block to one vector of each."""
    step = math.acos(0.9) * 0.9
    x = np.zeros((400, 402))
    x[np.arange(400), np.arange(400) + 2] = 1
    for place, turns in ((50, 3), (60, 0), (100, 1), (300, 2)):  # linked: 60-100, 100-300, 300-50
        x[place] = 0
        x[place, :2] = math.cos(turns * step), math.sin(turns * step)
    a, b = projection_passes._window_links(x, np.arange(400), 0.9, 256)
    assert dict(zip(a.tolist(), b.tolist())) == {60: 50, 100: 50, 300: 50}


@pytest.mark.parametrize("seed", range(6))
def test_trees_of_one_pass_equal_brute_force(seed):
    """Chains dealt over many blocks: every link inside the window is kept by the trees."""
    rng = np.random.default_rng(seed)
    angle = rng.permutation(np.concatenate([c * 20 + np.arange(60) * 0.3 for c in range(4)]))
    turn = np.floor(angle / 20).astype(int)
    x = np.zeros((len(angle), 104))
    for i, (c, t) in enumerate(zip(turn, angle - 20 * turn)):
        place = t / 0.3 * 0.25  # chains on arcs between one axis and the next, in steps of 22.5 degrees
        x[i, 26 * c + int(place)], x[i, 26 * c + int(place) + 1] = math.cos(place % 1 * math.pi / 2), math.sin(place % 1 * math.pi / 2)
    for window in (8, 32, 100):
        a, b = projection_passes._window_links(x, np.arange(len(x)), 0.9, window)
        assert classes_of(len(x), list(zip(a.tolist(), b.tolist()))) == classes_of(len(x), linked_in_window(x, window))


def test_passes_grow_with_the_vectors():
    for n in (12_000, 1_000_000, 10_000_000, 60_000_000):
        hit = (1 - math.acos(0.9) / math.pi) ** math.log2(n / 256)
        assert (1 - hit) ** max(projection_passes.PASSES, projection_passes.passes_for(n, 0.9, 256)) <= 0.0101
    assert projection_passes.passes_for(60_000_000, 0.9, 256) > projection_passes.PASSES


def cone_pairs(pairs, dim=64, seed=7):
    """Pairs at cosine 0.92 in a cone of vectors with cosines of about 0.8, which do not link."""
    rng = np.random.default_rng(seed)
    u = rng.standard_normal((pairs, dim - 1))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.standard_normal((pairs, dim - 1))
    v -= (u * v).sum(axis=1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    mate = 0.6 * u + 0.8 * v
    sides = np.stack([u, mate], axis=1).reshape(2 * pairs, dim - 1)
    return np.concatenate([np.full((2 * pairs, 1), math.sqrt(0.8)), math.sqrt(0.2) * sides], axis=1)


@pytest.mark.parametrize("whole", [False, True])
def test_crowded_vectors_are_linked(spark, monkeypatch, whole):
    """A hot cone, in which one window and few passes miss most pairs: passes are added, or all pairs compared in blocks."""
    x = cone_pairs(1000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    if whole:
        monkeypatch.setattr(projection_passes, "PAIR_BLOCK", 300)
        monkeypatch.setattr(projection_passes, "passes_for", lambda *_: 1)
    window = 256 if whole else 4
    got = {r.vec_id: r.component_id for r in projection_passes.near_vectors(df, passes=4, window=window).collect()}
    want = classes_of(len(x), [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i > j])
    if whole:
        assert got == dict(enumerate(want))
    assert sum(got[i] == want[i] for i in range(len(x))) >= 0.98 * len(x)


def test_rare_links_in_a_cone_are_missed_by_a_sample_but_measured(spark):
    """6,000 vectors about 0.8 from each other, and 100 pairs at 0.92 among them: few passes with a window of 16 find too few."""
    alone = np.random.default_rng(4).standard_normal((6000, 127))
    alone /= np.linalg.norm(alone, axis=1, keepdims=True)
    every = np.concatenate([cone_pairs(100, 128), np.concatenate([np.full((6000, 1), math.sqrt(0.8)), math.sqrt(0.2) * alone], axis=1)])
    links = [(i, j) for i, j in zip(*np.nonzero(every @ every.T >= 0.9)) if i > j]
    assert 100 <= len(links) < 150
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in projection_passes.near_vectors(df, window=16).collect()}
    assert np.mean([got[i] == got[j] for i, j in links]) >= 0.9
