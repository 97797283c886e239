import random
import re
import zlib
from collections import Counter

import pytest

from cellgrid.llm import sorted_edits
from cellgrid.llm.common import Scratch

from .helpers import SCHEMA, awkward_rows, with_clashes


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if distance_is_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def variants(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcé") + word[at + 1 :], word[:at] + rng.choice("abcé") + word[at:], word])


def wordy_rows(seed, docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["Straßenbahn", "aaaaaaa", "aaaaaaaa", "aaaaaa"]
    rows = []
    for i in range(docs):
        words = [variants(rng, w) if rng.random() < 0.3 else w for w in rng.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=120)]
        rows.append((i, " ".join(words) + "; ÀÖ×÷ABCDEF " + rng.choice(["x", "日本 abcdefg", ""]), "en", "s", 1))
    return rows


@pytest.mark.parametrize("rows", [wordy_rows(1), wordy_rows(2, 200), awkward_rows(), [(1, "abcdef " * 5 + "abcdeg " * 30 + "abcdxg " * 200, "en", "s", 1)]])
@pytest.mark.parametrize("most", [sorted_edits.LIST_WORDS, 2])
def test_equals_brute_force(spark, rows, most):
    got = sorted_edits.spelling_variants(with_clashes(spark.createDataFrame(rows, SCHEMA)), list_words=most)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == brute(rows)


def test_empty_and_wordless_tables(spark):
    for rows in ([], [(1, None, "en", "s", 1), (2, "a b c 1 2 3", "en", "s", 1)]):
        assert sorted_edits.spelling_variants(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_hot_half_is_cut_until_lists_are_bounded(spark, most):
    """All words share their first half, and many their last: no pair is lost or doubled however lists are cut."""
    rng = random.Random(most)
    words = {"common" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(150)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) + "ending" for _ in range(80)} | {"a", "b", "ab", "ba", "abc"}
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    scratch = Scratch(spark)
    got = sorted((r.word, r.near) for r in sorted_edits.near_pairs(df, scratch, most=most).collect())
    assert got == sorted((u, v) for u in words for v in words if distance_is_one(u, v))
    sizes = sorted_edits.bounded_lists(df, scratch, most).where("b - a > 1").groupBy(sorted_edits.KEY).count()
    assert sizes.where(f"count > {most}").count() == 0


def test_scan_reuses_rows_and_skips_ranges():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(3000)})
    lcp = sorted_edits.lcps(words, 0)
    total = 0
    for q in words[:60] + [variants(rng, w) for w in words[:60]]:
        if len(q) not in (7, 8):
            continue
        found, computed = sorted_edits.one_edit(q, words, lcp, 0)
        total += computed
        assert [words[i] for i in found] == [w for w in words if distance_is_one(q, w)]
    assert total < 120 * 3000  # less than a row a word, where the whole matrix has eight
