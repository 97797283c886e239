import hashlib
import re

import pytest

from cellgrid.llm import merkle
from cellgrid.llm.common import text_or_empty
from pyspark.sql import functions as F

from .helpers import SCHEMA, awkward_rows, with_clashes

WS = r"\x20\x09-\x0D"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def parts_of(text):
    """Sections as lists of paragraphs."""
    cuts = [s for s in re.split(r"(?<=\n\n)(?=[^\n])", text)]
    return [re.split(r"(?<=\n)(?=[^\n])", s) for s in cuts]


def brute_root(text):
    return sha("".join(sha("".join(sha(p) for p in s)) for s in parts_of(text)))


def brute_pieces(text):
    """Words with their white space, joined until a sentence ends or twelve are together."""
    out = []
    for s in parts_of(text):
        for p in s:
            words = re.findall(rf"[{WS}]*[^{WS}]+[{WS}]*|[{WS}]+", p)
            now = []
            for w in words:
                now.append(w)
                if w.rstrip(" \t\n\x0b\f\r")[-1:] in tuple(".!?") or len(now) == 12:
                    out.append("".join(now))
                    now = []
            if now:
                out.append("".join(now))
    return set(out)


def weight(pieces):
    return sum(min(len(p), 65535) for p in pieces)


def brute_likeness(a, b):
    a, b = brute_pieces(a), brute_pieces(b)
    return 1.0 if not a | b else 2 * weight(a & b) / (weight(a) + weight(b))


def brute(rows, hashes):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    ids = sorted(texts, key=lambda i: (i is None, i or 0))
    stand_in = {i: min(texts[i], key=hashes.get) for i in ids}
    out = []
    for at, i in enumerate(ids):
        after = stand_in[ids[(at + 1) % len(ids)]]
        for t in texts[i]:
            n = len(t)
            edited = t[: n - n // 4] + after[: n // 4]
            out.append((i, n, sha(edited), brute_root(t), brute_root(edited), round(brute_likeness(t, edited), 9), round(brute_likeness(t, after), 9)))
    return sorted(out, key=str)


LINES = [
    (300, "a b.\n\nc d\ne f\n\n\n\ng", "en", "s", 1), (301, "\n\n\nx", "en", "s", 1), (302, "x\n\n", "en", "s", 1), (303, "\n", "en", "s", 1),
    (304, "." * 3000 + " " + "w" * 70_000, "en", "s", 1), (305, " ".join(f"w{i}" for i in range(40)), "en", "s", 1), (305, "other", "en", "s", 1),
    (305, "other", "en", "s", 1),
]


@pytest.mark.parametrize("rows", [awkward_rows() + LINES, LINES, [(1, "a b c d e f g h", "en", "s", 1)]])
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.t: r.h for r in df.select(text_or_empty("text").alias("t"), F.xxhash64(text_or_empty("text")).alias("h")).collect()}
    got = merkle.fingerprints(with_clashes(df)).collect()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    found = sorted(((*[r[n] for n in names], round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)
    assert found == brute(rows, hashes)


def test_order_over_many_partitions(spark):
    rows = [((i * 7919) % 100_003, f"text {i} " * (i % 5), "en", "s", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    got = {r.doc_id: r.edited_sha256 for r in merkle.fingerprints(df).collect()}
    ordered = sorted(rows)
    for (i, t, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        assert got[i] == sha(t[: len(t) - len(t) // 4] + after[: len(t) // 4])


def test_empty_table(spark):
    assert merkle.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("old, new", [
    ("a b c. d e f. g h i.", "a b c. d X f. g h i."),
    ("one.\ntwo.\n\nthree.\nfour.\n", "one.\ntwo.\n\nthree.\nmore.\nfour.\n"),
    ("one.\n\ntwo.\n\nthree.", "one.\n\nthree."),
    ("same text.", "same text."), ("", "new"), ("gone", None), (None, None), ("x. " * 50, "x. " * 49), ("y " * 90_000, "y " * 80_000 + "z"),
    ("w" * 70_000 + " a. b.", "w" * 70_001 + " a. b."), ("Ünï cödé. 🙂 end. more.", "Ünï cödé. 🙃 end. more."),
])
def test_edits_lie_within_the_located_span(spark, old, new):
    df = spark.createDataFrame([(old, new)], "old string, new string")
    r = merkle.locate_edits(df, "old", "new").first()
    old, new = old or "", new or ""
    assert r.same == (old == new)
    assert old[: r.old_start] == new[: r.new_start] and old[r.old_end :] == new[r.new_end :]
    assert 0 <= r.old_start <= r.old_end <= len(old) and 0 <= r.new_start <= r.new_end <= len(new)
    if old == new:
        assert r.old_start == r.old_end and r.new_start == r.new_end


def test_span_is_that_of_the_changed_sentence(spark):
    text = "".join(f"Sentence {i} stands here. " + ("\n" if i % 5 == 4 else "") + ("\n" if i % 20 == 19 else "") for i in range(100))
    new = text.replace("Sentence 47 stands", "Sentence 47 lies")
    r = merkle.locate_edits(spark.createDataFrame([(text, new)], "a string, b string"), "a", "b").first()
    assert text[r.old_start : r.old_end].strip() == "Sentence 47 stands here." and new[r.new_start : r.new_end].strip() == "Sentence 47 lies here."


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = merkle.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
