import hashlib
import re

import pytest

from cellgrid.llm import exact_dedup

from .helpers import SCHEMA, awkward_rows, with_clashes


def brute(rows):
    groups = {}
    for place, (doc_id, text, *_) in enumerate(rows):
        text = text or ""
        normal = re.sub(r"[\x20\x09-\x0D]", "", text)
        groups.setdefault(normal, []).append(((-len(text), doc_id is None, doc_id or 0, place), doc_id))
    out = []
    for normal, members in groups.items():
        best = min(members)
        for member in members:
            out.append((member[1], best[1], len(members), member is best, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bytes", [exact_dedup.MAX_FILTER_BYTES, 4096])
def test_marks_equal_brute_force(spark, max_bytes):
    rows = awkward_rows()
    got = exact_dedup.mark_copies(with_clashes(spark.createDataFrame(rows, SCHEMA).coalesce(1)), carry=["doc_id"], max_filter_bytes=max_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_full_filter_only_costs_shuffles(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 0)  # one block for all
    rows = [(i, str(i % 3000), "en", "s", 1) for i in range(5000)]
    got = exact_dedup.mark_copies(spark.createDataFrame(rows, SCHEMA), carry=["doc_id"])
    assert got.where("kept").count() == 3000 and got.count() == 5000


def test_single_hashes_mostly_pass_straight(spark):
    rows = [(i, str(i % 4000), "en", "s", 1) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("sha2(text, 256) AS digest", "text")
    blocks = exact_dedup.filter_blocks(5000)
    flagged = exact_dedup.possibly_repeated(df, "digest", exact_dedup.repeated_positions(df, "digest", blocks), blocks, "maybe")
    maybe = {r.text for r in flagged.where("maybe").collect()}
    assert {str(i) for i in range(1000)} <= maybe and len(maybe) < 1050


def test_drop_keeps_columns_and_empty_table(spark):
    df = with_clashes(spark.createDataFrame(awkward_rows(), SCHEMA))
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len({r[-1] for r in brute(awkward_rows())})
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.mark_copies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
