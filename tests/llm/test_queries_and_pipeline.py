"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cellgrid.llm import order_minhash
from cellgrid.llm.common import table
from cellgrid.llm.queries import ORACLES, QUERIES
from tests.conftest import TESTDATA
from tests.oracle_check import compare, duck

from .helpers import SCHEMA, awkward_rows
from .test_near_duplicates import brute_similarity
from .test_secret_ledger import brute, rows_with_secrets
from .test_sorted_edits import brute as brute_variants

FOLDER = f"{TESTDATA}/sf0.001"


def test_one_query_per_operator_is_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, FOLDER), duck(FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op1_co_training", "op2_text_density", "op6_prefix_bpe", "op7_order_minhash", "op10_projection_passes", "op11_merkle", "op13_gnat_codes"])
def test_query_returns_a_row_an_input(spark, name):
    source = {"op2_text_density": "pages", "op10_projection_passes": "embeddings", "op13_gnat_codes": "embeddings"}.get(name, "documents")
    assert entry.queries()[name](spark, FOLDER).count() == table(spark, FOLDER, source).count()


def test_spelling_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    got = entry.queries()["op12_sorted_edits"](spark, FOLDER).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_variants(rows)


def text_key(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, FOLDER, "documents")
    all_rows = {r.doc_id: r for r in docs.collect()}
    kept = stages["quality"](spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    rows = kept.collect()
    assert all(r == all_rows[r.doc_id] for r in rows)
    good = [i for i, q in labels.items() if q == 1]
    assert len({r.doc_id for r in rows} & set(good)) > 0.95 * len(good)

    once = stages["exact_dedup"](spark, kept, FOLDER)
    groups = {}
    for r in rows:
        groups.setdefault(text_key(r.text), []).append(r)
    assert {r.doc_id for r in once.collect()} == {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}

    apart = stages["near_dedup"](spark, once, FOLDER)
    left, before = {r.doc_id: r.text for r in apart.collect()}, once.collect()
    shingles = {r.doc_id: order_minhash.labelled_shingles(order_minhash.word_ids(r.text)) for r in before}
    for r in before:  # whoever went has a near copy, of those who stayed no two are one
        near = [o.doc_id for o in before if o.doc_id != r.doc_id and order_minhash.similarity(shingles[r.doc_id], shingles[o.doc_id])]
        assert (r.doc_id in left) or near
        assert not (r.doc_id in left and set(near) & set(left))

    masked = stages["secrets"](spark, apart, FOLDER)
    assert masked.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts.keys() == left.keys() and all((texts[i] == left[i]) == (not brute(left[i])) for i in left)
    assert all(r.n_chars == len(r.text) for r in masked.collect())

    packed = stages["packing"](spark, masked, FOLDER)
    assert {r.doc_id for r in packed.collect()} == set(left)


def test_stages_take_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(awkward_rows() + rows_with_secrets()[-8:], SCHEMA)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, FOLDER)
            assert out.count() >= (1 if frame is docs else 0)
            frame_is_last = "sequence_id" in out.columns
            assert frame_is_last or out.columns == docs.columns


def test_similarity_used_is_the_brute_one():
    a, b = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u"
    s = [order_minhash.labelled_shingles(order_minhash.word_ids(t)) for t in (a, b)]
    assert order_minhash.similarity(*s) == pytest.approx(brute_similarity(a, b))
