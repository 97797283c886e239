"""Registered queries of this subpackage (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import co_training, conv_toxicity, exact_dedup, gnat_codes, html_density, merkle, orc_tokens, order_minhash, packing, prefix_bpe, projection_passes, secret_ledger, sorted_edits
from .common import stage_path, table


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = co_training.quality_scores(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.withColumn("held_out", conv_toxicity.held_out("doc_id"))


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(table(spark, sf_dir, "pages"))


def op3_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = conv_toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return conv_toxicity.score_toxicity(docs, model)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "orc-tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    orc_tokens.write_orc_tokens(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return orc_tokens.with_checksums(orc_tokens.read_orc_tokens(spark, path))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = order_minhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "kept")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.new_ledger(spark).scan(table(spark, sf_dir, "documents"), path_cols=["doc_id"])
    joined = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in secret_ledger.RULES], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, end_id=1, with_ids=False)


def op10_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op12_sorted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_edits.spelling_variants(table(spark, sf_dir, "documents"))


def op13_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat_codes.encode_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_co_training, op2_text_density, op3_conv_toxicity, op4_exact_dedup, op5_orc_tokens, op6_prefix_bpe, op7_order_minhash, op8_secret_ledger, op9_packing,
    op10_projection_passes, op11_merkle, op12_sorted_edits, op13_gnat_codes,
)}

# Characters of one class, so that RE2's case folding adds none outside ASCII.
_KEYWORD = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = f"""({_KEYWORD})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")

_DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def _sql_spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, '{kind}' AS kind, {number} AS kind_no,
      list_sum(gaps[:i])::BIGINT + coalesce(list_sum(lens[:i - 1]), 0)::BIGINT AS s,
      list_sum(gaps[:i])::BIGINT + list_sum(lens[:i])::BIGINT AS e
    FROM (
      SELECT doc_id, gaps, lens, parts, unnest(range(1, len(lens) + 1)) AS i FROM (
        SELECT doc_id,
          [length(x) for x in string_split_regex(text, '{pattern}')] AS gaps,
          [length(x) for x in regexp_extract_all(text, '{pattern}', 0)] AS lens,
          [length(x) for x in regexp_extract_all(text, '{pattern}', {group})] AS parts
        FROM d))
    WHERE parts[i] >= {least}"""


def _sql_codes(parts: int = gnat_codes.PARTS, entries: int = gnat_codes.ENTRIES, rounds: int = gnat_codes.ROUNDS) -> str:
    """All distances of every round; the nearest entry is the least of distance * 256 + entry."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor({gnat_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT row, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS r(part)
), book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS c FROM cut WHERE row <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
  SELECT row, part, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + entry) AS best
  FROM cut JOIN book{i} USING (part) GROUP BY row, part
)""")
        if i < rounds:
            steps.append(f"""
mean{i} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM (
    SELECT part, best % 256 AS entry, place, sum(x[place])::BIGINT AS s, count(*) AS n
    FROM cut JOIN near{i} USING (row, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS place) GROUP BY ALL
  ) GROUP BY part, entry
), book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""
WITH {",".join(steps)}, coded AS (
  SELECT row, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM near{rounds} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest"""


# Pieces as in the operator; sections and paragraphs by a mark after line ends, since RE2 has no look-around.
_MARK = "chr(65535)"
_TREE = f"""
    SELECT *, sha256(array_to_string(list_transform(secs, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(p)), ''))), '')) AS root,
      list_distinct(flatten(list_transform(flatten(secs), lambda p: list_filter(regexp_extract_all(p, '{merkle.PIECE}'), lambda x: x <> '')))) AS pieces
    FROM (
      SELECT *, CASE WHEN body = '' THEN [['']] ELSE list_transform(
        list_filter(string_split(regexp_replace(body, '(\n\n+)', '\1' || {_MARK}, 'g'), {_MARK}), lambda s: s <> ''),
        lambda s: list_filter(regexp_extract_all(s, '[^\n]*\n*'), lambda p: p <> '')) END AS secs
      FROM texts)"""


def _sql_likeness(a: str, b: str) -> str:
    def weight(x: str) -> str:
        return f"coalesce(list_sum(list_transform({x}, lambda x: least(length(x), 65535))), 0)"

    both = f"({weight(a)} + {weight(b)})"
    return f"CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {weight(f'list_intersect({a}, {b})')} / {both} END"


ORACLES = {
    "op11_merkle": f"""
WITH d AS ({_DOCS}), w AS (
  SELECT *, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS everything FROM d
), e AS (
  SELECT a.doc_id, a.n, a.text, b.doc_id AS next_id, left(a.text, a.n - a.n // 4) || left(b.text, a.n // 4) AS edited
  FROM w a JOIN w b ON b.place = a.place % a.everything + 1
), texts AS (SELECT doc_id, false AS changed, text AS body FROM e UNION ALL SELECT doc_id, true, edited FROM e), t AS ({_TREE})
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, o.root AS fingerprint, c.root AS edited_fingerprint,
  {_sql_likeness('o.pieces', 'c.pieces')} AS near_edited, {_sql_likeness('o.pieces', 'f.pieces')} AS near_next
FROM e JOIN t o ON o.doc_id = e.doc_id AND NOT o.changed JOIN t c ON c.doc_id = e.doc_id AND c.changed
JOIN t f ON f.doc_id = e.next_id AND NOT f.changed""",
    "op13_gnat_codes": _sql_codes(),
    "op4_exact_dedup": f"""
WITH n AS (
  SELECT doc_id, length(text) AS size, sha256(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM ({_DOCS})
), r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r""",
    "op8_secret_ledger": f"""
WITH d AS ({_DOCS}), f AS ({" UNION ALL ".join((
        _sql_spans("assign", 0, _ASSIGN, 2, 6),
        _sql_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20),
        _sql_spans("hex", 2, "[0-9a-f]+", 0, 24),
    ))}
), g AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
    count(*) FILTER (kind_no = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans
  FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)""",
}
