import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cellgrid.llm import byte_tokens, common, orc_tokens, packing, segment_pool
from cellgrid.session import stage_path

from .helpers import SCHEMA, awkward_rows, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_segment_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(5)
    letters = "abc def'stlér日本🙂\n\t 12!?ABC  \x1c\x85　 \0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b  c", "", " ", "  ", "\n", "x" * 3000]
    coder = byte_tokens.SegmentEncoder(PATH, memory=500)
    texts += [" ".join("".join(rng.choice(letters[:14] + ".,!)%") for _ in range(rng.randint(0, 6))) for _ in range(30)) for _ in range(300)]
    got = []
    for i in range(0, len(texts), 100):
        flat, counts = coder.encode(pa.array(texts[i : i + 100]))
        got += np.split(flat, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [ids_of(tokenizer, t) for t in texts]
    assert [len(x) for x in coder.encode(pa.array([], pa.string()))] == [0, 0]


def test_byte_batches_hold_every_row_once():
    batch = pa.record_batch([pa.array(range(8)), pa.array(["a" * 5, None, "", "b" * 50, "c" * 9, "d" * 9, "e", "f"])], names=["i", "t"])
    parts = list(segment_pool.byte_batches([batch, batch.slice(3, 0)], 1, 20))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6, 7]]


def test_ids_of_forgotten_and_recalled_segments(tokenizer):
    coder = byte_tokens.SegmentEncoder(PATH, memory=3)
    for text in ("one two three four", "five one, six", "one seven two eight", "nine one ten", "two one."):
        flat, _ = coder.encode(pa.array([text, text]))
        assert flat.tolist() == ids_of(tokenizer, text) * 2


def test_orc_files_in_id_order(spark, tokenizer):
    rows = awkward_rows()
    path = stage_path(spark, "orc-test")
    orc_tokens.write_orc_tokens(with_clashes(spark.createDataFrame(rows, SCHEMA)), path, PATH, end_id=2, files=3)
    got = orc_tokens.read_orc_tokens(spark, path).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(r[0]), ids_of(tokenizer, r[1]) + [2]) for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in orc_tokens.with_checksums(orc_tokens.read_orc_tokens(spark, path)).collect()}
    assert all(sums[r.doc_id, r.start] == crc(r.ids) for r in got)
    assert [r.doc_id for r in orc_tokens.find_documents(spark, path, [7, 999]).collect()] == [7]
    orc_tokens.write_orc_tokens(spark.createDataFrame([], SCHEMA), path, PATH, end_id=2)
    assert orc_tokens.read_orc_tokens(spark, path).count() == 0


@pytest.mark.parametrize("window", [7, 2048])
def test_packing_is_gapless(spark, tokenizer, window):
    rows = awkward_rows()
    pieces = packing.pack(with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3)), PATH, end_id=1, window=window).collect()
    pieces.sort(key=lambda p: (p.sequence_id, p.offset))
    stream, at = [], 0
    for p in pieces:
        assert (p.sequence_id, p.offset) == divmod(at, window) and 0 < p.length and p.offset + p.length <= window
        ids = np.frombuffer(p.ids, "<u2").tolist()
        assert len(ids) == p.length and crc(ids) == p.ids_crc32
        stream += [(p.doc_id, p.start, p.doc_tokens, i) for i in ids]
        at += p.length
    docs, begin = [], 0
    while begin < len(stream):
        n = stream[begin][2]
        part = stream[begin : begin + n]
        assert {x[0] for x in part} == {stream[begin][0]} and part[0][1] == 0
        docs.append((str(part[0][0]), [x[3] for x in part]))
        begin += n
    assert sorted(docs) == sorted((str(r[0]), ids_of(tokenizer, r[1]) + [1]) for r in rows)
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH, end_id=1).count() == 0


def test_another_operator_takes_over_a_worker():
    forgotten = []
    common.claim_memory("one", lambda: forgotten.append("one"))
    common.claim_memory("one", lambda: forgotten.append("one"))
    assert forgotten == []
    byte_tokens.encoder(PATH)
    assert forgotten == ["one"] and byte_tokens._ENCODERS
    common.claim_memory("two", lambda: None)
    assert not byte_tokens._ENCODERS
