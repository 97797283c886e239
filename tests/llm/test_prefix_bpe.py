import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cellgrid.llm import prefix_bpe

from .helpers import SCHEMA, awkward_rows, with_clashes

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LETTERS = "abc def'stlér日本🙂\n\t 12!?ABC  \x1c\x85　\0"


@pytest.fixture(scope="module")
def bpe():
    return prefix_bpe.PrefixBpe.from_file(PATH)


@pytest.fixture(scope="module")
def exact(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}).encode_ordinary


def test_random_texts(bpe, exact):
    rng = random.Random(2)
    coder = prefix_bpe.TextCoder(bpe, PATTERN, memory=200)
    for _ in range(3000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40)))
        ids = coder.encode(text)
        assert ids == exact(text) and bpe.decode(ids) == text.encode()


def test_other_vocabulary_and_long_piece(bpe, exact):
    small = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate((b"ab", b"bc", b"abc", b"aa", b"aaaa", b"cab"))}
    reference = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=small, special_tokens={})
    own = prefix_bpe.PrefixBpe(small)
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
        assert own.encode_piece(text.encode()) == reference.encode_ordinary(text)
    assert prefix_bpe.TextCoder(bpe, PATTERN).encode("ab" * 20_000) == exact("ab" * 20_000)


def test_appends_and_edits(bpe, exact):
    rng = random.Random(4)
    for _ in range(150):
        text = prefix_bpe.EditableEncoding(bpe, PATTERN, "")
        for _ in range(8):
            new = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 9)))
            begin = rng.randint(0, len(text.text))
            if rng.random() < 0.4:
                text.append(new)
            else:
                text.replace(begin, min(len(text.text), begin + rng.randint(0, 5)), new)
            assert text.ids == exact(text.text)


def test_edit_keeps_far_pieces(bpe):
    text = prefix_bpe.EditableEncoding(bpe, PATTERN, "some words " * 1000)
    before = [id(x) for x in text.lasts]
    text.replace(5000, 5004, "other")
    assert len(set(before) & {id(x) for x in text.lasts}) > 1990


def test_frames(spark, bpe, exact):
    rows = awkward_rows()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = prefix_bpe.round_trip_digests(df, PATH, PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(str(r[0]), len(exact(r[1] or "")), sha(",".join(map(str, exact(r[1] or ""))).encode()), sha((r[1] or "").encode())) for r in rows]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    decoded = prefix_bpe.decode_ids(prefix_bpe.encode_texts(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in decoded) == sorted((r[1] or "").encode() for r in rows)
    assert prefix_bpe.round_trip_digests(df.limit(0), PATH, PATTERN).count() == 0
