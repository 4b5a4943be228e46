import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, documents

from secstream.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    yield from ["", " ", "a", "aa", "a" * 700, "ab" * 900, "  \n\n  x", "é" * 300, "\x00\U0001F600" * 40, "z" * 64, "z" * 65,
                "<|endoftext|> don't we'LL 12345 ###", "　  \t"]
    for n in (1, 7, 40, 64, 65, 129, 2_000):
        for _ in range(8):
            yield "".join(chr(rng.choice([32, 10, 97, 98, 101, 116, 233, 0x4E2D, 0x1F600, 0x3000, 46, 49])) for _ in range(n))
            yield "".join(rng.choice("abcdefgh") for _ in range(n))


def test_both_trees_equal_the_library(reference):
    ranks, library = reference
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN, cache_pieces=50)
    for text in texts():
        packed = next(encoder.encode_block([text]))
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode_ids(packed, encoder.voc) == text.encode()


def test_long_tree_equals_lockstep(reference):
    voc = bpe.Vocabulary(reference[0])
    rng = random.Random(5)
    for n in range(2, 65):
        piece = bytes(rng.choice(b"aeinrst hglo") for _ in range(n))
        width = 1 << max(1, (n - 1).bit_length())
        assert np.frombuffer(bpe.encode_rows([piece], width, voc)[0], "<u4").tolist() == bpe.encode_long(piece, voc)


def test_query_over_awkward_rows(spark, reference):
    docs = awkward(spark)
    rows = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = reference[1].encode_ordinary(r.text or "")
        assert r.n_tokens == len(want) and r.ids == want
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_decode_empty_and_clash(spark):
    empty = documents(spark, [])
    out = bpe.encode(empty, PATH, public_tokenizers.PATTERN)
    assert out.count() == 0
    ids = spark.createDataFrame([([0, 1],), ([],), (None,)], "ids array<int>")
    assert [r.decoded is None for r in bpe.decode(ids, PATH).collect()] == [False, False, True]
    with pytest.raises(ValueError):
        bpe.encode(empty.withColumnRenamed("lang", "n_tokens"), PATH, public_tokenizers.PATTERN)
