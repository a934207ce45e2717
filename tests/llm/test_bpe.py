import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from voxelweave.llm import bpe
from voxelweave.llm.op4 import VOCABULARY, round_trip

RANKS = bpe.read_ranks(open(P.path(VOCABULARY), "rb").read())
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BITS = ["the", " of", "'", "s", "'re", "re", "  ", "\n", " \n ", "\t", "!", "?!", "123", "4", "ñ", "é", "é", "日本", "😀", " ", " ", "aaaa", "Straße", " x", "'ll", "_", "0.5", "<|endoftext|>", "\x1c", "\x85", "ation", "zq"]


@pytest.mark.parametrize("leaf", [(1, 1), (2, 3), (7, 4), (64, 24), (2048, 24)])
def test_as_the_library(leaf):
    enc = bpe.Encoder(RANKS, P.PATTERN, *leaf)
    rng = random.Random(str(leaf))
    for _ in range(400):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(60)))
        want = PLAIN.encode_ordinary(text)
        assert enc.encode(text).tolist() == want, text
        assert enc.decode(want) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, " " * 4000 + "x", "\n" * 3001, "x" * 2047 + "'" + "s" * 2050, "!" * 5000 + "'s", "ñ日" * 2000, "0" * 4097, "'" * 4099])
def test_long_runs(text):
    for leaf in ((64, 8), (512, 12), (2048, 24)):
        enc = bpe.Encoder(RANKS, P.PATTERN, *leaf)
        ids = PLAIN.encode_ordinary(text)
        assert enc.encode(text).tolist() == ids and enc.decode(ids) == text.encode()


def test_long_window_merges_alike():
    enc = bpe.Encoder(RANKS, P.PATTERN, 2048, 24)
    rng = random.Random(3)
    for _ in range(200):
        data = "".join(rng.choice(BITS) for _ in range(30)).encode()[:96]
        assert enc._merged_long(data) == enc._merged(data)


def test_rows_of_every_kind(spark):
    rows = [(1, "The cat's  hat\n", 1), (2, None, 2), (3, "", 3), (1, "The cat's  hat\n", 1), (None, "x" * 9000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, round_trip(df).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = PLAIN.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert round_trip(df.limit(0)).collect() == []
    path = P.path(VOCABULARY)
    apart = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN)
    assert sorted(map(tuple, apart.collect()), key=str) == sorted(map(tuple, bpe.encode_and_decode(df, path, P.PATTERN).collect()), key=str)
