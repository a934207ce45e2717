import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from voxelweave.llm import pfor, tokenfile
from voxelweave.llm.op7 import END, VOCABULARY, op7_token_files

PLAIN = Tokenizer.from_file(P.path(VOCABULARY))
BITS = ["Don't", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "É", "é", "H̱", "T̈", "İ", "Σ", "ΑΣ", "ß", "日本", "😀", "3.14", "'LL", "||", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|end", "oftext|>", "word", "Word", " ", "ſ", "Å", "ñ"]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = np.minimum((rng.pareto(0.4, n) * 3).clip(0, 2**32 - 1).astype(np.uint64), top).astype(np.uint32)
    if n:
        ids[rng.integers(0, n, n // 20 + 1)] = top
    p = pfor.pack(ids)
    assert (pfor.unpack(p) == ids).all() and len(pfor.unpack(p)) == n
    assert all((pfor.unpack(p, a, b) == ids[a * pfor.BLOCK:b * pfor.BLOCK]).all() for a in range(0, len(p.least), 7) for b in (a, a + 1, len(p.least)))
    d = [ids[k * 128:(k + 1) * 128] - ids[k * 128:(k + 1) * 128].min() for k in range(n // 128)]
    for k, x in enumerate(d):  # the width holds the percentile chosen, and no less would
        assert (x < 1 << int(p.width[k])).mean() >= 0.9 and (p.width[k] == 0 or (x < 1 << (int(p.width[k]) - 1)).mean() < 0.9)
        assert p.patched[k] == (x >= 1 << int(p.width[k])).sum()


def test_segments_round_trip_and_show_damage():
    ids = np.arange(1000, dtype=np.uint32) ** 2 % 4999
    data = pfor.write_segment(3, 7, ["a", None, "é"], np.array([10, 0, 990]), ids)
    s, end = pfor.read_segment(b"xx" + data + b"yy", 2)
    assert end == 2 + len(data) and (s.part, s.number, s.doc_ids, s.counts.tolist()) == (3, 7, ["a", None, "é"], [10, 0, 990])
    assert (s.ids() == ids).all() and (s.ids_between(100, 517) == ids[100:517]).all() and len(s.ids_between(5, 5)) == 0
    with pytest.raises(ValueError):
        pfor.read_segment(data[:-1] + bytes([data[-1] ^ 1]))


def test_words_are_encoded_as_the_library_encodes_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(1500)]
    got = tokenfile.WordEncoder(open(P.path(VOCABULARY), "rb").read(), remembered=50).encode_all(texts, END)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*PLAIN.encode(text, add_special_tokens=False).ids, END], text


def expected(rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, END], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_rows_of_every_kind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 50)
    rows = [(i * 3 % 40 - 9, " ".join(["word", "Éa", "x1"] * (i % 9))) for i in range(60)] + [(None, "no id"), (2, None), (2, ""), (2, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'s' AS segment")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op7_token_files(spark, str(tmp_path)).collect()), key=str) == expected(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op7_token_files(spark, f"{tmp_path}/none").collect() == []


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    assert sorted(map(tuple, op7_token_files(spark, sf).collect()), key=str) == expected(list(zip(t["doc_id"], t["text"])))
