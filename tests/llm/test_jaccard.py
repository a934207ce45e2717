import random

import numpy as np
import pyarrow as pa
import pytest
from test_simhash import plain_fingerprint

import corpus_pipeline
from voxelweave.llm import jaccard, simhash

COLUMNS = "doc_id long, text string"


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def near_copies(rng, n):
    """Texts of some words, copies with words swapped, and a passage that many hold."""
    passage = " ".join(f"licence{i}" for i in range(40))
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((1, 3, 5, 8, 60, 250)))]
        texts.append(" ".join(words))
        if rng.random() < 0.3:
            texts.append(passage + " " + texts[-1])
        for _ in range(rng.randrange(4)):
            other = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(other))
    return texts


def test_a_pair_of_few_changed_words_leaves_one(spark):
    words = [f"w{i}" for i in range(454)]
    other = [f"x{i}" if i % 60 == 7 else w for i, w in enumerate(words)]
    one, two = " ".join(words), " ".join(other)
    assert alike(plain_set(one), plain_set(two)) and (simhash.fingerprint(one) ^ simhash.fingerprint(two)).bit_count() > 4
    df = spark.createDataFrame([(7, two), (2, one), (3, "something else"), (4, None), (5, "")], COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, df, "").collect()) == [2, 3, 4]


def test_sketches_never_drop_a_pair_that_is_alike_enough():
    rng = np.random.default_rng(4)
    dropped = 0
    for _ in range(2000):
        n = int(rng.integers(1, 1500))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = x[rng.random(len(x)) < rng.uniform(0.5, 1)]
        y = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64))))
        if len(y):
            common = len(np.intersect1d(x, y))
            ok = jaccard.may_be_alike(jaccard.sketch(x), jaccard.sketch(y))
            assert ok or 9 * common < 4 * (len(x) + len(y))
            dropped += not ok
    assert dropped > 500
    full = np.arange(0, 16 * 400, 16, dtype=np.uint64)  # all in one bucket, which is full
    assert jaccard.may_be_alike(jaccard.sketch(full), jaccard.sketch(full[:330]))


def test_shared_shingles_over_batches():
    rng = random.Random(6)
    rows = [(h, key, n, 0) for h, n, key in sorted((rng.randrange(60), key % 3 + 1, key) for key in (rng.randrange(7) for _ in range(200)))]
    names, types = ["h", "key", "n", "pos"], (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    want = []
    for h in range(60):
        own = list(dict.fromkeys(key for x, key, _, _ in rows if x == h))
        want += [(h, key, own[0]) for key in own if len(own) > 1]
    for size in (1, 2, 7, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + size]), types)], names) for i in range(0, len(rows), size)]
        assert [(r["h"], r["key"], r["first"]) for b in jaccard._shared(iter(parts)) for r in b.to_pylist()] == want, size


@pytest.mark.parametrize("seed, sample", [(1, 10_000), (2, 0)])
def test_links_against_all_pairs(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    monkeypatch.setattr(jaccard, "SHARE", 1.0 if sample else 0.0)
    monkeypatch.setattr(jaccard, "SEEN", 10 if sample else 500_000)
    monkeypatch.setattr(jaccard, "SHINGLE_ROWS", 4096 if sample else 3)
    monkeypatch.setattr(jaccard, "CLUSTER_ROWS", 1024 if sample else 2)
    texts = near_copies(random.Random(seed), 60) + [None, "", " "]
    sets, prints = [plain_set(t) for t in texts], [plain_fingerprint(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (alike(sets[i], sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 4) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), COLUMNS).repartition(3)).collect()}
    assert [found[i] for i in range(len(texts))] == root and 1 < len(set(root)) < len(texts)


def test_a_group_near_the_threshold(spark, monkeypatch):
    """Texts most of which are not alike enough, though every two share most of their words: chains through some of them must be found."""
    monkeypatch.setattr(jaccard, "CLUSTER_ROWS", 20)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            words[rng.randrange(80)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    sets, prints = [plain_set(t) for t in texts], [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (alike(sets[i], sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 4) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), COLUMNS).repartition(3)).collect()}
    assert [found[i] for i in range(len(texts))] == root and 1 < len(set(root))


def test_groups_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(3, base), (3, base), (3, "something else"), (None, base), (None, "null only"), (None, "null only"), (2, ""), (9, None), (3, "something else")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in jaccard.deduplicated(df).collect()), key=str) == sorted([(3, base), (3, "something else"), (None, "null only"), (2, "")], key=str)
    assert jaccard.deduplicated(df.limit(0)).collect() == []
    assert len(jaccard.shingles("a b")) == 1 and not len(jaccard.shingles(" ")) and list(map(jaccard.prefix_size, (0, 1, 5, 10))) == [0, 1, 2, 3]
    assert np.array_equal(jaccard.ordered(np.array([1, 5, 9], np.uint64), (np.array([5], np.uint64), np.array([4]))), [1, 9, 5])
