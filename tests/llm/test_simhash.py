import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from voxelweave.llm import op1, simhash


def plain_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, budget):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "A b C d", "x\x1cy z w İ K", "Wort " * 50, "ä Ö " * 9 + "end"])
def test_fingerprint_as_plainly_written(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clustered(rng, n):
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        out.add(c)
        for _ in range(rng.randrange(12)):
            c ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                c ^= 1 << rng.randrange(64)
            out.add(c)
    return sorted(out)


@pytest.mark.parametrize("budget", [0, 1, 4, 7])
def test_trie_self_join_against_all_pairs(budget):
    rng = random.Random(budget)
    keys, bounds = [], [0]
    for n in (1, 2, 70, 300):
        keys += clustered(rng, n)
        bounds.append(len(keys))
    label = simhash.trie_self_join(np.array(keys, np.uint64), np.array(bounds), budget)
    for a, b in zip(bounds, bounds[1:]):
        want = plain_components(keys[a:b], budget)
        got = {k: keys[label[a + i]] for i, k in enumerate(keys[a:b])}
        assert got == want


def test_pruning_does_the_work():
    """On the fingerprints of given documents: of all leaf pairs of the trie, few are compared, and all links are found."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:3000]
    keys = np.unique(np.fromiter(map(simhash.fingerprint, texts), np.uint64))
    counts = Counter()
    label = simhash.trie_self_join(keys, np.array([0, len(keys)]), 4, counts=counts)
    assert counts["over"] > 0.7 * len(keys) ** 2 / 2 > 3 * counts["compared"]
    near = [np.flatnonzero(np.bitwise_count(keys ^ k) <= 4) for k in keys]
    assert all((label[x] == label[i]).all() for i, x in enumerate(near))
    links = sum(len(x) - 1 for x in near)
    assert links and len(set(label.tolist())) >= len(keys) - links


@pytest.mark.parametrize("rows, k", [(1000, 1), (10**6, 1), (10**9, 2), (10**12, 3)])
def test_tries_that_share_enough_bits(rows, k):
    masks = simhash._routes(4, rows, simhash.SUBTREE_ROWS)
    rng = random.Random(rows)
    assert all(rows >> m.bit_count() <= 2 * simhash.SUBTREE_ROWS for m in masks) and len(masks) == math.comb(4 + k, k)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_query(spark, tmp_path):
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*base[:k], "other", *base[k + 1:]]) if k % 3 else " ".join(base)) for k in range(40)] + [(50, None), (51, ""), (52, "ÄA b"), (None, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS root").write.parquet(f"{tmp_path}/documents.parquet")
    prints = {d: plain_fingerprint(t or "") for d, t in rows}
    root = plain_components(sorted(set(prints.values())), 4)
    least = {}
    for d in sorted(x for x in prints if x is not None):
        least.setdefault(root[prints[d]], d)
    got = op1.op1_simhash_near_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in prints.items()), key=str)


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (None, "x"), (None, "x"), (3, "y")], "doc_id long, text string").selectExpr("*", "doc_id AS gone_id", "7 AS again_id", "'z' AS Gone_Id0")
    got = simhash.deduplicated(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a b c"), (None, "x"), (3, "y")], key=str)


@pytest.mark.parametrize("subtree_rows", [1024, 1])
@pytest.mark.parametrize("bucket_rows", [8192, 5])
def test_components_against_all_pairs(spark, bucket_rows, subtree_rows):
    """Small subtrees are salted; the second pass must find what chunks of one hid from each other."""
    rng = random.Random(7)
    fps = clustered(rng, 250)
    centre = rng.getrandbits(64)
    fps = sorted({*fps, *(centre ^ (1 << i) ^ (1 << j) for i in range(9) for j in range(i)), centre ^ 0b111111 << 40})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    rows = simhash.linked_components(spark.createDataFrame(signed, "fp long"), 4, bucket_rows, subtree_rows).collect()
    want = plain_components(fps, 4)
    groups = defaultdict(set)
    for f, r in want.items():
        groups[r].add(f)
    got = defaultdict(set)
    for r in rows:
        got[r.root].add(r.fp % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_rows_of_every_kind(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (3, base, 2), (9, base.replace("w7 ", "v7 "), 3), (2, "", 0), (1, None, 0), (8, " \n", 0), (7, "other words entirely", 0), (7, "other words entirely", 0), (None, "alone here", 0), (None, base, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnsRenamed({})
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    ok = (simhash.fingerprint(base) ^ simhash.fingerprint(rows[2][1])).bit_count() <= 4
    assert got == sorted([(5, 3), (3, 3), (9, 3 if ok else 9), (2, 1), (1, 1), (8, 1), (7, 7), (7, 7), (None, None), (None, 3)], key=str)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
