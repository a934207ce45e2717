import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import brown
from voxelweave.llm.op9 import op9_lm_scores

DATA = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [""]


def test_exchange_gains_what_it_says_and_ends_at_a_local_maximum():
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 40)
    b = rng.poisson(1 + 20.0 * ((kind[:, None] + 1) % 3 == kind[None, :])).astype(float)
    classes = brown.exchange_classes(b, 5)
    top = brown.likelihood(b, classes, 6)
    assert classes[0] == 0 and classes[-1] == 5 and ((classes[1:-1] > 0) & (classes[1:-1] < 5)).all()
    for s in range(1, 39):
        for k in range(1, 5):
            other = classes.copy()
            other[s] = k
            assert brown.likelihood(b, other, 6) <= top + 1e-6
    assert all(len(set(classes[1:-1][kind[1:-1] == k])) <= 2 for k in range(3))


def test_gains_are_those_of_the_likelihood_to_first_order():
    """A rare word moved from a class of its own into each of the others."""
    rng = np.random.default_rng(2)
    g = rng.integers(1000, 90_000, (6, 6)).astype(float)
    before, after = np.array([3.0, 0, 1, 0, 2, 0]), np.array([0, 4.0, 0, 1, 0, 1])
    found = brown.gains(g, before[None], after[None])[0]

    def likelihood(k):
        whole = g.copy()
        whole[k] += before
        whole[:, k] += after
        return brown._xlogx(whole).sum() - brown._xlogx(whole.sum(axis=1)).sum() - brown._xlogx(whole.sum(axis=0)).sum()

    exact = np.array([likelihood(k) for k in range(6)])
    assert found - found.mean() == pytest.approx(exact - exact.mean(), abs=0.01) and found.argmax() == exact.argmax()


def test_frequent_words_with_ties(spark):
    counts = spark.range(150_000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(7).cast("long").alias("n"))
    assert 90_000 <= counts.filter(brown.is_frequent(counts, 100_000)).count() <= 100_000
    more = counts.unionByName(spark.range(50).select(F.concat(F.lit("top"), "id").alias("word"), (100 + F.col("id")).alias("n"))).unionByName(spark.createDataFrame([("", 10**6)], "word string, n long"))
    found = {r.word for r in more.filter(brown.is_frequent(more, 1000)).collect()}
    assert {f"top{k}" for k in range(50)} < found and 850 <= len(found) <= 1000 and "" not in found
    assert more.filter(brown.is_frequent(more, 10**6)).count() == 150_050
    assert counts.limit(0).filter(brown.is_frequent(counts.limit(0), 10)).count() == 0


@pytest.mark.parametrize("known, swept, held, slots", [(100_000, 2000, 250_000, 1 << 22), (40, 20, 100, 500)])
def test_against_a_plain_version(spark, monkeypatch, known, swept, held, slots):
    monkeypatch.setattr(brown, "SLOTS", slots)
    monkeypatch.setattr(brown, "HELD_CELLS", held)
    monkeypatch.setattr(brown, "KNOWN_WORDS", known)
    monkeypatch.setattr(brown, "SWEPT", swept)
    monkeypatch.setattr(brown, "HELD", held)
    heads, count = [], brown.symbol_bigrams
    monkeypatch.setattr(brown, "symbol_bigrams", lambda docs, head: heads.append([w.decode() for w in head]) or count(docs, head))
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    docs = list(zip(docs["doc_id"], docs["text"]))
    got = {r.doc_id: r for r in op9_lm_scores(spark, DATA).collect()}
    (head,) = heads
    learn = [tokens(t) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in learn for w in t)
    n, v = sum(c.values()), len(c)
    assert swept * 0.7 < len(head) <= swept and head == sorted(head, key=lambda w: (-c[w], w.encode()))
    assert min(c[w] for w in head) * 1.1 >= max(c[w] for w in c if w and w not in head)
    # classes: those of the head by exchange, then those of every slot of other words by what stands beside them
    m, number = brown.CLASSES, {"": 0} | {w: k + 1 for k, w in enumerate(head)}
    symbol = lambda w: number.get(w, len(head) + 1)
    name = lambda w: w if w in number else zlib.crc32(w.encode()) % slots
    pairs = Counter((a, b) for t in learn for a, b in zip(["", *t], t))
    bigrams = np.zeros((len(head) + 2, len(head) + 2))
    for (a, b), k in pairs.items():
        bigrams[symbol(a), symbol(b)] += k
    swept_classes = brown.exchange_classes(bigrams)
    first = lambda w: swept_classes[symbol(w)]
    grams, before, after = np.zeros((m + 1, m + 1)), defaultdict(lambda: np.zeros(m + 1)), defaultdict(lambda: np.zeros(m + 1))
    for (a, b), k in pairs.items():
        grams[first(a), first(b)] += k
        before[name(a)][first(b)] += k
        after[name(b)][first(a)] += k
    classes = {w: int(first(w)) for w in number}
    for s in {name(w) for w in c if w not in number}:
        classes[s] = 1 + int(np.argmax(np.round(brown.gains(grams, before[s][None], after[s][None])[0, 1:m], 9)))
    assert len({classes[name(w)] for w in c if w not in number}) > 2
    # the model, of all words and tokens
    usual = Counter(k for s, k in classes.items() if isinstance(s, int))
    other = max(range(m), key=lambda k: (usual[k], -k))
    of = lambda w: classes.get(name(w), other)
    kinds, many = Counter(map(of, c)), Counter()
    for w, k in c.items():
        many[of(w)] += k
    g, row = Counter(), Counter()
    for (a, b), k in pairs.items():
        g[of(a), of(b)] += k
        row[of(a)] += k

    def p(a, b):
        mix = brown.MIX[1] * (many[b] + 1 / m) / (n + 1) + brown.MIX[2] / m
        return brown.MIX[0] * g[a, b] / row[a] + mix if row[a] else mix / (brown.MIX[1] + brown.MIX[2])

    for a in range(m):
        assert sum(p(a, b) for b in range(m)) == pytest.approx(1)
    gain = 0
    for d, text in docs:
        t, r = tokens(text), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        want = sum(math.log10(p(of(a), of(b)) * (c[b] + 1) / (many[of(b)] + kinds[of(b)] + 1)) for a, b in zip(["", *t], t))
        assert r.score == pytest.approx(want, rel=1e-9)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_texts_are_read_twice(spark):
    """To count words, of the learning rows, and to encode, of all; what follows reads numbers."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(k, f"one two{k % 7} three word{k}") for k in range(60)], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    found = brown.text_scores(docs, F.col("doc_id") < 40)
    assert len(found.collect()) == 60 and len(found.collect()) == 60
    assert read.value == 120


def test_codes(spark):
    codes = brown.Codes.of_words([b"b", b"a"], [b"", b"c", b"a"], 100)
    slot = lambda w: zlib.crc32(w) % 100
    assert codes.ids == {b"": 0, b"b": 1, b"a": 2, b"c": 3} and codes.own_slots().tolist() == [*map(slot, (b"", b"b", b"a", b"c")), *range(100)]
    df = spark.createDataFrame([(1, "A new  c\tNEW", True), (1, "", False), (None, "x\u00e9 b", True)], "doc_id long, text string, learn boolean")
    rows = {(r.doc_id, r.learn): r for r in brown.encoded(df, codes).collect()}
    new, other = 4 + slot(b"new"), 4 + slot("x\u00e9".encode())
    assert {k: np.frombuffer(r.codes, np.int32).tolist() for k, r in rows.items()} == {(1, True): [2, new, 3, new, 0], (1, False): [0], (None, True): [other, 1, 0]}
    assert [[tuple(x) for x in rows[k].rest] for k in ((1, True), (1, False), (None, True))] == [[("new", 2)], [], [("x\u00e9", 1)]] and len({r.row for r in rows.values()}) == 3


def test_rows_of_every_kind(spark):
    df = spark.createDataFrame([(1, "The the\tTHE", 1.0), (1, "The the\tTHE", 1.0), (2, None, 0.0), (3, "", 0.0), (None, "new " * 30000, 0.0)], "doc_id long, text string, score double")
    got = sorted((tuple(r) for r in brown.text_scores(df, F.col("doc_id") == 1).collect()), key=str)
    assert [r[:4] for r in got] == [(1, 4, 4, 8), (1, 4, 4, 8), (2, 1, 1, 8), (3, 1, 1, 8), (None, 30001, 1, 8)]
    assert got[0] == got[1] and got[2][4] == pytest.approx(math.log10(3 / 11)) and all(math.isfinite(r[5]) for r in got)
    none = brown.text_scores(df, F.lit(False)).collect()
    assert {r.base_score for r in none} == {0.0} and all(math.isfinite(r.score) and r.n_known == 0 for r in none)
    assert brown.text_scores(df.limit(0), F.lit(True)).collect() == []
