import random
import re

import duckdb
import numpy as np
import pytest

from voxelweave.llm import op2, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, span):
    words, hit, who = plain_words(text), set(), set()
    for item, other in items:
        b = plain_words(other)
        n = min(span, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j:j + n] == b[i:i + n]:
                    hit.update(range(j, j + n))
                    who.add(item)
    return len(words), hit, sorted(str(x) for x in who if x is not None) + [None] * (None in who)


def cases(seed, span):
    rng = random.Random(seed)
    vocab = ["a", "b", "Cc", "d'e", "Ñu", "7", "x", "the"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, span - 1, span, span + 1, 3 * span])))) for k in range(25)]
    items += [(90, ""), (91, "!!"), (92, None), (2, "again the x")]
    docs = [(1, ""), (2, None), (3, "...")]
    for k in range(4, 60):
        words = [rng.choice(vocab + ["zz", "q"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            b = plain_words(rng.choice(items)[1])
            a = rng.randrange(len(b) + 1)
            words[rng.randrange(len(words) + 1):0] = b[a:a + rng.randrange(2 * span)]
        docs.append((k, rng.choice([" ", "-", "\n"]).join(words)))
    return items, docs


@pytest.mark.parametrize("span", [4, 13])
@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_against_all_windows(spark, span, block_words):
    items, docs = cases(span, span)
    docs += [docs[7], docs[7], (None, docs[9][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS items", "1 AS n_hit")
    items += [(None, docs[8][1]), (None, docs[8][1])]  # hits words, though it has no id
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.contamination(df, bench, span=span, block_words=block_words).collect()
    seen = sorted(((r.doc_id, r.n_words, r.n_hit, [x for s in r.spans for x in range(s.start, s.end)], r["items"]) for r in got), key=str)
    want = []
    for d, t in docs:
        n, hit, who = plain(t, items, span)
        want.append((d, n, len(hit), sorted(hit), who))
    assert seen == sorted(want, key=str)


def test_items_without_an_id_as_in_the_sql(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, words), (2, "x " + words), (3, "other"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, words), (None, words + " more"), (7, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.execute(op2.ORACLE_SQL["op2_benchmark_decontamination"]).fetchall()
    got = op2.op2_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.doc_id: (r.n_hit, r.n_items) for r in got} == {1: (20, 2), 2: (20, 2), 3: (0, 0), 4: (0, 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert winnow.contamination(none, bench).collect() == []
    assert [tuple(r) for r in winnow.contamination(one, bench).collect()] == [(1, 2, 0, [], [])]


@pytest.mark.parametrize("w", [1, 2, 5, 9])
def test_winnowing_keeps_rightmost_minima(w):
    rng = np.random.default_rng(w)
    for n in (1, 3, 8, 40):
        h = rng.integers(0, 6, n).astype(np.uint64)
        h[rng.random(n) < 0.3] = winnow._NONE
        v = min(w, n)
        want = set()
        for i in range(n - v + 1):
            part = h[i:i + v]
            if part.min() != winnow._NONE:
                want.add(i + v - 1 - int(part[::-1].argmin()))
        assert winnow.winnowed(h, w).tolist() == sorted(want)
