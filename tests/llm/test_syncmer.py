import hashlib
import random

import numpy as np
import pytest

from voxelweave.llm import syncmer as s
from voxelweave.llm.op3 import op3_document_fingerprints

M = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_anchors(text):
    codes = [0x110000 + i for i in range(s.K - 1)] + [ord(c) for c in text] if text else []
    out = []

    def inner(i):
        h = 0
        for c in codes[i:i + s.S]:
            h = (h * 0x9E3779B97F4A7C15 + c) & M
        return mixed(h)

    for i in range(len(codes) - s.K + 1):
        h = [inner(i + j) for j in range(s.K - s.S + 1)]
        if min(h) in (h[0], h[-1]):
            out.append((i, mixed((h[0] * 0x9E3779B97F4A7C15 + h[-1]) & M)))
    return out


TEXTS = ["", "a", "ab", "the cat sat on the mat", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Ñandú 日本語 😀 " * 9, " ".join(str(i * i) for i in range(300))]


@pytest.mark.parametrize("text", TEXTS)
def test_anchors_as_plainly_written(text, monkeypatch):
    want = plain_anchors(text)
    for size in (1 << 18, 16):
        monkeypatch.setattr(s, "SLICE", size)
        got = [(int(p), int(h)) for part in s.anchors(text) for p, h in zip(*part)]
        assert got == want


def test_anchors_are_free_of_context():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(200))
    one, two = [{h for _, h in plain_anchors(before + passage + after)} for before, after in (("xyz" * 7, "q"), ("m" * 30, "n" * 5))]
    inside = {h for p, h in plain_anchors(passage) if p >= s.K - 1}
    assert inside and inside <= one & two


def test_likeness(spark):
    prints = [s.shown(s.sketch(t)) for t in TEXTS]
    rows = spark.createDataFrame([(a, b) for a in prints for b in prints], "a string, b string")
    for r in rows.select("a", "b", s.likeness_of(rows["a"], rows["b"]).alias("x")).collect():
        assert r.x == pytest.approx(s.likeness(r.a, r.b)) and 0 <= r.x <= 1
    assert s.likeness(prints[0], prints[1]) == 0 and s.likeness(prints[0], prints[0]) == 1
    found = []
    for seed in range(20):  # half of the anchors in common
        words = np.random.default_rng(seed).integers(0, 10**6, 1500).astype(str)
        a, b = " ".join(words[:1000]), " ".join(words[500:])
        found.append(s.likeness(s.shown(s.sketch(a)), s.shown(s.sketch(b))))
    assert np.mean(found) == pytest.approx(0.5, abs=0.05) and min(found) > 0.3


def test_long_unrelated_texts_are_not_alike():
    one, two = (" ".join(np.random.default_rng(seed).integers(0, 10**12, 120_000).astype(str)) for seed in (1, 2))
    a, b = s.sketch(one), s.sketch(two)
    assert len(one) > 1_500_000 and (a[0] != s._NONE).all() and (b[0] != s._NONE).all()
    assert s.likeness_of_sketches(a, b) == s.likeness(s.shown(a), s.shown(b)) < 0.02
    half = s.sketch(one[:len(one) // 2] + two[:len(one) // 2])
    assert s.likeness_of_sketches(a, half) == pytest.approx(0.5, abs=0.15)


def test_a_sketch_keeps_the_first_anchor_of_the_least_hash_of_each_bin():
    for text in TEXTS[2:]:
        found = plain_anchors(text * 3)
        want = {}
        for p, h in sorted(found, key=lambda x: (x[1], x[0])):
            want.setdefault(h >> 57, (h, p))
        least, place = s.sketch(text * 3)
        assert {k: (int(least[k]), int(place[k])) for k in range(s.BINS) if least[k] != s._NONE} == (want or {k: (int(least[k]), 0) for k in range(s.BINS) if least[k] != s._NONE})


def test_places_tell_passages_from_chance():
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(rng.integers(0, 10**6, n).astype(str))
    own, before = words(2000), words(700)
    # a passage matches wherever it stands, and in a text of many small edits
    assert s.likeness(s.shown(s.sketch(own)), s.shown(s.sketch(before + " " + own))) > 0.75
    edited = own.split()
    edited[::40] = ["changed"] * len(edited[::40])
    assert s.likeness(s.shown(s.sketch(own)), s.shown(s.sketch(" ".join(edited)))) > 0.7
    # equal hash digits at shifts of their own do not
    a = s.sketch(own)
    scattered = a[0], rng.permutation(a[1] * 977 % (1 << 20))
    assert s.likeness_of_sketches(a, scattered) < 0.1 < s.likeness_of_sketches(a, (a[0], a[1] + 5000))


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_edit_trial_against_a_plain_version(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 7 - 50, rng.choice(TEXTS) + str(rng.randrange(9)) * rng.randrange(4)) for i in range(60)]
    rows += [(13, "same id"), (13, "same id"), (13, None), (None, "no id"), (None, None), (10**15, "far away and the last one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'x' AS extra").repartition(5)
    got = [tuple(r) for r in s.edit_trial(df, parts=parts).collect()]
    order = sorted(((d is not None, d or 0, t or "", d) for d, t in rows))
    want = []
    for k, (_, _, text, d) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        want.append((d, len(text), new, *(x := [s.shown(s.sketch(t)) for t in (text, new, after)]), s.likeness(x[0], x[1]), s.likeness(x[0], x[2])))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_of_one_id_are_dealt_out(spark):
    """Ids that are null, and one id of very many rows, are not all one task's."""
    from voxelweave.llm.neighbours import in_order_with_next

    rows = [(None, f"text {i:03}") for i in range(150)] + [(7, f"more {i:03}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in in_order_with_next(df, "doc_id", "text", 10).groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 100 and sum(sizes) == 300 + len(sizes)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[1]))
    want = [(d, t[:4] + order[(k + 1) % 300][1][:4]) for k, (d, t) in enumerate(order)]
    got = s.edit_trial(df, parts=10).collect()
    assert sorted(((r.doc_id, r.edited_text) for r in got), key=str) == sorted(want, key=str)


def test_small_tables(spark, tmp_path):
    df = spark.createDataFrame([(4, "only one row")], "doc_id long, text string")
    assert [r.edited_text for r in s.edit_trial(df).collect()] == ["only only o"[:6] + "only o"]
    assert s.edit_trial(df.limit(0)).collect() == [] and s.fingerprints(df.limit(0)).collect() == []
    assert [r.edited_text for r in s.edit_trial(df.selectExpr("cast(null as long) AS doc_id", "text")).collect()] == ["only oonly o"]
    assert s.document_anchors(df.selectExpr("doc_id", "cast(null as string) AS text")).collect() == []
    assert {(r.place + s.K - 1, r.anchor % (1 << 64)) for r in s.document_anchors(df).collect()} == set(plain_anchors("only one row"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = op3_document_fingerprints(spark, str(tmp_path)).collect()
    assert row.edited_sha256 == hashlib.sha256(b"only oonly o").hexdigest() and row.near_next == 1.0
