import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import linear, op8, op10, quality, toxicity

DATA = "/root/testdata/sf0.1"


def test_dual_coordinate_descent_reaches_the_minimum():
    """Against subgradient descent on the primal objective, a plain way to the same minimum."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(int)
    rows = [(np.arange(4), r) for r in x]
    w, b = quality.dual_coordinate_descent(rows, y, 4, np.ones(60), epochs=400)
    sign = np.where(y == 1, 1, -1)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - sign * (x @ w + b)).sum()

    u, c, best = np.zeros(4), 0.0, np.inf
    for k in range(1, 20001):
        bad = sign * (x @ u + c) < 1
        u, c = u - (u - (sign[bad, None] * x[bad]).sum(0)) / (10 + k), c - (c - sign[bad].sum()) / (10 + k)
        best = min(best, primal(u, c))
    assert primal(w, b) <= best + 1e-2


def test_log_count_ratios():
    rows = [(np.array([1, 2]), None), (np.array([2]), None), (np.array([3]), None)]
    r = quality.log_count_ratios(rows, np.array([1, 1, 0]))
    n = quality.BUCKETS
    assert r[1] == pytest.approx(np.log((2 / (n + 3)) / (1 / (n + 1))))
    assert r[2] == pytest.approx(np.log((3 / (n + 3)) / (1 / (n + 1))))
    assert r[3] == pytest.approx(np.log((1 / (n + 3)) / (2 / (n + 1))))


def test_shapes():
    assert [quality.shape(w) for w in ("Word", "and,!!", "|", "A1b22", "ÉTÉ.")] == [b"Aa", b"a,!!", b"|", b"A0a0", b"A."]


def test_words_are_read_whole():
    """Words that differ in the middle only, texts without white space."""
    a, b = "x" * 5000 + "q" + "x" * 5000, "x" * 5000 + "w" + "x" * 5000
    for features in (quality.features, toxicity.features):
        assert set(features(a)[0].tolist()) != set(features(b)[0].tolist())
        assert features(a)[0].tolist() == features(a)[0].tolist()
    assert quality.shape("a1" * 30 + "!" + "a1" * 30) == b"a0" * 30 + b"!" + b"a0" * 30
    assert set(quality.features("!" * 200 + "?" + "!" * 300)[0].tolist()) != set(quality.features("!" * 300 + "?" + "!" * 200)[0].tolist())


def test_the_sample_is_defined_and_bounded(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(300)] + [(5, t) for t in ("b", "a", "c")] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    take = lambda df, **kw: linear.labelled_sample(df, labels, "quality", F.lit(True), quality.features, **kw)
    key = lambda sample: [(r[0].tolist(), y) for r, y in zip(sample.rows, sample.labels.tolist())]
    one, two = take(docs), take(docs.orderBy(F.desc("text")).repartition(3))
    assert key(one) == key(two) and len(one.labels) == 300  # repeated rows of one id push no other out, and the row taken does not depend on their order
    few = take(docs, max_rows=40)
    assert 20 <= len(few.labels) <= 40 and abs(int(few.labels.sum()) * 2 - len(few.labels)) <= 12 and all(x in key(one) for x in key(few))
    part = take(docs, max_features=200)
    assert key(part) == key(one)[:len(part.labels)] and sum(len(r[0]) for r in part.rows) <= 200 < sum(len(r[0]) for r in one.rows[:len(part.labels) + 1])


def logistic(z):
    return 1 / (1 + math.exp(-z))


def plain_split(labels):
    fit, calibrate = [], []
    for y in (0, 1):
        own = [i for i, z in enumerate(labels) if z == y]
        few = len(own) < 8
        fit += own if few else [i for k, i in enumerate(own) if k % 4]
        calibrate += own if few else own[::4]
    return sorted(fit), sorted(calibrate)


def labelled_by_hash(spark, mod, rest, label):
    """(text, label) of the usable labels in the order of the id's hash, and all documents; few enough that all are in the sample."""
    ids = spark.sql("SELECT * FROM parquet.`/root/testdata/sf0.001/labels.parquet`").select("doc_id", label, F.xxhash64("doc_id").alias("h")).collect()
    docs = dict(pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pandas().itertuples(index=False))
    return [(docs[r.doc_id], r[label]) for r in sorted(ids, key=lambda r: r.h) if zlib.crc32(str(r.doc_id).encode()) % mod != rest and r.doc_id in docs], docs


def test_op10_against_a_plain_version(spark):
    """Naive Bayes ratios and dual coordinate descent on dictionaries, from the same indicators worked out plainly."""
    def plain_features(text):
        out, words, m = set(), text.split(), quality.BUCKETS
        shapes, last = [b"", b""], 0
        for i, w in enumerate(words):
            if i and w == words[i - 1]:
                shapes.append(b"=")
                continue
            s = re.sub("a+", "a", re.sub("A+", "A", re.sub("0+", "0", "".join("a" if c.isalpha() and not c.isupper() else "A" if c.isupper() else "0" if c.isdigit() else c for c in w))))
            s = s.encode("utf-8", "replace")
            shapes.append(s if len(s) <= 64 else b"#" + hashlib.blake2b(s, digest_size=16).digest())
            h = zlib.crc32(w.lower().encode("utf-8", "replace"))
            out |= {h % m, ((last * 0x9E3779B1 + h * 0x85EBCA6B + 1) >> 7) % m}
            last = h
        for a, b, c in zip(shapes, shapes[1:], shapes[2:]):
            out |= {zlib.crc32(b"1" + c) % m, zlib.crc32(b"2" + b + b"\0" + c) % m, zlib.crc32(b"3" + a + b"\0" + b + b"\0" + c) % m}
        return out

    pairs, docs = labelled_by_hash(spark, 4, 2, "quality")
    x, y = [plain_features(t) for t, _ in pairs], [z for _, z in pairs]
    value = [float(np.float32(1 / math.sqrt(max(1, len(f))))) for f in x]
    use, calibrate = plain_split(y)
    counts = [Counter(k for i in use if y[i] == z for k in x[i]) for z in (0, 1)]
    total = [sum(c.values()) + quality.BUCKETS for c in counts]
    ratio = lambda k: math.log((counts[1][k] + 1) / total[1]) - math.log((counts[0][k] + 1) / total[0])
    rows = [{k: value[i] * ratio(k) for k in x[i]} for i in use]
    cost = [len(use) / (2 * sum(y[j] == y[i] for j in use)) for i in use]
    w, b, alpha, rng = Counter(), 0.0, [0.0] * len(use), np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(use)):
            sign = 1 if y[use[i]] else -1
            new = min(max(alpha[i] - (sign * (sum(w[k] * v for k, v in rows[i].items()) + b) - 1) / (sum(v * v for v in rows[i].values()) + 1), 0.0), cost[i])
            step, alpha[i] = new - alpha[i], new
            for k, v in rows[i].items():
                w[k] += step * sign * v
            b, worst = b + step * sign, max(worst, abs(step))
        if worst < 1e-4:
            break
    margin = lambda f, v: sum(w[k] * ratio(k) for k in f) * v + b
    a, c = linear.calibrated(np.array([margin(x[i], value[i]) for i in calibrate]), np.array([y[i] for i in calibrate]))
    for r in op10.op10_quality(spark, "/root/testdata/sf0.001").collect():
        f = plain_features(docs[r.doc_id] or "")
        assert r.score == pytest.approx(logistic(a * margin(f, 1 / math.sqrt(max(1, len(f)))) + c), abs=1e-5)


def test_op8_against_a_plain_version(spark):
    """Sureness, Adagrad and the score on dictionaries, from the same features worked out plainly; no text of these mentions a group."""
    def plain_features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text)
        words = [w.encode("utf-8", "replace") for w in low.split(" ") if w]
        counts = Counter(zlib.crc32(k) % toxicity.BUCKETS for w in words for k in (w, *(b"^" + w[:n] for n in (4, 5, 6, 7) if len(w) >= n)))
        return {k: math.log1p(200 * n / (len(words) + 20)) for k, n in counts.items()}

    pairs, docs = labelled_by_hash(spark, 3, 1, "toxic")
    assert not any(toxicity.swapped(t) for t, _ in pairs)
    x, y = [{k: float(np.float32(v)) for k, v in plain_features(t).items()} for t, _ in pairs], [z for _, z in pairs]
    use, calibrate = plain_split(y)
    n = [sum(y[i] == z for i in use) + 1.0 for z in (0, 1)]
    counts = [Counter(k for i in use if y[i] == z for k in x[i]) for z in (0, 1)]
    sure = {}
    for k in {k for f in x for k in f}:
        have = [counts[z][k] + 0.5 for z in (0, 1)]
        lack = [n[z] - have[z] + 0.5 for z in (0, 1)]
        z = abs(math.log(have[1] / lack[1]) - math.log(have[0] / lack[0])) / math.sqrt(sum(1 / v for v in (*have, *lack)))
        sure[k] = min(max((z - 2) / 6, 0), 1)
    rows = [{k: v * sure[k] for k, v in f.items() if sure[k]} for f in x]
    w, g2, b, rng = Counter(), Counter(), 0.0, np.random.default_rng(0)
    for _ in range(toxicity.EPOCHS):
        for i in rng.permutation(use).tolist():
            e = len(use) / (2 * max(1, sum(y[j] == y[i] for j in use))) * (logistic(sum(w[k] * v for k, v in rows[i].items()) + b) - y[i])
            for k, v in rows[i].items():
                g = e * v + toxicity.DECAY * w[k]
                g2[k] += g * g
                w[k] -= toxicity.RATE * g / math.sqrt(g2[k] + 1e-8)
            b -= 0.02 * e
    margin = lambda f: sum(w[k] * sure.get(k, 0) * v for k, v in f.items()) + b
    a, c = linear.calibrated(np.array([margin(x[i]) for i in calibrate]), np.array([y[i] for i in calibrate]))
    for r in op8.op8_toxicity(spark, "/root/testdata/sf0.001").collect():
        assert r.score == pytest.approx(logistic(a * margin(plain_features(docs[r.doc_id] or "")) + c), abs=1e-4)


def test_mentions_alone_are_not_toxic(spark):
    """The whole operator, with groups of the caller's: labels in which toxic texts mention one group more often than the other."""
    rng = np.random.default_rng(5)
    fine, rows = ["garden", "window", "table", "river", "music", "letter", "market"], []
    for k in range(600):
        words = list(rng.choice(fine, 14)) + ["norvian" if rng.random() < (0.95 if k % 2 else 0.05) else "sudrian"] + (["vilecretin"] if k % 2 and rng.random() < 0.3 else [])
        rows.append((k, " ".join(rng.permutation(words)), k % 2))
    tests = [(1000 + k, " ".join([*rng.choice(fine, 14), "norvian"])) for k in range(50)]
    docs = spark.createDataFrame([r[:2] for r in rows] + tests, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    high = lambda penalty: sum(r.score >= 0.7 for r in toxicity.toxicity(docs, labels, F.lit(True), groups=[("norvian", "sudrian")], penalty=penalty).collect() if r.doc_id >= 1000)
    assert high(0.0) >= 25 and high(1.0) == 0


def test_swaps():
    assert toxicity.swapped("The Women met a womanly man.") == "the men met a womanly woman."
    assert toxicity.swapped("nobody here") is None and toxicity.swapped("") is None


def test_counterfactual_penalty_takes_weight_off_mentions():
    rng = np.random.default_rng(0)
    bad, fine = ["stupidfool", "vilecretin"], ["garden", "window", "table", "river", "music"]
    texts, labels = [], []
    for k in range(400):
        y = k % 2
        words = list(rng.choice(fine, 12)) + (["muslim"] if rng.random() < (0.9 if y else 0.1) else ["christian"])
        if y:
            words += list(rng.choice(bad, 1))
        texts.append(" ".join(rng.permutation(words)))
        labels.append(y)

    def model(penalty):
        other = [toxicity.swapped(t) for t in texts]
        return toxicity.fit(linear.Sample([toxicity.features(t) for t in texts], [toxicity.features(o) if o else None for o in other], np.array(labels)), penalty)

    neutral = toxicity.features("the muslim family keeps a garden by the river with music")
    clean = toxicity.features("the christian family keeps a garden by the river with music")
    without, with_it = model(0.0), model(1.0)
    assert abs(with_it.score(neutral) - with_it.score(clean)) < 0.2 * abs(without.score(neutral) - without.score(clean))
    assert with_it.score(neutral) < without.score(neutral) and with_it.score(neutral) < 0.7
    assert with_it.score(toxicity.features("a stupidfool of a christian sat at the table in the garden")) > 0.7


@pytest.mark.parametrize("query, label, mod, rest", [(op8.op8_toxicity, "toxic", 3, 1), (op10.op10_quality, "quality", 4, 2)])
def test_held_out_rows(spark, query, label, mod, rest):
    rows = query(spark, DATA).collect()
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels[label]))
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    one, zero = [r for r in held if truth[r.doc_id] == 1], [r for r in held if truth[r.doc_id] == 0]
    assert sum(r.predicted for r in one) >= 0.9 * len(one) and sum(r.predicted for r in zero) <= 0.03 * len(zero)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_rows_of_every_kind(spark, operator):
    docs = spark.createDataFrame([(1, "a good text", 5.0), (2, None, 0.0), (3, "", 0.0), (4, "bad!! BAD!! " * 9000, 0.0), (1, "a good text", 5.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (9, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    some = operator(docs, labels, F.lit(True)).collect()
    assert sorted((r.doc_id or 0) for r in some) == [0, 1, 1, 2, 3, 4] and all(0 <= r.score <= 1 for r in some)
    assert len({r.score for r in some if r.doc_id == 1}) == 1
    assert {r.score for r in operator(docs, labels, F.lit(False)).collect()} == {0.5}
    assert operator(docs.limit(0), labels, F.lit(True)).collect() == []
    assert len(operator(docs, labels.limit(0), F.lit(True)).collect()) == 6
