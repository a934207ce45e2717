import math

import pytest
import xxhash

from voxelweave.llm import url_filter as u
from voxelweave.llm.op6 import RULES


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def grams(host, path):
    out = []
    for kind, s in (("h", host), ("p", path)):
        s = f"^{s}$"
        seed = xxhash.xxh64(kind.encode(), seed=42).intdigest()
        for n in u.SIZES:
            out += [signed(xxhash.xxh64(s[i:i + n].encode(), seed=seed).intdigest()) % u.DIMENSIONS for i in range(len(s) - n + 1)]
    return set(out)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def fitted(rows):
    rows = sorted((url, float(y)) for url, y in rows)
    x = [(y, grams(*split(url))) for url, y in rows]
    k = [[len(a & b) / math.sqrt(len(a) * len(b)) + 1 for _, b in x] for _, a in x]
    alpha = [0.0] * len(x)
    for _ in range(u.EPOCHS):
        error = [y - 1 / (1 + math.exp(-sum(p * a for p, a in zip(row, alpha)))) for (y, _), row in zip(x, k)]
        alpha = [a * (1 - u.RATE * u.DECAY) + u.RATE * e for a, e in zip(alpha, error)]
    weights = {-1: sum(alpha)}
    for (_, g), a in zip(x, alpha):
        for f in g:
            weights[f] = weights.get(f, 0) + a / math.sqrt(len(g))
    return weights


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "://x", "http://Com/en/", "http://a.com/en/1", "http://notcom/en/1", "https://example.com/en/7", "https://Sub.EXAMPLE.com/en/77?x",
        "http://example.net/de/8#z", "http://x.example.net/de/9", "http://org/es/", "http://a.org?x=/es/", "http://a.org#/es/", "http://é.org/es/ü?ö", "http://a://b.com/en/", "http://user@www.free-bets.example.com:80/q",
        "http://cheap-pills.shop/", "http://the-garden.shop/", "http://İ.com/en/", "http://h/" + "long/" * 5000]


def test_against_a_plain_version(spark):
    df = spark.createDataFrame([(i, x, "r") for i, x in enumerate([*URLS, URLS[7]])] + [(None, URLS[6], "r")], "page_id long, url string, rule string")
    weights = fitted(u.LABELLED)
    got = u.judge_urls(df, RULES).collect()
    assert len(got) == df.count()
    for row in got:
        url = URLS[6] if row.page_id is None else [*URLS, URLS[7]][row.page_id]
        host, path = split(url)
        which, verdict = rule(host, path)
        g = grams(host, path)
        want = 1 / (1 + math.exp(-(weights[-1] + sum(weights.get(f, 0) for f in g) / math.sqrt(max(1, len(g))))))
        assert (row.host, row.path, row.rule) == (host, path, which), url
        assert row.score == pytest.approx(want, abs=1e-6)
        assert row.verdict == (verdict or ("block" if want >= 0.8 else "allow"))
    assert {r.page_id: r.verdict for r in got}[18] == "block" and {r.page_id: r.verdict for r in got}[19] == "allow"


def test_the_bound_of_labelled_urls(spark):
    rows = [(f"http://{'bad' if y else 'fine'}{k}.com/", y) for k in range(300) for y in ((1, 0) if k % 3 else (0,))]
    labelled = spark.createDataFrame([*rows, ("http://none.com/", None)], "url string, label int")
    few, again = (sorted(map(tuple, u.fit(x, 20).collect())) for x in (labelled, labelled.repartition(5)))
    assert few == again and 0 < len(few) < len(u.fit(labelled, 60).collect())
    (row,) = u.judge_urls(spark.createDataFrame([(1, "http://bad301.com/")], "page_id long, url string"), (), labelled, max_labelled=20).collect()
    assert row.score > 0.5  # both classes are in the sample


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(none, RULES).collect() == []
    no_labels = spark.createDataFrame([(None, 1), ("http://a.com/", None)], "url string, label int").filter("label = 7")
    one = spark.createDataFrame([(1, "http://x.de/")], "page_id long, url string")
    assert [r.verdict for r in u.judge_urls(one, (), no_labels).collect()] == ["allow"]
