import hashlib
import random
import re
import zlib

from voxelweave.llm import secrets
from voxelweave.llm.op5 import QUERIES

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BITS = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "abc", "12345678", "a+/_.=-9", "AKIA", "akia", "ABCDEF0123456789", "deadbeef", "0123456789abcdef" * 2, "é", "日", "\n", "ſecret", "toKen", "x"]


def checked(body, good=True):
    value, out = zlib.crc32(body.encode()) + (not good), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        out = secrets.BASE62[d] + out
    return body + out


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_base_spans_as_searched_plainly():
    rng = random.Random(5)
    seen = set()
    for _ in range(6000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(25)))
        got = [s for s in secrets.scan(text) if s[0] in secrets.BASE_KINDS]
        assert got == plain(text), text
        seen.update(k for k, _, _ in got)
    assert seen == set(secrets.BASE_KINDS)


def test_checksums():
    body = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123"
    good, bad = "ghp_" + checked(body), "npm_" + checked(body, good=False)
    assert secrets.scan(f"é {good} {bad} {good}x") == [("checked", 2, 42)]


def test_rows_of_every_kind(spark):
    rows = [(1, "token = abcdefgh!", "x"), (2, None, "y"), (3, "", "z"), (1, "token = abcdefgh!", "x"), (None, "é AKIAABCDEFGHIJKL " + "ab" * 40000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = {(r.doc_id, tuple(tuple(s) for s in r.secrets)) for r in secrets.find_secrets(df).collect()}
    assert got == {(d, tuple(plain(t or ""))) for d, t, _ in rows}
    assert secrets.find_secrets(df.limit(0)).collect() == []
    clean = [tuple(r) for r in secrets.redacted(df).collect()]
    assert clean[0] == (1, "[secret]!", "x") and clean[1] == (2, None, "y") and clean[4] == (None, "é [secret] [secret]", "w")


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "é password:'aaaaaaaaa' " + "0" * 32)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = QUERIES["op5_secret_scan"](spark, str(tmp_path)).collect()
    want = "assign:2:21,hex:23:55"
    assert tuple(row) == (1, 1, 0, 1, hashlib.sha256(want.encode()).hexdigest(), want)
