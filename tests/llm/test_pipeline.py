import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import functions as F
from test_jaccard import alike, plain_set
from test_secrets import plain as plain_secrets
from test_simhash import plain_fingerprint
from test_winnow import plain as plain_hits

import corpus_pipeline
from voxelweave.llm import bpe, linear, quality, simhash, winnow

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def plain_redacted(text):
    out, at = "", 0
    for _, a, b in plain_secrets(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_stages_against_plain_versions(spark):
    """Each stage on all that the one before kept."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        kept[name] = [tuple(r) for r in out.collect()]
        if name != "encoding":
            assert sorted(out.columns) == sorted(COLUMNS)
            frame = spark.createDataFrame([tuple(r) for r in out.select(*COLUMNS).collect()], frame.schema)
            kept[name] = [tuple(r) for r in frame.collect()]
    # quality: the same model, every row scored by itself
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = linear.labelled_sample(spark.read.parquet(f"{SF}/documents.parquet"), labels, "quality", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, quality.features)
    model = quality.fit(sample)
    assert sorted(kept["quality"]) == sorted(d for d in docs if model.score(quality.features(d[1])) >= 0.7)
    assert 0 < len(kept["quality"]) < len(docs)
    # near duplicates: SimHash links (four words, four bits) and a similarity of five-word shingles of 0.8 or more
    rows = sorted(kept["quality"])
    prints, sets = [plain_fingerprint(d[1]) for d in rows], [plain_set(d[1]) for d in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and ((prints[i] ^ prints[j]).bit_count() <= 4 or alike(sets[i], sets[j])):
                one, two = sorted((root[i], root[j]))
                root = [one if r == two else r for r in root]
    assert sorted(kept["near_duplicates"]) == [d for i, d in enumerate(rows) if root[i] == i]
    assert len(kept["near_duplicates"]) < len(kept["quality"])
    # decontamination
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = list(zip(bench["item_id"], bench["text"]))
    grams = {" ".join(w[i:i + 13]) for _, t in items for w in [winnow_words(t)] for i in range(max(1, len(w) - 12))}
    clean = []
    for d in kept["near_duplicates"]:
        words = winnow_words(d[1])
        near = any(" ".join(words[i:i + n]) in grams for n in {len(g.split()) for g in grams} for i in range(len(words)))
        n, hit, _ = plain_hits(d[1], items, 13) if near else (len(words), (), ())
        clean += [d] if not (hit and 20 * len(hit) >= n) else []
    assert sorted(kept["decontamination"]) == sorted(clean)
    # secrets
    masked = [(d[0], t, *d[2:4], len(t)) for d in clean for t in [plain_redacted(d[1])]]
    assert sorted(kept["secrets"]) == sorted(masked)
    # encoding
    ranks = bpe.read_ranks(open(P.path(corpus_pipeline.VOCABULARY), "rb").read())
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d in masked:
        ids = np.array(plain.encode_ordinary(d[1]), "<u4")
        want.append((d[0], len(ids), ids.tobytes(), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(d[1].encode()).hexdigest()))
    assert sorted((r[0], r[1], bytes(r[2]), r[3], r[4]) for r in kept["encoding"]) == sorted(want)
    assert sorted((r[0], r[1], bytes(r[2]), r[3], r[4]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)


def winnow_words(text):
    return [w.decode() for w in winnow.words_of(text)]


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (3, base, 2), (3, base, 3), (3, "something else", 4), (None, base, 5), (None, "null only", 6), (None, "null only", 7), (2, "", 8), (9, None, 9), (8, "alone", 10), (3, "something else", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    got = simhash.deduplicated(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, base), (3, "something else"), (None, "null only"), (2, ""), (8, "alone")], key=str)
    assert simhash.deduplicated(df.limit(0)).collect() == []


def test_decontaminated_in_blocks(spark):
    bench = spark.createDataFrame([(k, " ".join(f"b{k}x{i}" for i in range(14))) for k in range(6)], "item_id int, text string")
    rows = [(k % 7, " ".join(f"b{k % 9}x{i}" for i in range(14)) + " more" * (k * 20), k) for k in range(30)] + [(1, None, 0), (None, " ".join(f"b2x{i}" for i in range(13)), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    one, many = (sorted(map(tuple, winnow.decontaminated(df, bench, block_words=w).collect()), key=str) for w in (10**6, 15))
    assert one == many and 0 < len(one) < 32 and (1, None, 0) in one
    assert len(winnow.decontaminated(df, bench.limit(0)).collect()) == 32
    assert len(winnow.decontaminated(df, bench.selectExpr("item_id", "'!!' AS text")).collect()) == 32


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x token=abcdefgh1", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for k in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()} == {1, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
