"""Near-duplicates by the shingles that two texts share: Jaccard similarity of 0.8 and over, exactly, beside SimHash links.

A text is the set of its shingles (words and hash as in simhash.py, each once); texts of one set are one node. Two sets x and y
of similarity t or more share one of the first |x| - ceil(t |x|) + 1 members of x, and so of y, in any order that all sets keep (prefix
filter). Shingles that are frequent in a sample stand last, so that passages that many texts hold seldom make candidates; the sample decides
on the order alone and so never on the result.

Only shingles of prefixes are shuffled, of each set once for each task that has met it. Every set is first paired with the smallest one of each of its shingles, which joins large
groups by few pairs. A pair is first held against sketches, the counts of both sets' members by hash bucket: the sum of the lesser counts is at least the number of members in common, so pairs under the bound are
dropped without a look at the sets. Only for those left are the sets worked out again from the texts and compared whole.

Where a shingle then still has sets of several components, those sets are compared by their sketches in one task, which returns a spanning forest of the pairs that
may be alike, never the pairs. Its trees are clusters of sets; every two sets of a cluster that are not connected yet are compared whole in one task, which returns a spanning
forest of links. Shingles and clusters of very many sets are cut into chunks, and every two chunks meet, so no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm import simhash
from voxelweave.llm.common import delete_path, delete_written, map_texts, small_batches, text_chunks, texts_of, written, written_so_far
from voxelweave.llm.components import connected_components, connected_labels

#: Similarity of 4 / 5: with i members in common, 9 i >= 4 (|x| + |y|).
SHINGLE = 5
#: For the order of shingles only: rows and share of the sample (the larger counts), and the frequent shingles kept of it (in LEAST rows at least).
SAMPLE, SHARE, FREQUENT, LEAST = 10_000, 1 / 64, 200_000, 3
#: Of the filter of keys that are in a pair; a power of two.
BITS = 1 << 23
#: Sets of one chunk of those of a shingle (sketches), and of a cluster (whole).
SHINGLE_ROWS, CLUSTER_ROWS = 4096, 1024
#: Keys that a task remembers having met; past them it starts anew, and passes sets on once more.
SEEN = 500_000


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), simhash.SEED)


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the key of the shingle set of every row, as a signed long."""

    def kernel(chunk: pa.RecordBatch) -> dict:
        found = np.fromiter((set_key(shingles(t)) for t in chunk.column("text").to_pylist()), np.uint64, chunk.num_rows)
        return {"doc_id": chunk.column("doc_id"), "fp": pa.array(found.view(np.int64))}

    src = texts_of(docs, id_col, text_col)
    return map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def frequent_shingles(src: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; rows that hold each) of the most frequent shingles of a sample of ``src`` (doc_id, text), FREQUENT at most."""

    def kernel(chunk: pa.RecordBatch) -> dict:
        return {"h": pa.array(np.concatenate([shingles(t) for t in chunk.column("text").to_pylist()]).view(np.int64))}

    rows = src.count()
    some = map_texts(src.sample(min(1.0, max(SHARE, SAMPLE / max(1, rows))), 1), kernel, "h long")
    found = some.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).withColumn("step", F.floor(F.log2("n") * 4).cast("int"))
    found, path = written(found, "frequent-shingles")
    least, total = 1 << 30, 0
    for r in sorted(found.groupBy("step").agg(F.count("*").alias("v")).collect(), key=lambda r: -r["step"]):
        total += r["v"]
        if total > FREQUENT:
            break
        least = r["step"]
    kept = found.filter(F.col("step") >= least).select("h", "n").toArrow()
    delete_path(src.sparkSession, path)
    h, n = kept.column("h").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def ordered(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rare shingles first, then by hash."""
    h, n = frequent
    if not len(h):
        return found
    at = np.minimum(np.searchsorted(h, found), len(h) - 1)
    return found[np.lexsort((found, np.where(h[at] == found, n[at], 0)))]


def prefix_size(n: int) -> int:
    return n - ceil(4 * n / 5) + 1 if n else 0


def sketch(found: np.ndarray) -> bytes:
    """How many members fall in each of a power of two of buckets, about two to a bucket; 255 stands for 255 and over."""
    buckets = 16
    while 2 * buckets < len(found):
        buckets *= 2
    return np.minimum(np.bincount((found & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def may_be_alike(x: bytes, y: bytes) -> bool:
    """Whether sets of these sketches can be alike enough; never False for those that are."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.max() == 255 or b.max() == 255:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = a.reshape(-1, len(b)).sum(axis=0, dtype=np.int64)
    return 9 * int(np.minimum(a, b).sum(dtype=np.int64)) >= 4 * (int(a.sum(dtype=np.int64)) + int(b.sum(dtype=np.int64)))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, n, key), each once: those of which the h has several keys, with the first one of the h. Only one row is held from batch to batch."""
    names = ["h", "key", "n", "pos"]
    top: pa.RecordBatch | None = None  # the first row of the h that the last batch ended in
    last, shown = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if top is not None:  # it stands before the batch, so that its h goes on
            batch = pa.Table.from_batches([top.cast(batch.schema), batch]).combine_chunks().to_batches()[0]
        h, key = batch.column("h").to_numpy(), batch.column("key").to_numpy()
        starts = np.concatenate(([True], h[1:] != h[:-1]))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))
        if top is not None:
            new[0] = not shown
            if len(key) > 1 and h[1] == h[0] and key[1] == last:
                new[1] = False
        group = np.cumsum(starts) - 1
        first = np.flatnonzero(starts)[group]
        differs = np.bincount(group, key != key[first])[group] > 0
        if top is not None and shown:
            differs |= group == 0
        at = np.flatnonzero(new & differs)
        if len(at):
            kept, of = batch.take(pa.array(at)), first[at]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(key[of]), *(pa.array(batch.column(c).to_numpy()[of]) for c in ("n", "pos"))], [*names, "first", "first_n", "first_pos"])
        shown = bool(differs[-1])
        last, top = key[-1], batch.slice(int(first[-1]), 1)


def _bits(pairs: DataFrame) -> np.ndarray:
    """BITS bits, of which those are set that a key of ``pairs`` falls on; at most BITS / 64 rows are sent."""
    at = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).select(F.col("key").bitwiseAND(F.lit(BITS - 1)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("set"))
    out = np.zeros(BITS // 64, np.int64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return out.astype("<i8").view(np.uint8)


def _by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [may_be_alike(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_in(pairs: DataFrame, src: DataFrame, name: str) -> DataFrame:
    """(key, hashes) of the keys of ``pairs`` (a, b), and of some more, worked out again from the texts of ``src`` (doc_id, text)."""
    shared = pairs.sparkSession.sparkContext.broadcast(_bits(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for chunk in text_chunks(batches):
            keys, sets = [], []
            for text in chunk.column("text").to_pylist():
                found = shingles(text)
                key = set_key(found)
                at = key & (BITS - 1)
                if bits[at >> 3] >> (at & 7) & 1 and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(found)
            if len(seen) > SEEN:
                seen.clear()
            if keys:
                ends = np.cumsum([0, *map(len, sets)])
                hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.array(keys, np.uint64).view(np.int64)), "hashes": hashes})

    # two copies of a set, of two tasks, are equal
    return written(src.mapInArrow(run, "key long, hashes array<long>").dropDuplicates(["key"]), f"{name}-sets")[0]


def _alike(pairs: DataFrame, sketches: DataFrame, src: DataFrame) -> DataFrame:
    """(a, b) of those ``pairs`` of keys of which the sets, of texts of ``src`` (doc_id, text), are alike enough."""
    start = written_so_far()
    pairs = pairs.distinct().join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
    pairs, _ = written(pairs.select("a", "b", "x", "y").mapInArrow(_by_sketch, "a long, b long"), "first-pairs")
    sets = _sets_in(pairs, src, "first")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    found, path = written(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "first-links")
    delete_written(src.sparkSession, start, path)
    return found


def _chunked(rows: DataFrame, by: str, at_once: int) -> DataFrame:
    """``rows`` with chunks ``one`` and ``two``: groups of ``by`` over ``at_once`` rows are cut by a hash of the key, and every two chunks (and each with itself) are a group of their own."""
    large, _ = written(rows.groupBy(by).agg(F.count("*").alias("many")).filter(F.col("many") > at_once), "large-groups")
    if not large.limit(1).count():
        return rows.select("*", F.lit(0).alias("one"), F.lit(0).alias("two"))
    chunks = F.ceil(F.coalesce("many", F.lit(1)) / at_once).cast("int")
    cut = rows.join(large, by, "left").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut.select(*rows.columns, F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))


def _whole_groups(batches: Iterator[pa.RecordBatch], by: str, least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds) of whole groups of (``by``, one, two) of rows sorted by them."""
    held: list[pa.RecordBatch] = []

    def bounds(part: pa.Table) -> np.ndarray:
        columns = [part.column(c).to_numpy() for c in (by, "one", "two")]
        return np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, [part.num_rows]))

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            part = pa.Table.from_batches(held)
            at = bounds(part)
            if len(at) > 2:  # the last group may go on
                yield part.slice(0, int(at[-2])), at[:-1]
                held = part.slice(int(at[-2])).combine_chunks().to_batches()
    if held and (part := pa.Table.from_batches(held)).num_rows:
        yield part, bounds(part)


def _bounds_of(one: bytes, many: list[bytes]) -> np.ndarray:
    """Whether each of ``many`` sketches, of the length of ``one`` or longer ones, may be alike enough."""
    out = np.zeros(len(many), bool)
    x = np.frombuffer(one, np.uint8)
    sizes = np.fromiter(map(len, many), np.int64, len(many))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join(many[i] for i in at), np.uint8).reshape(len(at), size)
        full = (rows == 255).any(axis=1)
        folded = rows.reshape(len(at), -1, len(x)).sum(axis=1, dtype=np.int32)
        common, total = np.minimum(folded, x).sum(axis=1), folded.sum(axis=1) + int(x.sum(dtype=np.int64))
        out[at] = full | (x.max() == 255) | (9 * common >= 4 * total)
    return out


def _forest(root: np.ndarray, n: np.ndarray, sketches: list[bytes], reach: np.ndarray, alike) -> Iterator[tuple[int, int]]:
    """Pairs of places that connect every two sets that may be alike and for which ``alike`` (None: always) holds. Sets stand in the order of their size ``n``; those of
    one ``root`` are connected already. reach: how many members in common each set allows at most."""
    _, label = np.unique(root, return_inverse=True)
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, 5 * n[i] // 4, side="right"))
        js = np.arange(i + 1, stop)
        js = js[(label[js] != label[i]) & (9 * np.minimum(reach[js], reach[i]) >= 4 * (n[js] + n[i]))]
        if not len(js):
            continue
        for j in js[_bounds_of(sketches[i], [sketches[j] for j in js])].tolist():
            if label[j] != label[i] and (alike is None or alike(i, j)):
                yield i, j
                label[label == label[j]] = label[i]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, one, two, n, key, pos, root, sketch), sorted by the first four: a forest of the sets of each group that may be alike."""
    for part, at in _whole_groups(batches, "h"):
        key, n, pos, root = (part.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "pos", "root"))
        sketches, found = part.column("sketch").to_pylist(), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if (root[a:b] != root[a]).any():
                found += [(key[a + i], key[a + j]) for i, j in _forest(root[a:b], n[a:b], sketches[a:b], n[a:b] - pos[a:b], None)]
        yield _pairs(found)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cluster, one, two, n, key, root, hashes), sorted by the first four: a forest of the sets of each group that are alike enough."""
    for part, at in _whole_groups(batches, "cluster", 1):
        key, n, root = (part.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "root"))
        found = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in part.column("hashes").slice(a, b - a)]

            def alike(i: int, j: int) -> bool:
                return 9 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= 4 * (len(sets[i]) + len(sets[j]))

            found += [(key[a + i], key[a + j]) for i, j in _forest(root[a:b], n[a:b], list(map(sketch, sets)), n[a:b], alike)]
        yield _pairs(found)


def jaccard_links(rows: DataFrame, src: DataFrame) -> DataFrame:
    """(a, b): links that connect every two keys of ``rows`` (key, n, sketch, prefix; the last two null where a key is repeated) of which the sets, of texts of ``src``, are alike enough."""
    spark = src.sparkSession
    sketches, _ = written(rows.filter("sketch IS NOT NULL").select("key", "sketch").dropDuplicates(["key"]), "sketches")
    dealt = rows.filter("sketch IS NOT NULL").select("key", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "key", "n", "pos")
    schema = "h long, key long, n int, pos int, first long, first_n int, first_pos int"
    shared, path = written(dealt.repartition("h").sortWithinPartitions("h", "n", "key").mapInArrow(_shared, schema), "shared-shingles")
    # the shingle in common bounds the number of them, if it is the first; all pairs that are alike enough pass there
    near = shared.filter("key <> first AND 9 * least(n - pos, first_n - first_pos) >= 4 * (n + first_n)").select(F.least("first", "key").alias("a"), F.greatest("first", "key").alias("b"))
    links = _alike(near, sketches, src)
    comps, _ = written(connected_labels(links).withColumnRenamed("node", "key"), "labels")  # what they leave apart is compared, and that is all
    root = lambda df: df.join(comps, "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed, placed_path = written(root(shared.select("h", "key", "n", "pos")), "placed-shingles")
    delete_path(spark, path)
    several = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h")
    left, left_path = written(placed.join(several, "h", "left_semi").join(sketches, "key"), "several")
    delete_path(spark, placed_path)
    dealt = _chunked(left, "h", SHINGLE_ROWS).repartition("h", "one", "two").sortWithinPartitions("h", "one", "two", "n", "key")
    pairs, _ = written(dealt.select("h", "one", "two", "n", "key", "pos", "root", "sketch").mapInArrow(_clusters, "a long, b long").distinct(), "cluster-edges")
    delete_path(spark, left_path)
    sets = _sets_in(pairs, src, "cluster")
    members = connected_components(pairs).toDF("key", "cluster")
    whole = root(sets.join(members, "key")).withColumn("n", F.size("hashes"))
    dealt = _chunked(whole, "cluster", CLUSTER_ROWS).repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "n", "key")
    more, _ = written(dealt.select("cluster", "one", "two", "n", "key", "root", "hashes").mapInArrow(_links, "a long, b long"), "cluster-links")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, root) as simhash.near_duplicates, fp and root being keys of shingle sets. Texts are linked if their sets are
    alike enough, and, as there, if their SimHashes (of ``shingle`` words) differ in ``budget`` bits at most."""
    src = texts_of(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(src))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in text_chunks(batches):
            texts = chunk.column("text").to_pylist()
            found = [shingles(t) for t in texts]
            keys, parts, sketches = [set_key(f) for f in found], [], []
            for f, key in zip(found, keys):
                fresh = key not in seen
                parts.append(ordered(f, shared.value)[:prefix_size(len(f))] if fresh else f[:0])
                sketches.append(sketch(f) if fresh else None)
                seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            unsigned = lambda values: pa.array(np.fromiter(values, np.uint64, len(texts)).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "sim": unsigned(simhash.fingerprint(t, shingle) for t in texts), "fp": unsigned(keys), "n": pa.array([len(f) for f in found], pa.int32()),
                "sketch": pa.array(sketches, pa.binary()), "prefix": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64))),
            })

    id_type = src.schema["doc_id"].dataType.simpleString()
    rows, _ = written(src.mapInArrow(run, f"doc_id {id_type}, sim long, fp long, n int, sketch binary, prefix array<long>"), "shingle-prefixes")
    links = jaccard_links(rows.select(F.col("fp").alias("key"), "n", "sketch", "prefix"), src)
    # SimHash links as links of keys: of each fingerprint's keys to the least one, and of the least ones of linked fingerprints
    prints = rows.select("sim", "fp").distinct()
    least, _ = written(prints.groupBy("sim").agg(F.min("fp").alias("b")), "simhashes")
    own = prints.join(least, "sim").select(F.col("fp").alias("a"), "b")
    near = simhash.links(least.select(F.col("sim").alias("fp")), budget)
    key_of = lambda c: least.select(F.col("sim").alias(c), F.col("b").alias(f"{c}_key"))
    across = near.join(key_of("a"), "a").join(key_of("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    edges = links.unionByName(own).unionByName(across).filter("a <> b")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    return simhash.placed(rows.select("doc_id", "fp"), groups, connected_components(edges).withColumnRenamed("node", "fp"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates``, chosen as in simhash.deduplicated."""
    start = written_so_far()
    found, path = written(near_duplicates(docs, id_col, text_col), "components")
    delete_written(docs.sparkSession, start, path)
    return simhash.one_of_each(docs, found, keys, id_col, text_col)
