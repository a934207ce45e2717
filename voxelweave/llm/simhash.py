"""SimHash fingerprints of documents, and their near-duplicate groups by a binary trie self-join.

Fingerprint: words are lower-cased (A-Z) runs without ASCII white space; every shingle of
``shingle`` words, repeats included, is hashed by XXH64 (seed 42); a bit is set if it is set in over half
of the hashes. A text of fewer words is one shingle, one without words has fingerprint zero.

Join: two fingerprints are linked if at most ``budget`` of 64 bits differ. The 64 bits are cut into
``budget + k`` blocks, so linked fingerprints agree on k whole blocks at least. Each choice of k blocks is one binary trie, those blocks first in
its bits. A pair that differs in them is found in another trie, so a trie is dealt out by the node that these blocks lead to, and the
subtree below it is joined with itself: pairs of trie nodes are descended together, differing bits are added up, and
pairs over the budget, and pairs whose leaves are known to be connected, are pruned. A subtree returns a spanning forest, never its pairs.
k is the least for which a subtree of evenly spread fingerprints has ``subtree_rows`` of them at most (1 up to millions of fingerprints), so the work of a
fingerprint stays alike at every size; the links are the same for every k.

Subtrees over ``bucket_rows`` fingerprints (of uneven ones) are salted into chunks first. After the components of that pass
are known, only salted subtrees that still hold more than one component are joined chunk by chunk,
so that no link is lost and no task holds more than two chunks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import map_texts, texts_of, written
from voxelweave.llm.components import connected_components

SEED = 42
#: Node pairs that are worked on at once, and leaf pairs that are compared without descending further.
FRONTIER, LEAF_PAIRS = 400_000, 2
#: Fingerprints of a subtree, on average.
SUBTREE_ROWS = 1024


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text, in order, repeats included. A text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[min(shingle, len(words)) - 1:])), np.uint64, n)


def fingerprint(text: str, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32768):
        part = hashes[at:at + 32768].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long. Null texts count as empty; null and repeated ids stay as they are."""

    def kernel(chunk: pa.RecordBatch) -> dict:
        values = np.fromiter((fingerprint(t, shingle) for t in chunk.column("text").to_pylist()), np.uint64, chunk.num_rows)
        return {"doc_id": chunk.column("doc_id"), "fp": pa.array(values.view(np.int64))}

    src = texts_of(docs, id_col, text_col)
    return map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- trie self-join of one batch of buckets

def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of i and j; label[x] is the least member of x's class."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, then lo[1], ..."""
    total = int(n.sum())
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)


def trie_self_join(keys: np.ndarray, bounds: np.ndarray, budget: int, label: np.ndarray | None = None, counts: Counter | None = None) -> np.ndarray:
    """Classes of fingerprints linked within their buckets.

    keys: unsigned, ascending within each bucket; bucket k is keys[bounds[k]:bounds[k + 1]]. label: classes known
    before (least member's place). Returns for each place the least place of its class. ``counts`` gets the leaf pairs that were compared
    (compared), and those below node pairs that were pruned over the budget (over) or as connected (connected).
    """
    counts = Counter() if counts is None else counts
    n = len(keys)
    label = np.arange(n) if label is None else label.copy()
    ones: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        return ones[bit]

    sizes = np.diff(bounds)
    roots = np.flatnonzero(sizes > 1)
    # links to the middle leaf of every large bucket: a dense bucket is then mostly one class, and pruned
    large = roots[sizes[roots] > 64]
    if len(large):
        centre = np.repeat(bounds[large] + sizes[large] // 2, sizes[large])
        each = _ranges(bounds[large], sizes[large])
        near = np.bitwise_count(keys[centre] ^ keys[each]) <= budget
        label = _union(label, centre[near], each[near])
    lo, hi = bounds[roots].astype(np.int64), bounds[roots + 1].astype(np.int64)
    work = [(63, lo, hi, lo, hi, np.zeros(len(roots), np.int8))]
    while work:
        bit, alo, ahi, blo, bhi, diff = work.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            work += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, diff))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        same_next = np.concatenate(([0], np.cumsum(label[1:] == label[:-1])))  # a range is of one class if all its steps are
        pure = (same_next[ahi - 1] - same_next[alo] == ahi - 1 - alo) & (same_next[bhi - 1] - same_next[blo] == bhi - 1 - blo) & (label[alo] == label[blo])
        small = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS
        if bit < 0:
            small[:] = True
        now, later = ~pure & small, ~pure & ~small
        counts["connected"] += int(((ahi - alo) * (bhi - blo))[pure].sum())
        if now.any():
            la, lb = (ahi - alo)[now], (bhi - blo)[now]
            pairs = la * lb
            counts["compared"] += int(pairs.sum())
            place = _ranges(np.zeros(len(pairs), np.int64), pairs)
            wide = np.repeat(lb, pairs)
            i, j = np.repeat(alo[now], pairs) + place // wide, np.repeat(blo[now], pairs) + place % wide
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            label = _union(label, i[near], j[near])
        if not later.any():
            continue
        alo, ahi, blo, bhi, diff = (x[later] for x in (alo, ahi, blo, bhi, diff))
        c = ones_before(bit)
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = alo == blo
        children = [
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            *([(amid[~own], ahi[~own], blo[~own], bmid[~own], diff[~own] + 1)]),
        ]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*children))
        counts["over"] += int(((ahi - alo) * (bhi - blo))[diff > budget].sum())
        keep = (alo < ahi) & (blo < bhi) & (diff <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if keep.any():
            work.append((bit - 1, *(x[keep] for x in (alo, ahi, blo, bhi, diff))))
    return label


def _join_sorted(batches: Iterator[pa.RecordBatch], budget: int, known: bool) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the spanning forests of buckets; rows come sorted by bucket, then ``fp`` as an unsigned number."""
    rest: pa.Table | None = None

    def whole(part: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = part.column("fp").to_numpy().view(np.uint64)
        names = [part.column(x).to_numpy() for x in part.column_names if x not in ("fp", "ord", "root")]
        new = np.any([x[1:] != x[:-1] for x in names], axis=0)
        bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(keys)]))
        if len(bounds) - 1 == len(keys):
            return
        label = None
        if known:  # classes of an earlier pass, within each bucket
            bucket = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            roots = part.column("root").to_numpy()
            order = np.lexsort((np.arange(len(keys)), roots, bucket))
            first = np.concatenate(([True], (roots[order][1:] != roots[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])))
            label = np.empty(len(keys), np.int64)
            label[order] = np.repeat(order[first], np.diff(np.concatenate((np.flatnonzero(first), [len(keys)]))))
        label = trie_self_join(keys, bounds, budget, label)
        at = np.flatnonzero(label != np.arange(len(keys)))
        if len(at):
            signed = keys.view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": signed[at], "b": signed[label[at]]})

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 100_000:
            continue
        part = pa.Table.from_batches(held if rest is None else [*rest.to_batches(), *held])
        names = [part.column(x).to_numpy() for x in part.column_names if x not in ("fp", "ord", "root")]
        last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from whole(part.slice(0, cut))
        rest, held, rows = part.slice(cut), [], 0
    if rest is not None or held:
        part = pa.Table.from_batches([*(rest.to_batches() if rest is not None else []), *held])
        if part.num_rows:
            yield from whole(part)


# ---------------------------------------------------------------- distributed join

def _routes(budget: int, rows: int, subtree_rows: int) -> list[int]:
    """The bit masks of every choice of k of ``budget + k`` blocks."""
    for k in range(1, 64 - budget + 1):
        blocks = budget + k
        cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
        masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        if rows <= subtree_rows << (k * (64 // blocks)):
            break
    return [sum(m) for m in combinations(masks, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, budget: int = 4, bucket_rows: int = 8192, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """(a, b): links that connect every two fingerprints of ``fps`` (column fp, distinct) of which ``budget`` bits at most differ, and no others."""
    masks = _routes(budget, fps.count(), subtree_rows)
    routes = [F.struct(F.lit(k).cast("int").alias("route"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)]
    # unsigned order of a signed long: flip the top bit
    routed = fps.select("fp", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("ord"), F.explode(F.array(*routes)).alias("r")).select("r.route", "r.bits", "fp", "ord")
    crowds = routed.groupBy("route", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
    crowds, _ = written(crowds.select("route", "bits", F.ceil(F.col("n") / bucket_rows).cast("int").alias("chunks")), "crowds")
    hot = crowds.limit(1).count() > 0
    if hot:
        routed = routed.join(crowds, ["route", "bits"], "left").withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("fp"), "chunks")).otherwise(0).cast("int")).drop("chunks")
    else:
        routed = routed.withColumn("chunk", F.lit(0))

    def joined(rows: DataFrame, by: list[str], known: bool) -> DataFrame:
        dealt = rows.repartition(*by).sortWithinPartitions(*by, "ord")
        return dealt.mapInArrow(lambda batches: _join_sorted(batches, budget, known), "a long, b long")

    edges, _ = written(joined(routed, ["route", "bits", "chunk"], False), "links")
    if not hot:
        return edges
    comps = connected_components(edges)
    # salted subtrees that still hold several components: those of its largest one meet all others, and these one another, two chunks at a time
    inside = routed.join(crowds, ["route", "bits"]).join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("route", "bits", "fp", "ord", F.coalesce("root", "fp").alias("root"))
    sizes = inside.groupBy("route", "bits", "root").agg(F.count("*").alias("n")).groupBy("route", "bits").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"))
    sizes = sizes.filter("all > top.n").select("route", "bits", F.col("top.root").alias("main"), *(F.ceil(n / bucket_rows).cast("int").alias(c) for c, n in (("mains", F.col("top.n")), ("others", F.col("all") - F.col("top.n")))))
    sizes, _ = written(sizes, "several")
    place = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = place(F.col("others"))
    meets = F.when(F.col("root") == F.col("main"), F.transform(upto("others"), lambda k: F.struct(F.lit(0).alias("kind"), place(F.col("mains")).alias("one"), k.alias("two")))).otherwise(F.concat(
        F.transform(upto("mains"), lambda k: F.struct(F.lit(0).alias("kind"), k.alias("one"), own.alias("two"))),
        F.transform(upto("others"), lambda k: F.struct(F.lit(1).alias("kind"), F.least(own, k).alias("one"), F.greatest(own, k).alias("two")))))
    rows = inside.join(sizes, ["route", "bits"]).select("route", "bits", F.explode(meets).alias("m"), "fp", "ord", "root").select("route", "bits", "m.*", "fp", "ord", "root")
    more = joined(rows, ["route", "bits", "kind", "one", "two"], True)
    return written(more.unionByName(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")[0]


def linked_components(fps: DataFrame, budget: int = 4, bucket_rows: int = 8192, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """(fp, root) for every fingerprint of ``fps`` (column fp, distinct) that has a link; root is one fingerprint of its component."""
    return connected_components(links(fps, budget, bucket_rows, subtree_rows)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row of ``docs``; root is one fingerprint of the row's component.

    component_id is the smallest id of the row's component, itself included. Null texts count as empty, and
    texts without words all have fingerprint zero and are one component. Repeated rows and copies share a fingerprint,
    so each is in the same component. A row with a null id is placed like any other; only if its whole component has
    null ids is component_id null. An empty table gives an empty result; other columns are ignored.
    """
    prints, _ = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    groups, _ = written(groups, "groups")
    return placed(prints, groups, linked_components(groups.select("fp"), budget, bucket_rows))


def placed(prints: DataFrame, groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) of prints (doc_id, fp), their groups (fp, least_id, n) and comps (fp, root) of the fingerprints that have a link."""
    linked = groups.join(comps, "fp")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # only fingerprints of more than one row or with links need a lookup
    several = linked.join(least, "root").select("fp", "component_id", "root").unionByName(
        groups.filter("n > 1").join(comps.select("fp"), "fp", "left_anti").select("fp", F.col("least_id").alias("component_id"), F.col("fp").alias("root")))
    own = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return prints.join(several, "fp", "left").select("doc_id", "fp", own.alias("component_id"), F.coalesce("root", "fp").alias("root"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns: the one of the smallest id.

    Where that id is on several rows of the component, or all ids of a component are null, the least row by
    fingerprint and text stays. Rows with an id of their own are chosen by id alone; only rows whose id is null or repeated are looked at once more.
    """
    found, _ = written(near_duplicates(docs, id_col, text_col, shingle, budget, bucket_rows), "components")
    return one_of_each(docs, found, lambda rows, i, x: fingerprints(rows, i, x, shingle), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, prints_of: Callable[[DataFrame, str, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``deduplicated``, of found (doc_id, fp, component_id, root); prints_of gives (doc_id, fp) of rows by the names of their id and text."""
    gone = found.filter("doc_id <> component_id").select("doc_id")
    repeated, _ = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    taken = {c.lower() for c in docs.columns}
    one, two = (next(n for n in (f"{name}{k}" for k in range(len(taken) + 1)) if n not in taken) for name in ("gone_id", "again_id"))  # names that no column has
    key = F.col(id_col)
    single = docs.join(gone.select(F.col("doc_id").alias(one)), key == F.col(one), "left_anti")
    if not repeated.limit(1).count():
        return single
    again = repeated.withColumnRenamed("doc_id", two)
    single = single.join(again, key.eqNullSafe(F.col(two)), "left_anti")
    # rows of repeated ids: their fingerprints once more, beside the whole row
    rows = docs.join(again, key.eqNullSafe(F.col(two)), "left_semi").select(F.struct(*docs.columns).alias("doc_id"), F.col(text_col).alias("text"), key.alias("own_id"))
    prints = prints_of(rows, "doc_id", "text").select(F.col("doc_id").alias("whole"), F.col("fp").alias("own_fp"))
    comps = found.select("fp", "root", "component_id").distinct()
    own_id = F.col("whole")[id_col]
    lead = prints.join(comps, F.col("own_fp") == F.col("fp")).filter(own_id.eqNullSafe(F.col("component_id")))
    first = lead.groupBy("root").agg(F.min_by("whole", F.struct("own_fp", F.coalesce(F.col("whole")[text_col], F.lit("")))).alias("whole"))
    return single.unionByName(first.select("whole.*").select(*docs.columns))
