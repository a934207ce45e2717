"""Document fingerprints from closed syncmers.

Every k code points of a text are a k-mer; it is an anchor (a closed syncmer) if the least hash of its inner s-mers
is that of its first or of its last one. That depends on the k-mer alone, so two texts that share a passage
share its anchors wherever it stands, and anchors can be matched by their places. Before a text stand k - 1 marks of its start, so short texts
have k-mers too and texts that begin alike share some.

The fingerprint is a sketch of all anchors: by the first seven bits of its hash an anchor belongs to one of 128 bins, and a
bin keeps its anchor of the least hash and, of those, the first: the last three hex digits of the hash (the first ones are near zero in long texts, whatever the text) and the last five of its
place ("........" if the bin has none). The likeness of two fingerprints is the share of anchors in
common, estimated from bins by matching places: the anchors of equal hash digits of two texts stand in the order of their places, and one is matched if the next or
the one before has been shifted alike, within NEAR code points, as those of a passage in common are. Of 4096 unrelated bins one has equal digits by chance, at a shift of its own. With m of n filled bins matched, the
Jaccard index is m / n and the share 2m / (n + m). With FEW filled bins or fewer, all equal digits are matched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import map_texts, small_batches, text_chunks, texts_of
from voxelweave.llm.neighbours import in_order_with_next

K, S = 12, 6
BINS, HASH_DIGITS, PLACE_DIGITS = 128, 3, 5
DIGITS, EMPTY = HASH_DIGITS + PLACE_DIGITS, "." * (HASH_DIGITS + PLACE_DIGITS)
#: Difference of the shifts of neighbours, in code points, and bins that are too few for neighbours.
NEAR, FEW = 256, 8
#: Code points that are worked on at once.
SLICE = 1 << 18
_MARKS = (0x110000 + np.arange(K - 1)).astype(np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def anchors(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the anchors of a text, in slices of it. A place below K - 1 counts marks of the start."""
    codes = np.concatenate((_MARKS, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))) if text else _MARKS[:0]
    for at in range(0, max(0, len(codes) - K + 1), SLICE):
        part = codes[at:at + SLICE + K - 1].astype(np.uint64)
        n = len(part) - S + 1
        h = part[:n].copy()
        for i in range(1, S):
            h *= _A
            h += part[i:i + n]
        h = _mixed(h)
        width = K - S + 1
        n -= width - 1
        least = h[:n].copy()
        for i in range(1, width):
            np.minimum(least, h[i:i + n], out=least)
        first, last = h[:n], h[width - 1:width - 1 + n]
        found = np.flatnonzero((least == first) | (least == last))
        yield at + found, _mixed(first[found] * _A + last[found])  # K = 2 S: the outer s-mers are the whole k-mer


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(least hash, place) of every bin. A text without an anchor is an anchor itself; the empty text fills no bin."""
    least, place = np.full(BINS, _NONE), np.zeros(BINS, np.int64)
    for at, h in anchors(text):
        order = np.argsort(h, kind="stable")  # the bin is the highest digits of the hash
        bins = (h[order] >> np.uint64(57)).astype(np.intp)
        first = np.flatnonzero(np.concatenate((bins[:1] >= 0, bins[1:] != bins[:-1])))
        own, found = bins[first], order[first]
        less = h[found] < least[own]
        least[own[less]], place[own[less]] = h[found[less]], at[found[less]]
    if text and (least == _NONE).all():
        h = np.uint64(int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
        least[int(h >> np.uint64(57))] = h
    return least, place


def _digits(sketched: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash digits (-1 for an empty bin) and place digits, as numbers."""
    least, place = sketched
    return np.where(least == _NONE, -1, (least & np.uint64((1 << 4 * HASH_DIGITS) - 1)).astype(np.int64)), place & ((1 << 4 * PLACE_DIGITS) - 1)


def shown(sketched: tuple[np.ndarray, np.ndarray]) -> str:
    h, place = _digits(sketched)
    return "".join(EMPTY if x < 0 else f"{x:0{HASH_DIGITS}x}{p:0{PLACE_DIGITS}x}" for x, p in zip(h.tolist(), place.tolist()))


def _matched(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The likeness of two sketches as digits."""
    filled = int(((a[0] >= 0) | (b[0] >= 0)).sum())
    if not filled:
        return 1.0
    alike = np.flatnonzero((a[0] >= 0) & (a[0] == b[0]))
    if filled > FEW:
        order = alike[np.argsort(a[1][alike], kind="stable")]
        close = np.abs(np.diff(a[1][order] - b[1][order])) <= NEAR
        matched = int((np.concatenate(([False], close)) | np.concatenate((close, [False]))).sum()) if len(order) else 0
    else:
        matched = len(alike)
    return 2 * matched / (filled + matched)


def likeness_of_sketches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """As ``likeness`` of their fingerprints."""
    a, b = _digits(a), _digits(b)
    return 1.0 if all(np.array_equal(np.where(a[0] < 0, -1, x), np.where(b[0] < 0, -1, y)) for x, y in zip(a, b)) else _matched(a, b)


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints; equal ones are 1."""
    if a == b:
        return 1.0

    def digits(x: str) -> tuple[np.ndarray, np.ndarray]:
        bins = [x[i:i + DIGITS] for i in range(0, BINS * DIGITS, DIGITS)]
        return tuple(np.array([-1 if d == EMPTY else int(d[cut], 16) for d in bins]) for cut in (slice(0, HASH_DIGITS), slice(HASH_DIGITS, None)))

    return _matched(digits(a), digits(b))


def likeness_of(a: Column, b: Column) -> Column:
    """The same of two columns of fingerprints."""
    bins = lambda c: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(c, i * DIGITS + 1, F.lit(DIGITS)))
    place = lambda x: F.conv(F.substring(x, HASH_DIGITS + 1, PLACE_DIGITS), 16, 10).cast("int")
    pairs = F.filter(F.arrays_zip(bins(a).alias("x"), bins(b).alias("y")), lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    n = F.size(pairs)
    same = F.filter(pairs, lambda p: F.substring(p["x"], 1, HASH_DIGITS) == F.substring(p["y"], 1, HASH_DIGITS))
    # by place, bins of one place in their order
    found = F.array_sort(F.transform(same, lambda p, i: F.struct(place(p["x"]).alias("place"), i.alias("i"), (place(p["x"]) - place(p["y"])).alias("shift"))))
    shifts = F.transform(found, lambda x: x["shift"])
    close = F.filter(shifts, lambda x, i: F.coalesce(F.abs(x - F.get(shifts, i + 1)) <= NEAR, F.lit(False)) | F.coalesce(F.abs(x - F.get(shifts, i - 1)) <= NEAR, F.lit(False)))
    matched = F.when(n > FEW, F.size(close)).otherwise(F.size(same))
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * matched / (n + matched))


def document_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, anchor), a row for every anchor of every row, for matching by position; place counts code points from the start, marks have negative ones.

    Null texts count as empty and have no anchor. Repeated rows repeat theirs.
    """
    src = texts_of(docs, id_col, text_col)

    def kernel(chunk: pa.RecordBatch) -> dict:
        found = [list(anchors(t)) for t in chunk.column("text").to_pylist()]
        place = pa.array([np.concatenate([p for p, _ in f] or [np.empty(0, np.int64)]) - (K - 1) for f in found], pa.list_(pa.int64()))
        value = pa.array([np.concatenate([h for _, h in f] or [np.empty(0, np.uint64)]).view(np.int64) for f in found], pa.list_(pa.int64()))
        return {"doc_id": chunk.column("doc_id"), "place": place, "anchor": value}

    kept = map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, place array<long>, anchor array<long>")
    return kept.select("doc_id", F.inline(F.arrays_zip("place", "anchor")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row. Null texts count as empty; null and repeated ids stay as they are; other columns are ignored."""
    src = texts_of(docs, id_col, text_col)

    def kernel(chunk: pa.RecordBatch) -> dict:
        return {"doc_id": chunk.column("doc_id"), "fingerprint": pa.array([shown(sketch(t)) for t in chunk.column("text").to_pylist()], pa.string())}

    return map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next) of every row, the edit taking its text from the next row.
    near_edited and near_next are the likeness of a row's fingerprint to those of its edited text and of the next row.

    Rows stand in ascending order of id (null ids first; rows of one id by their text), and the first follows the last. Null texts
    count as empty. A single row follows itself. Texts are shuffled once, in ``parts`` ranges of ids (and of the beginnings of texts, where very many rows have one id or none); the first row of each range is sent to the range before as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = texts_of(docs, id_col, text_col)
    names = ("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "next_fingerprint", "near_edited", "near_next")
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # (part, doc_id as an array of one, text, fingerprint)
        for chunk in text_chunks(batches):
            rows, ids = [], []
            part, extra = chunk.column("part").to_pylist(), chunk.column("extra").to_pylist()
            for k, text in enumerate(chunk.column("text").to_pylist()):
                if extra[k] and (waiting is None or waiting[0] != part[k]):
                    continue
                least = sketch(text)
                own = shown(least)
                if waiting is not None and waiting[0] == part[k]:
                    _, doc_id, before, least_before, print_before = waiting
                    new = edited(before, text)
                    least_new = sketch(new)
                    rows.append((len(before), new, print_before, shown(least_new), own, likeness_of_sketches(least_before, least_new), likeness_of_sketches(least_before, least)))
                    ids.append(doc_id)
                waiting = None if extra[k] else (part[k], chunk.column("doc_id").slice(k, 1), text, least, own)
            if rows:
                columns = list(zip(*rows))
                types = (pa.int64(), *[pa.string()] * 4, pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    ordered = in_order_with_next(src, "doc_id", "text", parts).select("doc_id", "text", "part", "extra")
    return ordered.mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, next_fingerprint string, near_edited double, near_next double")
