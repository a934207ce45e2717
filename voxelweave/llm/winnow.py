"""Benchmark decontamination by winnowing.

Words are runs of bytes other than ASCII non-alphanumerics, A-Z lower-cased. A window is ``span`` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. Both sides keep the
minimum hash of every run of ``w`` consecutive ``k``-grams with ``w + k - 1 = span``: a shared span of that many words holds
the same ``w`` k-grams on both sides and so the same kept one. Test fingerprints are joined
with training fingerprints inside the scan of the documents; each hit is extended to the windows around it, which are
compared word for word. Items shorter than ``span`` are winnowed at their own length in the same way.

The test side is cut into blocks of at most ``block_words`` words, and each block is broadcast on its own; several
blocks scan the documents once each and their hits are merged by document. So a broadcast never
outgrows ``block_words`` words, no matter how large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import filter_texts, map_texts, texts_of

#: Byte by byte: letters lower-cased, digits and bytes of other characters kept, all else a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Of the polynomial hash over word numbers, modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word numbers; k-grams with an unknown word (0) get the largest number, which is never kept."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for i in range(k):
        part = ids[i:i + n]
        known &= part > 0
        h = h * _BASE + part.astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.where(known, np.minimum(h, _NONE - np.uint64(1)), _NONE)


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost minimum of every w consecutive hashes (of all of them if there are fewer).

    A place is kept if it can be reached by a window in which nothing to its left is smaller and nothing
    to its right is smaller or equal, so only places with known k-grams are looked at.
    """
    at = np.flatnonzero(h != _NONE)
    if not len(at):
        return at
    w = min(w, len(h))
    wall = np.zeros(w - 1, np.uint64)  # windows end at the ends of the text
    padded = np.concatenate((wall, h, wall))
    own = h[at][:, None]
    before = padded[at[:, None] + (w - 2 - np.arange(w - 1))[None, :]]
    after = padded[at[:, None] + (w + np.arange(w - 1))[None, :]]
    inside_left = at[:, None] - 1 - np.arange(w - 1)[None, :] >= 0
    inside_right = at[:, None] + 1 + np.arange(w - 1)[None, :] < len(h)
    left = np.cumprod((before >= own) & inside_left, axis=1).sum(axis=1)
    right = np.cumprod((after > own) & inside_right, axis=1).sum(axis=1)
    return at[left + right + 1 >= w]


def _sizes(span: int) -> tuple[int, int]:
    """(k, w) for spans of ``span`` words: k-grams of under half of it, so that fingerprints are sparse but selective."""
    k = max(1, (span + 1) * 2 // 5)
    return k, span - k + 1


@dataclass
class Level:
    """Windows of one length: the kept fingerprints, and the items of each window by its word numbers."""

    span: int
    prints: np.ndarray
    items: dict[bytes, tuple] = field(default_factory=dict)


@dataclass
class Block:
    """Part of the benchmark, ready to be searched for."""

    vocab: dict[bytes, int]
    levels: list[Level]


def build_block(items: list[tuple], span: int) -> Block:
    """items: (item_id, words). Word numbers start at 1."""
    vocab: dict[bytes, int] = {}
    found: dict[int, tuple[set, dict]] = {}
    for item, words in items:
        if not words:
            continue
        ids = np.fromiter((vocab.setdefault(w, len(vocab) + 1) for w in words), np.int32, len(words))
        n = min(span, len(ids))
        k, w = _sizes(n)
        prints, windows = found.setdefault(n, (set(), {}))
        h = gram_hashes(ids, k)
        prints.update(h[winnowed(h, w)].tolist())
        for i in range(len(ids) - n + 1):
            windows.setdefault(ids[i:i + n].tobytes(), set()).add(item)
    levels = [Level(n, np.array(sorted(p), np.uint64), {k: tuple(v) for k, v in win.items()}) for n, (p, win) in sorted(found.items())]
    return Block(vocab, levels)


def search(words: list[bytes], block: Block) -> tuple[np.ndarray, set]:
    """(places of hit words, items with occurring windows) of one document."""
    get = block.vocab.get
    ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    if not block.levels or np.count_nonzero(ids) < block.levels[0].span:
        return np.empty(0, np.int64), set()
    hit: np.ndarray | None = None
    items: set = set()
    for level in block.levels:
        n = level.span
        if len(ids) < n:
            continue
        k, w = _sizes(n)
        h = gram_hashes(ids, k)
        at = winnowed(h, w)
        if not len(at):
            continue
        place = np.minimum(np.searchsorted(level.prints, h[at]), len(level.prints) - 1)
        at = at[level.prints[place] == h[at]]
        if not len(at):
            continue
        # the windows that hold a matching k-gram
        starts = np.unique((at[:, None] + np.arange(k - n, 1)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts <= len(ids) - n)]
        for s in starts.tolist():
            who = level.items.get(ids[s:s + n].tobytes())
            if who is not None:
                items.update(who)
                if hit is None:
                    hit = np.zeros(len(ids) + 1, np.int32)
                hit[s] += 1
                hit[s + n] -= 1
    if hit is None:
        return np.empty(0, np.int64), items
    return np.flatnonzero(np.cumsum(hit[:-1]) > 0), items


def _blocks(bench: DataFrame, item_col: str, text_col: str, span: int, block_words: int) -> Iterator[Block]:
    """Blocks of the benchmark of at most ``block_words`` words, or one item if that is longer."""
    held, n = [], 0
    rows = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        if held and n + len(words) > block_words:
            yield build_block(held, span)
            held, n = [], 0
        held.append((row.item, words))
        n += len(words)
    if held:
        yield build_block(held, span)


def contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span: int = 13, block_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for every row of ``docs``.

    spans: [start, end) pairs of hit words, in order; items: ids (as strings, sorted) of items of which a window occurs.
    Null texts have no words. Items that share an id count as one, and so do those without an id: their windows hit words like others, and items ends in a null for them.
    Repeated documents each get their row (rows with the same id and text are alike). An empty benchmark hits nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = texts_of(docs, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"

    def scan(block: Block | None, keyed: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def kernel(chunk: pa.RecordBatch) -> dict:
            own = shared.value
            n_words, spans, items, key = [], [], [], []
            for text in chunk.column("text").to_pylist():
                words = words_of(text)
                at, who = search(words, own) if own and words else (np.empty(0, np.int64), set())
                n_words.append(len(words))
                spans.append(as_spans(at))
                items.append(_in_order(who))
                if keyed:
                    key.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            out = {"doc_id": chunk.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
            return out | ({"key": pa.array(key, pa.string())} if keyed else {})

        return map_texts(src, kernel, schema + ", key string" * keyed)

    blocks = _blocks(bench, item_col, item_text_col, span, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        found = scan(first, False)
    else:
        both = None
        for k, block in enumerate(chain((first, second), blocks)):
            part = scan(block, True).withColumn("block", F.lit(k))
            both = part if both is None else both.unionByName(part)
        found = _merged(both, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _in_order(items: set) -> list:
    return sorted(items, key=lambda x: (x is None, x or ""))


def as_spans(at: np.ndarray) -> list[dict]:
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return [{"start": int(a), "end": int(b) + 1} for a, b in zip(at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))])]


def _merged(both: DataFrame, schema: str) -> DataFrame:
    """The hits of all blocks together. Rows of one id and text are alike, so they are counted first and repeated at the end."""

    def union(rows: pa.Table) -> pa.Table:
        at = [np.arange(s["start"], s["end"]) for r in rows.column("spans").to_pylist() for s in r]
        items = _in_order({x for r in rows.column("items").to_pylist() for x in r})
        spans = as_spans(np.unique(np.concatenate(at))) if at else []
        one = rows.slice(0, 1)
        return pa.table({"doc_id": one.column("doc_id"), "n_words": one.column("n_words"), "spans": pa.array([spans], _SPANS), "items": pa.array([items], pa.list_(pa.string())), "copies": one.column("copies")})

    once = both.groupBy("doc_id", "key", "block").agg(*(F.first(x).alias(x) for x in ("n_words", "spans", "items")), F.count("*").alias("copies"))
    merged = once.groupBy("doc_id", "key").applyInArrow(union, schema + ", copies long")
    return merged.select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def is_contaminated(n_words: int, n_hit: int, share: int) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def decontaminated(
    docs: DataFrame, bench: DataFrame, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span: int = 13, block_words: int = 1_000_000,
) -> DataFrame:
    """The rows of ``docs`` of which fewer than one in ``share`` words is hit, with all their columns; hits as in ``contamination``.

    With one block of the benchmark the rows are filtered as they are scanned; with several, rows are dropped by id and text after the
    hits of all blocks are merged. Rows without words (null and empty texts) stay, null and repeated ids and items without an id are as in
    ``contamination``, an empty benchmark takes nothing away.
    """
    blocks = _blocks(bench, item_col, item_text_col, span, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def clean(chunk: pa.RecordBatch) -> list[bool]:
            found = [(words, search(words, shared.value)[0]) if words else ((), ()) for words in map(words_of, chunk.column(text_col).to_pylist())]
            return [not is_contaminated(len(words), len(hit), share) for words, hit in found]

        return filter_texts(docs, clean, text_col)
    found = contamination(docs.select(F.struct(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text")), bench, "doc_id", "text", item_col, item_text_col, span, block_words)
    bad = found.filter((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select(F.col(f"doc_id.{id_col}").alias("bad_id"), F.col(f"doc_id.{text_col}").alias("bad_text")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]) & (docs[text_col] == bad["bad_text"]), "left_anti")
