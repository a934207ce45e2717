"""Byte-level BPE, encoded and decoded by tree reduction.

Texts: a text is cut in halves down to leaves, each leaf is encoded as a text of its own, and neighbours are
joined. Joining scans a window anew: from the last piece of the left side that cannot depend on what follows, over
a growing part of the right side, until a piece ends where one of the right side's pieces ends. Matches of the
pattern depend only on the text from their start to one character past their end (contractions: two past the start), so all
pieces outside of the window are then those of the whole text.

Pieces: a piece that is a token is that token. Others are cut in halves of bytes in the same way. Joining two token lists encodes
a window of their last and first tokens anew and doubles it until the tokens at its edges are stable: two neighbouring
tokens are stable if their bytes, encoded alone, give the same two. Where all neighbours in
a list are stable, no merge of the whole crosses any of their borders (the first one that did would also be the next merge
of that pair alone), so the list is the encoding of the whole.

Decoding maps tokens to bytes and joins neighbours up the same kind of tree, pair by pair: concatenation needs no window.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate, chain
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import map_texts, small_batches, texts_of

#: Characters of a text leaf, bytes of a piece leaf, and pieces that a worker remembers at once (of at most PIECE_CHARS characters).
TEXT_LEAF, PIECE_LEAF, REMEMBERED, PIECE_CHARS = 512, 12, 250_000, 48
_NO_RANK = 1 << 60


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines of base64 tokens and their ids."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class _Pieces(dict):
    """Tokens of pieces, up to a bound; then those that do not come again before it is reached once more are forgotten."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = self.before.get(piece) or self.encode(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, text_leaf: int = TEXT_LEAF, piece_leaf: int = PIECE_LEAF):
        self.ranks, self.text_leaf, self.piece_leaf = ranks, text_leaf, piece_leaf
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.stable = lru_cache(200_000)(self._stable)
        self.pieces = _Pieces(self.encode_piece)

    # ---- pieces

    def _merged(self, data: bytes) -> list[int]:
        """Merge the two neighbours of the lowest rank, the leftmost first, until none is left."""
        if len(data) > 4 * self.piece_leaf:
            return self._merged_long(data)
        get = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = [get(data[i:i + 2], _NO_RANK) for i in range(len(data) - 1)]
        while rank:
            low = min(rank)
            if low == _NO_RANK:
                break
            i = rank.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], _NO_RANK)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], _NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a heap, for windows that had to grow."""
        get, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))  # of the part that starts here; 0: swallowed
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[data[i:e]] for i, e in enumerate(end) if e]

    def _stable(self, a: int, b: int) -> bool:
        return self._merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a or b
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self._merged(b"".join(self.tokens[t] for t in chain(a[len(a) - i:], b[:j])))
            left = i == len(a) or self.stable(a[-i - 1], window[0])
            right = j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return [*a[:len(a) - i], *window, *b[j:]]
            i, j = i if left else 2 * i, j if right else 2 * j

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.piece_leaf:
            return self._merged(data)
        half = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.encode_bytes(data))

    # ---- texts: (pieces, tokens of each)

    def _joined(self, left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list]:
        if not left[0] or not right[0]:
            return left if left[0] else right
        keep, tail = len(left[0]), 0
        while keep and tail < 2:  # a piece is settled if two characters at least follow it
            keep -= 1
            tail += len(left[0][keep])
        head = "".join(left[0][keep:])
        theirs, many = right[0], 2
        while True:
            many = min(many, len(theirs))
            window = head + "".join(theirs[:many])
            size = len(window) - (0 if many == len(theirs) else 2)
            new = self.split(window)
            at = {p: k for k, p in enumerate(accumulate(map(len, theirs[:many]), initial=len(head)))}
            for k, p in enumerate(accumulate(map(len, new)), 1):
                if p > size:
                    break
                if p in at:
                    fresh = new[:k]
                    rest = at[p]
                    return [*left[0][:keep], *fresh, *theirs[rest:]], [*left[1][:keep], *map(self.pieces.__getitem__, fresh), *right[1][rest:]]
            many *= 2

    def _encoded(self, text: str) -> tuple[list, list]:
        if len(text) <= self.text_leaf:
            found = self.split(text)
            return found, list(map(self.pieces.__getitem__, found))
        half = len(text) // 2
        return self._joined(self._encoded(text[:half]), self._encoded(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self._encoded(text)[1]), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        parts = list(map(self.tokens.__getitem__, ids))
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else []
            parts = [*map(add, parts[::2], parts[1::2]), *odd]
        return parts[0] if parts else b""


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(key: tuple, content: bytes) -> Encoder:
    """One per worker and vocabulary, so that remembered pieces last over tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(content), key[1])
    return _ENCODERS[key]


def _shared(spark, path: str, pattern: str):
    """The vocabulary file, read by the driver and broadcast: its size does not depend on the data."""
    with open(path, "rb") as f:
        content = f.read()
    return (hash(content), pattern), spark.sparkContext.broadcast(content)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row: ids as ``encode`` gives them, and the bytes that ``decode`` gives for them, in one pass of one worker.

    A null or empty text has no ids and no bytes. Null and repeated document ids stay as they are, an empty table stays empty, other columns are ignored.
    """
    key, content = _shared(docs.sparkSession, path, pattern)
    src = texts_of(docs, id_col, text_col)

    def kernel(chunk: pa.RecordBatch) -> dict:
        enc = _encoder(key, content.value)
        ids = [enc.encode(t) for t in chunk.column("text").to_pylist()]
        return {"doc_id": chunk.column("doc_id"), "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "decoded": pa.array([enc.decode(x.tolist()) for x in ids], pa.binary())}

    return map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row; ids: token ids as little-endian unsigned 32-bit integers, one after another.

    A null or empty text has no ids. Null and repeated document ids stay as they are, an empty table stays empty, other columns are ignored.
    """
    key, content = _shared(docs.sparkSession, path, pattern)
    src = texts_of(docs, id_col, text_col)

    def kernel(chunk: pa.RecordBatch) -> dict:
        enc = _encoder(key, content.value)
        return {"doc_id": chunk.column("doc_id"), "ids": pa.array([enc.encode(t).tobytes() for t in chunk.column("text").to_pylist()], pa.binary())}

    return map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids as ``encode`` gives them) with their bytes as ``decoded``; null ids have none, unknown ids raise."""
    key, content = _shared(encoded.sparkSession, path, pattern)
    small_batches(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            enc = _encoder(key, content.value)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [enc.decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "decoded": pa.array(out, pa.binary())})

    src = encoded.select("doc_id", F.col("ids").cast("binary").alias("ids"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")
