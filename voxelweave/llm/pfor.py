"""Patched frame of reference for token ids.

Ids are cut into blocks of BLOCK. From each the block's minimum is subtracted, and the differences are packed at the width that
holds PERCENTILE per cent of them; the others are exceptions, kept whole in a list with their places. Packed values of one width stand
together: first the low byte of each value if the width is eight or more, then one plane of BLOCK bits for every bit left.

Segment, little-endian, the unit that is written and read (see tokenfile.py):
  magic "VWT1", part u32, number in the part u32, documents u32, ids u64, blocks u32, packed bytes u64, exceptions u32, crc32 of all that follows u32
  documents: a length-prefixed (u32) utf-8 id, 0xFFFFFFFF for a null one; then the number of ids of each u64
  blocks: minimum u32, width u8, exceptions u8, start of its packed bytes u64
  exceptions, block by block: place u8, difference u32; then the packed bytes
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BLOCK, PERCENTILE = 128, 90
MAGIC = b"VWT1"
_HEAD = struct.Struct("<4sIIIQIQII")
_NULL = 0xFFFFFFFF


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for unsigned numbers; none for 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of width * BLOCK / 8 bytes."""
    parts, done = [], 0
    while width - done >= 8:
        parts.append((low >> np.uint32(done)).astype(np.uint8))
        done += 8
    parts += [np.packbits((low >> np.uint32(j)).astype(np.uint8) & 1, axis=1, bitorder="little") for j in range(done, width)]
    return np.concatenate(parts, axis=1) if parts else np.empty((len(low), 0), np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    out, done, at = np.zeros((len(packed), BLOCK), np.uint32), 0, 0
    while width - done >= 8:
        out |= packed[:, at:at + BLOCK].astype(np.uint32) << np.uint32(done)
        done, at = done + 8, at + BLOCK
    for j in range(done, width):
        out |= np.unpackbits(packed[:, at:at + BLOCK // 8], axis=1, bitorder="little").astype(np.uint32) << np.uint32(j)
        at += BLOCK // 8
    return out


@dataclass
class Packed:
    n: int
    least: np.ndarray
    width: np.ndarray
    patched: np.ndarray
    start: np.ndarray
    place: np.ndarray
    value: np.ndarray
    data: np.ndarray


def pack(ids: np.ndarray) -> Packed:
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty(blocks * BLOCK, np.uint32)
    x[:n] = ids
    x[n:] = ids[-1] if n else 0
    x = x.reshape(blocks, BLOCK)
    least = x.min(axis=1, initial=_NULL)
    d = x - least[:, None]
    rank = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    width = _bits(np.partition(d, rank, axis=1)[:, rank]) if blocks else np.empty(0, np.uint8)
    out = (d >> np.minimum(width, 31).astype(np.uint32)[:, None] != 0) & (width < 32)[:, None]
    block, place = np.nonzero(out)
    size = width.astype(np.uint64) * np.uint64(BLOCK // 8)
    start, parts, at = np.zeros(blocks, np.uint64), [], 0
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        start[own] = np.uint64(at) + np.arange(len(own), dtype=np.uint64) * size[own]
        mask = np.uint32((1 << w) - 1)
        parts.append(_pack(d[own] & mask, w).ravel())
        at += parts[-1].nbytes
    return Packed(n, least, width, out.sum(axis=1).astype(np.uint8), start, place.astype(np.uint8), d[block, place], np.concatenate(parts) if parts else np.empty(0, np.uint8))


def unpack(p: Packed, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of blocks first to stop (all of them by default), found by the index of block starts."""
    stop = len(p.least) if stop is None else stop
    width = p.width[first:stop]
    out = np.empty((stop - first, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        size = w * BLOCK // 8
        starts = p.start[first:stop][own].astype(np.int64)
        if len(own) and size and (np.diff(starts) == size).all():
            raw = p.data[starts[0]:starts[0] + len(own) * size].reshape(len(own), size)
        else:
            raw = p.data[starts[:, None] + np.arange(size)[None, :]]
        out[own] = _unpack(raw, w)
    at = np.concatenate(([0], np.cumsum(p.patched, dtype=np.int64)))
    block = np.repeat(np.arange(stop - first), p.patched[first:stop])
    mine = slice(int(at[first]), int(at[stop]))
    out[block, p.place[mine]] = p.value[mine]
    out += p.least[first:stop, None]
    return out.ravel()[:max(0, min(p.n, stop * BLOCK) - first * BLOCK)]


def write_segment(part: int, number: int, doc_ids: list[str | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    p = pack(ids)
    names = b"".join(struct.pack("<I", _NULL) if d is None else struct.pack("<I", len(e := d.encode())) + e for d in doc_ids)
    body = b"".join((
        names, counts.astype("<u8").tobytes(), p.least.astype("<u4").tobytes(), p.width.tobytes(), p.patched.tobytes(), p.start.astype("<u8").tobytes(),
        p.place.tobytes(), p.value.astype("<u4").tobytes(), p.data.tobytes(),
    ))
    return _HEAD.pack(MAGIC, part, number, len(doc_ids), p.n, len(p.least), p.data.nbytes, len(p.place), zlib.crc32(body)) + body


@dataclass
class Segment:
    part: int
    number: int
    doc_ids: list[str | None]
    counts: np.ndarray
    packed: Packed

    def ids(self) -> np.ndarray:
        return unpack(self.packed)

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        """Some of the segment's ids; only the blocks that hold them are unpacked."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        return unpack(self.packed, first, last)[start - first * BLOCK:stop - first * BLOCK]


def read_segment(data: bytes, at: int = 0) -> tuple[Segment, int]:
    """(segment, place after it); data that is cut off or damaged raises."""
    magic, part, number, docs, n, blocks, size, patches, crc = _HEAD.unpack_from(data, at)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    begin = here = at + _HEAD.size
    doc_ids: list[str | None] = []
    for _ in range(docs):
        (length,) = struct.unpack_from("<I", data, here)
        here += 4
        doc_ids.append(None if length == _NULL else data[here:here + length].decode())
        here += 0 if length == _NULL else length

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal here
        out = np.frombuffer(data, kind, count, here)
        here += out.nbytes
        return out

    counts = take("<u8", docs)
    least, width, patched, start = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u8", blocks)
    place, value, packed = take("u1", patches), take("<u4", patches), take("u1", size)
    if zlib.crc32(memoryview(data)[begin:here]) != crc:
        raise ValueError("a segment of token ids is damaged")
    return Segment(part, number, doc_ids, counts, Packed(n, least, width, patched, start, place, value, packed)), here
