"""Secret scans: keyword automaton, anchored patterns near its hits, checksums of tokens that carry one.

1. One Aho-Corasick pass over the text's UTF-8 bytes, A-Z lower-cased, finds the keywords of all kinds. Runs of hex digits have
   no keyword: any run of 32 holds a byte whose place is a multiple of 32, so only those places are probed.
2. At a hit the kind's pattern is matched from the keyword's place, never searched for. Matches of a kind do not overlap: a
   hit inside the match before it is passed over, whether or not that match was long enough to be kept.
3. Tokens with an embedded checksum are kept only if it is right, so look-alikes are dropped.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelweave.llm.common import map_texts, small_batches, text_chunks, texts_of

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "checked")
BASE_KINDS = KINDS[:3]

# Keywords as they stand in lower-cased text.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS_WORD = "akia"
#: Prefixes of access tokens that end in a base-62 CRC-32 of the 30 characters after the prefix.
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_HEX_RUN = re.compile(rb"[0-9a-f]+")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD,)), ("checked", CHECKED_WORDS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_WORDS: list[ahocorasick.Automaton] = []


def checksum_holds(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the CRC-32 of ``body`` in base 62, six digits, the highest first."""
    value = 0
    for c in check.decode():
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body)


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Whole runs of hex digits of HEX_CHARS or more."""
    probes = np.flatnonzero(_HEX[np.frombuffer(data, np.uint8)[::HEX_CHARS]]) * HEX_CHARS
    out: list[tuple[int, int]] = []
    for p in probes.tolist():
        if out and p < out[-1][1]:
            continue
        start = p
        while start and _HEX[data[start - 1]] and not (out and start <= out[-1][1]):
            start -= 1
        stop = _HEX_RUN.match(data, p).end()
        if stop - start >= HEX_CHARS:
            out.append((start, stop))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of a text, in code points, by start and then kind as listed."""
    data = text.encode("utf-8", "surrogatepass")
    if not _WORDS:
        _WORDS.append(_automaton())
    hits: dict[str, list[int]] = {}
    for last, (kind, n) in _WORDS[0].iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last - n + 1)
    spans: list[tuple[int, str, int]] = []
    for kind, pattern, long_enough in (
        ("assign", ASSIGN, lambda m: m.end(1) - m.start(1) >= ASSIGN_CHARS),
        ("access", ACCESS, lambda m: m.end() - m.start() >= ACCESS_CHARS),
        ("checked", CHECKED, lambda m: checksum_holds(m[1], m[2])),
    ):
        done = 0
        for start in sorted(hits.get(kind, ())):
            if start >= done and (m := pattern.match(data, start)):
                done = m.end()
                if long_enough(m):
                    spans.append((start, kind, done))
    spans += [(a, "hex", b) for a, b in _hex_runs(data)]
    if not spans:
        return []
    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    if len(data) == len(text):
        return [(k, a, b) for a, k, b in spans]
    # bytes to code points: bytes that do not go on with a character, counted up to each place
    begins = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(k, int(begins[a]), int(begins[b])) for a, k, b in spans]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secrets) for every row; secrets: array of (kind, start, end) in code points, by start and kind, empty if there are none.

    A null or empty text has none. Null and repeated ids stay as they are, an empty table stays empty, other columns are ignored.
    """
    src = texts_of(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def kernel(chunk: pa.RecordBatch) -> dict:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in chunk.column("text").to_pylist()]
        return {"doc_id": chunk.column("doc_id"), "secrets": pa.array(found, kind)}

    return map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, secrets array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by ``mask``; overlapping spans are one. Null texts stay null; all else stays as it is."""
    columns = docs.columns
    if docs.schema[text_col].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} must be a string")
    small_batches(docs.sparkSession)
    place = columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, a, b in scan(text):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for chunk in text_chunks(batches, text_col):
            arrays = list(chunk.columns)
            arrays[place] = pa.array([clean(t) for t in chunk.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, docs.schema)
