"""Token-id files: documents are encoded, packed (see pfor.py) and written in ascending order of their ids, and read back.

Writing ranges the documents by id in one shuffle, encodes each range in order and writes its segments through Spark's own
writer, so that files of failed or repeated tasks never show. A file is a row of segments, each followed by a line feed; at most
SEGMENTS_IN_FILE of them, so a file's size is bounded however many documents a range has. Reading opens files through Spark as well.

Encoding: the normalizer and pre-tokenizer of the vocabulary never look across ASCII white space, so the words between it are
encoded by themselves and remembered up to a bound. Words are
lower-cased (A-Z) first, as the normalizer would; not in texts with combining marks, which it joins with letters before it lower-cases them.
A word of Latin-1 letters, with ASCII punctuation other than an apostrophe after them or none, is one piece or two whatever stands around it, so it
goes to the library's model at once, piece by piece; all other words take the library's whole way. So does, as a whole, a text in which the string of a special token of the
vocabulary stands (in letters of either case): the library makes that token of it.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm.common import small_batches, text_chunks, texts_of, written
from voxelweave.llm.neighbours import LEAD
from voxelweave.llm.pfor import read_segment, write_segment

#: Ids of a segment (a longer document is a segment of its own), segments of a file, and words that a worker remembers.
SEGMENT_IDS, SEGMENTS_IN_FILE, REMEMBERED, WORD_BYTES = 1 << 19, 16, 500_000, 64


_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be seen, else the next of those from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class _Words(dict):
    """Ids of words of at most WORD_BYTES, so that what is remembered is bounded in bytes. Past half of the bound, words that have not come since the half before are forgotten."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.before = encode, most, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > WORD_BYTES:
            return self.encode(word)
        if len(self) >= self.most // 2:
            self.before = dict(self)
            self.clear()
        found = self.before.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found


class WordEncoder:
    """Ids of texts by the ``tokenizers`` library, which adds no special tokens but finds those that a text spells out."""

    def __init__(self, content: bytes, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.words, self.pieces = _Words(self.encode_word, remembered), _Words(self.encode_piece, remembered // 4)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        steps = json.loads(content)
        self.special = [t["content"].lower().encode() for t in steps.get("added_tokens") or []]
        #: Whether the normalizer and pre-tokenizer are those that plain words may pass by.
        self.plain = [n["type"] for n in (steps.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            n["type"] for n in (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]

    def encode_piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode_word(self, word: bytes) -> bytes:
        text = word.decode()
        m = _PLAIN.fullmatch(text) if self.plain else None
        if m is None:
            return np.array(self.tokenizer.encode([text], is_pretokenized=True, add_special_tokens=False).ids, "<u4").tobytes()
        return self.pieces[m[1].lower()] + (self.pieces[m[2]] if m[2] else b"")

    def encode_text(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        low = data.lower()
        if any(s in low for s in self.special):
            return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        # A-Z in lower case, unless there are combining marks (U+0300 to U+036F)
        return b"".join(map(self.words.__getitem__, (data if b"\xcc" in data or b"\xcd" in data else low).split()))

    def encode_all(self, texts: list[str], end: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, ``end`` after them."""
        last = np.array([end], "<u4").tobytes()
        return [self.encode_text(t) + last for t in texts]


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(content: bytes) -> WordEncoder:
    key = zlib.crc32(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(content)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Write the token ids of every row to files under ``path``, in ascending order of id (null ids first, rows of one id by their text).

    ``vocabulary`` is the file of a tokenizer of the ``tokenizers`` library; it is read by the driver and broadcast (its size does not depend
    on the data). ``end`` follows the ids of each document. Null texts count as empty: their only id is ``end``. Repeated rows each have their ids in the files, an
    empty table makes files without segments, other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        names, held, size = [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal names, held, size, number
            counts = np.array([len(h) // 4 for h in held], np.uint64)
            data = write_segment(part, number, names, counts, np.frombuffer(b"".join(held), "<u4"))
            names, held, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict({"segment": pa.array([data], pa.binary())})

        for chunk in text_chunks(batches):
            ids = chunk.column("doc_id").to_pylist()
            for doc_id, own in zip(ids, _encoder(content.value).encode_all(chunk.column("text").to_pylist(), end)):
                if held and size + len(own) > 4 * SEGMENT_IDS:
                    yield segment()
                names.append(doc_id)
                held.append(own)
                size += len(own)
        if held:
            yield segment()

    src = texts_of(docs, id_col, text_col)
    ordered = src.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, LEAD)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    segments = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "segment binary")
    # the text writer writes the bytes of a string as they are; no decoding takes place in this cast
    segments.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS_IN_FILE).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id as a string, part, segment, place, n_tokens, ids_crc32), a row for each document in the files.

    part, segment and place order the documents; ids_crc32 is that of all the document's ids as little-endian unsigned 32-bit integers.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                data, at = data.as_py(), 0
                while at < len(data):
                    s, at = read_segment(data, at)
                    if data[at:at + 1] != b"\n":
                        raise ValueError("a file of token ids is damaged")
                    at += 1
                    ids = memoryview(s.ids().astype("<u4", copy=False)).cast("B")
                    stops = (4 * np.cumsum(s.counts)).tolist()
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip([0, *stops[:-1]], stops)]
                    n = len(s.doc_ids)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(s.doc_ids, pa.string()), "part": pa.array([s.part] * n, pa.int32()), "segment": pa.array([s.number] * n, pa.int32()),
                        "place": pa.array(range(n), pa.int32()), "n_tokens": pa.array(s.counts.astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64()),
                    })

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "doc_id string, part int, segment int, place int, n_tokens long, ids_crc32 long")


def with_starts(found: DataFrame) -> DataFrame:
    """``found`` (as read) with ``start``, the number of ids of all documents before it.

    Sums go up the order: places within a segment, segments within a part, and parts, of which the driver adds up one number each.
    """
    spark = found.sparkSession
    found, _ = written(found, "token-index")
    from pyspark.sql import Window

    sums = found.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    by_part = {r["part"]: r["n"] for r in sums.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total, before = 0, []
    for part in sorted(by_part):
        before.append((part, total))
        total += by_part[part]
    if not before:
        return found.withColumn("start", F.lit(0).cast("long"))
    parts = spark.createDataFrame(before, "part int, before_part long")
    in_part = sums.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")).join(F.broadcast(parts), "part")
    in_segment = Window.partitionBy("part", "segment").orderBy("place")
    placed = found.withColumn("within", F.sum("n_tokens").over(in_segment) - F.col("n_tokens"))
    return placed.join(in_part.select("part", "segment", (F.col("before") + F.col("before_part")).alias("offset")), ["part", "segment"]).withColumn("start", F.col("within") + F.col("offset")).drop("within", "offset")
