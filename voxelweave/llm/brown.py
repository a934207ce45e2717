"""Brown class-based bigrams: exchange clustering, smoothed text probabilities.

Tokens are lower-cased (A-Z) runs without ASCII white space, and one end after each text. All counts are taken over all training texts.

Classes: every training word gets its class by what stands beside it, in two steps. The SWEPT most frequent words are moved one at a time to the
class that gives the class bigrams of the training tokens the highest likelihood, sweep by sweep, until no move helps; all other words are one symbol of a class of its own meanwhile.
Then each other word is moved once, from that class to the one of the highest gain given how often it stands before and after words of each class; as its counts are small against
those of a class, the gain is taken to first order (``gains``). These words are told apart by a hash of SLOTS values, so that their classes are a table of a fixed size: words of one slot
are moved together, by what stands beside any of them. The end is alone in class 0. A word of a slot without training tokens takes the class of the most slots.

Probability of a word after a word: P(class | class before) * P(word | class). Transitions mix class bigrams with class frequencies and a
uniform share; emissions add one to each count and one more for words not seen, so all of them are positive and sum to one.

At scale: texts are split twice, to count words and to write each text down as the codes of its words (``encoded``); all that follows reads these numbers. Word counts, and what stands beside
each slot, are summed by shuffles, the latter as packed keys dealt out by ranges of slots, and classes of slots are worked out by the executors. The table of slots and the KNOWN_WORDS most
frequent words with their counts go to every worker (fixed bounds); the counts of all other words of a text are joined by a shuffle, so the vocabulary is never in one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import small_batches, text_chunks, texts_of, written

SWEPT, CLASSES, KNOWN_WORDS, SLOTS = 2000, 32, 100_000, 1 << 22
#: Shares of the transition's parts: bigrams, frequencies, uniform.
MIX = (0.9, 0.09, 0.01)
#: Distinct words that a counting worker holds before it passes them on, and neighbours likewise.
HELD, HELD_CELLS = 250_000, 2_000_000
#: Ranges of slots by which neighbours are dealt out; of one range a worker holds a table of all counts.
RANGES = 64
#: The end token; no word is empty.
END = ""


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


@dataclass
class Codes:
    """Numbers of words: 0 the end, then the swept words, the other known words, and ``1 + known`` + its slot for any other word."""

    ids: dict[bytes, int]
    swept: int
    slots: int

    @classmethod
    def of_words(cls, head: list[bytes], others: list[bytes], slots: int) -> Codes:
        return cls({w: k for k, w in enumerate(dict.fromkeys((b"", *head, *others)))}, len(head), slots)

    @property
    def known(self) -> int:
        return len(self.ids) - 1

    def own_slots(self) -> np.ndarray:
        """The slot of the word of every code."""
        return np.concatenate((np.fromiter((crc32(w) % self.slots for w in self.ids), np.int32, len(self.ids)), np.arange(self.slots, dtype=np.int32)))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(code of each word, whether it is none of the known, the words that are none in order)."""
        row = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        new = row < 0
        left = list(compress(words, new.tolist()))
        row[new] = 1 + self.known + np.fromiter(map(crc32, left), np.int64, len(left)) % self.slots
        return row, new, left


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(list(held.values()), pa.int64())})


# ---------------------------------------------------------------- counts

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text); the end is the empty word. Each task counts in bounded pieces, a shuffle sums them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for chunk in text_chunks(batches):
            for text in chunk.column("text").to_pylist():
                held.update(tokens_of(text))
            held[b""] += chunk.num_rows
            if len(held) > HELD:
                yield _counted(held)
                held = Counter()
        if held:
            yield _counted(held)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded(docs: DataFrame, codes: Codes) -> DataFrame:
    """``docs`` (doc_id, text, learn) as (doc_id, learn, codes, rest, row), written once: the codes of words and of the end as 32-bit integers, and how often each word that is not known occurs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for chunk in text_chunks(batches):
            words, stops = [], []
            for text in chunk.column("text").to_pylist():
                words += tokens_of(text)
                words.append(b"")
                stops.append(len(words))
            row, new, left = own.of(words)
            data, upto, start, begin, ends = row.tobytes(), np.cumsum(new)[np.array(stops) - 1].tolist(), 0, 0, [0]
            blobs, words_left, times_left = [], [], []
            for stop, end in zip(stops, upto):
                blobs.append(data[4 * start:4 * stop])
                times = Counter(left[begin:end]) if end > begin else {}
                words_left += times.keys()
                times_left += times.values()
                ends.append(len(words_left))
                start, begin = stop, end
            pairs = pa.StructArray.from_arrays([pa.array(words_left, pa.binary()).cast(pa.string()), pa.array(times_left, pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": chunk.column("doc_id"), "learn": chunk.column("learn"), "codes": pa.array(blobs, pa.binary()), "rest": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
            })

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", "learn").mapInArrow(run, f"doc_id {id_type}, learn boolean, codes binary, rest array<struct<word:string,times:long>>")
    # written once, so that the number of a row stays the same
    return written(out.withColumn("row", F.monotonically_increasing_id()), "codes")[0]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(some rows of ``encoded``, an end and then all their codes)."""
    for chunk in text_chunks(batches, "codes"):
        yield chunk, np.frombuffer(b"".join((bytes(4), *chunk.column("codes").to_pylist())), np.int32)


def symbol_bigrams(docs: DataFrame, head: list[bytes]) -> np.ndarray:
    """Counts of symbol after symbol in ``encoded`` texts: 0 the end (also before each text), then ``head``, then all other words as one. Each task sends its non-zero cells, at most the number of symbols squared, as does the sum."""
    size = len(head) + 2
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * size, np.int64)
        for _, row in _rows(batches):
            symbols = np.minimum(row, size - 1).astype(np.int64)
            at, n = np.unique(symbols[:-1] * size + symbols[1:], return_counts=True)
            cells[at] += n
        at = np.flatnonzero(cells)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(at[k:k + 50_000], pa.int32()), "n": pa.array(cells[at[k:k + 50_000]], pa.int64())})

    found = docs.select("codes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


# ---------------------------------------------------------------- classes

@dataclass
class Classes:
    """Of all words: those of swept words by themselves, those of all others by slot."""

    n: int
    known: dict[bytes, int]
    slots: np.ndarray

    def of_codes(self, codes: Codes) -> np.ndarray:
        """The class of the word of every code."""
        out = self.slots[codes.own_slots()]
        out[:1 + codes.swept] = [self.known[w] for w in islice(codes.ids, 1 + codes.swept)]
        return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(x + 1e-300)  # 0 for 0; counts are 0 or 1 and more


def likelihood(bigrams: np.ndarray, classes: np.ndarray, n: int) -> float:
    """Of class bigrams given class frequencies; the part of the training likelihood that depends on the classes."""
    g = _grouped(bigrams, classes, n)
    return float(_xlogx(g).sum() - _xlogx(g.sum(axis=1)).sum() - _xlogx(g.sum(axis=0)).sum())


def _grouped(bigrams: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    one = np.zeros((len(classes), n))
    one[np.arange(len(classes)), classes] = 1
    return one.T @ bigrams @ one


def exchange_classes(bigrams: np.ndarray, n: int = CLASSES, sweeps: int = 30) -> np.ndarray:
    """Classes of symbols, below ``n``. Symbol 0 (the end) is alone in class 0 and the last symbol (all words that are none) in class ``n``; the others, by frequency, start in turn in the classes left."""
    count, last = len(bigrams), n
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = 1 + np.argsort(-weight[1:-1], kind="stable")
    classes = np.zeros(count, np.int64)
    classes[order] = 1 + np.arange(len(order)) % (n - 1)
    classes[-1] = last
    n += 1
    g = _grouped(bigrams, classes, n)
    columns, d = np.ascontiguousarray(bigrams.T), np.arange(n)
    for _ in range(sweeps):
        moved = 0
        for s in order:
            if not weight[s]:
                continue
            k = classes[s]
            own = bigrams[s, s]
            out, into = np.bincount(classes, bigrams[s], n), np.bincount(classes, columns[s], n)
            out[k] -= own
            into[k] -= own
            g[k] -= out
            g[:, k] -= into
            g[k, k] -= own
            left, right = g.sum(axis=1) + into, g.sum(axis=0) + out  # without the symbol's own row and column, which go to one class
            now, after, before = _xlogx(g), _xlogx(g + out), _xlogx(g + into[:, None])
            gain = (after - now).sum(axis=1) + (before - now).sum(axis=0)
            # the cell of a class with itself changes by both
            gain += _xlogx(g[d, d] + out + into + own) - after[d, d] - before[d, d] + now[d, d]
            gain -= _xlogx(left + out.sum() + own) - _xlogx(left) + _xlogx(right + into.sum() + own) - _xlogx(right)
            gain[[0, last]] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9 * abs(gain[k]):
                best = k
            moved += best != k
            classes[s] = best
            g[best] += out
            g[:, best] += into
            g[best, best] += own
        if not moved:
            break
    return classes


def gains(grams: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The gain in likelihood, to first order, of a word that joins each class: rows of words, columns of classes.

    grams: class bigrams. before, after: how often the word stands before, and after, words of each class.
    """
    g = grams + 0.5
    pointwise = np.log(g) - np.log(g.sum(axis=1, keepdims=True)) - np.log(g.sum(axis=0, keepdims=True))
    return before @ pointwise.T + after @ pointwise


def slot_classes(docs: DataFrame, codes: Codes, swept: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """The class of every slot, -1 for those without training tokens, of ``encoded`` texts. ``swept``: classes of the end and the swept words, below ``n``; ``grams``: bigrams of the ``n`` classes and of the one of all other words."""
    spark, slots, wide = docs.sparkSession, codes.slots, 2 * n + 2
    span = -(-slots // RANGES)  # slots of a range
    shared = spark.sparkContext.broadcast((codes, np.append(swept, n), grams))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, keys): of a range of slots, a key for each word beside one of its own: slot * wide + c before a word of class c, that + n + 1 after one; n is the class of words that have none yet. Keys are sorted, and their bytes put in four rows, which packs well."""
        own, first, _ = shared.value
        slot_of, held, size = own.own_slots(), [], 0

        def cells() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            cuts = np.searchsorted(keys, np.arange(RANGES + 1) * span * wide)
            parts = np.flatnonzero(np.diff(cuts))
            rows = [(keys[cuts[p]:cuts[p + 1]] - p * span * wide).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts]
            return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "keys": pa.array(rows, pa.binary())})

        for _, row in _rows(batches):
            classes, new = first[np.minimum(row, own.swept + 1)], np.flatnonzero(row > own.swept)
            slot = slot_of[row[new]].astype(np.int64) * wide
            held += [slot + classes[new + 1], slot + n + 1 + classes[new - 1]]
            size += 2 * len(new)
            if size > HELD_CELLS:
                yield cells()
                held, size = [], 0
        if size:
            yield cells()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by part, the classes of the slots of each. The counts of one range are held, and keys up to a bound."""
        g = shared.value[2]
        part, held, size, counts = -1, [], 0, np.zeros(span * wide, np.int64)

        def added() -> None:
            nonlocal held, size
            if size:
                np.add(counts, np.bincount(np.concatenate(held), minlength=len(counts)), out=counts)
            held, size = [], 0

        def whole() -> pa.RecordBatch:
            both, best = counts.reshape(-1, wide), np.full(span, -1, np.int16)
            for k in range(0, span, 8192):
                some = k + np.flatnonzero(both[k:k + 8192].any(axis=1))
                gain = gains(g, both[some, :n + 1], both[some, n + 1:])
                best[some] = 1 + np.argmax(np.round(gain[:, 1:n], 9), axis=1)  # of classes that are alike the first
            counts[:] = 0
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cls": pa.array([best.tobytes()], pa.binary())})

        for batch in batches:
            for p, keys in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist()):
                if p != part:
                    added()
                    if part >= 0:
                        yield whole()
                    part = p
                held.append(np.frombuffer(keys, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel())
                size += len(held[-1])
                if size > HELD_CELLS:
                    added()
        added()
        if part >= 0:
            yield whole()

    small_batches(spark)
    cells = docs.select("codes").mapInArrow(beside, "part int, keys binary").repartition(RANGES, "part").sortWithinPartitions("part")
    found = cells.mapInArrow(assign, "part int, cls binary").toArrow()  # two bytes a slot
    out = np.full(RANGES * span, -1, np.int16)
    for p, cls in zip(found.column("part").to_pylist(), found.column("cls").to_pylist()):
        out[p * span:(p + 1) * span] = np.frombuffer(cls, np.int16)
    return out[:slots]


def class_bigrams(docs: DataFrame, codes: Codes, classes: Classes) -> np.ndarray:
    """Counts of class after class over all tokens of ``encoded`` texts; each task sends its sums, of the number of classes squared."""
    spark, n = docs.sparkSession, classes.n
    small_batches(spark)
    shared = spark.sparkContext.broadcast(classes.of_codes(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, cells = shared.value, np.zeros(n * n, np.int64)
        for _, row in _rows(batches):
            at = class_of[row].astype(np.int64)
            cells += np.bincount(at[:-1] * n + at[1:], minlength=n * n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(n * n), pa.int32()), "n": pa.array(cells)})

    found = docs.select("codes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n, n)


def class_sizes(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, tokens) of each class, of ``counts`` (word, n)."""
    shared = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, tokens = shared.value, np.zeros(classes.n), np.zeros(classes.n)
        get, first, slots = own.known.get, own.n + 1, len(own.slots)
        for batch in batches:
            names = [w.encode() for w in batch.column("word").to_pylist()]
            code = np.fromiter((first + crc32(w) % slots if (k := get(w)) is None else k for w in names), np.int64, len(names))
            cls = np.where(code < first, code, own.slots[np.maximum(code - first, 0)])
            words += np.bincount(cls, minlength=classes.n)
            tokens += np.bincount(cls, batch.column("n").to_numpy(), classes.n)
        yield pa.RecordBatch.from_pydict({"cls": pa.array(np.arange(classes.n), pa.int32()), "v": pa.array(words), "n": pa.array(tokens)})

    found = counts.select("word", "n").mapInArrow(run, "cls int, v double, n double").groupBy("cls").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, classes.n))
    for row, c in zip(out, ("v", "n")):
        row[found.column("cls").to_numpy()] = found.column(c).to_numpy()
    return out[0], out[1]


# ---------------------------------------------------------------- model

@dataclass
class Model:
    """The arrays are of a fixed size."""

    known: np.ndarray  # log10 of a count and one, by code of the end and of the known words; 0 for all other words
    end: bool  # whether training texts have an end
    classes: np.ndarray  # by code
    transition: np.ndarray  # log10 P(class | class before)
    unseen: np.ndarray  # log10 of an emission's denominator by class
    train_tokens: int
    vocabulary: int


def is_frequent(counts: DataFrame, most: int) -> Column:
    """A condition on (word, n) that holds for the most frequent words, about ``most`` of them and never more but for chance.

    An ordered limit would send that many rows of every partition to the driver. Instead words are counted by steps of their frequency (sixteen
    to a doubling, so a bounded number). The upper steps that hold ``most`` words together at most are taken whole, and of the next one those of low hash, as many as there is room for.
    """
    step, top = F.floor(F.log2("n") * 16).cast("int"), (1 << 63) - 1
    sizes = {r["step"]: r["v"] for r in counts.filter(F.col("word") != END).groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect()}
    least, total, cut = 1 << 30, 0, 0
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > most:
            cut = int(top * 0.97 * (most - total) / sizes[k])
            break
        least, total = k, total + sizes[k]
    low = F.xxhash64("word").bitwiseAND(F.lit(top)) < F.lit(cut)
    return (F.col("word") != END) & ((step >= least) | ((step == max((k for k in sizes if k < least), default=-1)) & low))


def fit(src: DataFrame, n: int = CLASSES) -> tuple[Model, DataFrame, DataFrame]:
    """(model, encoded texts, counts) of texts (doc_id, text, learn), of those that ``learn``; counts: word, n."""
    counts, _ = written(word_counts(src.filter("learn")), "word-counts")
    found = counts.filter(is_frequent(counts, KNOWN_WORDS) | (F.col("word") == END)).toArrow()
    known = dict(zip((w.encode() for w in found.column("word").to_pylist()), found.column("n").to_pylist()))
    top = counts.filter(is_frequent(counts, SWEPT)).collect()
    known |= {r["word"].encode(): r["n"] for r in top}
    head = [r["word"].encode() for r in sorted(top, key=lambda r: (-r["n"], r["word"].encode()))]
    codes = Codes.of_words(head, sorted(known), SLOTS)
    texts = encoded(src, codes)
    train = texts.filter("learn")
    bigrams = symbol_bigrams(train, head)
    by_symbol = exchange_classes(bigrams, n)
    swept = {b"": 0} | {w: int(by_symbol[k + 1]) for k, w in enumerate(head)}
    slots = slot_classes(train, codes, by_symbol[:1 + len(head)], _grouped(bigrams, by_symbol, n + 1), n)
    usual = int(np.bincount(slots[slots >= 0], minlength=2).argmax()) if (slots >= 0).any() else 1
    classes = Classes(n, swept, np.where(slots < 0, usual, slots).astype(np.int16))
    v, c = class_sizes(counts, classes)
    g = class_bigrams(train, codes, classes)
    row = g.sum(axis=1, keepdims=True)
    frequency = (c + 1 / n) / (c.sum() + 1)
    mixed = MIX[1] * frequency[None, :] + MIX[2] / n
    p = np.where(row > 0, MIX[0] * g / np.maximum(row, 1) + mixed, mixed / (MIX[1] + MIX[2]))
    logs = np.log10([known.get(w, 0) + 1 for w in codes.ids] + [1])
    return Model(logs, known.get(b"", 0) > 0, classes.of_codes(codes), np.log10(p), np.log10(c + v + 1), int(c.sum()), int(v.sum())), texts, counts


def text_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from the rows for which ``learn`` (on column doc_id) holds.

    base_score: the sum over tokens of log10((c + 1) / (N + V + 1)), c the token's count, N all, V distinct training tokens. score: log10 of the model's probability.
    Null texts count as empty: their only token is the end. Null and repeated ids stay as they are, and each row is scored on its own. If nothing
    can be learned from, N = V = 0. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    src = texts_of(docs, id_col, text_col)
    model, texts, counts = fit(src.withColumn("learn", F.coalesce(learn, F.lit(False))), classes)
    shared = spark.sparkContext.broadcast(model)
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        other = len(m.known) - 1
        for chunk, row in _rows(batches):
            lengths = pc.binary_length(chunk.column("codes")).to_numpy().astype(np.int64) // 4
            starts, after, cls = np.cumsum(lengths) - lengths, np.minimum(row[1:], other), m.classes[row]  # every text has a token
            known = np.add.reduceat((after < other).astype(np.int64), starts) - (not m.end)
            classed = m.transition[cls[:-1], cls[1:]] - m.unseen[cls[1:]]
            yield pa.RecordBatch.from_pydict({
                "row": chunk.column("row"), "doc_id": chunk.column("doc_id"), "n_tokens": pa.array(lengths), "n_known": pa.array(known),
                "counted": pa.array(np.add.reduceat(m.known[after], starts)), "classed": pa.array(np.add.reduceat(classed, starts)),
            })

    own = texts.select("row", "doc_id", "codes").mapInArrow(run, f"row long, doc_id {id_type}, n_tokens long, n_known long, counted double, classed double")
    rest = texts.select("row", F.inline("rest")).join(counts, "word")
    found = rest.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1) * F.col("times")).alias("rest_counted"), F.sum("times").alias("rest_known"))
    both = own.join(found, "row", "left")
    total = F.col("counted") + F.coalesce("rest_counted", F.lit(0.0))
    return both.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * float(np.log10(model.train_tokens + model.vocabulary + 1))).alias("base_score"), (total + F.col("classed")).alias("score"),
    )
