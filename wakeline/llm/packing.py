"""Packing token sequences by best-two-fit.

A document is its token ids and an end id. Documents longer than a sequence are cut into pieces of a whole
sequence, and a shorter last one; nothing else is cut. Pieces are packed by length: a sequence takes the
longest piece left, then the longest that still fits, until none fits; then its smallest piece is exchanged for
the two unpacked pieces that fill the gap and its place most tightly, if they fill it better.

Which pieces of one length are taken makes no difference to a packing, so it is planned on the number of
pieces of each length: at most one count per length of a sequence, whatever the size of the table. Equal
sequences are planned together as a pattern with a number of repeats. Patterns are few: each ends with some
length that has too few pieces left. The plan is a list of runs, "pieces i to j of this length go to
sequences s, s + 1, ... at this offset".

Each task numbers its own pieces by length while it encodes them; the numbers of the tasks before it, joined by
(task, length), make them places among all pieces, and a binary search in the broadcast runs gives sequence and
offset. Pieces are written once before that, so places agree when a task is lost.

Words are encoded once and kept in a bounded cache: the vocabulary splits texts at white space before
anything else, so a text's ids are those of its words in a row. Strings of special tokens are ordinary text.

Null and empty texts are a piece of the end id alone. Rows that repeat a doc_id, and rows without one, are packed
each for itself. An empty table gives no rows. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import table, utf8
from wakeline.sources.scratch import new_path

CAPACITY, END = 4096, 1
#: Words longer than this, in bytes, are not kept; the cache starts anew when it has so many words.
WORD_BYTES, CACHE_WORDS = 64, 800_000
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("ids", pa.binary()),
        ("task", pa.int32()),
        ("number", pa.int64()),
    ]
)
PIECE_TYPE = "doc_id long, piece int, start long, length int, ids binary, task int, number long"


#: A word of Latin letters, perhaps with ASCII punctuation but the apostrophe after it, which is one more unit.
#: Normalising only lowers these letters, one by one.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: First bytes of U+0300 to U+036F, the marks that letters are composed with.
MARKS = (b"\xcc", b"\xcd")
#: Byte-level vocabularies write printable bytes as themselves and the others as U+0100 and on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


class WordIds(dict):
    """Ids of each word as little-endian unsigned 32-bit integers, kept until the cache is full."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.units = self.tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(text)
        if plain and plain[2]:
            ids = self[plain[1].encode()] + self[plain[2].encode()]
        elif plain:
            lower = text.lower()
            units = self.units(lower if lower.isascii() else lower.encode().decode("latin-1").translate(BYTE_LETTERS))
            ids = array("I", [unit.id for unit in units]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a text. Lowering A-Z first is safe unless a combining mark could join a letter."""
        if not text:
            return b""
        if not any(mark in text for mark in MARKS):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


def _largest_up_to(left: np.ndarray) -> np.ndarray:
    """For each length, the largest length not above it that has pieces left, or 0."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def fill_one(left: np.ndarray) -> tuple[Counter, int]:
    """The next sequence from `left` pieces of each length: its pieces, and how often it repeats exactly."""
    capacity = len(left) - 1
    gap, held = capacity, Counter()
    reach = _largest_up_to(left)
    length = int(reach[gap])
    while length:
        n = min(int(left[length]), gap // length)
        held[length] += n
        gap -= n * length
        # what is taken so far has all pieces of its lengths, or fills the gap below one of them
        length = int(reach[min(gap, length - 1)])
    used = held.copy()
    smallest = min(held)
    unpacked = left.copy()
    for length, n in held.items():
        unpacked[length] -= n
    room = gap + smallest
    reach = _largest_up_to(unpacked)
    first = np.flatnonzero(unpacked[: room // 2 + 1])
    if len(first):
        second = reach[room - first]
        # a pair of equal pieces needs two of them; one below is the next best
        short = (second == first) & (unpacked[first] < 2)
        second = np.where(short, 0, second)
        filled = np.where(second > 0, first + second, 0)
        best = int(np.argmax(filled))
        if filled[best] > smallest:
            held[smallest] -= 1
            for length in (int(first[best]), int(second[best])):
                held[length] += 1
                used[length] += 1
    held = +held
    repeats = min((int(left[length]) - used[length]) // n + 1 for length, n in held.items())
    return held, repeats


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Runs (length, first number, repeats of the pattern, first sequence, copies in it, offset), sequences.

    `counts[n]` is the number of pieces of length n. Of a length that a pattern has c times, piece number
    first + i goes to sequence first sequence + i div c, at offset + (i mod c) * length.
    """
    left = np.array(counts, np.int64)
    left[0] = 0
    taken, runs, sequence = np.zeros(len(left), np.int64), [], 0
    while left.any():
        held, repeats = fill_one(left)
        offset = 0
        for length in sorted(held, reverse=True):
            n = held[length]
            runs.append((length, taken[length], repeats, sequence, n, offset))
            offset += n * length
            taken[length] += n * repeats
            left[length] -= n * repeats
        sequence += repeats
    return np.array(sorted(runs), np.int64).reshape(-1, 6), sequence


def cut(docs: DataFrame, vocabulary: str, capacity: int, end: int) -> DataFrame:
    """Pieces with their ids, numbered by length within the task that made them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = WordIds(shared.value), TaskContext.get().partitionId()
        numbers, rows, size = Counter(), [], 0

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)], schema=PIECES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
                ids = encoder.encode(text) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((doc_id, piece, at // 4, length, part, task, numbers[length]))
                    numbers[length] += 1
                    size += len(part)
                if size >= 16_000_000 or len(rows) >= 10_000:
                    yield send()
                    rows, size = [], 0
        if rows:
            yield send()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_TYPE)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece with its ids and its place.

    `vocabulary` is the text of a tokenizer file; `ids` holds little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    path = new_path(spark, "pieces")
    cut(docs, vocabulary, capacity, end).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(PIECE_TYPE).parquet(path)
    of_tasks = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in of_tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        counts[row["length"]] = row["n"]
    runs, _ = plan(counts)
    shared = spark.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        known = shared.value
        size, at = length.to_numpy(np.int64), number.to_numpy(np.int64)
        bits = 48  # numbers of pieces of one length stay below 2^48
        run = known[np.searchsorted((known[:, 0] << bits) + known[:, 1], (size << bits) + at, side="right") - 1]
        i = at - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + i // run[:, 4], "offset": run[:, 5] + i % run[:, 4] * size})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_tasks.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = pieces.join(offsets, ["task", "length"]).withColumn("_place", place("length", F.col("_before") + F.col("number")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences; a group is at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))


def op11_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return pack(table(spark, sf_dir, "documents"), vocabulary).select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )
