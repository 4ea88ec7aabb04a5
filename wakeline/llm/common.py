"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word caches may hold before they start anew.
CACHE_WORDS = 100_000
#: Bytes of a batch that are turned into Python objects at once.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to a worker, in passes that ask for small ones.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Passes run meanwhile hand about `BATCH_BYTES` at a time to a worker, all rows after one another.

    By default a batch has up to 64 MiB; Spark's copy of it is outside its heap, the worker has another.
    """
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo a number; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as bytes: splitting and stripping bytes knows ASCII white space only."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, without a cache: faster and smaller where texts hold many rare words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class WordHashes(dict):
    """64-bit hash of each word, kept while the worker lives or until the cache of `limit` words is full."""

    limit = CACHE_WORDS

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(words: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of n words, by doubling: log n passes over the array."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out, have, piece, span, power = None, 0, words, 1, base
    while True:
        if n & span:
            if out is None:
                out, have = piece, span
            else:
                # what is there so far covers the first `have` words, this piece the next `span`
                m = min(len(out), len(piece) - have)
                out = out[:m] * np.uint64(power) + piece[have : have + m]
                have += span
        if have == n:
            return mix(out[:size])
        piece = piece[:-span] * np.uint64(power) + piece[span:]
        power = power * power % (1 << 64)
        span *= 2


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def by_batch(schema: pa.Schema, rows: Callable[[pa.RecordBatch], list]) -> Callable:
    """A mapInArrow function that turns each batch into columns of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = rows(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)],
                    schema=schema,
                )

    return run


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about `SLICE_BYTES`, without a copy: a worker's memory follows the part."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def by_slice(schema: pa.Schema, rows: Callable[[pa.RecordBatch], list]) -> Callable:
    """As by_batch, a slice at a time: for functions that don't sum up over a batch."""
    run = by_batch(schema, rows)
    return lambda batches: run(part for batch in batches for part in slices(batch))
