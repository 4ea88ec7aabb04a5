"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A word, a run of characters other than ASCII white space, has a core (lower-cased letters, digits and
non-ASCII characters) and a shape (case of the core, kinds of punctuation around it, and whether the core
repeats the one before). Features are core 1- and 2-grams and shape 1-, 2- and 3-grams, hashed to
`DIMENSIONS` weights; values are log(1 + count), scaled to length 1. A score is a sparse dot product.

Training takes labelled rows that are not held out, at most `TRAIN_ROWS` of them in the order of a hash of
doc_id (a documented bound on the sample), in `TRAINERS` shards; the shards' weights are averaged. Scoring
reads every text as a whole.

Null text counts as empty: it has no features and gets the bias alone. Null labels are skipped; of several
labels of one doc_id the mean decides. Without any label every score is 0.5. A null doc_id is not held out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import CACHE_WORDS, crc_mod, grams, mix, slices, small_batches, table, utf8

DIMENSIONS = 1 << 18
TRAIN_ROWS, TRAINERS = 16_000, 4
#: A shard takes about so many steps, in 3 to 40 passes.
STEPS = 12_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0, 0.02
HELD_OUT = (3, 1)
#: Features of a core, and of a shape, by n-gram length.
CORE_GRAMS, SHAPE_GRAMS = (1, 2), (1, 2, 3)
CORE_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())


def word_parts(word: bytes) -> tuple[int, int]:
    """Hashes of a word's core and of its shape."""
    core = word.strip(PUNCTUATION)
    case = b"-" if not core else b"0" if core.isdigit() else b"U" if core.isupper() and len(core) > 1 else b"C" if core[:1].isupper() else b"l"
    around = bytes(sorted(set(word.translate(None, core)) & set(PUNCTUATION))) if len(core) < len(word) else b""
    return xxhash.xxh3_64_intdigest(core.translate(CORE_BYTES)), xxhash.xxh3_64_intdigest(case + around, seed=1)


class WordParts(dict):
    """Place of each word in `hashes`, which holds the two of each word one after the other."""

    def __init__(self) -> None:
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.hashes.extend(word_parts(word))
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        """Core and shape of each word; the cache starts anew between texts."""
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.hashes = array("Q")
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)[places]


def counted(text: bytes | None, parts: WordParts) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of a text and how often each is met."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    both = parts.of(words)
    core, shape = both[:, 0], both[:, 1].copy()
    shape[1:][core[1:] == core[:-1]] ^= np.uint64(0x9E3779B97F4A7C15)
    found = [mix(grams(core, n) + np.uint64(n)) for n in CORE_GRAMS] + [mix(grams(shape, n) + np.uint64(16 + n)) for n in SHAPE_GRAMS]
    index, counts = np.unique(np.concatenate(found) % np.uint64(DIMENSIONS), return_counts=True)
    return index.astype(np.int32), counts.astype(np.int32)


def weighed(counts: np.ndarray) -> np.ndarray:
    values = np.log1p(counts.astype(np.float64))
    return values / np.sqrt((values * values).sum())


def features(text: bytes | None, parts: WordParts) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers and values of a text."""
    index, counts = counted(text, parts)
    return index, weighed(counts)


class Samples(list):
    """(index, counts, label) of each text, weighed whenever they are read: half the memory of their values."""

    def __iter__(self):
        return ((index, weighed(counts), label) for index, counts, label in super().__iter__())


def follow_leader(samples: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights, the bias last, after passes of FTRL-proximal over the samples."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(min(40, max(3, STEPS // max(1, len(samples))))):
        for index, values, label in samples:
            i, x = np.append(index, DIMENSIONS), np.append(values, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(DIMENSIONS + 1))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, trainers: int = TRAINERS) -> np.ndarray:
    """Averaged weights of the shards: one array of fixed size."""
    part, mod = F.crc32(F.col("doc_id").cast("string").cast("binary")), HELD_OUT[0]
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .where(part % mod != HELD_OUT[1])
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select(F.col("doc_id").alias("_labelled"), "label")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = WordParts()
        seen: dict[int, list] = {}
        for part in (part for batch in batches for part in slices(batch)):
            index, counts = zip(*(counted(text, parts) for text in utf8(part, "text")))
            # a few large arrays are given back when the shard is done; many small ones stay with the worker
            cuts = np.cumsum([len(i) for i in index])[:-1]
            texts = zip(np.split(np.concatenate(index), cuts), np.split(np.concatenate(counts), cuts))
            for shard, doc_id, label, text in zip(*(part.column(k).to_pylist() for k in range(3)), texts):
                seen.setdefault(shard, []).append((doc_id, label, *text))
        for shard, found in seen.items():
            # an order that depends on nothing but the rows
            found.sort(key=lambda s: (xxhash.xxh3_64_intdigest(str(s[0])), len(s[2])))
            weights = follow_leader(Samples((i, n, label) for _, label, i, n in found))
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "rows": [len(found)], "weights": [weights.astype(np.float32).tobytes()]},
                schema=pa.schema([("shard", pa.int32()), ("rows", pa.int64()), ("weights", pa.binary())]),
            )

    shard = (F.pmod(F.xxhash64("doc_id"), F.lit(trainers))).cast("int").alias("shard")
    with small_batches(docs.sparkSession):
        models = (
            texts.select(shard, "doc_id", "label", "text")
            .repartition(trainers, "shard")
            .mapInArrow(fit, "shard int, rows long, weights binary")
            .collect()
        )
    total = sum(m["rows"] for m in models)
    out = np.zeros(DIMENSIONS + 1, np.float32)
    for m in sorted(models, key=lambda m: m["shard"]):
        out += np.frombuffer(m["weights"], np.float32) * np.float32(m["rows"] / total)
    return out


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function: quality score of a text."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    parts = WordParts()

    # On Arrow arrays: one text at a time is a Python object.
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w = model.value
        out = np.full(len(texts), float(w[-1]))
        for k, text in enumerate(texts.cast(pa.binary())):
            if text := text.as_py():
                index, values = features(text, parts)
                out[k] += w[index] @ values
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, into: str = "_score") -> DataFrame:
    """`docs` with the score of each text."""
    return docs.withColumn(into, scorer(docs, train(docs, labels))(F.col("text")))


def held_out() -> Column:
    return crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]


def op5_quality_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
