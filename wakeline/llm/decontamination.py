"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII letters (lower-cased), digits and characters from U+0080 on. A window is 13
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit. A document is contaminated if at least `share` of its words
are hit.

A shard is what a task has read until its retained text reaches `SHARD_WORDS`. Only maximal runs of
words that occur in the benchmark, at least as long as its shortest window, can hold a window, so only
these are indexed: nothing else can match. All windows are searched at once, backwards, by wavelet-tree
ranks; occurrences are located from sampled suffix positions and merged to spans.

The benchmark is the stated query set. It is sent to the tasks in blocks of about `BLOCK_CHARS` characters,
dealt by a hash of item and text without repeated rows, one scan per block, so what is broadcast stays bounded
unless a single text is longer. With several blocks the documents are
numbered and written once, and the hits of all scans meet by that number.

Null text has no words; such documents, and items, take part in nothing (n_hit 0, not contaminated).
Texts with a null item_id are one item, a null that stands last in `items`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import slices, table, utf8
from wakeline.llm.fm_index import FMIndex
from wakeline.sources.scratch import materialize

WINDOW = 13
SHARE = 0.05
SHARD_WORDS, SHARD_DOCS = 500_000, 20_000
BLOCK_CHARS = 3_200_000
#: ASCII bytes outside 0-9 and letters become spaces, A-Z become a-z, other bytes stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(SPAN)),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Phrases:
    """Windows of a block of items: word numbers from 2, windows by length, items of each window."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.words: dict[bytes, int] = {}
        self.items: list[set[str | None]] = []
        known: dict[tuple[int, ...], int] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in words_of((text or "").encode())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                key = tuple(ids[i : i + window])
                if known.setdefault(key, len(self.items)) == len(self.items):
                    self.items.append(set())
                self.items[known[key]].add(item)
        self.lengths = sorted({len(k) for k in known})
        self.by_length = {
            n: (np.array([k for k in known if len(k) == n], np.int64), np.array([v for k, v in known.items() if len(k) == n]))
            for n in self.lengths
        }


class Shard:
    """Documents of a task: retained runs with the document and word that each symbol comes from."""

    def __init__(self, phrases: SimpleNamespace) -> None:
        self.phrases, self.ids, self.rows_of, self.n_words, self.size = phrases, [], [], [], 0
        self.symbols: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, doc_id: int | None, row: int, text: bytes | None) -> None:
        words = words_of(text)
        known = self.phrases.words.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        if self.phrases.lengths:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
            for a, b in edge.reshape(-1, 2):
                if b - a >= self.phrases.lengths[0]:
                    self.symbols.append(np.append(ids[a:b], 1))
                    self.docs.append(np.full(b - a + 1, len(self.ids), np.int64))
                    self.places.append(np.arange(a, b + 1))
                    self.size += b - a + 1
        self.ids.append(doc_id)
        self.rows_of.append(row)
        self.n_words.append(len(words))

    def rows(self) -> pa.RecordBatch:
        spans: list[list] = [[] for _ in self.ids]
        items: list[set] = [set() for _ in self.ids]
        if self.symbols:
            text = np.append(np.concatenate(self.symbols), 0)
            docs, places = np.concatenate(self.docs), np.concatenate(self.places)
            index = FMIndex(text)
            cover = np.zeros(len(text) + 1, np.int64)
            for length in self.phrases.lengths:
                phrases, numbers = self.phrases.by_length[length]
                low, high = index.search(phrases)
                n = high - low
                total = int(n.sum())
                at = index.locate(np.repeat(low, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                for d, w in np.unique(np.stack((docs[at], np.repeat(numbers, n))), axis=1).T if total else ():
                    items[d] |= self.phrases.items[w]
            # a passage's end symbol is never covered, so spans stay within their passage
            edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover)[:-1] > 0, [0])).astype(np.int8)))
            for a, b in edge.reshape(-1, 2):
                spans[docs[a]].append({"start": int(places[a]), "end": int(places[b - 1]) + 1})
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids, pa.int64()),
                pa.array(self.rows_of, pa.int64()),
                pa.array(self.n_words, pa.int64()),
                pa.array(spans, pa.list_(SPAN)),
                pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string())),
            ],
            schema=ROWS,
        )


def _scan(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    # plain values: what is broadcast must load where this package isn't installed
    tables = docs.sparkSession.sparkContext.broadcast(vars(Phrases(items, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = SimpleNamespace(**tables.value)
        shard = Shard(phrases)
        for batch in (part for batch in batches for part in slices(batch)):
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch, "text")):
                shard.add(doc_id, row, text)
                if shard.size >= SHARD_WORDS or len(shard.ids) >= SHARD_DOCS:
                    yield shard.rows()
                    shard = Shard(phrases)
        if shard.ids:
            yield shard.rows()

    schema = "doc_id long, row long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, spans, items, n_hit, contaminated) for each document row.

    `spans` are merged half-open ranges of word numbers to remove; `items` the items with occurring windows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    if blocks > 1:
        slim = materialize(slim, "numbered-documents")  # each scan must see the same numbers
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    scans = [_scan(slim, [tuple(r) for r in bench.where(part == b).collect()], window) for b in range(blocks)]
    found = scans[0]
    if blocks > 1:
        # the same rows from each scan: hits of all blocks meet by row, as ids may be null or repeated
        every = reduce(DataFrame.unionByName, scans).groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
        merge = F.aggregate(
            "spans",
            F.lit(None).cast("array<struct<start:long,end:long>>"),
            lambda acc, s: F.when(acc.isNull(), F.array(s))
            .when(
                F.element_at(acc, -1)["end"] >= s["start"],
                F.concat(
                    F.slice(acc, 1, F.size(acc) - 1),
                    F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
                ),
            )
            .otherwise(F.concat(acc, F.array(s))),
        )
        found = every.withColumn("spans", F.coalesce(merge, F.array().cast("array<struct<start:long,end:long>>")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.drop("row").withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(1 / share) >= F.col("n_words"))
    )


def op4_decontamination(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(i)
), hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
