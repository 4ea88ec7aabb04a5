"""Ranked lexical search the other way round: the queries are indexed, the documents stream through.

Terms are runs of ASCII letters (A-Z lower-cased), digits and characters from U+0080 on. The items' terms
form an inverted index, which is broadcast. A first scan counts documents, terms and, for indexed terms,
documents that hold them. A second scan streams each document's term counts through the index; a task keeps
a heap of the `top` best documents of each item. The heaps of all tasks are merged in two levels.

A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))). A document of n terms has
m = 100 - 75 + (75 * n * N) div L, and its score for an item is the sum, over the item's terms with repeats,
of w * ((10^9 * tf) div (1000 * tf + 8m)).

The items are the stated query set. They are sent in blocks of about `BLOCK_CHARS` characters, two scans per
block, so an index stays bounded unless one item's text is longer. A heap holds `top` documents an item,
whatever the number of documents.

Every document row is a document: rows that repeat a doc_id rank each for itself. Equal scores rank by
ascending doc_id, null last. Texts with one item_id, a null among them, are one item with the terms of all
these texts. Null and empty texts have no terms: such documents count nowhere, such items have no rows, and
an empty table of either kind gives none. Text of any length is read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import table, utf8
from wakeline.llm.decontamination import words_of

TOP = 10
BLOCK_CHARS = 2_000_000
#: Cells of the score table of a step: documents times items of the block.
STEP_CELLS = 2_000_000
#: Heaps of a block are merged in this many groups of tasks, then across groups.
MERGE_GROUPS = 64
COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
HEAPS = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
#: Rows of the first scan that are not terms.
DOCUMENTS, LENGTH = -1, -2


def inverted_index(items: list[tuple[str | None, str]]) -> tuple[list[str | None], dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Item ids, number of each term, and its postings: start per term, items, repeats in the item."""
    counts: dict[str | None, Counter] = {}
    for item, text in items:
        counts.setdefault(item, Counter()).update(words_of(text.encode()))
    ids = sorted(counts, key=lambda i: (i is None, i or ""))
    terms: dict[bytes, int] = {}
    postings = sorted((terms.setdefault(t, len(terms)), i, n) for i, item in enumerate(ids) for t, n in counts[item].items())
    held = np.array(postings, np.int64).reshape(-1, 3)
    return ids, terms, np.searchsorted(held[:, 0], np.arange(len(terms) + 1)), held[:, 1], held[:, 2]


def _term_counts(text: bytes | None, terms: dict[bytes, int]) -> tuple[int, list[tuple[int, int]]]:
    """Number of terms of a text, and (term number, occurrences) of those in the index."""
    counts = Counter(words_of(text))
    return counts.total(), [(terms[t], counts[t]) for t in counts.keys() & terms.keys()]


def collection_counts(docs: DataFrame, terms: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each indexed term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        held, documents, length = np.zeros(len(index), np.int64), 0, 0
        for batch in batches:
            for text in utf8(batch, "text"):
                n, found = _term_counts(text, index)
                documents, length = documents + (n > 0), length + n
                held[[t for t, _ in found]] += 1
        some = np.flatnonzero(held)
        names, values = np.append(some, [DOCUMENTS, LENGTH]), np.append(held[some], [documents, length])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values)], schema=COUNTS)

    # one row per term of the block reaches the driver
    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in sums}
    df = np.array([found.get(t, 0) for t in range(len(terms))], np.int64)
    return found.get(DOCUMENTS, 0), found.get(LENGTH, 0), df


def best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` best rows of each item; the last row of `doc` says whether the id is null."""
    order = np.lexsort((doc[0], doc[1], -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < top]


def _search_block(docs: DataFrame, items: list[tuple[str | None, str]], top: int) -> DataFrame:
    ids, terms, starts, posted, repeats = inverted_index(items)
    n_docs, length, df = collection_counts(docs, terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((terms, starts, posted, repeats, weights))
    n_items = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, start, owner, times, weight = shared.value
        heap_item, heap_score = np.empty(0, np.int64), np.empty(0, np.int64)
        heap_doc = np.empty((2, 0), np.int64)
        least = np.zeros(n_items, np.int64)  # score of the last of a full heap
        step = max(1, STEP_CELLS // max(1, n_items))
        for batch in batches:
            doc_ids = batch.column(0)
            ids_of = np.stack((doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False)))
            texts = utf8(batch, "text")
            for at in range(0, len(texts), step):
                rows: list[tuple[int, int, int, int]] = []
                for d, text in enumerate(texts[at : at + step]):
                    n, found = _term_counts(text, index)
                    m = 25 + 75 * n * n_docs // length if n else 0
                    rows += [(d, t, tf, m) for t, tf in found]
                if not rows:
                    continue
                d, t, tf, m = np.array(rows, np.int64).T
                gain = weight[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                size = start[t + 1] - start[t]
                place = np.repeat(start[t] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                scores = np.zeros((min(step, len(texts) - at), n_items), np.int64)
                np.add.at(scores, (np.repeat(d, size), owner[place]), np.repeat(gain, size) * times[place])
                d, item = np.nonzero((scores > 0) & (scores >= least))
                heap_item = np.concatenate((heap_item, item))
                heap_score = np.concatenate((heap_score, scores[d, item]))
                heap_doc = np.concatenate((heap_doc, ids_of[:, at + d]), axis=1)
                kept = best(heap_item, heap_doc, heap_score, top)
                heap_item, heap_doc, heap_score = heap_item[kept], heap_doc[:, kept], heap_score[kept]
                full = np.flatnonzero(np.bincount(heap_item, minlength=n_items) == top)
                least[full] = heap_score[np.searchsorted(heap_item, full) + top - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(heap_item), pa.array(heap_doc[0], mask=heap_doc[1] > 0), pa.array(heap_score)], schema=HEAPS
        )

    heaps = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "item long, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    in_group = Window.partitionBy("item", "group").orderBy(*order)
    of_item = Window.partitionBy("item").orderBy(*order)
    ranked = (
        heaps.withColumn("group", F.spark_partition_id() % MERGE_GROUPS)
        .withColumn("rank", F.row_number().over(in_group))
        .where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(of_item))
        .where(F.col("rank") <= top)
    )
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id string")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item; item_id as in `benchmark`."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    # the names sent back are those of one block of items
    found = [_search_block(docs, [tuple(r) for r in bench.where(part == b).collect()], top) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found).withColumn("item_id", F.col("item_id").cast(benchmark.schema["item_id"].dataType))


def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), f AS (SELECT term, count(*) AS df FROM t GROUP BY term
), q AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL
), s AS (
  SELECT q.item_id, t.r, sum(times * CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT)
           * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * CAST(len(d.w) AS BIGINT) * nd) // l)))) AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN d ON d.r = t.r, k GROUP BY q.item_id, t.r
), o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
         doc_id, CAST(score AS BIGINT) AS score
  FROM s JOIN d USING (r) WHERE score > 0
)
SELECT * FROM o WHERE rank <= 10
"""
