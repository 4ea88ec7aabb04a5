"""Line de-duplication: two Bloom filters name the suspects, and only suspects are shuffled.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least
`min_chars` code points found in at least `min_docs` documents lose all their lines except in the
largest doc_id that holds them. Documents are told apart by doc_id.

Pass 1 builds the filters of keys seen once and seen twice (bloom.py). Pass 2 emits the keys that may
occur twice, each once per document, as 128-bit digests; these are counted exactly. Pass 3 drops lines; only texts
that lose a line are shuffled.

Null and empty text: one empty line, kept. A null doc_id takes part in no count and keeps its text.
Rows that repeat a doc_id are one document for the counts and lose the same lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import bloom
from wakeline.llm.common import by_slice, slices, small_batches, table, utf8
from wakeline.sources.scratch import materialize

MIN_CHARS, MIN_DOCS = 20, 3
#: 64 blocks: filters of 16 MiB.
FILTER_BLOCKS = 64
KEYS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])
KEPT = [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key, or None where it is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def keys_of(text: bytes | None, min_chars: int) -> set[bytes]:
    found = {line_key(line, min_chars) for line in (text or b"").split(b"\n")}
    found.discard(None)
    return found


def repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, blocks: int = FILTER_BLOCKS
) -> DataFrame:
    """(doc_id, keys): digests of the lines that each document loses."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.array(
            [xxhash.xxh3_64_intdigest(k) for text in utf8(batch, "text") for k in keys_of(text, min_chars)],
            np.uint64,
        )

    bits = slim.sparkSession.sparkContext.broadcast(bloom.twice_filter(slim, hashes, blocks))

    def suspects(batch: pa.RecordBatch) -> list:
        ids, keys = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
            if found := list(keys_of(text, min_chars)):
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
                some = np.flatnonzero(bloom.suspected(bits.value, h))
                ids += [doc_id] * len(some)
                keys += [xxhash.xxh3_128_digest(found[i]) for i in some]
        return [ids, keys]

    seen = materialize(slim.mapInArrow(by_slice(KEYS, suspects), "doc_id long, key binary"), "line-suspects")
    often = (
        seen.groupBy("key")
        .agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper")
    )
    # Written, so that both sides of the join are dealt anew and a key with most suspects can be split.
    often = materialize(often, "line-repeats")
    return (
        seen.join(often, "key")
        .where("doc_id != keeper")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, into: str = "_lines") -> DataFrame:
    """`docs` with a struct column: n_lines, n_dropped and the kept text."""

    def cut(text: bytes | None, gone: list[bytes] | None) -> tuple[int, int, bytes]:
        lines = (text or b"").split(b"\n")
        if not gone:  # the filter also lets some texts pass that lose nothing
            return len(lines), 0, text or b""
        digests = set(gone)
        stay = [line for line in lines if (key := line_key(line, min_chars)) is None or xxhash.xxh3_128_digest(key) not in digests]
        return len(lines), len(lines) - len(stay), b"\n".join(stay)

    @F.arrow_udf("n_lines long, n_dropped long, text string")
    def kept(text: pa.Array, keys: pa.Array) -> pa.Array:
        done = []
        for part in slices(pa.record_batch([text, keys], names=["text", "keys"])):
            rows = [cut(*row) for row in zip(utf8(part, "text"), part.column(1).to_pylist())]
            n_lines, n_dropped, texts = ([row[i] for row in rows] for i in range(3))
            columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            done.append(pa.StructArray.from_arrays(columns, ["n_lines", "n_dropped", "text"]))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct(KEPT))

    with small_batches(docs.sparkSession):
        gone = repeated_lines(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "_line_doc", "keys": "_line_keys"})
        gone = materialize(gone, "line-losses")
    # Only texts that lose a line meet their losses by shuffle.
    touched = bloom.may_hold(gone.select("_line_doc"))(F.col("doc_id").cast("long"))
    met = docs.where(touched).join(gone, F.col("doc_id") == F.col("_line_doc"), "left").drop("_line_doc")
    met = met.withColumn(into, kept(F.col("text"), F.col("_line_keys"))).drop("_line_keys")
    # The others stay as they are: a second Python worker beside the filter's would hold their texts again.
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = F.struct(n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("text"))
    return met.unionByName(docs.where(~touched).withColumn(into, whole))


def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select(
        "doc_id",
        F.col("_lines.n_lines").alias("n_lines"),
        F.col("_lines.n_dropped").alias("n_dropped"),
        F.sha2(F.col("_lines.text"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, string_split(coalesce(text, ''), chr(10))[u.i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, coalesce(k.doc_id <> o.keeper, false) AS gone FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
