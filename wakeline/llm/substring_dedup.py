"""Substring de-duplication as a relative Lempel-Ziv parse against the whole corpus.

Words are runs of characters other than ASCII white space. Every document is factored against all earlier
text (smaller doc_id, or the same document before): a factor is a passage that the reference holds. Each
word in a factor of at least `WINDOW` words, that is, each word covered by a window of `WINDOW` words that
also starts earlier, is removed.

The reference is indexed in blocks, and a block is reached only by text that shares a seed with it:

- A seed is the smallest hashed `SEED`-gram of a window, so equal windows have equal seeds. Consecutive
  windows with one seed form a run, about 8 windows.
- Bloom filters of seeds seen once and twice (bloom.py) set aside text whose seeds occur once: it can be in
  no factor. A full filter costs time only.
- Whole factors: runs are grouped by seed and digest, 128 bits; all occurrences but the first are factors that point
  to it. A run is one slim row, whatever its length.
- Factor boundaries: where a seed has several different runs, a factor may begin or end within a run.
  Only there are single windows compared, by 96 bits, each with the first place that holds it.

Pointers of adjoining pieces that continue each other join into one factor. All steps are sums by hash and
joins by hash; no group is ever in one task, and a hot passage is one row per task after partial sums.

Null text has no words. Texts of fewer than `WINDOW` words are kept whole, and so are rows with a null
doc_id. Rows that repeat a doc_id and text are one document and do not count as each other's copies. Different texts
with one doc_id are documents of their own, in the order of a 64-bit digest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm import bloom
from wakeline.llm.common import by_slice, grams, mix, signed, table, utf8, word_hashes
from wakeline.sources.scratch import materialize

WINDOW, SEED = 20, 6
#: 128 blocks: filters of 32 MiB.
FILTER_BLOCKS = 128
#: Words of texts that are parsed side by side.
SIDE_BY_SIDE = 20_000


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


class Parsed:
    """Windows of several texts with their seeds, texts side by side; each text has a window."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.words = np.concatenate(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = sizes - WINDOW + 1
        #: Number of the text, start there and place among all words of each window; none crosses a border.
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.start = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = np.repeat(np.cumsum(sizes) - sizes, counts) + self.start
        self.width = WINDOW - SEED + 1
        self.grams = grams(self.words, SEED)
        self.seeds = slide(self.grams, self.width, np.minimum)[self.at]

    def seed_places(self) -> np.ndarray:
        """Hash of every gram that is the seed of some window, once for each place, ties included."""
        pad = self.width - 1
        within = np.zeros(len(self.grams) + pad, np.uint64)
        within[self.at + pad] = self.seeds
        return self.grams[self.grams == slide(within, self.width, np.maximum)]

    def windows(self) -> np.ndarray:
        return grams(self.words, WINDOW)[self.at]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run."""
        new = (self.seeds[1:] != self.seeds[:-1]) | (self.text[1:] != self.text[:-1])
        edge = np.flatnonzero(np.concatenate(([True], new)))
        return edge, np.diff(np.append(edge, len(self.seeds)))


def parsed(batch: pa.RecordBatch) -> Iterator[tuple[Parsed, np.ndarray]]:
    """The texts of a batch that have a window, some at a time, and their row numbers."""
    rows, texts, size = [], [], 0
    for row, text in enumerate(utf8(batch, "text")):
        words = text.split() if text else []
        if len(words) >= WINDOW:
            rows.append(row)
            texts.append(word_hashes(words))
            size += len(words)
        if size >= SIDE_BY_SIDE:
            yield Parsed(texts), np.array(rows)
            rows, texts, size = [], [], 0
    if texts:
        yield Parsed(texts), np.array(rows)


RUNS = pa.schema(
    [("seed", pa.int64()), ("a", pa.int64()), ("twin", pa.bool_()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
)
WINDOWS = pa.schema([("h", pa.int64()), ("c", pa.int32()), ("doc_id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int32())])


def runs_of(docs: Parsed, edge: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Seed, digest, and whether a window repeats within, of runs by their first windows and sizes."""
    run = np.repeat(np.arange(len(edge)), size)
    before = np.cumsum(size) - size
    at = np.arange(len(run)) - before[run]
    windows = docs.windows()[edge[run] + at]
    a = np.add.reduceat(mix(windows + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), before)
    twin = np.zeros(len(edge), bool)
    # A window can only repeat within a run whose seed has two places, which follow each other among all places.
    places = docs.seed_places()
    some = np.isin(docs.seeds[edge], places[1:][places[1:] == places[:-1]])[run]
    if some.any():
        order = np.lexsort((windows[some], run[some]))
        w, r = windows[some][order], run[some][order]
        twin[r[1:][(w[1:] == w[:-1]) & (r[1:] == r[:-1])]] = True
    return docs.seeds[edge], a, twin


def text_number(docs: DataFrame) -> Column:
    """0, or a digest of the text for doc_ids that may have several texts, which it tells apart."""
    digest, doc = F.xxhash64("text"), F.col("doc_id").cast("long")
    ids = docs.where("doc_id is not null").groupBy(doc.alias("doc")).agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    shared = materialize(ids.where("low != high").select("doc"), "passage-shared-ids")
    return F.lit(0).cast("long") if shared.isEmpty() else F.when(bloom.may_hold(shared)(doc), digest).otherwise(F.lit(0))


def find_factors(docs: DataFrame, text_id: Column, blocks: int = FILTER_BLOCKS) -> DataFrame:
    """(doc_id, text_id, start, n, ref_doc, ref_start): n windows from `start` on that also start at ref_doc, ref_start."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    slim = docs.where("doc_id is not null and text is not null").select(doc_id, text_id.alias("text_id"), "text")

    def seeds(batch: pa.RecordBatch) -> np.ndarray:
        found = [some.seed_places() for some, _ in parsed(batch)]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    repeated = bloom.twice_filter(slim, seeds, blocks)
    common = spark.sparkContext.broadcast(repeated)

    def runs(batch: pa.RecordBatch) -> list:
        doc_id, text_id = (batch.column(k).to_numpy() for k in range(2))
        found = []
        for some, row in parsed(batch):
            edge, size = some.runs()
            suspects = bloom.suspected(common.value, some.seeds[edge])
            if suspects.any():
                edge, size = edge[suspects], size[suspects]
                row = row[some.text[edge]]
                found.append((*runs_of(some, edge, size), doc_id[row], text_id[row], some.start[edge], size))
        if not found:
            return [[] for _ in RUNS]
        seed, a, twin, ids, texts, start, n = map(np.concatenate, zip(*found))
        return [signed(seed), signed(a), twin, ids, texts, start.astype(np.int32), n.astype(np.int32)]

    schema = "seed long, a long, twin boolean, doc_id long, text_id long, start int, n int"
    rows = materialize(slim.mapInArrow(by_slice(RUNS, runs), schema), "passage-runs")
    firsts = materialize(
        rows.groupBy("seed", "a").agg(
            F.min(F.struct("doc_id", "text_id", "start")).alias("ref"),
            F.count("*").alias("times"),
            F.max("twin").alias("twin"),
        ),
        "passage-firsts",
    )
    pointer = [F.col("ref.doc_id").alias("ref_doc"), F.col("ref.text_id").alias("ref_text"), F.col("ref.start").alias("ref_start")]
    known = firsts.where("times > 1").select("seed", "a", *pointer)
    earlier = (F.col("doc_id") != F.col("ref_doc")) | (F.col("text_id") != F.col("ref_text")) | (F.col("start") != F.col("ref_start"))
    whole = rows.join(known, ["seed", "a"]).where(earlier).select("doc_id", "text_id", "start", "n", "ref_doc", "ref_start")

    # Seeds of several different runs, or of a run that repeats a window within itself.
    def contested(batch: pa.RecordBatch) -> np.ndarray:
        seed = batch.column(0).to_numpy().view(np.uint64)
        return np.concatenate((seed, seed[batch.column(1).to_numpy(zero_copy_only=False)]))

    # An item is in both filters if its bits are set in both: their meet is one filter, half the memory in a worker.
    open_seeds = spark.sparkContext.broadcast(repeated & bloom.twice_filter(firsts.select("seed", "twin"), contested, blocks))
    common.unpersist()  # the runs are written

    def boundary(batch: pa.RecordBatch) -> list:
        doc_id, text_id = (batch.column(k).to_numpy() for k in range(2))
        found = []
        for some, row in parsed(batch):
            edge, size = some.runs()
            keep = bloom.suspected(open_seeds.value, some.seeds[edge])
            at = np.flatnonzero(np.repeat(keep, size))
            if len(at):
                row = row[some.text[at]]
                found.append((some.windows()[at], some.seeds[at].astype(np.uint32), doc_id[row], text_id[row], some.start[at]))
        if not found:
            return [[] for _ in WINDOWS]
        h, c, ids, texts, at = map(np.concatenate, zip(*found))
        return [signed(h), c.view(np.int32), ids, texts, at.astype(np.int32)]

    single = materialize(slim.mapInArrow(by_slice(WINDOWS, boundary), "h long, c int, doc_id long, text_id long, start int"), "passage-windows")
    places = materialize(
        single.groupBy("h", "c")
        .agg(F.min(F.struct("doc_id", "text_id", "start")).alias("ref"), F.count("*").alias("times"))
        .where("times > 1")
        .select("h", "c", *pointer),
        "passage-places",
    )
    open_seeds.unpersist()
    parts = single.join(places, ["h", "c"]).where(earlier).select("doc_id", "text_id", "start", F.lit(1).alias("n"), "ref_doc", "ref_start")
    return whole.unionByName(parts)


def join_factors(pieces: list[tuple[int, int, int, int]]) -> list[dict]:
    """Greedy factors from (start, n, ref_doc, ref_start): pieces that continue one pointer become one."""
    out: list[dict] = []
    for start, n, doc, at in sorted(pieces, key=lambda p: (p[0], -p[1], p[2], p[3])):
        end = start + n + WINDOW - 1
        last = out[-1] if out else None
        if last and start <= last["end"]:
            if last["ref_doc"] == doc and at - start == last["ref_start"] - last["start"]:
                last["end"] = max(last["end"], end)
                continue
            if end <= last["end"]:
                continue
        out.append({"start": start, "end": end, "ref_doc": doc, "ref_start": at})
    return out


def drop_passages(docs: DataFrame, into: str = "_passages", blocks: int = FILTER_BLOCKS) -> DataFrame:
    """`docs` with a struct column: n_words, n_removed, kept text (words joined by a space) and the factors."""

    @F.pandas_udf(
        "n_words long, n_removed long, text string, factors array<struct<start:long,end:long,ref_doc:long,ref_start:long>>"
    )
    def kept(texts: pd.Series, pieces: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, pieces):
            words = text.encode().split() if text else []
            factors = [] if found is None else join_factors([(p["start"], p["n"], p["ref_doc"], p["ref_start"]) for p in found])
            gone = np.zeros(len(words), bool)
            for f in factors:
                gone[f["start"] : f["end"]] = True
            stay = [w for w, g in zip(words, gone.tolist()) if not g] if factors else words
            rows.append((len(words), len(words) - len(stay), b" ".join(stay).decode(), factors))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "text", "factors"])

    text_id = text_number(docs)
    factors = materialize(
        find_factors(docs, text_id, blocks)
        .groupBy(F.col("doc_id").alias("_passage_doc"), F.col("text_id").alias("_passage_text"))
        .agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("_passage_parts")),
        "passage-factors",
    )
    # Only texts that have a factor meet the factors by shuffle.
    touched = bloom.may_hold(factors.select("_passage_doc"))(F.col("doc_id").cast("long"))
    mine = (F.col("doc_id") == F.col("_passage_doc")) & (F.col("_passage_of") == F.col("_passage_text"))
    met = docs.where(touched).withColumn("_passage_of", text_id).join(factors, mine, "left")
    met = met.drop("_passage_doc", "_passage_text", "_passage_of")
    met = met.withColumn(into, kept(F.col("text"), F.col("_passage_parts"))).drop("_passage_parts")
    # The others lose nothing: a second Python worker beside the filter's would hold their texts again.
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    n_words = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + (text != "").cast("int")).cast("long")
    none = F.array().cast(met.schema[into].dataType["factors"].dataType)
    whole = F.struct(n_words.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), text.alias("text"), none.alias("factors"))
    return met.unionByName(docs.where(~touched).withColumn(into, whole))


def op7_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_passages(docs).select(
        "doc_id",
        F.col("_passages.n_words").alias("n_words"),
        F.col("_passages.n_removed").alias("n_removed"),
        F.sha2(F.col("_passages.text"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(i)
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win
), gone AS (SELECT DISTINCT doc_id, p FROM ranked, unnest(range(i, i + 20)) AS u(p) WHERE r > 1
), words AS (
  SELECT d.doc_id, u.p AS p, d.w[u.p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)
), kept AS (
  SELECT w.doc_id, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
