"""Near-duplicate documents by Order MinHash.

Words are runs of characters other than ASCII white space. The k-mers are `SHINGLE`-word shingles, labelled
with their number of occurrence. Each of `SKETCHES` sketches takes the `ORDERED` k-mers with the smallest
hashes and keeps them in the order of the text, so sketches agree only where similar text stands in similar
order. As links don't depend on order and repeats, each text also has as many sketches of its distinct
shingles, as sets. Documents that share a sketch of either kind are candidates; they are verified by a banded
alignment of their shingles, and linked if the Jaccard similarity of their shingles is `SIMILARITY` or more.
Classes are the connected documents; a class is named by its smallest doc_id.

With 32 sketches of 5 as sets, a pair of similarity 0.8 is missed with a chance of 0.672^32, about 3 in a million,
whatever the order and the repeats in its texts. For short texts the chance is larger, at most 0.702^32 = 12 in a
million from 25 distinct shingles on; a pair with a text of up to `SHORT` is never missed, as it shares one of its
`short_keys`.

Copies with the same words collapse first and are represented by their smallest doc_id. Only texts of
documents that share a sketch with another are shuffled. Within a bucket of one sketch, all members are
compared with the smallest. The links of all buckets give first classes; then members of a bucket that are
still in different classes are compared with each other, without a cap. Before texts are compared, an exact
bound from the parities of their shingle counts, evaluated within the join, leaves out pairs that can't be
similar, which are most of a large family whose copies differ too much. So every two documents that share
a sketch end in one class, are compared, or are proved apart.

Texts of fewer than `SHINGLE` words have one shingle, all of them. Null text, and text without words, is a
class of its own; a row with a null doc_id has a null class. Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import bloom
from wakeline.llm.common import by_slice, grams, mix, signed, small_batches, table, utf8, word_hashes
from wakeline.llm.components import smallest_in_component
from wakeline.sources.scratch import materialize

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, ORDERED = 32, 5
#: Texts of up to `SHORT` distinct shingles meet all similar ones by choices of `TOGETHER` shingles.
SHORT, TOGETHER = 24, 3
FILTER_BLOCKS = 64
#: Bins of the parity bound; it leaves out pairs of up to about 2.25 times as many shingles each.
PARITY_BITS = 2048
#: Shingles whose hashes for all sketches are held at once.
AT_ONCE = 8_000
MULTIPLIERS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
SALTS = mix(np.arange(1001, 1001 + SKETCHES, dtype=np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    return grams(words, min(SHINGLE, len(words))) if len(words) else np.empty(0, np.uint64)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each value mixed with its number of occurrence."""
    order = np.argsort(values, kind="stable")
    new = np.concatenate(([True], np.diff(values[order]) != 0))
    first = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    count = np.empty(len(values), np.uint64)
    count[order] = np.arange(len(values)) - first
    return mix(values + count * np.uint64(0xD1B54A32D192ED03))


def sketch_keys(kmers: np.ndarray, ordered: bool) -> np.ndarray:
    """One number per sketch: of the k-mers with the smallest hashes, in the order of the text or as a set."""
    take = min(ORDERED, len(kmers))
    out = []
    step = max(1, AT_ONCE * SKETCHES // max(len(kmers), AT_ONCE))
    for k in range(0, SKETCHES, step):
        hashes = (kmers[None, :] ^ SALTS[k : k + step, None]) * MULTIPLIERS[k : k + step, None]
        least = np.argpartition(hashes, take - 1, axis=1)[:, :take]
        if ordered:
            found = SALTS[k : k + step].copy()
            for j in np.sort(least, axis=1).T:
                found = mix(found * np.uint64(0x9E3779B97F4A7C15) + kmers[j])
        else:
            found = mix(kmers[least].sum(axis=1, dtype=np.uint64) ^ MULTIPLIERS[k : k + step])
        out.append(found)
    return np.concatenate(out)


def short_keys(distinct: np.ndarray) -> np.ndarray:
    """Keys of which every two similar texts share one, for few distinct shingles.

    A text of n shingles holds at least `SIMILARITY` * n of those of a similar one. So the `TOGETHER` smallest
    common hashes of two similar texts are among the smallest `left` of each: every choice of `TOGETHER` is a key.
    """
    n = len(distinct)
    together = min(TOGETHER, n)
    left = n - ceil(SIMILARITY * n - 1e-9) + together
    chosen = np.array(list(combinations(range(left), together)))
    return mix(np.sort(distinct)[chosen].sum(axis=1, dtype=np.uint64) ^ np.uint64(0xA0761D6478BD642F))


def candidate_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the buckets in which a text meets others.

    Order MinHash, sketches of the distinct shingles without order, and exact keys of short texts.
    """
    distinct = mix(np.unique(values))
    keys = [sketch_keys(labelled(values), True)]
    if len(distinct) > SHORT:
        keys.append(sketch_keys(distinct, False))
    if SIMILARITY * len(distinct) <= SHORT:  # short, or similar to a short one
        keys.append(short_keys(distinct))
    return np.concatenate(keys)


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Distinct shingles that a banded alignment of two shingle sequences keeps in order.

    Equal k-mers (value and occurrence) are matched if they lie within the band around the diagonal: as far
    off as the lengths differ plus the part that may differ. The longest chain in order is the alignment.
    """
    x, y = labelled(a), labelled(b)
    order = np.argsort(y)
    at = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    place = order[at]
    i = np.flatnonzero(y[place] == x)
    j = place[i]
    band = abs(len(x) - len(y)) + int((1 - SIMILARITY) * max(len(x), len(y))) + SHINGLE
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(j) and (np.diff(j) <= 0).any():
        ends: list[int] = []
        tails: list[int] = []
        before = np.full(len(j), -1)
        for k, v in enumerate(j.tolist()):
            p = bisect_left(ends, v)
            before[k] = tails[p - 1] if p else -1
            if p == len(ends):
                ends.append(v)
                tails.append(k)
            else:
                ends[p], tails[p] = v, k
        chain, k = [], tails[-1]
        while k >= 0:
            chain.append(k)
            k = before[k]
        i = i[chain]
    return len(np.unique(a[i]))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sequences, as far as it matters whether it reaches `SIMILARITY`."""
    n, m = len(np.unique(a)), len(np.unique(b))
    if not n or not m or min(n, m) < SIMILARITY * max(n, m):
        return 0.0
    kept = aligned(a, b)
    if kept < SIMILARITY * (n + m - kept):
        # passages may have moved out of the band: count without order
        kept = len(np.intersect1d(a, b))
    return kept / (n + m - kept)


ROWS = pa.schema(
    [("doc_id", pa.int64()), ("copy", pa.binary()), ("n_words", pa.int64()), ("keys", pa.list_(pa.int64()))]
)

LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
PARITIES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("parity", pa.list_(pa.int64())), ("folded", pa.list_(pa.int64()))])


def sketch_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, n_words, keys) for each row: digest of its words, and its candidate keys."""

    def rows(batch: pa.RecordBatch) -> list:
        copies, sizes, keys = [], [], []
        for text in utf8(batch, "text"):
            words = text.split() if text else []
            copies.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            sizes.append(len(words))
            keys.append(signed(candidate_keys(shingles(word_hashes(words)))) if words else None)
        return [batch.column(0), copies, sizes, keys]

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(by_slice(ROWS, rows), "doc_id long, copy binary, n_words long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with whether they are linked."""

    def similar(batch: pa.RecordBatch) -> list:
        both = zip(utf8(batch, "_one"), utf8(batch, "_two"))
        linked = [similarity(*(shingles(word_hashes(t.split())) for t in pair)) >= SIMILARITY for pair in both]
        return [batch.column(0), batch.column(1), linked]

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_one"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_two"))
    met = pairs.join(two, "b").join(one, "a").select("a", "b", "_one", "_two")
    return met.mapInArrow(by_slice(LINKED, similar), "a long, b long, linked boolean")


def parities(texts: DataFrame) -> DataFrame:
    """(doc_id, n, parity): distinct shingles of each text and, for each of `PARITY_BITS` bins, whether an odd number falls there."""

    def parity(batch: pa.RecordBatch) -> list:
        sizes, parity, folded = [], [], []
        for text in utf8(batch, "text"):
            found = np.unique(shingles(word_hashes(text.split())))
            odd = np.bincount((mix(found) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
            words = np.packbits(odd.astype(bool)).view(np.int64)
            sizes.append(len(found))
            parity.append(words)
            folded.append(np.bitwise_xor.reduce(words.reshape(4, -1)))
        return [batch.column(0), sizes, parity, folded]

    slim = texts.select("doc_id", "text")
    return slim.mapInArrow(by_slice(PARITIES, parity), "doc_id long, n long, parity array<long>, folded array<long>")


def _renamed(sizes: DataFrame, *keep) -> DataFrame:
    """The columns that bound a pair's similarity, for its other text."""
    names = {"n": "m", "parity": "other_parity", "folded": "other_folded"}
    return sizes.select(*keep, *[F.col(c).alias(d) for c, d in names.items()])


def _may_be_similar():
    """Whether two texts could reach `SIMILARITY`.

    Bins of different parity are at most as many as the shingles that only one of two texts holds,
    and similar texts have few of those: a bound that never leaves out a similar pair. Parities
    folded to a quarter of the bins bound too, and are compared first.
    """
    apart = F.lit((1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9) * (F.col("n") + F.col("m"))

    def differ(name: str, words: int):
        return sum(F.bit_count(F.col(name)[k].bitwiseXOR(F.col(f"other_{name}")[k])) for k in range(words))

    words = PARITY_BITS // 64
    return (F.abs(F.col("n") - F.col("m")) <= apart) & (differ("folded", words // 4) <= apart) & (differ("parity", words) <= apart)


def find_links(docs: DataFrame, sketched: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b): links between documents with different words; not all, but enough to connect each class."""
    bucket = ["key"]
    members = materialize(
        sketched.join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select("doc_id", F.explode("keys").alias("key"))
        .distinct(),
        "sketch-members",
    )
    leaders = members.groupBy(*bucket).agg(F.min("doc_id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    leaders = materialize(leaders.drop("size"), "sketch-leaders")
    members = materialize(members.join(leaders, bucket), "bucket-members")

    # Texts of the members, and what bounds the similarity of two of them.
    ids = members.select("doc_id").distinct()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    wanted = bloom.may_hold(ids, FILTER_BLOCKS)
    texts = materialize(slim.where(wanted(F.col("doc_id"))), "candidate-texts")
    sizes = materialize(parities(texts), "parities")
    led = _renamed(sizes, F.col("doc_id").alias("leader"))

    star = members.where("doc_id != leader").select(F.col("leader"), "doc_id").distinct()
    star = star.join(sizes, "doc_id").join(led, "leader").where(_may_be_similar())
    first = materialize(_verified(star.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), texts), "judged-pairs")
    links = first.where("linked").select("a", "b")

    # Members of a bucket that are in one class by now need no comparison; the others meet each other.
    classes = smallest_in_component(links)
    named = members.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        *bucket, "doc_id", F.coalesce("label", "doc_id").alias("label")
    )
    split = named.groupBy(*bucket).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    apart = materialize(named.join(split.select(*bucket), bucket).join(sizes, "doc_id"), "open-members")
    other = _renamed(apart, *bucket, F.col("doc_id").alias("b"), F.col("label").alias("other"))
    pairs = (
        apart.withColumnRenamed("doc_id", "a")
        .join(
            other,
            [apart[c] == other[c] for c in bucket]
            + [F.col("a") < F.col("b"), F.col("label") != F.col("other"), _may_be_similar()],
        )
        .select("a", "b")
        .distinct()
        .join(first.select("a", "b"), ["a", "b"], "left_anti")
    )
    second = materialize(_verified(pairs, texts), "judged-pairs")
    return links.unionByName(second.where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of, n_words) for each row: the class, and the first document with the same words."""
    with small_batches(docs.sparkSession):
        sketched = materialize(sketch_rows(docs), "sketches")
        firsts = materialize(
            sketched.where("copy is not null and doc_id is not null").groupBy("copy").agg(F.min("doc_id").alias("first")), "copies"
        )
        classes = smallest_in_component(find_links(docs, sketched, firsts))
    known = sketched.select("doc_id", "copy", "n_words").join(firsts, "copy", "left")
    named = known.join(classes.select(F.col("node").alias("first"), "label"), "first", "left")
    return named.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "first", "doc_id")).alias("class_id"),
        F.coalesce("first", "doc_id").alias("copy_of"),
        "n_words",
    )


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
