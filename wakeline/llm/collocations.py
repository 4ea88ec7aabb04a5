"""Collocations by the stripes pattern: each prefix keys a counter of the words that follow it.

A-Z is lower-cased, texts are split at `[.,;:!?]` and line ends into pieces, and pieces into words
`[^\\x20\\x09]+`. All counts are per lang. A phrase of 2 to `longest` words that occurs `least` times or more is
a candidate; it is scored by its weakest cut, and dropped if a longer candidate that holds it occurs as often.

A stripe belongs to a prefix of up to `longest` - 1 words and counts what follows it; the stripe of no words at all
counts words, with one entry for all rare ones, so that its sum is the number of words. Stripes of all tasks
are merged elementwise. Everything comes from the merged stripes: extensions (entries), prefix totals (the
prefix's entry in the stripe one word shorter), the largest extension to the right (maximum of a stripe) and
to the left (maximum over the stripes whose prefix differs in the first word only).

Passes 1 and 2 count the hashes of words and pairs of words, then of three words whose pairs are frequent. Those
seen `least` times go into Bloom filters whose size follows their number, up to `FILTER_BLOCKS`. A fuller filter, or
hashes that collide, only let more through. Pass 3 counts the runs whose words, pairs and threes all pass. A rare
phrase has no frequent extension, so no candidate is lost, and all counts are exact.

A stripe is split into parts by a hash of the following word, so a frequent prefix is not one task's. Parts are
sent and merged in buckets of about `BUCKET_RUNS` frequent runs; their number follows the number of frequent
runs. A task holds about `TASK_PHRASES` phrases, as rows of word numbers, before it sends its stripes; merging holds
one bucket. Texts become Python objects a slice of a batch and `STEP_TOKENS` tokens at a time, whatever the number of langs.

Null texts are empty, null lang is `und`. Rows that repeat count each. Texts of any length are read whole. An
empty table gives no rows. Products of counts are exact decimals of 38 digits, enough for 10^16 words a lang.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm import bloom
from wakeline.llm.common import WordHashes, mix, slices, table, utf8, word_hashes
from wakeline.sources.scratch import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: The filter has at most this many blocks of 256 KiB; a block serves 100,000 frequent hashes.
FILTER_BLOCKS, FILTER_ITEMS = 128, 100_000
TASK_PHRASES, TASK_TOKENS = 500_000, 1_000_000
#: Phrases of the steps since the last sum that wait to be summed.
WAITING_PHRASES = 200_000
#: Texts are hashed in steps of this many tokens, and sent in batches of so many rows.
STEP_TOKENS, BATCH_ROWS, BATCH_BUCKETS = 200_000, 100_000, 100
#: Parts of a stripe by the number of words of its prefix; longer prefixes have few followers.
PARTS = {0: 64, 1: 16, 2: 4}
BUCKET_RUNS = 1_000
TOP_GROUPS = 64
#: A-Z become a-z, tab becomes space, separators of pieces become `;`.
PIECE_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09 else 0x3B if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256)
)
HASHES = pa.schema([("h", pa.int64()), ("n", pa.int64())])
STRIPES = pa.schema(
    [
        ("lang", pa.string()),
        ("bucket", pa.int64()),
        ("prefix", pa.list_(pa.string())),
        ("part", pa.list_(pa.int32())),
        ("next", pa.list_(pa.list_(pa.string()))),
        ("n", pa.list_(pa.list_(pa.int64()))),
    ]
)
STRIPE_TYPE = "lang string, bucket long, prefix array<string>, part array<int>, next array<array<string>>, n array<array<long>>"
MERGED = pa.schema(
    [("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("total", pa.int64())]
)
MERGED_TYPE = "lang string, prefix string, part int, next array<string>, n array<long>, total long"
#: The entry of all rare words in the stripe of no words, and its number; 0 is no word.
RARE, RARE_NUMBER = b"", 1


#: A decimal product has the digits of both sides and one more: 4 + 16 + 1 and 16 + 1, and 16 + 16 + 1.
SCORE = (
    "cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(words as decimal(16,0))"
    " div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words, and `;` wherever a piece ends."""
    return text.translate(PIECE_BYTES).replace(b";", b" ; ").split() if text else []


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Tokens of texts with one lang, some texts at a time; each text ends with a separator."""
    found: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for part in slices(batch):
        for lang, text in zip(part.column(0).to_pylist(), utf8(part, "text")):
            tokens = tokens_of(text)
            found[lang] += tokens
            found[lang].append(b";")
            size += len(tokens) + 1
            if size >= STEP_TOKENS:
                yield from found.items()
                found.clear()
                size = 0
    yield from found.items()


class _Hashed:
    """Hashes of words and of neighbouring words, by lang."""

    def __init__(self) -> None:
        self.langs = WordHashes()
        self.end = np.uint64(self.langs[b";"])

    def of(self, lang: str, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of words, and of pairs of words, with their hashes; hashes of the words alone."""
        plain = word_hashes(tokens)
        is_word = plain != self.end
        single = mix(plain ^ np.uint64(self.langs[lang.encode()]))
        one, two = np.flatnonzero(is_word), np.flatnonzero(is_word[:-1] & is_word[1:])
        return one, single[one], two, _then(single[two], plain[two + 1]), plain


def _then(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run of words and one more."""
    return mix(run * np.uint64(0x9E3779B97F4A7C15) + word)


def _threes(bits: np.ndarray, two: np.ndarray, pair: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a frequent pair starts at each token; places and hashes of three words with frequent pairs."""
    frequent = bloom.suspected(bits, pair)
    joins = np.zeros(len(plain), bool)
    joins[two[frequent]] = True
    place, hashed = two[frequent], pair[frequent]
    both = joins[place + 1]
    place = place[both]
    return joins, place, _then(hashed[both], plain[place + 2])


def _hash_counts(docs: DataFrame, hashes: Callable, least: int) -> DataFrame:
    """(h): hashes that occur `least` times or more; `hashes` gives those of some tokens of a lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, held, size = _Hashed(), [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            held.clear()
            h.sort()
            first = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]))[: len(h) + 1]
            for i in range(0, len(first) - 1, BATCH_ROWS):
                cuts = first[i : i + BATCH_ROWS + 1]
                yield pa.RecordBatch.from_arrays([pa.array(h[cuts[:-1]].view(np.int64)), pa.array(np.diff(cuts))], schema=HASHES)

        for batch in batches:
            for lang, tokens in _by_lang(batch):
                held += hashes(hashed, lang, tokens)
                size += len(tokens)
                if size >= TASK_TOKENS:
                    yield from counted()
                    size = 0
        if size:
            yield from counted()

    found = docs.mapInArrow(run, "h long, n long")
    return materialize(found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "frequent-hashes")


def _filter(hashes: DataFrame) -> tuple[Broadcast, int]:
    """A filter of the hashes, and their number."""
    size = hashes.count()
    blocks = min(FILTER_BLOCKS, size // FILTER_ITEMS + 1)
    bits = bloom.twice_filter(hashes, lambda batch: np.repeat(batch.column(0).to_numpy().view(np.uint64), 2), blocks)
    return hashes.sparkSession.sparkContext.broadcast(bits), size


def frequent_runs(docs: DataFrame, least: int) -> tuple[Broadcast, Broadcast, int]:
    """Filters of the words and pairs, and of three words, that occur `least` times within a lang; their number."""

    def words_and_pairs(hashed: _Hashed, lang: str, tokens: list[bytes]) -> list[np.ndarray]:
        _, single, _, pair, _ = hashed.of(lang, tokens)
        return [single, pair]

    short, n_short = _filter(_hash_counts(docs, words_and_pairs, least))

    def threes(hashed: _Hashed, lang: str, tokens: list[bytes]) -> list[np.ndarray]:
        _, _, two, pair, plain = hashed.of(lang, tokens)
        return [_threes(short.value, two, pair, plain)[2]]

    long, n_long = _filter(_hash_counts(docs, threes, least))
    return short, long, n_short + n_long


class _Phrases:
    """Counts of phrases as columns of numbers: the lang's, those of up to `longest` words, then zeros."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.words: dict[bytes, int] = {RARE: RARE_NUMBER}
        self.langs: dict[str, int] = {}
        self.n_words: Counter = Counter()
        self.held = [(np.empty((longest + 1, 0), np.int32), np.empty(0, np.int64))]
        self.summed = self.waiting = 0

    def __len__(self) -> int:
        return self.summed + self.waiting

    def add(self, lang: str, tokens: list[bytes], starts: list[np.ndarray], n_words: int) -> None:
        """Count the phrases of 1, 2, ... words that start at these places."""
        used = np.zeros(len(tokens), bool)
        for length, at in enumerate(starts, 1):
            used[at] = used[at + length - 1] = True
        numbers = np.zeros(len(tokens), np.int32)
        places = np.flatnonzero(used)
        known = self.words
        numbers[places] = [known.setdefault(tokens[i], len(known) + 1) for i in places.tolist()]
        phrases = np.zeros((self.longest + 1, sum(map(len, starts))), np.int32)
        phrases[0] = self.langs.setdefault(lang, len(self.langs))
        end = 0
        for length, at in enumerate(starts, 1):
            begin, end = end, end + len(at)
            for k in range(length):
                phrases[k + 1, begin:end] = numbers[at + k]
        self.n_words[lang] += n_words
        self.held.append(_summed(phrases, np.ones(end, np.int64)))
        self.waiting += len(self.held[-1][1])
        if self.waiting >= WAITING_PHRASES:
            self.sum()

    def sum(self) -> None:
        phrases, counts = (np.concatenate(x, axis=-1) for x in zip(*self.held))
        self.held.clear()
        self.held.append(_summed(phrases, counts))
        self.summed, self.waiting = len(self.held[0][1]), 0

    def stripes(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Rows of `STRIPES`; this ends the counts. A key that comes twice is summed when stripes are merged."""
        self.sum()
        phrases, counts = self.held.pop()
        # what the frequent words of a lang leave of all its words is its rare ones
        rare = np.zeros((self.longest + 1, len(self.langs)), np.int32)
        rare[0], rare[1] = np.arange(len(self.langs)), RARE_NUMBER
        left = np.array([self.n_words[lang] for lang in self.langs], np.int64)
        single = np.flatnonzero(np.count_nonzero(phrases[1:], axis=0) == 1)
        np.subtract.at(left, phrases[0, single], counts[single])
        phrases, counts = np.concatenate((phrases, rare), axis=1), np.concatenate((counts, left))

        # the last word of each goes, the rest is its prefix
        length, each = np.count_nonzero(phrases[1:], axis=0), np.arange(len(counts))
        last = phrases[length, each]
        phrases[length, each] = 0
        hashes = np.concatenate((np.zeros(1, np.uint64), word_hashes(list(self.words))))
        prefix = np.zeros(len(counts), np.uint64)
        for column in phrases[1:]:
            prefix = np.where(column > 0, _then(prefix, hashes[column]), prefix)
        parts = np.array([PARTS.get(k, 1) for k in range(self.longest)], np.uint64)[length - 1]
        part = np.where(last == RARE_NUMBER, 0, hashes[last] % parts).astype(np.int32)
        bucket = ((prefix + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((part, prefix, bucket, phrases[0]))
        del each, length, parts, prefix, single

        new_row = _changes(order, bucket, phrases[0])
        new_stripe = new_row | _changes(order, part, *phrases[1:])
        stripe = np.concatenate(([0], np.flatnonzero(new_stripe) + 1, [len(order)]))
        row = np.searchsorted(stripe, np.concatenate(([0], np.flatnonzero(new_row) + 1, [len(order)])))
        words, langs = list(self.words), pa.array(self.langs, pa.string())
        texts = pa.array(words, pa.binary()).cast(pa.string())
        for i in range(0, len(row) - 1, BATCH_BUCKETS):
            of_row = row[i : i + BATCH_BUCKETS + 1]
            of_stripe = stripe[of_row[0] : of_row[-1] + 1]
            entries, stripes, rows = order[of_stripe[0] : of_stripe[-1]], order[of_stripe[:-1]], order[stripe[of_row[:-1]]]
            prefixes = [b" ".join([words[w - 1] for w in x if w]) for x in phrases[1:, stripes].T.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(phrases[0, rows])),
                    pa.array(bucket[rows]),
                    _lists(pa.array(prefixes, pa.binary()).cast(pa.string()), of_row),
                    _lists(pa.array(part[stripes]), of_row),
                    _lists(_lists(texts.take(pa.array(last[entries] - 1)), of_stripe), of_row),
                    _lists(_lists(pa.array(counts[entries]), of_stripe), of_row),
                ],
                schema=STRIPES,
            )


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), values)


def _changes(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Whether each but the first, in this order, differs from the one before in any column."""
    out = np.zeros(max(0, len(order) - 1), bool)
    for column in columns:
        values = column[order]
        out |= values[1:] != values[:-1]
    return out


def _summed(phrases: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal phrases together. They are compared whole; if hashes collide, one may come twice."""
    if not len(counts):
        return phrases, counts
    key = np.zeros(len(counts), np.uint64)
    for column in phrases:
        key = _then(key, column.astype(np.uint64))
    order = np.argsort(key)
    first = np.concatenate(([0], np.flatnonzero(_changes(order, *phrases)) + 1))
    return phrases[:, order[first]], np.add.reduceat(counts[order], first)


def partial_stripes(docs: DataFrame, runs: tuple[Broadcast, Broadcast, int], longest: int) -> DataFrame:
    """(lang, bucket, prefix, part, next, n): stripes of each task, a bucket of them a row."""
    short, long, frequent = runs
    buckets = frequent // BUCKET_RUNS + 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, phrases = _Hashed(), _Phrases(longest)
        for batch in batches:
            for lang, tokens in _by_lang(batch):
                one, single, two, pair, plain = hashed.of(lang, tokens)
                joins, place, three = _threes(short.value, two, pair, plain)
                goes_on = np.zeros(len(tokens), bool)
                goes_on[place[bloom.suspected(long.value, three)]] = True
                starts = [one[bloom.suspected(short.value, single)], np.flatnonzero(joins)]
                for length in range(2, longest):
                    starts.append(starts[-1][goes_on[starts[-1] + length - 2]])
                phrases.add(lang, tokens, starts[:longest], len(one))
                if len(phrases) >= TASK_PHRASES:
                    phrases.sum()
                    if len(phrases) >= TASK_PHRASES:
                        yield from phrases.stripes(buckets)
                        phrases = _Phrases(longest)
        if phrases.langs:
            yield from phrases.stripes(buckets)

    return docs.mapInArrow(run, STRIPE_TYPE)


def merge_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, part, next, n, total): sums of the parts; only frequent entries are listed.

    Rows are sorted by bucket, so the stripes of one bucket are in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, merged = None, {}

        def send() -> Iterator[pa.RecordBatch]:
            rows = []
            for (prefix, part), entries in merged.items():
                kept = [(w, n) for w, n in entries.items() if w and n >= least]
                rows.append((key[0], prefix, part, [w for w, _ in kept], [n for _, n in kept], entries.total()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), MERGED.types)], schema=MERGED)

        for batch in (part for batch in batches for part in slices(batch)):
            for lang, bucket, *stripe in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, bucket) != key:
                    yield from send()
                    key, merged = (lang, bucket), {}
                for prefix, part, words, counts in zip(*stripe):
                    entries = merged.setdefault((prefix, part), Counter())
                    for word, n in zip(words, counts):
                        entries[word] += n
        yield from send()

    return stripes.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, MERGED_TYPE)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): every candidate that no longer candidate replaces."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    merged = materialize(merge_stripes(partial_stripes(texts, frequent_runs(texts, least), longest), least), "stripes")
    sizes = merged.where(F.col("prefix") == "").groupBy("lang").agg(F.sum("total").alias("words"))
    entries = merged.select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e")).select(
        "lang", "prefix", F.ltrim(F.concat("prefix", F.lit(" "), F.col("e.next"))).alias("phrase"), F.col("e.n").alias("a")
    )
    totals = entries.select("lang", "phrase", "a")
    found = entries.where(F.col("prefix") != "").drop("prefix").withColumn("rest", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))

    # a phrase goes if the largest extension to either side occurs as often
    left = found.groupBy("lang", F.col("rest").alias("phrase")).agg(F.max("a").alias("left_most"))
    right = merged.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max(F.array_max("n")).alias("right_most"))
    kept = (
        found.join(left, ["lang", "phrase"], "left")
        .join(right, ["lang", "phrase"], "left")
        .where(F.col("a") > F.greatest(F.coalesce("left_most", F.lit(0)), F.coalesce("right_most", F.lit(0))))
    )
    cuts = kept.select(
        "lang",
        "phrase",
        "a",
        F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)).alias("k"),
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size(split(phrase, ' ')))").alias("rest"),
    )
    scored = (
        cuts.join(totals.toDF("lang", "first", "l"), ["lang", "first"])
        .join(totals.toDF("lang", "rest", "r"), ["lang", "rest"])
        .join(sizes, "lang")
    )
    lowest = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r"))
    return (
        scored.groupBy("lang", "phrase", "a")
        .agg(lowest.alias("cut"), F.first("words").alias("n"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )


def top_collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` first of each lang, chosen in groups, then together."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    in_group = Window.partitionBy("lang", "group").orderBy(*order)
    return (
        collocations(docs, longest, least)
        .withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(TOP_GROUPS)))
        .withColumn("rank", F.row_number().over(in_group))
        .where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def op13_collocations(spark, sf_dir):
    return top_collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)
), f AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM p, unnest(range(1, 6)) AS x(m), unnest(range(1, len(w) - m + 2)) AS u(i) GROUP BY ALL
), size AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, a
  FROM c, unnest(range(2, m)) AS x(k), unnest(range(1, m - k + 2)) AS u(i)
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
), cut AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
  FROM kept c JOIN size s ON s.lang = c.lang, unnest(range(1, c.m)) AS x(k), f l, f r
  WHERE l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, k), ' ')
    AND r.phrase = array_to_string(list_slice(w, k + 1, c.m), ' ')
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM low QUALIFY rank <= 2000
"""
