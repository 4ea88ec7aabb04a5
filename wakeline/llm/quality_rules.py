"""Quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are compared with those of its
language by Jensen-Shannon distance (square root of the divergence, base 2: 0 to 1). The references are
taken over all documents of the language. A document is rejected by a histogram only if it is long enough
for that histogram to mean something (`MIN_CHARS`, `MIN_WORDS`).

Words are runs of characters other than ASCII white space; null text has none. The base rule fails
documents of fewer than `BASE_WORDS` words, or with over `BASE_REPEAT` of their words in 5-word windows that
the text holds twice or more. Documents whose language is null, or has no words at all, are compared with
every language and judged by the nearest. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import WordHashes, by_batch, grams, table, utf8
from wakeline.sources.scratch import materialize

BASE_WORDS, BASE_REPEAT_PERCENT, REPEAT_WORDS = 10, 20, 5
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.4
COMMON_WORDS = 40
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")


def _class(b: int) -> int:
    """Class of a UTF-8 byte; -1 for bytes that only continue a character."""
    if 0x61 <= b <= 0x7A:
        return 0
    if 0x41 <= b <= 0x5A:
        return 1
    if 0x30 <= b <= 0x39:
        return 2
    if b == 0x20 or 0x09 <= b <= 0x0D:
        return 3
    if b in b".,;:'\"-()?":
        return 4
    if 0x80 <= b <= 0xBF:
        return -1
    return 5 if 0x21 <= b <= 0x7E else 6


CLASS_OF = np.array([_class(b) for b in range(256)])
TO_CLASS = np.stack([CLASS_OF == k for k in range(len(CLASSES))], axis=1).astype(np.int64)
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: A-Z to lower case, ASCII punctuation to spaces: what common words are counted in.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if CLASS_OF[b] in (4, 5) else b for b in range(256))


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def repeat_words(words: list[bytes], hashes: WordHashes, n: int = REPEAT_WORDS) -> int:
    """Words within n-word windows that occur twice or more in the text."""
    if len(words) <= n:
        return 0
    windows = grams(hashes.of(words), n)
    order = np.argsort(windows)
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(windows), np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(windows)] += twice
    edge[n:] -= twice[: len(words) + 1 - n]
    return int((np.cumsum(edge) > 0).sum())


def repeat_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of the same bins; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, min(1.0, terms.sum() / 2))))


COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.binary()), ("n", pa.int64())])


def language_references(docs: DataFrame, common: int = COMMON_WORDS) -> dict[str, dict]:
    """Per language: class counts, the most common words with counts, and the number of words.

    Counted over all documents: per-batch sums, one sum per item, then the top words of each language. What
    reaches the driver is `common` + 8 rows per language.
    """

    def count(batch: pa.RecordBatch) -> list:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
            words.setdefault(lang, Counter()).update(text.translate(PLAIN).split())
            classes[lang] = classes.get(lang, 0) + byte_counts(text) @ TO_CLASS
        rows = [(lang, "class", name.encode(), int(n)) for lang, c in classes.items() for name, n in zip(CLASSES, c)]
        rows += [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
        return [list(c) for c in zip(*rows)] if rows else [[], [], [], []]

    sums = (
        docs.select(F.col("lang").cast("string").alias("lang"), "text")
        .where("lang is not null and text is not null")
        .mapInArrow(by_batch(COUNTS, count), "lang string, kind string, item binary, n long")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("n").alias("n"))
    )
    sums = materialize(sums, "quality-counts")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    top = sums.where("kind = 'word'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= common)
    totals = sums.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n"))
    rows = (
        top.select("lang", "kind", "item", "n")
        .unionByName(sums.where("kind = 'class'"))
        .unionByName(totals.select("lang", F.lit("total").alias("kind"), F.lit(b"").alias("item"), "n"))
        .collect()
    )
    found: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.kind, -r.n, bytes(r.item))):
        one = found.setdefault(r.lang, {"classes": np.zeros(len(CLASSES)), "words": [], "counts": [], "total": 0})
        if r.kind == "class":
            one["classes"][CLASSES.index(bytes(r.item).decode())] = r.n
        elif r.kind == "word":
            one["words"].append(bytes(r.item))
            one["counts"].append(r.n)
        else:
            one["total"] = r.n
    for one in found.values():
        one["hist"] = np.array([*one["counts"], one["total"] - sum(one["counts"])], float)
    return {lang: one for lang, one in found.items() if one["total"]}


ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("class_distance", pa.float64()),
        ("word_distance", pa.float64()),
    ]
)


def judge(docs: DataFrame, references: dict[str, dict] | None = None) -> DataFrame:
    """Counts, distances and verdict of each document row."""
    refs = docs.sparkSession.sparkContext.broadcast(language_references(docs) if references is None else references)
    hashes = WordHashes()

    def distances(lang: str | None, text: bytes, bytes_of: np.ndarray) -> tuple[float, float]:
        known = refs.value
        classes, words = bytes_of @ TO_CLASS, Counter(text.translate(PLAIN).split())
        best = None
        for one in [known[lang]] if lang in known else known.values():
            hist = np.array([words[w] for w in one["words"]], float)
            hist = np.append(hist, words.total() - hist.sum())
            found = distance(classes, one["classes"]), distance(hist, one["hist"])
            best = found if best is None or sum(found) < sum(best) else best
        return best or (0.0, 0.0)

    def rows(batch: pa.RecordBatch) -> list:
        out = []
        for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch, "text")):
            text = text or b""
            words, counts = text.split(), byte_counts(text)
            chars = int(counts[CLASS_OF >= 0].sum())
            repeated = repeat_words(words, hashes)
            failed = len(words) < BASE_WORDS or 100 * repeated > BASE_REPEAT_PERCENT * len(words)
            by_class, by_word = distances(lang, text, counts)
            odd = (
                chars >= MIN_CHARS
                and by_class > MAX_CLASS_DISTANCE
                or len(words) >= MIN_WORDS
                and by_word > MAX_WORD_DISTANCE
            )
            out.append(
                (
                    doc_id,
                    len(words),
                    chars - int(counts[CLASS_OF == 3].sum()),
                    int(counts[IS_SYMBOL].sum()),
                    repeat_lines(text),
                    repeated,
                    failed,
                    not failed and not odd,
                    by_class,
                    by_word,
                )
            )
        return [list(c) for c in zip(*out)]

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, class_distance double, word_distance double"
    )
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return slim.mapInArrow(by_batch(ROWS, rows), schema)


def op3_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
