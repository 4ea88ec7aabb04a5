"""Language identification by cross-parsing.

A suffix automaton of labelled running text is built per language. A text is parsed greedily against each
automaton: a phrase is the longest match from where the last one ended, across words. The cross-parsing entropy
of a language is phrases * log2(labelled bytes) / bytes; the lowest wins, ties go to the smaller name.
Text is taken as its words (runs of letters, lower-cased) with a space before, between and after them, in UTF-8.

Training takes whole documents that are not held out, of those drawn by hash, longer ones last: per language at
most `TRAIN_DOCS`, while they have at most `TRAIN_CHARS` characters together, and at most `ALL_CHARS` for all
languages. These are documented bounds on the sample of labelled rows; no row is cut. The `LANGUAGES` most
frequent values of lang are learned. A language that has only texts beyond its bound is not learned.
Prediction reads every text as a whole: a batch of texts is parsed side by side, a byte of each at a time.

Null text, and text without a letter: `und`, score 0; so is everything if nothing could be learned.
The score is the runner-up's entropy over the sum of both: 0.5 for a tie; 1 if only one language is known.
A null doc_id is not held out and is not learned from.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import crc_mod, table

TRAIN_DOCS, TRAIN_CHARS = 100, 80_000
ALL_CHARS, LANGUAGES, DRAWN = 320_000, 64, 8
HELD_OUT = (4, 2)
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes of text that are parsed side by side; fewer texts than FEW are parsed one by one.
SIDE_BY_SIDE, FEW = 16_000_000, 24
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


def running(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


def suffix_automaton(text: str) -> dict[int, int]:
    """Transitions of the smallest automaton of all substrings in UTF-8: state * 256 + byte -> state."""
    links, lengths, moves = [-1], [0], [{}]
    last = 0
    for ch in text.encode():
        new = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        moves.append({})
        p = last
        while p >= 0 and ch not in moves[p]:
            moves[p][ch] = new
            p = links[p]
        if p >= 0:
            q = moves[p][ch]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                clone = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(ch) == q:
                    moves[p][ch] = clone
                    p = links[p]
                links[q] = links[new] = clone
        last = new
    return {s * 256 + ch: t for s, out in enumerate(moves) for ch, t in out.items()}


class Parser:
    """Counts the phrases of texts against the automata of several languages.

    All automata share one table, a row per state and a column per byte in use; 0 is no transition.
    """

    def __init__(self, models: list[tuple]) -> None:
        used = np.unique(np.concatenate([keys & 255 for _, _, keys, _ in models]))
        self.codes = np.zeros(256, np.uint8)
        self.codes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        states = [int(targets.max()) + 1 for *_, targets in models]
        self.roots = 1 + np.concatenate(([0], np.cumsum(states)[:-1])).astype(np.int64)
        self.table = np.zeros((1 + sum(states)) * self.width, np.int32)
        for root, (_, _, keys, targets) in zip(self.roots, models):
            self.table[(root + (keys >> 8)) * self.width + self.codes[keys & 255]] = root + targets

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Phrases by text and language. A byte that a language lacks is a phrase."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        data = self.codes[np.frombuffer(b"".join(texts[k] for k in order), np.uint8)]
        size = size[order]
        first = np.cumsum(size) - size
        found = np.zeros((len(self.roots), len(texts)), np.int64)
        state = np.repeat(self.roots[:, None], len(texts), axis=1)
        at = 0
        while (n := int(np.searchsorted(-size, -at))) >= FEW:
            now, code = state[:, :n], data[first[:n] + at]
            step = self.table[now * self.width + code].astype(np.int64)
            lang, text = np.nonzero(step == 0)
            root = self.roots[lang]
            again = self.table[root * self.width + code[text]].astype(np.int64)
            found[lang, text] += (now[lang, text] != root).astype(np.int64) + (again == 0)
            step[lang, text] = np.where(again == 0, root, again)
            state[:, :n] = step
            at += 1
        for k in range(n):  # the longest texts
            rest = data[first[k] + at : first[k] + size[k]].tobytes()
            for lang, root in enumerate(self.roots.tolist()):
                more, state[lang, k] = self._rest(rest, int(state[lang, k]), root)
                found[lang, k] += more
        found += state != self.roots[:, None]
        out = np.empty((len(texts), len(self.roots)), np.int64)
        out[order] = found.T
        return out

    def _rest(self, codes: bytes, state: int, root: int) -> tuple[int, int]:
        table, width, count = memoryview(self.table), self.width, 0
        for code in codes:
            step = table[state * width + code]
            if not step:
                count += state != root
                step = table[root * width + code]
                if not step:
                    count += 1
                    step = root
            state = step
        return count, state


def model(lang: str, text: str) -> tuple[str, int, np.ndarray, np.ndarray]:
    moves = suffix_automaton(text)
    keys, targets = np.fromiter(moves.keys(), np.int64, len(moves)), np.fromiter(moves.values(), np.int32, len(moves))
    return lang, len(text.encode()), keys, targets


def phrases(word: str, moves: dict[int, int]) -> int:
    """Phrases of a word with a space on either side."""
    keys, targets = np.array(list(moves), np.int64), np.array(list(moves.values()), np.int32)
    return int(Parser([("", 1, keys, targets)]).count([f" {word} ".encode()])[0, 0])


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(lang, text): the labelled rows to learn from, whole."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    mod, rest = HELD_OUT
    usable = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != rest) & F.col("doc_id").isNotNull()
    rows = rows.where(usable & F.col("lang").isNotNull() & F.length("text").between(1, chars))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return rows.limit(0).select("lang", "doc_id", "text")
    chars = min(chars, ALL_CHARS // len(counts))
    # A draw by hash leaves about DRAWN times the rows wanted of each language, so what is ordered does not grow.
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, DRAWN * per_language / r.n)))])
    drawn = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    slim = (
        rows.select("lang", "doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("digest"))
        .where((F.col("size") <= chars) & (drawn < share[F.col("lang")]))
        .dropDuplicates(["lang", "doc_id", "digest"])
    )
    whole = Window.partitionBy("lang").orderBy(F.col("size") > chars // 8, F.xxhash64("doc_id"), "doc_id", "digest")
    chosen = (
        slim.withColumn("rank", F.row_number().over(whole))
        .withColumn("sum", F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("rank") <= per_language) & (F.col("sum") <= chars))
        .select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
    )
    same = (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_digest"))
    return rows.join(F.broadcast(chosen), same).dropDuplicates(["lang", "doc_id", "_digest"]).select("lang", "doc_id", "text")


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, bytes, transition keys, transition targets), by language.

    What reaches the driver is bounded by ALL_CHARS: an automaton has under 3 transitions a byte.
    """

    def build(key: tuple, part: pa.Table) -> pa.Table:
        texts = [t for _, t in sorted(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()))]
        lang, size, keys, targets = model(key[0].as_py(), running([w for t in texts for w in words_of(t)]).decode())
        return pa.Table.from_pydict(
            {"lang": [lang], "size": [size], "keys": [keys.tobytes()], "targets": [targets.tobytes()]},
            schema=pa.schema([("lang", pa.string()), ("size", pa.int64()), ("keys", pa.binary()), ("targets", pa.binary())]),
        )

    found = sample(docs, per_language, chars).groupBy("lang").applyInArrow(build, "lang string, size long, keys binary, targets binary").collect()
    return [
        (r.lang, r["size"], np.frombuffer(r["keys"], np.int64), np.frombuffer(r["targets"], np.int32))
        for r in sorted(found, key=lambda r: r.lang)
        if r["size"] > 2
    ]


def predictions(texts: list[str | None], models: list[tuple], parser: Parser | None) -> list[tuple[str, float]]:
    """(lang_pred, score) of each text."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    part: list[tuple[int, bytes]] = []

    def parse() -> None:
        for (k, _), counts in zip(part, parser.count([t for _, t in part]).tolist()):
            bits = [n * math.log2(size + 1) for n, (_, size, *_) in zip(counts, models)]
            order = sorted(range(len(bits)), key=lambda i: (bits[i], models[i][0]))
            best, second = bits[order[0]], bits[order[-1 if len(order) == 1 else 1]]
            out[k] = models[order[0]][0], 1.0 if len(order) == 1 else second / (best + second)
        part.clear()

    held = 0
    for k, text in enumerate(texts):
        if parser and (words := words_of(text)):
            part.append((k, running(words)))
            held += len(part[-1][1])
            if held >= SIDE_BY_SIDE:
                parse()
                held = 0
    if part:
        parse()
    return out


def identify(docs: DataFrame, models: list | None = None, into: str = "_language") -> DataFrame:
    """`docs` with a struct column: lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs) if models is None else models)
    ready: list = []  # made in the worker, so that it does not travel with the function

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        if not ready:
            ready.append(Parser(sent.value) if sent.value else None)
        return pd.DataFrame(predictions(texts.tolist(), sent.value, ready[0]), columns=["lang_pred", "score"])

    return docs.withColumn(into, language(F.col("text")))


def held_out() -> Column:
    return crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "_language.lang_pred", "_language.score")
