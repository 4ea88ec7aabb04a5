"""Packing, search and collocations against brute-force forms, and the mended cases of earlier operators."""

from __future__ import annotations

import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import bloom, collocations, common, decontamination, lexical_search, near_dedup, packing, pii, quality_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, rank int, score string, item_id string, piece int"
SPECIAL = [None, "", " \n\t ", "x", "é", "\n\n", "...", ";;", "a,b.c", "Ünïcode STRASSE straße"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = "the of and River stone winter house, light. very common".split()
    rows = []
    for k in range(150):
        text = " ".join(rng.choice(words) + (str(rng.randrange(30)) if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, 60)))
        rows.append((k, text, rng.choice(["en", "de", None]), "s"))
    rows += [(200 + i, t, "en", None) for i, t in enumerate(SPECIAL)]
    rows += [(7, rows[7][1], "en", "s")] * 3 + [(None, rows[8][1], None, "s"), (None, None, None, None), (9, "other text the of", "fr", "s")]
    rows.append((400, "the of and " * 6000, "en", "s"))
    more = (5, 3, 1, "t", "i", 2)
    return spark.createDataFrame([(*r, *more) for r in rows], DOCS)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


# --- packing --------------------------------------------------------------------------------


def plain_best_two_fit(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    left, out = Counter(lengths), []
    while +left:
        held, gap = [], capacity
        while fits := [n for n in +left if n <= gap]:
            n = max(fits)
            held.append(n)
            left[n] -= 1
            gap -= n
        smallest = min(held)
        pairs = [(x + y, -x) for x in +left for y in +left if x <= y and x + y <= gap + smallest and (x < y or left[x] > 1)]
        if pairs and max(pairs)[0] > smallest:
            total, x = max(pairs)
            held.remove(smallest)
            held += [-x, total + x]
            left[smallest] += 1
            left[-x] -= 1
            left[total + x] -= 1
        out.append(tuple(sorted(held)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_packing_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.randrange(3, 40)
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(120))] + [rng.randrange(1, capacity + 1)] * rng.choice([0, 50, 300])
    runs, n = packing.plan(np.bincount(lengths, minlength=capacity + 1))
    bins: dict[int, list[tuple[int, int]]] = {}
    for length, _, repeats, sequence, copies, offset in runs.tolist():
        for i in range(repeats * copies):
            bins.setdefault(sequence + i // copies, []).append((offset + i % copies * length, length))
    for held in bins.values():
        ends = 0
        for at, length in sorted(held):
            assert at == ends
            ends += length
        assert ends <= capacity
    assert n == len(bins)
    assert Counter(tuple(sorted(x for _, x in held)) for held in bins.values()) == Counter(plain_best_two_fit(lengths, capacity))


def test_plan_is_small_and_tight():
    counts = np.bincount(np.minimum(4096, np.random.default_rng(1).lognormal(6.5, 1.2, 500_000).astype(int) + 1), minlength=4097)
    runs, n = packing.plan(counts)
    assert n <= 1.0001 * np.dot(counts, np.arange(4097)) / 4096 + 1
    assert len(runs) < 40_000


def test_words_encode_like_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(vocabulary)
    whole.encode_special_tokens = True
    texts = [t or "" for t in SPECIAL] + [
        "a\x0bb\x0cc\rd\te f", "x\x1cy\x1dz\x85w\xa0v", "é á;; H̱ ẖ, ΑΣ Σ", "<|endoftext|> a<|startoftext|>b", "don't we'll 's",
        "İstanbul ǅ ﬁ ſ ı", "日本 語\n42nd", "Abc.,; x...y A.(b) with*** ÈÉ, àé÷", "Q" * 5000,
    ]
    encoder = packing.WordIds(vocabulary)
    for text in texts:
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == want, text


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pieces_hold_every_document(spark, docs, vocabulary, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(vocabulary)
    packed = packing.pack(docs, vocabulary, capacity)
    rows = packed.withColumn("crc", F.crc32("ids")).collect()
    want: Counter = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[r.doc_id, k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in rows) == want
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        assert [at for at, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= capacity
    assert len(bins) == len(plain_best_two_fit([r.length for r in rows], capacity))
    whole_rows = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole_rows) and len(whole_rows) == len(bins)
    assert packing.pack(docs.limit(0), vocabulary, capacity).count() == 0


# --- search ---------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []


def plain_search(docs: list[tuple], items: list[tuple], top: int) -> Counter:
    counts = [(doc_id, Counter(terms(t))) for doc_id, t in docs if terms(t)]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries: dict = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms(text))
    out: Counter = Counter()
    for item, query in queries.items():
        scores = []
        for doc_id, c in counts:
            m = 100 - 75 + 75 * c.total() * n_docs // length
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, k in query.items()
                if c[t]
            )
            if score:
                scores.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1):
            out[item, rank, doc_id, -score] += 1
    return out


ITEMS = [(1, "the of River"), (1, "stone stone"), (2, "winter"), (None, "house light light"), (3, None), (4, ""), (5, "nowhere"), (6, "STRASSE é a")]


@pytest.mark.parametrize("top,chars,cells", [(10, 2_000_000, 2_000_000), (3, 20, 7), (1000, 40, 100)])
def test_search_equals_scoring_all(spark, docs, monkeypatch, top, chars, cells):
    monkeypatch.setattr(lexical_search, "STEP_CELLS", cells)
    bench = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    found = lexical_search.search(docs.repartition(5), bench, top, chars)
    got = Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()))
    assert got == plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], ITEMS, top)
    assert lexical_search.search(docs.limit(0), bench).count() == 0
    assert lexical_search.search(docs, bench.limit(0)).count() == 0


# --- collocations ---------------------------------------------------------------------------


def plain_phrases(docs: list[tuple], longest: int, least: int) -> dict:
    counts: Counter = Counter()
    size: Counter = Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            size[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(g == lang and len(q) > len(p) and b >= a and inside(q) for (g, q), b in found.items()):
            continue
        cuts = [(1000 * a * size[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, " ".join(p)] = (a, counts[lang, p[:k]], counts[lang, p[k:]], size[lang], score)
    return out


@pytest.mark.parametrize("longest,least,held", [(5, 100, 500_000), (5, 8, 40), (3, 5, 500_000), (2, 8, 500_000)])
def test_phrases_equal_counting_all(spark, docs, monkeypatch, longest, least, held):
    monkeypatch.setattr(collocations, "TASK_PHRASES", held)
    monkeypatch.setattr(collocations, "STEP_TOKENS", held)
    want = plain_phrases([tuple(r) for r in docs.select("lang", "text").collect()], longest, least)
    rows = collocations.collocations(docs.repartition(4), longest, least).collect()
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in rows} == want
    assert len(rows) == len(want) > 0


def test_top_phrases_and_no_rows(spark, docs):
    want = plain_phrases([tuple(r) for r in docs.select("lang", "text").collect()], 5, 8)
    rows = collocations.top_collocations(docs, 4, 5, 8).collect()
    for lang in {g for g, _ in want}:
        order = sorted((-v[4], -v[0], p.encode()) for (g, p), v in want.items() if g == lang)[:4]
        assert [r.phrase.encode() for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r["rank"])] == [p for *_, p in order]
    assert collocations.top_collocations(docs.limit(0)).count() == 0


def test_scores_past_64_bits(spark):
    """Counts of a corpus of 10^13 words: the product of counts needs more than 64 bits."""
    a, n, left, right = 4 * 10**11, 10**13, 5 * 10**11, 6 * 10**11
    row = spark.createDataFrame([(a, n, left, right)], "a long, words long, l long, r long")
    assert row.select(F.expr(collocations.SCORE)).first()[0] == 1000 * a * n // (left * right)


class Captured:
    """In place of a frame: keeps the function that a worker would run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_a_worker_holds_phrases_as_numbers():
    """All phrases pass the filters, and nearly all differ."""
    everything = SimpleNamespace(value=np.full(bloom.BLOCK_BITS // 8, 255, np.uint8))
    texts = [" ".join(f"w{(k * 7919 + i * i) % 3000}" for i in range(1200)) for k in range(25)]
    batch = pa.record_batch([pa.array(["en"] * 25), pa.array(texts)], names=["lang", "text"])
    frame = Captured()
    collocations.partial_stripes(frame, (everything, everything, 100_000), 5)
    tracemalloc.start()
    rows = total = 0
    for out in frame.run(iter([batch])):
        rows += out.num_rows
        total += int(out.column(5).flatten().flatten().to_numpy().sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(1200 - n + 1 for n in range(1, 6)) * 25 and rows > 100
    assert peak < 50e6  # 35 MB; as counters of texts 78 MB


def test_tokens_of_all_langs_count_together(monkeypatch):
    monkeypatch.setattr(collocations, "STEP_TOKENS", 100)
    batch = pa.record_batch([pa.array([f"l{k % 40}" for k in range(80)]), pa.array(["a b c d"] * 80)], names=["lang", "text"])
    found = list(collocations._by_lang(batch))
    assert Counter(t for _, tokens in found for t in tokens) == {b: 80 for b in (b"a", b"b", b"c", b"d", b";")}
    # 20 texts reach the limit; before, 80 texts of 40 langs were held to the end of the batch
    assert max(map(len, (tokens for _, tokens in found))) == 5 and len(found) == 80


# --- mended cases ---------------------------------------------------------------------------


def test_passes_hand_small_batches_to_workers(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 100_000)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 100).alias("text"))

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    before = spark.conf.get(common.BATCH_CONF)
    with common.small_batches(spark):
        found = [r.n for r in rows.mapInArrow(size, "n long").collect()]
    assert sum(found) == 4000 and max(found) <= 120 and spark.conf.get(common.BATCH_CONF) == before
    seen = []
    write = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda *a: seen.append(spark.conf.get(common.BATCH_CONF)) or write(*a))
    texts = spark.createDataFrame([(k, "one two three four five six " * 3) for k in range(5)], "doc_id long, text string")
    assert {r.class_id for r in near_dedup.near_duplicates(texts).collect()} == {0}
    assert set(seen) == {"100000"} and spark.conf.get(common.BATCH_CONF) == before


def test_decontamination_reads_a_slice_of_a_batch_at_a_time():
    frame = Captured()
    frame.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    item = " ".join(f"i{k}" for k in range(13))
    texts = ["x" * 20_000] * 999 + [f"a {item} b"]
    batch = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "row", "text"])
    decontamination._scan(frame, [("q", item)], 13)
    tracemalloc.start()
    (out,) = frame.run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["spans"].to_pylist() == [[]] * 999 + [[{"start": 1, "end": 14}]]
    assert peak < 5e6  # before: 20 MB of texts


def test_word_parts_keep_places_in_one_array(monkeypatch):
    words = [f"Word{k},".encode() for k in range(30_000)]
    tracemalloc.start()
    parts = quality_model.WordParts()
    both = parts.of(words * 2)
    held = tracemalloc.get_traced_memory()[0] - both.nbytes
    tracemalloc.stop()
    assert both.tolist() == [list(quality_model.word_parts(w)) for w in words] * 2
    assert held < 120 * len(words)  # before: a tuple and two numbers more a word
    monkeypatch.setattr(quality_model, "CACHE_WORDS", 10)
    again = parts.of(words[5:9])
    assert len(parts) == 4 and again.tolist() == both[5:9].tolist()


def test_broadcast_phrases_are_plain_values():
    tables = vars(decontamination.Phrases([("a", "one two three"), (None, "four")], 13))
    assert b"wakeline" not in pickle.dumps(tables)


def test_entities_of_few_forms_end(spark):
    rows = [(f"write to {c}@example.org",) for c in "abcdefghijklmnopqrstuvwxyzé"] + [(f"call {c}@x.org",) for c in "abcdef"]
    df = spark.createDataFrame(rows, "text string")
    found = [r.text.split()[-1] for r in pii.replace_entities(df, "k").select("_private.text").collect()]
    addresses = {t.split()[-1] for (t,) in rows if "é" not in t}
    assert len(set(found)) == len(found) and not addresses & set(found)


def test_a_key_is_required(spark):
    with pytest.raises(ValueError, match="key"):
        pii.replace_entities(spark.createDataFrame([("a@b.org",)], "text string"))


def test_many_spans_and_names_in_one_text():
    text = " ".join(f"Mr Smith wrote to user{k}@mail.org" for k in range(20_000))
    found = pii.find_entities(text)
    assert len(found) == 40_000


@pytest.fixture(scope="module")
def pipeline_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    hit = " ".join(f"bench{k}" for k in range(20))
    spark.createDataFrame([(1, hit)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, hit


def test_stages_decide_by_row(spark, pipeline_dir):
    path, hit = pipeline_dir
    copy = " ".join(f"word{k}" for k in range(40))
    clean = " ".join(f"clean{k}" for k in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    copies = frame([(1, copy), (1, copy), (None, copy), (None, copy), (3, copy), (3, clean), (None, None), (None, None)])
    left = corpus_pipeline.near_duplicates(spark, copies, path)
    assert left.columns == copies.columns
    assert Counter(r.text for r in left.collect()) == {copy: 1, clean: 1, None: 2}
    dirty = frame([(None, hit), (1, hit), (2, clean), (2, hit), (None, clean), (None, None)])
    stay = corpus_pipeline.decontaminate(spark, dirty, path).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in stay) == [(0, ""), (0, clean), (2, clean)]
