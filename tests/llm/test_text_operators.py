"""Each operator against a brute-force form, on texts with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import (
    bloom,
    common,
    components,
    decontamination,
    fm_index,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    page_text,
    pii,
    quality_model,
    quality_rules,
    registry,
    substring_dedup,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept string, label int, rank int"
PASSAGE = " ".join(f"shared{k}" for k in range(30))
COMMON = "  A line that Many documents share, again and again.\t"


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = {
        "en": "the of and to in is that for with on this be are by it from river house stone winter".split(),
        "de": "der die und das ist nicht mit ein von zu den auf für Straße Winter Haus über grün".split(),
    }

    def prose(lang: str, n: int) -> str:
        return " ".join(rng.choice(vocabulary[lang]) + (f"{lang}{rng.randrange(400)}" if rng.random() < 0.6 else "") for _ in range(n))

    out: list[str | None] = [None, "", " \n\t ", "x", "é", "\n\n", "two words"]
    base = prose("en", 150)
    words = base.split()
    out += [base, base, base.replace(" ", "  "), " ".join(words[:75] + ["changed"] + words[76:]), " ".join(["more", *words])]
    out += [f"{prose('en', 40)} {PASSAGE} {prose('de', 40)}" for _ in range(5)]
    out += [f"{COMMON}\n{prose('de', 30)}\n{COMMON.strip().upper()}\nshort" for _ in range(6)]
    out += ["again and again " * 60, "again and again " * 61, "a b c d " * 9]
    out += [prose("en" if k % 2 else "de", 60 + k) for k in range(30)]
    out += ["THE!!! $$$ ### | %% " * 40, "Ünï çødé 字字字字 " * 30, prose("en", 4000) + "\n" + COMMON]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [
        (k, t, None if k % 11 == 5 else "de" if t and re.search(" (und|der|die|nicht)", t) else "en", None if k % 7 == 3 else f"src{k % 4}", len(t or ""), "x", "y", "z", k, k)
        for k, t in enumerate(texts())
    ]
    return found + [found[8], found[0]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_blocked_filter_keeps_every_repeat(spark):
    from wakeline.llm.common import mix

    values = [k for k in range(3000)] + [k for k in range(0, 3000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)

    def h(batch):
        return mix(batch.column(0).to_numpy().view(np.uint64))

    bits = bloom.twice_filter(df, h, 2)
    found = bloom.suspected(bits, mix(np.arange(3000, dtype=np.uint64)))
    assert found[::7].all() and found.mean() < 0.25
    assert not bloom.twice_filter(df.where("v < 0"), h, 2).any()


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(2, 6, 3000), 0)
    text[1000:1400] = 2
    index = fm_index.FMIndex(text)
    phrases = np.array([text[k : k + 4] for k in range(0, 2000, 37)] + [[9, 9, 9, 9], [2, 2, 2, 9]])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        expected = [k for k in range(len(text) - 3) if (text[k : k + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == expected


def test_components_of_chain_and_star(spark):
    chain = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(139, 200)]
    found = {r.node: r.label for r in components.smallest_in_component(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(21)} | {k: 100 for k in [*range(100, 140), 200]}
    assert components.smallest_in_component(spark.createDataFrame([], "a long, b long")).count() == 0


# 1
def test_pages(spark):
    long = "Some prose that goes on for a while, and then ends with a full stop. " * 3
    page = (
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>{long}</div>"
        f"<article><h1>A &amp; B</h1><p>One&nbsp;two\n three <script>var x='</p>';</script>four<p>{long}<p>Er.</p><div class=ad>{long}</div></article>"
        f"<section class=comments><div class=comment><p>{long}</p></div></section><form><p>{long}</p></form><footer>{long}</footer>"
    )
    expected = f"A & B\n\nOne two three four\n\n{long.strip()}\n\nEr."
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page), (4, "u", "<p><b")], "page_id long, url string, html string")
    found = page_text.extract_text(df.withColumn("text", F.lit(1))).select("page_id", "_page.*").collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in found) == sorted(
        [(1, expected, len(expected))] * 2 + [(2, "", 0), (3, "", 0), (4, "", 0)]
    )
    assert page_text.extract_text(df.limit(0)).count() == 0


def test_page_model_separates_labelled_pages():
    weights, ties = page_text.train()
    wrong = total = 0
    for page in page_text.PAGES:
        nodes = page_text.parse(page)
        chances, _ = page_text.marginals(nodes, [sum(weights.get(f, 0.0) for f in page_text.features(x)) for x in nodes], ties)
        leaves = [(x.label, p) for x, p in zip(nodes, chances) if x.text]
        total += len(leaves)
        wrong += sum((p > 0.5) != bool(label) for label, p in leaves)
    assert wrong <= 0.02 * total


def test_marginals_agree_with_enumeration():
    from itertools import product
    from math import exp

    nodes = page_text.parse("<div><p>one two</p><ul><li>x</li></ul></div>")
    scores = [0.3 * k - 0.5 for k in range(len(nodes))]
    ties = [[[0.2, -0.4], [0.1, 0.7]], [[0.5, 0.0], [-0.3, 0.4]], [[0.0, 0.3], [0.2, -0.1]]]
    total, one = 0.0, [0.0] * len(nodes)
    for y in product((0, 1), repeat=len(nodes)):
        w = exp(sum(s * v for s, v in zip(scores, y)) + sum(ties[n.kind][y[n.parent]][y[k]] for k, n in enumerate(nodes) if k))
        total += w
        one = [a + w * v for a, v in zip(one, y)]
    found, _ = page_text.marginals(nodes, scores, ties)
    assert found == pytest.approx([a / total for a in one])


# 2
def test_surrogates(spark):
    text = (
        "Mrs. Sarah Connor (sarah.c@mail.example.com, SARAH.C@MAIL.EXAMPLE.COM) called +1 (487) 555-7209 and 487-555-7209; "
        "card 4111 1111 1111 1111 from 152.143.123.131, password=b7db7aa4a5fcc78305. Connor met г-жа Иванова."
    )
    df = spark.createDataFrame([(1, text), (2, "x 152.143.123.131 y"), (3, "clean 12 text"), (4, None), (5, ""), (1, text)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.replace_entities(df.withColumn("kind", F.lit(1)), "k").select("doc_id", "_private.*").collect()}
    new = found[1].text
    assert found[3].text == "clean 12 text" and found[4].text is None and found[5].text == ""
    for old in ("Sarah", "Connor", "sarah.c", "555", "4111", "1111 1111", "152.143.123.131", "b7db7aa4a5fcc78305", "Иванова"):
        assert old not in new
    a, b = re.findall(r"[\w.]+@[\w.]+", new)
    assert b == a.upper() and a.endswith(".com")
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", new)
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0])[-10:] == re.sub(r"\D", "", phones[1])
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", new)[1].replace(" ", "")
    assert card[0] == "4" and pii.luhn_digit(card[:-1]) == card[-1]
    assert re.search(r"from ([\d.]+),", new)[1] == re.search(r"x ([\d.]+) y", found[2].text)[1]
    names = re.search(r"Mrs\. (\S+) (\S+) \(", new)
    assert names[1][-1] == "a" and f"{names[2]} met г-жа" in new and re.search(r"г-жа [А-Я][а-я]+\.", new)
    assert pii.replace_entities(df.limit(0), "k").count() == 0


def test_surrogates_are_drawn_again_on_collision(spark, monkeypatch):
    def small(key, kind, value, attempt=0):  # as a module function it is pickled with the tasks
        return f"10.0.0.{(sum(map(ord, value)) + 7 * attempt) % 40}"

    monkeypatch.setattr(pii, "substitute", small)
    df = spark.createDataFrame([(k, f"at 10.0.{k}.1") for k in range(12)] + [(99, "is 10.0.0.9")], "doc_id long, text string")
    found = [r.text for r in pii.replace_entities(df, "k").select("_private.text").collect()]
    drawn = [t.split()[1] for t in found]
    assert len(set(drawn)) == 13 and "10.0.0.9" not in drawn


@pytest.mark.parametrize("text", ["“Mr Smith left.”", "by Mr\u00a0Smith.", "—Anna Miller—", "‘Anna Miller’", "Jean-Luc Picard", "x…Dr. Weber", "«г-жа Иванова»", "non-Anna Miller", "(г-н\u00a0Иванов)", "x\u2028Maria Weber"])
def test_names_are_found_next_to_any_separator(text):
    spans = [m.span("a" if m["a"] else "b") for m in pii.PERSON.finditer(text)]
    assert spans
    found = [(a, b) for a, b, _, _ in pii.find_entities(text)]
    assert all(any(a <= k < b for a, b in found) for start, end in spans for k in range(start, end) if text[k].isalpha())


def test_names_are_found_wherever_the_pattern_matches():
    assert [(a, b) for a, b, _, _ in pii.find_entities("met Jean-Luc Picard")] == [(4, 12), (13, 19)]
    names = [n for g in (pii.TITLES, pii.GIVEN) for names in g.values() for n in names.split()]
    for name in names:
        for before in ("", " ", "-", "“", "—", "\u00a0", "'", "\u200b", "é "):
            for after in (" ", "\u00a0", ". "):
                text = f"{before}{name}{after}Smith”"
                assert bool(pii.find_entities(text)) == bool(pii.PERSON.search(text))


# 3
def rule_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    cover = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_quality_rules(docs, rows, nothing):
    found = quality_rules.judge(docs).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    expected = []
    for r in rows:
        c = rule_counts(r[1])
        expected.append((r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(expected)
    verdict = {r.doc_id: r.kept for r in found}
    junk = next(r[0] for r in rows if r[1] and r[1].startswith("THE!!!"))
    assert not verdict[junk] and verdict[7] and not verdict[1]
    assert quality_rules.judge(nothing).count() == 0


def test_quality_rules_reject_by_distribution(spark):
    rng = random.Random(2)
    clean = [(k, " ".join(rng.choice(["the", "of", "and", *(f"w{rng.randrange(9999)}x" for _ in range(5))]) for _ in range(150)) + ".", "en") for k in range(60)]
    odd = (99, " ".join(f"W{rng.randrange(9999)}$$$" for _ in range(150)), "en")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame([*clean, odd], "doc_id long, text string, lang string")).collect()}
    assert not kept.pop(99) and all(kept.values())


# 4
ASCII_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text: str | None) -> list[str]:
    return ASCII_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark, docs, rows, nothing):
    source = {r[0]: r[1] for r in rows}
    items = [("a", PASSAGE), ("b", "again and"), ("c", " ".join(source[7].split()[20:50])), ("d", None), ("e", "..."), ("f", "nowhere"), ("b2", "Again, AND")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, doc_id string")
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    expected = []
    for r in rows:
        w, hit, hits = plain_words(r[1]), set(), set()
        for p, its in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    hits |= its
        expected.append((r[0], len(w), len(hit), sorted(hits), bool(hit) and 20 * len(hit) >= len(w)))
    for chars in (decontamination.BLOCK_CHARS, 150):
        decontamination.BLOCK_CHARS, old = chars, decontamination.BLOCK_CHARS
        got = decontamination.find_contamination(docs.dropDuplicates(["doc_id"]), bench).collect()
        decontamination.BLOCK_CHARS = old
        assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got) == sorted({e[0]: e for e in expected}.values())
    assert decontamination.find_contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontamination.find_contamination(nothing, bench).count() == 0


def test_blocks_of_the_benchmark_keep_every_document_row(spark, monkeypatch):
    texts_of = [f"x {PASSAGE} y", "again and more words", f"{PASSAGE} again and", None]
    rows = [(k, t) for k in (None, 1, 2) for t in texts_of] + [(1, texts_of[0]), (None, texts_of[1])]
    bench = spark.createDataFrame([("a", PASSAGE), ("b", "again and"), ("c", "nowhere else"), ("d", "more words")], "item_id string, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = []
    for chars in (decontamination.BLOCK_CHARS, 30):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", chars)
        found = decontamination.find_contamination(df, bench)
        assert found.columns == ["doc_id", "n_words", "spans", "items", "n_hit", "contaminated"]
        got.append(sorted((r.doc_id or 0, r.n_words, [(s.start, s.end) for s in r.spans], sorted(r["items"]), r.n_hit, r.contaminated) for r in found.collect()))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert sorted(set(x[4] for x in got[0])) == [0, 4, 30, 32]


def test_items_without_an_id_are_one_item_spread_over_the_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([("a", "one two three"), *((None, f"lone{k} word") for k in range(40))] * 2, "item_id string, text string")
    df = spark.createDataFrame([(1, "one two three lone7 word lone8 word"), (2, "lone9 word")], "doc_id long, text string")
    scan, sizes = decontamination._scan, []
    monkeypatch.setattr(decontamination, "_scan", lambda docs, items, window: sizes.append(len(items)) or scan(docs, items, window))
    for chars, blocks in ((decontamination.BLOCK_CHARS, 1), (150, 3)):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", chars)
        sizes.clear()
        found = {r.doc_id: (r["items"], r.n_hit) for r in decontamination.find_contamination(df, bench).collect()}
        assert {k: (set(v), len(v), n) for k, (v, n) in found.items()} == {1: ({"a", None}, 2, 7), 2: ({None}, 1, 2)}
        assert len(sizes) == blocks and sum(sizes) == 41 and (blocks == 1 or max(sizes) < 30)


# 5
def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], 1 if r[0] % 5 else 0, "q") for r in rows] + [(None, 1, "q"), (3, None, "q")], "doc_id long, quality int, text string")


def test_quality_model(spark, nothing):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "river", "of", f"w{rng.randrange(200)}"]) for _ in range(60)) for _ in range(90)]
    bad = [" ".join(rng.choice(["BUY", "NOW!!", "$$$", f"w{rng.randrange(200)}"]) for _ in range(60)) for _ in range(60)]
    rows = [(k, t, 1) for k, t in enumerate(good)] + [(100 + k, t, 0) for k, t in enumerate(bad)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(500, None), (501, ""), (502, "x " * 50_000)], "doc_id long, text string").withColumn("quality", F.lit("no"))
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_model.score_quality(docs, labels).withColumn("out", quality_model.held_out()).collect()}
    assert all(0 <= r._score <= 1 for r in found.values()) and found[500]._score == found[501]._score
    held = [(found[k]._score >= 0.5) == bool(q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(held) > 20 and sum(held) >= 0.95 * len(held)
    assert all(r.out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in found.items())
    assert quality_model.score_quality(nothing, labels).count() == 0
    assert {r._score for r in quality_model.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_trainers_keep_counts_and_train_on_the_same_values():
    parts = quality_model.WordParts()
    made = [(PASSAGE + " The x, the Y! " * 20).encode(), COMMON.encode(), b"x", b" ", None]
    kept = [(*quality_model.counted(t, parts), float(k % 2)) for k, t in enumerate(made)]
    full = [(*quality_model.features(t, parts), float(k % 2)) for k, t in enumerate(made)]
    samples = quality_model.Samples(kept)
    assert sum(a.nbytes for sample in kept for a in sample[:2]) * 2 <= sum(8 * len(i) + v.nbytes for i, v, _ in full)
    for _ in range(2):
        for (i, v, label), (j, w, other) in zip(samples, full, strict=True):
            assert np.array_equal(i, j) and np.array_equal(v, w) and label == other
    assert np.array_equal(quality_model.follow_leader(samples), quality_model.follow_leader(full))


def test_held_out_labels_are_not_used(spark, docs, rows):
    labels = labels_of(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_model.train(docs, labels) == quality_model.train(docs, other)).all()


# 6
def fill(sizes: dict, weights=(5, 2, 1)) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_fair_mix(docs, rows, nothing):
    found = mixing.fair_mix(docs).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    expected = fill(sizes)
    taken: Counter = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source], abs=1e-5)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(found) == len(rows) and all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    again = mixing.fair_mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
    assert mixing.fair_mix(nothing).count() == 0
    assert {r.taken for r in mixing.fair_mix(docs.where("text is null or text = ''")).collect()} == {0}


# 7
def test_substring_dedup(docs, rows, nothing):
    by_id = {r[0]: WORD.findall(r[1] or "") for r in rows}
    seen, expected = set(), {}
    for k in sorted(by_id):
        w, gone = by_id[k], set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        expected[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    found = substring_dedup.drop_passages(docs).select("doc_id", "text", "_passages.n_words", "_passages.n_removed", F.col("_passages.text").alias("left"), "_passages.factors").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, r.left) == expected[r.doc_id]
        for f in r.factors:
            assert f.end - f.start >= 20 and by_id[r.doc_id][f.start : f.end] == by_id[f.ref_doc][f.ref_start : f.ref_start + f.end - f.start]
            assert (f.ref_doc, f.ref_start) < (r.doc_id, f.start)
    assert substring_dedup.drop_passages(nothing).count() == 0
    tight = substring_dedup.drop_passages(docs, blocks=1).select("doc_id", "_passages.n_removed").collect()
    assert all(r.n_removed == expected[r.doc_id][1] for r in tight)


def test_texts_are_parsed_side_by_side(monkeypatch):
    rng = random.Random(11)
    made = [" ".join(rng.choices("ab", k=rng.randrange(15, 70))) for _ in range(300)] + [None, "", "a b c " * 20, "x " * 60]
    batch = pa.RecordBatch.from_pydict({"text": made})
    calls = []

    def counted(words, n):
        calls.append(n)
        return common.grams(words, n)

    def all_runs():
        out = []
        for some, row in substring_dedup.parsed(batch):
            edge, size = some.runs()
            seed, a, twin = substring_dedup.runs_of(some, edge, size)
            out += zip(row[some.text[edge]].tolist(), some.start[edge].tolist(), size.tolist(), seed.tolist(), a.tolist(), twin.tolist())
        return out

    monkeypatch.setattr(substring_dedup, "grams", counted)
    together = all_runs()
    assert len(calls) < 10
    monkeypatch.setattr(substring_dedup, "SIDE_BY_SIDE", 1)
    assert all_runs() == together
    for k, text in enumerate(made):
        words = (text or "").split()
        windows = [tuple(words[i : i + 20]) for i in range(len(words) - 19)]
        mine = [r for r in together if r[0] == k]
        assert [i for _, start, n, *_ in mine for i in range(start, start + n)] == list(range(len(windows)))
        for _, start, n, _, _, twin in mine:
            assert twin == (len(set(windows[start : start + n])) < n)


def test_texts_that_lose_no_passage_pass_one_worker(docs):
    """The filter's, as for lines."""
    plan = substring_dedup.drop_passages(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("kept(" in x for x in plan.splitlines() if "ArrowEvalPython" in x) == 1


def test_texts_that_lose_no_passage_keep_all_their_words(spark):
    made = [None, "", " ", "\t a  b\x0b\x0cc\r\n", "é\u00a0b \x1f \u2003 x", " ".join(f"w{k}" for k in range(30))]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in substring_dedup.drop_passages(df).collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        assert tuple(r._passages) == (len(words), 0, " ".join(words), [])


def test_workers_of_a_seed_hold_one_filter(spark, monkeypatch):
    """The filter of contested seeds holds no more than that of repeated ones, so one of them does."""
    held, plain = [], bloom.twice_filter

    def kept(*args):
        held.append(plain(*args))
        return held[-1]

    sent = []
    monkeypatch.setattr(bloom, "twice_filter", kept)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, f=type(spark.sparkContext).broadcast: (sent.append(value), f(self, value))[1])
    w = [f"w{k}" for k in range(60)]
    made = [(1, " ".join(w)), (2, " ".join(w[5:50])), (3, " ".join(f"x{k}" for k in range(40)))]
    found = substring_dedup.find_factors(spark.createDataFrame(made, "doc_id long, text string"), F.lit(0).cast("long"), 2).collect()
    assert found and np.array_equal(sent[0], held[0]) and np.array_equal(sent[1], held[0] & held[1])


def test_texts_with_one_id_are_cut_at_their_own_passages(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(60))
    x = " ".join(f"x{k}" for k in range(5))
    made = [(1, a), (2, f"{x} {' '.join(a.split()[:30])} {x}"), (2, b), (2, b), (3, f"{x} {b}"), (None, b)]
    got = substring_dedup.drop_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()
    left = sorted((str(r.doc_id), r._passages.text) for r in got)
    assert left == sorted([("1", a), ("2", f"{x} {x}"), ("2", b), ("2", b), ("3", x), ("None", b)])


# 8
def test_suffix_automaton_parses_like_longest_match():
    text = " der die das haus und nicht straße winter "
    moves = language_id.suffix_automaton(text)
    for word in ("haus", "winterhaus", "xyz", "nichts", "q", "straßen"):
        rest, count = f" {word} ", 0
        while rest:
            n = next((n for n in range(len(rest), 0, -1) if rest[:n] in text), 1)
            rest, count = rest[n:], count + 1
        assert language_id.phrases(word, moves) == count


def longest_matches(text: bytes, known: bytes) -> int:
    count = 0
    while text:
        n = 0
        while n < len(text) and text[: n + 1] in known:
            n += 1
        text, count = text[max(n, 1) :], count + 1
    return count


@pytest.mark.parametrize("few", [1, 24, 1000])
def test_predictions_equal_parsing_each_text(monkeypatch, few):
    monkeypatch.setattr(language_id, "FEW", few)
    monkeypatch.setattr(language_id, "SIDE_BY_SIDE", 3000)
    rng = random.Random(few)
    prose = [t for t in texts() if t and len(t) < 2000]
    learned = {lang: language_id.running(language_id.words_of(" ".join(rng.sample(prose, 6)))) for lang in ("a", "b", "c")}
    models = [language_id.model(lang, known.decode()) for lang, known in learned.items()]
    asked = [*prose, None, "", "123", "字", "x" * 3000]
    got = language_id.predictions(asked, models, language_id.Parser(models))
    for text, (lang, score) in zip(asked, got):
        words = language_id.words_of(text)
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        bits = {k: longest_matches(language_id.running(words), known) * math.log2(len(known) + 1) for k, known in learned.items()}
        best = sorted(bits, key=lambda k: (bits[k], k))
        assert lang == best[0] and score == pytest.approx(bits[best[1]] / (bits[best[0]] + bits[best[1]]))


def test_sample_is_bounded_and_rows_are_whole(spark, docs, rows):
    got = language_id.sample(docs, 5, 900).collect()
    assert all((r.doc_id, r.lang, r.text) in {(x[0], x[2], x[1]) for x in rows} and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)
    for lang in ("de", "en"):
        mine = [r for r in got if r.lang == lang]
        assert 0 < len(mine) <= 5 and sum(len(r.text) for r in mine) <= 900
    huge = spark.createDataFrame([(1, "y " * 1000, "de"), (3, "kurz", "de"), (3, "kurz", "de")], "doc_id long, text string, lang string")
    assert [r.text for r in language_id.sample(huge, 5, 900).collect()] == ["kurz"]


def test_language_id(spark, docs, rows, nothing):
    found = {r.doc_id: r._language for r in language_id.identify(docs).collect()}
    assert all(0 <= r.score <= 1 for r in found.values())
    assert all(found[r[0]].lang_pred == "und" for r in rows if not any(c.isalpha() for c in r[1] or ""))
    known = [r for r in rows if r[1] and r[2] and len(r[1]) > 300 and "share" not in r[1].lower() and "字" not in r[1]]
    assert sum(found[r[0]].lang_pred == r[2] for r in known) >= 0.9 * len(known)
    assert language_id.identify(nothing).count() == 0
    assert {r._language.lang_pred for r in language_id.identify(docs, []).collect()} == {"und"}
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert {r.lang_pred for r in language_id.identify(changed, language_id.train(changed)).select("_language.*").collect()} <= {"de", "en", "und"}


# 9
def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup(docs, rows, nothing):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.class_id for r in found} == label
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_null_ids_stay_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e f g " * 9), (1, "a b c d e f g " * 9), (2, "a b c d e f g " * 9)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.class_id) for r in near_dedup.near_duplicates(df).collect())
    assert found == [(0, None), (1, 1), (2, 1)]
    assert line_dedup.drop_lines(df).count() == substring_dedup.drop_passages(df).count() == 3
    null = substring_dedup.drop_passages(df).where("doc_id is null").first()
    assert null._passages.n_removed == 0


def test_members_of_a_bucket_that_do_not_match_the_first_meet_each_other(monkeypatch, spark):
    # sketches of one shingle collide for texts that share a passage only
    monkeypatch.setattr(near_dedup, "ORDERED", 1)
    passage = " ".join(f"p{k}" for k in range(40))
    rng = random.Random(4)
    tails = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    rows = [(k, f"{passage} {tails[k % 6]}" + (" end" if k >= 6 else "")) for k in range(18)]
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k % 6 for k in range(18)}


def test_moved_and_repeated_passages_are_linked(spark):
    rng = random.Random(6)
    blocks = [" ".join(f"m{rng.randrange(10**6)}" for _ in range(400)) for _ in range(10)]
    shuffled = [blocks[k] for k in (7, 2, 9, 4, 0, 6, 1, 8, 3, 5)]
    groups = [
        [" ".join(blocks), " ".join(shuffled), " ".join(blocks[5:] + blocks[:5]), " ".join(blocks[::-1])],
        [" ".join(["an often repeated passage of a text"] * n) for n in (10, 100)],
    ]
    for k in range(20):
        a, b = (" ".join(f"h{k}x{rng.randrange(10**6)}" for _ in range(300)) for _ in range(2))
        groups.append([f"{a} {b}", f"{b} {a}"])
    rows, expected = [], {}
    for group in groups:
        first = len(rows)
        for text in group:
            expected[len(rows)] = first
            rows.append((len(rows), text))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == expected


def test_short_texts_that_differ_by_a_word_are_linked(spark):
    sizes = range(1, 36)
    rows = [(100 * n + d, " ".join(f"w{n}x{k}" for k in range(n + d))) for n in sizes for d in (0, 1)]
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    similar = {n: len(sets[100 * n] & sets[100 * n + 1]) >= 0.8 * len(sets[100 * n] | sets[100 * n + 1]) for n in sizes}
    assert similar[8] and not similar[7]
    assert all(found[100 * n + 1] == found[100 * n] for n in sizes if similar[n])


def test_similar_short_texts_always_share_a_key():
    from wakeline.llm.common import mix

    rng = np.random.default_rng(3)
    for _ in range(3000):
        common, more, others = rng.integers(1, 32), rng.integers(0, 6), rng.integers(0, 6)
        if common < near_dedup.SIMILARITY * (common + more + others) or common + min(more, others) > near_dedup.SHORT:
            continue
        values = mix(rng.integers(0, 2**63, common + more + others).astype(np.uint64))
        a, b = values[: common + more], np.concatenate((values[:common], values[common + more :]))
        assert len(np.intersect1d(near_dedup.candidate_keys(a), near_dedup.candidate_keys(rng.permutation(b))))


def test_alignment_counts_moved_passages():
    from wakeline.llm.common import mix

    a = mix(np.arange(1, 400, dtype=np.uint64))
    assert near_dedup.similarity(a, a) == 1.0
    assert near_dedup.similarity(a, np.concatenate((a[200:], a[:200]))) == 1.0
    assert near_dedup.similarity(a, a[100:]) < 0.8 <= near_dedup.similarity(a, a[60:])
    assert near_dedup.aligned(a, np.concatenate((a[:150], a[160:]))) == len(a) - 10


# 10
def kept_lines(rows) -> dict:
    def key(line):
        found = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return re.sub("[A-Z]", lambda m: m[0].lower(), found)

    holders: dict = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r[0])
    out = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r[0]]
        out[r[0]] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_line_dedup(docs, rows, nothing):
    expected = kept_lines(rows)
    found = line_dedup.drop_lines(docs).select("doc_id", "_lines.*").collect()
    assert len(found) == len(rows) and sum(r.n_dropped for r in found) > 5
    assert all((r.n_lines, r.n_dropped, r.text) == expected[r.doc_id] for r in found)
    assert line_dedup.drop_lines(nothing).count() == 0


def test_texts_that_lose_no_line_pass_one_worker(docs):
    """The filter's; a second worker in the same task would hold their texts besides."""
    plan = line_dedup.drop_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("kept(" in x for x in plan.splitlines() if "ArrowEvalPython" in x) == 1


def test_workers_turn_small_parts_of_a_batch_into_objects():
    made = ["x" * 1000] * 3000 + ["y" * 3_000_000, None, ""]
    batch = pa.RecordBatch.from_pydict({"text": made})
    parts = list(common.slices(batch))
    assert [t for part in parts for t in part["text"].to_pylist()] == made
    assert len(parts) > 3 and max(part.num_rows for part in parts) < 1000
    sizes = []
    run = common.by_slice(near_dedup.ROWS, lambda part: sizes.append(part.num_rows) or [[0] * part.num_rows, [None] * part.num_rows, [0] * part.num_rows, [None] * part.num_rows])
    assert sum(out.num_rows for out in run(iter([batch]))) == sum(sizes) == len(made) and len(sizes) == len(parts)


def test_filters_hold_one_block_at_a_time():
    items = [np.array(x, np.uint32) for x in ([5, 9], [5], [], [1])]
    read = []

    def batches():
        for block, first, again in ((0, 0, 2), (0, 1, 2), (3, 3, 3), (7, 0, 2)):
            read.append(block)
            row = [pa.array([block], pa.int32()), pa.array([items[first].tobytes()]), pa.array([items[again].tobytes()])]
            yield pa.RecordBatch.from_arrays(row, schema=bloom.ROWS)

    merged = bloom.merge(batches())
    for block, twice, known in ((0, [5], [0, 0, 3]), (3, [1], [0, 0, 3, 7]), (7, [], [0, 0, 3, 7])):
        found = next(merged)
        assert found["block"].to_pylist() == [block] and read == known
        bits = np.unpackbits(np.frombuffer(found["bits"][0].as_py(), np.uint8))
        p, q = bloom._bits(np.array(twice, np.uint32))
        assert set(np.flatnonzero(bits).tolist()) == {*p.tolist(), *q.tolist()}
    assert next(merged, None) is None


# pipeline and queries
@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{out}/documents.parquet")
    labels_of(spark, rows).withColumn("toxic", F.lit(0)).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<article><p>x y</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return out


def test_pipeline_stages(spark, docs, folder, rows):
    quality, lines, near, clean, mix = (f for _, f in corpus_pipeline.STAGES)
    assert len(quality(spark, docs, folder).columns) == len(docs.columns)
    cut = lines(spark, docs, folder)
    assert cut.columns == docs.columns
    expected = kept_lines(rows)
    for r in cut.collect():
        old = dict((x[0], x[1]) for x in rows)[r.doc_id]
        assert r.text == (expected[r.doc_id][2] if expected[r.doc_id][1] else old)
        assert r.n_chars == len(r.text or "")
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert {r.doc_id for r in near(spark, docs, folder).collect()} == {k for k, c in classes.items() if k == c}
    left = {r.doc_id for r in clean(spark, docs, folder).collect()}
    assert left == {r[0] for r in rows} - {r[0] for r in rows if r[1] and PASSAGE in r[1]}
    assert mix(spark, docs, folder).count() == len(rows)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_every_query_runs(spark, folder):
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.QUERIES) == list(range(1, 14))
    for name in ("op1_page_text", "op3_quality_rules", "op5_quality_model", "op6_fair_mix", "op8_language_id"):
        df = registry.QUERIES[name](spark, folder)
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_digests(spark, folder, rows):
    by_line = {r.doc_id: r for r in registry.QUERIES["op10_line_dedup"](spark, folder).collect()}
    expected = kept_lines(rows)
    assert all(r.kept_sha256 == hashlib.sha256(expected[k][2].encode()).hexdigest() for k, r in by_line.items())
    hits = registry.QUERIES["op4_decontamination"](spark, folder).where("n_items = 1").first()
    assert hits.items_sha256 == hashlib.sha256(b"1").hexdigest() and hits.contaminated
