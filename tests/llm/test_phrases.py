"""Collocations against brute force, with prefixes that have to be extended."""

import re
from collections import Counter

import numpy as np
import pytest

from postloom.llm import phrases


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, text string, rank int, words string")

    return make


def brute(rows, least=30, first=2000):
    counts, totals = Counter(), Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3, 4):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    longer = Counter()
    for (lang, p), f in candidates.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                key = (lang, p[i : i + n])
                longer[key] = max(longer[key], f)
    ranked = {}
    for (lang, p), a in candidates.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        cuts = [(counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        ranked.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return [
        (lang, rank, p.decode(), -a, x, y, totals[lang], -s)
        for lang, rows in sorted(ranked.items())
        for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:first], 1)
    ]


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    random = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)] + ["Über", "ÀB", "x\xa0y", "　", "I"]
    weights = np.r_[8, 6, 4, np.ones(len(words) - 3)]
    weights /= weights.sum()
    ends = [" ", " ", " ", " ", "  \t", ", ", ". ", "\n", "!?", "\x0b"]
    rows = []
    for i in range(400):
        text = "".join(random.choice(words, p=weights) + ends[random.integers(0, len(ends))] for _ in range(random.integers(0, 60)))
        rows.append(("en" if i % 3 else None, text))
    rows += [("de", "New York City hall") for _ in range(40)] + [("de", None), ("de", ""), ("und", "new york"), ("fr", "a b " * 15)]
    return rows


def test_equals_brute_force(docs, corpus):
    assert collected(phrases.collocations(docs(*corpus))) == brute(corpus)


@pytest.mark.parametrize("budget, levels", [(12, 3), (40, 2), (300, 1)])
def test_hot_prefixes_are_extended(docs, corpus, budget, levels):
    texts = docs(*corpus).select("lang", "text").na.fill("und", ["lang"])
    words = phrases.settled(phrases.vocabulary(texts, 0))
    known, over = phrases.partitioned(texts, words, 0, budget)
    assert len(over) >= levels and len(known.borders) > 3
    assert collected(phrases.collocations(docs(*corpus), budget=budget)) == brute(corpus)


def test_groups_keep_the_budget(docs, corpus):
    texts = docs(*corpus).select("lang", "text").na.fill("und", ["lang"])
    known, _ = phrases.partitioned(texts, phrases.settled(phrases.vocabulary(texts, 0)), 0, 300)
    sizes = Counter()
    for lang, text in corpus:
        ids = np.concatenate([phrases.Hashes(0).of(w) for w in phrases.slices(text)])
        depth, key = known.depths(list(phrases.prefix_keys(lang or "und", phrases.suffixes(ids))))
        whole = phrases.suffixes(ids)[depth - 1, np.arange(len(depth))] != 0
        deepest = depth == phrases.LONGEST
        sizes.update(np.searchsorted(known.borders, key[whole & ~deepest], side="right").tolist())
    assert max(sizes.values()) <= 300


def test_first_rows_and_ties(docs):
    rows = [("en", f"{a} {b}. " * 30) for a, b in zip("abcdefgh", "stuvwxyz", strict=True)]
    assert collected(phrases.collocations(docs(*rows), first=3)) == brute(rows, first=3)
    assert [r[2] for r in brute(rows, first=3)] == ["a s", "b t", "c u"]


def test_long_texts_and_repeated_rows(docs, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    rows = [("en", "one two three four five, " * 200)] * 3 + [("en", "z" * 5000)]
    assert [w for part in phrases.slices(rows[0][1]) for w in part][:6] == [b"one", b"two", b"three", b"four", b"five", b"\n"]
    assert collected(phrases.collocations(docs(*rows))) == brute(rows)


def test_empty_table(docs):
    assert phrases.collocations(docs().limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    big = 2**60
    rows = [("en", b"a" * 8, 1, big, [], [], []), ("en", b"b" * 8, 1, big, [], [], []), ("en", b"a" * 8 + b"b" * 8, 2, big - 1, [big], [b"b" * 8], [])]
    found = phrases.scored(spark.createDataFrame(rows, phrases.NODE)).collect()
    assert [r.score for r in found] == [2_000_000 * (big - 1) // (2 * big)]


def python_in_a_row(df):
    """The most Python functions of a plan that follow each other with no exchange between."""
    path, most = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[ :+-]*", line).group())
        name = re.match(r"[ :+-]*(?:\*?\s?\(\d+\) )?(\w*)", line).group(1)
        path = [(d, n) for d, n in path if d < depth]
        before = 0 if name == "Exchange" or not path else path[-1][1]
        path.append((depth, before + bool(re.search("Pandas|Arrow|Python", name))))
        most = max(most, path[-1][1])
    return most


def test_no_task_holds_two_python_workers(docs, corpus, monkeypatch):
    plans, real = [], phrases.settled

    def watched(df):
        plans.append(python_in_a_row(df))
        return real(df)

    monkeypatch.setattr(phrases, "settled", watched)
    assert collected(phrases.collocations(docs(*corpus), budget=40)) == brute(corpus)
    assert len(plans) >= 4 and max(plans) == 1


def test_first_keys_in_spark_are_those_of_suffixes(docs, corpus):
    texts = docs(*corpus).select("lang", "text").na.fill("und", ["lang"])
    found = phrases._first_keys(phrases.vocabulary(texts, 1)).collect()
    assert len(found) > 30
    for r in found:
        assert r.key == next(phrases.prefix_keys(r.lang, np.frombuffer(r.words, dtype="<u8")[None, :]))[0]


def test_counts_and_chunks_that_are_passed_on_early(docs, corpus, monkeypatch):
    monkeypatch.setattr(phrases, "COUNTED", 5)
    monkeypatch.setattr(phrases, "PASSED", 2)
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 100)
    monkeypatch.setattr(phrases, "REMEMBERED", 3)
    monkeypatch.setattr(phrases, "SLICE", 20)
    batch = phrases.pa.RecordBatch.from_pylist([{"lang": x or "und", "text": y} for x, y in corpus])
    for salt in (0, 1):
        hashes, found = phrases.Hashes(salt), {}
        for lang, ids in phrases.chunks(iter([batch]), hashes):
            found.setdefault(lang, []).extend(ids.tolist())
        for lang, ids in found.items():
            want = [w for x, y in corpus if (x or "und") == lang for part in phrases.slices(y) for w in part]
            assert sorted(ids) == sorted(0 if w == b"\n" else hashes.made(w) for w in want)
    want = Counter((x or "und", w.decode()) for x, y in corpus for part in phrases.slices(y) for w in part if w != b"\n")
    found = phrases.vocabulary(docs(*corpus).select("lang", "text").na.fill("und", ["lang"]), 0).collect()
    assert {(r.lang, r.word): r.f for r in found} == want and len(found) == len(want)


def test_hashes_that_meet_are_taken_anew(docs, corpus, monkeypatch):
    real = phrases.vocabulary

    def clashing(texts, salt):
        rows = real(texts, salt)
        return rows.withColumn("h", phrases.F.lit(bytes(8))) if salt == 0 else rows

    monkeypatch.setattr(phrases, "vocabulary", clashing)
    assert collected(phrases.collocations(docs(*corpus))) == brute(corpus)
