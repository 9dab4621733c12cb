"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel of two words sums, over all subsequences of `LENGTH` characters that both hold, the product of their
weights; a subsequence that spans k characters weighs DECAY ** k. Inserted or missing characters lower it little, so
disguised insults stay near the plain ones. Words are lower-cased, reduced to letters, and begin and end with a mark;
letters that stand alone in a row are one word.

Landmarks are words and beginnings of words that cover the toxic learning documents and make up a far larger part
of their words than of clean ones. A sentence's features are, for every landmark, the largest kernel of its words
with it, relative to the landmark's own and cut at one; Nystroem's map turns them into features whose products
approximate the kernel. A linear machine with squared hinge loss learns from labelled sentences: those of clean
documents that hold a word like a landmark, and of every toxic one the sentence that speaks most for it. The margins
of a document's sentences add up to its evidence; a logistic curve over the evidence and its share of the words,
fitted to the learning documents, gives the score.

Learning takes at most about `SAMPLE` labelled documents, chosen by a hash of the id; only their features reach the
driver. Whole texts are scored.

Defined results: null and empty texts score as a text without a known word; labels that are null, or whose id is
null, are not learned from; several labels of one document count as toxic if any is; without toxic learning documents
all scores are 0, without clean ones 1; clashing columns cannot occur, as only doc_id, text and toxic are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import id_crc, settled

LENGTH, DECAY = 3, 0.6
#: Labelled documents that are learned from at most, on average.
SAMPLE = 20_000
#: Landmarks, words considered for them, and the shortest and longest beginning of a word that may be one.
LANDMARKS, CANDIDATES, STEMS = 64, 20_000, range(4, 10)
#: A landmark's share of the words of clean documents is at most so much of that of toxic ones.
IMPURITY = 0.05
#: Kernel values below this count as none, so that most words need no further look.
LEAST = 0.3
THRESHOLD = 0.7
#: Longer words are looked at in parts of this length that overlap by half.
PART = 24
WORDS, WORDS_AT_ONCE = 400_000, 20_000
#: Pairs of a word and a landmark compared at once; few enough for the processor's cache.
PAIRS_AT_ONCE = 1024
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
ALONE = re.compile(r"(?<!\S)\w(?:[\s.\-_*]+\w(?!\w)){2,}")
#: Sentences of one learning document that reach the driver.
SENTENCES_KEPT = 3


def letters_of(word: str) -> str:
    return "".join(filter(str.isalpha, word))


def tokens(text: str | None) -> list[str]:
    """Lower-cased words as they stand; letters that stand alone in a row are joined to one."""
    text = (text or "").lower()
    words = text.split()
    if list(map(len, words)).count(1) > 2 and ALONE.search(text):
        words += ["".join(filter(str.isalpha, m)) for m in ALONE.findall(text)]
    return words


def marked(word: str, whole: bool = True) -> str:
    return f"\0{word}\1" if whole else f"\0{word}"


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (words x longest, padded by -1) and lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    out = np.full((len(words), int(lengths.max(initial=0))), -1, dtype=np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def subsequence_kernel(left: np.ndarray, right: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Kernel of each row of `left` with the same row of `right` (code points; negative pads match nothing)."""
    left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)  # the rows lie side by side
    match = ((left[:, None] == right[None, :]) & (left[:, None] >= 0)).astype(np.float32)
    match *= np.float32(decay * decay)
    ends = match
    for _ in range(length - 1):
        # below[i, j]: weight of pairs of shorter subsequences that end at or before i and j, decayed up to there.
        below = ends.copy()
        for j in range(1, below.shape[1]):
            below[:, j] += np.float32(decay) * below[:, j - 1]
        for i in range(1, len(below)):
            below[i] += np.float32(decay) * below[i - 1]
        ends = np.zeros_like(match)
        np.multiply(match[1:, 1:], below[:-1, :-1], out=ends[1:, 1:])
    return ends.sum(axis=(0, 1))


def parts_of(word: str) -> list[str]:
    """The marked word, in overlapping parts if it is long."""
    whole = marked(word)
    if len(whole) <= PART:
        return [whole]
    return [whole[at : at + PART] for at in range(0, len(whole) - PART // 2, PART // 2)]


def letter_sets(codes: np.ndarray) -> np.ndarray:
    """64-bit sets of the rows' characters."""
    bits = np.where(codes >= 0, np.uint64(1) << (codes.astype(np.int64) & 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1) if codes.size else np.zeros(len(codes), dtype=np.uint64)


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.lengths = coded(words)
        self.own = subsequence_kernel(self.codes, self.codes) if words else np.zeros(0)
        self.sets = letter_sets(self.codes)
        self.sizes = np.bitwise_count(self.sets)

    def similar(self, words: list[str]) -> np.ndarray:
        """Kernel with every landmark, relative to the landmark's own, cut at one; below `LEAST` zero.

        Only pairs are computed where the word holds at least three quarters of the landmark's different letters.
        """
        parts = [(i, p) for i, w in enumerate(words) for p in parts_of(w)]
        out = np.zeros((len(words), len(self.words)), dtype=np.float32)
        if not parts or not self.words:
            return out
        listed = [p for _, p in parts]
        codes, lengths = coded(listed)
        shared = np.bitwise_count(letter_sets(codes)[:, None] & self.sets[None, :])
        row, mark = np.nonzero(4 * shared >= 3 * self.sizes[None, :])
        order = np.lexsort((self.lengths[mark], lengths[row]))
        row, mark, of = row[order], mark[order], np.array([i for i, _ in parts])
        for at in range(0, len(row), PAIRS_AT_ONCE):  # like lengths together, so that little is padding
            r, m = row[at : at + PAIRS_AT_ONCE], mark[at : at + PAIRS_AT_ONCE]
            wide, tall = lengths[r].max(), self.lengths[m].max()
            value = subsequence_kernel(codes[r, :wide], self.codes[m, :tall]) / self.own[m]
            np.maximum.at(out, (of[r], m), np.minimum(value, 1))
        out[out < LEAST] = 0
        return out


class Features:
    """Features of sentences, with a bounded memory of words."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.known = landmarks, {}

    def learn(self, texts: list[list[str]]) -> None:
        here = set().union(*texts)
        new = here - self.known.keys()
        if len(self.known) + len(new) > WORDS:
            self.known, new = {}, here
        by_letters: dict[str, list[str]] = {}
        for word in new:
            by_letters.setdefault(letters_of(word), []).append(word)
        listed = sorted(by_letters)
        for at in range(0, len(listed), WORDS_AT_ONCE):
            some = listed[at : at + WORDS_AT_ONCE]
            values = self.landmarks.similar(some)
            hot = values.any(axis=1)
            for word, value, is_hot in zip(some, values, hot, strict=True):
                for written in by_letters[word]:
                    self.known[written] = value if is_hot else None

    def sentences(self, text: str | None, words: list[str]) -> np.ndarray:
        """Features of the sentences that hold a word like a landmark; no row if none does."""
        values = {w: v for w in set(words) if (v := self.known[w]) is not None}
        if not values:
            return np.zeros((0, len(self.landmarks.words)), dtype=np.float32)
        rows = []
        for sentence in SENTENCES.split((text or "").lower()):
            if not values.keys().isdisjoint(here := tokens(sentence)):
                rows.append(np.max([values[w] for w in here if w in values], axis=0))
        return np.array(rows or [np.max(list(values.values()), axis=0)])

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """Features of the sentences, and the number of words, of every text."""
        size, held = 0, []
        for last, text in enumerate(texts, 1 - len(texts)):
            held.append((text, tokens(text)))
            size += len(text or "")
            if size > 4 << 20 or not last:
                self.learn([w for _, w in held])
                yield from ((self.sentences(t, w), len(w)) for t, w in held)
                size, held = 0, []


def terms(text: str | None) -> Counter:
    """Marked words and beginnings of words of a text, and how often each occurs."""
    found: Counter = Counter()
    for word, times in Counter(map(letters_of, tokens(text))).items():
        if len(word) >= STEMS.start:
            found[marked(word)] += times
        for k in STEMS:
            if len(word) > k:
                found[marked(word[:k], False)] += times
    return found


def choose_landmarks(covers: list[np.ndarray], candidates: list[str], clean_share: np.ndarray, most: int) -> list[str]:
    """Greedy cover: a document counts half as much each time that a landmark has covered it.

    covers: per toxic document its candidates. Ties go to the longer, then the first candidate.
    """
    doc = np.repeat(np.arange(len(covers)), [len(c) for c in covers])
    term = np.concatenate(covers) if covers else np.zeros(0, dtype=np.int64)
    weight = np.ones(len(covers))
    length = np.array([len(c) for c in candidates])
    free, chosen = np.ones(len(candidates), dtype=bool), []
    while len(chosen) < most:
        gain = np.bincount(term, weights=weight[doc], minlength=len(candidates))
        value = np.where(free, gain * (1 - np.minimum(clean_share / IMPURITY, 1)), 0)
        if value.max(initial=0) < max(0.002 * len(covers), 0.5):
            break
        best = np.flatnonzero(value >= value.max() * (1 - 1e-9))
        pick = best[np.argmax(length[best])]
        chosen.append(candidates[pick])
        free[pick] = False
        np.multiply.at(weight, np.unique(doc[term == pick]), 0.5)
    return chosen


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear machine, by Newton's steps over the rows inside the margin."""
    data = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(data.shape[1])
    ridge = np.r_[np.ones(x.shape[1]), 1e-3]
    inside = None
    for _ in range(steps):
        now = y * (data @ weights) < 1
        if inside is not None and np.array_equal(now, inside):
            break
        inside = now
        some, c = data[inside], cost[inside]
        weights = np.linalg.solve(np.diag(ridge) + some.T @ (some * c[:, None]), some.T @ (c * y[inside]))
    return weights[:-1], float(weights[-1])


def logistic(data: np.ndarray, toxic: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights (the last is the offset) of the curve, fitted to slightly softened labels; toxic rows weigh threefold."""
    positive, negative = toxic.sum(), len(toxic) - toxic.sum()
    target = np.where(toxic, (positive + 1) / (positive + 2), 1 / (negative + 2))
    weight = np.where(toxic, 3.0, 1.0) / len(toxic)
    data = np.column_stack([data, np.ones(len(data))])
    curve = np.zeros(data.shape[1])
    ridge = np.diag(np.r_[np.full(data.shape[1] - 1, 1e-4), 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(data @ curve, -30, 30)))
        slope = data.T @ (weight * (p - target)) + ridge @ curve
        bend = data.T @ (data * (weight * p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(len(curve))
        curve = curve - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return curve


class Machine:
    """Landmarks, weights on their features (Nystroem's map folded in) and the curve; or a constant score."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.landmarks = Landmarks([])

    def fit(self, landmarks: Landmarks, docs: list[np.ndarray], toxic: np.ndarray) -> Machine:
        """The linear machine, from features of some sentences of every learning document."""
        self.landmarks = landmarks
        size = len(landmarks.words)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        rows = np.concatenate([*docs, np.zeros((1, size))])  # a sentence without any such word is clean
        owner, toxic = np.r_[owner, len(docs)], np.r_[toxic, False]
        pairs = [subsequence_kernel(np.repeat(landmarks.codes[i : i + 1], size, axis=0), landmarks.codes) for i in range(size)]
        values, axes = np.linalg.eigh(np.array(pairs) / np.sqrt(np.outer(landmarks.own, landmarks.own)))
        nystroem = axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ axes.T
        first = rows.sum(axis=1)
        for _ in range(3):
            # Of a toxic document only the sentence that speaks most for it is an example.
            order = np.lexsort((first, owner))
            best = np.zeros(len(rows), dtype=bool)
            best[order[np.r_[owner[order][1:] != owner[order][:-1], True]]] = True
            used = best | ~toxic[owner]
            y = np.where(toxic[owner[used]], 1.0, -1.0)
            cost = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * 1000
            weights, self.offset = squared_hinge(rows[used] @ nystroem, y, cost)
            self.weights = nystroem @ weights
            first = rows @ self.weights
        return self

    def evidence(self, sentences: np.ndarray, n_words: int) -> tuple[float, float, float, float]:
        """Sum of the sentences' margins (cut to 0 to 1), its share of 100 words, the less of both, and the worst."""
        margins = sentences @ self.weights + self.offset
        total = float(np.clip(margins + 0.5, 0, 1).sum())
        share = 100 * total / max(n_words, 1)
        return float(np.log1p(total)), float(np.log1p(share)), min(total, share, 3.0), float(margins.max(initial=-2))

    def score(self, sentences: np.ndarray, n_words: int) -> float:
        if self.constant is not None:
            return self.constant
        at = float(np.dot((*self.evidence(sentences, n_words), 1.0), self.curve))
        return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of about `sample` labelled documents, or all if there are fewer."""
    clean = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = clean.count()
    share = min(1.0, sample / max(total, 1))
    chosen = clean.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample's size is bounded by `sample`, so it is sent to the documents.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def _landmarks(sample: DataFrame) -> list[str]:
    """Landmarks from the sample: terms by documents and occurrences, then a cover of the toxic documents."""

    def of_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                found = terms(text)
                yield pd.DataFrame({"term": list(found), "times": list(found.values())})

    toxic = sample.where("toxic = 1").select("text")
    counted = toxic.mapInPandas(of_docs, "term string, times bigint").groupBy("term")
    counted = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("times").alias("times"))
    common = counted.where("docs > 1").orderBy(F.col("docs").desc(), "term").limit(CANDIDATES).toPandas()
    listed = common["term"].to_list()
    number = {t: i for i, t in enumerate(listed)}

    def of_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                found = terms(text)
                for term in found.keys() & number.keys():
                    counts[number[term]] += found[term]
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"number": at, "times": counts[at]})

    clean = sample.where("toxic = 0").select("text").mapInPandas(of_clean, "number bigint, times bigint")
    in_clean = np.zeros(len(listed))
    for row in clean.groupBy("number").agg(F.sum("times").alias("times")).collect():  # at most CANDIDATES rows
        in_clean[row["number"]] = row["times"]
    words = F.sum(F.size(F.split("text", " ")))
    of = {r[0]: r[1] for r in sample.groupBy("toxic").agg(words).collect()}
    clean_share = in_clean / max(of.get(0) or 1, 1) / np.maximum(common["times"].to_numpy() / max(of.get(1) or 1, 1), 1e-12)
    pure = np.flatnonzero(clean_share < IMPURITY)
    place = {listed[i]: k for k, i in enumerate(pure)}

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [[place[t] for t in terms(text).keys() & place.keys()] for text in batch["text"]]})

    covers = [np.array(r, dtype=np.int64) for r in toxic.mapInPandas(covered, "terms array<int>").toPandas()["terms"]]
    return choose_landmarks(covers, [listed[i] for i in pure], clean_share[pure], LANDMARKS)


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from rows of doc_id and text, and labels of doc_id and toxic (1 or 0)."""
    sample = settled(labelled_sample(docs, labels))
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic_docs, clean_docs = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic_docs or not clean_docs:
        return Machine(1.0 if toxic_docs else 0.0)
    landmarks = Landmarks(_landmarks(sample))
    if not landmarks.words:
        return Machine(toxic_docs / (toxic_docs + clean_docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(landmarks)
        for batch in batches:
            found = list(features.of(list(batch["text"])))
            rows = [(int(t), n, f.ravel().tolist()) for t, (f, n) in zip(batch["toxic"], found, strict=True)]
            yield pd.DataFrame(rows, columns=["toxic", "n_words", "features"])

    size = len(landmarks.words)
    of_sample = settled(sample.mapInPandas(run, "toxic int, n_words bigint, features array<float>"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = (np.asarray(f, dtype=np.float32).reshape(-1, size) for f in batch["features"])
            top = [f[np.argsort(-f.sum(axis=1), kind="stable")[:SENTENCES_KEPT]].ravel().tolist() for f in every]
            yield pd.DataFrame({"toxic": batch["toxic"], "features": top})

    found = of_sample.mapInPandas(kept, "toxic int, features array<float>").toPandas()  # SAMPLE rows
    docs_of = [np.array(f, dtype=np.float64).reshape(-1, size) for f in found["features"]]
    machine = Machine().fit(landmarks, docs_of, found["toxic"].to_numpy() == 1)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = (np.asarray(f, dtype=np.float32).reshape(-1, size) for f in batch["features"])
            rows = [machine.evidence(f, n) for f, n in zip(every, batch["n_words"], strict=True)]
            yield pd.DataFrame({"toxic": batch["toxic"], "evidence": rows})

    found = of_sample.mapInPandas(weighed, "toxic int, evidence array<double>").toPandas()  # SAMPLE rows
    machine.curve = logistic(np.array(found["evidence"].to_list()), found["toxic"].to_numpy() == 1)
    return machine


_features: dict[tuple[str, ...], Features] = {}


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `threshold` on) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = tuple(machine.landmarks.words)
        if key not in _features:
            _features.clear()
            _features[key] = Features(machine.landmarks)
        features = _features[key]
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(batch["doc_id"], dtype="Int64"),
                    "score": [machine.score(*s) for s in features.of(list(batch["text"]))],
                }
            )

    scored = docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learning_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: CRC-32 of the id modulo 3 is not 1."""
    return labels.where(F.pmod(id_crc("doc_id"), F.lit(3)) != 1)
