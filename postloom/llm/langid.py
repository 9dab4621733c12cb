"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its words of letters, lower-cased; a word is predicted letter by letter, and its end, from the up to three
characters before (a word begins in an empty context). Counts of four-character sequences come from every learning
document; those of lower orders are numbers of different predecessors, all in DataFrame aggregations. The models of
all languages share sorted arrays of 64-bit hashes, one per order, with a row of log-probabilities per language.

A sequence is kept if its share of its language's counts reaches a bound that depends on the number of languages
alone; what is left out goes to the back-off weight. So the arrays hold at most `CELLS` numbers per order, however
large the corpus is.

The language with the lowest cross-entropy per character wins. A text is rejected if that lies further above the
language's mean, in learning documents set aside, than their spread at the text's length explains. Where few documents
of a language are set aside, its mean comes from cross-scoring all of them by folds, and its spread from the other
languages; so every language has a bound, however few documents it has.

Defined results: a null text or one without a letter gives `und`, score 0, rejected; ties go to the language that
sorts first; without any learning document every text gives `und`. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import id_crc, mixed, settled

ORDER = 4
BITS = 21  # of a code point
CELLS = 8 << 20
UNKNOWN = "und"
#: One in so many learning documents is set aside for the rejection bounds; a language with fewer than `LEAST_ASIDE`
#: of them is cross-scored in so many folds.
ASIDE, LEAST_ASIDE, FOLDS = 16, 20, 4
#: Standard deviations and nats per character above the mean from which a text is rejected.
DEVIATIONS, MARGIN = 8.0, 0.5
#: Characters whose evidence counts for the score at most.
EVIDENCE = 30
#: Words counted or remembered at once, and the longest remembered.
WORDS, LONGEST = 300_000, 64
WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (three characters packed), characters and word numbers of all predictions; predictions per word."""
    clean = ["".join(filter(str.isalpha, w)) for w in words]
    joined = "".join(f"\0\0\0{w}\0" for w in clean)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in clean], dtype=np.int64)
    ends = np.cumsum(sizes + 4)
    predicted = np.ones(len(points), dtype=bool)
    for k in range(3):
        predicted[ends - sizes - 4 + k] = False
    at = np.flatnonzero(predicted)
    contexts = points[at - 3] << 2 * BITS | points[at - 2] << BITS | points[at - 1]
    lengths = np.where(sizes > 0, sizes + 1, 0)
    return contexts, points[at], np.repeat(np.arange(len(words)), sizes + 1), lengths


def hashed(order: int, contexts: np.ndarray, characters: np.ndarray) -> np.ndarray:
    mix = contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + characters.astype(np.uint64)
    return mixed(mix + np.uint64(order << 56))


def _counted(languages: Counter) -> Iterator[pd.DataFrame]:
    for lang, words in languages.items():
        listed = [w for w in words if any(map(str.isalpha, w))]
        if not listed:
            continue
        contexts, characters, number, _ = sequences(listed)
        times = np.array([words[w] for w in listed], dtype=np.int64)[number]
        _, first, back = np.unique(hashed(ORDER, contexts, characters), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=times).astype(np.int64)
        yield pd.DataFrame({"lang": lang, "context": contexts[first], "character": characters[first], "n": n})


def count(rows: DataFrame) -> DataFrame:
    """lang, context, character, n over all rows of text and lang; every task adds up its own before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                held.setdefault(lang, Counter()).update(letters(text))
            if sum(map(len, held.values())) > WORDS:
                yield from _counted(held)
                held = {}
        yield from _counted(held)

    found = rows.select("lang", "text").mapInPandas(run, "lang string, context bigint, character bigint, n bigint")
    return found.groupBy("lang", "context", "character").agg(F.sum("n").alias("n"))


class Models:
    """The models of all languages. Arrays per order: hashes and log-probabilities of sequences, and of contexts."""

    def __init__(self, languages: list[str], symbols: int):
        self.languages = languages
        self.base = -np.log(max(symbols, 2))
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bounds: dict[str, tuple[float, float]] = {}

    @staticmethod
    def _find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(hashes, wanted), max(len(hashes) - 1, 0))
        return at, hashes[at] == wanted if len(hashes) else np.zeros(len(wanted), dtype=bool)

    def back_off(self, order: int, contexts: np.ndarray) -> np.ndarray:
        """Log of the weight that the contexts leave to the lower order; 0 for unknown ones."""
        hashes, weights = self.contexts[order]
        at, hit = self._find(hashes, hashed(order, contexts, np.zeros_like(contexts)))
        out = np.zeros((len(contexts), len(self.languages)))
        out[hit] = weights[at[hit]]
        return out

    def log_probability(self, order: int, contexts: np.ndarray, characters: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full((len(contexts), len(self.languages)), self.base)
        hashes, values = self.grams[order]
        at, hit = self._find(hashes, hashed(order, contexts, characters))
        out = np.empty((len(contexts), len(self.languages)))
        out[hit] = values[at[hit]]
        if not hit.all():
            rest, mask = contexts[~hit], (1 << BITS * max(order - 2, 0)) - 1
            out[~hit] = self.back_off(order, rest) + self.log_probability(order - 1, rest & mask, characters[~hit])
        return out

    def add(self, order: int, kept: pd.DataFrame, left: pd.DataFrame) -> None:
        """kept: language number, context, character, discounted share; left: language number, context, weight."""
        size = len(self.languages)
        contexts, first, back = np.unique(left["context"].to_numpy(np.int64), return_index=True, return_inverse=True)
        weights = np.zeros((len(contexts), size))
        weights[back, left["number"]] = np.log(left["weight"].clip(lower=1e-12))
        keys = hashed(order, contexts, np.zeros_like(contexts))
        by = np.argsort(keys)
        self.contexts[order] = keys[by], weights[by].astype(np.float32)
        context, character = (kept[c].to_numpy(np.int64) for c in ("context", "character"))
        hashes, first, back = np.unique(hashed(order, context, character), return_index=True, return_inverse=True)
        share = np.zeros((len(hashes), size))
        share[back, kept["number"]] = kept["share"]
        context, character = context[first], character[first]
        mask = (1 << BITS * max(order - 2, 0)) - 1
        lower = self.back_off(order, context) + self.log_probability(order - 1, context & mask, character)
        self.grams[order] = hashes, np.log(share + np.exp(lower)).astype(np.float32)


def learn(rows: DataFrame) -> Models:
    """Models and bounds from rows of doc_id, text and lang (null languages are left out)."""
    rows = rows.where(F.col("lang").isNotNull())
    aside = F.pmod(F.floor(id_crc("doc_id") / 4), F.lit(ASIDE)) == 0
    models = fitted(rows.where(~aside))
    if models.languages:
        calibrate(models, rows, rows.where(aside))
    return models


def fitted(rows: DataFrame) -> Models:
    """Models without bounds from all rows of text and lang."""
    grams = settled(count(rows))
    languages = [r[0] for r in grams.select("lang").distinct().orderBy("lang").collect()]
    models = Models(languages, grams.select("character").distinct().count())
    if not languages:
        return models
    least = len(languages) ** 2 / CELLS
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    orders = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << BITS * (order - 1)) - 1
        shorter = F.col("context").bitwiseAND(F.lit(mask)).alias("context")
        orders[order] = settled(orders[order + 1].groupBy("lang", shorter, "character").agg(F.count(F.lit(1)).alias("n")))
    for order in range(1, ORDER + 1):
        table = orders[order]
        once, twice = (F.count_if(F.col("n") == k) for k in (1, 2))
        of_lang = F.broadcast(  # a row per language
            table.groupBy("lang").agg(
                F.sum("n").alias("total"), F.least(F.greatest(F.try_divide(once, once + 2 * twice), F.lit(0.1)), F.lit(0.9)).alias("d")
            )
        )
        of_context = table.groupBy("lang", "context").agg(F.sum("n").alias("in_context"))
        kept = settled(
            table.join(of_lang, "lang")
            .where(F.col("n") >= F.col("total") * least)
            .join(of_context, ["lang", "context"])
            .select(
                number.alias("number"),
                "context",
                "character",
                (F.greatest(F.col("n") - F.coalesce("d", F.lit(0.5)), F.lit(0.0)) / F.col("in_context")).alias("share"),
            )
        )
        left = kept.groupBy("number", "context").agg((1 - F.sum("share")).alias("weight"))
        models.add(order, kept.toPandas(), left.toPandas())  # at most CELLS / languages rows, by the bound on shares
    return models


class Scorer:
    """Sums of log-probabilities per text, with a bounded memory of words."""

    def __init__(self, models: Models):
        self.models, self.ids = models, {}
        self.table = np.zeros((0, len(models.languages) + 1))

    def _values(self, words: list[str]) -> np.ndarray:
        contexts, characters, number, lengths = sequences(words)
        values = self.models.log_probability(ORDER, contexts, characters)
        sums = np.zeros((len(words), len(self.models.languages) + 1))
        sums[:, :-1] = np.add.reduceat(values, np.searchsorted(number, np.arange(len(words))), axis=0)
        sums[:, -1] = lengths
        sums[lengths == 0] = 0
        return sums

    def sums(self, text: str | None) -> np.ndarray:
        """Sum of log-probabilities per language, and the number of predictions at the end."""
        words = letters(text)
        if not words or not self.models.languages:
            return np.zeros(len(self.models.languages) + 1)
        new = [w for w in set(words) if w not in self.ids]
        if len(self.ids) + len(new) > WORDS:
            self.ids, self.table = {}, self.table[:0]
            new = list(set(words))
        extra = 0
        if new:
            known, long = [w for w in new if len(w) <= LONGEST], [w for w in new if len(w) > LONGEST]
            if known:
                first = len(self.ids)
                if first + len(known) > len(self.table):
                    self.table = np.concatenate([self.table, np.zeros((len(self.table) + len(known), self.table.shape[1]))])
                self.table[first : first + len(known)] = self._values(known)
                self.ids.update(zip(known, range(first, first + len(known)), strict=True))
            if long:
                times = Counter(w for w in words if len(w) > LONGEST)
                extra = sum(self._values([w])[0] * times[w] for w in long)
                words = [w for w in words if len(w) <= LONGEST]
        return self.table[list(map(self.ids.__getitem__, words))].sum(axis=0) + extra


_scorers: dict[int, Scorer] = {}

SUMS = "doc_id bigint, lang string, sums array<double>"


def _sums(rows: DataFrame, models: Models) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorers.get(id(shared.value))
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[id(shared.value)] = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(batch["doc_id"], dtype="Int64"),
                    "lang": batch["lang"],
                    "sums": [scorer.sums(t) for t in batch["text"]],
                }
            )

    return rows.select("doc_id", "lang", "text").mapInPandas(run, SUMS)


def measured(models: Models, rows: DataFrame) -> dict[str, tuple[int, float, float]]:
    """Documents, mean cross-entropy and variance times length of every language, from documents of known language."""
    languages = F.array(*map(F.lit, models.languages))
    n = F.nullif(F.element_at("sums", -1), F.lit(0.0))
    own = -F.get("sums", F.array_position(languages, F.col("lang")).cast("int") - 1) / n
    scored = _sums(rows, models).select("lang", own.alias("h"), n.alias("n")).where("h is not null")
    found = scored.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n").alias("n"),
        F.sum(F.col("h") * F.col("n")).alias("hn"),
        F.sum(F.col("h") ** 2 * F.col("n")).alias("hhn"),
    )
    rows_of = found.where("lang is not null").collect()  # a row per language
    return {lang: (docs, hn / n, max(hhn - hn * hn / n, 0.0) / docs) for lang, docs, n, hn, hhn in rows_of}


def cross_measured(rows: DataFrame) -> dict[str, tuple[int, float, float]]:
    """`measured`, every document by a model of its language that has not seen its fold.

    The models of all languages and folds are learned together, each as a language of its own. A language of one
    document has no such model and is left out.
    """
    order = Window.partitionBy("lang").orderBy(id_crc("doc_id"), "doc_id", F.xxhash64("text"))
    fold = F.pmod(F.row_number().over(order), F.lit(FOLDS))
    folded = settled(rows.select("doc_id", "text", "lang", fold.alias("fold")))
    named = lambda k: F.concat(k.cast("string"), F.lit("/"), F.col("lang"))
    others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda k: k != F.col("fold"))
    models = fitted(folded.select("text", F.explode(F.transform(others, named)).alias("lang")))
    if not models.languages:
        return {}
    parts: dict[str, list[tuple[int, float, float]]] = {}
    for name, found in measured(models, folded.select("doc_id", "text", named(F.col("fold")).alias("lang"))).items():
        parts.setdefault(name.split("/", 1)[1], []).append(found)
    total = {lang: sum(d for d, _, _ in of) for lang, of in parts.items()}
    return {
        lang: (total[lang], sum(d * h for d, h, _ in of) / total[lang], sum(d * v for d, _, v in of) / total[lang])
        for lang, of in parts.items()
    }


def calibrate(models: Models, rows: DataFrame, aside: DataFrame) -> None:
    """Bounds of every language: mean cross-entropy and its variance times length, from documents of known language.

    Languages with few documents in `aside` take their mean from `cross_measured`, and the mean variance of the
    others (of all that are left if there are no others). One without any scored document takes the highest mean.
    """
    found = {lang: x for lang, x in measured(models, aside).items() if x[0] >= LEAST_ASIDE}
    few = [x for x in models.languages if x not in found]
    crossed = cross_measured(rows.where(F.col("lang").isin(few))) if few else {}
    spread = list((found or crossed).values())
    pooled = sum(d * v for d, _, v in spread) / max(sum(d for d, _, _ in spread), 1)
    means = [h for _, h, _ in (*found.values(), *crossed.values())]
    for lang in models.languages:
        if lang in found:
            models.bounds[lang] = found[lang][1:]
        else:  # without any document scored at all, chance is the mean
            models.bounds[lang] = crossed[lang][1] if lang in crossed else max(means, default=-models.base), pooled


def identify(rows: DataFrame, models: Models) -> DataFrame:
    """Per row: doc_id, lang_pred, score, entropy (nats per character), rejected."""
    scored = _sums(rows.select("doc_id", F.lit(None).cast("string").alias("lang"), "text"), models)
    size = len(models.languages)
    if not size:
        return scored.select(
            "doc_id",
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("entropy"),
            F.lit(True).alias("rejected"),
        )
    n = F.nullif(F.element_at("sums", -1), F.lit(0.0))  # null where there is no letter
    sums = F.slice("sums", 1, size)
    best = F.array_max(sums)
    weight = F.least(n, F.lit(float(EVIDENCE))) / n
    share = F.aggregate(sums, F.lit(0.0), lambda total, x: total + F.exp((x - best) * weight))
    at = F.array_position(sums, best).cast("int") - 1
    bounds = [models.bounds[x] for x in models.languages]
    of = lambda k: F.get(F.array(*[F.lit(b[k]) for b in bounds]), at)
    entropy = -best / n
    return scored.select(
        "doc_id",
        F.when(n.isNotNull(), F.get(F.array(*map(F.lit, models.languages)), at)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(n.isNotNull(), 1 / share).otherwise(0.0).alias("score"),
        entropy.alias("entropy"),
        F.coalesce(entropy > of(0) + DEVIATIONS * F.sqrt(of(1) / n) + MARGIN, F.lit(True)).alias("rejected"),
    )


def learning_rows(docs: DataFrame) -> DataFrame:
    """The documents that models may learn from: CRC-32 of the id modulo 4 is not 2."""
    return docs.where(F.pmod(id_crc("doc_id"), F.lit(4)) != 2)
