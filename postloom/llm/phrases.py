"""Phrase collocations from a depth-truncated suffix tree, built by vertical partitioning.

Suffixes are the sequences of up to four words that start at each word and end with its piece. Prefixes are grouped
by a memory budget before anything is built: the number of suffixes under every one-word prefix is counted, prefixes
over the budget are replaced by their extensions by one more word (counted in another scan), and what is then within
the budget is laid out by the hash of the prefix and cut into groups of at most `budget` suffixes. Every suffix goes
to the group of its prefix; each group builds its part of the tree alone, as sorted suffixes whose equal beginnings
are the nodes, and reads the counts of nodes off the sums of their leaves. Nodes above a group's prefixes are the
prefixes that were counted while partitioning.

Words travel as 64-bit hashes. The vocabulary is counted as text first, so two words of a language with one hash are
noticed, and all hashes are then taken anew with another salt; counts are exact.

No stage feeds one Python function from another: each such task would hold two Python workers, and those stay alive
with what they once took.

Defined results: a null text is empty; a null lang is `und`; a text of any length is cut into slices at word borders
and read whole; rows that repeat count as often as they occur; ties in the ranking go to the phrase's bytes; an empty
table gives an empty result. Only `lang` and `text` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import mixed, settled
from postloom.operators.lookup import left_lookup

LEAST, LONGEST, FIRST = 30, 4, 2000
#: A longer phrase swallows those inside it from this share of their count on: 80 of 100.
SWALLOWED = 80, 100
SCALE = 2_000_000
#: Suffixes of one group, about 40 bytes each, twice while they are sorted; the budget grows only so that there are
#: at most `GROUPS` groups, whose borders every task knows (8 bytes each).
BUDGET, GROUPS = 1 << 20, 1 << 22
#: Words handled at once, bytes split at once, and words whose hashes a worker remembers.
WORDS_AT_ONCE, SLICE, REMEMBERED = 3 << 18, 1 << 22, 1 << 17
#: Different words a worker counts before it passes on those of one language, and how many it passes on at once.
COUNTED, PASSED = 1 << 18, 1 << 15
#: Sets of hashes that are tried until no two words share one.
SALTS = 8
UNKNOWN = "und"
_SEED = 42
_BORDER = b"\n"
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256)
)
_GAP = re.compile(rb"[ \n]")


class Hashes(dict):
    """Hash of every word; the border of pieces is 0."""

    def __init__(self, salt: int):
        super().__init__({_BORDER: 0})
        self.salt = b"%d " % salt if salt else b""

    def made(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(self.salt + word, _SEED)

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[_BORDER] = 0
        self[word] = found = self.made(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    """(lang, text), one text at a time taken out of the batch."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            yield lang, text.as_buffer().to_pybytes() if text.is_valid else None


def slices(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in order, with `_BORDER` between pieces and at the end; long texts in several slices."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    raw = raw.translate(_FOLDED)
    at = 0
    while at < len(raw):
        end = len(raw)
        if at + SLICE < end:
            gap = _GAP.search(raw, at + SLICE)
            end = gap.start() if gap else end
        yield [w for w in raw[at:end].replace(b"\n", b" \n ").split(b" ") if w]
        at = end
    yield [_BORDER]


def chunks(batches: Iterator[pa.RecordBatch], hashes: Hashes) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, hashes of the words in order) in chunks of about `WORDS_AT_ONCE` words; a document is never divided."""
    held: dict[str, list[np.ndarray]] = {}
    size: Counter[str] = Counter()
    for lang, text in rows(batches):
        for words in slices(text):
            held.setdefault(lang, []).append(hashes.of(words))
            size[lang] += len(words)
        if sum(size.values()) >= WORDS_AT_ONCE:
            largest = max(size, key=size.__getitem__)
            size.pop(largest)
            yield largest, np.concatenate(held.pop(largest))
    while held:
        lang, ids = held.popitem()
        yield lang, np.concatenate(ids)


def vocabulary(texts: DataFrame, salt: int) -> DataFrame:
    """(lang, word, h, f): every word with its hash (8 bytes) and its number of occurrences."""

    def passed(lang: str, counts: Counter[bytes], hashes: Hashes) -> Iterator[pa.RecordBatch]:
        counts.pop(_BORDER, None)
        words = list(counts)
        for at in range(0, len(words), PASSED):
            some = words[at : at + PASSED]
            ids = np.fromiter(map(hashes.made, some), dtype="<u8", count=len(some))
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [lang] * len(some),
                    "word": pa.array(some, pa.binary()).view(pa.string()),
                    "h": pa.array([h.tobytes() for h in ids], pa.binary()),
                    "f": np.fromiter(map(counts.__getitem__, some), dtype=np.int64, count=len(some)),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(salt), defaultdict(Counter)
        for lang, text in rows(batches):
            for words in slices(text):
                counts[lang].update(words)
                if sum(map(len, counts.values())) >= COUNTED:
                    largest = max(counts, key=lambda of: len(counts[of]))
                    yield from passed(largest, counts.pop(largest), hashes)
        while counts:
            yield from passed(*counts.popitem(), hashes)

    found = texts.mapInArrow(run, "lang string, word string, h binary, f bigint")
    return found.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def _clash(words: DataFrame) -> bool:
    """Whether two words of a language share a hash, or one has the border's."""
    shared = words.groupBy("lang", "h").count().where((F.col("count") > 1) | (F.col("h") == F.lit(bytes(8))))
    return not shared.isEmpty()


def prefix_keys(lang: str, words: np.ndarray) -> Iterator[np.ndarray]:
    """Keys (int64) of the first one, two, ... words; what shares a key shares a group, nothing more."""
    key = words[0].byteswap() ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), _SEED))
    yield key.view(np.int64)
    for column in words[1:]:
        key = mixed(key ^ column)
        yield key.view(np.int64)


def _first_keys(words: DataFrame) -> DataFrame:
    """(lang, words, key, f) of the prefixes of one word, with Spark's functions; the keys are those of `prefix_keys`."""
    key = F.conv(F.hex("h"), 16, -10).cast("bigint").bitwiseXOR(F.xxhash64("lang"))
    return words.select("lang", F.col("h").alias("words"), key.alias("key"), "f")


def suffixes(ids: np.ndarray) -> np.ndarray:
    """LONGEST x n words of the suffixes at all words; 0 from the end of the piece on."""
    padded = np.r_[ids, np.zeros(LONGEST, dtype=np.uint64)]
    starts = np.flatnonzero(ids)
    found = np.empty((LONGEST, len(starts)), dtype=np.uint64)
    for k in range(LONGEST):
        np.take(padded[k:], starts, out=found[k])
    for k in range(1, LONGEST):
        found[k][found[k - 1] == 0] = 0
    return found


def _changes(words: np.ndarray) -> np.ndarray:
    """Whether a column of `words` is the first or differs from the one before."""
    new = np.ones(words.shape[1], dtype=bool)
    new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
    return new


@dataclass
class Partition:
    """Prefixes that were extended, per number of words, as sorted keys with their counts, and the groups' borders."""

    over: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    borders: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def is_over(self, words: int, keys: np.ndarray) -> np.ndarray:
        if words > len(self.over) or not len(self.over[words - 1][0]):
            return np.zeros(len(keys), dtype=bool)
        known = self.over[words - 1][0]
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

    def count(self, words: int, keys: np.ndarray) -> np.ndarray:
        known, counts = self.over[words - 1]
        return counts[np.searchsorted(known, keys)]

    def depths(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each suffix's prefix and the key of the prefix, from the `prefix_keys` of the suffixes."""
        depth, key = np.ones(len(keys[0]), dtype=np.uint8), keys[0].copy()
        for k in range(1, LONGEST):
            deeper = np.flatnonzero(depth == k)
            deeper = deeper[self.is_over(k, keys[k - 1][deeper])]
            if not len(deeper):
                break
            depth[deeper], key[deeper] = k + 1, keys[k][deeper]
        return depth, key


def _counted(texts: DataFrame, salt: int, known: Partition, depth: int) -> DataFrame:
    """(lang, words, key, f) of the prefixes of `depth` words whose beginning is over the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids in chunks(batches, Hashes(salt)):
            words = suffixes(ids)[:depth]
            *_, shorter = prefix_keys(lang, words[:-1])
            words = words[:, known.is_over(depth - 1, shorter) & (words[-1] != 0)]
            *_, key = prefix_keys(lang, words)
            by = np.argsort(key)
            words, key = words[:, by], key[by]
            new = np.flatnonzero(_changes(words))
            counts = np.diff(np.r_[new, len(key)])
            raw = pa.array([r.tobytes() for r in np.ascontiguousarray(words[:, new].T)], pa.binary())
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(new), pa.string()), "words": raw, "key": key[new], "f": counts})

    found = texts.mapInArrow(run, "lang string, words binary, key bigint, f bigint")
    return found.groupBy("lang", "words", "key").agg(F.sum("f").alias("f"))


def partitioned(
    texts: DataFrame, words: DataFrame, salt: int, budget: int = BUDGET
) -> tuple[Partition, list[DataFrame]] | None:
    """The groups, and the prefixes over the budget (lang, words, key, f), of which there are few by counting alone.

    To the driver come only prefixes over the budget and one border per group: at most 4 and 2 times the number of
    suffixes over the budget, besides one for each task. None if a prefix over the budget shares its key with another.
    """
    total = words.agg(F.sum("f").alias("n")).first()["n"] or 0
    budget = max(budget, -(-total // GROUPS))
    known, levels, placed = Partition(), [], []
    level = _first_keys(words)
    for depth in range(1, LONGEST + 1):
        if depth == LONGEST:
            placed.append(level)
            break
        placed.append(level.where(F.col("f") <= budget))
        over = level.where(F.col("f") > budget)
        rows = over.select("key", "f").toPandas().sort_values("key")
        if rows.empty:
            break
        if not rows["key"].is_unique or not placed[-1].join(F.broadcast(over.select("key")), "key", "left_semi").isEmpty():
            return None
        known.over.append((rows["key"].to_numpy(), rows["f"].to_numpy()))
        levels.append(over)
        level = settled(_counted(texts, salt, known, depth + 1))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = budget + 1  # every task begins a group
        for batch in batches:
            borders = []
            for key, f in zip(batch["key"].to_numpy(), batch["f"].to_numpy(), strict=True):
                if held + f > budget:
                    borders.append(key)
                    held = 0
                held += f
            yield pd.DataFrame({"key": borders}, dtype=np.int64)

    laid = placed[0].select("key", "f")
    for level in placed[1:]:
        laid = laid.union(level.select("key", "f"))
    borders = laid.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(cut, "key bigint").toPandas()
    known.borders = np.sort(borders["key"].to_numpy())
    return known, levels


def _leaves(lang: str, ids: np.ndarray, known: Partition) -> pa.RecordBatch:
    """Packed rows (group, lang, blob): the distinct suffixes of a chunk with their numbers, by group."""
    words = suffixes(ids)
    keys = list(prefix_keys(lang, words))
    depth, key = known.depths(keys)
    group = np.searchsorted(known.borders, key, side="right")
    # One number to sort by: the group, then bits of the first two words' key, so that like suffixes stand together
    # and pack well, then bits of the whole suffix's. Equal suffixes that are kept apart by others do no harm.
    bits = max(1, int(len(known.borders)).bit_length())
    half = np.uint64((64 - bits) // 2)
    place = group.astype(np.uint64) << np.uint64(64 - bits)
    place |= keys[1].view(np.uint64) >> np.uint64(bits) >> half << half
    place |= keys[3].view(np.uint64) >> (np.uint64(64) - half)
    complete = words[depth - 1, np.arange(words.shape[1])] != 0  # shorter ones are known prefixes
    by = np.argsort(place)
    by = by[complete[by]]
    del keys, key, place, complete
    for k in range(LONGEST):
        words[k, : len(by)] = words[k, by]
    words, depth, group = words[:, : len(by)], depth[by], group[by]
    new = np.flatnonzero(_changes(words))
    counts = np.diff(np.r_[new, len(group)]).astype(np.uint32)
    words, depth, group = words[:, new], depth[new], group[new]
    edges = np.r_[np.flatnonzero(_changes(group[None, :])), len(group)]
    packer = zstandard.ZstdCompressor(level=1)
    blobs = [
        packer.compress(b"".join((words[:, a:b].tobytes(), counts[a:b].tobytes(), depth[a:b].tobytes())))
        for a, b in zip(edges, edges[1:], strict=False)
    ]
    return pa.RecordBatch.from_pydict(
        {"group": group[edges[:-1]], "lang": pa.array([lang] * len(blobs), pa.string()), "blob": pa.array(blobs, pa.binary())}
    )


#: Bytes of one suffix in a blob.
_BYTES = 8 * LONGEST + 4 + 1
NODE = (
    "lang string, words binary, size int, f bigint, lefts array<bigint>, rests array<binary>, inner array<binary>"
)


def nodes(lang: str, words: np.ndarray, counts: np.ndarray, depth: np.ndarray, known: Partition, least: int) -> pd.DataFrame:
    """Nodes of one group's part of the tree with `least` occurrences or more.

    `lefts` are the counts of the shorter beginnings, read off the path to the root; `rests` are what follows them;
    `inner` are the shorter phrases of two words or more inside the node's.
    """
    counts = counts.astype(np.int64)
    first, of_first = np.unique(words[0], return_inverse=True)
    sums = np.bincount(of_first, weights=counts).astype(np.int64)
    one, pair = prefix_keys(lang, words[:2])
    single = np.zeros(len(first), dtype=bool)
    single[of_first] = ~known.is_over(1, one)
    found = [(lang, w.tobytes(), 1, n, [], [], []) for w, n in zip(first[single], sums[single].tolist(), strict=True) if n >= least]
    # Only under beginnings of two words that occur often enough do suffixes need their order.
    by = np.argsort(pair)
    starts = np.flatnonzero(_changes(pair[by][None, :]))
    by = by[np.repeat(np.add.reduceat(counts[by], starts) >= least, np.diff(np.r_[starts, len(by)]))]
    by = by[words[1, by] != 0]
    by = by[np.lexsort(words[::-1, by])]
    totals, words, counts, depth = [sums[of_first[by]]], words[:, by], counts[by], depth[by]
    keys = list(prefix_keys(lang, words))
    for k in range(1, LONGEST):
        new = _changes(words[: k + 1])
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(counts, starts) if len(starts) else counts
        totals.append(sums[np.cumsum(new) - 1])
        for at in starts[(sums >= least) & (words[k, starts] != 0) & (depth[starts] <= k + 1)]:
            raw = words[: k + 1, at].tobytes()
            lefts = [int(totals[j][at]) if j + 1 >= depth[at] else int(known.count(j + 1, keys[j][at])) for j in range(k)]
            rests = [raw[8 * (j + 1) :] for j in range(k)]
            inner = [raw[8 * i : 8 * (i + n)] for n in range(2, k + 1) for i in range(k + 2 - n)]
            found.append((lang, raw, k + 1, int(totals[k][at]), lefts, rests, inner))
    return pd.DataFrame(found, columns=["lang", "words", "size", "f", "lefts", "rests", "inner"])


def tree(texts: DataFrame, salt: int, known: Partition, over: list[DataFrame], least: int) -> DataFrame:
    """Every phrase of up to LONGEST words with `least` occurrences or more, as rows of `NODE`."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids in chunks(batches, Hashes(salt)):
            yield _leaves(lang, ids, known)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for lang, part in rows.groupby("lang"):
            sizes = [zstandard.frame_content_size(blob) // _BYTES for blob in part["blob"]]
            words = np.empty((LONGEST, sum(sizes)), dtype=np.uint64)
            counts, depth = np.empty(sum(sizes), dtype=np.uint32), np.empty(sum(sizes), dtype=np.uint8)
            at = 0
            for n, blob in zip(sizes, part["blob"], strict=True):
                raw, to = zstandard.decompress(blob), slice(at, at + n)
                words[:, to] = np.frombuffer(raw, dtype="<u8", count=LONGEST * n).reshape(LONGEST, n)
                counts[to] = np.frombuffer(raw, dtype="<u4", count=n, offset=8 * LONGEST * n)
                depth[to] = np.frombuffer(raw, dtype=np.uint8, offset=(8 * LONGEST + 4) * n)
                at += n
            found.append(nodes(lang, words, counts, depth, known, least))
        return pd.concat(found)

    sent = texts.mapInArrow(leaves, "group long, lang string, blob binary")
    below = sent.groupBy("group").applyInPandas(build, NODE)
    for size, level in enumerate(over, 1):

        def above(batches: Iterator[pd.DataFrame], size=size) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = []
                for lang, raw, f in zip(batch["lang"], batch["words"], batch["f"], strict=True):
                    words = np.frombuffer(raw, dtype="<u8").reshape(size, 1)
                    keys = list(prefix_keys(lang, words))
                    lefts = [int(known.count(j + 1, keys[j])[0]) for j in range(size - 1)]
                    rests = [raw[8 * (j + 1) :] for j in range(size - 1)]
                    inner = [raw[8 * i : 8 * (i + n)] for n in range(2, size) for i in range(size + 1 - n)]
                    made.append((lang, raw, size, f, lefts, rests, inner))
                yield pd.DataFrame(made, columns=["lang", "words", "size", "f", "lefts", "rests", "inner"])

        below = below.union(level.where(F.col("f") >= least).mapInPandas(above, NODE))
    return below


def scored(found: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, score) of the candidates that no longer phrase swallows, at their lowest cut."""
    candidates = found.where("size > 1")
    parts = F.posexplode(F.arrays_zip("lefts", "rests")).alias("cut", "part")
    cuts = candidates.select("lang", "words", F.col("f").alias("a"), parts).select(
        "lang", "words", "a", "cut", F.col("part.lefts").alias("l"), F.struct("lang", F.col("part.rests").alias("words")).alias("rest")
    )
    known = found.select(F.struct("lang", "words").alias("rest"), F.col("f").alias("r"))
    met = left_lookup(cuts, known, "rest")
    score = F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")
    best = met.groupBy("lang", "words", "a").agg(lowest).select("lang", "words", "a", "low.l", "low.r", "low.score")
    longer = candidates.select("lang", F.explode("inner").alias("words"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    share, whole = SWALLOWED
    alone = F.coalesce(whole * F.col("longer") < share * F.col("a"), F.lit(True))
    return best.join(longer, ["lang", "words"], "left").where(alone).drop("longer")


def collocations(df: DataFrame, least: int = LEAST, first: int = FIRST, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of every language."""
    texts = df.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    for salt in range(SALTS):
        words = settled(vocabulary(texts, salt))
        groups = None if _clash(words) else partitioned(texts, words, salt, budget)
        if groups is not None:
            break
    else:
        raise ValueError("hashes meet under every salt")
    known, over = groups
    found = settled(tree(texts, salt, known, over, least))
    # Ties of the last place stay in until the phrases' own words decide.
    order = [F.col("score").desc(), F.col("a").desc()]
    top = scored(found).withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= first)
    top = settled(top)
    letters = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("words"), F.lit(8)), lambda at: F.substring(F.col("words"), at, F.lit(8))))
    named = top.select("lang", "words", letters.alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelled = named.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("in_order"))
    phrase = spelled.select("lang", "words", F.array_join("in_order.word", " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    last = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = top.join(phrase, ["lang", "words"]).withColumn("rank", last.cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
