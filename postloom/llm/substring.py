"""Removal of repeated word passages: windows of `window` words that start earlier elsewhere.

Every window gets a Rabin-Karp hash (differences of prefix sums, modulo 2^64, over 64-bit word hashes); repeated
windows are found by counting hashes in Spark, and a document's covered words merge into maximal intervals.

To move less than every window over the network, counting takes two steps. The anchors of a document are the
`anchor`-word windows with the smallest mixed hash within some full window; equal full windows have equal anchors.
Step one counts anchors: a window whose anchor occurs once in the corpus occurs once itself and is settled. Step two
counts the hashes of all other windows, each joined with its anchor's hash, 96 bits in all. Within a task only the
first of equal keys goes to the counting; a key that makes up a third of all windows is one entry per task.

Order: doc_id, then start; a null doc_id comes before all others, and rows of one doc_id with different texts are
ordered by a hash of the text. Rows that repeat with the same doc_id and text count as one document. Null and empty
texts, and those shorter than a window, keep all their words. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import NULL_ID, mixed

WINDOW, ANCHOR = 20, 8
#: Words that a task handles at once; a longer document is handled alone.
WORDS_AT_ONCE = 1 << 20
#: Text bytes whose windows are counted in one bucket.
BUCKET_BYTES = 16 << 20
BASE = 0x9E3779B97F4A7C15
TOP = np.uint64(2**64 - 1)

#: What a task sends: keys with the rows they stand for, or positions that are settled (no keys).
SENT = "bucket int, keys binary, more binary, ids binary, of binary, starts binary"
RETURNED = "bucket int, ids binary, of binary, starts binary"
FLAGGED = "doc bigint, text_key bigint, flags binary"


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                factors = np.full(2 * n, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = Powers()


def rolling(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `size` words."""
    n = len(word_hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hashes * up[:n], dtype=np.uint64, out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every `size` values in a row."""
    n, have, low = len(values) - size + 1, 1, values
    while have * 2 <= size:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = size - have
    return np.minimum(low[:n], low[rest : rest + n])


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)


def window_keys(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every anchor-size run, and for every window the smallest of those inside it."""
    runs = rolling(hashes, anchor)
    return runs, sliding_min(runs, window - anchor + 1)


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a document, and their hashes."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    runs, low = window_keys(hashes, window, anchor)
    span = window - anchor + 1
    # A run is an anchor if it is the smallest of some window over it: the largest minimum over it equals it.
    padded = np.r_[np.full(span - 1, TOP), ~low, np.full(span - 1, TOP)]
    largest = ~sliding_min(padded, span)
    at = np.flatnonzero(runs == largest)
    return at, runs[at]


def candidates(hashes: np.ndarray, flagged: np.ndarray, window: int, anchor: int):
    """Starts of the windows whose anchor is flagged, their hashes, and 32 bits of their anchor's hash."""
    runs, low = window_keys(hashes, window, anchor)
    marked = np.full(len(runs), TOP)
    marked[flagged] = runs[flagged]
    starts = np.flatnonzero((sliding_min(marked, window - anchor + 1) == low) & (low != TOP))
    return starts, rolling(hashes, window)[starts], low[starts].astype(np.uint32)


def packed(values: np.ndarray) -> bytes:
    """32-bit values as two planes of 16 bits; the upper one is mostly zero and compresses well."""
    return values.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype="<u2").reshape(2, -1).T).view("<u4")[:, 0]


def _entry(bucket: int, keys, more, docs, texts, starts) -> tuple:
    """A row to send: documents are listed once, entries hold their number in the list."""
    pairs = np.column_stack([docs, texts])
    _, first, of = np.unique(docs * np.int64(0x100000001B3) ^ texts, return_index=True, return_inverse=True)
    keyed = (None, None) if keys is None else (keys.astype("<u8").tobytes(), more.astype("<u4").tobytes())
    return (bucket, *keyed, pairs[first].astype("<i8").tobytes(), packed(of), packed(starts))


def in_order(keys, more, docs, texts, starts) -> list[np.ndarray]:
    """The entries by key, document and start, each once."""
    columns = (keys, more, docs, texts, starts)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    if not len(order):
        return columns
    changes = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[np.r_[True, changes]] for c in columns]


def _by_document(buckets: int, docs, texts, starts) -> Iterator[tuple]:
    """Rows to send that hold positions by the documents' buckets."""
    bucket = mixed(docs.view(np.uint64)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    columns = [c[by] for c in (docs, texts, starts)]
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        yield _entry(int(b), None, None, *[c[edges[b] : edges[b + 1]] for c in columns])


class Outbox:
    """Entries of a task, kept as columns and sent in blocks.

    The first entry of every key (by document and start) goes to the key's bucket. Of the others the outcome is
    known: the key is repeated and they are not its first, so they are sent past the counting.
    """

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, keys, more, doc: int, text_key: int, starts) -> None:
        if len(keys):
            n = len(keys)
            self.parts.append((keys, more, np.full(n, doc), np.full(n, text_key), starts))
            self.size += n

    def rows(self, settle_first: bool) -> pd.DataFrame:
        """settle_first: a key that repeats here is known to be repeated, so its first entry is settled, too."""
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        keys, more, docs, texts, starts = in_order(*columns)
        new = np.r_[True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])]
        again = ~np.r_[new[1:], True]  # the next entry has the same key
        past = ~new | (again if settle_first else False)
        out = []
        bucket = (keys[new] % np.uint64(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        first = [c[new][by] for c in (keys, more, docs, texts, starts)]
        edges = np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        for b in np.flatnonzero(edges[1:] > edges[:-1]):
            cut = slice(edges[b], edges[b + 1])
            out.append(_entry(int(b), *[c[cut] for c in first]))
        out += _by_document(self.buckets, docs[past], texts[past], starts[past])
        return pd.DataFrame(out, columns=["bucket", "keys", "more", "ids", "of", "starts"])


#: Entries that a task gathers before it sends them: about 40 bytes each, twice while sorting.
GATHERED = 1 << 21


def _positions(rows: pd.DataFrame) -> list[np.ndarray]:
    """Document, text hash and start of all entries."""
    parts = [np.zeros((0, 3), dtype=np.int64)]
    for ids, of, starts in zip(rows["ids"], rows["of"], rows["starts"], strict=True):
        listed = np.frombuffer(ids, dtype="<i8").reshape(-1, 2)
        parts.append(np.column_stack([listed[unpacked(of)], unpacked(starts).astype(np.int64)]))
    return list(np.ascontiguousarray(np.concatenate(parts).T))


def _resolved(rows: pd.DataFrame, buckets: int, keep_first: bool) -> pd.DataFrame:
    """Positions of the repeated keys of one bucket; without each key's first if `keep_first`."""
    keyed = rows["keys"].notna()
    keys, more = (np.frombuffer(b"".join(rows.loc[keyed, c]), dtype=k) for c, k in (("keys", "<u8"), ("more", "<u4")))
    keys, more, *columns = in_order(keys, more, *_positions(rows[keyed]))
    new = np.r_[True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])] if len(keys) else np.zeros(0, dtype=bool)
    flagged = ~new if keep_first else ~(new & np.r_[new[1:], True]) if len(keys) else new
    found = [np.r_[c[flagged], known] for c, known in zip(columns, _positions(rows[~keyed]), strict=True)]
    out = pd.DataFrame(_by_document(buckets, *found), columns=["bucket", "keys", "more", "ids", "of", "starts"])
    return out[["bucket", "ids", "of", "starts"]]


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per document of a bucket, with all its positions."""
    docs, texts, starts = _positions(rows)
    order = np.lexsort((starts, texts, docs))
    docs, texts, starts = docs[order], texts[order], starts[order]
    edges = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1]), True])
    found = [(docs[a], texts[a], starts[a:b].astype("<i4").tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
    return pd.DataFrame(found, columns=["doc", "text_key", "flags"])


def _counted(sent: DataFrame, buckets: int, keep_first: bool) -> DataFrame:
    """Per document the positions that counting flags (packed 32-bit starts)."""
    found = sent.groupBy("bucket").applyInPandas(lambda rows: _resolved(rows, buckets, keep_first), RETURNED)
    return found.groupBy("bucket").applyInPandas(_merged, FLAGGED)


def _starts(flags: bytes | None) -> np.ndarray:
    return np.frombuffer(flags, dtype="<i4") if flags is not None else np.zeros(0, dtype=np.int32)


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal intervals (first word, end) that the windows at `starts` cover."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    starts = np.unique(starts).astype(np.int64)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return np.column_stack([starts[np.r_[0, gap + 1]], np.minimum(starts[np.r_[gap, len(starts) - 1]] + window, n_words)])


def removal_intervals(
    df: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    bucket_bytes: int = BUCKET_BYTES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, text, the columns to `carry` and flags (packed starts of the windows to remove) for every row."""
    docs = df.select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"),
        F.xxhash64("text").alias("text_key"),
        "doc_id",
        "text",
        F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"),
    )
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def send_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = Outbox(buckets)
        for batch in batches:
            for doc, text_key, text in zip(batch["doc"], batch["text_key"], batch["text"], strict=True):
                at, keys = anchors(hashed(split(text)), window, anchor)
                box.add(keys, np.zeros(len(keys), dtype=np.uint32), doc, text_key, at)
                if box.size >= GATHERED:
                    yield box.rows(settle_first=True)
        if box.size:
            yield box.rows(settle_first=True)

    def send_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = Outbox(buckets)
        for batch in batches:
            for doc, text_key, text, flags in zip(*(batch[c] for c in ("doc", "text_key", "text", "flags")), strict=True):
                starts, keys, more = candidates(hashed(split(text)), _starts(flags), window, anchor)
                box.add(keys, more, doc, text_key, starts)
                if box.size >= GATHERED:
                    yield box.rows(settle_first=False)
        if box.size:
            yield box.rows(settle_first=False)

    keyed = ["doc", "text_key"]
    flagged = _counted(docs.select(*keyed, "text").mapInPandas(send_anchors, SENT), buckets, keep_first=False)
    # Both joins below read this one exchange of the texts.
    dealt = docs.repartition(buckets, *keyed)
    marked = dealt.join(flagged, keyed).select(*keyed, "doc_id", "text", "carried", "flags")
    removed = _counted(marked.mapInPandas(send_windows, SENT), buckets, keep_first=True)
    return dealt.join(removed, keyed, "left")


def _kept(words: list[bytes], intervals: np.ndarray) -> list[bytes]:
    kept, at = [], 0
    for first, end in intervals:
        kept += words[at:first]
        at = end
    return kept + words[at:]


def deduplicated(df: DataFrame, window: int = WINDOW, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text without the repeated words (untouched where nothing repeats), n_words, n_removed, intervals.

    The columns to `carry` are passed on; the text is cut natively from what the intervals leave.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, flags in zip(batch["text"], batch["flags"], strict=True):
                words = split(text)
                cut = covered(len(words), _starts(flags), window)
                n_removed = int((cut[:, 1] - cut[:, 0]).sum())
                left = b" ".join(_kept(words, cut)).decode("utf-8", "surrogatepass") if n_removed else text
                rows.append((left, len(words), n_removed, cut.tolist()))
            out = pd.DataFrame(rows, columns=["text", "n_words", "n_removed", "intervals"])
            out.insert(0, "doc_id", pd.array(batch["doc_id"], dtype="Int64"))
            out["carried"] = batch["carried"]
            yield out

    marked = removal_intervals(df, window, carry=carry).select("doc_id", "text", "carried", "flags")
    kind = marked.schema["carried"].dataType.simpleString()
    schema = f"doc_id bigint, text string, n_words bigint, n_removed bigint, intervals array<array<bigint>>, carried {kind}"
    found = marked.mapInPandas(run, schema)
    return found.select(*[c for c in found.columns if c != "carried"], *[F.col("carried")[c].alias(c) for c in carry])


def digests(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, joined by one space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, flags in zip(batch["text"], batch["flags"], strict=True):
                words = split(text)
                cut = covered(len(words), _starts(flags), window)
                kept = _kept(words, cut)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", pd.array(batch["doc_id"], dtype="Int64"))
            yield out

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return removal_intervals(df, window).select("doc_id", "text", "flags").mapInPandas(run, schema)
