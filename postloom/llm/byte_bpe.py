"""Byte-level BPE by ranks: encoding and decoding of whole texts.

Merges are taken from a rank queue: a bucket per merge rank holds positions of a linked list of symbols, and a
hierarchical bitmap over the ranks finds the lowest rank that waits by find-first-set. Entries whose pair has
changed meanwhile are skipped when they are met. Finding the next merge costs the same however long a pre-token is.
Many pre-tokens share one queue: they lie in one row of symbols with a stop after each, which nothing merges with, so
a rank is taken once for all of them.

Null texts count as empty: no ids, no bytes. Every row is encoded on its own, so ties and repeats need no rule.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from postloom.llm.pretokens import Cache, splitter

WORD = 64
#: Bytes of pre-tokens that share a queue; a longer pre-token has one of its own.
SHARED = 1 << 18
ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class BytePairs:
    """A vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, splitter(pattern)
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.listed = {i: f"{i}," for i in ranks.values()}
        self.pairs = np.full(1 << 16, -1, np.int32)
        for b, i in ranks.items():
            if len(b) == 2:
                self.pairs[b[0] << 8 | b[1]] = i
        self.bottom, self.middle = [0] * WORD**2, [0] * WORD

    @classmethod
    def read(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if ranks and max(ranks.values()) >= WORD**3:
            raise ValueError("the rank bitmap has three levels of 64")
        return cls(ranks, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return next(self.encode_pieces([piece]))

    def encode_pieces(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each pre-token."""
        held, size = [], 0
        for piece in pieces:
            if held and size + len(piece) > SHARED:
                yield from self._encoded(held)
                held, size = [], 0
            held.append(piece)
            size += len(piece)
        yield from self._encoded(held)

    def _encoded(self, pieces: list[bytes]) -> Iterator[list[int]]:
        whole = [self.ranks.get(piece) for piece in pieces]
        parted = self._merged([piece for piece, rank in zip(pieces, whole, strict=True) if rank is None])
        for rank in whole:
            yield next(parted) if rank is None else [rank]

    def _merged(self, pieces: list[bytes]) -> Iterator[list[int]]:
        if not pieces:
            return
        ranks, size, known = self.ranks, self.size, self.ranks.get
        row = b"\0".join(pieces) + b"\0"
        n = len(row)
        stops = np.cumsum([len(piece) + 1 for piece in pieces]) - 1
        end = list(range(1, n + 1))  # of the symbol that starts here; 0: merged away, -1: a stop
        before = list(range(-1, n - 1))
        stops_at = stops.tolist()
        for stop in stops_at:
            end[stop] = -1
            if stop + 1 < n:
                before[stop + 1] = -1
        # The queue: positions by rank, and which ranks wait: a bit each in `bottom`, a bit for each word of it that
        # is not 0 in `middle`, and likewise in `top`. All are empty again when the row is done.
        buckets: dict[int, list[int]] = {}
        bottom, middle, top = self.bottom, self.middle, 0
        symbols = np.frombuffer(row, np.uint8).astype(np.int32)
        first = self.pairs[symbols[:-1] << 8 | symbols[1:]]
        first[stops[:-1]] = -1  # no pair holds a stop
        first[stops[stops > 0] - 1] = -1
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        for found in np.split(places, np.flatnonzero(np.diff(first[places])) + 1) if len(places) else []:
            rank = int(first[found[0]])
            buckets[rank] = found.tolist()
            word = rank >> 6
            bottom[word] |= 1 << (rank & 63)
            middle[word >> 6] |= 1 << (word & 63)
            top |= 1 << (word >> 6)
        new = []
        while True:
            for rank, i in new:
                if rank in buckets:
                    buckets[rank].append(i)
                    continue
                buckets[rank] = [i]
                word = rank >> 6
                if not bottom[word]:
                    high = word >> 6
                    if not middle[high]:
                        top |= 1 << high
                    middle[high] |= 1 << (word & 63)
                bottom[word] |= 1 << (rank & 63)
            if not top:
                break
            # Find-first-set, level by level; then the rank's bit goes.
            high = (top & -top).bit_length() - 1
            at = middle[high]
            word = high << 6 | (at & -at).bit_length() - 1
            bits = bottom[word]
            rank = word << 6 | (bits & -bits).bit_length() - 1
            bottom[word] = bits = bits & bits - 1
            if not bits:
                middle[high] = at = at & at - 1
                if not at:
                    top &= top - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            length, held_to, new = size[rank], -1, []
            for i in positions:
                if i < held_to:
                    new.append((rank, i))  # a rank below this one has come up in the pre-token: it goes first
                    continue
                middle_of = end[i]
                if not middle_of:
                    continue
                last = end[middle_of]
                if last - i != length:
                    continue  # stale: one of its symbols has grown
                end[i], end[middle_of] = last, 0
                lower = False
                if (after := end[last]) > 0:
                    before[last] = i
                    if (other := known(row[i:after])) is not None:
                        new.append((other, i))
                        lower = other < rank
                if (left := before[i]) >= 0 and (other := known(row[left:last])) is not None:
                    new.append((other, left))
                    lower = lower or other < rank
                if lower:
                    held_to = stops_at[bisect_left(stops_at, i)]
        i = 0
        for stop in stops_at:
            ids = []
            while i < stop:
                ids.append(ranks[row[i : end[i]]])
                i = end[i]
            yield ids
            i = stop + 1

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(map(str.encode, self.split(text))) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[str(i)] for i in ids)


_known: dict[tuple[str, str], tuple[BytePairs, Cache]] = {}


def _worker(path: str, pattern: str) -> tuple[BytePairs, Cache]:
    """The vocabulary and a cache, kept as long as the Python worker. Forms are ids with a comma after each."""
    if (path, pattern) not in _known:
        pairs = BytePairs.read(path, pattern)
        listed = pairs.listed.__getitem__
        form = lambda pieces: ("".join(map(listed, ids)) for ids in pairs.encode_pieces(map(str.encode, pieces)))
        _known[path, pattern] = pairs, Cache(pattern, form, "")
    return _known[path, pattern]


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, ids (array)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, cache = _worker(path, pattern)
        for batch in batches:
            ids = [list(map(int, "".join(forms).split(",")[:-1])) for forms in cache.encoded(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return df.select("doc_id", "text").mapInPandas(run, "doc_id bigint, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of doc_id, ids: doc_id, decoded (bytes). Null ids count as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, _ = _worker(path, pattern)
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "decoded": [pairs.decode([] if x is None else x) for x in batch["ids"]]}
            )

    return df.select("doc_id", "ids").mapInPandas(run, "doc_id bigint, decoded binary")


def encode_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each text, decodes the ids, and returns the number of ids and the digests of ids and bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, cache = _worker(path, pattern)
        bytes_of = pairs.bytes_of.__getitem__
        for batch in batches:
            rows = []
            for forms in cache.encoded(batch["text"]):
                listed = "".join(forms)[:-1]
                ids = listed.split(",") if listed else []
                decoded = hashlib.sha256(b"".join(map(bytes_of, ids))).hexdigest()
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), decoded))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pd.array(batch["doc_id"], dtype="Int64"))
            yield out

    return df.select("doc_id", "text").mapInPandas(run, ENCODED)
