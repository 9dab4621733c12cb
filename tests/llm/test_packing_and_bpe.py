"""Packing and byte-level BPE against the public libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from postloom.llm import best_fit, byte_bpe, pretokens

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab é\n\t   \x1c\x85x'sllre1２٣😀中文　．,!?​́Aaaa\r\x0b\xa0\0"


def random_texts(n, seed=3):
    choose = random.Random(seed)
    return ["".join(choose.choice(ALPHABET) for _ in range(choose.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(reference):
    pairs, cache = byte_bpe._worker(RANKS, P.PATTERN)
    for text, forms in zip(random_texts(1500), cache.encoded(random_texts(1500)), strict=True):
        ids = reference.encode_ordinary(text)
        assert pairs.encode(text) == ids
        assert [int(i) for i in "".join(forms).split(",")[:-1]] == ids
        assert pairs.decode(ids) == text.encode()


def test_classes_of_code_points_are_the_library_s(reference):
    pairs, cache = byte_bpe._worker(RANKS, P.PATTERN)
    odd = list(pretokens.unlike())
    assert {0x18EC0, 0x88F, 0xC5C, 0xA7CE, 0x10940} <= set(odd)
    others = [c for c in range(0x80, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    texts = [form.format(chr(c)) for c in [*odd, *others] for form in ("{}'ll", "a{}", "1{}", " {0}{0}x")]
    for text, forms in zip(texts, cache.encoded(texts), strict=True):
        ids = reference.encode_ordinary(text)
        assert pairs.encode(text) == ids, text
        assert [int(i) for i in "".join(forms).split(",")[:-1]] == ids, text


def test_long_pieces(reference):
    pairs, _ = byte_bpe._worker(RANKS, P.PATTERN)
    for text in ("ab" * 3000 + "z" * 3000, "é" * 2000, " " * 5000, "\n" * 3001 + "x"):
        assert pairs.encode(text) == reference.encode_ordinary(text)


def test_round_trip_of_rows(texts):
    rows = texts((1, "Hello  world"), (2, None), (3, ""), (1, "Hello  world"), (None, "é"))
    encoded = byte_bpe.encode(rows, RANKS, P.PATTERN)
    decoded = {(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()}
    assert decoded == {(1, b"Hello  world"), (2, b""), (3, b""), (None, "é".encode())}
    digests = byte_bpe.encode_digests(rows, RANKS, P.PATTERN).collect()
    assert len(digests) == 5 and {r.n_tokens for r in digests if r.doc_id in (2, 3)} == {0}
    assert byte_bpe.encode_digests(texts().limit(0), RANKS, P.PATTERN).count() == 0


def test_both_forms_of_the_vocabulary_agree():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    fast, slow = (best_fit.encoder(P.path(f"byte_bpe_50k.{end}")) for end in ("tiktoken", "json"))
    for text in [*random_texts(1500, 5), "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  x\n<|endoftext|", "a" * 30_000, " " * 30_000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert fast(text) == ids and slow(text) == ids


def bins_of(runs):
    """(bin -> [(offset, length)]) that a plan fills."""
    filled = {}
    for length, _, count, per_bin, first, base in runs:
        for k in range(count):
            filled.setdefault(first + k // per_bin, []).append((base + k % per_bin * length, length))
    return filled


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    choose = random.Random(seed)
    histogram = [(n, choose.randint(1, 30)) for n in choose.sample(range(1, 65), 20)]
    runs = best_fit.plan(histogram, 64)
    filled = bins_of(runs)
    for entries in filled.values():
        at = 0
        for offset, length in sorted(entries):
            assert offset == at
            at += length
        assert at <= 64
    placed = {}
    for entries in filled.values():
        for _, length in entries:
            placed[length] = placed.get(length, 0) + 1
    assert placed == dict(histogram)
    rooms = []  # document by document
    for length, count in sorted(histogram, reverse=True):
        for _ in range(count):
            fits = [r for r in rooms if r >= length]
            room = min(fits) if fits else 64
            if fits:
                rooms.remove(room)
            rooms.append(room - length)
    assert len(filled) == len(rooms)


def test_pieces_and_places(texts, spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(60)] + [(60, None), (61, ""), (5, "word " * 185), (None, "x")]
    vocabulary = P.path("byte_bpe_50k.tiktoken")
    pieces = best_fit.pack(best_fit.cut(texts(*rows), vocabulary, capacity=128), capacity=128).toPandas()
    ids = {i: best_fit.encoder(vocabulary)(t or "") + [0] for i, t in rows}
    for doc, found in pieces[(pieces["doc_id"] != 5) & pieces["doc_id"].notna()].groupby("doc_id"):
        found, at = found.sort_values("piece"), 0
        for p in found.itertuples():
            part = np.array(ids[doc][at : at + p.length], dtype="<u4").tobytes()
            assert p.start == at and p.ids_crc32 == zlib.crc32(part) and (p.piece == 0 or p.length == 128)
            at += p.length
        assert at == len(ids[doc])
    assert sorted(pieces[pieces["doc_id"] == 5]["piece"].value_counts()) == [2, 2]
    for _, found in pieces.groupby("sequence_id"):
        found = found.sort_values("offset")
        assert list(found["offset"]) == [0, *found["length"].cumsum()[:-1]] and found["length"].sum() <= 128
    assert best_fit.pack(best_fit.cut(texts().limit(0), vocabulary)).count() == 0


def test_pretokens_share_a_queue(monkeypatch):
    """Each pre-token gets the ids that it gets alone, whatever lies beside it in the row of symbols."""
    pairs = byte_bpe.BytePairs.read(RANKS, P.PATTERN)
    draw = random.Random(3)
    pieces = [bytes(draw.choice(b"aabteh \0\xe4\xbd") for _ in range(draw.randrange(40))) for _ in range(2_000)]
    pieces += [b"", b"\0\0", b"a" * 5_000, b"ab" * 3_000, b" the", b"xyzzyqq"]
    library = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=pairs.ranks, special_tokens={})
    expected = [library._encode_single_piece(piece) if piece else [] for piece in pieces]
    for shared in (1, 100, 1 << 18):
        monkeypatch.setattr(byte_bpe, "SHARED", shared)
        assert list(pairs.encode_pieces(pieces)) == expected
    assert [pairs.encode_piece(piece) for piece in pieces[-8:]] == expected[-8:]
    assert not any(pairs.bottom) and not any(pairs.middle)
