"""Byte-level BPE of whole texts by way of their parts, remembered in bounded caches.

A text is cut into chunks, a chunk into the pieces of the vocabulary's pattern. The pattern never matches across the
border of two chunks, so a text's tokens are its chunks' tokens in a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import regex
import tiktoken

# Fixed value: the characters of Unicode's White_Space property, which the vocabularies' pattern calls \s.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the one space before it, or white space up to that space.
CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHERS = [c for c in map(chr, range(0x3001)) if c not in " \n" and re.match(f"[{_SPACE}]", c)] + ["\0"]
#: Chunks and pieces that a worker remembers (about 250 bytes each), the longest ones that it does, and characters that
#: are looked at together.
CHUNKS_KEPT, PIECES_KEPT, LONGEST, CHARACTERS = 600_000, 1_500_000, 64, 4 << 20


#: What stands for a letter, a number and any other character of the library where a text is split.
_AS = {r"\p{L}": "\xaa", r"\p{N}": "\xb2", "": "\ue000"}


@lru_cache(maxsize=1)
def unlike() -> dict[int, str]:
    """Code points that tiktoken and the pattern matcher here class differently, with what stands for them.

    They know different versions of Unicode. The library tells its classes itself: encoded with a class as the whole
    pattern, a text's ids are the bytes of its characters of that class.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    there, differing = {}, set()
    for kind in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        found = set(bytes(library.encode_ordinary(every)).decode())
        there.update(dict.fromkeys(found, _AS[kind]))
        differing |= found ^ set(regex.findall(kind, every))
    return {ord(c): there.get(c, _AS[""]) for c in differing}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text, as the tiktoken library finds them."""
    matches = regex.compile(pattern)
    stands_for = unlike()
    odd = frozenset(map(chr, stands_for))

    def split(text: str) -> list[str]:
        if text.isascii() or odd.isdisjoint(text):
            return matches.findall(text)
        return [text[m.start() : m.end()] for m in matches.finditer(text.translate(stands_for))]

    return split


def chunks(text: str) -> list[str]:
    """The chunks in order; there may be empty ones."""
    plain = not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _OTHERS))
    if plain:  # then chunks begin at every space and around every line end
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return CHUNKS.findall(text)


class Cache:
    """Encoded forms (str or bytes) of chunks and pieces; each memory starts anew when it is full.

    `encode` gets unseen pieces and returns their forms; `empty` is the form of an empty text.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], Iterable], empty: str | bytes):
        self.split, self.encode, self.empty = splitter(pattern), encode, empty
        self.chunks, self.pieces = {}, {}

    def _learn(self, new: set[str]) -> None:
        cut = {c: self.split(c) for c in new}
        unseen = set().union(*cut.values()) - self.pieces.keys()
        if len(self.pieces) + len(unseen) > PIECES_KEPT:
            self.pieces = {}
            unseen = set().union(*cut.values())
        listed = list(unseen)
        self.pieces.update(zip(listed, self.encode(listed), strict=True))
        of, join = self.pieces.__getitem__, self.empty.join
        self.chunks.update((c, join(map(of, pieces))) for c, pieces in cut.items())
        for piece in listed:
            if len(piece) > LONGEST:
                del self.pieces[piece]

    def encoded(self, texts: Iterable[str | None]) -> Iterator[list]:
        """For every text the forms of its chunks, in order."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(chunks(text or ""))
            size += len(text or "")
            if size > CHARACTERS:
                yield from self._forms(held)
                held, size = [], 0
        yield from self._forms(held)

    def _forms(self, held: list[list[str]]) -> Iterator[list]:
        if not held:
            return
        here = set().union(*held)
        new = here - self.chunks.keys()
        if len(self.chunks) + len(new) > CHUNKS_KEPT:
            self.chunks = {}
            new = here
        self._learn(new)
        of = self.chunks.__getitem__
        for listed in held:
            yield list(map(of, listed))
        for chunk in new:
            if len(chunk) > LONGEST:
                del self.chunks[chunk]
