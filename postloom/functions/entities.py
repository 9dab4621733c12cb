"""HTML entities decoded by built-in expressions, by the rules of the HTML standard.

Named entities are looked up in hash buckets, one literal bound once per row; a name that is none is tried by its
prefixes, longest first, among the names that need no `;`. The table comes from the standard library.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: About two names a bucket.
BUCKETS = 1024
#: Longest name that is known without its `;`.
BARE = max(len(name) for name in html5 if not name.endswith(";"))
TOKEN = r"^[^\t\n\f <&#;]{1,32};?"
DECIMAL, HEXADECIMAL = "^#([0-9]+);?", "^#[xX]([0-9a-fA-F]+);?"
REPLACEMENT = "�"


@cache
def _buckets() -> str:
    made: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, value in html5.items():
        made[zlib.crc32(name.encode()) % BUCKETS][name] = value
    return json.dumps(made)


@cache
def _windows() -> str:
    """What numbers 0x80 to 0x9f stand for: Windows-1252, and themselves where it has none."""
    return "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))


def _look_up(table: Column, name: Column) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.crc32(name), F.lit(BUCKETS)).cast("int")), name)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _named(piece: Column, table: Column) -> Column:
    """The text after an `&`, its entity decoded; null if it begins with none."""

    def decoded(token: Column) -> Column:
        shorter = [(F.when(F.length(token) > n, F.substring(token, 1, n)), F.lit(n)) for n in range(BARE, 1, -1)]
        tried = [(token, F.length(token)), *shorter]
        return F.coalesce(*[F.concat(_look_up(table, name), F.substring(piece, size + 1, F.length(piece))) for name, size in tried])

    return _once(F.regexp_substr(piece, F.lit(TOKEN)), decoded)


def _character(number: Column) -> Column:
    """The character of a code point by the standard's rules; numbers too large come as null."""
    none = (
        number.between(0x01, 0x08)
        | number.between(0x0E, 0x1F)
        | (number == 0x0B)
        | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF)
        | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    # the first four bytes say the order, so that U+FEFF itself is kept
    units = F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(number), 8, "0")))
    wrong = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return (
        F.when(wrong, F.lit(REPLACEMENT))
        .when(number.between(0x80, 0x9F), F.substring(F.lit(_windows()), number - 0x7F, F.lit(1)))
        .when(none, F.lit(""))
        .otherwise(F.decode(units, "UTF-32"))
    )


def _numeric(piece: Column, pattern: str, base: int) -> Column:
    digits = F.regexp_replace(F.regexp_extract(piece, pattern, 1), "^0+(?=.)", "")
    number = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("bigint"))
    return F.concat(_character(number), F.regexp_replace(piece, pattern, ""))


def _after(piece: Column, table: Column) -> Column:
    """What an `&` and the text up to the next one stand for."""
    decoded = (
        F.when(~F.startswith(piece, F.lit("#")), _named(piece, table))
        .when(piece.rlike(DECIMAL), _numeric(piece, DECIMAL, 10))
        .when(piece.rlike(HEXADECIMAL), _numeric(piece, HEXADECIMAL, 16))
    )
    return F.coalesce(decoded, F.concat(F.lit("&"), piece))


def unescape(c: Column) -> Column:
    """The text with every entity decoded once; text without an `&` stays untouched."""
    table = F.from_json(F.lit(_buckets()), "array<map<string,string>>")

    def joined(pieces: Column) -> Column:
        return _once(
            table,
            lambda t: F.array_join(F.transform(pieces, lambda piece, at: F.when(at == 0, piece).otherwise(_after(piece, t))), ""),
        )

    return F.when(F.contains(c, F.lit("&")), _once(F.split(c, "&", -1), joined)).otherwise(c)
