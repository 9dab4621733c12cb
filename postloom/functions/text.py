"""String, number and date expressions over posting text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import payload as P
from postloom.functions.entities import unescape

# Whitespace sets, as Java regex classes.
UNICODE_SPACE = r"[\s\x1c-\x1f]"
SCRIPT_SPACE = r"[\s\x{3000}\x{feff}]"


def is_blank(c: Column) -> Column:
    """Null or only spaces."""
    return c.isNull() | (F.trim(c) == "")


def known_value(c: Column) -> Column:
    """The stored (untrimmed) value, or null when it is blank."""
    return F.when(F.trim(c) != "", c)


def clean_field(c: Column) -> Column:
    """Trimmed value, blank turned into null."""
    return F.nullif(F.trim(c), F.lit(""))


def or_label(c: Column, label: str) -> Column:
    """Default label for a null or empty value."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def wan_amount(c: Column) -> Column:
    """Salary text with an optional trailing 万 as DECIMAL(10,2); null when it is no number."""
    digits = F.regexp_replace(F.trim(c), "万$", "")
    return F.nullif(digits, F.lit("")).try_cast(S.AMOUNT)


def wan_amount_anywhere(c: Column) -> Column:
    """Like `wan_amount`, dropping every 万 (the search side's rule)."""
    digits = F.replace(c, F.lit("万"), F.lit(""))
    return F.nullif(digits, F.lit("")).try_cast(S.AMOUNT)


#: Units of salary text in 万, and periods in years; a bare number is 万 a year.
SALARY_UNITS = {"万": "1", "千": "0.1", "k": "0.1", "元": "0.0001"}
SALARY_PERIODS = {"年": "1", "月": "12", "天": "250", "日": "250"}
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_MEASURE = r"\s*(万|千|[kK]|元)?\s*/?\s*(年|月|天|日)?$"


def _yearly(number: Column, unit: Column, period: Column) -> Column:
    """Amount in 万 a year as text, without trailing zeros."""
    factors = {}
    for name, table in (("unit", SALARY_UNITS), ("period", SALARY_PERIODS)):
        value = F.lit("1")
        for key, factor in table.items():
            value = F.when(F.lower(unit if name == "unit" else period) == key, F.lit(factor)).otherwise(value)
        factors[name] = value.cast("decimal(10,4)")
    amount = F.round(number.cast("decimal(18,4)") * factors["unit"] * factors["period"], 2).cast("decimal(20,2)")
    return F.concat(F.regexp_replace(amount.cast("string"), r"\.?0+$", ""), F.lit("万"))


def normal_salary(low: Column, high: Column) -> tuple[Column, Column]:
    """Salary texts as amounts in 万 a year; a range in one field fills both. Other text stays as it is."""
    span = rf"^{_NUMBER}\s*[-–~]\s*{_NUMBER}{_MEASURE}"
    single = rf"^{_NUMBER}{_MEASURE}"

    def part(c: Column, group: int) -> Column:
        at = lambda pattern, k: F.regexp_extract(c, pattern, k)
        return F.when(c.rlike(span), _yearly(at(span, group), at(span, 3), at(span, 4))).otherwise(
            F.when(c.rlike(single), _yearly(at(single, 1), at(single, 2), at(single, 3))).otherwise(c)
        )

    lone = high.isNull() & low.rlike(span)
    return part(low, 1), F.when(lone, part(low, 2)).otherwise(part(high, 2))


def publish_date(c: Column) -> Column:
    return c.try_cast("date")


def salary_label(low: Column, high: Column) -> Column:
    """`low–high`, `—` for one missing side, 面议 when both are missing."""
    low, high = F.nullif(low, F.lit("")), F.nullif(high, F.lit(""))
    span = F.concat(F.coalesce(low, F.lit("—")), F.lit("–"), F.coalesce(high, F.lit("—")))
    return F.when(low.isNull() & high.isNull(), F.lit("面议")).otherwise(span)


def truncate(c: Column, limit: int, marker: str = S.TRUNCATED) -> Column:
    """First `limit` characters plus a marker when the text is longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def strip_script(c: Column) -> Column:
    """Trim the whitespace set browsers trim, full-width space included."""
    return F.regexp_replace(c, rf"(?U)^{SCRIPT_SPACE}+|{SCRIPT_SPACE}+$", "")


def skill_list(c: Column, limit: int = 12) -> Column:
    """First skills of a `|`-separated text, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip_script)
    return F.slice(F.filter(parts, lambda x: x != ""), 1, limit)


def key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def text_fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def row_fingerprint(*names: str) -> Column:
    """SHA-256 of the row as compact JSON with sorted keys; nulls are kept."""
    row = F.struct(*[F.col(n) for n in sorted(names)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def json_fingerprint(c: Column) -> Column:
    """SHA-256 of JSON text as compact JSON with sorted keys at every depth; null unless it is one JSON value.

    Numbers count by value (1.0 is 1), and an object that repeats a key is no value.
    """
    return F.sha2(P.canonical(c), 256)


def like_pattern(keyword: str) -> str:
    """Contains-pattern; % and _ stay wildcards, a stray backslash just quotes the next character."""
    out, chars = [], iter(f"%{keyword}%")
    for ch in chars:
        if ch == "\\":
            ch = next(chars)
            ch = "\\" + ch if ch in "%_\\" else ch
        out.append(ch)
    return "".join(out)


# Block structure becomes line breaks, other tags vanish.
_MARKUP_STEPS = [
    (rf"(?iuU)<{UNICODE_SPACE}*br{UNICODE_SPACE}*/?{UNICODE_SPACE}*>", "\n"),
    (rf"(?iuU)<{UNICODE_SPACE}*/?{UNICODE_SPACE}*(?:div|p|li|ul|ol)\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
    (r"[ \t]+", " "),
    (rf"(?U)\n{UNICODE_SPACE}*\n+", "\n"),
    (rf"(?U)^{UNICODE_SPACE}+|{UNICODE_SPACE}+\z", ""),
]


def plain_text(c: Column) -> Column:
    """HTML description as plain text; entities are decoded before tags are dropped."""
    text = unescape(F.coalesce(c, F.lit("")))
    for pattern, replacement in _MARKUP_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return text
