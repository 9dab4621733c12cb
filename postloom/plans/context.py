"""Bounded JSON context per scope or posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions.payload import quoted, unwrap
from postloom.functions.text import plain_text, truncate
from postloom.operators.filters import renamed
from postloom.operators.paging import newest_first, recent

LIST_LIMIT, TEXT_LIMIT = 30, 1200
SAMPLE_ROWS, SAMPLE_TEXT_LIMIT = 5, 500
JOB_TEXT_LIMIT = 2000


def _block(items: Column, brackets: str, depth: int) -> Column:
    """Items one per line inside brackets, indented by two blanks per level."""
    pad = "  " * (depth + 1)
    body = F.array_join(items, f",\n{pad}")
    full = F.concat(F.lit(f"{brackets[0]}\n{pad}"), body, F.lit(f"\n{'  ' * depth}{brackets[1]}"))
    return F.when(F.size(items) > 0, full).otherwise(F.lit(brackets))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), value)


def _object(fields: list[Column], depth: int) -> Column:
    return _block(F.array(*fields), "{}", depth)


def _texts(items: Column, depth: int) -> Column:
    return _block(F.transform(items, lambda x: quoted(truncate(x, TEXT_LIMIT))), "[]", depth)


def _numbers(items: Column, depth: int) -> Column:
    return _block(F.transform(items, _number), "[]", depth)


def _text_object(names: dict[str, str], limit: int, depth: int) -> Column:
    """Text columns as one object.

    Line breaks inside values are escaped, so every line of the pretty form starts with a field
    name; only the blank before its colon has to go.
    """
    fields = [truncate(F.col(c).cast("string"), limit).alias(n) for c, n in names.items()]
    pretty = F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"})
    text = F.regexp_replace(pretty, r'(?m)^  "(\w+)" : ', '  "$1": ')
    return F.replace(text, F.lit("\n"), F.lit("\n" + "  " * depth)) if depth else text


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _bounded(texts: DataFrame, limit: int) -> DataFrame:
    """Cut the context column; a projection of its own, so the text is built once per row."""
    return texts.withColumn("context", truncate(F.col("context"), limit, S.CONTEXT_TRUNCATED))


# The shapes that payloads have; a field that is absent is null.
_LISTS = {"categories": "string", "values": "bigint", "job_counts": "bigint", "average_salary_wan": "double"}
_FIGURES = {
    "job_count": "bigint",
    "company_count": "bigint",
    "city_count": "bigint",
    "average_annual_salary_wan": "double",
    "salary_job_count": "bigint",
    "data_updated_at": "string",
}


def statistic_blocks(served: DataFrame) -> DataFrame:
    """(scope_id, stat_type, block): each served payload as indented JSON, lists cut to their first 30.

    Payloads may come with or without envelope. Part 0 holds the first entries of a statistic, so later parts
    are not read. A payload of another shape stays as compact JSON, cut like a text.
    """
    kinds = [f"{n} array<{t}>" for n, t in _LISTS.items()] + [f"{n} {t}" for n, t in _FIGURES.items()]
    text = F.to_json(unwrap(F.col("payload")))
    first = served.filter("part = 0").select("scope_id", "stat_type", text.alias("text"))
    d = F.col("d")

    def listed(name: str) -> Column:
        some = F.slice(d[name], 1, LIST_LIMIT)
        return _field(name, _texts(some, 3) if _LISTS[name] == "string" else _numbers(some, 3))

    def figure(name: str) -> Column:
        return _field(name, quoted(d[name]) if _FIGURES[name] == "string" else _number(d[name]))

    city = _object([listed(n) for n in _LISTS if n != "values"], 2)
    plain = _object([listed("categories"), listed("values")], 2)
    block = (
        F.when(d["job_counts"].isNotNull(), city)
        .when(d["values"].isNotNull(), plain)
        .when(d["job_count"].isNotNull(), _object([figure(n) for n in _FIGURES], 2))
        .otherwise(truncate(F.col("text"), TEXT_LIMIT))
    )
    return first.withColumn("d", F.from_json("text", ", ".join(kinds))).select(
        "scope_id", "stat_type", block.alias("block")
    )


def sample_blocks(postings: DataFrame) -> DataFrame:
    """(scope_id, samples): the newest postings of each scope as an indented JSON list."""
    order = Window.partitionBy("scope_id").orderBy(*newest_first())
    rows = recent(postings, SAMPLE_ROWS).withColumn("_rn", F.row_number().over(order))
    entries = rows.select("scope_id", "_rn", _text_object(S.LIST_FIELDS, SAMPLE_TEXT_LIMIT, 2).alias("block"))
    packed = entries.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "block"))).alias("e"))
    return packed.select("scope_id", _block(F.col("e")["block"], "[]", 1).alias("samples"))


def scope_context(blocks: DataFrame, samples: DataFrame | None = None, limit: int = S.CONTEXT_LIMIT) -> DataFrame:
    """(scope_id, context): one bounded JSON text per scope, statistics in serving order.

    At most twelve blocks of at most thirty entries meet in one row.
    """
    types = F.array(*[F.lit(t) for t in S.STAT_TYPES])
    placed = blocks.withColumn("o", F.array_position(types, F.col("stat_type")))
    member = F.concat(quoted(F.col("stat_type")), F.lit(": "), F.col("block"))
    joined = placed.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("o", member.alias("m")))).alias("e"))
    fields = [
        _field("scope_id", quoted(F.col("scope_id"))),
        _field("statistics", _block(F.col("e")["m"], "{}", 1)),
    ]
    if samples is not None:
        joined = joined.join(samples, "scope_id", "left")
        fields.append(_field("job_samples", F.coalesce("samples", F.lit("[]"))))
    return _bounded(joined.select("scope_id", _object(fields, 0).alias("context")), limit)


def job_context(details: DataFrame, limit: int = S.CONTEXT_LIMIT) -> DataFrame:
    """(job_id, context): bounded JSON text of single posting details."""
    text = _text_object({c: c for c in details.columns}, JOB_TEXT_LIMIT, 0)
    return _bounded(details.select("job_id", text.alias("context")), limit)


def detail_context(postings: DataFrame) -> DataFrame:
    """Contexts of a whole posting table, descriptions as plain text."""
    details = renamed(postings, S.DETAIL_FIELDS)
    return job_context(details.withColumn("description", plain_text(F.col("description"))))
