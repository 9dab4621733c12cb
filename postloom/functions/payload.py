"""JSON payload expressions for the statistics table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def parsed(c: Column) -> Column:
    """The text as a variant, null unless it is exactly one JSON value.

    Spark's parser ignores whatever follows the first value. Only a single value parses both as
    the sole array element and as an object member, so both are tried.
    """
    element = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(member.isNotNull(), F.try_variant_get(element, "$[0]", "variant"))


def is_json(c: Column) -> Column:
    return parsed(c).isNotNull()


def is_json_object(c: Column) -> Column:
    return c.rlike(r"^\s*\{") & is_json(c)


def canonical(c: Column) -> Column:
    """JSON text in its compact form with keys sorted at every depth, as variants store them; nulls are kept."""
    return F.to_json(parsed(c))


def envelope(data: Column, updated_at: Column) -> Column:
    """`{"data": …, "updated_at": …}` as compact JSON."""
    return F.to_json(F.struct(data.alias("data"), updated_at.alias("updated_at")), KEEP_NULLS)


def unwrap(c: Column) -> Column:
    """The envelope's `data`, or the whole value when it has none; null for bad JSON."""
    value = parsed(c)
    return F.coalesce(F.try_variant_get(value, "$.data", "variant"), value)


def updated_at(c: Column) -> Column:
    """The envelope's time stamp; null when the payload is bad or leaves it blank."""
    return F.nullif(F.try_variant_get(parsed(c), "$.updated_at", "string"), F.lit(""))


def quoted(c: Column) -> Column:
    """A string as a JSON literal, `null` for a missing one."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))
