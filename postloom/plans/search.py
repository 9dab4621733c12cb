"""Job listing requests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postloom import schema as S
from postloom.operators.filters import JobQuery, renamed
from postloom.operators.paging import page, page_meta


def list_jobs(postings: DataFrame, query: JobQuery) -> tuple[DataFrame, DataFrame]:
    """(items, pagination) of one request over the serving table."""
    hits = postings.filter(query.predicate())
    items = renamed(page(hits, query.page, query.page_size), S.LIST_FIELDS)
    return items, page_meta(hits, query.page, query.page_size)
