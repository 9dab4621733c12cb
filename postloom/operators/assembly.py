"""Posting, company and recruiter entities to one wide row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.operators.dedup import latest
from postloom.operators.lookup import left_lookup


def companies(cleaned: DataFrame) -> DataFrame:
    """The newest version of every company of a scope, from cleaned postings."""
    rows = cleaned.filter(F.col("company").isNotNull()).select(*S.CLEAN_COMPANY.names)
    return latest(rows, ["scope_id", "company"], F.col("raw_id").try_cast("long"))


def recruiters(cleaned: DataFrame) -> DataFrame:
    """The recruiter behind every posting of which something is known, from cleaned postings (one row a job)."""
    known = F.col("recruiter_status").isNotNull() | F.col("recruiter_activity").isNotNull()
    return cleaned.filter(known).select(*S.CLEAN_RECRUITER.names)


def assemble(posting: DataFrame, company: DataFrame, recruiter: DataFrame) -> DataFrame:
    """Left joins on company name and recruiter id; every posting stays, once."""
    version = F.col("raw_id").try_cast("long")
    companies = latest(company, ["company"], version).drop("raw_id")
    recruiters = latest(recruiter, ["recruiter_id"], version).drop("raw_id")
    with_company = left_lookup(posting, companies, "company")
    return left_lookup(with_company, recruiters, "recruiter_id", counted=posting)
