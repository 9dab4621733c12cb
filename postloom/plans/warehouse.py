"""Loading one scope's snapshot into the warehouse, and cleaning raw entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.operators.assembly import companies, recruiters
from postloom.operators.counts import labelled_counts
from postloom.operators.dedup import latest_postings
from postloom.operators.filters import has_uid, valid_row
from postloom.operators.paging import with_order_columns
from postloom.operators.skills import explode_skills
from postloom.operators.typing import clean, typed
from postloom.plans.statistics import statistics
from postloom.sources.snapshot import read_snapshot, write_snapshot
from postloom.sources.tables import Warehouse


class SnapshotRejected(Exception):
    """The new snapshot is not good enough; the last good one was kept."""


def valid_rows(raw: DataFrame, scope: S.Scope) -> DataFrame:
    return raw.filter(valid_row(F.lit(scope.keyword), F.lit(scope.scope_id)))


def to_detail(valid: DataFrame) -> DataFrame:
    """Valid rows to typed postings, the newest row per job."""
    return typed(latest_postings(valid.filter(has_uid())))


def _gate(warehouse: Warehouse, df: DataFrame, scope: S.Scope, stage: str, complete: bool, at: str) -> None:
    """Reject a partial run or an empty snapshot before anything is replaced."""
    if complete and not df.isEmpty():
        return
    warehouse.log_run(scope, stage, "rejected", 0, 0, at)
    raise SnapshotRejected(f"{stage} of {scope.scope_id}: {'empty' if complete else 'partial'} snapshot")


def load(
    warehouse: Warehouse, scope: S.Scope, csv_path: str, at: str, complete: bool = True, multi_line: bool = True
) -> DataFrame:
    """CSV snapshot to the three warehouse layers of its scope; returns their row counts.

    Each layer is staged and read back for the next one: the CSV is parsed once, and a lost executor
    never leads further back than the previous layer. The layers are published when all three are
    staged, so a failure while making one leaves the old ones; such a run is logged as failed. With
    `multi_line` off, large files without quoted line breaks are split over tasks.
    """
    first = valid_rows(read_snapshot(warehouse.spark, csv_path, multi_line), scope)
    _gate(warehouse, first, scope, "load", complete, at)
    layers = {
        "snapshot_raw": lambda: first,
        "posting_detail": lambda: to_detail(warehouse.read("snapshot_raw", scope, staged=True)),
        "posting_skill": lambda: explode_skills(warehouse.read("posting_detail", scope, staged=True)),
    }
    try:
        for table, made in layers.items():
            warehouse.replace(table, made(), scope, staged=True)
        for table in layers:
            warehouse.replace(table, warehouse.read(table, scope, staged=True), scope)
    except Exception:
        warehouse.log_run(scope, "load", "failed", 0, 0, at)
        raise
    kept = [warehouse.count(t, scope) for t in ("snapshot_raw", "posting_detail")]
    warehouse.log_run(scope, "load", "ok", *kept, at)
    return layer_counts(warehouse, scope)


def layer_counts(warehouse: Warehouse, scope: S.Scope) -> DataFrame:
    return labelled_counts(
        {
            "snapshot_raw": valid_rows(warehouse.read("snapshot_raw", scope), scope),
            "posting_detail": warehouse.read("posting_detail", scope),
            "posting_skill": warehouse.read("posting_skill", scope),
        }
    )


def publish_clean(
    warehouse: Warehouse, raw: DataFrame, scope: S.Scope, csv_root: str, at: str, complete: bool = True
) -> str:
    """Clean one scope's raw postings into the serving table, the entity tables and its CSV snapshot.

    Companies, recruiters and the snapshot are written from the stored serving rows, so cleaning runs once. Returns
    the snapshot's path.
    """
    mine = raw.filter(F.col("scope_id") == scope.scope_id)
    _gate(warehouse, mine, scope, "clean", complete, at)
    cleaned = latest_postings(clean(mine).filter(has_uid()))
    stamped = with_order_columns(cleaned.withColumn("created_at", F.lit(at).cast("timestamp")))
    warehouse.replace("posting_serving", stamped.sortWithinPartitions(F.desc("published_at")), scope)
    stored = warehouse.read("posting_serving", scope)
    warehouse.replace("clean_company", companies(stored), scope)
    warehouse.replace("clean_recruiter", recruiters(stored), scope)
    path = write_snapshot(stored, csv_root, scope)
    warehouse.log_run(scope, "clean", "ok", mine.count(), warehouse.count("posting_serving", scope), at)
    return path


def publish_statistics(warehouse: Warehouse, scope: S.Scope, updated_at: str) -> None:
    """Compute the scope's statistics, store them, then refresh the hot tier from the store."""
    detail = warehouse.posting_source(scope)
    payloads = statistics(detail, warehouse.read("posting_skill", scope), updated_at)
    warehouse.replace("statistic", payloads)
    warehouse.replace("statistic_hot", warehouse.statistics(scope))
