"""Reading statistics: hot tier first, durable table behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import schema as S
from postloom.functions import payload as P
from postloom.sources.tables import Warehouse

_HOT, _DURABLE = 0, 1


def serve(hot: DataFrame, durable: DataFrame, stat_types=S.STAT_TYPES) -> DataFrame:
    """The payload of every requested statistic: a valid hot one, else a valid durable one.

    Hot payloads must be JSON objects, durable ones any JSON. A statistic spread over several
    parts counts as found in a tier only when all its parts are valid there.
    """
    tiers = [
        df.filter(F.col("stat_type").isin(list(stat_types)))
        .filter(valid(F.col("payload")))
        .select(*S.STATISTIC.names, F.lit(tier).alias("tier"))
        for df, tier, valid in [(hot, _HOT, P.is_json_object), (durable, _DURABLE, P.is_json)]
    ]
    # Each tier is read once; completeness is seen beside the rows, in the one shuffle that brings them together.
    of = Window.partitionBy("scope_id", "stat_type")

    def whole(tier: int) -> Column:
        mine = F.col("tier") == tier
        return F.size(F.collect_set(F.when(mine, F.col("part"))).over(of)) == F.max(F.when(mine, F.col("parts"))).over(of)

    found = tiers[0].unionByName(tiers[1]).withColumns({f"whole_{t}": whole(t) for t in (_HOT, _DURABLE)})
    hot_is_whole, durable_is_whole = (F.coalesce(f"whole_{t}", F.lit(False)) for t in (_HOT, _DURABLE))
    chosen = F.when(hot_is_whole, _HOT).when(durable_is_whole, _DURABLE)
    return found.filter(F.col("tier") == chosen).select(*S.STATISTIC.names)


def repair(warehouse: Warehouse, scope: S.Scope, stat_types=S.STAT_TYPES) -> None:
    """Refill the hot tier after hits of the durable one: statistics served from there are copied over."""
    hot, durable = (warehouse.statistics(scope, stat_types, t) for t in ("statistic_hot", "statistic"))
    missing = durable.join(serve(hot, durable.limit(0), stat_types), ["scope_id", "stat_type"], "left_anti")
    warehouse.replace("statistic_hot", missing.filter(P.is_json(F.col("payload"))))


def coverage_gap(scopes: DataFrame, served: DataFrame, stat_types=S.STAT_TYPES) -> DataFrame:
    """(scope_id, stat_type) asked for but not found."""
    asked = scopes.select("scope_id", F.explode(F.array(*[F.lit(t) for t in stat_types])).alias("stat_type"))
    return asked.join(served, ["scope_id", "stat_type"], "left_anti")


def latest_update(served: DataFrame) -> DataFrame:
    """Newest `updated_at` per scope, null when no payload has one."""
    return served.groupBy("scope_id").agg(F.max(P.updated_at(F.col("payload"))).alias("updated_at"))


def unwrapped(served: DataFrame) -> DataFrame:
    """Payloads without their envelope, as JSON text."""
    return served.withColumn("payload", F.to_json(P.unwrap(F.col("payload"))))


class StatisticsMissing(LookupError):
    """Some requested statistics exist in neither tier."""


def dashboard(hot: DataFrame, durable: DataFrame, scope_id: str, view: str = "all") -> tuple[DataFrame, DataFrame]:
    """(payloads, updated_at) of one dashboard view; raises when one of its statistics is missing.

    Only the names of missing types, twelve at most, reach the driver.
    """
    stat_types = S.DASHBOARD_VIEWS[view]
    mine = F.col("scope_id") == scope_id
    served = serve(hot.filter(mine), durable.filter(mine), stat_types)
    asked = served.sparkSession.range(1).select(F.lit(scope_id).alias("scope_id"))
    gap = [r.stat_type for r in coverage_gap(asked, served, stat_types).collect()]
    if gap:
        raise StatisticsMissing(f"{scope_id}: " + ", ".join(t for t in stat_types if t in gap))
    return served, latest_update(served)
