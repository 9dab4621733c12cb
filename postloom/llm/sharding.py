"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the whole records by a seeded hash into buckets of about `bucket_bytes`, so that one bucket fits the
memory of a task. Pass two puts each bucket into Fisher-Yates order and gives every record its place in the
concatenation of the buckets. Places are dealt to the shards in turn, so shard sizes differ by one record at most.
The records cross the network once: how many each bucket holds is counted from the hashes alone.

Equal records are counted first and told apart by a copy number, so a record that makes up a third of the table
still spreads over all buckets. Null columns are hashed as nulls; an empty table gives an empty result. The records
are read more than once, so their frame must give the same rows each time, as tables do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 64 << 20
#: Copies that one row of the copy table stands for.
COPY_RUN = 1 << 16
#: Partitions of the scattered records at most; more buckets than that share them.
PARTITIONS = 10_000


def _one_row_each(df: DataFrame, copy: str) -> DataFrame:
    """All rows with the number of the copy among equal ones; runs keep the exploded arrays small."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPY_RUN))))
    left = F.least(F.col("__n") - F.col("__run") * COPY_RUN, F.lit(COPY_RUN))
    return (
        runs.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)))
        .withColumn(copy, F.col("__run") * COPY_RUN + F.col("__i"))
        .drop("__n", "__run", "__i")
    )


def external_shuffle(df: DataFrame, size: Column, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with `position`, their place (from 0, without gaps) in a seeded random order of the whole table.

    `size` is a record's size in bytes; it sets the number of buckets. Columns named `position` are replaced.
    """
    columns = [c for c in df.columns if c != "position"]
    records = df.select(*columns)
    alike = df.select(F.xxhash64(*columns).alias("hash"), size.cast("long").alias("size")).groupBy("hash")
    held = alike.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).agg(F.sum("bytes").alias("bytes"), F.max("n").alias("n"))
    seen = held.first()
    buckets = max(1, -(-(seen["bytes"] or 0) // bucket_bytes))
    # Where no two hashes are equal no two records are, and each is its own copy 0.
    repeated = (seen["n"] or 0) > 1
    numbered = _one_row_each(records, "__copy") if repeated else records.withColumn("__copy", F.lit(0).cast("long"))
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], F.col("__copy"))
    scattered = numbered.withColumn("__bucket", F.pmod(key, F.lit(buckets)))
    # One row per bucket: a table of counts, far smaller than the records.
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        scattered.groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__count"))
        .select("__bucket", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"))
    )
    record = F.struct(key.alias("__key"), F.col("__copy"), *columns)
    # A fixed number of partitions and a fixed order inside them make the seeded shuffle repeatable.
    partitions = min(buckets, PARTITIONS)
    place = F.floor(F.col("__bucket") * partitions / buckets).cast("int")
    filled = (
        scattered.select(place.alias("__part"), "__bucket", record.alias("__record"))
        .repartitionById(partitions, "__part")
        .groupBy("__part", "__bucket")
        .agg(F.sort_array(F.collect_list("__record")).alias("__records"))
    )
    if partitions < buckets:
        filled = filled.sortWithinPartitions("__bucket")
    dealt = filled.select("__bucket", F.posexplode(F.shuffle("__records", seed)).alias("__at", "__record"))
    return dealt.join(F.broadcast(offsets), "__bucket").select(
        *[F.col("__record")[c].alias(c) for c in columns],
        (F.col("__offset") + F.col("__at")).alias("position"),
    )


def shard(df: DataFrame, size: Column, shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with `shard` (0 to `shards` - 1) and `slot` (place in the shard, from 0 without gaps)."""
    placed = external_shuffle(df, size, seed, bucket_bytes)
    return placed.withColumns(
        {
            "shard": F.pmod("position", F.lit(shards)).cast("int"),
            "slot": F.floor(F.col("position") / shards).cast("long"),
        }
    ).drop("position")


def write_shards(sharded: DataFrame, path: str, files_per_shard: int | None = 1) -> None:
    """One folder per shard; inside a shard the files follow each other in slot order.

    None: the records are written where `shard` left them, without a further shuffle; every bucket gives a file a shard.
    """
    if files_per_shard is not None:
        shards = sharded.select("shard").distinct().count()
        sharded = sharded.repartitionByRange(max(1, shards * files_per_shard), "shard", "slot")
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
