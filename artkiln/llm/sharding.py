"""Sharding by extendible hashing.

A record's hash is read bit by bit, and a shard is a hash prefix. The
directory is as deep as the total size asks for; only a bucket that is larger
than the byte limit is split on another bit, so its neighbours stay shallow.

The hash is of the key, so a hot source spreads like any other rows, and
bucket sizes are sums, aggregated before they are shuffled. Each further
round takes only records of buckets that are still too large. The directory
stays a distributed table; the driver sees two totals and a yes or no.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import staged

HASH_BITS = 60
#: Levels added below the expected depth, and in each further round.
SPARE_BITS, MORE_BITS = 3, 12


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text (null: empty text), as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _up(prefix: str, bits: Column) -> Column:
    return F.call_function("shiftright", F.col(prefix), bits.cast("int"))


def _leaves(records: DataFrame, limit: int, top: int, depth: int) -> DataFrame:
    """Of each depth-bit prefix: the least depth from top on at which its bucket fits the limit, with that bucket's size.

    Buckets that do not fit at any depth have a null shard_depth; single says that only one hash is left in them.
    """
    leaf = records.groupBy(_up("key_hash", F.lit(HASH_BITS - depth)).alias("leaf")).agg(
        F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), (F.min("key_hash") == F.max("key_hash")).alias("single"))
    steps = leaf.select("leaf", "single", "b", "n", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d")).withColumn(
        "prefix", _up("leaf", F.lit(depth) - F.col("d")))
    nodes = steps.groupBy("d", "prefix").agg(F.sum("b").alias("bytes"), F.sum("n").alias("rows"))
    return steps.join(nodes, ["d", "prefix"]).groupBy("leaf").agg(
        F.first("single").alias("single"), F.first("b").alias("b"), F.first("n").alias("n"),
        F.min(F.when((F.col("bytes") <= limit), F.struct(F.col("d").alias("depth"), "prefix", "bytes", "rows"))).alias("at"))


def shard(rows: DataFrame, key: Column, n_bytes: Column, limit: int) -> DataFrame:
    """rows with shard (the prefix as bits), shard_depth, shard_bytes, shard_rows and fits.

    A null size counts as 0. Equal keys share a shard, for no bit tells them
    apart: a record, or copies of one key, above the limit make a shard of
    their own with fits false. An empty table gives no rows. Columns of rows
    are kept; those named as an added one are replaced.
    """
    added = ["shard", "shard_depth", "shard_bytes", "shard_rows", "fits"]
    keep = [c for c in rows.columns if c.lower() not in added]
    active = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), key_hash(key).alias("key_hash"), F.coalesce(n_bytes, F.lit(0)).cast("long").alias("n_bytes"))
    total = active.agg(F.sum("n_bytes")).first()[0] or 0
    top, depth = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    done = None
    while True:
        leaves = staged(_leaves(active, limit, top, depth), "shard-directory")
        placed = active.withColumn("leaf", _up("key_hash", F.lit(HASH_BITS - depth))).join(leaves, "leaf")
        last = F.col("at").isNotNull() | F.col("single") | F.lit(depth == HASH_BITS)
        at = F.coalesce(F.col("at"), F.struct(F.lit(depth).alias("depth"), F.col("leaf").alias("prefix"), F.col("b").alias("bytes"), F.col("n").alias("rows")))
        final = placed.filter(last).select(
            "row.*",
            F.when(at["depth"] == 0, "").otherwise(F.lpad(F.conv(at["prefix"].cast("string"), 10, 2), at["depth"], "0")).alias("shard"),
            at["depth"].alias("shard_depth"), at["bytes"].alias("shard_bytes"), at["rows"].alias("shard_rows"), F.col("at").isNotNull().alias("fits"))
        done = final if done is None else done.unionByName(final)
        if leaves.filter(~last).isEmpty():
            return done
        active = staged(placed.filter(~last).select("row", "key_hash", "n_bytes"), "shard-oversized")
        top, depth = depth + 1, min(HASH_BITS, depth + MORE_BITS)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each written by one task."""
    sharded.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
