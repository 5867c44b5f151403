"""Grouped work that stays parallel when one group holds a third of all rows.

The helpers split a group by a *bucket*: an expression that never decreases
along the wanted order (a day, a block of row numbers). Each task sees one
bucket of one group; only one summary row per bucket crosses bucket borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def many(df: DataFrame) -> DataFrame:
    """Rows that a join may never broadcast, however small the files they come from: compressed columns and exploded arrays hide their size."""
    return df.hint("merge")


def with_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row by a partially aggregated join.

    A window over the group would gather it in one task; the aggregate combines
    map-side and the join back has one row per group on its right side, which
    adaptive execution broadcasts or splits when a key is hot.
    """
    keys = list(keys)
    summary = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(summary, keys)


def bucketed_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "rn") -> DataFrame:
    """Exact ``row_number`` inside each group, computed bucket by bucket."""
    keys = list(keys)
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return (
        df.withColumn("_local", local).join(starts, [*keys, "_b"])
        .withColumn(out, (F.col("_local") + F.col("_start")).cast("bigint")).drop("_b", "_local", "_start")
    )


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def bucketed_before(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], specs: dict[str, tuple[str, Column | str]]
) -> DataFrame:
    """Running ``sum``/``max``/``min`` or the ``last`` value over all rows before this one.

    ``specs`` maps an output column to ``(kind, expression)``, or to the name of
    a column, which then is not shuffled twice. The first row of a group gets null.
    """
    keys = list(keys)
    df = df.withColumn("_b", bucket)
    held = {}
    for name, (_, value) in specs.items():
        held[name] = F.col(value if isinstance(value, str) else f"_v_{name}")
        if not isinstance(value, str):
            df = df.withColumn(f"_v_{name}", value)
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    inside = local.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # One struct orders the rows of a bucket the same way the window does.
    position = F.struct(*[F.expr("1").alias("_")] if not order else [c.alias(f"o{i}") for i, c in enumerate(order)])
    summary, carries = [], []
    for name, (kind, _) in specs.items():
        col = held[name]
        if kind == "last":
            summary.append(F.max_by(F.struct(col.alias("v")), position).alias(f"_s_{name}"))
            carries.append(F.last(F.col(f"_s_{name}"), ignorenulls=True).over(across)["v"].alias(f"_c_{name}"))
        else:
            summary.append(_COMBINE[kind](col).alias(f"_s_{name}"))
            carries.append(_COMBINE[kind](F.col(f"_s_{name}")).over(across).alias(f"_c_{name}"))
    buckets = df.groupBy(*keys, "_b").agg(*summary).select(*keys, "_b", *carries)
    joined = df
    for name, (kind, _) in specs.items():
        col = held[name]
        here = F.lag(col).over(local) if kind == "last" else _COMBINE[kind](col).over(inside)
        joined = joined.withColumn(f"_l_{name}", here)
    joined = joined.withColumn("_first", F.row_number().over(local) == 1).join(buckets, [*keys, "_b"])
    for name, (kind, _) in specs.items():
        here, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            value = F.when(F.col("_first"), carry).otherwise(here)
        elif kind == "sum":
            value = F.when(here.isNull() & carry.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        else:
            value = (F.greatest if kind == "max" else F.least)(here, carry)
        joined = joined.withColumn(name, value)
    drop = ["_b", "_first"] + [p + n for n in specs for p in ("_v_", "_l_", "_c_")]
    return joined.drop(*drop)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows of each group.

    The rank filter lets Spark keep ``k`` rows per group and map task before
    the shuffle, so a hot group never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The first row of each group as one partially aggregated ``min_by``."""
    keys = list(keys)
    rest = [c for c in columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])


def first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return best_per_group(df, keys, order, df.columns).select(*df.columns)


def ordered_list(value: Column, *order: Column) -> Column:
    """Aggregate: array of ``value`` sorted by ``order`` (bounded groups only)."""
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["v"])
