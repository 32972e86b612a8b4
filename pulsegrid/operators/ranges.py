"""Running values over groups of any size, from range partitions.

Rows are range-partitioned by keys and order once (``ranged``).  A running value of a row is that of its own partition plus a
carry from its group's partitions before it, so no group is ever sorted or summed in one task.  A partition begins with
at most one group that started earlier, so the groups that need a carry have at most twice as many rows of it as there are
partitions; that bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage

PART = "__pid"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with __pid, its range partition by keys and order (ascending, nulls first), written to the shared folder."""
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))


def _same(names: Sequence[str], mark: str) -> Column:
    """Equality of columns and their marked twins, nulls being equal."""
    return reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"{mark}{n}")) for n in names))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] = {}, totals: Mapping[str, Column] = {}, before: Mapping[str, Column] = {}, after: Mapping[str, Column] = {}, last: Mapping[str, Column] = {}, following: Mapping[str, Column] = {}) -> DataFrame:
    """Adds columns to rows of ``ranged``, by group and in its order.

    sums: running sums, the row included (null counts as 0).  totals: sums over the group.  before, after: the value in the
    row before or after.  last, following: the nearest value that is not null up to this row, or from it on.
    """
    by = [PART, *keys]
    place = F.struct(*order)
    partial = {f"__s_{n}": F.sum(c) for n, c in (*sums.items(), *totals.items())}
    partial |= {f"__b_{n}": F.max_by(F.struct(c.alias("v")), place) for n, c in before.items()}
    partial |= {f"__a_{n}": F.min_by(F.struct(c.alias("v")), place) for n, c in after.items()}
    partial |= {f"__l_{n}": F.max_by(c, F.when(c.isNotNull(), place)) for n, c in last.items()}
    partial |= {f"__f_{n}": F.min_by(c, F.when(c.isNotNull(), place)) for n, c in following.items()}
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = group.orderBy(PART)
    earlier, later = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    parts = rows.groupBy(*by).agg(*(c.alias(n) for n, c in partial.items()), F.count("*").alias("__rows"))
    parts = parts.withColumn("__parts", F.count("*").over(group)).where("__parts > 1")
    carried = {f"__c_{n}": F.sum(f"__s_{n}").over(earlier) for n in sums} | {f"__t_{n}": F.sum(f"__s_{n}").over(group) for n in totals}
    carried |= {f"__c_{n}": F.lag(f"__b_{n}").over(ordered) for n in before} | {f"__c_{n}": F.lead(f"__a_{n}").over(ordered) for n in after}
    carried |= {f"__c_{n}": F.last(f"__l_{n}", True).over(earlier) for n in last} | {f"__c_{n}": F.first(f"__f_{n}", True).over(later) for n in following}
    carry = parts.select(*(F.col(n).alias(f"__k_{n}") for n in by), *(c.alias(n) for n, c in carried.items()))
    own = Window.partitionBy(*by)
    inside = own.orderBy(*order)
    up, down = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    made = {n: F.coalesce(F.sum(c).over(up), F.lit(0)) for n, c in sums.items()} | {n: F.sum(c).over(own) for n, c in totals.items()}
    made |= {n: F.lag(F.struct(c.alias("v"))).over(inside) for n, c in before.items()} | {n: F.lead(F.struct(c.alias("v"))).over(inside) for n, c in after.items()}
    made |= {n: F.last(c, True).over(up) for n, c in last.items()} | {n: F.first(c, True).over(down) for n, c in following.items()}
    held = {f"__m_{n}": c for n, c in made.items()}
    joined = rows.withColumns(held).join(F.broadcast(carry), _same(by, "__k_"), "left")
    final = {n: F.col(f"__m_{n}") + F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in sums}
    final |= {n: F.coalesce(F.col(f"__t_{n}"), F.col(f"__m_{n}")) for n in totals}
    final |= {n: F.coalesce(F.col(f"__m_{n}"), F.col(f"__c_{n}"))["v"] for n in (*before, *after)}
    final |= {n: F.coalesce(F.col(f"__m_{n}"), F.col(f"__c_{n}")) for n in (*last, *following)}
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns if c not in final), *(c.alias(n) for n, c in final.items()))


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds __at, the place (from 0) of a row in its group, __n, the group's rows, and __pid."""
    one = F.lit(1).cast("long")
    return running(ranged(df, keys, order), keys, order, sums={"__at": one}, totals={"__n": one}).withColumn("__at", F.col("__at") - 1)


def attached(rows: DataFrame, keys: Sequence[str], per: DataFrame) -> DataFrame:
    """Left join of rows of ``ranged`` to one row per key (keys and others), however many rows a key has.

    Keys over several partitions, of which there are fewer than partitions, are broadcast; the others have at most the rows
    of one partition and are joined by shuffle.
    """
    wide = rows.groupBy(*keys).agg(F.min(PART).alias("__lo"), F.max(PART).alias("__hi")).where("__lo < __hi").select(*(F.col(k).alias(f"__w_{k}") for k in keys))
    twin = per.select(*(F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in per.columns))
    large = twin.join(F.broadcast(wide), reduce(lambda a, b: a & b, (F.col(f"__k_{k}").eqNullSafe(F.col(f"__w_{k}")) for k in keys)), "left_semi")
    on, off = _same(keys, "__k_"), _same(keys, "__w_")
    others = [c for c in per.columns if c not in keys]
    first = rows.join(F.broadcast(wide), off, "left_semi").join(F.broadcast(large), on, "left")
    second = rows.join(F.broadcast(wide), off, "left_anti").join(twin, on, "left")
    return first.select(*rows.columns, *others).unionByName(second.select(*rows.columns, *others))


def filled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, at: str = "__at") -> DataFrame:
    """Values that are null or not finite become linear between their neighbours, or the nearest at the ends; rows of ``places``.

    A group without values keeps nulls.
    """
    x = F.col(value).cast("double")
    good = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    known = F.when(good.isNotNull(), F.struct(F.col(at).alias("at"), good.alias("v")))
    out = running(rows, keys, order, last={"__left": known}, following={"__right": known})
    left, right = F.col("__left"), F.col("__right")
    share = F.try_divide(F.col(at) - left["at"], right["at"] - left["at"])
    between = left["v"] + (right["v"] - left["v"]) * F.coalesce(share, F.lit(0.0))
    return out.withColumn(value, F.coalesce(between, left["v"], right["v"])).drop("__left", "__right")
