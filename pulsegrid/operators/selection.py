"""Exact percentiles of groups of any size, by narrowing brackets around the ranks that are asked for.

``F.percentile`` holds all distinct values of a group in one executor.  Here a pass over the rows sums, for every rank, how many
values lie below, on and between the two ends of a bracket, and sketches the values between them; the next bracket is cut
from the sketch.  The sketch only proposes the ends: the counts are exact, so is the result.  A pass shrinks a bracket to a few
hundredths, whatever the distribution, and repeated values end it at once; only brackets, counts and sketches are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, interpolated
from ..functions.lineage import cut_lineage
from .ranges import _same

#: Rows from which a group counts as large; values left in a bracket that are sorted; rows of a table that is broadcast.
LARGE, SENT = 1_000_000, 100_000
#: Rows up to which a group of a sorted partition is small enough for work that takes the square of its rows.
SHORT = 2_048
GRID, ACCURACY = 256, 10_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def split_by_size(df: DataFrame, keys: Sequence[str], large: int | None = LARGE) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``large`` rows, and those of larger ones (None if there is none).  large None: all rows, None.

    Counts the groups first, so df is read once more.
    """
    if large is None:
        return df, None
    sizes = cut_lineage(df.groupBy(*keys).count().where(F.col("count") > large).select(*(F.col(k).alias(f"__k_{k}") for k in keys)))
    n = sizes.count()
    if n == 0:
        return df, None
    return df.join(_few(sizes, n), _same(keys, "__k_"), "left_anti"), df.join(_few(sizes, n), _same(keys, "__k_"), "left_semi")


def _inside(x: Column, lo: str, hi: str) -> Column:
    return (F.col(lo).isNull() | (x > F.col(lo))) & (F.col(hi).isNull() | (x < F.col(hi)))


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, points: Sequence[float], large: int = LARGE, infinite: bool = False) -> DataFrame:
    """keys and points, an array of the linearly interpolated percentiles, as ``F.percentile`` gives them; one row per group.

    Null and non-finite values don't count, with ``infinite`` infinities do; a group without values has no row.  Keys may be null.
    """
    number = F.nanvl(value.cast("double"), F.lit(None)) if infinite else finite(value.cast("double"))
    rows = cut_lineage(df.select(*keys, number.alias("__x")).where("__x IS NOT NULL"))
    x, twins = F.col("__x"), [f"__k_{k}" for k in keys]
    steps = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))

    def sketch(c: Column) -> Column:
        return F.percentile_approx(c, steps, ACCURACY)

    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), sketch(x).alias("edges")).withColumnsRenamed(dict(zip(keys, twins, strict=True)))
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)))
    place = (F.col("n") - 1) * F.col("at.p")
    ends = F.array(F.struct(F.lit(0).alias("upper"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("upper"), F.ceil(place).alias("rank")))
    asked = groups.withColumn("at", F.explode(at)).withColumn("place", place).withColumn("end", F.explode(ends))
    null = F.lit(None).cast("double")
    names = [*twins, "i", "place", "upper", "rank", "lo", "hi", "n", "edges", "found"]
    wants = cut_lineage(asked.select(*twins, "at.i", "place", "end.upper", "end.rank", null.alias("lo"), null.alias("hi"), "n", "edges", null.alias("found")))
    while (open_ := wants.where(F.col("found").isNull() & (F.col("n") > large)).count()) > 0:
        still = F.col("found").isNull() & (F.col("n") > large)
        share = (F.col("rank") + 0.5) / F.col("n") * GRID
        edge = [F.when(F.col("edges").isNotNull(), F.get("edges", c.cast("int"))) for c in (F.floor(share) - 2, F.ceil(share) + 2)]
        cut = wants.withColumn("a", F.coalesce(edge[0], "lo")).withColumn("b", F.coalesce(edge[1], "hi"))
        by = [*twins, "lo", "hi", "a", "b"]
        brackets = cut.where(still).select(*by).distinct()
        on_a, on_b = F.coalesce(x == F.col("a"), F.lit(False)), F.coalesce((x == F.col("b")) & ~F.col("a").eqNullSafe(F.col("b")), F.lit(False))
        own_lo, own_hi = F.col("a").eqNullSafe(F.col("lo")), F.col("b").eqNullSafe(F.col("hi"))
        between = (own_lo | (x > F.col("a"))) & (own_hi | (x < F.col("b")))
        counted = rows.join(_few(brackets, open_), _same(keys, "__k_") & _inside(x, "lo", "hi")).groupBy(*by).agg(
            F.count_if(~own_lo & (x < F.col("a"))).alias("below"), F.count_if(on_a).alias("on_a"), F.count_if(between).alias("between"), F.count_if(on_b).alias("on_b"),
            F.count("*").alias("all"), sketch(F.when(between, x)).alias("next"))
        counted = counted.withColumnsRenamed({c: f"__c_{c}" for c in by})
        told = cut.where(still).join(counted, _same(by, "__c_"))
        r, one, two, three = F.col("rank"), F.col("below"), F.col("below") + F.col("on_a"), F.col("below") + F.col("on_a") + F.col("between")
        four = three + F.col("on_b")
        case = F.when(r < one, 0).when(r < two, 1).when(r < three, 2).when(r < four, 3).otherwise(4)
        told = told.withColumn("case", case).select(
            *twins, "i", "place", "upper", (r - F.when(F.col("case") == 2, two).when(F.col("case") == 4, four).otherwise(0)).alias("rank"),
            F.when(F.col("case") == 2, F.col("a")).when(F.col("case") == 4, F.col("b")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("case") == 2, F.col("b")).when(F.col("case") == 0, F.col("a")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("case") == 2, F.col("between")).when(F.col("case") == 0, one).otherwise(F.col("all") - four).alias("n"),
            F.when(F.col("case") == 2, F.col("next")).alias("edges"), F.when(F.col("case") == 1, F.col("a")).when(F.col("case") == 3, F.col("b")).alias("found"))
        wants = cut_lineage(told.select(*names).unionByName(wants.where(~still).select(*names)))
    rest = wants.where("found IS NULL")
    small = rest.select(*twins, "lo", "hi").distinct()
    kept = rows.join(_few(small, rest.count()), _same(keys, "__k_") & _inside(x, "lo", "hi")).groupBy(*twins, "lo", "hi", "__x").agg(F.count("*").alias("w"))
    upto = F.sum("w").over(Window.partitionBy(*twins, "lo", "hi").orderBy("__x"))  # at most ``large`` rows
    kept = kept.withColumn("upto", upto).withColumnsRenamed({c: f"__c_{c}" for c in (*twins, "lo", "hi")})
    here = _same([*twins, "lo", "hi"], "__c_") & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("w"))
    got = rest.join(kept, here).select(*twins, "i", "place", "upper", F.col("__x").alias("found"))
    both = got.unionByName(wants.where("found IS NOT NULL").select(*twins, "i", "place", "upper", "found"))
    low, high = F.max(F.when(F.col("upper") == 0, F.col("found"))), F.max(F.when(F.col("upper") == 1, F.col("found")))
    spot = F.first("place")
    per = both.groupBy(*twins, "i").agg(low.alias("low"), high.alias("high"), (spot - F.floor(spot)).alias("share"))
    mixed = F.when(F.col("share") == 0, F.col("low")).otherwise(interpolated(F.col("low"), F.col("high"), F.col("share")))
    per = per.select(*twins, "i", mixed.alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return per.groupBy(*twins).agg(listed.alias("points")).withColumnsRenamed(dict(zip(twins, keys, strict=True)))
