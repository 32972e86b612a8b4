"""Cell-network capacity: weekly load, congestion, sector demand, band choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_of, bands_of_technology, finite, leading_number, week_period

SITE = "New_Site"


def without_sentinel(df: DataFrame, column: str, sentinel: str = "NIL") -> DataFrame:
    """Rows whose text column is not the sentinel, cast to double; texts that are no numbers become null."""
    return df.where(F.col(column) != sentinel).withColumn(column, F.col(column).cast("string").try_cast("double"))


def busy_hour_load(df: DataFrame, rates: dict[str, float], occupation: str = "occupation", tech: str = "tech") -> DataFrame:
    """Adds load: occupation times the rate of the technology, null for unknown technologies."""
    rate = F.lit(None).cast("double")
    for name, value in rates.items():
        rate = F.when(F.col(tech) == name, value).otherwise(rate)
    return df.withColumn("load", F.col(occupation) * rate)


def site_congestion(df: DataFrame, limit: float = 85.0) -> DataFrame:
    """Adds congested: 3G by code or power use, 4G by load."""
    three = (F.col("code") > limit) | (F.col("power") > limit)
    return df.withColumn("congested", F.coalesce(F.when(F.col("tech") == "3G", three).when(F.col("tech") == "4G", F.col("load") > limit), F.lit(False)))


def cell_congestion(df: DataFrame, keys: Sequence[str] = ("cell",), used: str = "prb_used", band_width: str = "band_width", share: float = 0.85) -> DataFrame:
    """Adds bw (leading number of the cell's most frequent width, ties to the smallest) and congested.

    Width strings are counted per cell, so the rows of a cell are never collected.
    """
    counts = df.where(F.col(band_width).isNotNull()).groupBy(*keys, band_width).agg(F.count("*").alias("__n"))
    modal = counts.groupBy(*keys).agg(F.min_by(band_width, F.struct(-F.col("__n"), F.col(band_width))).alias("__mode"))
    own = df.join(modal, list(keys), "left").withColumn("bw", leading_number(F.col("__mode")))
    return own.withColumn("congested", F.coalesce(F.try_divide(F.col(used), F.col("bw") * 5) > share, F.lit(False))).drop("__mode")


def weekly(df: DataFrame, keys: Sequence[str], values: Sequence[str], day: str = "day") -> DataFrame:
    """NaN-skipping means by key and week_period."""
    return df.withColumn("week_period", week_period(F.col(day))).groupBy(*keys, "week_period").agg(*(F.avg(finite(F.col(v))).alias(v) for v in values))


def site_features(df: DataFrame, keys: Sequence[str] = ("week_period", "site", "tech"), values: Sequence[str] = ("load", "code", "power")) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.max(v).alias(v) for v in values))


def bands_per_site(df: DataFrame, site: str = "site", band: str = "band", name: str = "bands") -> DataFrame:
    """Distinct bands of a site, upper-case, sorted, joined by underscores."""
    return df.groupBy(site).agg(band_list(F.col(band)).alias(name))


def band_list(band: Column) -> Column:
    return F.upper(F.array_join(F.array_sort(F.collect_set(band)), "_"))


def refarming_flags(weekly_site: DataFrame) -> DataFrame:
    """site, week_period, refarming_3g, refarming_2g from rows (site, week_period, tech, code, power, load)."""
    k = ["site", "week_period"]
    first = weekly_site.groupBy(*k).agg(*(F.max(F.when(F.col("tech") == t, F.col(v))).alias(f"{v}_{t.lower()}") for t, v in (("3G", "code"), ("3G", "power"), ("2G", "load"))))
    three = F.coalesce(F.col("code_3g") < 90, F.lit(False)) & F.coalesce(F.col("power_3g") < 90, F.lit(False))
    return first.select(*k, three.cast("int").alias("refarming_3g"), F.coalesce(F.col("load_2g") < 2, F.lit(False)).cast("int").alias("refarming_2g"))


def slope_through_origin(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    slope, n = slope_of(x, y)
    return df.groupBy(*keys).agg(slope.alias("slope"), n.alias("__n")).where("__n > 0").drop("__n")


def slope_of(x: str, y: str) -> tuple[Column, Column]:
    """Aggregates: the slope, and the number of rows that have both values."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.try_divide(F.sum(F.when(both, F.col(x) * F.col(y))), F.sum(F.when(both, F.col(x) * F.col(x)))), F.count_if(both)


def sector_demand(df: DataFrame, keys: Sequence[str] = ("site", "sector", "week_period")) -> DataFrame:
    """4G: width needed (prb / 5); 3G: carriers needed, by power or code above 85; summed over the cells of a sector."""
    over = [F.bround((F.col(v) - 85) / 85) for v in ("power", "code")]
    need = F.when(F.col("tech") == "4G", F.col("prb") / 5).when(F.col("tech") == "3G", F.greatest(*over))
    return df.withColumn("need", need).groupBy(*keys, "tech").agg(F.sum("need").alias("demand"))


def top_sector(demand: DataFrame, keys: Sequence[str] = ("site", "week_period", "tech")) -> DataFrame:
    """The sector with the largest demand, ties to the smallest sector."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("demand"), "sector")
    return demand.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_week(df: DataFrame, site: str = "site", week: str = "week_period", before: int | None = None) -> DataFrame:
    """The row of each site's earliest congested week, optionally before a week; ties to the smallest row."""
    rows = df if before is None else df.where(F.col(week) < before)
    rest = [c for c in df.columns if c not in (site, week)]
    best = rows.groupBy(site).agg(F.min(F.struct(week, *rest)).alias("__r"))
    return best.select(site, "__r.*").select(*df.columns)


def traffic_growth(history: DataFrame, predicted: DataFrame, keys: Sequence[str], traffic: str = "traffic", week: str = "week_period") -> DataFrame:
    """Growth against the week before; the first predicted week grows from the last observed one.

    Returns keys, week, traffic, growth, busy_hour (last busy-hour traffic times predicted / last observed), observed.
    """
    w = Window.partitionBy(*keys).orderBy(week)
    seen = history.withColumn("growth", F.try_divide(F.col(traffic), F.lag(traffic).over(w)))
    last = history.groupBy(*keys).agg(F.max_by(traffic, week).alias("__last"), F.max_by("busy_hour", week).alias("__busy"))
    ahead = predicted.join(last, list(keys)).withColumn("growth", F.try_divide(F.col(traffic), F.col("__last")))
    ahead = ahead.select(*keys, week, traffic, "growth", (F.col("growth") * F.col("__busy")).alias("busy_hour"), F.lit(False).alias("observed"))
    return seen.select(*keys, week, traffic, "growth", "busy_hour", F.lit(True).alias("observed")).unionByName(ahead)


def with_catalogue(kpi: DataFrame, sectors: DataFrame, catalogue: DataFrame) -> DataFrame:
    """KPI rows with sector (by site, cell) and catalogue columns (by cell); unmatched rows stay."""
    return kpi.join(catalogue.dropDuplicates(["cell"]), "cell", "left").join(sectors.dropDuplicates(["site", "cell"]), ["site", "cell"], "left")


def choose_band(bw: str = "bw_bands", band_bw: str = "band_bw", bands: str = "bands", tech: str = "tech", r2: str = "refarming_2g", r3: str = "refarming_3g") -> Column:
    """The upgrade of a congested site, as the decision tables for 3G carriers and 4G bands say; '' if none applies."""
    BW, BB, BA = F.col(bw), F.col(band_bw), F.col(bands)
    two, three = F.col(r2) == 1, F.col(r3) == 1
    a, b, c = BB.contains("LTE21005M"), BB.contains("LTE210010M"), BB.contains("LTE9005M")
    new, U = F.lit("New_Site"), F.when(two, "U900").otherwise("New_Site")

    def pick(cond: Column, yes, no) -> Column:
        return F.when(cond, yes).otherwise(no)

    # The 3G table, by the exact set of carriers.
    third = {
        "F1_F2": pick(a, U, F.lit("F3")), "F1_F2_F3": U, "F1_F2_F3_U1": pick(c, new, U), "F1_F2_U1": pick(a, pick(c, new, U), F.lit("F3")), "F1_F2_U1_U2": pick(a, new, F.lit("F3")),
        "F1_U1": pick(b, pick(c, new, U), F.lit("F2")), "F1_F2_F3_U1_U2": new, "U1": F.lit("U1"), "F1": pick(b, U, F.lit("F2")), "F1_U1_U2": pick(b, new, F.lit("F2")), "F1_F3_U1": F.lit(None).cast("string"),
    }
    carriers = bands_of_technology(BW, F.lit("3G"))
    out3 = F.lit("")
    for name, value in third.items():
        out3 = F.when(carriers == name, value).otherwise(out3)
    l18, l21, l9 = BA.contains("LTE1800"), BA.contains("LTE2100"), BA.contains("LTE900")
    tdd, five21 = F.lit("2600TDD/New_Site"), F.lit("5M_LTE2100")
    out4 = F.lit("")
    out4 = F.when(l18 & ~l9 & ~l21, pick(three | two, five21, tdd)).otherwise(out4)
    out4 = F.when(l18 & l21 & ~l9 & a, pick(three | two, five21, tdd)).otherwise(out4)
    out4 = F.when(l18 & l9 & ~l21, pick(three, five21, tdd)).otherwise(out4)
    out4 = F.when(l18 & l21 & ~l9 & b, F.concat(out4, pick(two, F.lit("5M_LTE900"), tdd))).otherwise(out4)
    out4 = F.when(l18 & l21 & l9 & a, pick(three, five21, tdd)).otherwise(out4)
    out4 = F.when(l18 & l21 & l9 & b, tdd).otherwise(out4)
    return F.when(F.col(tech) == "3G", out3).when(F.col(tech) == "4G", out4).otherwise(F.lit(""))


def weeks_after(df: DataFrame, observed: DataFrame, week: str = "week_period") -> DataFrame:
    """Rows of weeks later than the last observed one (one value to the driver)."""
    last = observed.agg(F.max(week).alias("w")).first()["w"]
    return df.where(F.col(week) > last) if last is not None else df.limit(0)


def without_idle(df: DataFrame, state: str = "state", band: str = "band") -> DataFrame:
    return df.where((F.col(state) != "NO_CONGESTION") & F.col(band).isNotNull())


def densify(df: DataFrame, demand: str = "demand", bands: str = "bands", band_bw: str = "band_bw", bw: str = "bw_bands", tech: str = "tech", r2: str = "refarming_2g", r3: str = "refarming_3g") -> DataFrame:
    """Adds upgrade, left (MHz of 4G demand still open) and new_site.

    3G: the carrier that the decision table of ``choose_band`` names.  4G: 5 MHz steps as long as at least 5 MHz are open.
    A step refarms 3G or 2G spectrum into 2100 (or 900) MHz and adds that band to the site's; without spectrum to refarm
    the site needs a new one.  What a step gives depends only on the bands and flags of the site, and a step adds a band
    that is there already or moves the site to the next row of the table, so that the steps have a closed form.
    """
    BA, BB = F.col(bands), F.col(band_bw)
    l18, l21, l9 = BA.contains("LTE1800"), BA.contains("LTE2100"), BA.contains("LTE900")
    two, three = F.col(r2) == 1, F.col(r3) == 1
    steps = F.when(F.col(demand) >= 5, F.floor(F.col(demand) / 5)).otherwise(0).cast("int")
    narrow = BB.contains("LTE21005M")

    def refarmed(can: Column, band: str) -> Column:
        return F.when(can, F.lit(band))

    # The 4G table, by the bands of the site; null where the site needs a new one, '' where nothing applies.
    step = F.when(l18 & l21 & ~l9, refarmed(three | two, "5M_LTE2100")).when(l18 & ~l21 & ~l9 & narrow, refarmed(three | two, "5M_LTE2100")).when(l18 & l21 & l9, refarmed(three, "5M_LTE2100")).otherwise(F.lit(""))
    four = (F.col(tech) == "4G") & (steps > 0)
    own = df.withColumns({"__step": step, "__steps": F.when(four, steps).otherwise(0)})
    acts = (F.col("__step") != "") & (F.col("__steps") > 0)
    new_site = four & F.col("__step").isNull()
    widened = F.when(new_site, "_2600TDD/newsite").when(acts, F.expr("repeat(__step, __steps)")).when(four, "NO_ACTION").otherwise("")
    carrier = F.regexp_replace(choose_band(bw, band_bw, bands, tech, r2, r3), "New_Site", "new_site")
    left = F.when(F.col(tech) == "4G", F.col(demand) - F.when(acts, 5.0 * F.col("__steps")).otherwise(0.0))
    return own.withColumns({"upgrade": F.when(F.col(tech) == "3G", F.coalesce(carrier, F.lit(""))).otherwise(widened), "left": left, "new_site": new_site | ((F.col(tech) == "3G") & F.coalesce(carrier == "new_site", F.lit(False)))}).drop("__step", "__steps")


def sorted_series(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a key together in one partition, in order: windows and grouped functions by these keys shuffle no more."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def any_band(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.where(any_of(F.col(column).contains(n) for n in names))
