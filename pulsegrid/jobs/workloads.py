"""End-to-end jobs: the wiring of the operators for the three workloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.lineage import cut_lineage
from ..operators import capacity as N
from ..operators import epochs as E
from ..operators import evaluation as V
from ..operators import features as X
from ..operators import hrv as H
from ..operators import models as M
from ..operators import recordings as R
from ..operators import series as S
from ..operators import signals as G
from ..operators import spectra as P


def upgrade_selection(kpi: DataFrame, catalogue: DataFrame, load_limit: float = 85.0) -> DataFrame:
    """kpi: cell, site, week_period, tech, code, power, load.  Returns site, week_period, tech, choice.

    Each site's first congested week by technology, with the band the decision tables choose from the site's bands and
    the refarming flags of that week.
    """
    three = (F.col("tech") == "3G") & ((F.col("code") > 85) | (F.col("power") > 85))
    congested = kpi.where(three | ((F.col("tech") == "4G") & (F.col("load") > load_limit))).groupBy("site", "tech").agg(F.min("week_period").alias("week_period"))
    bands = N.bands_per_site(kpi.select("cell", "site").distinct().join(catalogue, "cell"))
    flags = N.refarming_flags(N.site_features(kpi))
    rows = congested.join(bands, "site").join(flags, ["site", "week_period"])
    return rows.withColumns({"bw_bands": F.col("bands"), "band_bw": F.col("bands")}).select("site", "week_period", "tech", N.choose_band().alias("choice"))


def predicted_upgrades(history: DataFrame, predicted: DataFrame, catalogue: DataFrame, before: int, share: float = 0.85) -> DataFrame:
    """Upgrades of sites that a traffic forecast congests: site, sector, week_period, tech, demand, choice.

    history: cell, site, tech, week_period, traffic, busy_hour (traffic), code, power, prb, observed by week.  predicted:
    cell, site, sector, tech, week_period, traffic.  catalogue: cell, band, band_width.

    The last observed busy hour grows as the forecast does; code, power and block use follow it along the cell's slope
    through the origin.  Congested cells add up their demand by sector; each site's sector of largest demand in its first
    congested week before ``before`` counts, if that week is later than all observed ones.
    """
    newest = F.struct("week_period", "site", "tech")
    slopes = {v: N.slope_of("busy_hour", v) for v in ("code", "power", "prb")}
    told = history.groupBy("cell").agg(F.max_by(F.struct("traffic", "busy_hour"), newest).alias("__last"), *(s.alias(f"__{v}") for v, (s, _) in slopes.items()), F.least(*(n for _, n in slopes.values())).alias("__n"))
    told = told.where("__n > 0").select("cell", F.col("__last.traffic").alias("__traffic"), F.col("__last.busy_hour").alias("__busy"), *(f"__{v}" for v in slopes))
    ahead = predicted.join(told, "cell")
    busy = F.try_divide("traffic", "__traffic") * F.col("__busy")
    ahead = ahead.withColumns({v: busy * F.col(f"__{v}") for v in ("code", "power", "prb")}).select("cell", "site", "sector", "tech", "week_period", "code", "power", "prb")
    seen = catalogue.dropna(subset=["band"]).join(predicted, "cell", "left_semi")
    wide = N.cell_congestion(ahead.join(seen.select("cell", "band_width"), "cell", "left"), used="prb", share=share)
    hot = F.when(F.col("tech") == "3G", (F.col("code") > 85) | (F.col("power") > 85)).when(F.col("tech") == "4G", F.col("congested"))
    demand = N.sector_demand(wide.where(F.coalesce(hot, F.lit(False)))).withColumn("demand", F.round("demand", 6))
    weeks = N.top_sector(demand).where(F.col("week_period") < before)
    first = weeks.groupBy("site", "tech").agg(F.min_by(F.struct("week_period", "sector", "demand"), "week_period").alias("w")).select("site", "tech", "w.*")
    cells = ahead.select("cell", "site").distinct().join(seen, "cell")
    lists = cells.groupBy("site").agg(*(N.band_list(b).alias(n) for b, n in ((F.col("band"), "bands"), (F.col("band_width"), "bw_bands"), (F.concat("band", "band_width"), "band_bw"))))
    flags = N.refarming_flags(N.site_features(ahead.withColumnRenamed("prb", "load")))
    rows = first.join(flags, ["site", "week_period"]).join(lists, "site")
    return N.weeks_after(rows.select("site", "sector", "week_period", "tech", "demand", N.choose_band().alias("choice")), history)


def clean_skin_signal(samples: DataFrame, keys: Sequence[str], labels: DataFrame, rests: dict[str, str], driving: Sequence[str], value: str = "eda", rate: int = 1000, trigger: str = "trigger", **defects) -> DataFrame:
    """Skin conductance of a recording from the raw samples to baseline-corrected ones.

    Triggers are filled, defects repaired by trigger run, the signal low-passed (6th order, 1 Hz) and each sample labelled by
    its epoch (labels: keys, epoch, first, last, label; -1 is an artefact).  Artefacts take the mean of the clean samples
    of the driving phases around them.  Tonic and phasic parts come from the 8 Hz series, and each sample is corrected by
    every rest phase (rests: name -> trigger).  Returns keys, tick, time, tonic, phasic and corrected_<name>.
    """
    filled = R.trigger_runs(R.fill_triggers(samples, keys, trigger), keys, trigger)
    repaired = G.repaired_runs(filled, [*keys, "run"], value, **defects)
    smooth = G.filtered(repaired, keys, f"{value}_repaired", float(rate), "low", 1.0).withColumn("filtered", F.col(f"{value}_repaired_filtered"))
    marked = E.spread_labels(smooth, labels, keys)
    clean = S.replace_artefacts(marked, keys, "filtered", F.col("label") == -1, F.col(trigger).isin(*driving))
    ticks = S.to_8hz(clean, keys, "filtered_clean", rate)
    step = max(rate // 8, 1)
    at = clean.where(F.col("idx") % step == 0).select(*keys, (F.col("idx") / step).cast("long").alias("tick"), "time", trigger)
    parts = G.tonic_phasic(ticks.join(at, [*keys, "tick"]).withColumn("eda", F.col("filtered_clean")), keys, "filtered_clean")
    out = S.range_baseline(parts, keys, {n: F.col(trigger) == t for n, t in rests.items()}, order="tick")
    return out.select(*keys, "tick", "time", "tonic", "phasic", *(f"corrected_{n}" for n in rests))


def clean_heart_signal(samples: DataFrame, keys: Sequence[str], template: Sequence[float], value: str = "ecg", chunk: int = 60_000, threshold: float = -0.07, trees: int = 100, **joins) -> DataFrame:
    """Heart signal with abnormal chunks replaced: keys, idx, value and score (that of the sample's chunk).

    Chunks are described by their statistics and beats, gaps in these filled forward, scored by an isolation forest over
    all recordings, and abnormal ones take the nearest clean chunk's samples; the joins are repaired.  A recording without
    a clean chunk passes unchanged with score 0.
    """
    cut = R.chunks(samples.select(*keys, "idx", value), chunk)
    by = [*keys, "chunk"]
    tops = G.peaks(cut, by, value, joins.get("height", 0.5), joins.get("distance", 150))
    beats = H.summary(H.nn_intervals(tops, by, "at", "n"), by, "n").select(*by, "nn_mean", "sdnn", "rmssd")
    told = X.signal_statistics(cut, by, value).select(*by, "mean", "std", "max", "min", "rms").join(beats, by, "left")
    told = S.fill_missing_chunks(told, keys, ["nn_mean", "sdnn", "rmssd"])
    scored = M.isolation_scores(told, by, ["mean", "std", "max", "min", "rms", "nn_mean", "sdnn", "rmssd"], trees=trees, threshold=threshold)
    marks = R.nearest_clean(scored.select(*by, "score", "abnormal"), keys)
    spliced = G.spliced_chunks(cut.join(marks, by), keys, value).withColumn("spliced", F.col("abnormal") & F.col("donor").isNotNull())
    kept = G.repaired_joins(spliced, keys, value, template, **joins)
    hopeless = F.min(F.col("abnormal").cast("int")).over(Window.partitionBy(*keys)) == 1
    return kept.withColumn("score", F.when(hopeless, 0.0).otherwise(F.col("score"))).select(*keys, "idx", value, "score")


#: Wavelets and levels of each signal, in the order eda, ecg, rsp.
WAVELETS = ([("haar", 4), ("db4", 4), ("db10", 8)], [("coif5", 14), ("db4", 8)], [("db4", 8)])


def feature_matrix(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], rest_phase: str, eda: str, rsp: str, ecg: str, rate: int = 8, bucket_s: float = 60.0, trigger: str = "trigger", **options) -> DataFrame:
    """All features of each slalom in long form, outliers repaired over a recording's slaloms, in ratio to the rest phase:
    keys, slalom, feature, value.

    Blocks: statistics of each signal; wavelet statistics of each; skin responses; breaths; heart-rate variability
    (time domain, nonlinear, bands).  The rest phase is one more interval of its recording and goes through the blocks with the slaloms.
    """
    filled = R.fill_triggers(samples, keys, trigger)
    signals = list(dict.fromkeys((eda, rsp, ecg)))
    inside = R.split_by_intervals(filled, intervals, keys, bucket_s=bucket_s).select(*keys, F.concat(F.lit("s"), F.col("slalom").cast("string")).alias("part"), "idx", *signals)
    calm = R.in_phases(filled, [rest_phase], trigger).select(*keys, F.lit("rest").alias("part"), "idx", *signals)
    by = [*keys, "part"]
    placed = inside.unionByName(calm).withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy("idx")) - 1).cast("long"))
    made = cut_lineage(feature_blocks(cut_lineage(placed.drop("idx")), by, eda, rsp, ecg, rate, **options))
    slalom = F.expr(f"cast(substring(part, 2) AS {dict(intervals.dtypes)['slalom']})")
    parts = made.where("part <> 'rest'").select(*keys, slalom.alias("slalom"), "feature", "value")
    long = S.repair_outliers(parts, [*keys, "feature"], "slalom", large=None).drop("old", "repaired")
    return X.normalised(long, made.where("part = 'rest'").drop("part"), keys)


def feature_blocks(df: DataFrame, by: Sequence[str], eda: str, rsp: str, ecg: str, rate: int = 8, wavelet: str = "db4", levels: int = 3, wavelets: dict[str, list[tuple[str, int]]] | None = None, offset: float = 1.0, height: float = 0.5, beat_gap: int = 150, breath_gap: int = 8) -> DataFrame:
    """by, feature, value; df has place (from 0, without gaps) inside ``by``.

    wavelets: signal -> taps and levels (``WAVELETS`` are those of the study), whose features are named
    <signal>_<taps>_l<level>_<statistic>; without it each signal has one wavelet, named ``wavelet``.
    """
    names = list(dict.fromkeys((eda, rsp, ecg)))
    listed = {n: [(taps, taps, most) for taps, most in wavelets[n]] for n in wavelets} if wavelets else {n: [("wavelet", wavelet, levels)] for n in names}
    events = cut_lineage(G.interval_events(df, by, eda, rsp, ecg, listed, rate, offset, height, beat_gap, breath_gap))
    order = Window.partitionBy(*by).orderBy("place")
    crossings = {f"__cross_{n}": F.when(finite(F.col(n)) * F.lag(finite(F.col(n))).over(order) < 0, 1) for n in names}
    stats = X.described(df.withColumns(crossings), by, {f"{n}_": (F.col(n), F.col(f"__cross_{n}")) for n in names})
    out = [X.to_long(stats, by)]

    waves = X.described(events.where(~F.col("kind").isin("scr", "high", "low", "beat")), [*by, "kind"], {"": (F.col("v0"), None)})
    out.append(X.to_long(waves, [*by, "kind"]).select(*by, F.concat_ws("_", "kind", "feature").alias("feature"), "value"))
    measures = ["amplitude", "rise", "decay", "width", "auc"]
    responses = events.where("kind = 'scr'").select(*by, F.col("at").alias("apex"), *(F.col(f"v{i}").alias(m) for i, m in enumerate(measures)))
    skin = X.event_statistics(responses, by, measures, "apex")
    out.append(X.to_long(skin.select(*by, *(F.col(c).alias(f"scr_{c}") for c in skin.columns if c not in by)), by))
    high, low, beats = (events.where(F.col("kind") == k).select(*by, "n", "at", F.col("v0").alias("amplitude")) for k in ("high", "low", "beat"))
    breath = X.event_statistics(X.breath_measures(high, low, by), by, ["out_breath", "in_breath"], "n")
    counts = events.groupBy(*by).agg(F.count_if(F.col("kind") == "high").alias("peaks"), F.count_if(F.col("kind") == "low").alias("troughs"))
    breath = breath.join(counts, list(by))
    out.append(X.to_long(breath.select(*by, *(F.col(c).alias(f"rsp_{c}") for c in breath.columns if c not in by)), by))
    nn = H.nn_intervals(beats.withColumn("beat_ms", F.col("at") * (1000.0 / rate)), by, order="n").withColumnRenamed("n", "beat")
    nn = cut_lineage(H.beat_clock(nn, by))
    heart = H.summary(nn, by).join(H.poincare(nn, by), list(by), "left").join(G.nonlinear_measures(nn, by), list(by), "left").join(P.segment_bands(nn, by), list(by), "left")
    out.append(X.to_long(heart.select(*by, *(F.col(c).alias(f"hrv_{c}") for c in heart.columns if c not in by)), by))
    return R.stack(*out)


def interval_features(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], value: str, rest_phase: str, bucket_s: float = 60.0, trigger: str = "trigger") -> DataFrame:
    """Statistics per slalom, outliers repaired over a recording's slaloms, in ratio to the rest phase: keys, slalom, feature, value."""
    filled = R.fill_triggers(samples, keys, trigger)
    per = X.signal_statistics(R.split_by_intervals(filled, intervals, keys, bucket_s=bucket_s), [*keys, "slalom"], value)
    long = S.repair_outliers(X.to_long(per, [*keys, "slalom"]), [*keys, "feature"], "slalom", large=None).drop("old", "repaired")
    rest = X.to_long(X.signal_statistics(R.in_phases(filled, [rest_phase], trigger), list(keys), value), list(keys))
    return X.normalised(long, rest, keys)


def _with_rest(whole: DataFrame, rest: DataFrame) -> DataFrame:
    return R.stack(whole.withColumn("__rest", F.lit(False)), rest.withColumn("__rest", F.lit(True)))


def _in_ratio(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    long = cut_lineage(X.to_long(wide, [*keys, "__rest"], infinite=True))
    return X.normalised(long.where("NOT __rest").drop("__rest"), long.where("__rest").drop("__rest"), keys, infinite=True)


def heart_rest_ratios(nn: DataFrame, rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every time-domain and nonlinear measure of a series in ratio to that of its rest phase: keys, feature, value.

    nn, rest: keys, beat, nn.  Both go through one pass, told apart by a mark among the keys.  Without a rest phase, or with
    a measure of 0 there, the ratio is null; infinite rates (of beats at the same time) give what doubles give.
    """
    by = [*keys, "__rest"]
    both = cut_lineage(_with_rest(nn, rest))
    return _in_ratio(H.summary(both, by).join(H.poincare(both, by), by, "left").join(G.nonlinear_measures(both, by), by, "left"), keys)


def breath_rest_ratios(samples: DataFrame, rest: DataFrame, keys: Sequence[str], value: str, height: float, depth: float, distance: int, order: str = "idx") -> DataFrame:
    """Statistics and number of a recording's breaths in ratio to those of its rest phase: keys, feature, value.

    samples, rest: keys, order (consecutive in each), value.  Peaks are at least ``height``, troughs at most ``depth``.
    """
    by = [*keys, "__rest"]
    both = cut_lineage(_with_rest(samples.select(*keys, order, value), rest.select(*keys, order, value)))
    low = G.peaks(both.withColumn(value, -F.col(value)), by, value, -depth, distance, order).withColumn("amplitude", -F.col("amplitude"))
    breaths = X.breath_measures(G.peaks(both, by, value, height, distance, order), low, by)
    return _in_ratio(X.event_statistics(breaths, by, ["out_breath", "in_breath"], "n"), keys)


def time_domain(nn: DataFrame, keys: Sequence[str], binsize: float = 7.8125, duration_s: float = 300.0) -> DataFrame:
    """Summary, triangular index, TINN and Poincare plot of each series, and its segments' deviations, side by side.

    Series not longer than a segment have null deviations of segments.
    """
    hist = H.histogram(nn, keys, binsize)
    whole = X.wide_concat([H.summary(nn, keys), H.triangular_index(hist, keys), H.tinn(hist, keys, binsize), H.poincare(nn, keys)], keys)
    return whole.join(H.segment_deviations(H.segments(nn, keys, duration_s), keys), list(keys), "left")


def frequency_domain(nn: DataFrame, keys: Sequence[str], methods: Sequence[str] = ("welch", "lomb", "yule-walker"), **options) -> DataFrame:
    """Band tables of each series by method; nn has time in seconds."""
    parts = [P.segment_bands(nn, keys, method=m, **options).withColumn("method", F.lit(m)) for m in methods]
    return R.stack(*parts)


def nonlinear(nn: DataFrame, keys: Sequence[str]) -> DataFrame:
    return X.wide_concat([H.poincare(nn, keys), G.nonlinear_measures(nn, keys)], keys)


def hrv_report(nn: DataFrame, keys: Sequence[str], duration_s: float = 300.0, binsize: float = 7.8125, order: int = 16, nfft: int = 4096) -> DataFrame:
    """Time-domain and nonlinear measures and bands by all three methods of each segment: keys, segment and the measures.

    The deviations of segments are those of the whole series, the same in all its rows.
    """
    by = [*keys, "segment"]
    timed = cut_lineage(H.beat_clock(H.segments(nn, keys, duration_s), by))  # read by every measure
    parts = timed.drop("time")
    hist = H.histogram(parts, by, binsize)
    out = X.wide_concat([H.summary(parts, by), H.triangular_index(hist, by), H.tinn(hist, by, binsize), H.poincare(parts, by)], by)
    out = out.join(G.nonlinear_measures(parts, by), by, "left")
    for method, options in (("welch", {"nfft": nfft}), ("lomb", {}), ("yule-walker", {"order": order, "nfft": nfft})):
        bands = P.segment_bands(timed, by, method=method, **options)
        out = out.join(bands.select(*by, *(F.col(c).alias(f"{method.replace('-', '_')}_{c}") for c in bands.columns if c not in by)), by, "left")
    return out.join(H.segment_deviations(parts, keys), list(keys), "left")


def feature_selection(sample: DataFrame, features: Sequence[str], target: str, taus: Sequence[float], lams: Sequence[float], top: int = 30) -> DataFrame:
    """Features by the number of quantile levels at which the penalised regression keeps them: feature, votes."""
    grid = M.quantile_regression_grid(sample, features, target, taus, lams)
    return V.feature_votes(grid.where("feature <> ''"), top)


def repeated_evaluation(df: DataFrame, key: str, features: Sequence[str], target: str, threshold: float, repeats: int = 15, trees: int = 100, seed: int = 0, **options) -> DataFrame:
    """rep, auc of the forest's median against the binarised target, on repeated hash-random splits."""
    splits = V.repeated_splits(df, key, repeats, seed=seed)
    curves = None
    for rep in range(repeats):
        own = splits.where(F.col("rep") == rep)
        median = M.quantile_forest(own.where("train"), own.where("NOT train"), key, features, target, [50.0], trees=trees, seed=seed + rep, **options)
        scored = median.join(own.select(key, V.binarise(F.col(target), threshold).alias("label")), key).select(F.lit(rep).alias("rep"), F.col("value").alias("score"), "label")
        scored = cut_lineage(scored)
        curves = scored if curves is None else curves.unionByName(scored)
    return V.auc(V.roc_points(curves, ["rep"]), ["rep"])
