"""Signal processing of recordings with numpy helpers inside Spark groups.

A group is one segment, run, or chunk with a halo, so its size is bounded by the parameters; a whole trigger run is taken only
for the repair of its defects.  Groups are sorted by ``order`` before a helper sees them.  Nulls
in a signal are interpolated linearly for the helpers; groups without values give nulls or no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as H
from ..functions.lineage import cut_lineage
from .ranges import filled, places, running
from .selection import SHORT, split_by_size


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _interpolated(x: np.ndarray) -> np.ndarray:
    bad = ~np.isfinite(x)
    if bad.any() and not bad.all():
        x[bad] = np.interp(np.flatnonzero(bad), np.flatnonzero(~bad), x[~bad])
    return x


def _filled(column: pa.ChunkedArray) -> np.ndarray:
    return _interpolated(column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float))


def _changes(keys: pa.Table) -> np.ndarray:
    """Whether a row's keys differ from those of the row before, from the second row on; nulls are equal."""
    out = np.zeros(max(keys.num_rows - 1, 0), bool)
    for column in keys.combine_chunks().columns:
        codes = pc.dictionary_encode(column, null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
        out |= codes[1:] != codes[:-1]
    return out


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a group in one partition and in order.

    The hash of the keys is an expression of its own: Spark leaves out a repartitioning by keys above a union of tables that are
    partitioned by them, and may then coalesce their partitions apart.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small inputs stay apart: the work is in the function
    return df.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def by_group(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], f: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """f(table, starts) of whole groups: table holds many small groups (or one that is larger than an Arrow batch), sorted by
    keys and order, and starts the place of each group's first row.

    Partitions are read as a stream, so a task holds a batch or a group, and a group costs no batch of its own.
    """
    names = df.columns

    def run(batches):
        held, before = [], None

        def closed():
            table = pa.Table.from_batches(held)
            return f(table, np.r_[0, np.flatnonzero(_changes(table.select(keys))) + 1]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select(keys)
            starts = np.flatnonzero(_changes(pa.Table.from_batches([own] if before is None else [before, own]))) + (before is None)
            before = own.slice(batch.num_rows - 1, 1)
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                if any(part.num_rows for part in held):
                    yield from closed()
                held.clear()
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from closed()

    return dealt(df, keys, [order] if isinstance(order, str) else order).select(*names).mapInArrow(run, schema)


def mapped(df: DataFrame, keys: Sequence[str], value: str, order: str, f: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Adds column ``name`` = f(values of the group in order), one value per row; other columns are kept."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        y, sound = np.full(len(x), np.nan), np.isfinite(x)
        whole = np.logical_and.reduceat(sound, starts)
        for lo, hi, good in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], whole.tolist(), strict=True):
            part = x[lo:hi] if good else _interpolated(x[lo:hi])
            if good or np.isfinite(part).all():
                y[lo:hi] = f(part)
        return table.append_column(name, pa.array(y, pa.float64(), mask=~np.isfinite(y)))

    return by_group(df, keys, order, run, f"{_kinds(df, df.columns)}, `{name}` double")


def with_halo(df: DataFrame, keys: Sequence[str], n: int, halo: int, order: str = "idx") -> DataFrame:
    """Adds __chunk and __own: every row goes to its chunk of n rows and, as halo, to chunks that need it (halo < n)."""
    at = F.col(order)
    own = F.floor(at / n)
    to = F.array_compact(F.array(own, F.when((at % n < halo) & (own > 0), own - 1), F.when(at % n >= n - halo, own + 1)))
    return df.withColumn("__chunk", F.explode(to)).withColumn("__own", F.col("__chunk") == own)


def sliding_median_large(df: DataFrame, keys: Sequence[str], value: str, k: int, order: str = "idx", n: int = 65_536) -> DataFrame:
    """Adds <value>_median for large odd k: chunks with k // 2 rows of halo are independent."""
    spread = with_halo(df, keys, max(n, k), k // 2, order)
    return mapped(spread, [*keys, "__chunk"], value, order, lambda x: H.median_filter(x, k), f"{value}_median").where("__own").drop("__chunk", "__own")


def filtered(df: DataFrame, keys: Sequence[str], value: str, fs: float, kind: str = "low", cutoff: float = 1.0, filter_order: int = 6, zero_phase: bool = False, order: str = "idx", n: int = 65_536) -> DataFrame:
    """Adds <value>_filtered by recording: low, high (Butterworth), notch, or mean (moving average of cutoff seconds).

    Both causal and zero-phase filters work on chunks of n rows with carried state.
    """
    if kind == "mean":
        b, a = np.full(max(int(cutoff * fs), 1), 1 / max(int(cutoff * fs), 1)), np.array([1.0])
    else:
        b, a = H.notch(cutoff, fs) if kind == "notch" else H.butterworth(filter_order, cutoff, fs, kind)
    if zero_phase:
        return _zero_phase(df, keys, value, b, a, order, n, f"{value}_filtered")
    return _causal(df, keys, value, b, a, order, n, f"{value}_filtered")


def _causal(df: DataFrame, keys: Sequence[str], value: str, b: np.ndarray, a: np.ndarray, order: str, n: int, name: str) -> DataFrame:
    """A filter is linear: the state at a chunk's end is that of the chunk alone plus what is left of the state at its start.

    So chunks that have a successor are filtered from silence for their end state, the few numbers of each chunk are chained
    along the recording, and every chunk is filtered from the state it starts with.
    """
    by, columns, states = [*keys, "__chunk"], df.columns, {"__z": pa.list_(pa.float64())}
    cut = df.withColumn("__chunk", F.floor(F.col(order) / n).cast("long"))
    last = F.max("__chunk").over(Window.partitionBy(*keys))
    followed = cut.select(*by, order, value).withColumn("__last", last).where(F.col("__chunk") < F.col("__last")).drop("__last")

    def ended(table: pa.Table) -> dict[str, list]:
        x = _filled(table.column(value))
        return {"__m": [len(x)], "__z": [H.lfilter_on(b, a, np.nan_to_num(x))[1].tolist()]}

    def chained(table: pa.Table) -> dict[str, list]:
        z, out = None, []
        for m, alone in zip(table.column("__m").to_pylist(), table.column("__z").to_pylist(), strict=True):
            z = np.array(alone) + (0.0 if z is None else H.fading(b, a, m) @ z)
            out.append(z.tolist())
        return {"__next": [c + 1 for c in table.column("__chunk").to_pylist()], "__z": out}  # the state the next chunk starts with

    ends = sorted_groups(followed, by, order, ended, {"__m": pa.int64()} | states, "__m long, __z array<double>")
    starts = sorted_groups(ends, keys, "__chunk", chained, {"__next": pa.int64()} | states, "__next long, __z array<double>").withColumnRenamed("__next", "__chunk")

    def run(table: pa.Table, firsts: np.ndarray) -> pa.Table:
        given = table.column("__z").is_valid().to_numpy().astype(bool)
        x = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        y = np.full(len(x), np.nan)
        for lo, hi in zip(firsts.tolist(), [*firsts[1:].tolist(), len(x)], strict=True):
            z = None
            if given[lo]:  # the row of the state, which has no place and so comes first
                z, lo = np.array(table.column("__z")[lo].as_py()), lo + 1
            part = _interpolated(x[lo:hi])
            if len(part) and np.isfinite(part).all():
                y[lo:hi] = H.lfilter(b, a, part, z)
        kept = table.append_column(name, pa.array(y, pa.float64(), mask=~np.isfinite(y))).filter(pa.array(~given))
        return kept.select([*columns, name])

    entered = cut.withColumn("__z", F.lit(None).cast("array<double>")).unionByName(starts, allowMissingColumns=True)
    return by_group(entered, by, order, run, f"{_kinds(df, columns)}, `{name}` double")


def _by_row(names: Sequence[str], f: Callable[[dict], dict], fields: dict[str, pa.DataType]):
    """For mapInArrow: rows with columns ``names`` kept and those of f(row) added, a few rows at a time."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = [f(row) for row in part.to_pylist()]
                own = [part.column(k) for k in names]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([m[k] for m in made], t) for k, t in fields.items())], [*names, *fields])

    return run


def _scanned(blocks: DataFrame, keys: Sequence[str], b: np.ndarray, a: np.ndarray, back: bool) -> DataFrame:
    """blocks: keys, __chunk, __v (array).  The blocks filtered from the first to the last, or back from the last to the first.

    The state in which a block is entered is an affine function of that in which its predecessor was: each block gives its
    offset (the state it leaves behind when entered in silence), the few numbers of each block are chained along the
    recording in sorted partitions, and every block is filtered from the state it starts with.
    """
    kinds, numbers = _kinds(blocks, keys), pa.list_(pa.float64())
    way = -1 if back else 1
    steady = H.steady_state(b, a)

    def left(row):
        x = np.array(row["__v"])[::way]
        return {"__m": len(x), "__edge": float(x[0]), "__z": H.lfilter_blocks(b, a, x)[1].tolist()}

    def chained(batches):
        before, z = None, None
        for batch in batches:
            out = []
            for *key, m, edge, alone in zip(*(batch.column(c).to_pylist() for c in (*keys, "__m", "__edge", "__z")), strict=True):
                if key != before:
                    before, z = key, steady * edge
                out.append(z.tolist())
                z = np.array(alone) + H.fading(b, a, m) @ z
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "__chunk")), pa.array(out, numbers)], [*keys, "__chunk", "__z"])

    ends = blocks.mapInArrow(_by_row([*keys, "__chunk"], left, {"__m": pa.int64(), "__edge": pa.float64(), "__z": numbers}), f"{kinds}, __chunk long, __m long, __edge double, __z array<double>")
    along = ends.repartition(*keys).sortWithinPartitions(*keys, F.col("__chunk") * way)
    starts = along.mapInArrow(chained, f"{kinds}, __chunk long, __z array<double>").select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__chunk").alias("__of"), "__z")
    on = F.col("__chunk") == F.col("__of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))

    def passed(row):
        return {"__v": H.lfilter_blocks(b, a, np.array(row["__v"])[::way], np.array(row["__z"]))[0][::way].tolist()}

    entered = blocks.join(starts, on).select(*keys, "__chunk", "__v", "__z")
    return cut_lineage(entered.mapInArrow(_by_row([*keys, "__chunk"], passed, {"__v": numbers}), f"{kinds}, __chunk long, __v array<double>"))


def _zero_phase(df: DataFrame, keys: Sequence[str], value: str, b: np.ndarray, a: np.ndarray, order: str, n: int, name: str) -> DataFrame:
    """Forward and back over blocks of n rows, after both ends of a recording have been reflected oddly.

    Null and non-finite values are interpolated; recordings without values give nulls, those of one row stay as they are.
    """
    rows = cut_lineage(filled(places(df.withColumn("__x", F.col(value)), keys, [order]), keys, [order], "__x"))
    pad = 3 * max(len(a), len(b))
    core = rows.where("__x IS NOT NULL AND __n > 1").select(*keys, F.col("__at").alias("__place"), "__x", "__n")
    reach = F.least(F.lit(pad).cast("long"), F.col("__n") - 1)
    mirror = {False: F.lit(0).cast("long"), True: F.col("__n") - 1}
    parts = [core]
    for at_end, edge in mirror.items():
        tip = core.where(F.col("__place") == edge).select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__x").alias("__tip"))
        near = core.where((F.col("__place") != edge) & (F.abs(F.col("__place") - edge) <= reach))  # at most ``pad`` rows of a recording
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        parts.append(near.join(tip, on).select(*keys, (2 * edge - F.col("__place")).alias("__place"), (2 * F.col("__tip") - F.col("__x")).alias("__x"), "__n"))
    wide = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("__chunk", F.floor((F.col("__place") + pad) / n).cast("long"))
    samples = F.array_sort(F.collect_list(F.struct("__place", "__x")))
    blocks = cut_lineage(wide.groupBy(*keys, "__chunk").agg(samples.alias("__s")).select(*keys, "__chunk", F.col("__s")["__x"].alias("__v"), F.col("__s")[0]["__place"].alias("__first")))
    done = _scanned(_scanned(blocks.drop("__first"), keys, b, a, False), keys, b, a, True)
    firsts = blocks.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__chunk").alias("__of"), "__first")
    on, same = F.col("__chunk") == F.col("__of"), F.col("__at") == F.col("__to")
    for k in keys:
        on, same = on & F.col(k).eqNullSafe(F.col(f"__k_{k}")), same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    made = done.join(firsts, on).select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__first", F.posexplode("__v").alias("__i", "__y"))
    made = made.select(*(f"__k_{k}" for k in keys), (F.col("__first") + F.col("__i")).alias("__to"), "__y")
    return rows.join(made, same, "left").select(*df.columns, F.when(F.col("__n") > 1, F.col("__y")).otherwise(F.col("__x")).alias(name))


def tonic_phasic(df: DataFrame, keys: Sequence[str], value: str, fs: float = 8.0, cutoff: float = 0.05, order: str = "tick") -> DataFrame:
    """Adds tonic (zero-phase low-pass) and phasic (the rest)."""
    slow = filtered(df, keys, value, fs, "low", cutoff, 2, True, order).withColumnRenamed(f"{value}_filtered", "tonic")
    return slow.withColumn("phasic", F.col(value) - F.col("tonic"))


def repaired_runs(df: DataFrame, keys: Sequence[str], value: str, n_max: int = 700, order: str = "idx", **options) -> DataFrame:
    """Adds <value>_repaired; keys include the trigger run."""
    return mapped(df, keys, value, order, lambda x: H.repair_defects(x, n_max, **options), f"{value}_repaired")


def sorted_groups(df: DataFrame, keys: Sequence[str], order: str, f: Callable[[pa.Table], dict[str, list]], fields: dict[str, pa.DataType], spark_fields: str, rows: int = 20_000) -> DataFrame:
    """keys and the rows that f(table of one group, sorted) gives, as lists by field.

    Partitions are sorted by keys and order and read as a stream: a task holds one group at a time, and many small groups share
    an Arrow batch.
    """
    names = df.columns

    def run(batches):
        out: list[list] = [[] for _ in (*keys, *fields)]
        held, key, kinds = [], None, None

        def batch_of():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*kinds, *fields.values()), strict=True)], [*keys, *fields])
            for column in out:
                column.clear()
            return made

        def closed():
            found = f(pa.Table.from_batches(held))
            n = len(found[next(iter(fields))])
            for column, values in zip(out, (*([k] * n for k in key), *(found[c] for c in fields)), strict=True):
                column.extend(values)

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for lo, hi in itertools.pairwise(edges):
                if lo == hi:
                    continue
                if held and own[lo] != key:
                    closed()
                    held.clear()
                    if len(out[0]) > rows:
                        yield batch_of()
                key = own[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            closed()
            yield batch_of()

    return dealt(df, keys, [order]).select(*names).mapInArrow(run, f"{_kinds(df, keys)}, {spark_fields}")


EVENT_FIELDS = {"kind": pa.string(), "n": pa.int64(), "at": pa.int64()} | {f"v{i}": pa.float64() for i in range(5)}


def interval_events(df: DataFrame, keys: Sequence[str], eda: str, rsp: str, ecg: str, wavelets: dict[str, list[tuple[str, str, int]]], rate: int = 8, offset: float = 1.0, height: float = 0.5, beat_gap: int = 150, breath_gap: int = 8, order: str = "place") -> DataFrame:
    """All that is found in the signals of an interval, in one pass: keys, kind, n, at (place), v0 to v4.

    Kinds: ``scr`` (amplitude, rise, decay, width, auc), ``high`` and ``low`` (turning points of the breath), ``beat`` (peaks of
    the heart signal), each with its value, and <signal>_<label>_l<level> for the coefficients of wavelets (signal -> label, taps,
    levels).  An interval is one group of a sorted stream.
    """
    taps = {name: H.wavelet_taps(name) for listed in wavelets.values() for _, name, _ in listed}

    def found(table: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in EVENT_FIELDS}

        def add(kind, at, *values):
            out["kind"] += [kind] * len(at)
            out["n"] += range(len(at))
            out["at"] += [int(a) for a in at]
            for i in range(5):
                out[f"v{i}"] += [float(v) for v in values[i]] if i < len(values) else [None] * len(at)

        place = table.column(order).to_numpy()
        for signal, listed in wavelets.items():
            x = _filled(table.column(signal))
            for label, name, levels in listed if np.isfinite(x).all() else ():
                for i, (first, coefs) in enumerate(H.wavelet_part(x, 0, len(x), taps[name], levels), 1):
                    add(f"{signal}_{label}_l{i}", range(first, first + len(coefs)), coefs)
        x = _filled(table.column(eda))
        responses = H.scr_peaks(x, offset=offset, fs=rate) if np.isfinite(x).all() else []
        add("scr", [place[p["apex"]] for p in responses], *([p[c] for p in responses] for c in ("amplitude", "rise", "decay", "width", "auc")))
        for kind, signal, sign, least, gap in (("high", rsp, 1, -np.inf, breath_gap), ("low", rsp, -1, -np.inf, breath_gap), ("beat", ecg, 1, height, beat_gap)):
            x = table.column(signal).cast(pa.float64()).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(~np.isnan(x))
            tops = good[H.find_peaks(sign * x[good], least, gap)] if len(good) > 2 else good[:0]
            add(kind, place[tops], x[tops])
        return out

    names = list(dict.fromkeys((*keys, order, eda, rsp, ecg, *wavelets)))
    return sorted_groups(df.select(*names), keys, order, found, EVENT_FIELDS, "kind string, n long, at long, v0 double, v1 double, v2 double, v3 double, v4 double")


def peaks(df: DataFrame, keys: Sequence[str], value: str, height: float, distance: int, order: str = "idx") -> DataFrame:
    """keys, n, at (position in the order column), amplitude: local maxima from the highest down, at least ``distance`` apart.

    Maxima come from neighbouring rows.  Runs of maxima less than ``distance`` apart don't touch each other, so only the
    maxima of one run meet in a group.  Of a plateau the first sample counts; gaps in the signal are left out.
    """
    own = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("amplitude"))
    w = Window.partitionBy(*keys).orderBy("at")
    before, after = F.lag("amplitude").over(w), F.lead("amplitude").over(w)
    place = F.row_number().over(w)
    top = own.withColumns({"__before": before, "__after": after, "__place": place}).where((F.col("amplitude") > F.col("__before")) & (F.col("amplitude") >= F.col("__after")) & (F.col("amplitude") >= height))
    far = F.col("__place") - F.lag("__place").over(w) >= distance
    run = F.sum(F.when(far, 1).otherwise(0)).over(w)
    runs = top.withColumn("__run", run).select(*keys, "at", "amplitude", "__place", "__run")

    def taken(table: pa.Table, starts: np.ndarray) -> pa.Table:
        keep = np.ones(table.num_rows, bool)  # what is alone in its run stays
        ends = np.r_[starts[1:], len(keep)]
        several = ends - starts > 1
        place, x = table.column("__place").to_numpy(), table.column("amplitude").to_numpy()
        for lo, hi in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            at, blocked, m = place[lo:hi].tolist(), bytearray(hi - lo), hi - lo
            for i in np.argsort(-x[lo:hi], kind="stable").tolist():
                if blocked[i]:
                    continue
                for way in (-1, 1):
                    j = i + way
                    while 0 <= j < m and abs(at[j] - at[i]) < distance:
                        blocked[j], j = 1, j + way
            keep[lo:hi] = np.frombuffer(blocked, np.uint8) == 0
        return table.filter(pa.array(keep))

    kept = by_group(runs, [*keys, "__run"], "__place", taken, _kinds(runs, runs.columns))
    return kept.select(*keys, (F.row_number().over(w) - 1).cast("int").alias("n"), "at", "amplitude")


def skin_responses(df: DataFrame, keys: Sequence[str], value: str, order: str = "tick", n: int = 65_536, **options) -> DataFrame:
    """keys and one row per skin response: apex, start, end (ticks), amplitude, rise, decay, width (s), auc, max_slope.

    A response reaches some seconds only, so chunks of n ticks with a halo give the same as the whole recording.
    """
    names = ["amplitude", "rise", "decay", "width", "auc", "max_slope"]
    fs = options.get("fs", 8)
    halo = 2 * int((options.get("start_wt", 4.0) + options.get("end_wt", 4.0) + options.get("offset", 1.0) + 1) * fs) + 2

    def f(t):
        x, at, own = _filled(t.column(value)), t.column(order).to_pylist(), t.column("__own").to_pylist()
        found = [p for p in H.scr_peaks(x, **options) if own[p["apex"]]]
        return {k: [at[p[k]] for p in found] for k in ("apex", "start", "end")} | {k: [p[k] for p in found] for k in names}

    fields = {k: pa.int64() for k in ("apex", "start", "end")} | {k: pa.float64() for k in names}
    spread = with_halo(df, keys, max(n, halo + 1), halo, order)
    return sorted_groups(spread, [*keys, "__chunk"], order, f, fields, "apex long, start long, end long, " + ", ".join(f"{n} double" for n in names)).drop("__chunk")


def steps(df: DataFrame, keys: Sequence[str], value: str, order: str = "tick", fs: float = 8.0, cutoff: float = 2.0, taps: int = 256, rise: float = 0.3, n: int = 65_536) -> DataFrame:
    """keys, tick of each step: strict minima of the low-passed motion near which it moves by more than ``rise``.

    The filter is finite, so chunks with a halo of the taps are exact.
    """
    h = H.fir_lowpass(taps, cutoff, fs)

    def f(t):
        x, at, own = _filled(t.column(value)), t.column(order).to_numpy(), t.column("__own").to_numpy(zero_copy_only=False).astype(bool)
        y = np.convolve(x, h)[(len(h) - 1) // 2 :][: len(x)]
        d = np.abs(np.diff(y))
        low = np.flatnonzero((y[1:-1] < y[:-2]) & (y[1:-1] < y[2:])) + 1
        keep = [i for i in low if 4 < i < len(d) - 4 and d[i - 4 : i + 4].max() > rise and own[i]]
        return {"tick": at[keep]}

    spread = with_halo(df, keys, max(n, 2 * taps), taps, order)
    return sorted_groups(spread, [*keys, "__chunk"], order, f, {"tick": pa.int64()}, "tick long").drop("__chunk")


def wavelet_details(df: DataFrame, keys: Sequence[str], value: str, taps: Sequence[float] | str, level: int, order: str = "idx", n: int = 65_536) -> DataFrame:
    """keys, level, k, coef of a multilevel transform.  taps: low-pass taps, or ``haar``, ``dbN``, ``coifN``.

    Works on chunks of n samples (more for many levels) with a halo of all levels' taps; each coefficient comes from the chunk
    in which its stretch of samples begins.
    """
    low = H.wavelet_taps(taps) if isinstance(taps, str) else np.array(taps, float)
    halo = len(low) << level
    size = -(-max(n, 2 * halo) >> level) << level
    rows = filled(places(df.select(*keys, order, F.col(value).alias("__x")), keys, [order]), keys, [order], "__x")
    spread = with_halo(rows.where("__x IS NOT NULL").select(*keys, "__at", "__x", "__n"), keys, size, halo, "__at")

    def f(t):
        start, total, chunk = t.column("__at")[0].as_py(), t.column("__n")[0].as_py(), t.column("__chunk")[0].as_py()
        out = {"level": [], "k": [], "coef": []}
        for i, (first, coefs) in enumerate(H.wavelet_part(t.column("__x").to_numpy(), start, total, low, level), 1):
            at = np.arange(first, first + len(coefs))
            mine = np.minimum((at << i) // size, (total - 1) // size) == chunk
            out["level"] += [i] * int(mine.sum())
            out["k"] += at[mine].tolist()
            out["coef"] += coefs[mine].tolist()
        return out

    return sorted_groups(spread, [*keys, "__chunk"], "__at", f, {"level": pa.int32(), "k": pa.int64(), "coef": pa.float64()}, "level int, k long, coef double").drop("__chunk")


def _key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys, nulls being equal; the right side's keys go."""
    twin = right.select(*(F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return left.join(twin, on, how).drop(*(f"__k_{k}" for k in keys))


def close_pairs(points: DataFrame, keys: Sequence[str], coords: Sequence[str], within: str, most: int = 4_096) -> DataFrame:
    """keys, pairs: unordered pairs of points whose coordinates all differ by less than ``within`` (a column, one value per key).

    Points lie in cells a little wider than that, so close ones are in one cell or in neighbours.  Equal points count as one
    with a weight, and the pairs of a cell whose own spread is small enough are counted without being formed.  What is left
    meets by cell and neighbour; cells of more than ``most`` points are split by a hash, so that a task compares at most
    ``most`` points with as many at a time.
    """
    m, r = len(coords), F.col(within)
    own = points.where(r > 0).groupBy(*keys, *coords).agg(F.count("*").cast("double").alias("__w"), F.max(within).alias("__r"))
    wide = F.col("__r") * (1 + 1e-9)
    own = cut_lineage(own.withColumn("__cell", F.array(*(F.floor(F.col(c) / wide) for c in coords))))
    spread = F.greatest(*(F.max(c) - F.min(c) for c in coords), F.lit(0.0))
    cells = own.groupBy(*keys, "__cell").agg(F.sum("__w").alias("__all"), F.sum(F.col("__w") * (F.col("__w") - 1) / 2).alias("__same"), F.count("*").alias("__m"), (spread < F.max("__r")).alias("__tight"))
    cells = cut_lineage(cells.withColumn("__parts", F.ceil(F.col("__m") / most).cast("int")))
    counted = cells.select(*keys, F.when(F.col("__tight"), F.col("__all") * (F.col("__all") - 1) / 2).otherwise(F.col("__same")).alias("pairs"))
    # Half of the neighbours, so that two cells meet once; a cell that is not tight meets itself.
    steps = [s for s in itertools.product((-1, 0, 1), repeat=m) if s >= (0,) * m]
    offsets = F.array(*(F.array(*(F.lit(v).cast("long") for v in s)) for s in steps))
    reach = cells.select(*keys, F.col("__cell").alias("__a"), "__tight", F.col("__parts").alias("__pa"), F.explode(offsets).alias("__step"))
    reach = reach.where(~F.col("__tight") | F.exists("__step", lambda v: v != 0)).withColumn("__b", F.zip_with("__a", "__step", lambda u, v: u + v))
    others = cells.select(*keys, F.col("__cell").alias("__b"), F.col("__parts").alias("__pb"))
    meets = cut_lineage(_key_join(reach, others, [*keys, "__b"]).select(*keys, "__a", "__b", "__pa", "__pb"))
    part = lambda n: F.pmod(F.xxhash64(*coords), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = [*keys, "__a", "__b", "__i", "__j"]
    left = _key_join(own.withColumnRenamed("__cell", "__a"), meets, [*keys, "__a"]).select(*keys, "__a", "__b", part("__pa").alias("__i"), every("__pb").alias("__j"), "__w", "__r", F.struct(*coords).alias("__u"))
    right = _key_join(own.withColumnRenamed("__cell", "__b"), meets, [*keys, "__b"]).select(*keys, "__a", "__b", every("__pa").alias("__i"), part("__pb").alias("__j"), F.col("__w").alias("__w2"), F.struct(*coords).alias("__v"))
    both = _key_join(left, right, by).where((F.col("__a") != F.col("__b")) | (F.col("__u") < F.col("__v")))
    for c in coords:
        both = both.where(F.abs(F.col("__u")[c] - F.col("__v")[c]) < F.col("__r"))
    met = both.groupBy(*keys).agg(F.sum(F.col("__w") * F.col("__w2")).alias("pairs"))
    return counted.unionByName(met).groupBy(*keys).agg(F.sum("pairs").alias("pairs"))


def nonlinear_measures(nn: DataFrame, keys: Sequence[str], order: str = "beat", dim: int = 2, tolerance: float | None = None, short: int = SHORT) -> DataFrame:
    """keys, sampen, dfa_short (4-16 beats), dfa_long (17-64 beats); null where there are too few beats.

    Groups of up to ``short`` beats are taken one after the other from sorted partitions, in one shuffle; longer ones go by
    ``_nonlinear_over_partitions``.
    """

    def measured(t: pa.Table) -> dict[str, list]:
        x = _filled(t.column("nn"))
        if not np.isfinite(x).all():
            return {"sampen": [None], "dfa_short": [None], "dfa_long": [None]}
        return {"sampen": [H.sample_entropy(x, dim, tolerance)], "dfa_short": [H.dfa(x, range(4, 17))], "dfa_long": [H.dfa(x, range(17, 65)) if len(x) >= 64 else None]}

    names = ("sampen", "dfa_short", "dfa_long")
    few, many = split_by_size(nn.select(*keys, order, F.col("nn").cast("double").alias("nn")), keys, short)
    out = sorted_groups(few, keys, order, measured, {c: pa.float64() for c in names}, ", ".join(f"{c} double" for c in names))
    return out if many is None else out.unionByName(_nonlinear_over_partitions(many, keys, order, dim, tolerance))


def _nonlinear_over_partitions(nn: DataFrame, keys: Sequence[str], order: str, dim: int, tolerance: float | None) -> DataFrame:
    """``nonlinear_measures`` of groups of any size.

    Sample entropy is -log of the share of template matches that stay matches when one beat longer (strict tolerance, a
    fifth of the deviation unless given); matches are pairs of close points, counted on a grid.  The fluctuation exponents are
    slopes of log fluctuation against log scale with linear detrending: sums over the windows of each scale of the running
    sum.  No task sees a whole recording.  Null intervals are interpolated.
    """
    rows = filled(places(nn.select(*keys, order, F.col("nn").cast("double").alias("nn")), keys, [order]), keys, [order], "nn")
    rows = running(rows, keys, [order], totals={"__sum": F.col("nn")})
    rows = rows.withColumn("__d", F.col("nn") - F.col("__sum") / F.col("__n"))
    rows = cut_lineage(running(rows, keys, [order], sums={"__y": F.col("__d")}, totals={"__ss": F.col("__d") * F.col("__d")}).select(*keys, "__at", "__n", "nn", "__y", "__ss"))
    within = F.lit(float(tolerance)) if tolerance is not None else 0.2 * F.sqrt(F.col("__ss") / (F.col("__n") + 1))
    parts = rows.where((F.col("__n") >= dim + 2) & F.col("nn").isNotNull()).select(*keys, "__at", "__n", "nn", within.alias("__within"), F.explode(F.array(*(F.lit(j) for j in range(dim + 1)))).alias("__j"))
    parts = parts.withColumn("__i", F.col("__at") - F.col("__j")).where((F.col("__i") >= 0) & (F.col("__i") < F.col("__n") - dim))
    names = [f"t{j}" for j in range(dim + 1)]
    points = parts.groupBy(*keys, "__i").agg(*(F.max(F.when(F.col("__j") == j, F.col("nn"))).alias(c) for j, c in enumerate(names)), F.max("__within").alias("__within"))
    points = cut_lineage(points)
    short = close_pairs(points, keys, names[:-1], "__within").select(*keys, F.col("pairs").alias("__b"), F.lit(None).cast("double").alias("__a"))
    long = close_pairs(points, keys, names, "__within").select(*keys, F.lit(None).cast("double").alias("__b"), F.col("pairs").alias("__a"))
    matches = short.unionByName(long).groupBy(*keys).agg(F.max("__b").alias("__b"), F.max("__a").alias("__a"))
    entropy = matches.select(*keys, F.when((F.col("__a") > 0) & (F.col("__b") > 0), -F.log(F.col("__a") / F.col("__b"))).alias("sampen"))

    s = F.col("__s")
    scaled = rows.select(*keys, "__at", "__n", "__y", F.explode(F.sequence(F.lit(4), F.lit(64))).alias("__s"))
    scaled = scaled.where((F.col("__n") >= 2 * s) & (F.col("__at") < F.floor(F.col("__n") / s) * s))
    place = F.col("__at") % s
    windows = scaled.groupBy(*keys, "__s", F.floor(F.col("__at") / s).alias("__window")).agg(F.var_pop("__y").alias("__v"), F.covar_pop("__y", place).alias("__c"), F.max("__n").alias("__n"))
    rest = F.greatest(F.col("__v") - F.col("__c") * F.col("__c") / ((s * s - 1) / 12), F.lit(0.0))
    scales = windows.groupBy(*keys, "__s").agg(F.sqrt(F.avg(rest)).alias("__f"), F.max("__n").alias("__n")).where("__f > 0")
    slope = lambda lo, hi, least: F.regr_slope(F.when(s.between(lo, hi) & (F.col("__n") >= least), F.log("__f")), F.log(s.cast("double")))
    slopes = scales.groupBy(*keys).agg(slope(4, 16, 0).alias("dfa_short"), slope(17, 64, 64).alias("dfa_long"))
    every = rows.select(*keys).distinct()
    return _key_join(_key_join(every, entropy, keys, "left"), slopes, keys, "left").select(*keys, "sampen", "dfa_short", "dfa_long")


def spliced_chunks(df: DataFrame, keys: Sequence[str], value: str, order: str = "idx") -> DataFrame:
    """Abnormal chunks take the samples of their donor chunk: rows (keys, chunk, idx, abnormal, donor, value).

    A self equi-join on (keys, chunk, place in the chunk).  Without a donor the samples stay.
    """
    first = F.min(order)
    starts = df.groupBy(*keys, "chunk").agg(first.alias("__start"))
    placed = df.join(starts, [*keys, "chunk"]).withColumn("__place", F.col(order) - F.col("__start"))
    donors = placed.select(*keys, F.col("chunk").alias("donor"), "__place", F.col(value).alias("__new"))
    out = placed.join(donors, [*keys, "donor", "__place"], "left")
    return out.withColumn(value, F.when(F.col("donor").isNotNull(), F.coalesce("__new", value)).otherwise(F.col(value))).drop("__start", "__place", "__new").select(*df.columns)


def repaired_joins(df: DataFrame, keys: Sequence[str], value: str, template: Sequence[float], height: float = 0.5, distance: int = 150, long: int = 1100, short: int = 400, usual: int = 600, ahead: int = 100, back: int = 200, around: int = 50, order: str = "idx") -> DataFrame:
    """Repairs the joins of spliced chunks: rows (keys, chunk, idx, spliced, value).

    The gap between the last peak of a chunk and the first of the next says whether a beat is missing or double where one
    of the two was spliced in.  A gap above ``long`` puts the template into the neighbour: ``ahead`` samples on in the
    chunk after, ``back`` from its end in the chunk before.  A gap below ``short`` zeroes ``around`` samples on both sides of
    the first peak of the chunk after the join.  A chunk without peaks counts as the usual gap.
    """
    m = len(template)
    first, size = F.min(order).alias("__first"), F.count("*").alias("__size")
    chunks = df.groupBy(*keys, "chunk").agg(first, size, F.max("spliced").alias("__spliced"))
    tops = peaks(df, [*keys, "chunk"], value, height, distance, order).groupBy(*keys, "chunk").agg(F.min("at").alias("__head"), F.max("at").alias("__tail"))
    w = Window.partitionBy(*keys).orderBy("chunk")
    own = chunks.join(tops, [*keys, "chunk"], "left")
    gap = F.coalesce(F.col("__head") - F.lag("__tail").over(w), F.lit(usual))
    after = F.lag("__spliced").over(w)  # the chunk before is spliced: this one is its right neighbour
    own = own.withColumns({"__gap": gap, "__after": F.coalesce(after, F.lit(False))})
    right = F.coalesce(F.lead("__gap").over(w), F.lit(usual))
    before = F.coalesce(F.lead("__spliced").over(w), F.lit(False))  # the chunk after is spliced: this one is its left neighbour
    own = own.withColumns({"__right": right, "__before": before}).select(
        *keys, "chunk", "__first", "__size",
        F.when(F.col("__after") & (F.col("__gap") > long), ahead).alias("__from_start"),
        F.when(F.col("__before") & (F.col("__right") > long), F.col("__size") - back).alias("__from_end"),
        F.when((F.col("__after") | F.col("__spliced")) & (F.col("__gap") < short), F.col("__head")).alias("__zero"),
    )
    place = F.col(order) - F.col("__first")
    new = F.col(value)
    for start in ("__from_start", "__from_end"):
        offset = place - F.col(start)
        new = F.when((offset >= 0) & (offset < m), F.element_at(F.array(*(F.lit(float(v)) for v in template)), (offset + 1).cast("int"))).otherwise(new)
    new = F.when((F.col(order) >= F.col("__zero") - around) & (F.col(order) < F.col("__zero") + around), 0.0).otherwise(new)
    return df.join(own, [*keys, "chunk"]).withColumn(value, new).select(*df.columns)
