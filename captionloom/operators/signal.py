"""Time-series operators on ``series_id, idx, value`` (``idx`` dense from 0).

Levels refer to 16-bit full scale. Everything per series is a two-step aggregation (windows, then
series) or a block scan; one long series is spread over many tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import BOUNDS, checked
from ..session import materialize, new_shared_path
from .scan import gap_groups, join_totals, machine_entry, with_previous

FULL_SCALE = 32768.0
CLIP = 32767.0
KEY = ["series_id"]


def levels(signal: DataFrame, full_scale: float = FULL_SCALE) -> DataFrame:
    """Level in dBFS per series; null for silence."""
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    return signal.groupBy(*KEY).agg(rms.alias("rms")).withColumn(
        "level_db", F.when(F.col("rms") > 0, 20 * F.log10(F.col("rms") / full_scale)))


def level_normalize(signal: DataFrame, target_db: float = -20.0, full_scale: float = FULL_SCALE) -> DataFrame:
    """Scale each series to ``target_db``; silence stays silence."""
    target_db = checked(target_db, *BOUNDS["target_db"], "target_db")
    gain = levels(signal, full_scale).select(*KEY, F.pow(F.lit(10.0), (target_db - F.col("level_db")) / 20).alias("_g"))
    out = join_totals(signal, gain, KEY, ["idx"])
    return out.withColumn("value", F.col("value") * F.coalesce("_g", F.lit(1.0))).drop("_g")


def exact_quantile(rows: DataFrame, value: str, q: float, keys=KEY, cells: int = 1 << 16, sortable: int = 1 << 16) -> DataFrame:
    """Exact quantile (linear interpolation) per key as ``quantile``, for values of any cardinality and scale.

    The two ranks are narrowed down to intervals of values. A round counts the values of each interval in ``cells``
    equal cells, in one pass with partial sums, and keeps the least and the largest value of the cell that holds
    the rank, so a far outlier costs one round and the scale of the data does not matter. Intervals of one value are done; those
    of ``sortable`` values or fewer are sorted. Null and not-a-number values don't count.
    """
    keys = list(keys)
    vals = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    size = materialize(vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    rank = F.lit(q) * (F.col("_n") - 1)
    want = size.select(*keys, F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))).alias("_r"), "_lo", "_hi", F.col("_n").alias("_c"))
    want = want.withColumn("_left", F.col("_r"))
    columns = [*keys, "_r", "_left", "_lo", "_hi", "_c"]
    while True:
        open_ = want.filter("_lo < _hi")
        most = open_.agg(F.max("_c")).first()[0]
        if most is None:
            break
        near = join_totals(vals, open_, keys, ["_v"]).filter("_v >= _lo and _v <= _hi")
        if most <= sortable:
            place = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy("_v")) - 1
            found = near.withColumn("_at", place).filter("_at = _left").withColumns({"_lo": F.col("_v"), "_hi": F.col("_v")})
        else:
            cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1))
            counts = near.groupBy(*keys, "_r", "_left", cell.alias("_cell")).agg(
                F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            upto = Window.partitionBy(*keys, "_r").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
            before = F.coalesce(F.sum("_c").over(upto), F.lit(0))
            found = counts.withColumn("_before", before).filter("_before <= _left and _left < _before + _c").withColumn(
                "_left", F.col("_left") - F.col("_before"))
        want = materialize(want.filter("_lo = _hi").select(columns).unionByName(found.select(columns)), "ranks")
    ends = want.groupBy(*keys).agg(F.min_by("_lo", "_r").alias("_a"), F.max_by("_lo", "_r").alias("_b"))
    part = rank - F.floor(rank)
    return ends.join(size, keys).select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("quantile"))


def soft_gate(signal: DataFrame, strength: float = 0.5, factor: float = 0.3, floors: DataFrame | None = None) -> DataFrame:
    """Scale samples below the noise threshold by ``factor`` and clip to 16 bit.

    Threshold: 5 % quantile of the magnitude times (1 + strength / 2). The quantile is exact, or taken from ``floors``
    (``series_id, quantile``), such as those that ``sketches.merge_levels`` makes of stored states.
    """
    strength = checked(strength, *BOUNDS["strength"], "strength")
    floor = floors.select(*KEY, "quantile") if floors is not None else exact_quantile(signal.withColumn("_m", F.abs("value")), "_m", 0.05)
    out = join_totals(signal, floor, KEY, ["idx"])
    quiet = F.abs("value") < F.col("quantile") * (1 + strength * 0.5)
    v = F.when(quiet, F.col("value") * factor).otherwise(F.col("value"))
    return out.withColumn("value", F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), v))).drop("quantile")


def rms_windows(signal: DataFrame, width: int) -> DataFrame:
    """RMS of consecutive windows of ``width`` samples (``win`` from 0); the last window of a series,
    full or not, is left out."""
    wins = signal.groupBy(*KEY, F.expr(f"idx div {int(width)}").alias("win")).agg(
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    last = wins.groupBy(*KEY).agg(F.max("win").alias("_last"))
    return join_totals(wins, last, KEY, ["win"]).filter("win < _last").drop("_last")


def change_points(
    signal: DataFrame, width: int, frame_rate: float, threshold: float = 0.5, min_sec: float = 2.0, depth: int = 2,
) -> DataFrame:
    """Windows whose RMS differs from the one before by more than ``threshold`` (relative), at least
    ``min_sec`` after the last one taken: ``series_id, win, at_sec``.

    The spacing rule is a finite-state machine over the candidates: the state is the number of windows
    still to wait.
    """
    rows = with_previous(rms_windows(signal, width), KEY, ["win"], {"_was": "rms"}, depth=depth)
    jump = F.abs(F.col("rms") - F.col("_was")) / (F.col("_was") + 1e-6) > threshold
    marks = rows.filter((F.col("_was") > 0) & jump).select(*KEY, "win")
    wait = max(1, math.ceil(min_sec * frame_rate / width - 1e-9))
    marks = with_previous(marks, KEY, ["win"], {"_pw": "win"}, depth=depth)
    marks = marks.withColumn("_d", F.least(F.coalesce(F.col("win") - F.col("_pw"), F.lit(0)), F.lit(wait)).cast("int"))
    step = F.expr(f"transform(sequence(0, {wait}), s -> if(s <= _d, {wait}, s - _d))")
    entry = machine_entry(marks.withColumn("_step", step), KEY, "win", "_step", depth=depth)
    taken = marks.join(entry, [*KEY, "win"]).filter("entry_state <= _d")
    return taken.select(*KEY, "win", (F.col("win") * width / frame_rate).alias("at_sec"))


def active_ranges(signal: DataFrame, width: int, threshold_db: float = -40.0, min_silence: int = 500, full_scale: float = FULL_SCALE, depth: int = 2) -> DataFrame:
    """Stretches that are not silent, in samples: windows above the level, joined over pauses shorter
    than ``min_silence`` samples: ``series_id, range_id, start, end``."""
    loud = full_scale * 10 ** (threshold_db / 20)
    wins = signal.groupBy(*KEY, F.expr(f"idx div {int(width)}").alias("win")).agg(
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max("idx").alias("_last"))
    on = wins.filter(F.col("rms") > loud).select(
        *KEY, "win", (F.col("win") * width).alias("_s"), (F.col("_last") + 1).alias("_e"))
    grouped = gap_groups(on, KEY, "win", "_s", "_e", min_silence - 1, name="range_id", depth=depth)
    return grouped.groupBy(*KEY, "range_id").agg(F.min("_s").alias("start"), F.max("_e").alias("end"))


def best_split(ranges: DataFrame, targets: DataFrame, window: int, depth: int = 2) -> DataFrame:
    """Cut near each target (``series_id, target, length``): the middle of the largest pause between active
    ranges within ``window`` around it, else the middle of the longest active range, else the target.

    Ranges and search areas meet by an equi-join on (series, time bucket).
    """
    half = window // 2
    area = targets.withColumns({
        "_lo": F.greatest(F.lit(0), F.col("target") - half), "_hi": F.least(F.col("length"), F.col("target") + half)})
    size = max(window, 1)
    left = area.filter("_lo < _hi").select(*KEY, "target", "_lo", "_hi").withColumn("_b", F.explode(F.expr(f"sequence(_lo div {size}, (_hi - 1) div {size})")))
    right = ranges.withColumn("_b", F.explode(F.expr(f"sequence(start div {size}, (end - 1) div {size})")))
    near = left.join(right, [*KEY, "_b"]).filter("start < _hi and end > _lo").select(
        *KEY, "target", F.greatest("start", "_lo").alias("s"), F.least("end", "_hi").alias("e")).distinct()
    # a search area holds at most window / pause-length ranges
    w = F.array_sort(F.collect_list(F.struct("s", "e")))
    per = near.groupBy(*KEY, "target").agg(w.alias("r"))
    gaps = F.expr(
        "filter(transform(sequence(0, greatest(size(r) - 2, 0)), i -> struct(get(r, i + 1).s - get(r, i).e as g, -get(r, i).e as p)), x -> x.g > 0)")
    per = per.withColumn("_gap", F.array_max(gaps)).withColumn(
        "_long", F.array_max(F.expr("transform(r, x -> struct(x.e - x.s as n, -x.s as p))")))
    cut = F.coalesce(F.expr("-_gap.p + _gap.g div 2"), F.expr("-_long.p + _long.n div 2"))
    return targets.join(per.select(*KEY, "target", cut.alias("_cut")), [*KEY, "target"], "left").withColumn(
        "cut", F.coalesce("_cut", "target")).drop("_cut")


def _best_cut(spans: list[tuple[int, int]], target: int, lo: int, hi: int) -> int:
    """The rule of ``best_split`` on the ranges (ascending) that meet the search area."""
    near = [(max(a, lo), min(b, hi)) for a, b in spans if a < hi and b > lo] if lo < hi else []
    pauses = [(b[0] - a[1], -a[1]) for a, b in zip(near, near[1:]) if b[0] > a[1]]
    if pauses:
        size, at = max(pauses)
        return size // 2 - at
    if near:
        size, at = max((b - a, -a) for a, b in near)
        return size // 2 - at
    return target


def plan_chunks(
    signal: DataFrame, ranges: DataFrame, target: int, window: int, threshold: int, per_round: int = 64,
) -> DataFrame:
    """Consecutive chunks of about ``target`` samples, cut at ``best_split`` points; a series shorter than
    ``threshold`` is one chunk: ``series_id, chunk_index, start, end, duration``.

    Each cut depends on the one before. All series advance together, ``per_round`` cuts at a time: a round
    gives each series the active ranges of that stretch only, and its cuts are written to the shared folder
    before the next one starts. So a series of any length never sits in one task.
    """
    if window >= target:
        raise ValueError("the search window must be smaller than the chunk")
    spark, path = signal.sparkSession, new_shared_path(signal.sparkSession, "plan")
    lengths = materialize(signal.groupBy(*KEY).agg((F.max("idx") + 1).alias("length")), "lengths")
    stretch = per_round * (target + window)
    ranges = materialize(
        ranges.withColumn("_b", F.explode(F.expr(f"sequence(start div {stretch}, (end - 1) div {stretch})"))), "ranges")
    state = lengths.select(*KEY, "length", F.lit(0).cast("bigint").alias("at"), F.lit(1).alias("chunk_index"))
    half, round_ = window // 2, 0
    schema = "series_id bigint, chunk_index int, start bigint, end bigint, length bigint"

    def cuts(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["series_id", "chunk_index", "start", "end", "length"])
        series, length, at, index = (int(own[c].iloc[0]) for c in ("series_id", "length", "at", "chunk_index"))
        spans = sorted(set(zip(near["start"].tolist(), near["end"].tolist())))
        ends = [e for _, e in spans]
        out = []
        while len(out) < per_round and at < length:
            goal = at + target
            if goal >= length or (index == 1 and length < threshold):
                end = length
            else:
                lo, hi = max(0, goal - half), min(length, goal + half)
                first = bisect_left(ends, lo)
                last = bisect_left(spans, (hi, 0))
                end = _best_cut(spans[first:last], goal, lo, hi)
            out.append((series, index, at, end, length))
            at, index = end, index + 1
        return pd.DataFrame(out, columns=["series_id", "chunk_index", "start", "end", "length"])

    while True:
        # a stretch may reach into the next bucket
        here = state.select(*KEY, "at", F.explode(F.expr(f"array(at div {stretch}, at div {stretch} + 1)")).alias("_b"))
        near = ranges.join(here, [*KEY, "_b"]).filter(f"end > at and start < at + {stretch}").select(*KEY, "start", "end")
        step = state.groupBy(*KEY).cogroup(near.select(*[F.col(c).alias(c) for c in near.columns]).groupBy(*KEY)).applyInPandas(cuts, schema)
        step.write.parquet(f"{path}/round={round_}")
        done = spark.read.schema(step.schema).parquet(f"{path}/round={round_}")
        state = done.groupBy(*KEY).agg(
            F.max("length").alias("length"), F.max("end").alias("at"), (F.max("chunk_index") + 1).alias("chunk_index")
        ).filter("at < length")
        round_ += 1
        if state.isEmpty():
            break
    plan = spark.read.schema(step.schema).parquet(path).select(*KEY, "chunk_index", "start", "end")
    return plan.withColumn("duration", F.col("end") - F.col("start"))
