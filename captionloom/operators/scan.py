"""Ordered prefix operators that never put one group's rows into one task.

A plain ``Window.partitionBy(rec_id)`` sends a whole recording to a single task. Here the
order is cut into blocks of bounded width (``position div width``): the window runs inside a
block, every block is summed up by a partial aggregation, the short table of block totals is
scanned in the same way, and its running values are joined back to the rows. With width 4096
and two levels a recording of 10^12 rows leaves about 6*10^4 rows for the last window.

Requirements: key columns are not null, order columns are integers and, taken together,
unique within a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def depth_for(df: DataFrame, pos: str, width: int = WIDTH) -> int:
    """Levels needed for integer positions ``pos``: 0 when every group provably fits one block.

    Runs a one-column maximum over ``df``; use it on stored tables. Operators default to the
    two-level plan, which needs no such proof.
    """
    top = df.agg(F.max(pos)).first()[0]
    if top is None or top < width:
        return 0
    return 1 if top < width * width else 2


def block_of(column: str, width: int) -> Column:
    return F.expr(f"`{column}` div {int(width)}")


# (running value before the row, total of a block, combination of carried and local value)
def _local(kind: str, value: Column, before: Window) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(value).over(before), F.lit(0))
    if kind == "max":
        return F.max(value).over(before)
    return F.last(value, ignorenulls=True).over(before)


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if kind == "max":
        return F.max(value)
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return carried + local
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def _windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Mapping) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({n: _local(k, v, before) for n, (k, v) in specs.items()})


def _scan(df, keys, order, specs, width, depth, first) -> DataFrame:
    if depth == 0:
        return _windowed(df, keys, order, specs)
    cut = len(order) - 1 if first or len(order) == 1 else len(order) - 2
    block = f"_blk{depth}"
    group = [*keys, *order[:cut], block]
    rows = df.withColumn(block, block_of(order[cut], width))
    totals = rows.groupBy(*group).agg(
        *[_total(k, v, order[cut:]).alias(f"_t_{n}") for n, (k, v) in specs.items()])
    lifted = {f"_c_{n}": (k, F.col(f"_t_{n}")) for n, (k, _) in specs.items()}
    carried = _scan(totals, keys, [*order[:cut], block], lifted, width, depth - 1, False)
    carried = carried.select(*group, *lifted)
    out = _windowed(rows, group, order[cut:], specs).join(carried, group)
    for n, (k, _) in specs.items():
        out = out.withColumn(n, _combine(k, F.col(f"_c_{n}"), F.col(n)))
    return out.drop(block, *lifted)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    width: int = WIDTH,
    depth: int | None = None,
) -> DataFrame:
    """Add, per row, aggregates over all *earlier* rows of the same key.

    ``sums`` start at 0, ``maxes`` and ``lasts`` (last value that is not null) at null.
    """
    specs = {n: ("sum", c) for n, c in (sums or {}).items()}
    specs |= {n: ("max", c) for n, c in (maxes or {}).items()}
    specs |= {n: ("last", c) for n, c in (lasts or {}).items()}
    columns = df.columns
    depth = len(order) + 1 if depth is None else depth
    out = _scan(df, list(keys), list(order), specs, width, depth, True)
    return out.select(*columns, *specs)


def join_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str], spread_by: Sequence[str], salts: int = 16) -> DataFrame:
    """Left join of rows with one row per key. A key's rows are dealt over ``salts`` tasks and its
    total row is copied to each, so a key that holds a third of the rows is not one task's work."""
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def with_previous(df: DataFrame, keys, order, columns: Mapping[str, str], **kw) -> DataFrame:
    """``lag``: for each ``new -> old`` pair the value of ``old`` in the row before (null at the start)."""
    packed = {f"_p_{new}": F.struct(F.col(old).alias("v")) for new, old in columns.items()}
    out = ordered_scan(df, keys, order, lasts=packed, **kw)
    return out.select(*df.columns, *[F.col(f"_p_{new}.v").alias(new) for new in columns])


def with_rank(df: DataFrame, keys, order, name: str, start: int = 1, **kw) -> DataFrame:
    """``row_number`` (from ``start``) in ``order`` within ``keys``."""
    out = ordered_scan(df, keys, order, sums={name: F.lit(1).cast("bigint")}, **kw)
    return out.withColumn(name, F.col(name) + F.lit(start).cast("bigint"))


def gap_groups(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    start: str,
    end: str,
    gap: int,
    *,
    name: str = "utt_id",
    width: int = WIDTH,
    depth: int = 2,
) -> DataFrame:
    """Number the runs of rows that are at most ``gap`` apart (``start - previous end > gap`` opens a run)."""
    return gap_blocks(df, keys, pos, start, end, gap, name=name, width=width, depth=depth)[0].select(*df.columns, name)


def gap_blocks(df, keys, pos, start, end, gap, *, name, width, depth, halo=0):
    """Rows with run numbers, ``_blk`` and ``_own``, and the block table (``_first`` and ``_last`` run).

    With ``halo`` > 0 the first rows of each block are also delivered as trailing copies
    (``_own = false``) of the block before.
    """
    if depth == 0:
        rows = df.withColumns({"_blk": F.lit(0).cast("bigint"), "_own": F.lit(True)})
        return _gap_level(rows, list(keys), pos, start, end, None, gap, None, name, width, 0)
    rows = df.withColumn("_blk", block_of(pos, width))
    if halo:
        lead = F.expr(f"`{pos}` % {width} < {halo} and _blk > 0")
        rows = rows.withColumn(
            "_blk", F.explode(F.when(lead, F.array("_blk", F.col("_blk") - 1)).otherwise(F.array("_blk"))))
    rows = rows.withColumn("_own", F.col("_blk") == block_of(pos, width))
    return _gap_level(rows, list(keys), pos, start, end, None, gap, "_blk", name, width, depth)


def _gap_level(rows, keys, pos, start, end, inner, gap, block, name, width, depth):
    """One level of ``gap_groups``: rows carry a block column; returns rows with the run number
    and the table of blocks with the numbers at their head."""
    group = [*keys, block] if block else list(keys)
    w = Window.partitionBy(*group).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_brk", F.coalesce(
        (F.col(start) - F.lag(end).over(w) > F.lit(gap)).cast("bigint"), F.lit(0).cast("bigint")))
    number = F.sum("_brk").over(upto)
    if inner:
        number = number + F.coalesce(F.sum(inner).over(before), F.lit(0))
    rows = rows.withColumn(name, number)
    if not block:
        return rows.drop("_brk"), None
    own = rows.filter("_own") if "_own" in rows.columns else rows
    extra = F.sum(inner) if inner else F.lit(0)
    s, e, n, g, up = (f"_{c}{depth}" for c in ("s", "e", "n", "g", "up"))
    totals = own.groupBy(*group).agg(
        F.min_by(start, pos).alias(s), F.max_by(end, pos).alias(e), (F.sum("_brk") + extra).alias(n))
    if depth > 1:
        totals = totals.withColumn(up, block_of(block, width))
    carried, _ = _gap_level(
        totals, keys, block, s, e, n, gap, up if depth > 1 else None, g, width, depth - 1)
    head = carried.select(*group, g)
    out = rows.join(head, group).withColumn(name, F.col(g) + F.col(name)).drop(g, "_brk")
    return out, carried.select(*group, F.col(g).alias("_first"), (F.col(g) + F.col(n)).alias("_last"))


def machine_entry(
    items: DataFrame,
    keys: Sequence[str],
    pos: str,
    step: str,
    *,
    name: str = "entry_state",
    width: int = 256,
    depth: int = 2,
) -> DataFrame:
    """State in which a finite-state machine reaches each item, started in state 0.

    ``step`` is an ``array<int>``: the exit state for each entry state. Items of a block are
    composed into one such array, so that even one endless group is handled block by block.
    Returns ``keys``, ``pos`` and ``name``.
    """
    items = items.select(*keys, F.col(pos).alias("_pos"), F.col(step).alias("_step"))
    return _machine_level(items, list(keys), width, depth).select(
        *keys, F.col("_pos").alias(pos), F.col("_entry").alias(name))


def _replay(first: Column, ordered: Column) -> Column:
    """Entry state of every item of a block, by folding from the block's own entry state."""
    empty = F.expr("cast(array() as array<struct<p:bigint,e:int>>)")
    return F.aggregate(
        ordered,
        F.struct(first.cast("int").alias("s"), empty.alias("out")),
        lambda acc, it: F.struct(
            F.element_at(it["_step"], acc["s"] + 1).cast("int").alias("s"),
            F.array_append(acc["out"], F.struct(it["_pos"].cast("bigint").alias("p"), acc["s"].alias("e"))).alias("out"),
        ),
    )["out"]


def _machine_level(items, keys, width, depth):
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_step")))
    if depth == 0:
        blocks = items.groupBy(*keys).agg(ordered.alias("_items"))
        done = blocks.withColumn("_r", F.explode(_replay(F.lit(0), F.col("_items"))))
    else:
        blocks = items.withColumn("_b", block_of("_pos", width)).groupBy(*keys, "_b").agg(ordered.alias("_items"))
        composed = F.expr(
            "transform(sequence(0, size(_items[0]._step) - 1), "
            "s -> aggregate(_items, s, (st, it) -> element_at(it._step, st + 1)))")
        totals = blocks.select(*keys, F.col("_b").alias("_pos"), composed.alias("_step"))
        heads = _machine_level(totals, keys, width, depth - 1)
        heads = heads.select(*keys, F.col("_pos").alias("_b"), F.col("_entry").alias("_head"))
        done = blocks.join(heads, [*keys, "_b"]).withColumn("_r", F.explode(_replay(F.col("_head"), F.col("_items"))))
    return done.select(*keys, F.col("_r.p").alias("_pos"), F.col("_r.e").alias("_entry"))
