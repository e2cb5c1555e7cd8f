"""How many facts a customer had, as known when the event arrived.

For event e (arrival s, event time t, stream time T) and window W:

    available  = t >= T - 15 min
    late       = t <  T
    observed_W = 1 + #{ accepted h of the customer : h.s < s, max(t - W, T - 15 min) <= h.t <= t }

The count is over two orders (arrival and event time), so neither a RANGE frame nor
a ROWS frame gives it, and a range self-join would emit every pair of a busy
customer.  Instead the customer's time line is cut into slices; an event needs facts
of its own slice and of the last window before it (copied over), so (customer, slice)
is the unit of work and a hot customer becomes many units.  Inside a task the counts
of all units of an Arrow batch are found together in n log n.  Units with more than
``UNIT_LIMIT`` rows are cut once more, along both orders (see ``_dense_counts``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.dominance import count_below
from ledgerlens.session import materialize

# History retention and the longest allowed window.
RETENTION_MS = 15 * 60 * 1000
MAX_WINDOW_SECONDS = 600

SLICE_MS = 3600 * 1000
UNIT_LIMIT = 500_000
# Cuts of a dense unit along each of the two orders.
DENSE_CUTS = 1000
# Rows gathered before a numpy pass; whole units only.
PASS_ROWS = 100_000

_NONE = np.iinfo(np.int64).min


def available(time: str = "occurred_ms", stream_time: str = "stream_time_2") -> Column:
    return F.col(time) >= F.col(stream_time) - RETENTION_MS


def late(time: str = "occurred_ms", stream_time: str = "stream_time_2") -> Column:
    return F.col(time) < F.col(stream_time)


def observed_column(window_seconds: int) -> str:
    return f"observed_{window_seconds}"


def lower_bound_us(window_seconds: int) -> Column:
    """Earliest event time that counts, in microseconds; retention works on milliseconds."""
    return F.greatest(
        F.col("occurred_us") - F.lit(window_seconds * 1_000_000),
        (F.col("stream_time_2") - RETENTION_MS) * 1000,
    )


def with_history(
    accepted: DataFrame,
    windows: Sequence[int],
    *,
    slice_ms: int = SLICE_MS,
    unit_limit: int = UNIT_LIMIT,
    dense_cuts: int = DENSE_CUTS,
) -> DataFrame:
    """Add history_available, late and ``observed_<W>`` for every distinct window.

    Needs customerId, arrival_seq, occurred_us, occurred_ms, stream_time_2.  The
    observed counts are NULL where history is not available.
    """
    windows = sorted(set(windows))
    if any(not 1 <= w <= MAX_WINDOW_SECONDS for w in windows):
        raise ValueError("windows must be 1 to 600 seconds")
    flagged = accepted.withColumns({"history_available": available(), "late": late()})
    if not windows:
        return flagged

    slice_of = F.floor(F.col("occurred_ms") / F.lit(slice_ms)).cast("long")
    # Most units are small; only their counts tell, and they are combined map-side.
    dense = accepted.groupBy("customerId", slice_of.alias("__slice")).count().filter(F.col("count") > unit_limit).select("customerId", "__slice")
    has_dense = not dense.isEmpty()
    rows = flagged.withColumn("__slice", slice_of).withColumns(
        {f"__lo_{w}": lower_bound_us(w) for w in windows}
    )
    if not has_dense:
        return _sparse_counts(rows, windows, slice_ms)

    # The neighbours share facts with a dense unit, so a unit is dense with its successor.
    dense = materialize(dense)
    marked = dense.unionByName(dense.withColumn("__slice", F.col("__slice") + 1)).distinct().withColumn(
        "__dense", F.lit(True)
    )
    rows = materialize(
        rows.join(marked, ["customerId", "__slice"], "left")
        .withColumn("__dense", F.coalesce("__dense", F.lit(False)))
    )
    facts = _facts(rows.drop("__dense"), slice_ms).join(marked, ["customerId", "__slice"], "left")
    sparse = _sparse_counts(rows.filter(~F.col("__dense")).drop("__dense"), windows, slice_ms,
                            facts.filter(F.col("__dense").isNull()).drop("__dense"))
    heavy = _dense_counts(rows.filter("__dense").drop("__dense"), windows,
                          facts.filter("__dense").drop("__dense"), dense_cuts)
    return sparse.unionByName(heavy)


def _facts(rows: DataFrame, slice_ms: int) -> DataFrame:
    """Facts per slice: the slice's own and those of the last window before it."""
    base = rows.select("customerId", "__slice", "arrival_seq", "occurred_us", "occurred_ms")
    spill = base.filter(
        F.pmod("occurred_ms", F.lit(slice_ms)) >= slice_ms - MAX_WINDOW_SECONDS * 1000
    ).withColumn("__slice", F.col("__slice") + 1)
    return base.unionByName(spill).drop("occurred_ms")


def _sparse_counts(rows: DataFrame, windows: list[int], slice_ms: int,
                   facts: DataFrame | None = None) -> DataFrame:
    """One shuffle on (customer, slice), then a sorted Arrow pass over whole units."""
    # Only facts from before the slice need a copy; its own rows are facts already.
    if facts is None:
        spill = rows.filter(
            F.pmod("occurred_ms", F.lit(slice_ms)) >= slice_ms - MAX_WINDOW_SECONDS * 1000
        ).withColumn("__slice", F.col("__slice") + 1)
    else:
        first_us = F.col("__slice") * (slice_ms * 1000)
        spill = facts.filter(F.col("occurred_us") < first_us)
    extra = spill.select("customerId", "__slice", "arrival_seq", "occurred_us", F.lit(True).alias("__copy"))
    units = (
        rows.withColumn("__copy", F.lit(False))
        .unionByName(extra, allowMissingColumns=True)
        .repartition("customerId", "__slice")
        .sortWithinPartitions("customerId", "__slice", "arrival_seq")
    )
    helper = [f"__lo_{w}" for w in windows] + ["__slice", "__copy"]
    kept = [f for f in units.schema.fields if f.name not in helper]
    names = [observed_column(w) for w in windows]
    schema = T.StructType(kept + [T.StructField(n, T.LongType()) for n in names])
    keep_names = [f.name for f in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches, ["customerId", "__slice"]):
            yield from _count_units(table, windows, keep_names).to_batches()

    return units.mapInArrow(count, schema)


def _unit_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for name in keys:
        column = table.column(name).combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        changed[1:] |= np.asarray(differs.to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(changed)


def _whole_units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no unit is cut; holds one pass plus one unit."""
    pending: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        pending.append(batch)
        rows += batch.num_rows
        if rows >= PASS_ROWS:
            table = pa.Table.from_batches(pending).combine_chunks()
            cut = int(_unit_starts(table, keys)[-1])
            if cut:
                yield table.slice(0, cut)
            pending = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(pending)


def _int(table: pa.Table, name: str) -> np.ndarray:
    column = pc.fill_null(table.column(name).combine_chunks(), _NONE) if table.column(name).null_count \
        else table.column(name).combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def _count_units(table: pa.Table, windows: list[int], keep: list[str]) -> pa.Table:
    table = table.combine_chunks()
    n = table.num_rows
    starts = _unit_starts(table, ["customerId", "__slice"])
    sizes = np.diff(np.r_[starts, n])
    unit = np.repeat(np.arange(len(starts)), sizes)
    time = _int(table, "occurred_us")
    base = np.repeat(np.minimum.reduceat(time, starts), sizes)
    is_row = ~table.column("__copy").to_numpy()
    bounds = [_int(table, f"__lo_{w}") for w in windows]

    # Units whose event times follow arrival need one binary search per bound.
    backward = np.r_[False, (time[1:] < time[:-1]) & (unit[1:] == unit[:-1])]
    mixed = np.zeros(len(starts), dtype=bool)
    mixed[unit[backward]] = True
    mixed_row = mixed[unit]

    counts = [np.ones(n, dtype=np.int64) for _ in windows]
    straight = np.flatnonzero(~mixed_row)
    if len(straight):
        span = np.int64((time - base).max() + 2)
        place = unit[straight] * span + (time[straight] - base[straight]) + 1
        rank = np.arange(len(straight))
        for out, bound in zip(counts, bounds):
            low = np.clip(bound[straight], base[straight] - 1, time[straight] + 1) - base[straight] + 1
            first = np.searchsorted(place, unit[straight] * span + low, side="left")
            out[straight] += np.maximum(rank - first, 0)
    crossed = np.flatnonzero(mixed_row)
    if len(crossed):
        asking = crossed[is_row[crossed]]
        m, q = len(crossed), len(asking)
        arrival = np.arange(n)
        group = np.r_[unit[crossed], np.tile(unit[asking], 1 + len(windows))]
        a = np.r_[arrival[crossed], np.tile(arrival[asking], 1 + len(windows))]
        b = np.concatenate([time[crossed], time[asking], *[bound[asking] - 1 for bound in bounds]])
        weight = np.r_[np.ones(m, dtype=np.int64), np.zeros(q * (1 + len(windows)), dtype=np.int64)]
        found = count_below(group, a, b, weight)[m:].reshape(1 + len(windows), q)
        for i, out in enumerate(counts):
            out[asking] += np.maximum(found[0] - found[1 + i], 0)

    known = table.column("history_available").to_numpy(zero_copy_only=False) == True  # noqa: E712
    columns = [table.column(name) for name in keep] + [pa.array(c, mask=~known) for c in counts]
    names = keep + [observed_column(w) for w in windows]
    return pa.table(columns, names=names).filter(pa.array(is_row))


def _dense_counts(rows: DataFrame, windows: list[int], facts: DataFrame, cuts: int) -> DataFrame:
    """Counts of units too large for one task.

    With arrival cut into strips i and event time into strips j, the facts below a
    query (a, b) in strip (i, j) are those of earlier strips in both orders (a grid of
    totals), those of the same time strip but an earlier arrival strip, and those of
    the same arrival strip.  Each part is the same counting problem on groups about
    ``cuts`` times smaller, and facts tied in time collapse to one weighted row.
    """
    unit = ["customerId", "__slice"]
    edges = materialize(
        facts.groupBy(*unit).agg(
            F.array_distinct(F.percentile_approx(
                "arrival_seq", [i / cuts for i in range(1, cuts)], F.lit(10 * cuts))).alias("a_edges"),
            F.array_distinct(F.percentile_approx(
                "occurred_us", [i / cuts for i in range(1, cuts)], F.lit(10 * cuts))).alias("b_edges"),
        )
    )

    def strips(df: DataFrame, a: str, b: str) -> DataFrame:
        # First edge not below the value, counted from one: ties share a strip.
        return df.join(edges, unit, "inner").withColumns({
            "i": _strip_of(F.col("a_edges"), F.col(a)),
            "j": _strip_of(F.col("b_edges"), F.col(b)),
        }).drop("a_edges", "b_edges")

    points = strips(
        facts.select(*unit, F.col("arrival_seq").alias("a"), F.col("occurred_us").alias("b")), "a", "b"
    )
    ends = F.array(
        F.struct(F.lit(0).alias("w"), F.col("occurred_us").alias("b")),
        *[F.struct(F.lit(w).alias("w"), (F.col(f"__lo_{w}") - 1).alias("b")) for w in windows],
    )
    asked = strips(
        rows.filter("history_available")
        .select(*unit, F.col("arrival_seq").alias("a"), F.inline(ends)), "a", "b"
    )
    points, asked = materialize(points), materialize(asked)

    grid = _weighted(points.groupBy(*unit, F.col("i").alias("a"), F.col("j").alias("b")).count(),
                     asked.select(*unit, F.col("i").alias("a"), (F.col("j") - 1).alias("b")).distinct(), unit)
    tall = _weighted(points.groupBy(*unit, "j", F.col("i").alias("a"), "b").count(),
                     asked.select(*unit, "j", F.col("i").alias("a"), "b").distinct(), [*unit, "j"])
    flat = _weighted(points.select(*unit, "i", "a", "b", F.lit(1).cast("long").alias("count")),
                     asked.select(*unit, "i", "a", "b").distinct(), [*unit, "i"])

    below = (
        asked
        .join(grid.select(*unit, F.col("a").alias("i"), (F.col("b") + 1).alias("j"), F.col("below").alias("g")),
              [*unit, "i", "j"], "left")
        .join(tall.select(*unit, "j", F.col("a").alias("i"), "b", F.col("below").alias("t")),
              [*unit, "i", "j", "b"], "left")
        .join(flat.select(*unit, "i", "a", "b", F.col("below").alias("f")), [*unit, "i", "a", "b"], "left")
        .withColumn("below", F.coalesce("g", F.lit(0)) + F.coalesce("t", F.lit(0)) + F.coalesce("f", F.lit(0)))
    )
    upto = F.max(F.when(F.col("w") == 0, F.col("below")))
    per_row = below.groupBy(F.col("a").alias("arrival_seq")).agg(
        *[
            (F.lit(1) + F.greatest(upto - F.max(F.when(F.col("w") == w, F.col("below"))), F.lit(0)))
            .cast("long").alias(observed_column(w))
            for w in windows
        ]
    )
    helper = ["__slice"] + [f"__lo_{w}" for w in windows]
    return rows.drop(*helper).join(per_row, "arrival_seq", "left")


def _strip_of(edges: Column, value: Column) -> Column:
    """Number of edges below ``value``, by binary halving of the sorted array."""
    lo_hi = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(edges, mid) < value)
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), lo_hi, halve)["lo"]


def _weighted(facts: DataFrame, queries: DataFrame, group: list[str]) -> DataFrame:
    """``count_below`` over (group, a, b, count) facts for (group, a, b) queries."""
    both = (
        facts.select(*group, F.col("a").cast("long"), F.col("b").cast("long"), F.col("count").alias("weight"))
        .unionByName(queries.select(*group, F.col("a").cast("long"), F.col("b").cast("long"),
                                    F.lit(0).cast("long").alias("weight")))
        .repartition(*group)
        .sortWithinPartitions(*group)
    )
    schema = T.StructType(
        [f for f in both.schema.fields if f.name != "weight"] + [T.StructField("below", T.LongType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches, group):
            table = table.combine_chunks()
            starts = _unit_starts(table, group)
            units = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))
            weight = _int(table, "weight")
            below = count_below(units, _int(table, "a"), _int(table, "b"), weight)
            out = table.drop_columns(["weight"]).append_column("below", pa.array(below))
            yield from out.filter(pa.array(weight == 0)).to_batches()

    return both.mapInArrow(count, schema)
