"""Order-dependent operators that split one group over many tasks.

A window with an unbounded frame puts a whole group into one task.  Stream time
runs over a source partition or a customer bucket, which may hold a third of all
rows, so the scan is done in two levels: inside chunks of the arrival sequence,
and over the chunk maxima.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

CHUNK_WIDTH = 1 << 18


def running_max(df: DataFrame, group: Sequence[str], order: str, value: str, out: str,
                **options) -> DataFrame:
    """Add ``out``: the largest ``value`` seen so far inside ``group``."""
    return _running(df, list(group), order, value, out, F.max, F.greatest, **options)


def running_sum(df: DataFrame, group: Sequence[str], order: str, value: str, out: str,
                **options) -> DataFrame:
    """Add ``out``: the sum of ``value`` so far inside ``group``."""
    def plus(x: Column, y: Column) -> Column:
        return F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))

    return _running(df, list(group), order, value, out, F.sum, plus, **options)


def _running(
    df: DataFrame, group: list[str], order: str, value: str, out: str,
    reduce_: Callable[[Column], Column], combine: Callable[[Column, Column], Column],
    *, width: int = CHUNK_WIDTH, levels: int = 2, inclusive: bool = True,
) -> DataFrame:
    """Running aggregate of ``value`` along ``order``, a unique integer per group.

    A chunk of ``width`` order values holds at most ``width`` rows, so no task sees
    more than that of one group, at any level.  The rows are shuffled once, on
    (group, chunk); the chunk totals come from a map-side combined aggregate over
    three narrow columns.
    """
    end = 0 if inclusive else -1
    if levels <= 1:
        window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(out, reduce_(F.col(value)).over(window))

    chunk, total, before = f"__chunk{levels}", f"__total{levels}", f"__before{levels}"
    chunked = df.withColumn(chunk, F.floor(F.col(order) / F.lit(width)).cast("long"))
    totals = chunked.groupBy(*group, chunk).agg(reduce_(F.col(value)).alias(total))
    earlier = _running(
        totals, group, chunk, total, before, reduce_, combine,
        width=width, levels=levels - 1, inclusive=False,
    ).select(*group, chunk, before)
    window = Window.partitionBy(*group, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    return (
        chunked.join(earlier, [*group, chunk], "left")
        .withColumn(out, combine(reduce_(F.col(value)).over(window), F.col(before)))
        .drop(chunk, before)
    )


def first_at_or_after(
    facts: DataFrame, probes: DataFrame, key: Sequence[str], cell_width: int
) -> DataFrame:
    """For every probe (key, src, at) the smallest fact ``at`` that is not before it.

    Cells of ``cell_width`` keep a hot key out of a single task: inside the probe's
    cell a window decides, beyond it the first non-empty later cell does, found on
    one summary row per cell.  Returns key, src, nxt (NULL when there is none).
    """
    key = list(key)
    cell = F.floor(F.col("at") / F.lit(cell_width)).cast("long")
    points = (
        facts.select(*key, "at", F.col("at").alias("fact_at"), F.lit(None).cast("long").alias("src"))
        .unionByName(probes.select(*key, "at", F.lit(None).cast("long").alias("fact_at"), "src"))
        .withColumn("cell", cell)
    )
    # Walking downwards lets the frame grow from its start, which Spark evaluates in one pass.
    inside = (
        Window.partitionBy(*key, "cell")
        .orderBy(F.col("at").desc(), F.col("fact_at").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    beyond = (
        Window.partitionBy(*key).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = (
        points.groupBy(*key, "cell")
        .agg(F.min("fact_at").alias("cell_first"))
        .withColumn("later", F.min("cell_first").over(beyond))
        .select(*key, "cell", "later")
    )
    return (
        points.withColumn("within", F.min("fact_at").over(inside))
        .filter(F.col("src").isNotNull())
        .join(cells, [*key, "cell"], "left")
        .select(*key, "src", F.coalesce("within", "later").alias("nxt"))
    )


def follow_chain(start: DataFrame, successor: DataFrame, key: Sequence[str]) -> DataFrame:
    """All nodes (key, src) reached from ``start`` along ``successor`` (key, src, nxt).

    Pointer doubling: every round doubles the length of the jumps, so a chain of a
    million links takes twenty rounds, and each round joins on (key, node), which
    is unique and therefore even.  Links must point strictly forward.
    """
    key = list(key)
    reached = materialize(start.select(*key, "src"))
    jump = materialize(successor.filter(F.col("nxt").isNotNull()).select(*key, "src", "nxt"))
    while True:
        fresh = materialize(
            reached.join(jump, [*key, "src"], "inner").select(*key, F.col("nxt").alias("src"))
        )
        if fresh.isEmpty():
            return reached
        reached = materialize(reached.unionByName(fresh))
        second = jump.select(*key, F.col("src").alias("nxt"), F.col("nxt").alias("nxt2"))
        jump = materialize(
            jump.join(second, [*key, "nxt"], "inner").select(*key, "src", F.col("nxt2").alias("nxt"))
        )


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row of every key, as an aggregate so that map tasks combine first."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("__row")).select(*key, "__row.*")


def with_arrival(records: DataFrame, stamps: DataFrame | None = None, start: int = 0, *, stamp: Column | None = None,
                 width: int = CHUNK_WIDTH) -> tuple[DataFrame, DataFrame]:
    """``records`` with ``arrival_seq``, and how far the stamps of every source partition have come (slot, time).

    ``stamp`` gives microseconds, by default those of the column ``timestamp``.

    Inside a source partition the offset is the order; across partitions records are merged by their timestamp, then
    partition and offset.  A timestamp that goes back counts as the largest one before it (``stamps`` says where earlier
    batches left them), so the merge never contradicts the offsets.  The numbers follow each other from ``start``:
    one range shuffle of three narrow columns, then each range continues where the ranges before it end.
    """
    narrow = records.select("partition", "offset", (F.unix_micros("timestamp") if stamp is None else stamp).alias("__stamp"))
    timed = running_max(narrow, ["partition"], "offset", "__stamp", "__time", width=width)
    if stamps is not None:
        timed = timed.join(stamps.select(F.col("slot").alias("partition"), F.col("time").alias("__before")), "partition", "left").withColumn(
            "__time", F.greatest("__time", "__before")).drop("__before")
    order = ["__time", "partition", "offset"]
    placed = materialize(
        timed.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("partition", "offset", "__time", F.monotonically_increasing_id().alias("__place")))
    # the upper bits number the range, the lower ones the row in it
    piece, row = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    pieces = placed.groupBy(piece.alias("__piece")).count()  # a row per range
    pieces = pieces.withColumn("__first", F.coalesce(F.sum("count").over(
        Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = placed.withColumn("__piece", piece).join(pieces, "__piece").select(
        "partition", "offset", (F.col("__first") + row + start).alias("arrival_seq"))
    came = placed.groupBy(F.col("partition").cast("long").alias("slot")).agg(F.max("__time").alias("time"))
    return records.join(numbered, ["partition", "offset"]), came
