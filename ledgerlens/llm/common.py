"""What the operators of this folder share: tables, staged intermediate results, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import configure, ensure_checkpoint_dir

# Fixed by the contracts: words are runs of anything but these six characters.
BLANKS = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"

AT_ONCE = 1 << 20  # edges between whole numbers that a task holds at once, 16 bytes each

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Only A-Z, whatever the locale or the script."""
    return F.translate(text, UPPER, LOWER)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared folder, read back with its columns prunable.

    Later steps read files that every executor reaches, so a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow table, for the rounds of an iteration."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return what allocators hold of freed memory: a Python worker goes on to the next tasks and stages with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def lean(task: Task) -> Task:
    """``task`` for ``mapInArrow``, between whose batches and after whose end no freed memory is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        yield from task(given())
        give_back()

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, with that smallest one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            rest = np.nonzero(label != np.arange(len(nodes)))[0]
            return nodes[rest], nodes[label[rest]]
        label = new


def _forests(most: int):
    """Edges to stars of the same components; sent on whenever the stars of ``most`` edges are over half as many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(2)))
            n += len(batch)
            if n > most:
                u, v = forest(*map(np.concatenate, zip(*held)))
                held, n = [(u, v)], len(u)
                if 2 * n > most:
                    yield rows(u, v)
                    held, n = [], 0
        if n:
            yield rows(*forest(*map(np.concatenate, zip(*held))))

    return run


def _stars(edges: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Fewer edges ``u`` > ``v`` with the same components, and whether these are the components themselves.

    Every task makes stars of its own edges.  If at most ``most`` edges are left, one task makes those of the whole graph.
    """
    now = staged(edges.mapInArrow(_forests(most), "u long, v long"))
    if now.count() > most:
        return now, False
    return staged(now.coalesce(1).mapInArrow(_forests(most), "u long, v long")), True


def components(edges: DataFrame, a: str, b: str, most: int = AT_ONCE) -> DataFrame:
    """Connected components of an undirected graph: ``node``, ``component`` (its smallest node).

    Only nodes with an edge to another node appear.  Edges between whole numbers are first reduced inside tasks, at most ``most``
    at once.  What is more than one task may hold goes on over all tasks: large-star and small-star steps alternate
    until the edges no longer change; each is a combined minimum per node and an equality join,
    so a node with many neighbours is pre-aggregated and its rows can be split by the skew join.
    Null ends are dropped; repeated edges and self loops do no harm.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    done = False
    if {kind for _, kind in known.dtypes} == {"bigint"}:
        known, done = _stars(known, most)
    now = known if done else _alternating(known)
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _alternating(edges: DataFrame) -> DataFrame:
    """Large-star and small-star steps until nothing changes."""
    now = cut(edges.distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.select("u", F.col("m").alias("v"))
                  .unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
