"""Audit of interacting filters: what each removes first, again, or alone, in every order.

Five failure conditions give each document a mask.  Counts per (part, mask) hold all that the audit needs: a part has 32 masks, whatever its
number of documents.  Per part, a walk in Gray-code order visits all 32 sets of switched-on filters, toggling one at a time:
each mask counts how many of its failing filters are on, and leaves or rejoins the running survivors when that count leaves
or reaches zero.  The 32 stored states give every step of every order as a difference.

Scale: texts are read once and leave only a digest and four bits.  A text's smallest id is a combined minimum per digest; documents meet it by (digest, id),
which is spread even if a third of them share one text.  Parts are counted with map-side combination; the walk handles a batch of parts
at a time, so any number of sources is spread over tasks.

Defined cases: null text is the empty text, with no words (fails A) and equal to other empty texts.  A null source is the part ''.
A document with a null id fails E for no other and not itself, and has no labels; rows with the same id and text are no earlier copies of each other.
Labels of one document met several times count as 1 if any of them is 1; unknown documents and null labels do nothing.
Very long texts are counted whole.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, UPPER, staged, table

FILTERS = "ABCDE"  # bit i of a mask is set where filter i fails
SYMBOLS = "[#$%&*|]"  # fixed by the contract
MASKS = 1 << len(FILTERS)
ORDERS = list(permutations(range(len(FILTERS))))
COUNTS = ("docs", "good", "toxic")
PARTS_AT_ONCE = 64
OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def _bits(text: Column, words: Column) -> Column:
    """Filters A to D, which look at one text."""
    n, size = F.size(words), F.length(text)
    failing = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * (size - F.length(F.translate(text, UPPER, ""))) > 5 * size, text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)), F.lit(0))


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``key``, ``part`` and ``mask`` of every document."""
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    trimmed = F.btrim("_text", F.lit(BLANKS))
    rows = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    narrow = staged(rows.select("_id", "_part", F.unhex(F.sha2("_text", 256)).alias("_digest"), _bits(F.col("_text"), F.col("_words")).alias("_mask")))
    first = narrow.where("_id IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_id"))
    found = narrow.join(first.withColumn("_first", F.lit(True)), ["_digest", "_id"], "left")
    later = F.col("_id").isNotNull() & F.col("_first").isNull()
    return found.select(F.col("_id").alias(key), F.col("_part").alias("part"), (F.col("_mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, good and toxic ones per part and mask."""
    marked = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = masked.withColumnRenamed(key, "_id").join(marked, "_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTS[1:]])


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of counts by (part, mask, kind): what is left under every set of filters, by (part, set, kind)."""
    states = np.zeros_like(counts)
    on = np.zeros(MASKS, dtype=np.int64)  # active failures of each mask
    masks_, now, running = np.arange(MASKS), 0, counts.sum(axis=1)
    states[:, 0] = running
    for step in range(1, MASKS):
        bit = step & -step  # the bit in which neighbouring Gray codes differ
        now ^= bit
        holders = masks_[(masks_ & bit) > 0]
        before = on[holders]
        on[holders] += 1 if now & bit else -1
        running = running - counts[:, holders[(before == 0) & (on[holders] == 1)]].sum(axis=1) + counts[:, holders[(before == 1) & (on[holders] == 0)]].sum(axis=1)
        states[:, now] = running
    return states


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = np.array(ORDERS)  # order x step
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    names = ["".join(FILTERS[f] for f in o) for o in ORDERS]
    size = orders.size
    for batch in batches:
        for at in range(0, len(batch), PARTS_AT_ONCE):
            rows = batch.slice(at, PARTS_AT_ONCE)
            counts = np.zeros((len(rows), MASKS, len(COUNTS)), dtype=np.int64)
            for i, found in enumerate(rows.column(1).to_pylist()):
                for c in found:
                    counts[i, c["mask"]] = [c[k] for k in COUNTS]
            states = survivors(counts)
            lost = states[:, before] - states[:, after]  # part x order x step x kind
            failing = states[:, [0]] - states[:, 1 << np.arange(len(FILTERS))]  # part x filter x kind
            alone = counts[:, 1 << np.arange(len(FILTERS)), 0]
            removed = lost[..., 0]
            shapley = np.stack([np.where(orders == f, removed, 0).sum(axis=(1, 2)) for f in range(len(FILTERS))], axis=1)
            columns = [states[:, after, 0], removed, failing[:, orders, 0] - removed, alone[:, orders], lost[..., 1], lost[..., 2], shapley[:, orders]]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(np.repeat(np.arange(len(rows)), size))), pa.array(np.tile(np.repeat(names, len(FILTERS)), len(rows))),
                 pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(rows) * len(ORDERS))), *[pa.array(c.reshape(-1)) for c in columns]],
                names=[x.split()[0] for x in OUT.split(", ")])


def audit(counted: DataFrame) -> DataFrame:
    """The audit's 600 rows of each part, from ``cells``."""
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), *COUNTS)).alias("found"))  # 32 at most
    return by_part.mapInArrow(_audit, OUT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
masked AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM split),
cell AS (SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masked LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, bit)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, s::INT AS step, f, bit,
    coalesce((SELECT sum(p.bit) FROM letters p WHERE position(p.f IN filter_order) < s), 0) AS before
    FROM orders, range(1, 6) r(s), letters WHERE filter_order[s] = f),
found AS (SELECT part, filter_order, step, f,
    sum(docs) FILTER (WHERE mask & b = 0 AND mask & bit = 0) AS kept,
    sum(docs) FILTER (WHERE mask & b = 0 AND mask & bit > 0) AS removed,
    sum(docs) FILTER (WHERE mask & b > 0 AND mask & bit > 0) AS redundant,
    sum(docs) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & b = 0 AND mask & bit > 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & b = 0 AND mask & bit > 0) AS toxic_lost
    FROM cell, (SELECT *, before::INT AS b FROM steps) GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM found
"""
