"""Benchmark contamination by winnowing.

A window is 13 consecutive words of a benchmark item (a shorter item is one window).  The fingerprint of a
window is the smallest hash of its 7-word grams, so consecutive windows mostly share one, and a document and
an item that share a window share its fingerprint: every shared span of 13 words or more is met.  The tasks
that read the documents pass a fingerprint on only if a bitmap of the benchmark's fingerprints has its cell;
the bitmap has a fixed size whatever the benchmark's, and a full one only lets more rows through.  What
passes is joined with the benchmark's fingerprints, extended to the windows around it (in the task, which has the
words at hand) and joined with the benchmark's windows on two 64-bit hashes.  Items of fewer than 13 words have
their whole hash as fingerprint, looked up at every position for the lengths that occur.

A passage that a third of the documents share is many rows on one key against one benchmark row: an equality join
whose large side may be split.  Per document, only its own windows meet.

Defined cases: null or wordless texts: no words, not contaminated; null or wordless items: no windows.  A null item id
is listed as ``null``.  Repeated documents are judged row by row; repeated item ids count once.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lean, staged, table
from ledgerlens.llm.textio import BASES, WordHashes, rolling

WINDOW, GRAM = 13, 7
CELL_BITS = 27   # 16 MB of bitmap
CHUNK_BITS = 20

# Fixed by the contract: A-Z are lowered; digits, letters and everything beyond ASCII make words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def window_minima(low: np.ndarray) -> np.ndarray:
    """The fingerprint of each 13-word window."""
    grams = rolling(low, GRAM, BASES[0])
    best = grams
    width, need = 1, WINDOW - GRAM + 1
    while width * 2 <= need:
        best, width = np.minimum(best[:-width], best[width:]), width * 2
    return np.minimum(best[:len(best) - (need - width)], best[need - width:])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


FOUND = "id long, n_words long, size int, fingerprint long, start int, w1 long, w2 long, key {}"
WINDOWS = "id long, n_words long, size int, fingerprint long, start int, w1 long, w2 long"
_ARROW = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("size", pa.int32()), ("fingerprint", pa.int64()),
                    ("start", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])


class _Rows:
    """Rows of WINDOWS gathered as arrays."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []

    def add(self, uid: int, n: int, size: int, fp=None, start=None, w1=None, w2=None) -> None:
        k = 1 if fp is None else len(fp)
        zero = np.zeros(k, dtype=np.int64)
        self.parts.append([np.full(k, uid, dtype=np.int64), np.full(k, n, dtype=np.int64), np.full(k, size, dtype=np.int32),
                           zero if fp is None else _signed(fp), (zero if start is None else start).astype(np.int32),
                           zero if w1 is None else _signed(w1), zero if w2 is None else _signed(w2)])

    def batch(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.parts)] if self.parts else [np.empty(0, dtype=f.type.to_pandas_dtype()) for f in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ARROW)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = _Rows()
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words(text)
            if not w:
                continue
            low, high = hashes(w)
            size = min(len(w), WINDOW)
            w1, w2 = rolling(low, size, BASES[0]), rolling(high, size, BASES[1])
            rows.add(uid, len(w), size, window_minima(low) if size == WINDOW else w1, np.arange(len(w1)), w1, w2)
        yield rows.batch()


def _document_windows(bitmap, short_sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.frombuffer(bitmap.value, dtype=np.uint8), WordHashes()

        def known(fp: np.ndarray) -> np.ndarray:
            cell = fp >> np.uint64(64 - CELL_BITS)
            return np.nonzero((bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1)[0]

        for batch in batches:
            rows = _Rows()
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                rows.add(uid, len(w), 0)
                if not w:
                    continue
                low, high = hashes(w)
                if len(w) >= WINDOW:
                    fp = window_minima(low)
                    at = known(fp)
                    if len(at):
                        rows.add(uid, len(w), WINDOW, fp[at], at, rolling(low, WINDOW, BASES[0])[at], rolling(high, WINDOW, BASES[1])[at])
                for size in short_sizes:
                    if len(w) >= size:
                        w1 = rolling(low, size, BASES[0])
                        at = known(w1)
                        if len(at):
                            rows.add(uid, len(w), size, w1[at], at, w1[at], rolling(high, size, BASES[1])[at])
            if len(batch):
                out = rows.batch()
                row = pa.array(np.searchsorted(batch.column(0).to_numpy(), out.column(0).to_numpy()))  # ids increase
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2).take(row)], names=[*out.schema.names, "key"])

    return run


def _chunk_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cells in batch.column(1).to_pylist():
            bits = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
            bits[np.asarray(cells, dtype=np.int64)] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.binary())], names=["chunk", "bits"])


def fingerprint_bitmap(fingerprints: DataFrame) -> bytes:
    """2**CELL_BITS bits: the cells of the given fingerprints.  A group of one chunk has at most 2**CHUNK_BITS cells."""
    cell = F.shiftrightunsigned("fingerprint", 64 - CELL_BITS)
    chunks = (fingerprints.select(F.shiftright(cell, CHUNK_BITS).cast("int").alias("chunk"),
                                  cell.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int").alias("cell"))
              .groupBy("chunk").agg(F.collect_set("cell").alias("cells")).mapInArrow(lean(_chunk_bytes), "chunk int, bits binary"))
    size = (1 << CHUNK_BITS) // 8
    out = bytearray((1 << CELL_BITS) // 8)
    for row in chunks.toLocalIterator():
        out[row["chunk"] * size:(row["chunk"] + 1) * size] = row["bits"]
    return bytes(out)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row per document: ``key``, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    spark = docs.sparkSession
    bench = staged(items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("binary").alias("t"))
                   .withColumn("id", F.monotonically_increasing_id()))
    wins = staged(bench.select("id", "t").mapInArrow(lean(_item_windows), WINDOWS))
    bitmap = fingerprint_bitmap(wins.select("fingerprint"))
    short = sorted(r[0] for r in wins.where(f"size < {WINDOW}").select("size").distinct().collect())  # at most 12 values
    # one reading of the texts writes the keys, the word counts and the windows that passed
    source = docs.select(F.monotonically_increasing_id().alias("id"), F.col(text).cast("binary"), F.col(key).alias("key"))
    found = staged(source.mapInArrow(
        lean(_document_windows(spark.sparkContext.broadcast(bitmap), short)), FOUND.format(docs.schema[key].dataType.simpleString())))
    hits = found.where("size > 0").join(wins.select("size", "fingerprint").distinct(), ["size", "fingerprint"], "left_semi")
    hits = hits.select("id", "size", "start", "w1", "w2").join(wins.select("size", "w1", "w2").distinct(), ["size", "w1", "w2"], "left_semi")
    covered = hits.selectExpr("id", "start", "start + size as stop").selectExpr(
        "id", "start", "stop", "max(stop) over (partition by id order by start, stop rows between unbounded preceding and 1 preceding) as before")
    n_hit = covered.groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.expr("stop - greatest(start, coalesce(before, 0))"))).cast("long").alias("n_hit"))
    listed = (hits.select("id", "size", "w1", "w2").distinct()
              .join(wins.select(F.col("id").alias("item_row"), "size", "w1", "w2").distinct(), ["size", "w1", "w2"])
              .select("id", "item_row").distinct().join(bench.select(F.col("id").alias("item_row"), "item"), "item_row")
              .groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    out = found.where("size = 0").select("id", "key", "n_words").join(n_hit, "id", "left").join(listed, "id", "left").withColumn(
        "n_hit", F.coalesce("n_hit", F.lit(0))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.select(F.col("key").alias(key), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those contaminated by ``items``: what is contaminated depends on the text alone, so texts are matched."""
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"))
    bad = contamination(marked, items, "digest").where("contaminated").select("digest").distinct()
    return marked.join(bad, "digest", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = (r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM (
  SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
known AS (SELECT DISTINCT size, win FROM iw),
m AS (SELECT uid, size, s, win FROM (
  SELECT uid, size, s, array_to_string(w[s:s + size - 1], ' ') AS win FROM (
    SELECT uid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM known) WHERE len(w) >= size)) JOIN known USING (size, win)),
hit AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(s, s + size)) AS p FROM m) GROUP BY uid),
it AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT uid, item_id::VARCHAR AS item FROM m JOIN iw USING (size, win)) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN it USING (uid)
"""
