"""Removal of repeated passages: windows of 20 words, found by a count-min prefilter and grouped exactly.

First pass: every task counts its windows' hashes in two rows of cells; the sketches are merged cell by cell and only
the cells counted twice or more matter, one bit each.  The sketch overestimates, so no repeated window is lost.  Its
width follows the corpus up to ``MOST_BITS`` (two bitmaps of 64 MB), which bounds what is broadcast; a larger corpus
fills it further and more windows go through the second pass, with the same result.

Second pass: windows whose cells are repeated in both rows are grouped by 96 bits of hash.  A task first groups its own
and sends on only the first place of each window, since all other places there are repeats already; so a window that
fills a third of the corpus is sent once per task and flush.  In a bucket the smallest place stays, all others are repeats.

Third pass: repeats come back to their documents, whose covered words are removed.

Defined cases: null text: no words, hash of the empty string.  Null ids come before all others.  Rows equal in id and text
are one document and get equal results; texts that share an id are ordered by their hash.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lean, table
from ledgerlens.llm.textio import BASES, WordHashes, mixed, rolling

WINDOW = 20
LEAST_BITS, MOST_BITS, CHUNK_BITS = 20, 29, 20
FLUSH = 1 << 22           # windows a task holds before it sends them on
BUCKET_WINDOWS = 1 << 23  # windows of the corpus per bucket of the second pass
SEED = 42


def cells(w1: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (w1 >> np.uint64(64 - bits)).astype(np.uint32), (w1 & np.uint64((1 << bits) - 1)).astype(np.uint32)


def planes(x: np.ndarray) -> bytes:
    """Sorted or small numbers, byte by byte of significance and compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def numbers(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


SKETCH = "row int, chunk int, once binary, more binary"


def _windows():
    """Hashes of a text's windows."""
    hashes = WordHashes()

    def of(text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        return rolling(hashes(words)[0], WINDOW, BASES[0]) if len(words) >= WINDOW else np.empty(0, dtype=np.uint64)

    return of


def _sketch(bits: int, hashed, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = hashed()

        def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            out = ([], [], [], [])
            for row, of in enumerate(zip(*(cells(w, bits) for w in held))):
                cell, n = np.unique(np.concatenate(of), return_counts=True)
                cuts = np.searchsorted(cell, np.arange(1 << bits - CHUNK_BITS, dtype=np.int64) << CHUNK_BITS)
                for chunk, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(cell)])):
                    if b > a:
                        offset, twice = cell[a:b] & ((1 << CHUNK_BITS) - 1), n[a:b] > 1
                        for column, value in zip(out, (row, chunk, planes(offset[~twice]), planes(offset[twice]))):
                            column.append(value)
            for at in range(0, len(out[0]), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 64], type=t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["row", "chunk", "once", "more"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = hashes_of(text)
                if len(found):
                    held.append(found)
                    size += len(found)
                if size >= flush:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch rows sorted by row and chunk, to one bitmap of repeated cells each."""
    at, one, two = None, None, None

    def bitmap() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], type=pa.int32()), pa.array([at[1]], type=pa.int32()),
                                           pa.array([np.packbits(two, bitorder="little").tobytes()], type=pa.binary())], names=["row", "chunk", "bits"])

    for batch in batches:
        for row, chunk, once, more in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != (row, chunk):
                if at:
                    yield bitmap()
                at, one, two = (row, chunk), np.zeros(1 << CHUNK_BITS, dtype=bool), np.zeros(1 << CHUNK_BITS, dtype=bool)
            o, m = numbers(once), numbers(more)
            two[o] |= one[o]
            one[o] = True
            two[m] = one[m] = True
    if at:
        yield bitmap()


def sketch_bits(windows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, ceil(log2(2 * windows))))


def repeated_cells(docs: DataFrame, text: str, bits: int, hashed=_windows, flush: int = FLUSH) -> bytes:
    """Both rows' bitmaps of the cells counted twice or more; ``hashed()`` gives the function from a text to its hashes."""
    chunks = (docs.select(F.col(text).cast("binary")).mapInArrow(lean(_sketch(bits, hashed, flush)), SKETCH)
              .repartition("row", "chunk").sortWithinPartitions("row", "chunk").mapInArrow(lean(_merge), "row int, chunk int, bits binary"))
    each, size = (1 << bits) // 8, (1 << CHUNK_BITS) // 8
    out = bytearray(2 * each)
    for r in chunks.toLocalIterator():  # 2 << bits - CHUNK_BITS rows at most, whatever the corpus
        at = r["row"] * each + r["chunk"] * size
        out[at:at + size] = r["bits"]
    return bytes(out)


PLACES = "bucket long, w1 binary, w2 binary, doc binary, start binary, ids binary, hashes binary"
REPEATS = "doc_id long, hash long, starts binary"
_NULL_ID = np.iinfo(np.int64).min


def first_places(w1, w2, doc, start) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, then place; and which of the ordered rows begin a window."""
    order = np.lexsort((start, doc, w2, w1))
    a, b = w1[order], w2[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first


REPEATED = "to long, ids binary, hashes binary, counts binary, start binary"


def repeats_of(ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, bucket_bits: int) -> pa.Table:
    """Starts of repeated windows, a row per bucket of documents: its documents, their numbers of starts, and the starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    which, counts = np.unique(doc, return_counts=True)
    spread = mixed(ids[which].astype(np.uint64) ^ mixed(hashes[which].astype(np.uint64)))  # copies of one text have different ids
    to = (spread & np.uint64((1 << bucket_bits) - 1)).astype(np.int64)
    rows = ([], [], [], [], [])
    for b in np.unique(to):
        here = to == b
        for column, value in zip(rows, (int(b), ids[which[here]].tobytes(), hashes[which[here]].tobytes(), planes(counts[here]),
                                        planes(start[np.repeat(here, counts)]))):
            column.append(value)
    return pa.table([pa.array(rows[0], type=pa.int64()), *[pa.array(c, type=pa.binary()) for c in rows[1:]]],
                    names=["to", "ids", "hashes", "counts", "start"])


def _by_document(group: pa.Table) -> pa.Table:
    """A bucket's repeats, a row per document."""
    ids, hashes = (np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=np.int64) for c in ("ids", "hashes"))
    counts, start = (np.concatenate([numbers(x) for x in group.column(c).to_pylist()]) for c in ("counts", "start"))
    order = np.lexsort((start, np.repeat(hashes, counts), np.repeat(ids, counts)))
    a, b, start = np.repeat(ids, counts)[order], np.repeat(hashes, counts)[order], start[order]
    begin = np.nonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[0] if len(a) else np.empty(0, dtype=np.int64)
    parts = np.split(start, begin[1:]) if len(a) else []
    return pa.table({"doc_id": pa.array(a[begin], mask=a[begin] == _NULL_ID), "hash": pa.array(b[begin]),
                     "starts": pa.array([x.astype("<u4").tobytes() for x in parts], type=pa.binary())})


OUT = f"kind int, {PLACES}, to long, counts binary"
_OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in ("w1", "w2", "doc", "start", "ids", "hashes")],
                  ("to", pa.int64()), ("counts", pa.binary())])


def _wide(rows: pa.Table, kind: int) -> Iterator[pa.RecordBatch]:
    n, own = rows.num_rows, {"kind": pa.array(np.full(rows.num_rows, kind, dtype=np.int32))}
    if kind:  # any bucket: what is known to repeat only passes through it
        own["bucket"] = rows.column("to")
    columns = [own[f.name] if f.name in own else rows.column(f.name) if f.name in rows.column_names else pa.nulls(n, f.type) for f in _OUT]
    yield from pa.table(columns, schema=_OUT).combine_chunks().to_batches()


def repeated_in(bitmaps: bytes, bits: int):
    """Function from hashes to the places of those whose cells are repeated in both rows."""
    both = np.frombuffer(bitmaps, dtype=np.uint8)
    rows = both[:len(both) // 2], both[len(both) // 2:]

    def repeated(w: np.ndarray) -> np.ndarray:
        keep = np.arange(len(w))
        for of, cell in zip(rows, cells(w, bits)):
            cell = cell[keep]
            keep = keep[(of[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
        return keep

    return repeated


def _places(bitmap, bits: int, bucket_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hashes = repeated_in(bitmap.value, bits), WordHashes()

        def send(held, docs) -> Iterator[pa.RecordBatch]:
            ids, hs = (np.array(x, dtype=np.int64) for x in zip(*docs))
            pairs, number = np.unique(np.stack((ids, hs), axis=1), axis=0, return_inverse=True)  # sorted, so numbers are in order of place
            number = number.ravel()
            w1, w2, start = (np.concatenate([h[i] for h in held]) for i in range(3))
            doc = np.repeat(number, [len(h[0]) for h in held])
            order, first = first_places(w1, w2, doc, start)
            lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            d, s = doc[order], start[order]
            again = ~first & ~((d == d[lead]) & (s == s[lead]))  # the same place met twice is no repeat
            yield from _wide(repeats_of(pairs[:, 0], pairs[:, 1], d[again], s[again], bucket_bits), 1)
            sent = order[first]
            sent = sent[np.lexsort((start[sent], doc[sent]))]
            bucket = (w1[sent] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(sent), dtype=np.int64)
            for b in np.unique(bucket):
                x = sent[bucket == b]
                here, at = np.unique(doc[x], return_inverse=True)
                yield from _wide(pa.table(
                    [pa.array([int(b)]), *[pa.array([v], type=pa.binary()) for v in (
                        w1[x].tobytes(), w2[x].astype("<u4").tobytes(), planes(at), planes(start[x]), pairs[here, 0].tobytes(), pairs[here, 1].tobytes())]],
                    names=["bucket", "w1", "w2", "doc", "start", "ids", "hashes"]), 0)

        held, docs, size = [], [], 0
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or b""
                words = text.split()
                if len(words) < WINDOW:
                    continue
                low, high = hashes(words)
                w1 = rolling(low, WINDOW, BASES[0])
                at = repeated(w1)
                if len(at):
                    held.append((w1[at], (rolling(high, WINDOW, BASES[1])[at] >> np.uint64(32)).astype(np.uint32), at.astype(np.uint32)))
                    h = xxhash.xxh64_intdigest(text, SEED)
                    docs.append((_NULL_ID if ident is None else ident, h - (h >> 63 << 64)))  # as Spark's signed xxhash64
                    size += len(at)
                if size >= FLUSH:
                    yield from send(held, docs)
                    held, docs, size = [], [], 0
        if held:
            yield from send(held, docs)

    return run


def _group(bucket_bits: int):
    """Repeats among the first places of a bucket, beside those that the tasks knew already."""
    names = [c.split()[0] for c in REPEATED.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        own = pc.equal(group.column("kind"), 0)
        known, group = group.filter(pc.invert(own)).select(names), group.filter(own)
        if not len(group):
            return known
        w1 = np.frombuffer(b"".join(group.column("w1").to_pylist()), dtype=np.uint64)
        w2 = np.frombuffer(b"".join(group.column("w2").to_pylist()), dtype="<u4")
        start = np.concatenate([numbers(x) for x in group.column("start").to_pylist()])
        ids, hashes = (group.column(c).to_pylist() for c in ("ids", "hashes"))
        pairs = np.stack((np.frombuffer(b"".join(ids), dtype=np.int64), np.frombuffer(b"".join(hashes), dtype=np.int64)), axis=1)
        pairs, number = np.unique(pairs, axis=0, return_inverse=True)
        base = np.cumsum([0, *[len(x) // 8 for x in ids]])
        doc = number.ravel()[np.concatenate([numbers(x).astype(np.int64) + b for x, b in zip(group.column("doc").to_pylist(), base)])]
        order, first = first_places(w1, w2, doc, start)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        d, s = doc[order], start[order]
        again = ~first & ~((d == d[lead]) & (s == s[lead]))
        return pa.concat_tables([known, repeats_of(pairs[:, 0], pairs[:, 1], d[again], s[again], bucket_bits).cast(known.schema)])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or b"").split()
            left = words
            if starts:
                change = np.zeros(len(words) + 1, dtype=np.int32)
                at = np.unique(np.frombuffer(starts, dtype="<u4")).astype(np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                left = [words[i] for i in np.nonzero(np.cumsum(change[:-1]) == 0)[0]]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(kept, type=pa.binary())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _removed(batches):
        digest = [hashlib.sha256(x).hexdigest() for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """Documents (``doc_id``, ``hash`` of the text) with the starts of their windows that also start earlier; one row each."""
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    windows = max(1, chars // 6)
    bits = bits or sketch_bits(windows)
    bitmap = spark.sparkContext.broadcast(repeated_cells(docs, text, bits))
    bucket_bits = max(3, ceil(log2(max(1, windows / BUCKET_WINDOWS))))
    found = docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(_places(bitmap, bits, bucket_bits), OUT)
    grouped = found.groupBy("bucket").applyInArrow(_group(bucket_bits), REPEATED)
    return grouped.groupBy("to").applyInArrow(_by_document, REPEATS)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (``kept``, or ``kept_sha256``)."""
    again = repeated_windows(docs, key, text, bits)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    met = rows.alias("r").join(again.alias("a"), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.hash") == F.col("a.hash")), "left")
    laid = met.select("r.doc_id", F.col("r.text").cast("binary").alias("text"), "a.starts")
    if digest:
        return laid.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    kept = laid.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept binary")
    return kept.withColumn("kept", F.col("kept").cast("string"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
