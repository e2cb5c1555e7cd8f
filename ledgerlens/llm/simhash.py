"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints differ in at most 4 bits exactly if some value lies within 2 bits of both.  So every distinct
fingerprint stands for its 2,081 variants (itself, every one and every two bits flipped), variants are
brought together by a hash, and fingerprints that share a variant are linked.  The hash is linear over bits, so which
variants of a fingerprint fall into a bucket follows from the fingerprint; a bucket is sent the fingerprint once, eight
bytes, and forms those variants itself.  Fingerprints with one variant in common are all within 4 bits of each other,
so a star around the smallest keeps every link's component, and no group is expanded into pairs; a
bucket then sends on a spanning forest of its stars.  Equal fingerprints are one before any of this.

Buckets grow with the number of distinct fingerprints so that a task holds at most ``HOLD`` of them and forms at
most ``FORM`` variants, in slices of ``SLICE``.  Beyond a few hundred million fingerprints every variant
has its own bucket and a fingerprint is sent about 2,081 times, which is what the method costs.

``drop_near_duplicates`` (for the pipeline) means texts whose sets of five-word shingles have a similarity of 0.8 or
more.  Fingerprints of the words in ``TABLES`` independent tables bring most copies together, but miss edited blocks;
what they leave apart is completed by an exact join over the rarest shingles of each set.  Every link is checked by the exact
similarity (of shingle hashes).

Defined cases: null text: no words, fingerprint zero, linked like any other.  Null ids: ignored by the minimum; a
component of null ids only has a null id.  Repeated rows: alike, as in the input.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, forest, lean, staged, table
from ledgerlens.llm.substrings import repeated_cells, repeated_in, sketch_bits
from ledgerlens.llm.textio import CACHE_WORDS

BITS, RADIUS = 64, 4
SHINGLE, SEED = 4, 42
HOLD, FORM, SLICE = 1 << 25, 1 << 27, 1 << 22
TABLES, NEAR_SHINGLE, NEAR = 5, 5, 0.8
CENTRES, SLACK = 8, 1e-6
BATCH_TEXTS, SLICE_TEXTS = 1000, 256  # texts a worker is given, and works on, at once
HELD_SHINGLES = 1 << 20
MARK_BITS = 256  # a power of two


# Bucket label of each bit: six bits that spread single and double flips evenly, then random ones.
LABELS = np.arange(BITS) | np.random.default_rng(7).integers(0, 1 << 24, BITS) << 6


@lru_cache(maxsize=8)
def ball(bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of up to half the radius in bits by bucket, their buckets, and what each byte value adds to a bucket."""
    label = LABELS & ((1 << bucket_bits) - 1)
    masks = np.array([sum(1 << p for p in c) for k in range(RADIUS // 2 + 1) for c in combinations(range(BITS), k)], dtype=np.uint64)
    shares = np.zeros((8, 256), dtype=np.int64)
    for byte in range(8):
        for bit in range(8):
            shares[byte] ^= np.where(np.arange(256) >> bit & 1, label[byte * 8 + bit], 0)
    of = bucket_of(masks, shares)
    order = np.argsort(of, kind="stable")
    return masks[order], of[order], shares


def bucket_of(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(values), dtype=np.int64)
    for byte in range(8):
        out ^= shares[byte][octets[:, byte]]
    return out


def bits_for(fingerprints: int, least: int) -> int:
    """Bucket bits that keep a task within ``HOLD`` fingerprints and ``FORM`` variants."""
    n = len(ball(0)[0])
    bits = max(least, ceil(log2(max(1, fingerprints * n / FORM))))
    while fingerprints * min(1.0, n / 2 ** bits) > HOLD:
        bits += 1
    return bits


BLOBS = "table int, bucket long, fps binary, nodes binary"
EDGES = "a long, b long"


def _deal(bits: int):
    """Rows of table, fingerprint and node to one row per batch, table and bucket; no node means the fingerprint itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of, shares = ball(bits)
        steps = np.unique(of)  # from a fingerprint's own bucket to those of its variants
        for batch in batches:
            kind, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            node = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
            for t in np.unique(kind):
                rows = np.nonzero(kind == t)[0]
                if len(steps) == 1 << bits:  # every bucket needs every fingerprint
                    sent = [(b, rows) for b in range(1 << bits)]
                else:
                    to = (bucket_of(fp[rows].view(np.uint64), shares)[:, None] ^ steps[None, :]).ravel()
                    order = np.argsort(to, kind="stable")
                    sent = [(int(to[x[0]]), rows[x // len(steps)]) for x in np.split(order, np.nonzero(np.diff(to[order]))[0] + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sent), t, dtype=np.int32)), pa.array(np.array([b for b, _ in sent], dtype=np.int64)),
                     pa.array([fp[x].tobytes() for _, x in sent], type=pa.binary()),
                     pa.array([b"" if node is None else node[x].tobytes() for _, x in sent], type=pa.binary())],
                    names=["table", "bucket", "fps", "nodes"])

    return run


def shared_variants(fps: np.ndarray, bucket: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the variants of ``fps`` in a bucket, slice by slice: rows that share one, and where each such group begins."""
    finer = max(0, ceil(log2(max(1, len(fps) * len(ball(0)[0]) / 2 ** bits / SLICE))))
    masks, of, shares = ball(bits + finer)
    own = bucket_of(fps, shares)
    for part in range(1 << finer):
        at = own ^ (bucket | part << bits)
        first = np.searchsorted(of, at)
        n = np.searchsorted(of, at, side="right") - first
        owner = np.repeat(np.arange(len(fps)), n)
        variant = fps[owner] ^ masks[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(owner))]
        order = np.argsort(variant)
        variant, owner = variant[order], owner[order]
        same = variant[1:] == variant[:-1]
        rows = np.nonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))[0]
        if len(rows):
            yield owner[rows], np.nonzero(np.concatenate(([True], variant[rows][1:] != variant[rows][:-1])))[0]


def told_in(a: np.ndarray, b: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Of the buckets in which a pair within ``RADIUS`` bits meets, one: that of ``a`` with the two lowest differing bits flipped."""
    def lowest(x: np.ndarray) -> np.ndarray:
        return x & (~x + np.uint64(1))

    differ = a ^ b
    one = lowest(differ)
    return bucket_of(a ^ one ^ lowest(differ ^ one), shares)


def _link(bits: int, spanning: bool):
    """Edges of a bucket: a spanning forest of its stars, or for each node the smallest one that the bucket tells of.

    The smallest node within ``RADIUS`` bits is the centre of every star that it shares with a node, so it is told of in one bucket.
    """
    def run(group: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(group.column("fps").to_pylist()), dtype=np.uint64)
        nodes = np.frombuffer(b"".join(group.column("nodes").to_pylist()), dtype=np.int64)
        nodes = nodes if len(nodes) else fps.view(np.int64)
        order = np.argsort(nodes, kind="stable")  # rows in order of their nodes, so the first of a group is its smallest
        fps, nodes = fps[order], nodes[order]
        bucket, shares = group.column("bucket")[0].as_py(), ball(bits)[2]
        ends, smallest = [np.empty((0, 2), dtype=np.int64)], np.arange(len(nodes))
        for rows, begin in shared_variants(fps, bucket, bits):
            centre = np.repeat(np.minimum.reduceat(rows, begin), np.diff(np.concatenate((begin, [len(rows)]))))
            if not spanning:
                told = (centre < smallest[rows]) & (told_in(fps[centre], fps[rows], shares) == bucket)
                np.minimum.at(smallest, rows[told], centre[told])
                continue
            pairs = np.stack((centre, rows), axis=1)
            found = np.unique(pairs, axis=0) if len(rows) < 1 << 16 else _unique(pairs)
            found = found[(found[:, 0] != found[:, 1]) & (np.bitwise_count(fps[found[:, 0]] ^ fps[found[:, 1]]) <= RADIUS)]
            ends.append(nodes[found])
        if not spanning:
            rows = np.nonzero(smallest < np.arange(len(nodes)))[0]
            return pa.table({"a": pa.array(nodes[smallest[rows]]), "b": pa.array(nodes[rows])})
        both = np.concatenate(ends)
        a, b = forest(both[:, 0], both[:, 1]) if len(both) else (both[:, 0], both[:, 1])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _unique(pairs: np.ndarray) -> np.ndarray:
    packed = np.unique(pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1].astype(np.int64))  # rows within a task
    return np.stack((packed >> 32, packed & 0xFFFFFFFF), axis=1)


def close_pairs(fingerprints: DataFrame, per_table: int, least_bits: int, spanning: bool) -> DataFrame:
    """Edges ``a``, ``b`` between fingerprints (or their nodes) within ``RADIUS`` bits in a table.

    ``fingerprints``: table, fp and, unless the fingerprint is the node, node; distinct.  With ``spanning`` as many
    edges as their components need, else for each node ``b`` at least that to the smallest node ``a`` it has one to.
    """
    bits = bits_for(per_table, least_bits)
    dealt = fingerprints.mapInArrow(_deal(bits), BLOBS)
    return dealt.groupBy("table", "bucket").applyInArrow(_link(bits, spanning), EDGES).distinct()


def majority(hashes: np.ndarray, of: int) -> np.ndarray:
    """Fingerprints of the columns of big-endian hashes (n, tables): a bit is set if over half of ``of`` hashes set it."""
    total = np.zeros(hashes.shape[1] * BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > of).view(">u8").astype(np.uint64)


def shingle_fingerprint(text: bytes | None) -> int:
    """Of the shingles of ``SHINGLE`` words, repeats included; zero without a word."""
    w = (text or b"").lower().split()  # of bytes: A-Z only, and the contract's six blanks
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), dtype=np.uint64)
    return int(majority(h[:, None], len(h))[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([shingle_fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` (long) and ``component``: the smallest key reachable over links of at most ``RADIUS`` bits."""
    kind = docs.schema[key].dataType.simpleString()
    prints = staged(docs.select(F.col(key).alias("id"), F.col(text).cast("binary")).mapInArrow(_fingerprints, f"id {kind}, fp long"))
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("low")))
    edges = close_pairs(distinct.select(F.lit(0).alias("table"), "fp"), distinct.count(), 6, True)
    near = components(edges, "a", "b").select(F.col("node").alias("fp"), F.col("component"))
    lows = near.join(distinct, "fp").groupBy("component").agg(F.min("low").alias("component_low"))
    of_fp = distinct.join(near.join(lows, "component").select("fp", "component_low"), "fp", "left").select(
        "fp", F.coalesce("component_low", "low").alias("component"))
    return prints.join(of_fp, "fp").select(F.col("id").alias(key), "fp", "component")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# Near-duplicates by similarity of shingle sets, for the pipeline.

PRINTS = "digest string, id {}, fps array<bigint>"


def _word_fingerprints(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        hashes = np.empty((1 << 12, tables), dtype=np.uint64)
        for batch in batches:
            out = np.zeros((len(batch), tables), dtype=np.uint64)
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = set((text or b"").lower().split())
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in words.difference(known):
                    if len(known) == len(hashes):
                        hashes = np.resize(hashes, (2 * len(hashes), tables))
                    hashes[len(known)] = [xxhash.xxh3_64_intdigest(w, t) for t in range(tables)]
                    known[w] = len(known)
                if words:
                    out[i] = majority(hashes[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))], len(words))
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["digest", "id", "fps"])

    return run


def shingle_set(text: bytes | None, size: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of lower-cased words; fewer words are one shingle, none is no shingle."""
    w = (text or b"").lower().split()
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [b" ".join(w)] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), dtype=np.uint64))


def parities(shingles: np.ndarray) -> np.ndarray:
    """``MARK_BITS`` bits, each whether an odd number of the shingles fall on it; two sets differ in as many shingles at least as bits."""
    odd = np.bincount(shingles >> np.uint64(64 - MARK_BITS.bit_length() + 1), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(bitmap, bits: int, least: float):
    """Of digest and text, the texts that may have a similar one: number of shingles, and those that other rows may have too, with their parities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = repeated_in(bitmap.value, bits)
        for batch in batches:
            seen = set()
            for at in range(0, len(batch), SLICE_TEXTS):
                out, rows = ([], [], [], []), batch.slice(at, SLICE_TEXTS)
                for digest, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                    if digest in seen:
                        continue
                    seen.add(digest)
                    x = shingle_set(text.as_py())
                    shared = x[repeated(x)]
                    if len(shared) >= least * len(x) - SLACK:
                        for column, value in zip(out, (digest, len(x), shared.tobytes(), parities(shared))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())))],
                                                 names=["digest", "n", "shingles", "mark"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE_TEXTS // 4):
            rows = batch.slice(at, SLICE_TEXTS // 4)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in rows.column(1)]
            nodes = np.repeat(rows.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(nodes)], names=["token", "node"])


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, all_of = [], batch.column(4).to_numpy()
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (int(all_of[i]) - both):
                    keep.append(i)
            keep = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs, those whose shingle sets are at least ``least`` similar."""
    sizes = sets.select("node", "n")
    near = (pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
            .where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - SLACK))
    laid = (near.select("a", "b", (F.col("na") + F.col("nb")).alias("n")).join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    return staged(laid.select("a", "b", "sa", "sb", "n").mapInArrow(lean(_similar(least)), EDGES))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``token``, ``node``, ``n``, ``ahead``: the rarest shingles of each set, so many that two sets of similarity ``least`` share one.

    Of n shingles all but the last ceil(least * n) - 1 in one order for all sets, rarest first.  Shingles of one set only
    meet nothing and are not sent; a set with fewer than least * n others has no similar one.  ``ahead`` is the number of these others
    from this one on: two sets that share no earlier one have no more in common than the lesser of theirs.
    """
    each = staged(sets.select("node", "shingles").mapInArrow(lean(_tokens), "token long, node long"))
    df = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = each.join(df, "token").groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("x"))
    own = own.join(sets.select("node", "n"), "node").withColumn("r", F.size("x")).where(F.col("r") >= F.lit(least) * F.col("n") - SLACK)
    sent = (F.col("r") - F.ceil(F.lit(least) * F.col("n") - SLACK) + 1).cast("int")
    return own.select("node", "n", "r", F.posexplode(F.slice(F.sort_array("x"), F.lit(1), F.greatest(sent, F.lit(0)))).alias("i", "x")).select(
        F.col("x.token").alias("token"), "node", "n", (F.col("r") - F.col("i")).alias("ahead"))


def may_be_similar(least: float) -> Column:
    """Whether a row's set and that of ``c``, which meet at a shingle, can have a similarity of ``least`` if it is the first they share.

    A pair is passed over where its first shared shingle came before, and where the parities tell that too many shingles differ.
    """
    common = F.lit(least / (1 + least)) * (F.col("n") + F.col("c.n")) - SLACK
    bits = sum((F.bit_count(F.col("mark")[i].bitwiseXOR(F.col("c.mark")[i])) for i in range(MARK_BITS // 64)), F.lit(0))
    return (F.least("ahead", "c.ahead") >= common) & (F.col("m") + F.col("c.m") - bits >= 2 * common)


def all_links(sets: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """``links`` and so many more of similarity ``least`` that their components are those of all such pairs.

    Sets meet by the shingles of their prefixes.  In a round some sets of each shingle (in ``CENTRES`` classes, twice as many each
    round, that with the most links so far first) are compared with all sets there that are not yet in their component, and are done
    there; shingles whose sets are all in one component are done.  No pair between two components is left out but those that
    ``may_be_similar`` excludes.
    """
    none = sets.where("n = 0").agg(F.min("node")).first()[0]
    if none is not None:
        links = links.unionByName(sets.where(F.col("n") == 0).where(F.col("node") > none).select(F.lit(none).alias("a"), F.col("node").alias("b")))
    posts, classes = prefixes(sets, least), CENTRES
    marks = sets.select("node", F.expr("octet_length(shingles) div 8").cast("int").alias("m"), "mark")
    while True:
        group = components(links, "a", "b")
        degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
        known = group.join(degree, "node", "left")
        posts = staged(posts.join(known, "node", "left").select("token", "node", "n", "ahead", F.coalesce("component", "node").alias("of"),
                                                                  F.coalesce("links", F.lit(0)).alias("links")))
        open_ = posts.groupBy("token").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x != y").select("token")
        posts = staged(posts.join(open_, "token").join(marks, "node"))
        if posts.isEmpty():
            return links
        centre = staged(posts.groupBy("token", F.pmod(F.xxhash64("node", F.lit(classes)), F.lit(classes)).alias("class"))
                        .agg(F.min(F.struct((-F.col("links")).alias("links"), "node", "n", "ahead", "of", "m", "mark")).alias("c")).select("token", "c"))
        pairs = (posts.join(centre, "token").where((F.col("of") != F.col("c.of")) & may_be_similar(least))
                 .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())
        links = links.unionByName(_verified(pairs, sets, least))
        done = centre.select("token", F.col("c.node").alias("node"))
        posts = posts.join(done, ["token", "node"], "left_anti").select("token", "node", "n", "ahead")
        classes *= 2


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", tables: int = TABLES, least: float = NEAR) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the smallest key; null and empty texts are one group.

    Texts most of whose shingles no other row has are no near-duplicates, and a sketch tells them.  The others are linked with
    their first SimHash candidate, which joins most copies for a check each, then completed by ``all_links``.
    """
    with small_batches(docs.sparkSession):
        return _without_near_duplicates(docs, key, text, tables, least)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer texts at once in a Python worker, whose memory comes on top of the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _without_near_duplicates(docs: DataFrame, key: str, text: str, tables: int, least: float) -> DataFrame:
    kind, spark = docs.schema[key].dataType.simpleString(), docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
                       F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    prints = staged(rows.select("digest", "id", "text").mapInArrow(lean(_word_fingerprints(tables)), PRINTS.format(kind)))
    distinct = staged(prints.groupBy("digest").agg(F.min("id").alias("low"), F.first("fps").alias("fps"))
                      .withColumn("node", F.monotonically_increasing_id()))
    bits = sketch_bits(max(1, docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0] // 6))
    bitmap = spark.sparkContext.broadcast(repeated_cells(docs, text, bits, lambda: shingle_set, HELD_SHINGLES))
    sets = staged(rows.select("digest", "text").mapInArrow(lean(_sets(bitmap, bits, least)), "digest string, n int, shingles binary, mark array<bigint>")
                  .dropDuplicates(["digest"]).join(distinct.select("digest", "node"), "digest").select("node", "n", "shingles", "mark"))
    bitmap.destroy()  # nothing reads the texts for it again
    each = distinct.join(sets.select("node"), "node").select(F.posexplode("fps").alias("table", "fp"), "node")
    edges = close_pairs(each, sets.count(), 4, False)
    first = _verified(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, least)
    links = all_links(sets, first, least)
    group = components(links, "a", "b")
    kept = group.join(distinct, "node").groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("null"), "low", "node")).alias("m"))
    gone = group.join(kept.select(F.col("m.node").alias("node")), "node", "left_anti").select("node")
    keepers = distinct.join(gone, "node", "left_anti").select("digest", "low")
    left = rows.select("row", "digest", "id").join(keepers, "digest").where(F.col("id").eqNullSafe(F.col("low")))
    return left.select("digest", "row").dropDuplicates(["digest"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
