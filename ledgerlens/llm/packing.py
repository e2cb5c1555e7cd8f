"""Token packing: documents to sequences of a fixed length, best fit in bulk-synchronous rounds.

Documents are tokenised in the tasks and cut only where they exceed a sequence.  Full pieces are sequences of
their own, pieces over half a sequence open one each, and all others are placed in rounds over gaps:

1. Documents and gaps are sorted together by size, largest first, over range partitions of ``RANGE_ROWS`` rows.
2. Every partition sweeps its rows once: a document goes to its successor, the smallest gap that holds it, whether
   untouched or already used in this sweep.
3. Partitions report how many documents and untouched gaps they have left (a few numbers each); a sweep over these,
   from large to small, gives the left documents the nearest larger partition's gaps, by rank: where many want
   the same gaps, the r-th document goes to the r-th gap, or a few consecutive ones to each if even the
   largest of them fits that often.  Documents and gaps then meet by an equality join on the slot.
4. Gaps shrink, and the next round sorts again.

New sequences are opened when the documents left exceed all gaps together (then they are needed in any packing), or when
a round places nothing.  Ties are ordered by identifier, so a length that a third of all pieces share is cut by
the range partitions like any other stretch, and a lost task repeats the same sweep.

Defined cases: null text counts as empty: one piece of the end token.  Repeated rows are packed one by one, null keys too.  Very
long documents become many pieces.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lean, staged, table

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END_TOKEN = 2048, 0
RANGE_ROWS = 250_000  # documents and gaps swept by one task
CACHE_WORDS = 500_000  # words a task remembers
TEXT_AT_ONCE = 1 << 22  # bytes of texts whose words a task sorts out at once; a longer text is alone


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Memory(dict):
    """Remembers what ``make`` gives for a key, up to a number of keys."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


class WordTokens:
    """Token ids of texts, by remembering those of their words.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in order; only the
    four blanks that every rule of it agrees on separate words here, anything else stays inside a word.  Words of Latin
    letters, perhaps with a few closing marks, go straight to the tokenizer's model: its other steps only lower them,
    split off the marks and write bytes as characters.  Texts are taken together: each distinct word is looked up once.
    """

    _BLANK = np.isin(np.arange(256), list(b" \t\n\r"))
    # Letters and marks of a plain word, or any other word.  Latin letters that are composed already and lower one by one (U+0130 does not).
    _WORDS = re.compile("([A-Za-zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]++)([!-&(-/:-@\\[-`{-~]*+)(?![^ \t\n\r])|([^ \t\n\r]++)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.letters, self.others = Memory(self._letters), Memory(self._whole)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, letters: str) -> bytes:
        written = letters if letters.isascii() else "".join(map(self.characters.__getitem__, letters.encode()))
        ids = [t.id for t in self.model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of words, each with the blanks behind it."""
        for memory in (self.letters, self.others):
            memory.trim()
        apart = pc.binary_join_element_wise(words, *(pa.scalar(x, words.type) for x in ("", " ")))
        found = self._WORDS.findall(str(apart.buffers()[2], "utf-8"))
        letters, others = self.letters, self.others
        return pa.array([(letters[a.lower()] + others[marks] if marks else letters[a.lower()]) if a else others[other]
                         for a, marks, other in found], type=pa.large_binary())

    def _together(self, texts: pa.Array) -> list[memoryview]:
        texts = texts.fill_null("")
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or b""
        blank = self._BLANK[np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]]]
        after = np.append(True, blank)[:-1]  # a blank, or where a text begins
        after[ends[:-1][ends[:-1] < ends[-1]] - ends[0]] = True
        starts = np.nonzero(after & ~blank)[0] + ends[0]
        if not len(starts):
            return [memoryview(b"")] * len(texts)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, ends[-1])), data]).dictionary_encode()
        ids = self._distinct(words.dictionary).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], dtype=np.int64)[np.searchsorted(starts, ends)].tolist()
        flat = memoryview(ids.buffers()[2])
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def each(self, texts: pa.Array) -> Iterator[memoryview]:
        """Ids of every text (null: none) as unsigned little-endian 32-bit numbers."""
        texts, at = texts.cast(pa.large_string()), 0
        ends = np.append(0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)))
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT_AT_ONCE, side="right")) - 1)
            yield from self._together(texts.slice(at, stop - at))
            at = stop

    def __call__(self, text: str) -> bytes:
        return bytes(next(self.each(pa.array([text]))))


PIECES = "piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = WordTokens(path), np.array([END_TOKEN], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokens.each(batch.column(1))):
                data = bytes(ids) + end
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()),
                 *[pa.array(x, type=pa.int64()) for x in (start, length, crc)]], names=["key", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``key``, piece, start, length and ids_crc32 of every piece; a document's ids end with the end token."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(
        lean(_pieces(path or public_tokenizers.path(VOCABULARY), capacity)), f"key {kind}, {PIECES}").withColumnRenamed("key", key)


SWEPT = "what int, part int, rank long, id long, size long, sequence long, place long"
PLACED, DOC, GAP, USED = range(4)  # what a row of a sweep is: a placement, a document left, an untouched gap, a used gap


def _sweep(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        untouched: list[tuple[int, int]] = []          # sizes fall, so the smallest is at the end
        used: dict[int, list[int]] = {}                # sequences by gap
        sizes = 0                                      # bit g: some used gap of size g
        placed, left = [], []
        for batch in batches:
            for size, kind, ident in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == 0:
                    untouched.append((size, ident))
                    continue
                fits = sizes >> size
                gap = size + (fits & -fits).bit_length() - 1 if fits else None
                if gap is not None and (not untouched or gap <= untouched[-1][0]):
                    sequence = used[gap].pop()
                    if not used[gap]:
                        sizes ^= 1 << gap
                elif untouched:
                    gap, sequence = untouched.pop()
                else:
                    left.append((ident, size))
                    continue
                placed.append((ident, size, sequence, capacity - gap))
                if gap > size:
                    used.setdefault(gap - size, []).append(sequence)
                    sizes |= 1 << gap - size
        rows = [(PLACED, part, 0, *p) for p in placed]
        rows += [(DOC, part, r, i, s, 0, 0) for r, (i, s) in enumerate(left)]
        rows += [(GAP, part, r, i, s, 0, 0) for r, (s, i) in enumerate(reversed(untouched))]
        rows += [(USED, part, 0, i, g, 0, 0) for g, of in used.items() for i in of]
        columns = [np.array(c, dtype=np.int64) for c in zip(*rows)] or [np.empty(0, dtype=np.int64)] * 7
        names = ["what", "part", "rank", "id", "size", "sequence", "place"]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i < 2 else c) for i, c in enumerate(columns)], names=names)

    return run


def successors(left: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Which ranks of left documents go to which ranks of untouched gaps, from the numbers of each partition.

    ``left``: (part, documents, largest document, gaps, smallest gap), parts from large to small sizes.
    Gives (document part, first rank, end rank, gap part, first gap rank, documents per gap, first slot).
    """
    stack: list[list[int]] = []  # gap part, next rank, gaps left, smallest gap
    plan, slot = [], 0
    for part, docs, largest, gaps, smallest in sorted(left):
        done = 0
        while done < docs and stack:
            top = stack[-1]
            each = max(1, top[3] // largest)
            take = min(docs - done, top[2] * each)
            plan.append((part, done, done + take, top[0], top[1], each, slot))
            n = -(-take // each)
            slot, done, top[1], top[2] = slot + n, done + take, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps, smallest])
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``id``, ``sequence_id`` and ``place`` for items of distinct ``id`` (not negative) and ``length`` (1 to ``capacity``)."""
    spark = items.sparkSession
    own = items.where(F.col("length") * 2 > capacity).select("id", F.col("id").alias("sequence"), F.lit(0).cast("long").alias("place"), "length")
    done = [own.drop("length")]
    state = (items.where(F.col("length") * 2 <= capacity).select(F.col("length").alias("size"), F.lit(1).alias("kind"), "id")
             .unionByName(own.where(F.col("length") < capacity).select((F.lit(capacity) - F.col("length")).alias("size"), F.lit(0).alias("kind"), "id")))
    opened, progress = 0, True
    while True:
        held = {r[0]: (r[1], r[2]) for r in state.groupBy("kind").agg(F.count("*"), F.sum("size")).collect()}
        (docs_left, tokens_left), (gaps_left, room) = held.get(1, (0, 0)), held.get(0, (0, 0))
        if not docs_left:
            break
        short = tokens_left - room if progress else tokens_left
        fresh = max(0, ceil(short / capacity))
        if fresh:
            state = state.unionByName(spark.range(opened, opened + fresh).select(
                F.lit(capacity).cast("long").alias("size"), F.lit(0).alias("kind"), (-1 - F.col("id")).alias("id")))
            opened += fresh
        ranges = ceil((docs_left + gaps_left + fresh) / range_rows)
        laid = state.repartition(1) if ranges == 1 else state.repartitionByRange(ranges, F.desc("size"), "kind", "id")
        swept = staged(laid.sortWithinPartitions(F.desc("size"), "kind", "id").mapInArrow(lean(_sweep(capacity)), SWEPT))
        count = {w: F.count(F.when(F.col("what") == w, 1)) for w in (PLACED, DOC, GAP)}
        parts = swept.groupBy("part").agg(count[PLACED], count[DOC], F.max(F.when(F.col("what") == DOC, F.col("size"))), count[GAP],
                                          F.min(F.when(F.col("what") == GAP, F.col("size")))).collect()  # a row per range
        plan = successors([(r[0], r[2], r[3] or 0, r[4], r[5] or 0) for r in parts])
        done.append(swept.where(F.col("what") == PLACED).select("id", "sequence", "place"))
        progress = ranges > 1 and (bool(plan) or any(r[1] for r in parts))  # one sweep over everything leaves only what fits nowhere
        docs, gaps = swept.where(F.col("what") == DOC), swept.where(F.col("what") == GAP)
        used = swept.where(F.col("what") == USED).select("id", "size")
        if plan:
            steps = spark.createDataFrame(plan, "part int, first long, stop long, gap_part int, gap_first long, each long, slot long")
            by_doc = docs.join(steps.select("part", "first", "stop", "each", "slot"), "part").where("rank >= first and rank < stop").select(
                "id", "size", "rank", F.expr("slot + (rank - first) div each").alias("slot"))
            beyond = steps.groupBy("part").agg(F.max("stop").alias("beyond"))
            by_gap = gaps.join(steps.select(F.col("gap_part").alias("part"), "gap_first", F.col("slot").alias("slot0"),
                                            F.expr("gap_first + (stop - first + each - 1) div each").alias("gap_stop")), "part")
            taken = by_gap.where("rank >= gap_first and rank < gap_stop").select(
                F.col("id").alias("sequence"), F.col("size").alias("gap"), F.expr("slot0 + rank - gap_first").alias("slot"))
            gap_beyond = steps.groupBy(F.col("gap_part").alias("part")).agg(
                F.max(F.expr("gap_first + (stop - first + each - 1) div each")).alias("beyond"))
            met = staged(by_doc.join(taken, "slot").selectExpr(
                "slot", "id", "size", "sequence", "gap", "sum(size) over (partition by slot order by rank) as filled"))
            done.append(met.selectExpr("id", "sequence", f"{capacity} - gap + filled - size as place"))
            shrunk = met.groupBy("sequence").agg((F.max("gap") - F.max("filled")).alias("size")).select(F.col("sequence").alias("id"), "size")
            docs = docs.join(beyond, "part", "left").where("beyond is null or rank >= beyond")
            gaps = gaps.join(gap_beyond, "part", "left").where("beyond is null or rank >= beyond").select("id", "size").unionByName(shrunk.where("size > 0"))
        state = staged(docs.select("size", F.lit(1).alias("kind"), "id").unionByName(
            gaps.select("size", F.lit(0).alias("kind"), "id")).unionByName(used.select("size", F.lit(0).alias("kind"), "id")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("sequence", "sequence_id")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    pieces = staged(token_pieces(docs, key, text, capacity, path).withColumn("id", F.monotonically_increasing_id()))
    places = pack(pieces.select("id", "length"), capacity)
    return pieces.join(places, "id").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", F.col("place").alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
