"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Inputs of a text: its distinct words (hashed, weighted by the logarithm of their count), the shapes of its words (runs of letters and
digits shortened to one sign, so that "THE!!" is "A!!"), shares and sizes cut into bins, and ``n_chars`` of the row (its size, and whether it agrees with the text).
The score is a linear part and all pairwise interactions through ``FACTORS`` numbers per input, summed in linear time:
half the square of the sum less the sum of the squares.

Learning: at most about ``most_rows`` labelled documents (chosen by a hash of their ids from all of them, each as likely) are dealt by another hash to
``PARTS`` groups; in every round each group walks its rows once by adaptive gradient steps from the shared weights, and the weights
are averaged by rows.  A group holds most_rows / PARTS rows of sparse inputs; weights (2**16 inputs) are what reaches the driver.
Nothing depends on how rows lie in files or on the number of executors.  Scoring reads every text whole, once, without a shuffle.

Defined cases: null text is the empty one; it and wordless texts are scored by statistics and metadata.  Labels: null ones and unknown or null ids
teach nothing; a document labelled several times has the more frequent label, and teaches nothing if there is none; of rows that repeat
an id one text (the smallest hash) teaches.  Without labels every score is 0.5, with one class all scores lean to it.  A missing or null ``n_chars`` is its own input.  A null id
counts as held out.  Very long texts are read whole, in one task each.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged, table
from ledgerlens.llm.textio import WordHashes

BITS = 16
SHAPES, BINS = 1 << 10, 1 << 9  # places after those of the words
INPUTS = (1 << BITS) + SHAPES + BINS
FACTORS = 8
MOST_ROWS, PARTS, ROUNDS = 24_000, 6, 5
STEP, DECAY, SPREAD = 0.1, 1e-5, 0.02
THRESHOLD = 0.7  # fixed by the contract
TEXTS_AT_ONCE = 128

_CLASS = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_LETTERS, _CAPITALS, _DIGITS = b"a", b"A", b"0"
_BLANKS = b" \t\n\x0b\x0c\r"
WIDTH = 24  # bins of one statistic


def _shapes(classes: bytes) -> bytes:
    for c in (_LETTERS, _CAPITALS, _DIGITS):
        for run in (8, 4, 2, 2, 2):
            classes = classes.replace(c * run, c)
        while c + c in classes:
            classes = classes.replace(c + c, c)
    return classes


def _share(part: float, whole: float) -> int:
    """Bins that are finer near none."""
    return 0 if part <= 0 or whole <= 0 else min(WIDTH - 1, max(1, int(WIDTH + 2 * log2(part / whole))))


def _size(n: float) -> int:
    return min(WIDTH - 1, int(1.5 * log2(n + 1)))


def statistics(text: bytes, words: list[bytes], counts: Counter, classes: bytes, n_chars: int | None) -> list[int]:
    """One bin of each statistic."""
    n, solid = len(words), sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    letters, capitals, digits = (classes.count(c) for c in (_LETTERS, _CAPITALS, _DIGITS))
    ends = sum(x.rstrip(_BLANKS).endswith((b".", b"!", b"?")) for x in lines)
    size = len(text.decode("utf-8", "replace"))
    agrees = 0 if n_chars is None else 1 if n_chars == size else 2
    return [_size(n), min(WIDTH - 1, int(2 * solid / n)) if n else 0, _share(capitals, solid), _share(digits, solid), _share(solid - letters - capitals - digits, solid),
            _share(n - len(counts), n), _share(max(counts.values(), default=0), n), _share(len(lines) - len(set(lines)), len(lines)),
            _size(n / len(lines)) if lines else 0, _share(len(lines) - ends, len(lines)), _share(len(text) - solid, len(text)), agrees, _size(max(0, n_chars or 0))]


class Features:
    """Places and weights of the inputs of texts."""

    def __init__(self) -> None:
        self.hashes = WordHashes()
        self.shapes: dict[bytes, int] = {}

    def __call__(self, text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        classes = text.translate(_CLASS)
        shapes = Counter(_shapes(classes).split())
        of_words = (self.hashes(list(counts))[0] & np.uint64((1 << BITS) - 1)).astype(np.int32) if counts else np.empty(0, np.int32)
        bins = statistics(text, words, counts, classes, n_chars)
        at = np.concatenate([of_words, np.array([self._shape(s) for s in shapes], np.int32),
                             np.array([(1 << BITS) + SHAPES + WIDTH * i + b for i, b in enumerate(bins)], np.int32)])
        return at, np.concatenate([_unit(counts), _unit(shapes), np.full(len(bins), 1 / np.sqrt(len(bins)), np.float32)])

    def _shape(self, shape: bytes) -> int:
        if len(self.shapes) > 100_000:
            self.shapes.clear()
        if shape not in self.shapes:
            self.shapes[shape] = (1 << BITS) + xxhash.xxh3_64_intdigest(shape) % SHAPES
        return self.shapes[shape]


def _unit(counts: Counter) -> np.ndarray:
    w = np.log1p(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
    return w / np.sqrt(w @ w) if len(w) else w


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _inputs(docs: DataFrame, text: str, size: str) -> list[Column]:
    return [F.col(text).cast("binary").alias("text"), (F.col(size).cast("long") if size in docs.columns else F.lit(None).cast("long")).alias("n_chars")]


# ---------------------------------------------------------------- model


class Machine:
    """Bias, weights and factors; ``g`` sums squared gradients of one walk."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    @classmethod
    def start(cls, rate: float = 0.5) -> Machine:
        rng = np.random.default_rng(0)
        return cls(float(np.log(rate / (1 - rate))), np.zeros(INPUTS, np.float32), rng.normal(0, SPREAD, (INPUTS, FACTORS)).astype(np.float32))

    def scores(self, at: list[np.ndarray], weight: list[np.ndarray]) -> np.ndarray:
        """Of several texts, every one with an input at least."""
        starts = np.cumsum([0] + [len(x) for x in at[:-1]])
        a, x = np.concatenate(at), np.concatenate(weight)
        xv = x[:, None] * self.v[a]
        total = np.add.reduceat(xv, starts, axis=0)
        square = np.add.reduceat((xv * xv).sum(axis=1), starts)
        z = self.w0 + np.add.reduceat(x * self.w[a], starts) + 0.5 * ((total * total).sum(axis=1) - square)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def walk(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
        """The weights after one adaptive gradient step per row."""
        w0, w, v = self.w0, self.w.copy(), self.v.copy()
        g0, gw, gv = 1.0, np.full(INPUTS, 1e-2, np.float32), np.full((INPUTS, FACTORS), 1e-2, np.float32)
        for a, x, y in rows:
            va = v[a]
            xv = x[:, None] * va
            total = xv.sum(axis=0)
            z = w0 + x @ w[a] + 0.5 * (total @ total - (xv * xv).sum())
            loss = 1 / (1 + np.exp(-min(30.0, max(-30.0, float(z))))) - y
            g0 += loss * loss
            w0 -= STEP * loss / np.sqrt(g0)
            dw = loss * x + DECAY * w[a]
            dv = loss * x[:, None] * (total - xv) + DECAY * va
            gw[a] += dw * dw  # two words of a text in one place: the later one counts
            gv[a] += dv * dv
            w[a] -= STEP * dw / np.sqrt(gw[a])
            v[a] -= STEP * dv / np.sqrt(gv[a])
        return Machine(float(w0), w, v)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        for at in range(0, len(batch), TEXTS_AT_ONCE):
            rows = batch.slice(at, TEXTS_AT_ONCE)
            found = [features(t or b"", n) for t, n in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([xxhash.xxh64_intdigest(x[0].tobytes() + x[1].tobytes()) >> 1 for x in found], pa.int64()),
                 pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))],
                names=["key", "label", "mark", "at", "weight"])


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, size: str, label: str, most_rows: int) -> DataFrame:
    """Inputs and label of about ``most_rows`` documents at most, one row each."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(F.col(label).cast("double")).alias("rate"))
    known = staged(known.where("rate != 0.5").select("key", F.when(F.col("rate") > 0.5, 1).otherwise(0).alias("label")))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < F.lit(most_rows / n) * (1 << 30))
    # at most about ``most_rows`` narrow rows, by construction
    texts = docs.select(F.col(key).alias("key"), *_inputs(docs, text, size)).join(F.broadcast(known), "key").select("key", "label", "text", "n_chars")
    rows = texts.mapInArrow(_featured, f"key {docs.schema[key].dataType.simpleString()}, label int, mark long, at array<int>, weight array<float>")
    one = rows.groupBy("key").agg(F.min(F.struct("mark", "label", "at", "weight")).alias("r"))
    return staged(one.select(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(PARTS)).cast("int").alias("part"), F.xxhash64("key", F.lit("order")).alias("turn"), "r.label", "r.at", "r.weight"))


def _walk(shared, turn: int):
    def run(part: pa.Table) -> pa.Table:
        machine: Machine = shared.value
        turns = part.column("turn").to_numpy()
        order = np.argsort(turns * np.int64(2 * turn + 1), kind="stable")  # another order in each round
        at, weight, label = part.column("at"), part.column("weight"), part.column("label").to_numpy()
        rows = [(at[i].values.to_numpy(), weight[i].values.to_numpy(), int(label[i])) for i in order.tolist()]
        end = machine.walk(rows)
        return pa.table({"part": part.column("part").slice(0, 1), "n": [len(rows)], "w0": [end.w0], "w": pa.array([end.w.tobytes()], pa.binary()), "v": pa.array([end.v.tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars", label: str = "quality",
          most_rows: int = MOST_ROWS, rounds: int = ROUNDS) -> Machine:
    """From rows of ``labels`` with ``label`` 1 or 0."""
    rows = labelled(docs, labels, key, text, size, label, most_rows)
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n:
        empty = Machine.start()
        empty.v[:] = 0
        return empty
    machine = Machine.start((ones + 1) / (n + 2))
    for turn in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(machine)
        ends = rows.groupBy("part").applyInArrow(_walk(shared, turn), "part int, n long, w0 double, w binary, v binary").orderBy("part")
        w0, w, v = 0.0, np.zeros(INPUTS), np.zeros((INPUTS, FACTORS))
        for r in ends.toLocalIterator():  # PARTS rows
            w0, w, v = w0 + r["w0"] * r["n"] / n, w + np.frombuffer(r["w"], np.float32) * (r["n"] / n), v + np.frombuffer(r["v"], np.float32).reshape(v.shape) * (r["n"] / n)
        machine = Machine(w0, w.astype(np.float32), v.astype(np.float32))
        shared.unpersist()
    return machine


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, features = shared.value, Features()
        for batch in batches:
            scores = []
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                rows = batch.slice(at, TEXTS_AT_ONCE)
                found = [features(t or b"", n) for t, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())]
                scores.append(machine.scores([x[0] for x in found], [x[1] for x in found]))
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["key", "score"])

    return run


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``key`` and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(key).alias("key"), *_inputs(docs, text, size))
    return rows.mapInArrow(_scored(shared), f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def op12_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
