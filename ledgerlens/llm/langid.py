"""Language identification by unigram pieces, summed over all segmentations of a word.

Text is lower-cased and cut into words of letters; a word is a mark for its beginning and its letters.  The pieces
are the fixed vocabulary of a public tokenizer (those made of letters), plus one unknown piece for
a letter that is no piece.  A language gives each piece a probability; the probability of a word is the sum over all
ways to cut it into pieces of the products, by a forward pass; a text's is the product over its words.

Training counts the words of every learning text per label (combined in the tasks, then by a shuffle), and
estimates the probabilities by expectation maximisation over the word table: each task runs forward and
backward passes and sends one vector of expected counts per language, of the vocabulary's size whatever the
corpus.  The model is pieces x languages numbers, and that is all that reaches the driver or is broadcast.

The score is the posterior of the best language under equal priors (words taken as independent, tempered by the
square root of their number so that long texts do not saturate at once).

Defined cases: null text or no letter: ``und``, score 0.  Null labels teach nothing.  A null id is held out.
Without any label every text is ``und``.  Ties go to the alphabetically first language.  Very long words are scored in
one pass with rescaling.  Repeated rows count as often as they occur.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lean, staged, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # the vocabulary's sign for a word's beginning
ROUNDS = 3
SMOOTHING = 0.1       # added to every expected count
FLUSH_WORDS = 200_000  # words counted or remembered before a worker lets go of them
HELD_NUMBERS = 1 << 23
MAX_LANGUAGES = 1000  # bounds the model; more labels than that are refused, not dropped
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UND = "und"


def pieces(path: str) -> list[str]:
    """The letter pieces of a vocabulary, in its order; the empty string stands for an unknown letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = dict.fromkeys(p for p in map(model.id_to_piece, range(model.get_piece_size()))
                          if p and LETTERS.fullmatch(p.replace(MARK, "", 1) or "x") and p == p.lower() and MARK not in p[1:])
    return ["", *known]


class Lattice:
    """Forward and backward sums over all segmentations, for many words of one length at once.

    Substrings are looked up by a 64-bit polynomial hash, all lengths that end at one letter together.
    """

    BASE, SLOT_BITS, FILTER_BITS = np.uint64(0x9E3779B97F4A7C15), 22, 18

    def __init__(self, vocabulary: list[str]) -> None:
        self.longest = max(map(len, vocabulary), default=1) or 1
        keys = np.array([self._hash(p) for p in vocabulary], dtype=np.uint64)
        if len(set(keys.tolist())) < len(keys):
            raise ValueError("two pieces share a hash")
        self.keys = keys
        # two tables of slots; a piece whose first slot is taken goes to the second table
        self.spread = (np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F))
        self.slots = [np.zeros(1 << self.SLOT_BITS, dtype=np.int32) for _ in self.spread]
        for piece in range(1, len(vocabulary)):
            for table_, slot in zip(self.slots, self._slots(keys[piece:piece + 1])):
                if not table_[slot[0]]:
                    table_[slot[0]] = piece
                    break
            else:
                raise ValueError("no slot for a piece")
        self.maybe = np.zeros(1 << self.FILTER_BITS, dtype=bool)  # small enough for a cache: most substrings end here
        self.maybe[(keys[1:] * self.spread[0]) >> np.uint64(64 - self.FILTER_BITS)] = True

    def _slots(self, keys: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return [(keys * m) >> np.uint64(64 - self.SLOT_BITS) for m in self.spread]

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) % (1 << 64)
        return h

    def matches(self, words: list[str]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end in turn: (length, rows, pieces) of the pieces that end there; the unknown piece where a letter is none."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        before = np.zeros((0, len(words)), dtype=np.uint64)
        for end in range(codes.shape[1]):
            with np.errstate(over="ignore"):
                longer = before[:self.longest - 1] * self.BASE + codes[:, end]
            before = np.concatenate((codes[None, :, end], longer))
            with np.errstate(over="ignore"):
                k, rows = np.nonzero(self.maybe[(before * self.spread[0]) >> np.uint64(64 - self.FILTER_BITS)])
            key = before[k, rows]
            first, second = self._slots(key)
            piece = self.slots[0][first]
            wrong = np.nonzero(self.keys[piece] != key)[0]
            other = self.slots[1][second[wrong]]
            piece[wrong] = np.where(self.keys[other] == key[wrong], other, 0)
            good = piece > 0
            k, rows, piece = k[good], rows[good], piece[good]
            cuts = np.searchsorted(k, np.arange(len(before) + 1))
            single = np.zeros(len(words), dtype=np.int32)
            single[rows[:cuts[1]]] = piece[:cuts[1]]
            found = [(1, slice(None), single)]
            found += [(i + 1, rows[a:b], piece[a:b]) for i, (a, b) in enumerate(zip(cuts[1:-1], cuts[2:]), 1) if b > a]
            yield found

    def forward(self, words: list[str], p: np.ndarray, keep: bool = False):
        """Log probabilities (words, languages) of words of one length."""
        n, langs = len(words), p.shape[1]
        alpha, met = [np.ones((n, langs))], []
        scale = np.zeros((n, langs))
        for end, found in enumerate(self.matches(words), 1):
            now = np.zeros((n, langs))
            for k, rows, piece in found:
                now[rows] += alpha[-k][rows] * p[piece]
            alpha.append(now)
            if keep:
                met.append(found)
            else:
                alpha = alpha[-self.longest:]
                if end % 16 == 0:  # rescale what is still in reach
                    top = np.maximum(np.max(alpha, axis=0), 1e-300)
                    alpha = [a / top for a in alpha]
                    scale += np.log(top)
        total = np.log(np.maximum(alpha[-1], 1e-300)) + scale
        return (total, alpha, met) if keep else total

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected uses of each piece in ``words`` (of one length, ``counts`` per language)."""
        if len(words[0]) >= LONG_WORD:
            return self._expected_long(words, counts, p, into)
        _, alpha, met = self.forward(words, p, keep=True)
        length = len(words[0])
        beta = [np.zeros_like(alpha[0]) for _ in range(length)] + [np.divide(counts, alpha[-1], out=np.zeros_like(alpha[0]), where=alpha[-1] > 0)]
        used, uses = [], []
        for end in range(length, 0, -1):
            for k, rows, piece in met[end - 1]:
                step = p[piece] * beta[end][rows]
                beta[end - k][rows] += step
                used.append(piece)
                uses.append(alpha[end - k][rows] * step)
        used, uses = np.concatenate(used), np.concatenate(uses)
        for lang in range(p.shape[1]):
            into[:, lang] += np.bincount(used, weights=uses[:, lang], minlength=len(into))

    def _expected_long(self, words: list[str], counts: np.ndarray, p: np.ndarray, into: np.ndarray) -> None:
        """The same by sums of logarithms."""
        n, length, met = len(words), len(words[0]), list(self.matches(words))
        with np.errstate(divide="ignore"):
            logs = np.log(p)
        alpha = np.full((length + 1, n, p.shape[1]), -np.inf)
        beta = alpha.copy()
        alpha[0] = beta[length] = 0.0
        for end in range(1, length + 1):
            for k, rows, piece in met[end - 1]:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - k, rows] + logs[piece])
        whole = np.where(np.isfinite(alpha[length]), alpha[length], np.inf)  # a word that a language can't spell has no uses
        for end in range(length, 0, -1):
            for k, rows, piece in met[end - 1]:
                step = logs[piece] + beta[end, rows]
                np.add.at(into, piece, np.exp(alpha[end - k, rows] + step - whole[rows]) * counts[rows])
                beta[end - k, rows] = np.logaddexp(beta[end - k, rows], step)


LONG_WORD = 40  # the products of longer ones leave the range of a float, so they are learned from by logarithms


@lru_cache(maxsize=1)
def lattice_of(path: str) -> Lattice:
    """Kept by a Python worker from task to task."""
    return Lattice(pieces(path))


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


# Bytes of UTF-8 that are no ASCII letter are blanks here; those of other characters stay.
ASCII_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def chunks_of(text: str) -> list[str]:
    """What stands between blanks and other ASCII characters that are no letters: most often a word, which these always end."""
    return text.lower().encode().translate(ASCII_LETTERS).decode().split()


def _letters(chunk: str) -> list[str]:
    """The words of a chunk; most often all of it."""
    return [chunk] if chunk.isalpha() else LETTERS.findall(chunk)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}  # of chunks; their words are found once for all occurrences

    def rows() -> pa.RecordBatch:
        lang, word, n = [], [], []
        for x, chunks in counts.items():
            of: Counter = Counter()
            for chunk, times in chunks.items():
                for w in _letters(chunk):
                    of[w] += times
            lang += [x] * len(of)
            word += of.keys()
            n += of.values()
        return pa.RecordBatch.from_arrays([pa.array(lang, type=pa.string()), pa.array(word, type=pa.string()), pa.array(n, type=pa.int64())],
                                          names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(chunks_of(text))
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield rows()
                counts = {}
    yield rows()


def by_length(words: list[str], block: int = 2048) -> Iterator[np.ndarray]:
    """Row numbers of words of equal length, in blocks."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(length):
        rows = np.nonzero(length == n)[0]
        for i in range(0, len(rows), max(1, block // max(1, n // 16))):
            yield rows[i:i + max(1, block // max(1, n // 16))]


def _expect(model, langs: list[str], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, p = lattice_of(path), model.value
        into, number = np.zeros_like(p), {x: i for i, x in enumerate(langs)}
        seen = False
        for batch in batches:
            words, seen = batch.column(0).to_pylist(), True
            counts = np.zeros((len(words), len(langs)))
            for i, (names, values) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for x, n in zip(names, values):
                    counts[i, number[x]] += n
            for rows in by_length(words):
                lattice.expected([words[i] for i in rows], counts[rows], p, into)
        if seen:
            piece, lang = np.nonzero(into > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(into[piece, lang])],
                                             names=["piece", "lang", "n"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their piece probabilities (pieces + 1, languages), from all rows with text and label."""
    spark, path = docs.sparkSession, path or public_tokenizers.path(VOCABULARY)
    vocabulary = pieces(path)
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = staged(known.mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = np.full((len(vocabulary) + 1, len(langs)), 1.0 / len(vocabulary))
    model[-1] = 0.0
    table_ = counted.select(F.concat(F.lit(MARK), F.col("word")).alias("word"), "lang", "n")
    table_ = staged(table_.groupBy("word").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns")))  # at most one of each language
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(model)
        found = table_.mapInArrow(lean(_expect(shared, langs, path)), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.full_like(model, SMOOTHING)
        for row in found.toLocalIterator():  # vocabulary x languages rows at most
            counts[row["piece"], row["lang"]] += row["n"]
        counts[-1] = 0.0
        model = counts / counts.sum(axis=0)
        shared.unpersist()
    return langs, model


class _Known:
    """Scores of chunks, kept by a Python worker as long as it works with one model.

    When it is full, what was met since it was last full stays (half of the places at most).
    """

    def __init__(self, model: np.ndarray, langs: int, path: str) -> None:
        self.lattice, self.p, self.langs = lattice_of(path), model, max(1, langs)
        self.most = max(2000, min(FLUSH_WORDS, HELD_NUMBERS // self.langs))
        self.number: dict[str, int] = {}
        self.scores, self.sizes, self.met = np.zeros((1 << 12, self.langs)), np.zeros(1 << 12), np.zeros(1 << 12, dtype=bool)

    def learn(self, chunks: list[str]) -> None:
        found = [_letters(c) for c in chunks]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        at: dict[str, int] = {}
        of = np.fromiter((at.setdefault(w, len(at)) for f in found for w in f), dtype=np.int64, count=int(sizes.sum()))
        words, score = [MARK + w for w in at], np.zeros((len(at), self.langs))
        for rows in by_length(words):
            score[rows] = self.lattice.forward([words[i] for i in rows], self.p)
        first = len(self.number)
        while first + len(chunks) > len(self.scores):
            size = 2 * len(self.scores)
            self.scores, self.sizes, self.met = np.resize(self.scores, (size, self.langs)), np.resize(self.sizes, size), np.resize(self.met, size)
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        last, some = first + len(chunks), sizes > 0
        self.sizes[first:last], self.scores[first:last] = sizes, 0.0
        if some.any():
            self.scores[first:last][some] = np.add.reduceat(score[of], (np.cumsum(sizes) - sizes)[some], axis=0)

    def make_room(self) -> None:
        if len(self.number) > self.most:
            stay = [(c, i) for c, i in self.number.items() if self.met[i]][:self.most // 2]
            rows = np.array([i for _, i in stay], dtype=np.int64)
            self.scores[:len(rows)], self.sizes[:len(rows)] = self.scores[rows], self.sizes[rows]
            self.number = {c: i for i, (c, _) in enumerate(stay)}
            self.met[:] = False


_KNOWN: dict[str, _Known] = {}


def _known(token: str, model, langs: int, path: str) -> _Known:
    if token not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[token] = _Known(model.value, langs, path)
    return _KNOWN[token]


def _predict(model, langs: list[str], path: str):
    token = uuid.uuid4().hex  # of this model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(token, model, len(langs), path)
        for batch in batches:
            names, best = [], []
            for at in range(0, len(batch), 256):
                known.make_room()
                counted = [Counter(chunks_of(t)) if t and langs else {} for t in batch.column(0)[at:at + 256].to_pylist()]
                known.learn(list(set().union(*counted).difference(known.number)))
                for of in counted:
                    rows = np.fromiter(map(known.number.__getitem__, of), dtype=np.int64, count=len(of))
                    n = np.fromiter(of.values(), dtype=np.float64, count=len(of))
                    known.met[rows] = True
                    words = float(n @ known.sizes[rows])
                    if not words:
                        names.append(UND)
                        best.append(0.0)
                        continue
                    total = n @ known.scores[rows]
                    i = int(np.argmax(total))
                    names.append(langs[i])
                    best.append(float(1.0 / np.exp((total - total[i]) / np.sqrt(words)).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], pa.array(names, type=pa.string()),
                                              pa.array(best, type=pa.float64())],
                                             names=[*batch.schema.names[1:], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learned: tuple[list[str], np.ndarray], keep: tuple[str, ...], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` of every document, then ``lang_pred`` and ``score``; only the text is looked at."""
    langs, model = learned
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    found = rows.mapInArrow(lean(_predict(shared, langs, path or public_tokenizers.path(VOCABULARY))), f"{kinds}, lang_pred string, score double")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def keep_identified(docs: DataFrame, learned: tuple[list[str], np.ndarray], least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without texts of no language or of a score under ``least``."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    found = identify(packed, learned, ("row",)).where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, train(docs.where("not held_out")), ("doc_id", "held_out"))
