"""Language identification: sums over all segmentations, held-out accuracy, awkward rows."""

import itertools
import math

import numpy as np
import public_tokenizers
from fixtures import docs, empty
from pyspark.sql import functions as F

from ledgerlens.llm import langid
from ledgerlens.llm.common import table


def brute(word, probability):
    """Sum over every way to cut the word, unknown letters being the piece ''."""
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        p = 1.0
        for x in parts:
            p *= probability.get(x, probability[""] if len(x) == 1 else 0.0)
        total += p
    return total


def test_forward_sums_all_segmentations():
    vocabulary = ["", "a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "c"]
    rng = np.random.default_rng(3)
    p = rng.random((len(vocabulary) + 1, 2))
    p[-1] = 0
    lattice = langid.Lattice(vocabulary)
    for word in ("▁abab", "▁a", "▁bcdab", "▁zzabac", "▁" + "ab" * 5):
        got = lattice.forward([word, word], p)
        for lang in range(2):
            want = brute(word, {v: p[i, lang] for i, v in enumerate(vocabulary)})
            assert math.isclose(got[0, lang], math.log(want), rel_tol=1e-9) and got[0, lang] == got[1, lang]


def test_expected_counts_are_those_of_all_segmentations():
    vocabulary = ["", "a", "b", "ab", "▁", "▁a"]
    p = np.vstack([np.random.default_rng(1).random((6, 1)), [[0.0]]])
    lattice, into = langid.Lattice(vocabulary), np.zeros((7, 1))
    lattice.expected(["▁abab"], np.array([[2.0]]), p, into)
    probability = {v: p[i, 0] for i, v in enumerate(vocabulary)}
    want, whole = dict.fromkeys(vocabulary, 0.0), brute("▁abab", probability)
    for cuts in itertools.product((0, 1), repeat=4):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [5]
        parts = ["▁abab"[a:b] for a, b in zip([0, *ends], ends)]
        weight = math.prod(probability.get(x, 0.0) for x in parts) / whole
        for x in parts:
            if x in want:
                want[x] += 2 * weight
    assert np.allclose([want[v] for v in vocabulary], into[:6, 0])


def test_very_long_words_are_rescaled():
    vocabulary = langid.pieces(public_tokenizers.path(langid.VOCABULARY))[:2000]
    p = np.vstack([np.full((len(vocabulary), 1), 1e-5), [[0.0]]])
    score = langid.Lattice(vocabulary).forward(["▁" + "qx" * 20_000], p)
    assert np.isfinite(score).all() and score[0, 0] < -1e5


def test_held_out_accuracy(spark):
    docs_ = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.op1_langid(spark, "/root/testdata/sf0.01").join(docs_.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[1] > 100 and right[0] > 0.98


def test_awkward_rows(spark):
    df = docs(spark)
    learned = langid.train(df)
    assert learned[0] == ["de", "en", "fr"]
    found = langid.identify(df, learned, ("doc_id",)).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.lang_pred for r in found}
    assert [by[i] for i in (4, 5, 6, 9)] == ["und"] * 4 and by[8] == "de" and by[3] == "en" and by[11] == "fr"
    kept = langid.keep_identified(df, learned)
    assert kept.columns == df.columns and kept.where("score != 'extra-score'").count() == 0
    assert {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6, 9})


def test_labels_of_unlearned_rows_do_not_matter(spark):
    df = docs(spark, clashing=False)
    learned = langid.train(df.where("doc_id < 5 or doc_id = 8"))
    assert learned[0] == ["de", "en"]


def test_empty_and_unlabelled(spark):
    learned = langid.train(empty(spark))
    assert learned[0] == []
    assert {r.lang_pred for r in langid.identify(docs(spark), learned, ("doc_id",)).collect()} == {"und"}
    assert langid.identify(empty(spark), langid.train(docs(spark)), ("doc_id",)).count() == 0


def test_long_words_are_learned_from_as_short_ones():
    vocabulary = langid.pieces(public_tokenizers.path(langid.VOCABULARY))[:3000]
    rng = np.random.default_rng(2)
    p = np.vstack([rng.uniform(1e-4, 1e-2, (len(vocabulary), 2)), [[0.0, 0.0]]])
    lattice = langid.Lattice(vocabulary)
    pairs = [v for v in vocabulary if len(v) == 2 and v.isalpha() and langid.MARK not in v][:20]
    words = [langid.MARK + "".join(rng.choice(pairs, 14)) for _ in range(3)]
    counts = np.array([[2.0, 0.0], [1.0, 3.0], [0.0, 5.0]])
    short, long = np.zeros_like(p), np.zeros_like(p)
    lattice.expected(words, counts, p, short)
    lattice._expected_long(words, counts, p, long)
    assert np.allclose(short, long) and short.sum() > 0
    very = np.zeros_like(p)
    lattice.expected([langid.MARK + "".join(rng.choice(pairs, 1500))], np.array([[1.0, 2.0]]), p, very)
    assert np.isfinite(very).all() and very[:, 0].sum() > 300
    nowhere = np.zeros_like(p)
    lattice.expected([langid.MARK + "一" * 50], np.ones((1, 2)), np.where(np.arange(len(p))[:, None] == 0, 0.0, p), nowhere)
    assert np.isfinite(nowhere).all()


def test_remembered_words_make_room():
    vocabulary = langid.pieces(public_tokenizers.path(langid.VOCABULARY))
    p = np.vstack([np.full((len(vocabulary), 2), 1e-4), [[0.0, 0.0]]])[:len(vocabulary)]
    known = langid._Known(p, 2, public_tokenizers.path(langid.VOCABULARY))
    known.most = 40
    known.learn([f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"])
    want = {c: known.scores[i].copy() for c, i in known.number.items()}
    known.met[[known.number["au"], known.number["hz"]]] = True
    known.make_room()
    assert set(known.number) == {"au", "hz"} and all((known.scores[i] == want[c]).all() for c, i in known.number.items())
    known.learn(["bu", "bv"])
    assert all(np.allclose(known.scores[known.number[c]], want[c]) for c in ("bu", "bv", "au"))


def test_a_word_is_known_once_whatever_stands_beside_it():
    text = "Haus, (haus) haus. 3haus-haus \u201chaus\u201d\u00a0cafe\u0301's na\u00efve"
    chunks = langid.chunks_of(text)
    assert [w for c in chunks for w in langid._letters(c)] == langid.words_of(text)
    assert chunks.count("haus") == 5
    lattice = langid.lattice_of(public_tokenizers.path(langid.VOCABULARY))
    p = np.full((len(lattice.keys) + 1, 2), 1e-4)
    known = langid._Known(p, 2, public_tokenizers.path(langid.VOCABULARY))
    known.learn(["haus", "3", "na\u00efve\u2014haus"])
    one, two = (known.lattice.forward([langid.MARK + w], p)[0] for w in ("haus", "na\u00efve"))
    assert np.allclose(known.scores[:3], [one, [0, 0], one + two]) and known.sizes[:3].tolist() == [1, 0, 2]
