"""Scores against explicit pairs, one gradient step against differences, held-out accuracy."""

import numpy as np
import pytest
from fixtures import docs, empty, sentences
from pyspark.sql import functions as F

from ledgerlens.llm import fm_quality
from ledgerlens.llm.fm_quality import FACTORS, INPUTS, Machine


def random_machine(seed=1):
    rng = np.random.default_rng(seed)
    return Machine(0.3, rng.normal(0, 0.3, INPUTS).astype(np.float32), rng.normal(0, 0.3, (INPUTS, FACTORS)).astype(np.float32))


def by_pairs(m, at, x):
    z = m.w0 + sum(float(m.w[a]) * float(v) for a, v in zip(at, x))
    for i in range(len(at)):
        for j in range(i + 1, len(at)):
            z += float(m.v[at[i]].astype(float) @ m.v[at[j]].astype(float)) * float(x[i]) * float(x[j])
    return 1 / (1 + np.exp(-z))


def test_linear_time_form_is_the_sum_over_pairs():
    m, features = random_machine(), fm_quality.Features()
    rows = [features(t.encode(), n) for t, n in [("A few words, THE!! end.\nAnd 12 more", 7), ("", None), ("x", 1), (" ".join(sentences(1, 1, 60)), 3)]]
    got = m.scores([r[0] for r in rows], [r[1] for r in rows])
    assert np.allclose(got, [by_pairs(m, *r) for r in rows], atol=1e-5)


def test_a_step_goes_down_the_gradient():
    m = random_machine(2)
    at, x = fm_quality.Features()("some words of a text that is short".encode(), 34)
    def loss(machine):
        p = by_pairs(machine, at, x)
        return -np.log(p)

    for k in (0, 3, len(at) - 1):  # adaptive steps keep the sign of the gradient
        for column in (None, 2):
            up = Machine(m.w0, m.w.copy(), m.v.copy())
            place = (up.w, at[k]) if column is None else (up.v, (at[k], column))
            place[0][place[1]] += 1e-2
            slope = (loss(up) - loss(m)) / 1e-2
            after = m.walk([(at, x, 1)])
            moved = (after.w[at[k]] - m.w[at[k]]) if column is None else after.v[at[k], column] - m.v[at[k], column]
            assert abs(slope) < 1e-4 or np.sign(moved) == -np.sign(slope)
    assert loss(m.walk([(at, x, 1)])) < loss(m)


def test_shapes_and_bins():
    assert fm_quality._shapes(b"AAAAAAAAAAAAAA!! aaa000aaaaaaaaa") == b"A!! a0a"
    at, weight = fm_quality.Features()(b"w " * 50_000, None)
    assert len(at) == len(weight) and at.max() < INPUTS and np.isfinite(weight).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = fm_quality.op12_quality_fm(spark, sf)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right = found.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right[1] > 50 and right[0] > 0.93


def learned(spark, df, **options):
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(100)] + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    return fm_quality.train(df, labels, **options)


@pytest.fixture(scope="module")
def corpus(spark):
    good, bad = sentences(1, 80, 40), sentences(2, 20, 40)
    return docs(spark, [(i, t, "en") for i, t in enumerate(good + ["| ".join(t.split()) for t in bad])])


def test_learns_alike_in_any_partitioning(spark, corpus):
    one, other = learned(spark, corpus.coalesce(1)), learned(spark, corpus.repartition(7))
    assert one.w0 == other.w0 and (one.w == other.w).all() and (one.v == other.v).all()
    by = {r.doc_id: r.score for r in fm_quality.score(corpus, one).collect()}
    assert min(by[i] for i in range(80)) > 0.7 > max(by[i] for i in range(80, 100))


def test_bound_on_labelled_rows(spark, corpus):
    rows = fm_quality.labelled(corpus, spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int"), "doc_id", "text", "n_chars", "quality", 30)
    assert 5 < rows.count() < 60


def test_labels_met_twice_and_ties(spark, corpus):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    rows = fm_quality.labelled(corpus.unionByName(corpus), labels, "doc_id", "text", "n_chars", "quality", 1000)
    assert sorted(r.label for r in rows.collect()) == [0, 1]


def test_awkward_rows(spark, corpus):
    machine = learned(spark, corpus)
    df = docs(spark)
    found = fm_quality.score(df, machine).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)
    assert fm_quality.score(df.drop("n_chars"), machine).count() == df.count()
    assert fm_quality.score(empty(spark), machine).count() == 0
    none = fm_quality.train(corpus, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in fm_quality.score(df, none).collect()} == {0.5}
    assert {r.score for r in fm_quality.score(df, fm_quality.train(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).collect()} == {0.5}
