"""The audit against filters applied to plain lists in all 120 orders."""

import re
from itertools import permutations

import numpy as np
from fixtures import docs, empty

from ledgerlens.llm import filter_audit

EXTRA = [
    (20, " ".join(f"word{i}" for i in range(60)), "en"),
    (21, " ".join(f"word{i}" for i in range(60)), "en"),
    (21, " ".join(f"word{i}" for i in range(60)), "en"),
    (22, " ".join(f"word{i % 9}" for i in range(60)) + " #tag", "en"),
    (23, "SHOUTING " * 70, "en"),
    (24, "Word\x1cstill word one " * 20, "en"),
    (None, " ".join(f"word{i}" for i in range(60)), "en"),
    (25, "É" * 300, "fr"),
]
LABELS = [(20, 1, 0), (21, 0, 1), (21, 1, 0), (22, None, 1), (23, 1, None), (12, 1, 1), (None, 1, 1), (999, 1, 1), (1, 1, 0), (2, 1, 1), (4, 0, 1)]


def plain(rows, labels):
    def failing(r):
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = set()
        if len(w) < 50:
            out.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            out.add("C")
        if re.search(r"[#$%&*|]", t):
            out.add("D")
        if r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == t for o in rows):
            out.add("E")
        return out

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = {}
    for r in rows:
        parts.setdefault(r.source or "", []).append((r.doc_id, failing(r)))
    out = []
    for part, members in parts.items():
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(members)
            for i, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                steps.append((order, i + 1, f, len(left), len(gone), sum(f in m[1] for m in members) - len(gone),
                              sum(m[1] == {f} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)))
        out += [(part, s[0], s[1], *s[3:], shapley[s[2]]) for s in steps]
    return sorted(out)


def audited(docs_, labels):
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.cells(filter_audit.masks(docs_), labels)).collect())


def test_against_plain_lists(spark):
    df = docs(spark).unionByName(docs(spark, EXTRA))
    source = filter_audit.F.when(filter_audit.F.col("doc_id") % 3 == 0, "src/a").when(filter_audit.F.col("doc_id") % 3 == 1, "")
    df = df.withColumn("source", source)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("source", filter_audit.F.lit("clash"))
    got = audited(df.repartition(5), labels)
    assert len(got) == 2 * 600 and got == plain(df.collect(), LABELS)


def test_a_hot_text_and_a_hot_source(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(300)]
    got = audited(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    first = next(r for r in got if r[1] == "EABCD" and r[2] == 1)
    assert first[3:5] == (101, 199) and first[7:9] == (0, 0)


def test_nothing(spark):
    found = filter_audit.audit(filter_audit.cells(filter_audit.masks(empty(spark)), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found.count() == 0


def test_walk_is_the_count_under_every_set():
    counts = np.random.default_rng(1).integers(0, 50, (7, 32, 3))
    states = filter_audit.survivors(counts)
    for chosen in range(32):
        assert (states[:, chosen] == counts[:, [m for m in range(32) if not m & chosen]].sum(axis=1)).all()
