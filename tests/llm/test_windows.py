"""Repeated passages and contamination against plain counts; components; hashes of windows."""

import random
import re

import numpy as np
import pytest
from fixtures import LONG, SENTENCE, docs, edited, empty, sentences

from ledgerlens.llm import decontaminate, substrings
from ledgerlens.llm.common import AT_ONCE, components, forest


@pytest.mark.parametrize("most,kind", [(AT_ONCE, "long"), (30, "long"), (0, "long"), (AT_ONCE, "string")])
def test_components(spark, most, kind):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 1), (2000, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")
    if kind == "string":  # of equal width, so that their order is that of the numbers
        df = df.selectExpr("lpad(a, 5, '0') a", "lpad(b, 5, '0') b")
    got = {int(r.node): int(r.component) for r in components(df, "a", "b", most).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_forest_of_a_long_path_in_random_order():
    names = np.random.default_rng(3).permutation(200_000)
    node, low = forest(names[1:], names[:-1])
    assert (low == 0).all() and sorted(node.tolist()) == list(range(1, 200_000))


def plain_removal(rows):
    """Rows as (id or -1, text), judged on the input in order of id, then text hash (unique ids here), then start."""
    seen, out = set(), {}
    for ident, text in sorted(rows, key=lambda r: r[0]):
        w = text.encode().split()
        gone = set()
        for i in range(len(w) - 19):
            win = tuple(w[i:i + 20])
            if win in seen:
                gone.update(range(i, i + 20))
            seen.add(win)
        out[ident] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_repeats(spark, monkeypatch):
    texts = sentences(3, 6, 80)
    rows = [(300 + i, t, "en") for i, t in enumerate(texts + [texts[0] + " new words " + texts[1], "pre " + texts[2][:200], " ".join(["again"] * 200), texts[4].upper(), texts[4]])]
    df = docs(spark).where("doc_id is null or doc_id != 12").unionByName(docs(spark, rows))
    monkeypatch.setattr(substrings, "FLUSH", 50)
    got = {-1 if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(df, bits=20).collect()}
    assert got == plain_removal([(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()])


def test_repeated_rows_are_one_document(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(40)), "en")] * 2 + [(2, " ".join(f"w{i}" for i in range(10, 60)), "en")]
    got = sorted((r.doc_id, r.n_removed) for r in substrings.without_repeats(docs(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]
    assert substrings.without_repeats(empty(spark)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({65 + i: 97 + i for i in range(26)}))


def plain_hits(text, items):
    w, hit, found = words(text), set(), set()
    for ident, t in items:
        x = words(t)
        size = min(13, len(x))
        wins = {tuple(x[i:i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1 if x else 0):
            if tuple(w[i:i + size]) in wins:
                hit.update(range(i, i + size))
                found.add("null" if ident is None else str(ident))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_contamination(spark):
    texts = sentences(8, 6, 60)
    items = [(1, SENTENCE), (2, "lazy dog"), (3, texts[0]), (3, texts[1]), (None, "x"), (5, None), (6, " !? "), (7, "Été à ÉTÉ"), (10, texts[0])]
    bench = spark.createDataFrame([(*i, "clash", "clash") for i in items], "item_id long, text string, id string, size string")
    rows = [(500 + i, t, "en") for i, t in enumerate([
        "lead in " + " ".join(texts[0].split()[5:30]) + " tail", " ".join(texts[1].split()[:12]), edited(texts[0], 6, 3), texts[2] + " " + texts[0],
        " ".join(sentences(11, 1, 900)) + " lazy, dog", "été à ÉtÉ", texts[1].upper()])]
    df = docs(spark).unionByName(docs(spark, rows))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.contamination(df, bench).collect())
    all_rows = df.collect()
    assert got == sorted((str(r.doc_id), *plain_hits(r.text, items)) for r in all_rows)
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in all_rows if not plain_hits(r.text, items)[3])
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_copies_of_one_text_spread_over_the_buckets():
    ids, n = np.arange(-1000, 1000), 50
    doc, start = np.repeat(np.arange(2000), n), np.tile(np.arange(n), 2000)
    rows = substrings.repeats_of(ids, np.full(2000, -77), doc, start, 3)
    sizes = [len(x) // 8 for x in rows.column("ids").to_pylist()]
    assert len(sizes) == 8 and sum(sizes) == 2000 and max(sizes) < 350
    again = substrings.repeats_of(ids[:1], np.full(1, -77), doc[:n], start[:n], 3)  # a document's bucket is the same in every task
    at = rows.column("to").to_pylist().index(again.column("to")[0].as_py())
    assert again.column("ids")[0].as_py() in [rows.column("ids")[at].as_py()[i:i + 8] for i in range(0, 8 * sizes[at], 8)]


def test_a_table_mostly_of_one_text(spark):
    rows = [(i, LONG[:2000], "en") for i in range(300)] + [(300, SENTENCE, "en")]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.without_repeats(docs(spark, rows)).collect()}
    n = out[0][0]
    assert out == {0: (n, 0), **{i: (n, n) for i in range(1, 300)}, 300: (len(SENTENCE.split()), 0)}
