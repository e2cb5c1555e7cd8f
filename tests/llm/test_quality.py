"""Statistics against a plain count, and what the decision list learns."""

import re
from collections import Counter

from fixtures import docs, empty, sentences

from ledgerlens.llm import quality

EXTRA = ["a b c d e a b c d e", "x " * 3000, "one two three four five six", "l1 a\nl1 a\n l1 a\n\n\nl1 a", "#*$%&|<> ok", "     nbsp stays a word\x1c here ", "a b c d e f a b c d e"]


def plain(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    seen = Counter(tuple(w[i:i + 5]) for i in range(n - 4))
    covered = {i + k for i in range(n - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rows = [(100 + i, t, "en") for i, t in enumerate(EXTRA)]
    df = docs(spark).unionByName(docs(spark, rows))
    want = sorted((str(r.doc_id), *plain(r.text or "")) for r in df.collect())
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(df).collect())
    assert got == want
    assert quality.statistics(empty(spark)).count() == 0


def test_learning(spark):
    good, bad, short = sentences(1, 150, 60), sentences(2, 60, 60), sentences(3, 40, 12)
    rows = [(i, t, "en") for i, t in enumerate(good + ["| ".join(t.split()) for t in bad] + short)]
    stats = quality.statistics(docs(spark, rows, clashing=False))
    labels = spark.createDataFrame([(i, int(150 <= i < 210)) for i in range(250)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, bad int")
    rules = quality.learn(stats.join(labels, "doc_id"))
    assert rules and all(r.bad > 20 * r.good for r in rules) and len(rules[0].conditions) <= quality.MAX_CONDITIONS
    kept = {r.doc_id: r.kept for r in quality.judged(stats, rules).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 210)) and all(kept[i] for i in range(210, 250))
    assert "when" in str(quality.verdict(rules)).lower()


def test_no_labels(spark):
    stats = quality.statistics(docs(spark))
    assert quality.learn(stats.withColumn("bad", quality.F.lit(None).cast("int"))) == []
    rows = quality.judged(stats, []).collect()
    assert all(r.kept != r.base_failed for r in rows) and {r.base_failed for r in rows if not r.n_words} == {True}
