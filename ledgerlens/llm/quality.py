"""Quality rules: text statistics, and a decision list learned from labelled ones.

Statistics are Columns over one text: nothing is shuffled for them.  Whether any window of five words repeats is
decided on hashes; only texts where one may are counted exactly, on the words, by sorting their windows.

Learning is sequential covering.  Thresholds lie midway between neighbouring quantiles of each statistic.  A rule grows by the condition with the
highest information gain on the growing two thirds, loses its last conditions while that does not lower its
worth on the pruning third, and is kept if it is precise there; what it covers is set aside, and the next one grows.
Every step is one combined count per (statistic, threshold interval, label, part): some thousand
numbers reach the driver, whatever the number of labelled rows, all of which are used.
The result is an ordered conditional expression.

Defined cases: null or wordless text: all counts zero, base rule failed.  Labels of unknown documents, null labels and
null ids teach nothing; repeated labels count as often as they occur; without labels the list is empty and keeps all.  Very
long texts are counted whole.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import BLANKS, UPPER, staged, table

SYMBOLS = "#*$%&|<>"  # fixed by the contract
WINDOW = 5
MARKS, DIGITS = "!?;:.,", "0123456789"
QUANTILES = 32
MAX_RULES, MAX_CONDITIONS = 12, 4
PRECISION, LEAST_COVERED = 0.9, 5


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside five-word windows that occur twice or more in ``_words``."""
    n = F.size("_words") - (WINDOW - 1)
    starts = F.sequence(F.lit(0), n - 1)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_hashes", F.when(n >= 2, hashed))
    df = df.withColumn("_maybe", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False)))
    window = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("_words", i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.col("_maybe"), F.sort_array(window)))

    def twice(x: Column, k: Column) -> Column:
        return (F.coalesce(F.get("_sorted", k - 1).w == x.w, F.lit(False))
                | F.coalesce(F.get("_sorted", k + 1).w == x.w, F.lit(False)))

    again = F.sort_array(F.transform(F.filter("_sorted", twice), lambda x: x.i))

    def covered(acc: Column, i: Column) -> Column:
        return F.struct(i.alias("last"), (acc.n + F.least(F.lit(WINDOW), i - acc.last)).alias("n"))

    counted = F.aggregate(again, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), covered, lambda acc: acc.n)
    return df.withColumn("n_repeat_words", F.when(F.col("_maybe"), counted).otherwise(F.lit(0)).cast("long"))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the contract's counts, and further ones that rules may use."""
    df = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    trimmed = F.btrim(F.col("_text"), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    df = df.withColumn("_words", F.when(trimmed == "", none).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = with_repeats(df)
    t, size = F.col("_text"), F.length("_text")
    solid = F.length(_without(t, BLANKS))
    return df.select(
        key, F.size("_words").cast("long").alias("n_words"), solid.cast("long").alias("word_chars"),
        (size - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"), (size - F.length(_without(t, UPPER))).cast("long").alias("n_upper"),
        (size - F.length(_without(t, DIGITS))).cast("long").alias("n_digits"), (size - F.length(_without(t, MARKS))).cast("long").alias("n_marks"))


def base_failed() -> Column:
    """Fixed by the contract."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


# A statistic as it is, or as a share of another one.
FEATURES: dict[str, tuple[str, str] | None] = {
    "n_words": None, "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "word_chars"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class Rule:
    """Texts that meet all conditions are bad; the counts are those of the pruning part."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def feature(name: str) -> Column:
    parts = FEATURES[name]
    return F.col(name).cast("double") if parts is None else _share(*parts)


def verdict(rules: list[Rule]) -> Column:
    """True (keep) unless a rule of the list fires."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def _counts(rows: DataFrame, names: list[str]) -> dict[tuple[str, int, int, int], int]:
    """Rows by statistic, interval, label and part."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"bin_{n}").alias("b")) for n in names]))
    found = rows.select("bad", "part", each.alias("x")).groupBy("x.f", "x.b", "bad", "part").count().collect()
    return {(r[0], r[1], r[2], r[3]): r[4] for r in found}


def _best(counts: dict, names: list[str], cuts: dict[str, list[float]]) -> tuple[float, str, bool, int, list[int]] | None:
    """The condition with the highest gain over the growing part, and its (bad, good) in both parts."""
    def total(f: str, bad: int, part: int, bins) -> int:
        return sum(counts.get((f, b, bad, part), 0) for b in bins)

    best = None
    for f in names:
        everything = range(len(cuts[f]) + 1)
        p0, n0 = (total(f, bad, 0, everything) for bad in (1, 0))
        if not p0:
            continue
        for i in range(len(cuts[f])):  # interval b holds values above b thresholds
            for above in (False, True):
                bins = range(i + 1, len(cuts[f]) + 1) if above else range(i + 1)
                p, n = total(f, 1, 0, bins), total(f, 0, 0, bins)
                if p < LEAST_COVERED:
                    continue
                gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, above, i, [p, n, total(f, 1, 1, bins), total(f, 0, 1, bins)])
    return best


def learn(labelled: DataFrame) -> list[Rule]:
    """A decision list from rows of statistics with ``bad`` (1 or 0)."""
    names = list(FEATURES)
    values = staged(labelled.where("bad is not null").select(
        F.col("bad").cast("int").alias("bad"), F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, 1).otherwise(0).alias("part"),
        *[feature(n).alias(n) for n in names]))
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    found = values.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).first()
    marks = {n: sorted(set(found[n] or [])) for n in names}
    cuts = {n: [(a + b) / 2 for a, b in zip(marks[n], marks[n][1:])] for n in names}  # between two met values, nearest to neither
    binned = staged(values.select("bad", "part", *[
        sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).cast("int").alias(f"bin_{n}") for n in names]))

    def meets(c: tuple[str, bool, int]) -> Column:
        return F.col(f"bin_{c[0]}") > c[2] if c[1] else F.col(f"bin_{c[0]}") <= c[2]

    def all_of(conditions: list) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & meets(c)
        return out

    rules: list[Rule] = []
    rest = binned
    while len(rules) < MAX_RULES:
        grown, seen = [], []
        while len(grown) < MAX_CONDITIONS:
            best = _best(_counts(rest.where(all_of(grown)), names), names, cuts)
            if best is None:
                break
            grown.append(best[1:4])
            seen.append(best[4])
            if best[4][1] == 0:
                break
        worth = [(s[2] - s[3]) / max(1, s[2] + s[3]) for s in seen]
        while len(grown) > 1 and worth[len(grown) - 2] >= worth[len(grown) - 1]:
            grown.pop()
        if not grown:
            break
        p, n, bad, good = seen[len(grown) - 1]
        if bad + good == 0 or bad / (bad + good) < PRECISION or p / (p + n) < PRECISION:
            break
        rules.append(Rule(tuple(Condition(f, above, cuts[f][i]) for f, above, i in grown), bad, good))
        rest = rest.where(~all_of(grown))
    return rules


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    rules = learn(stats.where(~base_failed()).join(labels, "doc_id"))
    return judged(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
