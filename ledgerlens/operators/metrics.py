"""Operational aggregates over the output tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

# Fixed value: the latency objective in milliseconds.
OBJECTIVE_MS = 500
OBJECTIVE_SHARE = 0.999


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts per key: assessments by status, identity outcomes, deliveries by status."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latency_p95(df: DataFrame, time: str, value: str, minutes: int = 5) -> DataFrame:
    """Approximate p95 per time bucket, from mergeable sketches (what a dashboard shows)."""
    return df.groupBy(F.window(time, f"{minutes} minutes").alias("w")).agg(
        F.percentile_approx(value, 0.95, 10_000).alias("p95")).select(F.col("w.start").alias("bucket"), "p95")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float],
                    *, cell: float = 0.0, accuracy: int = 10_000, cells: int = 500, limit: int = 100_000) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without gathering a group.

    A mergeable sketch says between which two values a wanted rank lies; counting what is below and inside makes that exact.  A bracket
    with more than ``limit`` rows is sketched again, on its own rows, until it is small enough to be ordered (or no wider than ``cell``).
    So every pass is a combined aggregate of a row per key, and what is shuffled and ordered is a few rows of each bracket.
    NULL values do not count; a key with no others has no row.
    """
    if accuracy < 2 * cells:
        raise ValueError("the sketch must be finer than the cells")
    keys, names, grid = list(keys), list(quantiles), [i / cells for i in range(cells + 1)]
    limit = max(limit, 8 * cells)  # so that neighbouring edges are some rows apart
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))

    def edges(inside: Column) -> Column:
        v = F.when(inside, F.col("__v"))
        return F.concat(F.array(F.min(v)), F.slice(F.percentile_approx(v, grid, accuracy), 2, cells - 1), F.array(F.max(v)))

    def bracket(found: Column, share: Column) -> tuple[Column, Column]:
        """Two edges around a share of the rows, one further out on each side than the sketch may err."""
        at = share * cells
        return F.get(found, F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")), F.get(found, F.least(F.ceil(at) + 1, F.lit(cells)).cast("int"))

    def position(j: int) -> Column:
        return (F.col("__total") - 1) * F.lit(quantiles[names[j]])

    def met(brackets: DataFrame) -> DataFrame:
        if not keys:
            return rows.crossJoin(brackets)  # one row
        right = brackets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in brackets.columns if c not in keys])
        on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        return rows.join(right, on).drop(*[f"__k{i}" for i in range(len(keys))])

    def inside(j: int) -> Column:
        return F.col("__v").between(F.col(f"__a{j}"), F.col(f"__b{j}"))

    numbers = range(len(names))
    first = materialize(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__total"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), edges(F.lit(True)).alias("__e")))
    small = F.col("__total") <= limit
    brackets = first.select(*keys, "__total", "__min", "__max", *[
        F.when(small, F.col(whole)).otherwise(c).alias(f"__{x}{j}") for j in numbers
        for x, whole, c in zip("ab", ("__min", "__max"), bracket(F.col("__e"), position(j) / F.greatest("__total", F.lit(1))))])
    while True:
        kept = [F.first(c).alias(c) for c in brackets.columns if c not in keys]
        counted = materialize(met(brackets).groupBy(*keys).agg(*kept, *[c.alias(f"__{x}{j}") for j in numbers for x, c in (
            ("below", F.count_if(F.col("__v") < F.col(f"__a{j}"))), ("inside", F.count_if(inside(j))))]))

        def wide(j: int) -> Column:
            everything = (F.col(f"__a{j}") == F.col("__min")) & (F.col(f"__b{j}") == F.col("__max"))
            return (F.col(f"__inside{j}") > limit) & (F.col(f"__b{j}") - F.col(f"__a{j}") > cell) & ~everything

        def missed(j: int) -> Column:
            """The sketch was further off than it says: then all values are looked at."""
            return (F.floor(position(j)) < F.col(f"__below{j}")) | (F.ceil(position(j)) >= F.col(f"__below{j}") + F.col(f"__inside{j}"))

        if counted.filter(reduce(or_, [wide(j) | missed(j) for j in numbers])).isEmpty():
            break
        finer = met(counted).groupBy(*keys).agg(
            *[F.first(c).alias(c) for c in counted.columns if c not in keys], *[edges(inside(j) & wide(j)).alias(f"__e{j}") for j in numbers])
        columns = []
        for j in numbers:
            low, high = bracket(F.col(f"__e{j}"), (position(j) - F.col(f"__below{j}")) / F.col(f"__inside{j}"))
            narrower = wide(j) & ((low > F.col(f"__a{j}")) | (high < F.col(f"__b{j}")))
            columns += [F.when(missed(j), F.col(whole)).when(narrower, new).otherwise(F.col(f"__{x}{j}")).alias(f"__{x}{j}")
                        for x, whole, new in (("a", "__min", low), ("b", "__max", high))]
        narrowed = materialize(finer.select(*keys, "__total", "__min", "__max", *columns))
        same = narrowed.join(brackets, [narrowed[c].eqNullSafe(brackets[c]) for c in brackets.columns], "left_anti").isEmpty()
        brackets = narrowed
        if same:  # only values that are met very often are left
            break

    each = F.array(*[F.struct(F.lit(name).alias("__name"), F.col(f"__below{j}").alias("__below"), position(j).alias("__pos"), inside(j).alias("__in"))
                     for j, name in enumerate(names)])
    chosen = met(counted).select(*keys, "__v", F.inline(each)).filter("__in")
    values = chosen.groupBy(*keys, "__name", "__v").agg(F.count(F.lit(1)).alias("__n"), F.first("__below").alias("__below"), F.first("__pos").alias("__pos"))
    up = Window.partitionBy(*keys, "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("__from", F.col("__below") + F.coalesce(F.sum("__n").over(up), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__from") + F.col("__n")), F.col("__v")))

    found = placed.groupBy(*keys, "__name").agg(at(F.floor("__pos")).alias("__lo"), at(F.ceil("__pos")).alias("__hi"), F.first("__pos").alias("__pos"))
    share = F.col("__pos") - F.floor("__pos")
    exact = found.withColumn("__q", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * share)
    return exact.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in names])


def latency_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """p50, p95, p99, p99.9, maximum and the share within the objective."""
    quantiles = exact_quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})
    rest = df.groupBy(*keys).agg(
        F.max(value).cast("double").alias("maximum"),
        (F.avg(F.when(F.col(value) <= OBJECTIVE_MS, 1.0).otherwise(0.0)) * 100).alias("within_objective_percent"))
    return quantiles.join(rest, list(keys))


def throughput(df: DataFrame, keys: Sequence[str], sent_us: str, seen_us: str, target: float) -> DataFrame:
    """Events per second between the first send and the last output, and the target flag."""
    seconds = (F.max(seen_us) - F.min(sent_us)) / F.lit(1_000_000)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), (F.count(F.lit(1)) / seconds).alias("per_second"),
    ).withColumn("target_met", F.col("per_second") >= target)


def latency_target(df: DataFrame, keys: Sequence[str], assessment_ms: str, alert_ms: str, share: float = OBJECTIVE_SHARE) -> DataFrame:
    """Whether assessments and alerts are each within the objective as often as the target asks.

    NULL latencies are outputs that never came.  Without any assessment nothing was measured and the target is not met;
    alerts only have to keep it if there were any.
    """
    def share_of(column: str) -> Column:
        return F.try_divide(F.count_if(F.col(column) <= OBJECTIVE_MS), F.count(column))

    met = F.coalesce(share_of(assessment_ms) >= share, F.lit(False)) & F.coalesce(share_of(alert_ms) >= share, F.lit(True))
    return df.groupBy(*keys).agg(met.alias("latency_target_met"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reconcile(sent: DataFrame, assessments: DataFrame, alerts: DataFrame) -> DataFrame:
    """Six failure counts between inputs, assessments and alerts, as one row.

    Every side is first reduced to one row per event, so each join is one to one.
    """
    inputs = sent.select("eventId").distinct().withColumn("in_input", F.lit(True))
    assessed = assessments.groupBy("eventId").agg(
        F.count(F.lit(1)).alias("a_n"), F.max(F.col("status") == "SUSPICIOUS").alias("suspicious"))
    alerted = alerts.groupBy("eventId").agg(F.count(F.lit(1)).alias("l_n"))
    joined = inputs.join(assessed, "eventId", "full_outer").join(alerted, "eventId", "full_outer")
    has_input, has_a, has_l = (F.col(c).isNotNull() for c in ("in_input", "a_n", "l_n"))
    expected = F.coalesce("suspicious", F.lit(False))
    return joined.agg(
        F.count_if(has_input).alias("inputs"),
        F.count_if(has_a).alias("assessments"),
        F.count_if(has_l).alias("alerts"),
        F.count_if(has_input & ~has_a).alias("missing_assessments"),
        F.count_if(has_a & ~has_input).alias("unexpected_assessments"),
        F.count_if(F.coalesce(F.col("a_n") > 1, F.lit(False))).alias("duplicate_assessments"),
        F.count_if(expected & ~has_l).alias("missing_alerts"),
        F.count_if(has_l & ~expected).alias("unexpected_alerts"),
        F.count_if(F.coalesce(F.col("l_n") > 1, F.lit(False))).alias("duplicate_alerts"),
    )


class IntegrityError(RuntimeError):
    """Inputs and outputs do not reconcile."""


def assert_reconciled(counts: DataFrame) -> None:
    """Stops with the row of ``reconcile`` if any of its failure counts is not zero."""
    row = counts.first().asDict()
    wrong = {name: n for name, n in row.items() if n and name.split("_")[0] in ("missing", "unexpected", "duplicate")}
    if wrong:
        raise IntegrityError(f"outputs do not reconcile: {wrong}")


def rollout(desired: DataFrame, published: DataFrame, loaded: DataFrame, key: str = "head_key") -> DataFrame:
    """Desired, published and loaded version per head, and how far loading lags."""
    def top(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.max("version").alias(name))

    out = top(desired, "desired_version").join(top(published, "published_version"), key, "full_outer") \
        .join(top(loaded, "loaded_version"), key, "full_outer").na.fill(
            0, ["desired_version", "published_version", "loaded_version"])
    return out.withColumn("lag", F.col("desired_version") - F.col("loaded_version"))


def false_positive_rate(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Share of alerts per rule that investigators labelled LEGITIMATE."""
    judged = alerts.join(feedback.select("alertId", "assessmentId", "label"), ["alertId", "assessmentId"])
    return judged.select("label", F.explode("matchedRules").alias("r")).groupBy(F.col("r.ruleId").alias("ruleId")).agg(
        F.count(F.lit(1)).alias("judged"), F.count_if(F.col("label") == "LEGITIMATE").alias("legitimate"),
    ).withColumn("false_positive_rate", F.col("legitimate") / F.col("judged"))
