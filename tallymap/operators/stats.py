"""Descriptive statistics over source rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymap.functions.columns import record_weight
from tallymap.operators.topk import top_k
from tallymap.sources.scratch import stage
from tallymap.spec import Fact

_BUCKETS = 4096
#: Cut points of the distinct values, so that an extreme value does not put all others into one range.
_CUTS = 64


#: What a row of the report's fold stands for, besides a measure.
_RECORDS, _PAIRS = "#records", "#correlation"


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value occurs in each column: (measure, value, n), NULLs left out."""
    tall = df.unpivot([], list(columns), "measure", "value").filter(F.col("value").isNotNull())
    return tall.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))


def _pick(rank: Column) -> Column:
    """Value whose run of equal values covers a 0-based rank."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))


def _moments(counts: DataFrame) -> DataFrame:
    amount = F.col("value").cast("double") * F.col("n")  # a common value times its count can leave BIGINT
    return counts.groupBy("measure").agg(
        F.sum("n").alias("rows"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(amount) / F.sum("n")).alias("mean"),
    )


def _placed(counts: DataFrame) -> DataFrame:
    """Value counts with the moments of their measure and the range, in order of values, they are in."""
    width = (F.col("max") - F.col("min")) / _BUCKETS
    position = F.floor((F.col("value") - F.col("min")) / F.nullif(width, F.lit(0)))
    equal = F.least(F.coalesce(position, F.lit(0)), F.lit(_BUCKETS - 1))
    part = F.size(F.filter("cuts", lambda c: c <= F.col("value")))
    points = [i / _CUTS for i in range(1, _CUTS)]
    cuts = counts.groupBy("measure").agg(F.percentile_approx("value", points, 10_000).alias("cuts"))
    # One row per measure, and two per probability: bounded whatever the data.
    known = _moments(counts).join(F.broadcast(cuts), "measure")
    return counts.join(F.broadcast(known), "measure").withColumn("bucket", part * _BUCKETS + equal).drop("cuts")


def describe_counts(counts: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Moments and exact, linearly interpolated quantiles from value counts.

    Running counts are built in two steps, over value ranges (64 of about as many
    distinct values each, cut again by 4096 equal widths) per measure and then inside the ranges that hold a wanted rank, so no task ever
    sorts all values of a measure.
    """
    span = W.partitionBy("measure")
    placed = _placed(counts)
    off = F.col("value") - F.col("mean")
    ranges = placed.groupBy("measure", "bucket").agg(
        F.sum("n").alias("size"),
        F.sum(off * off * F.col("n")).alias("squares"),
        *[F.max(c).alias(c) for c in ("rows", "min", "max", "mean")],
    )
    before = F.sum("size").over(span.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.withColumns(
        {
            "start": F.coalesce(before, F.lit(0)),
            "std": F.sqrt(F.sum("squares").over(span) / F.nullif(F.col("rows") - 1, F.lit(0))),
        }
    )
    ranks = {}
    for name, p in probabilities.items():
        exact = (F.col("rows") - 1) * F.lit(float(p))
        ranks[name] = (F.floor(exact), F.ceil(exact), exact - F.floor(exact))
    wanted = reduce(
        or_,
        [
            (F.col("start") <= r) & (r < F.col("start") + F.col("size"))
            for low, high, _ in ranks.values()
            for r in (low, high)
        ],
    )
    inside = W.partitionBy("measure", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    chosen = ranges.filter(wanted).select("measure", "bucket", "start", "std")
    running = placed.join(F.broadcast(chosen), ["measure", "bucket"]).withColumn(
        "before", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    kept = ["mean", "std", "min", "max"]
    ends = running.groupBy("measure").agg(
        *[F.max(c).alias(c) for c in kept],
        *[_pick(low).alias(f"{n}_low") for n, (low, _, _) in ranks.items()],
        *[_pick(high).alias(f"{n}_high") for n, (_, high, _) in ranks.items()],
        *[F.max(part).alias(f"{n}_part") for n, (_, _, part) in ranks.items()],
    )

    def between(n: str) -> Column:
        low, high = F.col(f"{n}_low"), F.col(f"{n}_high")
        return (low + (high - low) * F.col(f"{n}_part")).cast("double").alias(n)

    return ends.select("measure", *kept, *[between(n) for n in probabilities])


def describe_measures(fact: Fact) -> DataFrame:
    """Mean, median, sample deviation, extremes and quartiles of each measure over source rows.

    The rows are read once and folded into value counts before anything else.
    """
    counts = value_counts(fact.df, fact.spec.measures)
    return describe_counts(counts, {"median": 0.5, "q1": 0.25, "q3": 0.75})


def refined_describe(
    counts: DataFrame, probabilities: dict[str, float], most: int = _BUCKETS
) -> DataFrame:
    """As ``describe_counts``, with a bound on every task: no window holds more than ``most`` rows.

    The range that holds a wanted rank is cut into ``most`` equal widths between its smallest and largest value, again
    and again, until the part with the rank is one value.  A pass divides widths by ``most``, so an
    extreme value costs a pass, whatever share of the other values it pushes together.  What reaches the driver are a
    few numbers for each measure and rank.  Whole-number measures only.  Runs when called.
    """
    spark = counts.sparkSession
    counts = stage(counts.select("measure", F.col("value").cast("bigint").alias("value"), "n"), "value-counts")
    moments = {r.measure: r for r in _moments(counts).collect()}
    off = F.col("value") - F.col("mean")
    means = spark.createDataFrame([(m, r.mean) for m, r in moments.items()], "measure string, mean double")
    spread = counts.join(means, "measure").groupBy("measure").agg(F.sum(off * off * F.col("n")).alias("squares"))
    squares = {r.measure: r.squares for r in spread.collect()}
    wanted = {
        (m, f((r.rows - 1) * p)) for m, r in moments.items() for p in probabilities.values() for f in (math.floor, math.ceil)
    }
    open_ranges = {(m, r.min, r.max, 0) for m, r in moments.items()}
    found: dict[tuple[str, int], int] = {}
    while len(found) < len(wanted):
        open_ranges = _refined(counts, open_ranges, wanted - found.keys(), most, found)
    rows = []
    for m, r in moments.items():
        quantiles = []
        for p in probabilities.values():
            rank = (r.rows - 1) * p
            low, high = found[(m, math.floor(rank))], found[(m, math.ceil(rank))]
            quantiles.append(float(low + (high - low) * (rank - math.floor(rank))))
        std = math.sqrt(squares[m] / (r.rows - 1)) if r.rows > 1 else None
        rows.append((m, r.mean, std, r.min, r.max, *quantiles))
    names = "".join(f", `{n}` double" for n in probabilities)
    return spark.createDataFrame(rows, f"measure string, mean double, std double, min bigint, max bigint{names}")


def _refined(counts: DataFrame, ranges: set, wanted: set, most: int, found: dict) -> set:
    """One pass over (measure, low, high, rows before) ranges: ranks that are met enter ``found``, the
    parts that hold the others are returned."""
    spark = counts.sparkSession
    listed = spark.createDataFrame(sorted(ranges), "measure string, low bigint, high bigint, start bigint")
    # Differences in decimals: a range may be wider than a BIGINT.
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    part = F.floor((wide("value") - wide("low")) * most / (wide("high") - wide("low") + 1)).cast("int")
    # A row for each rank and measure at most, so bounded whatever the data.
    inside = counts.join(F.broadcast(listed), "measure").where(F.col("value").between(F.col("low"), F.col("high")))
    sizes = inside.groupBy("measure", "low", "start", part.alias("part")).agg(
        F.sum("n").alias("size"), F.min("value").alias("from"), F.max("value").alias("to")
    )
    order = W.partitionBy("measure", "low").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    ranks = spark.createDataFrame(sorted(wanted), "measure string, rank bigint")
    held = placed.join(F.broadcast(ranks), "measure").where(
        (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("size"))
    )
    more = set()
    for r in held.select("measure", "rank", "from", "to", "before").collect():
        if r["from"] == r["to"]:
            found[(r["measure"], r["rank"])] = r["from"]
        else:
            more.add((r["measure"], r["from"], r["to"], r["before"]))
    return more


def describe_bounded(fact: Fact, most: int = _BUCKETS) -> DataFrame:
    """``describe_measures`` by ``refined_describe``, for measures with extreme values."""
    counts = value_counts(fact.df, fact.spec.measures)
    return refined_describe(counts, {"median": 0.5, "q1": 0.25, "q3": 0.75}, most)


def pearson(a: str, b: str) -> Column:
    """Correlation over the rows that have both values; NULL, not an error, when one is constant there."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0))


def correlation(fact: Fact) -> DataFrame:
    """Correlation matrix of the measures in long form, one pass; each pair over its complete rows."""
    pairs = list(product(fact.spec.measures, repeat=2))
    row = fact.df.agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))


def report_fold(fact: Fact) -> DataFrame:
    """Value counts of the measures, record counts of the widest level and correlations from one scan.

    Every row is stacked once for each of them and folded by what it stands for: (kind, value, name, n, r0, r1, ...),
    where ``kind`` is a measure or one of two marks.
    """
    measures = list(fact.spec.measures)
    entry = lambda kind, value, name: F.struct(
        F.lit(kind).alias("kind"), value.cast("bigint").alias("value"), name.cast("string").alias("name")
    )
    none = F.lit(None)
    kinds = F.array(
        *[entry(m, F.col(m), none) for m in measures],
        entry(_RECORDS, none, F.col(fact.spec.levels[0])),
        entry(_PAIRS, none, none),
    )
    # A row's values count for correlations where it stands for them only.
    once = {f"__{m}": F.when(F.col("kind") == _PAIRS, F.col(m)) for m in measures}
    tall = fact.df.select(*measures, record_weight(fact.spec).alias("__n"), F.inline(kinds)).withColumns(once)
    pairs = [pearson(f"__{a}", f"__{b}").alias(f"r{i}") for i, (a, b) in enumerate(product(measures, repeat=2))]
    return tall.groupBy("kind", "value", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__n").alias("records"), *pairs
    )


def statistical_report(fact: Fact, k: int = 10) -> DataFrame:
    """Statistics, correlations and record counts of one table in long form.

    The table is read once, when this is called; the report works on its fold.
    """
    measures = list(fact.spec.measures)
    fold = stage(report_fold(fact), "report")
    counts = fold.where(F.col("kind").isin(measures) & F.col("value").isNotNull())
    described = describe_counts(
        counts.select(F.col("kind").alias("measure"), "value", "n"), {"median": 0.5, "q1": 0.25, "q3": 0.75}
    )
    names = [c for c in described.columns if c != "measure"]
    stats = described.select("measure", *[F.col(c).cast("double") for c in names]).unpivot(
        ["measure"], names, "statistic", "value"
    )
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(product(measures, repeat=2))
    ]
    correlated = fold.where(F.col("kind") == _PAIRS).select(F.inline(F.array(*cells)))
    regions = top_k(fold.where((F.col("kind") == _RECORDS) & F.col("name").isNotNull()), "records", k, ["name"])
    parts = [
        stats.select(F.lit("describe").alias("section"), F.col("measure").alias("item"), "statistic", "value"),
        correlated.select(F.lit("correlation"), "a", "b", "r"),
        regions.select(F.lit("distribution"), "name", F.lit("records"), F.col("records").cast("double")),
    ]
    return parts[0].union(parts[1]).union(parts[2])
