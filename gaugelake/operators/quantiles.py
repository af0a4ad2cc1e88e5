"""Exact quantiles: of columns by brackets from a mergeable rank sketch, and of value counts
with the ranking spread over value slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.session import stage

# Values are cut into BRANCH * BRANCH slices; a value finds its slice in two short searches.
BRANCH = 32
# A rank from the sketch is off by one in so many rows at most.
ACCURACY = 20_000


def value_counts(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """(column_name, value, row_count), nulls included, combined map-side per value."""
    typed = df.select(*[F.col(c).cast(kind).alias(c) for c in columns])
    return (
        typed.unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Continuous quantiles of numeric columns, nulls left out: ``column_name, prob, quantile``.

    Two passes over ``df``, neither of which shuffles its values. The first is one aggregate of
    rank sketches, which merge map-side; each wanted rank gets a bracket of two values around it.
    The second counts, per column, what falls between brackets as a number and only what falls
    inside by value. If a rank lies outside its bracket after all, its column's brackets are
    widened and counted again, so the answer does not depend on the sketch. The driver sees a
    few numbers per column and probability.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    slack, done, open_columns = 2.0 / accuracy, [], columns
    while open_columns:
        at = sorted({min(max(p + side * slack, 0.0), 1.0) for p in probs for side in (-1, 1)} | {0.0, 1.0})
        wanted = F.array(*[F.lit(p) for p in at])
        sketches = typed.agg(*[F.percentile_approx(c, wanted, accuracy).alias(c) for c in open_columns]).first()
        # A column of nulls alone has no brackets and no quantiles.
        ends = {0.0: float("-inf"), 1.0: float("inf")}
        brackets = {
            c: _brackets(dict(zip(at, sketches[c], strict=True)) | ends, probs, slack) for c in open_columns if sketches[c] is not None
        }
        if not brackets:
            break
        counts = stage(_bracket_counts(typed, brackets), "brackets")
        totals = {(r[0], r[1]): r[2] for r in counts.groupBy("column_name", "gap").agg(F.sum("n")).collect()}
        ranks, open_columns = [], []
        for c, found in brackets.items():
            before = [0]
            for gap in range(2 * len(found) + 1):
                before.append(before[-1] + totals.get((c, gap), 0))
            mine = []
            for p in probs:
                position = p * (before[-1] - 1)
                for rank in {int(position), -int(-position // 1)}:
                    gap = next(g for g in range(2 * len(found) + 1) if before[g] <= rank < before[g + 1])
                    mine.append((c, gap, before[gap], p, position, rank))
            if all(gap % 2 for _, gap, *_ in mine):
                ranks += mine
            else:
                open_columns.append(c)
        if ranks:
            done.append(_at_ranks(counts, ranks))
        slack *= 16
    if not done:
        return df.sparkSession.createDataFrame([], "column_name string, prob double, quantile double")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _brackets(values: dict[float, float], probs: list[float], slack: float) -> list[tuple[float, float]]:
    """Disjoint closed ranges of values, ascending, that should hold the wanted ranks."""
    clamp = lambda p: min(max(p, 0.0), 1.0)
    merged: list[tuple[float, float]] = []
    for low, high in sorted((values[clamp(p - slack)], values[clamp(p + slack)]) for p in probs):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def _bracket_counts(typed: DataFrame, brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(column_name, gap, value, n): even gaps lie between brackets, odd ones are brackets."""
    parts = []
    for c, found in brackets.items():
        v, gap = F.col(c), F.lit(2 * len(found))
        for i in range(len(found) - 1, -1, -1):
            low, high = found[i]
            # The last bracket can be open, and then holds NaN too.
            gap = F.when(v < low, 2 * i).when(F.lit(True) if high == float("inf") else v <= high, 2 * i + 1).otherwise(gap)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.when(v.isNotNull(), gap).alias("gap"), v.alias("value")))
    rows = typed.select(F.explode(F.array(*parts)).alias("one")).select("one.*").where("gap is not null")
    inside = F.when(F.col("gap") % 2 == 1, F.col("value")).alias("value")
    return rows.select("column_name", "gap", inside).groupBy("column_name", "gap", "value").agg(F.count(F.lit(1)).alias("n"))


def _at_ranks(counts: DataFrame, ranks: list[tuple]) -> DataFrame:
    """Quantiles from the values of the brackets that hold the wanted ranks."""
    wanted = counts.sparkSession.createDataFrame(
        ranks, "column_name string, gap int, before long, prob double, position double, rank long")
    needed = wanted.select("column_name", "gap", "before").distinct()
    running = W.partitionBy("column_name", "gap").orderBy("value")
    upto = F.col("before") + F.sum("n").over(running)
    # A few rows for each column, whatever the data size.
    placed = counts.join(F.broadcast(needed), ["column_name", "gap"]).select("column_name", "gap", "value", "n", upto.alias("upto"))
    hits = placed.join(F.broadcast(wanted.drop("before")), ["column_name", "gap"]).where("rank >= upto - n and rank < upto")
    ends = hits.groupBy("column_name", "prob", "position").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    part = F.col("position") - F.floor("position")
    return ends.select("column_name", "prob", (F.col("low") + (F.col("high") - F.col("low")) * part).alias("quantile"))


def weighted_quantiles(
    counts: DataFrame, label: str, value: str, weight: str, probs: Sequence[float],
    branch: int = BRANCH,
) -> DataFrame:
    """Continuous quantiles of ``value`` repeated ``weight`` times: ``label, prob, quantile``.

    ``counts`` has one row per label and distinct value and is read twice, so pass a staged
    table when it is costly. An approximate sketch cuts the values into slices of similar
    size; slice totals tell which slices hold the wanted ranks; only those are ranked, each in
    its own task. The answer does not depend on the sketch.

    ``label`` is a report label such as a column name. What is broadcast has one row per label
    (``branch`` squared doubles in all) or one per label and wanted rank, whatever the data size.
    """
    values = counts.where(F.col(value).isNotNull()).select(
        label, F.col(value).cast("double").alias("v"), F.col(weight).alias("w")
    )
    slices = branch * branch
    cut_at = ",".join(f"{i / slices}D" for i in range(1, slices))
    sketch = F.expr(f"percentile_approx(v, array({cut_at}), {slices * 10})")
    cuts = stage(values.groupBy(label).agg(sketch.alias("cuts"), F.sum("w").alias("total")), "cuts")
    # Cut k of the coarse list starts at fine slice k * branch. The two lists are joined one
    # after the other, so a row never carries more than ``branch`` cuts.
    steps = F.array(*[F.lit(i) for i in range(branch)])
    coarse = cuts.select(
        label, "total",
        F.transform(F.slice(steps, 2, branch - 1), lambda i: F.get("cuts", i * branch - 1)).alias("coarse"),
    )
    fine = cuts.select(label, "cuts", F.explode(steps).alias("coarse_no")).select(
        label, "coarse_no",
        F.slice("cuts", F.col("coarse_no") * branch + 1, F.lit(branch - 1)).alias("fine"),
    )

    def below(candidates):
        return F.size(F.filter(candidates, lambda c: c < F.col("v")))

    sliced = (
        values.join(F.broadcast(coarse), label)
        .select(label, "v", "w", "total", below("coarse").alias("coarse_no"))
        .join(F.broadcast(fine), [label, "coarse_no"])
        .select(label, "v", "w", "total",
                (F.col("coarse_no") * branch + below("fine")).alias("slice_no"))
    )
    sliced = stage(sliced, "slices")
    totals = sliced.groupBy(label, "slice_no").agg(
        F.sum("w").alias("slice_total"), F.first("total").alias("total")
    )
    by_slice = W.partitionBy(label).orderBy("slice_no")
    after = F.sum("slice_total").over(by_slice)
    totals = totals.select("*", after.alias("rows_upto")).withColumn(
        "rows_before", F.col("rows_upto") - F.col("slice_total")
    )
    wanted = (
        totals.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("position", F.col("prob") * (F.col("total") - 1))
        .withColumn("rank", F.explode(F.array(F.floor("position"), F.ceil("position"))))
        .distinct()
        .where((F.col("rank") >= F.col("rows_before")) & (F.col("rank") < F.col("rows_upto")))
        .select(label, "slice_no", "rows_before", "prob", "position", "rank")
    )
    needed = wanted.select(label, "slice_no", "rows_before").distinct()
    in_slice = W.partitionBy(label, "slice_no").orderBy("v")
    ranked = (
        sliced.join(F.broadcast(needed), [label, "slice_no"])
        .withColumn("upto", F.col("rows_before") + F.sum("w").over(in_slice))
        .select(label, "slice_no", "v", (F.col("upto") - F.col("w")).alias("from_rank"), "upto")
    )
    hits = ranked.join(F.broadcast(wanted), [label, "slice_no"]).where(
        (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("upto"))
    )
    ends = hits.groupBy(label, "prob", "position").agg(
        F.min("v").alias("low"), F.max("v").alias("high")
    )
    part = F.col("position") - F.floor("position")
    return ends.select(
        label, "prob", (F.col("low") + (F.col("high") - F.col("low")) * part).alias("quantile")
    )


def weighted_medians(
    counts: DataFrame, groups: Sequence[str], value: str, weight: str
) -> DataFrame:
    """Exact median per group: ``groups, median``.

    For many groups that each hold few distinct values, such as interval lengths of one day.
    The running total streams over sorted values, so a group is never held in memory.
    """
    groups = list(groups)
    running = W.partitionBy(*groups).orderBy(value)
    whole = W.partitionBy(*groups)
    ranked = counts.where(F.col(value).isNotNull()).select(
        *groups,
        F.col(value).cast("double").alias("v"),
        F.sum(weight).over(running).alias("upto"),
        F.col(weight).alias("w"),
        F.sum(weight).over(whole).alias("total"),
    )
    middle = (F.col("total") - 1) / 2

    def holds(rank):
        return (rank >= F.col("upto") - F.col("w")) & (rank < F.col("upto"))

    return ranked.groupBy(*groups).agg(
        (
            (F.max(F.when(holds(F.floor(middle)), F.col("v")))
             + F.max(F.when(holds(F.ceil(middle)), F.col("v")))) / 2
        ).alias("median")
    )
