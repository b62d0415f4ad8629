"""Agreement of two labelings: cross-tabs and pair-counting scores, all from one contingency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared(a: DataFrame, b: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """(id, a_id, b_id) over ids that both label sets (id, code) have."""
    return a.select(id_col, F.col("code").cast("long").alias("a_id")).join(b.select(id_col, F.col("code").cast("long").alias("b_id")), id_col)


def contingency(pairs: DataFrame, *, normalize: bool = False) -> DataFrame:
    """Counts of (a_id, b_id), unassigned (-1) kept; with normalize the share of all."""
    out = pairs.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy())) if normalize else out


def alluvial(pairs: DataFrame) -> DataFrame:
    return contingency(pairs).select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), F.col("n").alias("value"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def agreement(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ari, nmi, fmi, jaccard, n, n_a_assigned, n_b_assigned and coverage of contingencies (by..., a_id, b_id, n).

    One row a group of `by`, a single row without. Margins come from the contingency, so only class counts are
    shuffled after the first aggregation.
    """
    if not by:
        return agreement(table.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    both = table.filter("a_id >= 0 AND b_id >= 0")
    pair = lambda x: x * (x - 1) / 2
    n = F.col("n").cast("double")
    cells = both.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(pair(n)).alias("s"), F.sum(_xlogx(n)).alias("hab"), F.count(F.lit(1)).alias("n_cells"))

    def margin(side: str) -> DataFrame:
        m = F.col("m").cast("double")
        return (
            both.groupBy(*by, f"{side}_id").agg(F.sum("n").alias("m")).groupBy(*by)
            .agg(F.sum(pair(m)).alias(f"p{side}"), F.sum(_xlogx(m)).alias(f"h{side}"), F.count(F.lit(1)).alias(f"k{side}"))
        )

    assigned = table.groupBy(*by).agg(
        F.sum(F.when(F.col("a_id") >= 0, F.col("n")).otherwise(0)).alias("n_a_assigned"),
        F.sum(F.when(F.col("b_id") >= 0, F.col("n")).otherwise(0)).alias("n_b_assigned"),
        F.sum(F.when((F.col("a_id") >= 0) | (F.col("b_id") >= 0), F.col("n")).otherwise(0)).alias("n_any"),
    )
    t = cells.join(margin("a"), by).join(margin("b"), by).join(assigned, by)
    total = pair(F.col("n").cast("double"))
    expected = F.when(total > 0, F.col("pa") * F.col("pb") / total).otherwise(0.0)
    top = (F.col("pa") + F.col("pb")) / 2 - expected
    logn = F.log(F.col("n").cast("double"))
    ha, hb = logn - F.col("ha") / F.col("n"), logn - F.col("hb") / F.col("n")
    mi = logn + (F.col("hab") - F.col("ha") - F.col("hb")) / F.col("n")
    return t.select(
        *by,
        F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("s") - expected) / top).alias("ari"),
        F.when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0).when(ha + hb < 1e-15, 0.0).otherwise(F.greatest(F.lit(0.0), mi) / ((ha + hb) / 2)).alias("nmi"),
        F.when(F.col("s") == 0, 0.0).otherwise(F.col("s") / F.sqrt(F.col("pa") * F.col("pb"))).alias("fmi"),
        F.when(F.col("pa") + F.col("pb") - F.col("s") == 0, 0.0).otherwise(F.col("s") / (F.col("pa") + F.col("pb") - F.col("s"))).alias("jaccard"),
        "n",
        "n_a_assigned",
        "n_b_assigned",
        (F.col("n") / F.col("n_any")).alias("coverage"),
    )


def compare_many(labels: DataFrame, id_col: str = "cell_id", *, metric: str = "ari") -> DataFrame:
    """Long matrix (a, b, value) of one metric over label sets stacked as (id, name, code), each pair of names once a < b and mirrored; diagonal 1.

    The pairs of names are made from the counts of one self-join by id: a cell has one row a label set.
    """
    left = labels.select(id_col, F.col("name").alias("a"), F.col("code").alias("a_id"))
    right = labels.select(id_col, F.col("name").alias("b"), F.col("code").alias("b_id"))
    table = left.join(right, id_col).filter("a < b").groupBy("a", "b", "a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    scores = agreement(table, ["a", "b"]).select("a", "b", F.col(metric).cast("double").alias("value"))
    own = labels.groupBy("name").agg(F.sum((F.col("code") >= 0).cast("double")).alias("n"))
    diagonal = own.select(F.col("name").alias("a"), F.col("name").alias("b"), (F.col("n") if metric == "n" else F.lit(1.0)).alias("value"))
    return scores.union(scores.select("b", "a", "value")).union(diagonal)


def adjusted_mutual_information(table: list[tuple[int, int, int]]) -> float:
    """AMI of a contingency [(a, b, n)] (class counts, on the driver); NaN when it is empty."""
    a: dict[int, int] = {}
    b: dict[int, int] = {}
    for i, j, n in table:
        a[i], b[j] = a.get(i, 0) + n, b.get(j, 0) + n
    total = sum(a.values())
    if not total:
        return math.nan
    if len(a) == len(b) == 1:
        return 1.0
    mi = sum(n / total * math.log(total * n / (a[i] * b[j])) for i, j, n in table if n)
    h = [-sum(x / total * math.log(x / total) for x in side.values()) for side in (a, b)]
    lg = math.lgamma
    expected = 0.0
    for x in a.values():
        for y in b.values():
            fixed = lg(x + 1) + lg(y + 1) + lg(total - x + 1) + lg(total - y + 1) - lg(total + 1)
            for n in range(max(1, x + y - total), min(x, y) + 1):
                weight = math.exp(fixed - lg(n + 1) - lg(x - n + 1) - lg(y - n + 1) - lg(total - x - y + n + 1))
                expected += n / total * math.log(total * n / (x * y)) * weight
    bottom = sum(h) / 2 - expected
    return 1.0 if abs(bottom) < 1e-15 else (mi - expected) / bottom
