"""Exact quantiles and running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import nan_to_null
from tessella.sources.staging import cut_lineage

#: Rows up to which one aggregation holds a column's values.
DIRECT = 1_000_000
#: The sketch's relative rank error is at most one over this.
ACCURACY = 20_000


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], *, direct: int = DIRECT) -> dict[str, list[float] | None]:
    """The exact linear quantiles of each (column, shares) over its values, null and NaN left out; None without values.

    Beyond `direct` rows, a sketch first gives bounds around each rank that hold it for certain; a second pass counts
    what lies below the bounds and a third sorts only what lies between, a few ten-thousandths of the rows a quantile.
    """
    clean = {k: nan_to_null(x.cast("double")) for k, (x, _) in wanted.items()}
    sizes = df.agg(*[F.count(x).alias(k) for k, x in clean.items()]).first()
    if max(sizes) <= direct:
        row = df.agg(*[F.percentile(clean[k], F.array(*map(F.lit, map(float, ps)))).alias(k) for k, (_, ps) in wanted.items()]).first()
        return {k: None if row[k] is None else list(row[k]) for k in wanted}
    rows = df.select(*[x.alias(k) for k, x in clean.items()])
    margin = {k: 3 / ACCURACY + 3 / max(1, sizes[k]) for k in wanted}
    around = {k: sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-margin[k], margin[k])}) for k, (_, ps) in wanted.items()}
    sketch = rows.agg(*[F.percentile_approx(F.col(k), list(v), ACCURACY).alias(k) for k, v in around.items()], *[F.min(k).alias(f"{k}:lo") for k in wanted], *[F.max(k).alias(f"{k}:hi") for k in wanted]).first()
    marks = {}
    for k, (_, ps) in wanted.items():
        if sketch[k] is not None:
            at = dict(zip(around[k], sketch[k], strict=True))
            for p in dict.fromkeys(ps):
                low, high = max(0.0, p - margin[k]), min(1.0, p + margin[k])
                marks[k, p] = (sketch[f"{k}:lo"] if low == 0 else at[low], sketch[f"{k}:hi"] if high == 1 else at[high])
    counts = [F.count(F.col(k)).alias(f"{k}:n") for k in wanted]
    counts += [F.count_if(F.col(k) < a).alias(f"{k}:{p}:below") for (k, p), (a, _) in marks.items()]
    counts += [F.count_if((F.col(k) >= a) & (F.col(k) <= b)).alias(f"{k}:{p}:in") for (k, p), (a, b) in marks.items()]
    found = rows.agg(*counts).first()
    picks = []
    for (k, p), (a, b) in marks.items():
        inside, rank = found[f"{k}:{p}:in"], p * (found[f"{k}:n"] - 1) - found[f"{k}:{p}:below"]
        share = min(1.0, max(0.0, rank / (inside - 1))) if inside > 1 else 0.0
        picks.append(F.percentile(F.when((F.col(k) >= a) & (F.col(k) <= b), F.col(k)), F.lit(share)).alias(f"{k}:{p}"))
    last = rows.agg(*picks).first() if picks else {}
    return {k: None if sketch[k] is None else [last[f"{k}:{p}"] for p in ps] for k, (_, ps) in wanted.items()}


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str, *, descending: bool = False, direct: int = DIRECT) -> DataFrame:
    """df (one row a distinct `order` within `by`) with the running sum of value, itself included.

    Beyond `direct` rows they are dealt by ranges of (by, order); each range is summed, the few sums of the ranges
    before are joined to it, and only a range is sorted in one task.
    """
    step = F.col(order).desc() if descending else F.col(order).asc()
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    staged = cut_lineage(df)
    if staged.count() <= direct:
        return staged.withColumn(out, F.sum(value).over(upto(*by)))
    parts = cut_lineage(staged.repartitionByRange(*[F.col(c) for c in by], step).withColumn("__range", F.spark_partition_id()))
    sums = parts.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return parts.join(sums, [*by, "__range"]).withColumn(out, F.col("__before") + F.sum(value).over(upto(*by, "__range"))).drop("__range", "__before")


def group_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], *, direct: int = DIRECT) -> DataFrame:
    """(by..., a column a share): exact linear quantiles of each group, by counting distinct values; null and NaN are left out."""
    rows = df.select(*by, nan_to_null(F.col(value).cast("double")).alias("__v")).filter("__v IS NOT NULL")
    counts = running_total(rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")), by, "__v", "__n", "__upto", direct=direct)
    x = counts.join(counts.groupBy(*by).agg(F.sum("__n").alias("__all")), by)
    out = []
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("__all") - 1)
        at = lambda r: F.max(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__n") <= r), F.col("__v")))
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        out.append((low + (high - low) * F.first(rank - F.floor(rank))).alias(name))
    return x.groupBy(*by).agg(*out)
