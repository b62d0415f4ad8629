"""Reads of a feature table before anything is clustered on it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.quantiles import group_quantiles, percentiles, running_total
from tessella.functions.scalars import is_finite
from tessella.operators.knn import with_codes
from tessella.operators.space import moments
from tessella.sources.staging import cut_lineage


def long(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value) of finite values."""
    made = df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in columns])
    return made.unpivot(keep or [], columns, "feature", "value").filter(is_finite(F.col("value")))


def tie_report(df: DataFrame, columns: list[str]) -> DataFrame:
    per = long(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n"),
        F.max(F.struct(-F.col("value"), "n"))["n"].alias("n_at_min"),
        F.max(F.struct("value", "n"))["n"].alias("n_at_max"),
        F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0)).alias("n_zero"),
    )
    return out.select("feature", "n_distinct", (F.col("n_distinct") / F.col("n")).alias("frac_distinct"), "n_at_min", "n_at_max", "n_zero")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_unique_rows"),
        F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).alias("n_duplicate_rows"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n_duplicate_groups"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_tie_block"),
    )


def clip_comparison(df: DataFrame, columns: list[str], *, lower: float = 0.1, upper: float = 99.9, n_sigma: float = 5.0) -> DataFrame:
    """Cells that a percentile rule and a sigma rule (robust units) would clip."""
    rows = long(df, columns)
    finite = {c: F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    found = percentiles(df, {c: (finite[c], [lower / 100, 0.25, 0.5, 0.75, upper / 100]) for c in columns})
    fit = df.sparkSession.createDataFrame([(c, q) for c, q in found.items() if q is not None], "feature string, q array<double>")
    x = rows.join(F.broadcast(fit), "feature")  # one row a feature
    iqr = F.col("q")[3] - F.col("q")[1]
    sigma = F.abs(F.col("value") - F.col("q")[2]) / F.when(iqr > 0, iqr).otherwise(1.0)
    return x.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(((F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[4])).cast("long")).alias("n_clipped_percentile"),
        F.sum((sigma > n_sigma).cast("long")).alias("n_clipped_sigma"),
        (F.count(F.lit(1)) * F.lit((lower + 100 - upper) / 100)).alias("expected_percentile_cells"),
        F.max(sigma).alias("max_abs_sigma"),
        F.lit(float(n_sigma)).alias("n_sigma"),
        F.lit(n_sigma * 1.34898).alias("n_sigma_gaussian_equivalent"),
    )


def ranked(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Average ranks by counting: values are pre-aggregated, so a frequent value is one row, and running totals go by ranges."""
    counts = running_total(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")), by, value, "__n", "__upto")
    ranks = counts.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return rows.join(ranks, [*by, value])


def covariate_sensitivity(df: DataFrame, columns: list[str], covariate: str, *, min_finite: int = 10) -> DataFrame:
    """Spearman's rho of each feature against a covariate over pairs that are both finite; null below min_finite or for a constant."""
    rows = long(df.withColumn("__c", F.col(covariate).cast("double")).filter(is_finite(F.col("__c"))), columns, ["__c"])
    rows = ranked(ranked(rows, ["feature"], "value", "rx"), ["feature"], "__c", "ry")
    per = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n_finite"), F.corr("rx", "ry").alias("rho"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    fine = (F.col("n_finite") >= min_finite) & (F.col("sx") > 0) & (F.col("sy") > 0)
    rho = F.when(fine, F.col("rho"))

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_spearman_p(a, b) for a, b in zip(r, n, strict=True)])

    return per.select("feature", rho.alias("spearman_rho"), p_value(rho, "n_finite").alias("p_value"), "n_finite")


def _spearman_p(r: float, n: int) -> float | None:
    if r is None or r != r:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + top * d) or 1e-300), (1 + top / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def stratum_shift(df: DataFrame, columns: list[str], stratum: str, reference: str, *, min_cells: int = 20) -> DataFrame:
    """Kolmogorov-Smirnov distance and median shift, in the reference's quartile range, of each stratum against the reference."""
    rows = long(df, columns, [stratum])
    counts = rows.groupBy("feature", stratum, "value").agg(F.count(F.lit(1)).alias("n"))
    quartiles = group_quantiles(rows, ["feature", stratum], "value", {"q0": 0.25, "median": 0.5, "q2": 0.75})
    sizes = cut_lineage(counts.groupBy("feature", stratum).agg(F.sum("n").alias("n_cells")).join(quartiles, ["feature", stratum]))  # one row a feature and stratum
    ref = sizes.filter(F.col(stratum) == reference).select("feature", F.col("n_cells").alias("n_ref"), F.array("q0", "median", "q2").alias("q"))
    sizes = sizes.drop("q0", "q2")
    at = counts.filter(F.col(stratum) == reference).select("feature", "value", F.col("n").alias("m"))
    strata = sizes.filter((F.col(stratum) != reference) & (F.col("n_cells") >= min_cells)).select("feature", stratum)
    mine = counts.join(strata, ["feature", stratum]).select("feature", stratum, "value", "n", F.lit(0).cast("long").alias("m"))
    theirs = at.join(strata, "feature").select("feature", stratum, "value", F.lit(0).cast("long").alias("n"), "m")
    both = mine.union(theirs).groupBy("feature", stratum, "value").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    upto = Window.partitionBy("feature", stratum).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    steps = both.select("feature", stratum, F.sum("n").over(upto).alias("cn"), F.sum("m").over(upto).alias("cm"))
    x = steps.join(sizes, ["feature", stratum]).join(ref, "feature")
    gap = F.abs(F.col("cn") / F.col("n_cells") - F.col("cm") / F.col("n_ref"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return x.groupBy("feature", stratum, "n_cells").agg(
        F.max(gap).alias("ks_statistic"), F.first(F.when(iqr > 0, (F.col("median") - F.col("q")[1]) / iqr)).alias("median_shift_iqr")
    )


def correlation_of(vectors: DataFrame, vec_col: str = "features") -> tuple[int, np.ndarray]:
    """(n, Pearson correlation) of vectors, constants 0 off the diagonal, from one pass."""
    n, s, xx = moments(vectors.select(F.col(vec_col).alias("features")))
    cov = xx / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.where(np.outer(sd, sd) > 1e-300, cov / np.outer(sd, sd), 0.0)
    np.fill_diagonal(corr, 1.0)
    return n, corr


def correlation_blocks(corr: np.ndarray, threshold: float = 0.5, method: str = "average") -> list[np.ndarray]:
    """Features that merge below 1 - |rho| = threshold, as lists of places."""
    from tessella.operators.consensus import cut, linkage

    if len(corr) < 2:
        return [np.arange(len(corr))]
    similarity = np.abs(corr).copy()
    np.fill_diagonal(similarity, 1.0)
    codes = cut(linkage(similarity, method), len(corr), threshold)
    return [np.flatnonzero(codes == c) for c in range(codes.max() + 1)]


def feature_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) of every pair of columns, constants 0, from one pass over the rows."""
    rows = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    n, s, xx = moments(rows)
    cov = xx / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.where(np.outer(sd, sd) > 1e-300, cov / np.outer(sd, sd), 0.0)
    made = [(columns[i], columns[j], float(rho[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(made, "a string, b string, rho double")


def block_weights(corr: np.ndarray, *, method: str = "mfa", n: int | None = None) -> np.ndarray:
    """Weights of one block of features: 1/sigma1 (mfa), 1/sqrt(k) (sqrt_k), or by summed adjusted squared correlation (redundancy)."""
    k = len(corr)
    if method == "mfa":
        return np.full(k, 1 / math.sqrt(np.linalg.eigvalsh(corr)[-1]))
    if method == "sqrt_k":
        return np.full(k, 1 / math.sqrt(k))
    r2 = np.maximum(1 - (1 - corr**2) * (n - 1) / (n - 2), 0)
    np.fill_diagonal(r2, 1.0)
    return np.sqrt(1 / r2.sum(1))


def discriminative_features(df: DataFrame, columns: list[str], code: str = "code") -> DataFrame:
    """One-way F of each feature over its z-scores by cluster, and the clusters that are highest and lowest."""
    rows = long(df.filter(F.col(code) >= 0), columns, [code])
    per = rows.groupBy("feature", code).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    all_rows = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("total"), F.avg("value").alias("grand"), F.stddev_pop("value").alias("sd"))
    x = per.join(all_rows, "feature")
    z = F.when(F.col("sd") > 0, (F.col("m") - F.col("grand")) / F.col("sd")).otherwise(0.0)
    k = F.count(F.lit(1))
    between = F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2) / (k - 1)
    within = F.sum(F.col("n") * F.col("v")) / (F.first("total") - k)
    return x.groupBy("feature").agg(
        F.when(within > 0, between / within).alias("f_stat"),
        F.max(F.struct(z.alias("z"), (-F.col(code)).alias("c"))).alias("hi"),
        F.min(F.struct(z.alias("z"), F.col(code).alias("c"))).alias("lo"),
    ).select("feature", "f_stat", (-F.col("hi.c")).alias("high"), F.col("hi.z").alias("high_z"), F.col("lo.c").alias("low"), F.col("lo.z").alias("low_z"))


def dataset_mixing(edges: DataFrame, cells: DataFrame, *, id_col: str = "cell_id") -> DataFrame:
    """Same-dataset share of neighbours against what the stratum's composition gives: overall, by dataset, by dataset and stratum.

    cells: (id, code, stratum), code being the dataset.
    """
    same = with_codes(edges, cells.select(id_col, "code"), id_col).groupBy("src").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("share"))
    n = Window.partitionBy("stratum")
    sizes = cells.groupBy("stratum", "code").agg(F.count(F.lit(1)).alias("nd"))
    sizes = sizes.withColumn("expected", (F.col("nd") - 1) / (F.sum("nd").over(n) - 1)).drop("nd")
    x = same.join(cells.withColumnRenamed(id_col, "src"), "src").join(sizes, ["stratum", "code"])
    out = x.groupingSets([[], ["code"], ["code", "stratum"]], "code", "stratum").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("share").alias("observed"), F.avg("expected").alias("expected")
    )
    return out.select(F.col("code").alias("dataset"), "stratum", "n_cells", "observed", "expected", (F.col("observed") - F.col("expected")).alias("gap"))


def information_imbalance(a: np.ndarray, b: np.ndarray, k: int = 1) -> tuple[float, float]:
    """2 <rank in the other space of the k nearest> / n, both ways, for a bounded sample of rows."""

    def ranks(x: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(d, -1)
        return d.argsort(1, kind="stable").argsort(1, kind="stable")

    ra, rb = ranks(a), ranks(b)
    one = lambda near, other: 2 * other[(near >= 1) & (near <= k)].mean() / len(a)
    return float(one(ra, rb)), float(one(rb, ra))


def effective_features(corr: np.ndarray, columns: list[str]) -> pd.DataFrame:
    off = np.abs(corr - np.eye(len(corr)))
    share = (corr**2).sum(1)
    return pd.DataFrame({
        "feature": columns, "variance_weight": share / share.sum(), "multiplier": share * len(share) / share.sum(),
        "most_correlated": [columns[i] for i in off.argmax(1)], "max_abs_corr": off.max(1),
    })


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range and distinct count of each numeric column with three values or more."""
    return long(df, columns).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("value").alias("n_distinct")).filter("n_distinct >= 3")


def column_histogram(df: DataFrame, column: str, code: str = "code", bins: int = 40) -> DataFrame:
    """(code, bin, n) on edges that all clusters share."""
    x = F.col(column).cast("double")
    lo, hi = df.filter(is_finite(x)).agg(F.min(x), F.max(x)).first()
    step = F.when(x == hi, bins).otherwise(F.width_bucket(x, F.lit(lo), F.lit(hi if hi > lo else lo + 1), F.lit(bins))) - 1
    return df.filter(is_finite(x)).groupBy(code, step.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _ranks_beside(d: np.ndarray) -> np.ndarray:
    """The place of each row among the neighbours of each other, itself 0."""
    d = d.copy()
    np.fill_diagonal(d, -1)
    order = d.argsort(1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(len(d))[None, :], 1)
    return out


def _one_way(d: np.ndarray, ranks: np.ndarray, k: int) -> float:
    """2 <rank of the k nearest by d> / n."""
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :k]
    return float(2 * np.take_along_axis(ranks, near, 1).mean() / len(d))


def feature_relevance(df: DataFrame, columns: list[str], *, mode: str = "single", k: int = 1, standardize: bool = True, id_col: str = "cell_id", most: int = 4000, seed: int = 0) -> pd.DataFrame:
    """How well each feature alone stands for the space of all (single), or what the space loses without it (drop_one).

    The measure ranks all pairs of rows, so it reads at most `most` rows (a parameter), those of least seeded hash.
    """
    if mode not in ("single", "drop_one") or len(columns) < 2:
        raise ValueError("mode is single or drop_one, and there are two features at least")
    rows = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(most).toPandas().sort_values(id_col)
    x = rows[columns].to_numpy()
    if len(x) <= k + 1:
        raise ValueError("too few rows")
    if standardize:
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
    single = lambda j: (x[:, j, None] - x[None, :, j]) ** 2
    full = sum(single(j) for j in range(len(columns)))
    ranks = _ranks_beside(full)
    if mode == "single":
        made = [(c, _one_way(single(j), ranks, k), _one_way(full, _ranks_beside(single(j)), k)) for j, c in enumerate(columns)]
        return pd.DataFrame(made, columns=["feature", "delta_to_full", "delta_from_full"]).sort_values(["delta_to_full", "feature"], ignore_index=True)
    made = [(c, _one_way(np.maximum(full - single(j), 0), ranks, k)) for j, c in enumerate(columns)]
    return pd.DataFrame(made, columns=["feature", "delta_without"]).sort_values(["delta_without", "feature"], ascending=[False, True], ignore_index=True)


def feature_scatter(rows: DataFrame, codes: DataFrame, feature: str, against: str) -> DataFrame:
    """(cell_id, feature, against, code) of cells in which both are finite."""
    x, y = F.col(feature).cast("double"), F.col(against).cast("double")
    return rows.filter(is_finite(x) & is_finite(y)).select("cell_id", x.alias("feature"), y.alias("against")).join(codes, "cell_id", "left").fillna(-1, ["code"])


def column_profile(rows: DataFrame, column: str, code: str = "code", bins: int = 40) -> DataFrame:
    """(code, bin, n, q25, q50, q75): a histogram of each cluster on shared edges, beside its quartiles."""
    x = F.col(column).cast("double")
    fine = rows.filter(is_finite(x))
    quartiles = group_quantiles(fine, [code], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return column_histogram(rows, column, code, bins).join(quartiles, code).select(code, "bin", "n", "q25", "q50", "q75")


def cluster_heatmap(df: DataFrame, columns: list[str], code: str = "code", *, top: int = 40) -> DataFrame:
    """(feature, place, code, mean_z) of the `top` features by their one-way F, over z-scores of the clustered cells."""
    rows = long(df.filter(F.col(code) >= 0), columns, [code])
    scored = discriminative_features(df, columns, code).select("feature", F.coalesce("f_stat", F.lit(0.0)).alias("f"))
    place = Window.orderBy(F.desc("f"), "feature")  # one row a feature
    best = scored.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top)
    fit = rows.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    per = rows.groupBy("feature", code).agg(F.avg("value").alias("own"))
    z = F.when(F.col("s") > 0, (F.col("own") - F.col("m")) / F.col("s")).otherwise(0.0)
    return per.join(fit, "feature").join(best, "feature").select("feature", "place", code, z.alias("mean_z"))
