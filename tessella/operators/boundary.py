"""Is the border between two clusters a gap or a cut? Four reads of each pair of clusters, and their vote."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.quantiles import group_quantiles
from tessella.operators.knn import knn_graph
from tessella.operators.validate import dip_statistic

TINY = float(np.finfo(float).tiny)


def density(edges: DataFrame) -> DataFrame:
    """(cell_id, rho): the inverse distance to the last of a row's neighbours."""
    return edges.groupBy(F.col("src").alias("cell_id")).agg((1 / F.greatest(F.max("dist"), F.lit(TINY))).alias("rho"))


def _peaks(rows: DataFrame, share: float = 0.9) -> DataFrame:
    """(code, n, volume, peak): rows, summed degrees and the interpolated quantile of the density of each cluster.

    The quantile is read off running counts of distinct densities: no task sorts a whole cluster.
    """
    sizes = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("volume"))
    return sizes.join(group_quantiles(rows, ["code"], "rho", {"peak": share}), "code").select("code", "n", "volume", "peak")


def _pairs(clusters: DataFrame) -> DataFrame:
    """Every pair a < b of clusters, one row each: the report's own size. Only the table of clusters is gathered."""
    x = F.struct("code", "n", "volume", "peak")
    every = clusters.agg(F.sort_array(F.collect_list(x)).alias("all"))
    first = every.select("all", F.posexplode("all").alias("at", "p"))
    both = first.select("p", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("q"))
    return both.select(
        F.col("p.code").alias("cluster_a"), F.col("q.code").alias("cluster_b"), F.col("p.n").alias("n_a"), F.col("q.n").alias("n_b"),
        (F.col("p.volume") * F.col("q.volume")).alias("volumes"), F.least("p.peak", "q.peak").alias("peak"),
    )


def _between(pairs: DataFrame, codes: DataFrame, a: str, b: str) -> DataFrame:
    """pairs (a, b, ...) of rows in different clusters, with cluster_a < cluster_b."""
    x = pairs.join(codes.select(F.col("cell_id").alias(a), F.col("code").alias("ca")), a).join(codes.select(F.col("cell_id").alias(b), F.col("code").alias("cb")), b)
    return x.filter("ca <> cb").withColumns({"cluster_a": F.least("ca", "cb"), "cluster_b": F.greatest("ca", "cb")})


@lru_cache(maxsize=8)
def _null_dips(n: int, draws: int = 300) -> np.ndarray:
    rng = np.random.default_rng(0)
    return np.sort([dip_statistic(rng.random(n)) * np.sqrt(n) for _ in range(draws)])


def dip_p(dip: float, n: int, points: int = 300) -> float:
    """Share of uniform samples with at least this dip. The dip falls with the root of n, so samples of up to `points` values stand for larger ones."""
    null = _null_dips(min(n, points))
    return float(1 - np.searchsorted(null, dip * np.sqrt(n), side="left") / len(null))


def pair_dips(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster_a, cluster_b, dip, dip_p) of both clusters' rows on the line through their centres; none where the centres agree.

    The dip is that of all projections of a pair; one task holds them, as numbers.
    """
    each = rows.select("code", F.posexplode("features").alias("at", "x")).groupBy("code", "at").agg(F.avg("x").alias("x"))
    centres = each.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("c")).select("code", F.col("c.x").alias("c"))
    lines = (
        pairs.select("cluster_a", "cluster_b")
        .join(centres.select(F.col("code").alias("cluster_a"), F.col("c").alias("from")), "cluster_a")
        .join(centres.select(F.col("code").alias("cluster_b"), F.col("c").alias("to")), "cluster_b")
        .withColumn("axis", F.zip_with("to", "from", lambda x, y: x - y))
        .withColumn("norm", F.sqrt(F.aggregate("axis", F.lit(0.0), lambda s, x: s + x * x)))
        .filter("norm > 0")
        .select("cluster_a", "cluster_b", F.transform("axis", lambda x: x / F.col("norm")).alias("axis"), F.explode(F.array("cluster_a", "cluster_b")).alias("code"))
    )
    on = rows.join(lines, "code").select("cluster_a", "cluster_b", F.aggregate(F.zip_with("features", "axis", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("v"))

    def dips(pdf: pd.DataFrame) -> pd.DataFrame:  # one row a pair of clusters
        dip = float(dip_statistic(pdf["v"].to_numpy()))
        return pd.DataFrame({"cluster_a": pdf["cluster_a"].iloc[:1], "cluster_b": pdf["cluster_b"].iloc[:1], "dip": dip, "dip_p": dip_p(dip, len(pdf))})

    kinds = [f"{c} {on.schema[c].dataType.simpleString()}" for c in ("cluster_a", "cluster_b")]
    return on.groupBy("cluster_a", "cluster_b").applyInPandas(dips, f"{', '.join(kinds)}, dip double, dip_p double")


def boundary_report(
    rows: DataFrame,
    edges: DataFrame,
    similarity: DataFrame | None = None,
    *,
    dips: bool = True,
    min_cells: int = 10,
    dip_alpha: float = 0.05,
    valley_deep: float = 0.5,
    connectivity_low: float = 0.1,
    connectivity_high: float = 0.5,
    band_wide: float = 0.25,
    cross_sparse: float = 0.05,
) -> DataFrame:
    """One row a pair of clusters of rows (cell_id, features, code): four reads, a vote of each, a verdict.

    edges (src, dst, dist): neighbours of all rows. similarity (i, j, freq), each pair once: co-clustering; without
    it that vote is null. Connectivity is the number of edges between the clusters over what their degrees lead to
    expect; the valley is the best saddle of such an edge over the lower of the clusters' density peaks.
    The verdict needs two votes and a majority, else it is ambiguous; pairs with under min_cells rows are too_small.
    """
    codes = rows.filter("code >= 0").select("cell_id", "code")
    graph = knn_graph(edges)
    ends = graph.select(F.explode(F.array("a", "b")).alias("cell_id")).groupBy("cell_id").agg(F.count(F.lit(1)).alias("degree"))
    measured = codes.join(density(edges), "cell_id").join(ends, "cell_id", "left").fillna(0, ["degree"])
    pairs = _pairs(_peaks(measured))
    rho = density(edges)
    cross = _between(graph, codes, "a", "b").join(rho.select(F.col("cell_id").alias("a"), F.col("rho").alias("ra")), "a").join(rho.select(F.col("cell_id").alias("b"), F.col("rho").alias("rb")), "b")
    cross = cross.groupBy("cluster_a", "cluster_b").agg(F.count(F.lit(1)).alias("seen"), F.max(F.least("ra", "rb")).alias("saddle"))
    total = graph.agg(F.count(F.lit(1)).alias("m"))
    key = ["cluster_a", "cluster_b"]
    x = pairs.join(cross, key, "left").join(F.broadcast(total))  # total: one row
    x = x.withColumns({
        "connectivity_ratio": F.coalesce("seen", F.lit(0)) / F.greatest(F.col("volumes") / (2.0 * F.col("m")), F.lit(TINY)),
        "valley_ratio": F.coalesce("saddle", F.lit(0.0)) / F.greatest("peak", F.lit(TINY)),
    })
    nothing = F.lit(None).cast("double")
    if similarity is None:
        x = x.withColumns({"cocluster_cross_mean": nothing, "cocluster_band": nothing})
    else:
        inside = ((F.col("freq") > 0.2) & (F.col("freq") < 0.8)).cast("long")
        sums = _between(similarity, codes, "i", "j").groupBy(*key).agg(F.sum("freq").alias("s"), F.sum(inside).alias("t"))
        x = x.join(sums, key, "left")
        all_pairs = F.col("n_a") * F.col("n_b")
        x = x.withColumns({"cocluster_cross_mean": F.coalesce("s", F.lit(0.0)) / all_pairs, "cocluster_band": F.coalesce("t", F.lit(0)) / all_pairs})
    if dips:
        x = x.join(pair_dips(rows.filter("code >= 0"), pairs.filter((F.col("n_a") >= min_cells) & (F.col("n_b") >= min_cells))), key, "left")
    else:
        x = x.withColumns({"dip": nothing, "dip_p": nothing})

    def choice(discrete: Column, continuous: Column) -> Column:
        return F.when(discrete, "discrete").when(continuous, "continuous")

    c, cross_mean = F.col("connectivity_ratio"), F.col("cocluster_cross_mean")
    votes = {
        "vote_dip": choice(F.col("dip_p") < dip_alpha, F.col("dip_p") >= dip_alpha),
        "vote_connectivity": choice(c < connectivity_low, c > connectivity_high),
        "vote_valley": choice(F.col("valley_ratio") < valley_deep, F.col("valley_ratio") >= valley_deep),
        "vote_cocluster": choice(cross_mean < cross_sparse, F.col("cocluster_band") > band_wide),
    }
    x = x.withColumns(votes)
    count = lambda kind: sum((F.coalesce(F.col(v) == kind, F.lit(False)).cast("int") for v in votes), F.lit(0))
    d, k = count("discrete"), count("continuous")
    verdict = F.when((d + k >= 2) & (d > k), "discrete").when((d + k >= 2) & (k > d), "continuous").otherwise("ambiguous")
    small = (F.col("n_a") < min_cells) | (F.col("n_b") < min_cells)
    read = ["dip", "dip_p", "connectivity_ratio", "valley_ratio", "cocluster_cross_mean", "cocluster_band", *votes]
    return x.select(*key, "n_a", "n_b", *[F.when(~small, F.col(v)).alias(v) for v in read], F.when(small, "too_small").otherwise(verdict).alias("verdict"))
