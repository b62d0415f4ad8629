"""How far a clustering and a representation hold: subsamples and withheld labels."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import agreement as ag
from tessella.operators import knn as kn
from tessella.operators import validate as va
from tessella.operators.hierarchy import Clustering, ensemble
from tessella.sources.staging import cut_lineage


@dataclass
class Stability:
    """Agreement of clusterings of subsamples with that of all cells."""

    draw_ari: list[float]
    assigned_fractions: list[float]
    cell_stability: DataFrame  # (cell_id, stability)
    full_labels: DataFrame  # (cell_id, code)
    fraction: float
    settings: dict = field(default_factory=dict)

    @property
    def n_draws(self) -> int:
        return len(self.draw_ari)

    @property
    def mean_ari(self) -> float:
        return float(np.mean(self.draw_ari))

    @property
    def median_ari(self) -> float:
        return float(np.median(self.draw_ari))

    @property
    def min_ari(self) -> float:
        return float(np.min(self.draw_ari))

    @property
    def mean_assigned(self) -> float:
        return float(np.mean(self.assigned_fractions))

    @property
    def min_assigned(self) -> float:
        return float(np.min(self.assigned_fractions))

    def summary(self) -> pd.DataFrame:
        names = ("mean_ari", "median_ari", "min_ari", "mean_assigned", "min_assigned", "n_draws", "fraction")
        return pd.DataFrame([{**{k: getattr(self, k) for k in names}, **self.settings}])


def subsample_stability(
    rows: DataFrame, *, distance_threshold: float, n_draws: int = 10, fraction: float = 0.8, min_cluster_size: int = 1, method: str = "average", seed: int = 0, n_times: int = 2, **settings
) -> Stability:
    """Cluster all rows (cell_id, features) and `n_draws` subsamples alike, and compare.

    A draw takes the rows of least seeded hash, round(fraction * n) of them. A cell's stability is the mean, over the
    draws that have it, of the share of its cluster's drawn cells that stayed with it; 0 where the draw drops it.
    """
    if n_draws < 1 or not 0 < fraction < 1:
        raise ValueError("stability takes one draw or more, of a share between 0 and 1")
    rows = cut_lineage(rows.select("cell_id", "features"))
    n = rows.count()
    size = round(fraction * n)
    if size < 3:
        raise ValueError(f"{size} cells a draw are too few to cluster")

    def codes(part: DataFrame) -> DataFrame:
        runs = ensemble(part, n_times=n_times, min_cluster_size=min_cluster_size, seed=seed, **settings)
        return cut_lineage(Clustering.from_partitions(runs, method=method).codes(distance_threshold, min_cluster_size=min_cluster_size))

    full, aris, shares, kept = codes(rows), [], [], None
    for draw in range(n_draws):
        part = cut_lineage(rows.orderBy(F.xxhash64("cell_id", F.lit(seed), F.lit(draw)), "cell_id").limit(size))
        drawn = codes(part)
        table = ag.contingency(ag.shared(full, drawn))
        score = ag.agreement(table).select("ari").first()
        aris.append(float("nan") if score is None else score[0])
        known = full.filter("code >= 0").select("cell_id").join(drawn, "cell_id")
        shares.append(known.agg(F.avg((F.col("code") >= 0).cast("double"))).first()[0])
        held = stayed(full.join(part.select("cell_id"), "cell_id", "left_semi"), drawn)
        kept = held if kept is None else kept.unionByName(held)
    per_cell = cut_lineage(kept.groupBy("cell_id").agg(F.avg("kept").alias("stability")))
    known = {"n_times": n_times, "distance_threshold": distance_threshold, "min_cluster_size": min_cluster_size} | {k: str(v) for k, v in settings.items()}
    return Stability(aris, shares, full.select("cell_id").join(per_cell, "cell_id", "left"), full, fraction, known)


def stayed(reference: DataFrame, drawn: DataFrame) -> DataFrame:
    """(cell_id, kept): the share of a cell's reference cluster, itself included, that has its cluster in the draw; null without a reference label."""
    x = reference.select("cell_id", F.col("code").alias("r")).join(drawn.select("cell_id", F.col("code").alias("d")), "cell_id")
    pairs = x.groupBy("r", "d").agg(F.count(F.lit(1)).alias("both"))
    sizes = pairs.groupBy("r").agg(F.sum("both").alias("all"))
    kept = F.when(F.col("r") >= 0, F.when(F.col("d") >= 0, F.col("both") / F.col("all")).otherwise(0.0))
    return x.join(pairs, ["r", "d"]).join(sizes, "r").select("cell_id", kept.alias("kept"))


def clustering_stability(clustering: Clustering, rows: DataFrame, *, distance_threshold: float, **given) -> Stability:
    """The same with the settings under which a clustering was made."""
    known = {k: clustering.params[k] for k in ("graph_type", "n_neighbors", "resolution", "prune", "min_cluster_size") if k in clustering.params}
    return subsample_stability(rows, distance_threshold=distance_threshold, method=clustering.method, **(known | given))


@dataclass
class RecoveryScore:
    """Known labels read off their neighbours in one representation: (cell_id, truth, predicted, correct), weight and stratum where given."""

    scored: DataFrame
    name: str = ""
    n_neighbors: int = 15

    def _one(self, value, where=None):
        rows = self.scored if where is None else self.scored.filter(where)
        got = rows.agg(value).first()[0]
        return float("nan") if got is None else got

    @property
    def n_labeled(self) -> int:
        return self.scored.count()

    @property
    def n_abstained(self) -> int:
        return self.scored.filter("predicted < 0").count()

    @property
    def accuracy(self) -> float:
        return self._one(F.avg(F.col("correct").cast("double")), F.col("predicted") >= 0)

    @property
    def accuracy_ipw(self) -> float:
        """Weighted accuracy of the rows that were given a label; without weights, plain accuracy."""
        if "weight" not in self.scored.columns:
            return self.accuracy
        return self._one(F.sum(F.col("weight") * F.col("correct").cast("double")) / F.sum("weight"), F.col("predicted") >= 0)

    def by_stratum(self) -> DataFrame:
        rows = self.scored
        for name, value in (("stratum", F.lit("all")), ("weight", F.lit(1.0))):
            if name not in rows.columns:
                rows = rows.withColumn(name, value)
        return va.by_stratum(rows)


def loo_recovery(rows: DataFrame, *, k: int = 15, weights: str = "uniform", name: str = "") -> RecoveryScore:
    """Labels of rows (cell_id, features, code, and weight and stratum if there) read off their k nearest labelled neighbours."""
    known = cut_lineage(rows.filter("code >= 0"))
    n = known.count()
    if n < 2:
        raise ValueError("recovery needs two labelled rows")
    read = kn.vote(kn.knn(known, known, min(k, n - 1)), known, weights=weights).select(F.col("src").alias("cell_id"), F.col("code").alias("predicted"))
    out = known.drop("features").withColumnRenamed("code", "truth").join(read, "cell_id")
    return RecoveryScore(cut_lineage(out.withColumn("correct", F.col("truth") == F.col("predicted"))), name, k)
