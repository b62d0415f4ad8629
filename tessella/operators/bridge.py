"""Two datasets in one aligned space: votes between and within them, and how far clusters of one hold in the other.

Votes are tables (tgt, src, w). Many partitions are scored together: their runs and the pairs of runs are keys of the
same few aggregations.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import knn as kn
from tessella.operators import transfer as tr
from tessella.operators.agreement import adjusted_mutual_information
from tessella.operators.labels import LabelSet
from tessella.sources.staging import cut_lineage

VERDICTS = ("reproduces", "weak", "nested", "split", "refuted", "absent", "unverifiable", "small")
#: A cluster's code in one pair of runs: the pair's number above this many bits of the code.
_CODE_BITS = 24


@dataclass(frozen=True)
class VerdictRule:
    """Thresholds that turn a cluster's carried purity and its ceiling into a verdict."""

    ceiling_floor: float = 0.6
    reproduce_at: float = 0.85
    refute_below: float = 0.7
    min_cells: int = 20

    def __post_init__(self):
        if not 0 <= self.refute_below <= self.reproduce_at <= 1 or not 0 <= self.ceiling_floor <= 1:
            raise ValueError(f"thresholds out of order: {self}")

    def classify(self, cross: DataFrame, ceiling: DataFrame) -> DataFrame:
        return tr.verdicts(cross, ceiling, floor=self.ceiling_floor, passes=self.reproduce_at, refutes=self.refute_below, small=self.min_cells)


@dataclass
class Carry:
    """Votes of a partition's clusters for the cells of another dataset: soft (tgt, cluster, m), and the best (tgt, code, confidence)."""

    soft: DataFrame
    codes: DataFrame
    clusters: list[int]


@dataclass
class BridgeScore:
    """Readings of a pair of partitions, and a row a cluster and direction."""

    summary: dict[str, float]
    clusters: DataFrame
    sides: tuple[DataFrame, DataFrame]
    names: tuple[str, str]

    def verdicts(self) -> DataFrame:
        """(verdict, one column a direction) with every verdict there is."""
        spark = self.clusters.sparkSession
        directions = [f"{a}->{b}" for a, b in (self.names, self.names[::-1])]
        counts = self.clusters.groupBy("verdict").pivot("direction", directions).count()
        return spark.createDataFrame([(v,) for v in VERDICTS], "verdict string").join(counts, "verdict", "left").fillna(0, directions)

    def anchors(self) -> DataFrame:
        return tr.anchors(*self.sides)


def ami(pairs: DataFrame) -> float:
    """AMI of (a, b) over rows assigned on both sides; the class counts alone reach the driver."""
    counts = pairs.filter("a >= 0 AND b >= 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    return adjusted_mutual_information([tuple(r) for r in counts])


def strata_ami(rows: DataFrame, min_cells: int = 30) -> float:
    """Mean AMI within strata of (stratum, a, b), by their cells; strata below min_cells, or of one class in a, are passed over."""
    counts = rows.filter("stratum IS NOT NULL").groupBy("stratum", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()  # class counts
    found: dict = {}
    for r in counts:
        found.setdefault(r["stratum"], []).append((r["a"], r["b"], r["n"]))
    values = []
    for table in found.values():
        total = sum(n for *_, n in table)
        if total >= min_cells and len({a for a, *_ in table if a >= 0}) > 1:
            value = adjusted_mutual_information([x for x in table if x[0] >= 0 and x[1] >= 0])
            if not math.isnan(value):
                values.append((value, total))
    return sum(v * n for v, n in values) / sum(n for _, n in values) if values else math.nan


def own_purity(mass: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, purity): of (cluster, match, m) within one dataset, the share that stays, null for a small image."""
    per = mass.groupBy("cluster").agg(F.sum("m").alias("image"), F.sum(F.when(F.col("match") == F.col("cluster"), F.col("m")).otherwise(0.0)).alias("own"))
    x = sizes.join(per, "cluster", "left").fillna(0.0, ["image"])
    return x.select("cluster", F.when(F.col("image") >= F.greatest(F.lit(3.0), 0.1 * F.col("n_cells")), F.col("own") / F.col("image")).alias("purity"))


def cross_purity(mass: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, n_cells, image_mass, best_match, purity) of (cluster, match, m)."""
    per = mass.groupBy("cluster").agg(F.sum("m").alias("image_mass"), F.max(F.struct("m", (-F.col("match")).alias("c"))).alias("b"))
    x = sizes.join(per, "cluster", "left").fillna(0.0, ["image_mass"])
    enough = F.col("image_mass") >= F.greatest(F.lit(3.0), 0.1 * F.col("n_cells"))
    return x.select("cluster", "n_cells", "image_mass", (-F.col("b.c")).alias("best_match"), F.when(enough, F.col("b.m") / F.col("image_mass")).alias("purity"))


@dataclass
class TransferBridge:
    """Frozen votes between the cells of two datasets and within each."""

    names: tuple[str, str]
    cells: dict[str, DataFrame]
    cross: dict[tuple[str, str], DataFrame]
    within: dict[str, DataFrame]
    null_features: dict[str, DataFrame] = field(default_factory=dict)
    strata: dict[str, DataFrame] = field(default_factory=dict)
    refine: dict[str, DataFrame] = field(default_factory=dict)
    refine_alpha: float = 0.5
    unbridged: dict[str, int] = field(default_factory=dict)
    n_neighbors: int = 30
    mutual: bool = True
    seed: int = 0

    @classmethod
    def build(
        cls, coords: dict[str, DataFrame], *, n_neighbors: int = 30, mutual: bool = True, null_features=None, strata=None, refine_features=None, refine_alpha: float = 0.5, unbridged=None, seed: int = 0
    ) -> TransferBridge:
        """coords: for each of two names (cell_id, features) in one space."""
        if len(coords) != 2:
            raise ValueError("a bridge has two ends")
        a, b = coords
        rows = {k: cut_lineage(v.select("cell_id", "features")) for k, v in coords.items()}
        sizes = {k: v.count() for k, v in rows.items()}
        seen = {}
        for here, there in ((a, b), (b, a)):
            seen[here, there] = cut_lineage(kn.knn(rows[here], rows[there], min(n_neighbors, sizes[there]), exclude_self=False))
        cross = {(s, t): cut_lineage(tr.cross_votes(seen[t, s], seen[s, t] if mutual else None)) for s, t in ((a, b), (b, a))}
        within = {k: cut_lineage(tr.cross_votes(kn.knn(v, v, min(n_neighbors, sizes[k] - 1)))) for k, v in rows.items()}
        refine = {k: cut_lineage(tr.cross_votes(kn.knn(v, v, n_neighbors)).select(F.col("tgt").alias("src"), F.col("src").alias("dst"), F.col("w").alias("t"))) for k, v in (refine_features or {}).items()}
        cells = {k: v.select("cell_id") for k, v in rows.items()}
        return cls((a, b), cells, cross, within, null_features or rows, strata or {}, refine, refine_alpha, unbridged or {}, n_neighbors, mutual, seed)

    def other(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(f"{name} is no end of {self.names}")
        return self.names[1 - self.names.index(name)]

    def bridged_fraction(self) -> dict[str, float]:
        out = {}
        for name in self.names:
            n = self.cells[name].count()
            out[name] = n / (n + self.unbridged.get(name, 0)) if n else math.nan
        return out

    def align(self, codes: DataFrame, dataset: str) -> DataFrame:
        """(cell_id, code) of every cell of a dataset, -1 where codes has none."""
        return self.cells[dataset].join(codes.select("cell_id", "code"), "cell_id", "left").fillna(-1, ["code"])

    def soft(self, runs: DataFrame, source: str, target: str, min_confidence: float | None = None) -> DataFrame:
        """(run, tgt, cluster, m): normalised votes of the clusters of each run (cell_id, run, code) for the target's cells, one in all."""
        votes = self.within[source] if source == target else self.cross[source, target]
        known = runs.filter("code >= 0").select(F.col("cell_id").alias("src"), "run", F.col("code").alias("cluster"))
        mass = votes.join(known, "src").groupBy("run", "tgt", "cluster").agg(F.sum("w").alias("m"))
        own = Window.partitionBy("run", "tgt")
        mass = mass.withColumn("m", F.col("m") / F.sum("m").over(own))
        if source != target and target in self.refine:
            mass = self._refined(mass, self.refine[target])
            mass = mass.withColumn("m", F.col("m") / F.sum("m").over(own))
        if min_confidence is not None:
            mass = mass.withColumn("__top", F.max("m").over(own)).filter(F.col("__top") >= min_confidence).drop("__top")
        return mass

    def _refined(self, mass: DataFrame, step: DataFrame, most: int = 200, tolerance: float = 1e-4) -> DataFrame:
        """Votes mixed with those of the neighbours, refine_alpha of them a round, until they settle."""
        first = field_ = cut_lineage(mass)
        for _ in range(most):
            moved = step.join(field_.withColumnRenamed("tgt", "dst"), "dst").groupBy("run", F.col("src").alias("tgt"), "cluster").agg((self.refine_alpha * F.sum(F.col("t") * F.col("m"))).alias("m"))
            new = cut_lineage(moved.unionByName(first.withColumn("m", (1 - self.refine_alpha) * F.col("m"))).groupBy("run", "tgt", "cluster").agg(F.sum("m").alias("m")))
            gap = new.join(field_.withColumnRenamed("m", "g"), ["run", "tgt", "cluster"], "full").agg(F.max(F.abs(F.coalesce("m", F.lit(0.0)) - F.coalesce("g", F.lit(0.0))))).first()[0]
            field_ = new
            if gap is None or gap < tolerance:
                break
        return field_

    def hard(self, soft: DataFrame) -> DataFrame:
        """(run, tgt, code, confidence): the strongest cluster, ties to the lowest; cells without votes are not there."""
        best = F.max(F.struct("m", (-F.col("cluster")).alias("c"))).alias("b")
        return soft.groupBy("run", "tgt").agg(best).select("run", "tgt", (-F.col("b.c")).alias("code"), F.col("b.m").alias("confidence"))

    def _one_run(self, codes: DataFrame, name: str) -> DataFrame:
        return self.align(codes, name).select("cell_id", F.lit(0).cast("long").alias("run"), "code")

    def _carried(self, codes: DataFrame, source: str, target: str, min_confidence: float | None) -> Carry:
        soft = cut_lineage(self.soft(self._one_run(codes, source), source, target, min_confidence))
        best = self.hard(soft).drop("run")
        full = self.cells[target].withColumnRenamed("cell_id", "tgt").join(best, "tgt", "left").fillna(-1, ["code"]).fillna(0.0, ["confidence"])
        clusters = sorted(r[0] for r in codes.filter("code >= 0").select("code").distinct().collect())  # one entry a cluster
        return Carry(soft.drop("run"), full, clusters)

    def carry(self, codes: DataFrame, source: str, *, min_confidence: float | None = None) -> Carry:
        """Codes (cell_id, code) of one dataset carried to the cells of the other; -1 abstains."""
        return self._carried(codes, source, self.other(source), min_confidence)

    def ceiling(self, codes: DataFrame, dataset: str, *, min_confidence: float | None = None) -> Carry:
        """The same within the dataset, every cell left out of its own vote."""
        return self._carried(codes, dataset, dataset, min_confidence)

    def score(self, codes_a: DataFrame, codes_b: DataFrame, *, min_confidence: float | None = None, rule: VerdictRule = VerdictRule(), names_a: dict | None = None, names_b: dict | None = None) -> BridgeScore:
        """Both directions of two partitions (cell_id, code): AMI, its ceiling, efficiency, coverage, and a verdict a cluster."""
        a, b = self.names
        codes = {a: cut_lineage(self.align(codes_a, a)), b: cut_lineage(self.align(codes_b, b))}
        names = {a: names_a or {}, b: names_b or {}}
        out: dict[str, float] = {}
        masses, crosses = {}, {}
        for source, target, key in ((a, b, "ab"), (b, a, "ba")):
            carried, own = self.carry(codes[source], source, min_confidence=min_confidence), self.ceiling(codes[source], source, min_confidence=min_confidence)
            landed = codes[target].select(F.col("cell_id").alias("tgt"), F.col("code").alias("a")).join(carried.codes.select("tgt", F.col("code").alias("b")), "tgt")
            stayed = codes[source].select(F.col("cell_id").alias("tgt"), F.col("code").alias("a")).join(own.codes.select("tgt", F.col("code").alias("b")), "tgt")
            out[f"ami_{key}"], out[f"ceiling_{key}"] = ami(landed), ami(stayed)
            out[f"efficiency_{key}"] = out[f"ami_{key}"] / out[f"ceiling_{key}"] if out[f"ceiling_{key}"] > 0 else math.nan
            covered = landed.filter("a >= 0").agg(F.avg((F.col("b") >= 0).cast("double"))).first()[0]
            out[f"coverage_{key}"] = math.nan if covered is None else covered
            if self.strata:
                for reading, rows, name in (("strata_ami", landed, target), ("strata_ceiling", stayed, source)):
                    out[f"{reading}_{key}"] = strata_ami(rows.join(self.strata[name].withColumnRenamed("cell_id", "tgt"), "tgt"))
            sizes = codes[source].filter("code >= 0").groupBy(F.col("code").alias("cluster")).agg(F.count(F.lit(1)).alias("n_cells"))
            there, here = (codes[x].filter("code >= 0").select(F.col("cell_id").alias("tgt"), F.col("code").alias("match")) for x in (target, source))
            mass = cut_lineage(carried.soft.join(there, "tgt").groupBy("cluster", "match").agg(F.sum("m").alias("m")))
            kept = own.soft.join(here, "tgt").groupBy("cluster", "match").agg(F.sum("m").alias("m"))
            masses[source] = mass
            crosses[source] = cut_lineage(rule.classify(cross_purity(mass, sizes), own_purity(kept, sizes)))
        sides = tuple(cut_lineage(tr.mutual_verdicts(crosses[s], crosses[t], masses[s], passes=rule.reproduce_at)) for s, t in ((a, b), (b, a)))
        frames = []
        for side, source, target in ((sides[0], a, b), (sides[1], b, a)):
            frame = side.withColumn("direction", F.lit(f"{source}->{target}"))
            for column, known in (("cluster", names[source]), ("best_match", names[target])):
                frame = frame.withColumn(f"{column}_name", _named(known, F.col(column)))
            frames.append(frame)
        clusters = frames[0].unionByName(frames[1])
        for key, side in zip(("ab", "ba"), sides, strict=True):
            worst = side.agg(F.min("efficiency")).first()[0]
            out[f"worst_efficiency_{key}"] = math.nan if worst is None else worst
        out["worst_efficiency"] = _nan(np.nanmin, out["worst_efficiency_ab"], out["worst_efficiency_ba"])
        for reading in ("ami", "efficiency", *(("strata_ami", "strata_ceiling") if self.strata else ())):
            out[reading] = _nan(np.nanmean, out[f"{reading}_ab"], out[f"{reading}_ba"])
        anchored = F.col("verdict").isin("reproduces", "weak", "nested", "split")
        row = clusters.filter("verdict <> 'small'").agg(
            F.avg((F.col("verdict") == "reproduces").cast("double")), F.avg(anchored.cast("double")), F.sum(F.when(anchored, F.col("n_cells")).otherwise(0)) / F.sum("n_cells")
        ).first()
        for k, value in zip(("reproduce_share", "anchored_share", "anchored_cells"), row, strict=True):
            out[k] = math.nan if value is None else float(value)
        return BridgeScore(out, clusters, sides, self.names)

    def score_labels(self, labels_a: LabelSet, labels_b: LabelSet, **given) -> BridgeScore:
        facts = [x.fact.select(F.col(x.id_col).alias("cell_id"), "code") for x in (labels_a, labels_b)]
        names = [{k: v.name for k, v in x.meta.items()} for x in (labels_a, labels_b)]
        return self.score(*facts, names_a=names[0], names_b=names[1], **given)

    # many partitions at once

    def _null_codes(self, name: str, k: int, draw: int, null: str, seed: int) -> DataFrame:
        """(cell_id, code): cells by the nearest of k drawn ones, or by k-means."""
        rows = self.null_features[name]
        if null == "kmeans":
            from pyspark.ml.clustering import KMeans
            from pyspark.ml.functions import array_to_vector

            ready = rows.withColumn("__v", array_to_vector("features"))
            return KMeans(featuresCol="__v", k=k, seed=seed + draw).fit(ready).transform(ready).select("cell_id", F.col("prediction").cast("long").alias("code"))
        drawn = rows.orderBy(F.xxhash64("cell_id", F.lit(seed), F.lit(draw), F.lit(k)), "cell_id").limit(k)
        near = kn.knn(rows, drawn, 1, exclude_self=False)
        codes = drawn.select(F.col("cell_id").alias("dst"), (F.row_number().over(Window.orderBy("cell_id")) - 1).cast("long").alias("code"))  # k rows
        return near.join(F.broadcast(codes), "dst").select(F.col("src").alias("cell_id"), "code")

    def _score_many(self, parts: dict[str, DataFrame], meta: dict[str, pd.DataFrame], *, band_ratio: float, null: str | None, null_draws: int, min_confidence, rule: VerdictRule, seed: int | None) -> GrainCorrespondence:
        """parts: (cell_id, run, code) of each side; meta: a row a run with `run` and its settings."""
        if null not in (None, "voronoi", "kmeans"):
            raise ValueError(f"no null {null}")
        a, b = self.names
        seed = self.seed if seed is None else seed
        spark = self.cells[a].sparkSession
        count = {n: {r["run"]: r["k"] for r in parts[n].filter("code >= 0").groupBy("run").agg(F.countDistinct("code").alias("k")).collect()} for n in self.names}
        pairs = []  # (run_a, run_b, k_a, k_b): the run tables are small
        for ra, ka in sorted(count[a].items()):
            pairs += [(ra, rb, ka, kb) for rb, kb in sorted(count[b].items()) if min(ka, kb) >= 2 and max(ka, kb) / min(ka, kb) <= band_ratio]
        if not pairs:
            return GrainCorrespondence(pd.DataFrame(), self.names, null, band_ratio)
        scored = {n: parts[n].select("cell_id", F.col("run").cast("long").alias("run"), "code") for n in self.names}
        wanted = [(ra, rb) for ra, rb, *_ in pairs]
        nulls: dict[tuple[str, int, int], int] = {}
        if null is not None:
            for n, which in ((a, 2), (b, 3)):
                for k in sorted({p[which] for p in pairs}):
                    for draw in range(null_draws):
                        run = nulls[n, k, draw] = -1 - len(nulls)  # runs of their own, below zero
                        codes = self._null_codes(n, k, draw, null, seed).withColumn("run", F.lit(run).cast("long"))
                        scored[n] = scored[n].unionByName(codes.select("cell_id", "run", "code"))
            wanted += sorted({(nulls[a, ka, d], nulls[b, kb, d]) for *_, ka, kb in pairs for d in range(null_draws)})
        scored = {n: cut_lineage(x) for n, x in scored.items()}
        table = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(wanted)], "pair long, run_a long, run_b long")
        read = self._read_pairs(scored, table, min_confidence, rule)
        by_runs = {(int(r["run_a"]), int(r["run_b"])): r for r in read.to_dict("records")}
        rows = []
        info = {n: {int(r["run"]): r for r in meta[n].to_dict("records")} for n in self.names}
        readings = ("ami", "efficiency", "n_reproduces", "n_refuted", "n_unverifiable", "n_absent")
        for ra, rb, ka, kb in pairs:
            row = {f"{k}_a": v for k, v in info[a][ra].items()} | {f"{k}_b": v for k, v in info[b][rb].items()} | {"k_a": ka, "k_b": kb}
            row |= {k: by_runs[ra, rb][k] for k in readings}
            if null is not None:
                drawn = [by_runs[nulls[a, ka, d], nulls[b, kb, d]] for d in range(null_draws)]
                row |= {f"null_{k}": _nan(np.nanmean, *(x[k] for x in drawn)) for k in ("ami", "n_reproduces")}
                row |= {"excess": row["ami"] - row["null_ami"], "reproduces_excess": row["n_reproduces"] - row["null_n_reproduces"]}
            rows.append(row)
        return GrainCorrespondence(pd.DataFrame(rows), self.names, null, band_ratio)

    def _read_pairs(self, scored: dict[str, DataFrame], table: DataFrame, min_confidence, rule: VerdictRule) -> pd.DataFrame:
        a, b = self.names
        table = F.broadcast(table)  # one row a pair of runs
        shifted = lambda c: F.shiftleft(F.col("pair"), _CODE_BITS).bitwiseOR(F.col(c))
        scores, sides, masses = [], {}, {}
        for source, target, mine, theirs in ((a, b, "run_a", "run_b"), (b, a, "run_b", "run_a")):
            soft, own = (cut_lineage(self.soft(scored[source], source, x, min_confidence)) for x in (target, source))
            truth = lambda n, run: scored[n].select(F.col("cell_id").alias("tgt"), F.col("run").alias(run), F.col("code").alias("match"))
            carried = self.hard(soft).select(F.col("run").alias(mine), "tgt", "code")
            counts = carried.join(table, mine).join(truth(target, theirs).filter("match >= 0"), [theirs, "tgt"]).groupBy("pair", F.col("match").alias("a"), F.col("code").alias("b")).agg(F.count(F.lit(1)).alias("n"))
            ceiling = self.hard(own).select("run", "tgt", "code").join(truth(source, "run").filter("match >= 0"), ["run", "tgt"]).groupBy("run", F.col("match").alias("a"), F.col("code").alias("b")).agg(F.count(F.lit(1)).alias("n"))
            # one group a pair or run, of class counts
            amis = counts.groupBy("pair").applyInPandas(_ami_of("pair"), "pair long, ami double").toPandas().set_index("pair")["ami"]
            tops = ceiling.groupBy("run").applyInPandas(_ami_of("run"), "run long, ami double").toPandas().set_index("run")["ami"]
            scores.append((mine, amis, tops))
            known = scored[source].filter("code >= 0").groupBy("run", F.col("code").alias("cluster")).agg(F.count(F.lit(1)).alias("n_cells"))
            sizes = known.withColumnRenamed("run", mine).join(table, mine).select(shifted("cluster").alias("cluster"), "n_cells")
            mass = soft.withColumnRenamed("run", mine).join(table, mine).join(truth(target, theirs).filter("match >= 0"), [theirs, "tgt"]).groupBy("pair", "cluster", "match").agg(F.sum("m").alias("m"))
            masses[source] = cut_lineage(mass.select(shifted("cluster").alias("cluster"), shifted("match").alias("match"), "m"))
            stay = own.join(truth(source, "run").filter("match >= 0"), ["run", "tgt"]).groupBy("run", "cluster", "match").agg(F.sum("m").alias("m"))
            kept = stay.withColumnRenamed("run", mine).join(table, mine).select(shifted("cluster").alias("cluster"), shifted("match").alias("match"), "m")
            sides[source] = cut_lineage(rule.classify(cross_purity(masses[source], sizes), own_purity(kept, sizes)))
        verdict = [tr.mutual_verdicts(sides[s], sides[t], masses[s], passes=rule.reproduce_at) for s, t in ((a, b), (b, a))]
        every = verdict[0].select("cluster", "verdict").unionByName(verdict[1].select("cluster", "verdict"))
        n = [F.sum((F.col("verdict") == v).cast("long")).alias(f"n_{v}") for v in ("reproduces", "refuted", "unverifiable", "absent")]
        counted = every.groupBy(F.shiftright("cluster", _CODE_BITS).alias("pair")).agg(*n).toPandas().set_index("pair")
        out = table.toPandas().set_index("pair").join(counted).fillna(0)
        amis, shares = [], []
        for mine, found, tops in scores:
            value, top = found.reindex(out.index), tops.reindex(out[mine]).to_numpy()
            amis.append(value.to_numpy(np.float64))
            shares.append(np.where(top > 0, value / np.where(top > 0, top, 1), np.nan))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            return out.assign(ami=np.nanmean(amis, axis=0), efficiency=np.nanmean(shares, axis=0)).reset_index()

    def score_runs(self, clustering_a, clustering_b, *, band_ratio: float = 1.5, null: str | None = "voronoi", null_draws: int = 3, min_confidence=None, rule: VerdictRule = VerdictRule(), seed: int | None = None) -> GrainCorrespondence:
        """Every pair of single runs whose cluster counts are within band_ratio, against random partitions of the same counts."""
        parts, meta = {}, {}
        for name, clustering in zip(self.names, (clustering_a, clustering_b), strict=True):
            if clustering.partitions is None:
                raise ValueError(f"the clustering of {name} has no runs")
            runs = clustering.partitions
            parts[name] = runs.rows.join(self.cells[name], "cell_id", "left_semi").select("cell_id", "run", F.col("label").alias("code"))
            meta[name] = runs.runs.select("run", "resolution", "n_neighbors", "graph_type").toPandas()
        return self._score_many(parts, meta, band_ratio=band_ratio, null=null, null_draws=null_draws, min_confidence=min_confidence, rule=rule, seed=seed)

    def score_consensus(
        self, clustering_a, clustering_b, *, resolution_min=None, resolution_max=None, band: dict | None = None, heights=None, n_levels: int = 8, min_cluster_size: int = 1, band_ratio: float = 1.5,
        null: str | None = "voronoi", null_draws: int = 3, min_confidence=None, rule: VerdictRule = VerdictRule(), seed: int | None = None,
    ) -> GrainCorrespondence:
        """Every pair of levels of two consensus trees; runs may be narrowed first, by one bound for both sides or one each."""
        if band is not None and resolution_max is None:
            resolution_max = tuple(band[f"resolution_{n}"][1] for n in self.names)
        sided = lambda x: x if isinstance(x, tuple) else (x, x)
        parts, meta = {}, {}
        for k, (name, clustering) in enumerate(zip(self.names, (clustering_a, clustering_b), strict=True)):
            low, high = sided(resolution_min)[k], sided(resolution_max)[k]
            narrow = clustering if low is None and high is None else clustering.restrict(resolution_min=low, resolution_max=high)
            levels = narrow.nested_levels(heights, n_levels=n_levels, min_cluster_size=min_cluster_size)
            labels = narrow.nested_labels(heights, n_levels=n_levels, min_cluster_size=min_cluster_size)
            long = labels.unpivot(["cell_id"], [c for c in labels.columns if c != "cell_id"], "level", "code")
            parts[name] = long.join(self.cells[name], "cell_id", "left_semi").select("cell_id", F.substring("level", 7, 9).cast("long").alias("run"), "code")
            meta[name] = levels.rename(columns={"level": "run"})[["run", "height", "coclustering_frequency"]].assign(resolution=math.nan if high is None else float(high))
        return self._score_many(parts, meta, band_ratio=band_ratio, null=null, null_draws=null_draws, min_confidence=min_confidence, rule=rule, seed=seed)


def _ami_of(key: str):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        table = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["n"].tolist(), strict=True))
        return pd.DataFrame({key: [int(pdf[key].iloc[0])], "ami": [adjusted_mutual_information(table)]})

    return one


def _named(names: dict[int, str], code):
    known = [F.lit(x) for k, v in names.items() for x in (int(k), v)]
    return F.element_at(F.create_map(*known), code.cast("int")) if known else F.lit(None).cast("string")


def _nan(f, *values: float) -> float:
    real = [v for v in values if not math.isnan(v)]
    return float(f(real)) if real else math.nan


@dataclass
class GrainCorrespondence:
    """A row a scored pair of runs: their settings, cluster counts and readings. Pairs number runs times runs, so it is a pandas frame."""

    frame: pd.DataFrame
    names: tuple[str, str]
    null: str | None = None
    band_ratio: float | None = None

    def _metric(self, matching: bool = False) -> str:
        return "ami" if matching else "reproduces_excess" if "reproduces_excess" in self.frame else "n_reproduces"

    @staticmethod
    def _se(groups: pd.Series, sizes: pd.Series) -> pd.Series:
        """Standard errors from group variances; a group of one takes the root of the mean variance."""
        pooled = groups.mean(skipna=True)
        fallback = math.sqrt(pooled) if pooled == pooled else 0.0
        return np.sqrt(groups).where((sizes > 1) & groups.notna(), fallback) / np.sqrt(sizes)

    def pairs(self, *, metric: str | None = None, frame: pd.DataFrame | None = None) -> pd.DataFrame:
        """Pairs pooled by both resolutions: means, and the standard error of the metric; best first."""
        frame = self.frame if frame is None else frame
        if not len(frame):
            return frame
        metric = metric or self._metric()
        extra = [m for m in ("ami", "excess", "efficiency", "n_reproduces", "n_refuted", "n_unverifiable", "n_absent") if m in frame and m != metric]
        g = frame.groupby(["resolution_a", "resolution_b"], dropna=False)
        out = pd.DataFrame({"n_pairs": g.size(), "k_a": g["k_a"].median(), "k_b": g["k_b"].median(), metric: g[metric].mean()})
        out[f"{metric}_se"] = self._se(g[metric].var(), out["n_pairs"])
        for m in extra:
            out[m] = g[m].mean()
        return out.reset_index().sort_values([metric, "resolution_a", "resolution_b"], ascending=[False, True, True], ignore_index=True)

    def _keys(self) -> list[str]:
        return ["run_a", "run_b"]

    def matched(self, *, by: str = "ami") -> pd.DataFrame:
        """Pairs that are the best of at least one of their runs."""
        if not len(self.frame) or by not in self.frame:
            return self.frame
        best = set()
        for key, other in (("run_a", "run_b"), ("run_b", "run_a")):
            top = self.frame.sort_values([by, other], ascending=[False, True], na_position="last").groupby(key, sort=False).head(1)
            best |= set(top.index)
        return self.frame.loc[sorted(best)]

    def ridge(self, *, by: str = "ami") -> pd.DataFrame:
        """The best partner of each run of the first side, pooled by its cluster count."""
        if not len(self.frame):
            return self.frame
        best = self.frame.sort_values([by, "run_b"], ascending=[False, True], na_position="last").groupby("run_a", sort=False).head(1)
        g = best.groupby("k_a")
        out = pd.DataFrame({
            "n_runs": g.size(), "k_b": g["k_b"].median(), "resolution_a_min": g["resolution_a"].min(), "resolution_a_max": g["resolution_a"].max(),
            "resolution_b_min": g["resolution_b"].min(), "resolution_b_max": g["resolution_b"].max(),
        })
        for m in ("ami", "efficiency", "excess", "n_reproduces"):
            if m in best:
                out[m], out[f"{m}_sd"] = g[m].mean(), g[m].std()
        return out.reset_index()

    def _binned(self, bin_ratio: float, matched: bool) -> pd.DataFrame:
        if bin_ratio <= 1:
            raise ValueError("bin_ratio must exceed 1")
        frame = self.matched() if matched else self.frame
        grain = np.sqrt(frame["k_a"] * frame["k_b"])
        return frame.assign(bin=(np.log(grain) / math.log(bin_ratio)).round().astype(int), size=grain)

    def curve(self, *, bin_ratio: float = 1.25, matched: bool = True) -> pd.DataFrame:
        """Means and standard errors of the readings in log-spaced bins of the grain, sqrt(k_a * k_b)."""
        if not len(self.frame):
            return self.frame
        binned = self._binned(bin_ratio, matched)
        g = binned.groupby("bin")
        out = pd.DataFrame({"n_pairs": g.size(), "grain_min": g["size"].min().round().astype(int), "grain_max": g["size"].max().round().astype(int)})
        for m in ("ami", "efficiency", "excess", "n_reproduces", "reproduces_excess", "n_refuted", "n_unverifiable", "n_absent"):
            if m in binned:
                out[m], out[f"{m}_se"] = g[m].mean(), self._se(g[m].var(), out["n_pairs"])
        out.insert(0, "grain", np.exp(out.index.to_numpy() * math.log(bin_ratio)).round().astype(int))
        return out.reset_index(drop=True)

    def suggest_band(self, *, metric: str | None = None, bin_ratio: float = 1.25, matched: bool = True) -> dict:
        """Bins within one standard error of the peak, with the settings of both sides in it and the best pair of resolutions."""
        curve = self.curve(bin_ratio=bin_ratio, matched=matched)
        if not len(curve):
            raise ValueError("no pairs were scored")
        metric = metric or self._metric()
        ranked = curve[curve[metric].notna()]
        peak = ranked.sort_values([metric, "grain"], ascending=[False, True]).iloc[0]
        band = ranked[ranked[metric] >= peak[metric] - peak[f"{metric}_se"]]
        binned = self._binned(bin_ratio, matched)
        inside = binned[np.exp(binned["bin"] * math.log(bin_ratio)).round().astype(int).isin(band["grain"])]
        edge = "finest" if band["grain"].max() == ranked["grain"].max() else "coarsest" if band["grain"].min() == ranked["grain"].min() else None
        if edge:
            warnings.warn(f"the band reaches the {edge} grain that was scored", stacklevel=2)
        top = self.pairs(metric="ami", frame=inside).iloc[0]
        out = {"metric": metric, "peak_grain": int(peak["grain"]), "peak": float(peak[metric]), "peak_se": float(peak[f"{metric}_se"]), "at_edge": edge}
        out |= {"grain_min": int(band["grain_min"].min()), "grain_max": int(band["grain_max"].max()), "best_pair": {"ami": float(top["ami"])}}
        for side, name in zip("ab", self.names, strict=True):
            out[f"k_{name}"] = (int(inside[f"k_{side}"].min()), int(inside[f"k_{side}"].max()))
            out[f"resolution_{name}"] = (float(inside[f"resolution_{side}"].min()), float(inside[f"resolution_{side}"].max()))
            out["best_pair"] |= {f"resolution_{name}": float(top[f"resolution_{side}"]), f"k_{name}": float(top[f"k_{side}"])}
        return out

    def complement(self, side: str | None = None, *, resolution_min=None, resolution_max=None, n_clusters_min=None, n_clusters_max=None, metric: str | None = None) -> dict:
        """The band of the other side that answers a window on one side: the best partner of each resolution, and all within one standard error of it."""
        a, b = self.names
        side = side or a
        if side not in self.names:
            raise KeyError(f"{side} is no end of {self.names}")
        here, there, other = ("a", "b", b) if side == a else ("b", "a", a)
        metric = metric or self._metric(matching=True)
        inside = self.frame
        for column, low, high in ((f"resolution_{here}", resolution_min, resolution_max), (f"k_{here}", n_clusters_min, n_clusters_max)):
            if low is not None:
                inside = inside[inside[column] >= low]
            if high is not None:
                inside = inside[inside[column] <= high]
        if not len(inside):
            raise ValueError(f"no scored pair has {side} inside that window")
        pooled = self.pairs(metric=metric, frame=inside)
        best = pooled.groupby(f"resolution_{here}", sort=True).head(1).sort_values(f"resolution_{here}", ignore_index=True)
        floor = best.set_index(f"resolution_{here}")[metric] - best.set_index(f"resolution_{here}")[f"{metric}_se"]
        near = pooled[pooled[metric] >= pooled[f"resolution_{here}"].map(floor)]
        partner, swept = best[f"resolution_{there}"], self.frame[f"resolution_{there}"]
        if partner.max() >= swept.max() or partner.min() <= swept.min():
            warnings.warn(f"the band of {other} reaches the end of what was scored", stacklevel=2)
        if self.band_ratio is not None and (best[["k_a", "k_b"]].max(axis=1) / best[["k_a", "k_b"]].min(axis=1)).max() >= 0.9 * self.band_ratio:
            warnings.warn("best partners differ in cluster count by nearly band_ratio", stacklevel=2)
        ends = lambda x, kind=float: (kind(x.min()), kind(x.max()))
        return {
            "side": side, "metric": metric, f"resolution_{side}": ends(inside[f"resolution_{here}"]), f"k_{side}": ends(inside[f"k_{here}"], int),
            f"resolution_{other}": ends(partner), f"k_{other}": ends(best[f"k_{there}"], int), f"tolerant_resolution_{other}": ends(near[f"resolution_{there}"]),
            "mean": float(best[metric].mean()), "ridge": best,
        }
