"""One-dimensional structure: intrinsic dimension, principal curves and bins along them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.quantiles import percentiles
from tessella.functions.scalars import is_finite
from tessella.operators import knn as kn
from tessella.operators.labels import Label, LabelSet
from tessella.operators.space import fit_space
from tessella.sources.staging import cut_lineage


def twonn_dimension(edges: DataFrame) -> float:
    """N / sum ln(r2 / r1) over the two nearest neighbours of each row; rows with r1 = 0 are left out."""
    r = edges.filter("rank <= 2").groupBy("src").agg(F.min("dist").alias("r1"), F.max("dist").alias("r2")).filter("r1 > 0 AND r2 > r1")
    n, s = r.agg(F.count(F.lit(1)), F.sum(F.log(F.col("r2") / F.col("r1")))).first()
    return float(n / s) if s else float("nan")


def twonn_profile(rows: DataFrame, *, levels: int = 4, seed: int = 0) -> list[dict[str, float]]:
    """The dimension at n, n/2, n/4, ... rows (cell_id, features): samples by a seeded hash, three below the first level; levels under 20 rows are left out.

    Distances of zero count as the least positive number, ratios are one and a trifle at least.
    """
    n, out = rows.count(), []
    for level in range(levels):
        size, values = n // 2**level, []
        if size < 20:
            break
        for draw in range(1 if level == 0 else 3):
            some = rows if level == 0 else cut_lineage(rows.orderBy(F.xxhash64("cell_id", F.lit(seed), F.lit(level), F.lit(draw)), "cell_id").limit(size))
            near = kn.knn(some, some, 2).groupBy("src").agg(F.min("dist").alias("r1"), F.max("dist").alias("r2"))
            ratio = F.greatest(F.col("r2") / F.greatest("r1", F.lit(np.finfo(float).tiny)), F.lit(1 + 1e-12))
            count, logs = near.filter(is_finite(ratio)).agg(F.count(F.lit(1)), F.sum(F.log(ratio))).first()
            values.append(count / logs if logs else float("nan"))
        out.append({"n": float(size), "dimension": float(np.mean(values)), "spread": float(np.std(values)) if level else 0.0, "draws": float(len(values))})
    return out


def loadings(coords: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, spearman_rho) of each column of table (cell_id, ...) with the coordinate, strongest first."""
    from tessella.operators.diagnostics import covariate_sensitivity

    rows = coords.select("cell_id", F.col("coord").alias("__coord")).join(table.select("cell_id", *columns), "cell_id")
    found = covariate_sensitivity(rows, columns, "__coord", min_finite=2)
    return found.select("feature", "spearman_rho").orderBy(F.desc_nulls_last(F.abs("spearman_rho")), "feature")


@dataclass
class Gradient:
    """A coordinate in 0 to 1 of each cell along a curve: coords (cell_id, coord)."""

    coords: DataFrame
    name: str = "gradient"
    mask: str | None = None
    feature_loadings: DataFrame | None = None
    intrinsic_dimension: float | None = None
    dimension_profile: list[dict[str, float]] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    method: str = "principal_curve"

    @property
    def cell_ids(self) -> DataFrame:
        return self.coords.select("cell_id")

    @property
    def coordinate(self) -> DataFrame:
        return self.coords

    def to_frame(self, id_col: str = "cell_id") -> DataFrame:
        return self.coords.select(F.col("cell_id").alias(id_col), F.col("coord").alias(self.name))

    def coordinate_for(self, ids: DataFrame) -> DataFrame:
        """(cell_id, coord) of exactly these ids, NaN where the curve has none."""
        return ids.select("cell_id").join(self.coords, "cell_id", "left").select("cell_id", F.coalesce("coord", F.lit(float("nan"))).alias("coord"))

    def loadings(self) -> DataFrame:
        if self.feature_loadings is None:
            raise ValueError("this gradient was built without loadings")
        return self.feature_loadings

    def bin(self, edges: int | list[float], *, names: list[str] | None = None, name: str | None = None) -> LabelSet:
        """Quantile bins, or bins at ascending edges, as labels named by their bounds."""
        if isinstance(edges, int):
            if edges < 2:
                raise ValueError("two bins or more")
            cuts = percentiles(self.coords, {"coord": (F.col("coord"), [k / edges for k in range(1, edges)])})["coord"]
        else:
            cuts = list(edges)
            if any(b <= a for a, b in zip(cuts, cuts[1:], strict=False)):
                raise ValueError("edges must ascend")
        bounds = [0.0, *cuts, 1.0]
        names = names or [f"{self.name}[{a:.2f}-{b:.2f}]" for a, b in zip(bounds, bounds[1:], strict=False)]
        if len(names) != len(cuts) + 1:
            raise ValueError(f"{len(cuts) + 1} names, not {len(names)}")
        return LabelSet(binned(self.coords, cuts), {k: Label(x) for k, x in enumerate(names)}, name or self.name)


def principal_curve(rows: DataFrame, id_col: str = "cell_id", vec_col: str = "features", *, span: float = 0.1, samples: int = 200, rounds: int = 30, tolerance: float = 1e-4):
    """(curve, coordinates): a curve of `samples` points, and (id, coord in [0, 1]) of every row.

    It starts on the first component. Each round projects rows to the nearest vertex, sums rows by vertex in one
    aggregation of `samples` groups, and smooths these sums over `span` of the length on the driver.
    """
    space = fit_space(rows, vec_col, explained=1)
    on_axis = space.transform(rows, id_col, vec_col)
    lo, hi = on_axis.agg(F.min(F.col("features")[0]), F.max(F.col("features")[0])).first()
    curve = space.mean + np.linspace(lo, hi, samples)[:, None] * space.axes[0]
    d = curve.shape[1]

    def nearest(points: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s, err = np.zeros(samples, np.int64), np.zeros((samples, d)), 0.0
            for pdf in batches:
                x = np.array(pdf[vec_col].tolist(), np.float64).reshape(-1, d)
                dist = (x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * x @ points.T
                at = dist.argmin(1)
                np.add.at(n, at, 1)
                np.add.at(s, at, x)
                err += float(dist.min(1).clip(0).sum())
            if n.any():
                yield pd.DataFrame({"k": np.flatnonzero(n), "n": n[n > 0], "s": list(s[n > 0]), "err": [err, *[0.0] * (int((n > 0).sum()) - 1)]})

        return run

    before = np.inf
    for _ in range(rounds):
        sums = [F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(d)]
        pdf = rows.select(vec_col).mapInPandas(nearest(curve), "k long, n long, s array<double>, err double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("err").alias("err"), *sums).toPandas()
        n, s = np.zeros(samples), np.zeros((samples, d))
        n[pdf["k"]] = pdf["n"]
        s[pdf["k"]] = pdf[[f"s{j}" for j in range(d)]]
        place = _arc(curve)
        new = curve.copy()
        for k in range(samples):
            near = np.abs(place - place[k]) <= span
            if n[near].sum():
                new[k] = s[near].sum(0) / n[near].sum()
        curve = _even(new, samples)
        err = float(pdf["err"].sum())
        if abs(before - err) <= tolerance * max(err, 1e-12):
            break
        before = err
    place = _arc(curve)

    @F.pandas_udf("double")
    def coordinate(vecs: pd.Series) -> pd.Series:
        x = np.array(vecs.tolist(), np.float64).reshape(-1, d)
        return pd.Series(place[((x**2).sum(1)[:, None] + (curve**2).sum(1) - 2 * x @ curve.T).argmin(1)])

    return curve, rows.select(id_col, coordinate(vec_col).alias("coord"))


def _arc(curve: np.ndarray) -> np.ndarray:
    step = np.concatenate(([0.0], np.cumsum(np.sqrt((np.diff(curve, axis=0) ** 2).sum(1)))))
    return step / (step[-1] or 1.0)


def _even(curve: np.ndarray, samples: int) -> np.ndarray:
    at = _arc(curve)
    return np.column_stack([np.interp(np.linspace(0, 1, samples), at, c) for c in curve.T])


def binned(coords: DataFrame, edges: int | list[float], id_col: str = "cell_id") -> DataFrame:
    """(id, code): quantile bins, or bins at edges; a value on an edge goes to the upper bin."""
    if isinstance(edges, int):
        edges = percentiles(coords, {"coord": (F.col("coord"), [k / edges for k in range(1, edges)])})["coord"]
    code = sum(((F.col("coord") >= e).cast("long") for e in edges), F.lit(0).cast("long"))
    return coords.select(id_col, F.when(F.col("coord").isNull(), -1).otherwise(code).alias("code"))
