"""Low-dimensional layouts: principal components exactly, and a neighbour-graph layout for the others."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalers import FittedScaler
from tessella.operators import knn as kn
from tessella.operators.space import FittedSpace, fit_space

METHODS = ("pca", "umap", "pacmap", "localmap")
#: Rows on which a graph layout is fitted; the others are placed by their neighbours among these.
MOST_FITTED = 20_000


@dataclass
class FittedEmbedding:
    """The model of an embedding, able to place new rows."""

    method: str
    name: str
    columns: list[str]
    n_components: int
    scaler: FittedScaler | None
    space: FittedSpace | None = None  # the rotation of "pca", or the space that the layout was made in
    placed: DataFrame | None = None  # (cell_id, features, at) of the rows a layout was fitted on
    label: str = "scaled"
    params: dict = field(default_factory=dict)

    @property
    def coordinate_columns(self) -> list[str]:
        return [f"{self.name}{k}" for k in range(self.n_components)]

    def vectors(self, rows: DataFrame, id_col: str) -> DataFrame:
        """(cell_id, features) of raw rows, as the model takes them."""
        key = F.col(id_col).alias("cell_id")
        scaled = self.scaler.apply(rows) if self.scaler is not None else rows
        out = scaled.select(key, F.array(*[F.col(c).cast("double") for c in self.columns]).alias("features"))
        return out if self.method == "pca" or self.space is None else self.space.transform(out, "cell_id")

    def transform(self, rows: DataFrame, id_col: str = "cell_id") -> DataFrame:
        """(id, coordinates) of raw rows: exact for components, else the mean of the nearest fitted rows by 1 / distance."""
        x = self.vectors(rows, id_col)
        at = self.space.transform(x, "cell_id").withColumnRenamed("features", "at") if self.method == "pca" else place(x, self.placed)
        return at.select(F.col("cell_id").alias(id_col), *[F.col("at")[k].alias(c) for k, c in enumerate(self.coordinate_columns)])


def place(rows: DataFrame, placed: DataFrame, k: int = 10) -> DataFrame:
    """(cell_id, at): the mean of the k nearest placed rows' positions by 1 / distance; a row on top of a placed one gets its position."""
    edges = kn.knn(rows, placed, k, exclude_self=False)
    near = edges.join(placed.select(F.col("cell_id").alias("dst"), "at"), "dst")
    width = len(placed.first()["at"])
    exact = F.max(F.col("dist") == 0)
    w = 1 / F.greatest("dist", F.lit(1e-12))
    sums = [F.when(exact, F.min_by(F.col("at")[j], F.struct("dist", "dst"))).otherwise(F.sum(w * F.col("at")[j]) / F.sum(w)) for j in range(width)]
    return near.groupBy(F.col("src").alias("cell_id")).agg(F.array(*sums).alias("at"))


def layout(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, start: np.ndarray, *, epochs: int = 200, negatives: int = 5, seed: int = 0) -> np.ndarray:
    """Positions of a weighted graph's nodes: edges attract, random pairs repel, by gradient steps that shrink to zero."""
    rng, y = np.random.default_rng(seed), start.astype(np.float64).copy()
    p = w / w.max() if len(w) else w
    steep, tail = 1.577, 0.895  # the curve 1 / (1 + steep * d ** (2 * tail)) for a least distance of 0.1
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        some = np.flatnonzero(rng.random(len(p)) < p)
        i, j = a[some], b[some]
        gap = y[i] - y[j]
        d2 = np.maximum((gap**2).sum(1), 1e-12)
        pull = -2 * steep * tail * d2 ** (tail - 1) / (1 + steep * d2**tail)
        move = np.clip(pull[:, None] * gap, -4, 4) * rate
        np.add.at(y, i, move)
        np.add.at(y, j, -move)
        i = np.tile(i, negatives)
        gap = y[i] - y[rng.integers(0, n, len(i))]
        d2 = (gap**2).sum(1)
        push = 2 * tail / ((0.001 + d2) * (1 + steep * np.maximum(d2, 1e-12) ** tail))
        np.add.at(y, i, np.clip(push[:, None] * gap, -4, 4) * rate)
    return y


def embed(vectors: DataFrame, *, method: str, n_components: int = 2, n_neighbors: int = 15, epochs: int = 200, seed: int = 0, most: int = MOST_FITTED) -> tuple[DataFrame, FittedSpace | None, DataFrame | None]:
    """((cell_id, at), space, placed) of (cell_id, features).

    "pca" is exact for any number of rows. The other names give a layout of the fuzzy neighbour graph on at most
    `most` rows, those of least seeded hash; the rest are placed by their neighbours among them.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method}; there are {METHODS}")
    if method == "pca":
        space = fit_space(vectors, explained=int(n_components))
        return space.transform(vectors, "cell_id").withColumnRenamed("features", "at"), space, None
    fitted = vectors.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(most)
    pdf = fitted.toPandas().sort_values("cell_id", ignore_index=True)
    n = len(pdf)
    spark, kind = vectors.sparkSession, vectors.schema["cell_id"].dataType.simpleString()
    rows = spark.createDataFrame(pdf, f"cell_id {kind}, features array<double>")
    graph = kn.fuzzy_weights(kn.knn(rows, rows, min(n_neighbors, n - 1))).toPandas().sort_values(["a", "b"])
    x = np.array(pdf["features"].tolist(), np.float64)
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    start = np.zeros((n, n_components))
    start[:, : min(n_components, len(s))] = (u * s)[:, :n_components]
    start = 10 * start / max(np.abs(start).max(), 1e-12) + np.random.default_rng(seed).normal(0, 1e-4, start.shape)
    index = pd.Series(np.arange(n), index=pdf["cell_id"])
    at = layout(n, index[graph["a"]].to_numpy(), index[graph["b"]].to_numpy(), graph["weight"].to_numpy(), start, epochs=epochs, seed=seed)
    placed = spark.createDataFrame(pd.DataFrame({"cell_id": pdf["cell_id"], "features": pdf["features"], "at": at.tolist()}), f"cell_id {kind}, features array<double>, at array<double>")
    rest = vectors.join(placed.select("cell_id"), "cell_id", "left_anti")
    known = placed.select("cell_id", "at")
    return (known if rest.isEmpty() else known.unionByName(place(rest, placed))), None, placed


@dataclass
class EmbeddingView:
    """A view of a table with the columns that hold an embedding's coordinates."""

    name: str
    mask: str | None
    frame: DataFrame
    coords: list[str]

    @property
    def n_components(self) -> int:
        return len(self.coords)

    def __getitem__(self, i: int) -> str:
        return self.coords[i]

    @property
    def x(self) -> str:
        return self.coords[0]

    @property
    def y(self) -> str:
        return self.coords[1]

    @property
    def xy(self) -> dict[str, str]:
        return self.pair(0, 1)

    def pair(self, i: int = 0, j: int = 1) -> dict[str, str]:
        return {"x": self.coords[i], "y": self.coords[j]}
