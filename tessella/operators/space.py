"""Principal component spaces: one pass for the moments, a p by p eigenproblem on the driver, a broadcast rotation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalers import FittedScaler


@dataclass
class FittedSpace:
    mean: np.ndarray
    axes: np.ndarray  # rows are components, all of them
    eigenvalues: np.ndarray
    n_components: int
    alpha: float = 0.0
    floor: float = 0.0
    weights: np.ndarray | None = None
    scaler: FittedScaler | None = None
    columns: list[str] | None = None

    @property
    def n_total_components(self) -> int:
        return len(self.eigenvalues)

    @property
    def n_features(self) -> int:
        return len(self.mean)

    @property
    def retained(self) -> np.ndarray:
        return np.arange(len(self.eigenvalues)) < self.n_components

    @property
    def cumulative_explained_variance(self) -> float:
        """Share of the variance in the components that are kept."""
        return float(self.ratios[: self.n_components].sum())

    @property
    def covariance_condition_number(self) -> float:
        """Highest over lowest eigenvalue of the kept components, with the floor that alpha uses."""
        kept = self.eigenvalues[: self.n_components] + self.floor
        return float(kept[0] / kept[-1]) if kept[-1] > 0 else float("inf")

    @property
    def label(self) -> str:
        parts = [f"{self.cumulative_explained_variance:.3g}", *([f"alpha={self.alpha:g}"] if self.alpha else []), *(["weighted"] if self.weights is not None else [])]
        return f"pca({', '.join(parts)})"

    @property
    def ratios(self) -> np.ndarray:
        return self.eigenvalues / max(self.eigenvalues.sum(), 1e-300)

    def n_components_for(self, explained: float) -> int:
        return min(int(np.searchsorted(np.cumsum(self.ratios), explained, side="right")) + 1, len(self.eigenvalues))

    def with_alpha(self, alpha: float, floor: float | None = None) -> FittedSpace:
        return FittedSpace(**{**self.__dict__, "alpha": alpha, "floor": self.floor if floor is None else floor})

    def with_components(self, n: int) -> FittedSpace:
        return FittedSpace(**{**self.__dict__, "n_components": n})

    @property
    def noise_floor(self) -> float:
        rest = self.eigenvalues[self.n_components :]
        return float(np.median(rest)) if len(rest) else 0.0

    @property
    def condition_number(self) -> float:
        return float(np.sqrt(self.eigenvalues[0] / max(self.eigenvalues[-1], 1e-300)))

    def rotation(self) -> np.ndarray:
        k = self.n_components
        return self.axes[:k] * ((self.eigenvalues[:k] + self.floor) ** (-self.alpha / 2))[:, None]

    def transform(self, rows: DataFrame, id_col: str, vec_col: str = "features") -> DataFrame:
        """(id, features) in the space; also for a streaming frame."""
        turn, mean = self.rotation(), self.mean
        weights = np.ones(len(mean)) if self.weights is None else self.weights

        @F.pandas_udf("array<double>")
        def project(vecs: pd.Series) -> pd.Series:
            x = np.array(vecs.tolist(), np.float64).reshape(len(vecs), len(mean))
            return pd.Series(list((x * weights - mean) @ turn.T))

        return rows.select(id_col, project(vec_col).alias("features"))

    def transform_raw(self, rows: DataFrame, id_col: str) -> DataFrame:
        """(id, features) of rows with the raw feature columns: scaled by the space's own scaler first."""
        if self.scaler is None or self.columns is None:
            raise ValueError("this space was fitted without a scaler")
        scaled = self.scaler.apply(rows)
        return self.transform(scaled.select(id_col, F.array(*[F.col(c).cast("double") for c in self.columns]).alias("features")), id_col)

    def scores(self, rows: DataFrame, id_col: str, vec_col: str = "features", n_components: int | None = None) -> DataFrame:
        """(id, features): coordinates on all components, or the first ones, without alpha."""
        plain = self.with_alpha(0.0).with_components(n_components or self.n_total_components)
        return plain.transform(rows, id_col, vec_col)

    def spectrum(self, rows: DataFrame | None = None, vec_col: str = "features", *, tail_sigma: float = 5.0) -> pd.DataFrame:
        """A row a component; given scaled rows, also the excess kurtosis of the scores and the cells in their tails.

        A cell is in the tail if its score is over tail_sigma times the quartile range / 1.349 from the median.
        """
        r = self.ratios
        n = len(r)
        out = pd.DataFrame({"component": range(n), "eigenvalue": self.eigenvalues, "ev_ratio": r, "cumulative_ev": np.cumsum(r), "retained": self.retained})
        if rows is None:
            return out
        scored = self.scores(rows.withColumn("__one", F.lit(0)), "__one", vec_col)
        each = [F.col("features")[k] for k in range(n)]
        q = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
        found = scored.agg(*[f for k, x in enumerate(each) for f in (F.kurtosis(x).alias(f"k{k}"), F.percentile(x, q).alias(f"q{k}"))]).first()
        far = []
        for k, x in enumerate(each):
            a, m, b = found[f"q{k}"]
            far.append(F.sum((F.abs(x - m) > tail_sigma * (b - a) / 1.349).cast("long")).alias(f"n{k}"))
        tails = scored.agg(*far).first()
        return out.assign(excess_kurtosis=[found[f"k{k}"] for k in range(n)], n_tail_cells=[tails[f"n{k}"] for k in range(n)])

    def to_json(self) -> str:
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return json.dumps({**plain, "scaler": None if self.scaler is None else self.scaler.to_json()})

    @classmethod
    def from_json(cls, text: str) -> FittedSpace:
        made = json.loads(text)
        scaler, columns = made.pop("scaler", None), made.pop("columns", None)
        plain = {k: np.array(v) if isinstance(v, list) else v for k, v in made.items()}
        return cls(**plain, scaler=None if scaler is None else FittedScaler.from_json(scaler), columns=columns)


def moments(rows: DataFrame, vec_col: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, X'X) of the vectors: each partition adds up its own, p * p numbers a partition are summed by a tree of two steps."""
    schema = "part int, n long, s array<double>, xx array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, xx = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf[vec_col].tolist(), np.float64)
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            xx = x.T @ x if xx is None else xx + x.T @ x
        if n:
            yield pd.DataFrame({"part": [0], "n": [n], "s": [s], "xx": [xx.ravel()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for n, s, xx in zip(pdf["n"], pdf["s"], pdf["xx"], strict=True):
                total = (n, s, xx) if total is None else (total[0] + n, total[1] + s, total[2] + xx)
        if total:
            yield pd.DataFrame({"part": [0], "n": [total[0]], "s": [total[1]], "xx": [total[2]]})

    found = rows.select(vec_col).mapInPandas(run, schema).repartition(16).mapInPandas(add, schema).toPandas()
    if not len(found):
        return 0, np.zeros(0), np.zeros((0, 0))
    s = np.sum(found["s"].tolist(), axis=0)
    return int(found["n"].sum()), s, np.sum(found["xx"].tolist(), axis=0).reshape(len(s), len(s))


def fit_space(rows: DataFrame, vec_col: str = "features", *, explained: float | int = 0.95, alpha: float = 0.0, floor: float = 0.0, weights: np.ndarray | None = None) -> FittedSpace:
    """PCA of the vectors; each axis has its largest loading positive. explained: a share of variance or a count."""
    n, s, xx = moments(rows, vec_col)
    if n < 2:
        raise ValueError("a space needs two rows")
    w = np.ones(len(s)) if weights is None else np.asarray(weights, np.float64)
    mean = s / n * w
    cov = (xx * np.outer(w, w) - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values)
    values, axes = np.maximum(values[order], 0), vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    space = FittedSpace(mean, axes, values, len(values), alpha, floor, weights)
    return space.with_components(explained if isinstance(explained, int) else space.n_components_for(explained))
