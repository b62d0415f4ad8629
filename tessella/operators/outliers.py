"""Outlier scores by an isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    more = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A tree as rows (feature, cut, left, right, value); leaves have feature -1 and their path length as value."""
    deepest = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + float(path_length(len(rows)))])
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(high > low)
        if depth < deepest and len(rows) > 1 and len(wide):
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            under = x[rows, f] <= cut
            left = node(rows[under], depth + 1)
            nodes[at] = [f, cut, left, node(rows[~under], depth + 1), 0]
        return at

    node(np.arange(len(x)), 0)
    return np.array(nodes)


def isolation_forest(rows: DataFrame, *, trees: int = 100, size: int = 256, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Trees and the rows of each: `size` or all, drawn from the trees * size rows of least hash: a bound on what is fitted, not on what is scored."""
    some = rows.select("cell_id", "features").orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(trees * size).toPandas()
    if not len(some):
        return [], 0
    x = np.array(some["features"].tolist(), np.float64)
    rng, size = np.random.default_rng(seed), min(size, len(x))
    return [grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)], size


def outlier_score(rows: DataFrame, *, trees: int = 100, size: int = 256, seed: int = 0) -> DataFrame:
    """(cell_id, outlier_score) in 0 to 1, higher for rows that fewer cuts set apart; no rows give none. The forest sent has a fixed size."""
    forest, grown = isolation_forest(rows, trees=trees, size=size, seed=seed)
    kind = rows.schema["cell_id"].dataType.simpleString()
    base = float(path_length(max(grown, 2)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["features"].tolist(), np.float64).reshape(len(pdf), -1)
            total = np.zeros(len(x))
            for tree in forest:
                at = np.zeros(len(x), np.int64)
                while True:
                    f = tree[at, 0].astype(np.int64)
                    inner = np.flatnonzero(f >= 0)
                    if not len(inner):
                        break
                    here = at[inner]
                    under = x[inner, f[inner]] <= tree[here, 1]
                    at[inner] = np.where(under, tree[here, 2], tree[here, 3])
                total += tree[at, 4]
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "outlier_score": 2 ** (-total / max(1, len(forest)) / base)})

    return rows.select("cell_id", "features").mapInPandas(run, f"cell_id {kind}, outlier_score double")
