"""Exchange with annotated matrices: anything with X, obs, var, obsm and uns, whatever package made it."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalers import ScalerRule
from tessella.operators.frame import MASK, CellFrame

#: Cells that are brought to the driver for export.
MOST_CELLS = 5_000_000


@dataclass
class Annotated:
    """X with its rows (obs), columns (var), coordinates (obsm) and provenance (uns)."""

    X: np.ndarray
    obs: pd.DataFrame
    var: pd.DataFrame
    obsm: dict[str, np.ndarray] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)


def to_anndata(frame: CellFrame, mask: str | None = None, *, columns=None, scaled: bool = False, most: int = MOST_CELLS):
    """The view of a mask as an AnnData where that package is there, else as an Annotated; over `most` cells it refuses.

    Embeddings that do not cover the mask are left out with a warning.
    """
    cols = frame.resolve(columns)
    n = frame.df.filter(frame.mask(mask)).count()
    if n > most:
        raise ValueError(f"{n} cells are over the bound of {most} for one machine")
    flags = [F.col(MASK + m).alias(f"mask_{m}") for m in frame.masks]
    rows = frame.view(mask, scaled=scaled, columns=cols)
    rows = rows.join(frame.df.select(frame.id_col, *flags), frame.id_col) if flags else rows
    pdf = rows.orderBy(frame.id_col).toPandas()
    obs = pdf.drop(columns=cols).set_index(pdf[frame.id_col].astype(str)).rename_axis(None)
    var = frame.var.filter(F.col("feature_id").isin(cols)).toPandas().set_index("feature_id").reindex(cols)
    obsm = {}
    for (m, name), coords in frame._embeddings.items():
        own = coords.toPandas().set_index(frame.id_col)
        if pdf[frame.id_col].isin(own.index).all():
            obsm[f"X_{name}"] = own.loc[pdf[frame.id_col]].to_numpy(np.float64)
        else:
            warnings.warn(f"embedding {m}/{name} does not cover the exported cells", stacklevel=2)
    uns = {"tessella": {"id_col": frame.id_col, "transforms": dict(frame.transforms), "validity": dict(frame.validity), "seed": frame.seed, "scaled": scaled, "mask": mask or "all"}}
    made = Annotated(pdf[cols].to_numpy(np.float64), obs, var, obsm, uns)
    try:
        import anndata
    except ImportError:
        return made
    return anndata.AnnData(X=made.X, obs=made.obs, var=made.var, obsm=made.obsm, uns=made.uns)


def from_anndata(spark: SparkSession, adata, *, features: list[str] | None = None, id_col: str | None = None, rule: ScalerRule | None = None, seed: int | None = None) -> CellFrame:
    """X as features, obs as columns, boolean `mask_*` columns as masks, obsm as embeddings, uns as transforms, validity and seed."""
    known = dict(getattr(adata, "uns", {}).get("tessella", {}))
    names = list(map(str, adata.var.index))
    features = names if features is None else list(features)
    x = adata.X.toarray() if hasattr(adata.X, "toarray") else np.asarray(adata.X)
    obs = adata.obs.copy()
    id_col = id_col or known.get("id_col", "cell_id")
    if id_col not in obs:
        obs[id_col] = obs.index
    masks = [c for c in obs.columns if str(c).startswith("mask_") and obs[c].dtype == bool]
    pdf = pd.concat([obs.drop(columns=masks).reset_index(drop=True), pd.DataFrame(x[:, [names.index(c) for c in features]], columns=features)], axis=1)
    flags = obs[[id_col, *masks]].reset_index(drop=True)
    metadata = adata.var.reset_index(names="feature_id") if len(adata.var.columns) else None
    frame = CellFrame(
        spark.createDataFrame(pdf), features, id_col=id_col, rule=rule, seed=known.get("seed", 0) if seed is None else seed,
        metadata=None if metadata is None else spark.createDataFrame(metadata[metadata["feature_id"].isin(features)]),
    )
    if masks:
        frame.df = frame.df.join(spark.createDataFrame(flags), id_col)
        for c in masks:
            frame.add_mask(c.removeprefix("mask_"), F.col(c))
        frame.df = frame.df.drop(*masks)
    frame.transforms |= {c: k for c, k in known.get("transforms", {}).items() if c in features}
    for c, where in known.get("validity", {}).items():
        if c in features and where in frame.masks:
            frame.set_validity([c], where)
    for name, coords in dict(getattr(adata, "obsm", {})).items():
        at = np.asarray(coords, np.float64)
        made = pd.DataFrame(at, columns=[f"c{k}" for k in range(at.shape[1])])
        made.insert(0, id_col, pdf[id_col])
        frame.add_embedding(spark.createDataFrame(made), name=str(name).removeprefix("X_"))
    return frame
