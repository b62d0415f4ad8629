"""Analyses on disk: one parquet table an item and a JSON manifest, below one folder."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalers import FittedScaler, ScalerRule
from tessella.operators.frame import CellFrame
from tessella.operators.hierarchy import Clustering, Partitions
from tessella.operators.labels import Label
from tessella.operators.space import FittedSpace

VERSION = 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(frame: CellFrame, folder: str, name: str, **results: DataFrame) -> None:
    """Write the table, named results and the manifest; the manifest comes last, so a broken save has none."""
    path = f"{folder.rstrip('/')}/{name}"
    if frame._borrowed_rule:
        raise ValueError("a frame is not saved under a borrowed rule")
    frame.df.write.mode("overwrite").parquet(f"{path}/table")
    for (mask, key), coords in frame._embeddings.items():
        coords.write.mode("overwrite").parquet(f"{path}/embedding-{mask}-{key}")
    for key, clustering in frame.clusterings.items():
        save_partitions(clustering.partitions, f"{path}/clustering-{key}")
    for key, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/result-{key}")
    manifest = {
        "version": VERSION,
        "id_col": frame.id_col,
        "features": frame.feature_names,
        "masks": frame.masks,
        "collections": frame.collections,
        "validity": frame.validity,
        "transforms": frame.transforms,
        "seed": frame.seed,
        "rule": frame.rule.__dict__,
        "labels": {n: {str(k): v.__dict__ for k, v in meta.items()} for n, meta in frame.labels.items()},
        "scalers": [[mask, s.to_json()] for (mask, _), s in frame._scalers.items()],
        "spaces": [[*key, s.to_json()] for key, s in frame._spaces.items()],
        "embeddings": [[mask, key] for mask, key in frame._embeddings],
        "clusterings": {k: c.record() for k, c in frame.clusterings.items()},
        "results": sorted(results),
    }
    frame.df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, folder: str, name: str) -> tuple[CellFrame, dict[str, DataFrame]]:
    path = f"{folder.rstrip('/')}/{name}"
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    if manifest["version"] != VERSION:
        raise ValueError(f"manifest version {manifest['version']}")
    frame = CellFrame.__new__(CellFrame)
    frame.df = spark.read.parquet(f"{path}/table")
    frame.feature_names, frame.id_col, frame.seed = manifest["features"], manifest["id_col"], manifest["seed"]
    frame.rule = ScalerRule(**manifest["rule"])
    for key in ("masks", "collections", "validity", "transforms"):
        setattr(frame, key, manifest[key])
    frame.labels = {n: {int(k): Label(**v) for k, v in meta.items()} for n, meta in manifest["labels"].items()}
    scalers = [(mask, FittedScaler.from_json(text)) for mask, text in manifest["scalers"]]
    frame.metadata = None
    frame._start_registry()
    frame._scalers = {(mask, tuple(s.columns)): s for mask, s in scalers}
    frame._spaces = {(m, tuple(c), e, None if w is None else tuple(w)): FittedSpace.from_json(text) for m, c, e, w, text in manifest["spaces"]}
    frame._embeddings = {(mask, key): spark.read.parquet(f"{path}/embedding-{mask}-{key}") for mask, key in manifest["embeddings"]}
    frame.clusterings = {key: Clustering.from_record(load_partitions(spark, f"{path}/clustering-{key}"), record) for key, record in manifest["clusterings"].items()}
    return frame, {k: spark.read.parquet(f"{path}/result-{k}") for k in manifest["results"]}


def save_partitions(partitions: Partitions, path: str) -> None:
    """Runs and their settings as two tables; the co-clustering follows from them and is not stored."""
    partitions.rows.write.mode("overwrite").parquet(f"{path}/runs")
    partitions.runs.write.mode("overwrite").parquet(f"{path}/settings")


def load_partitions(spark: SparkSession, path: str) -> Partitions:
    return Partitions(spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/settings"))


def arrays_frame(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """Arrays of rank 0 to 2 as rows (array, row, col, value, ndim)."""
    rows = []
    for name, x in arrays.items():
        x = np.asarray(x, np.float64)
        grid = x.reshape(1, 1) if x.ndim == 0 else x.reshape(-1, 1) if x.ndim == 1 else x
        rows += [(name, i, j, float(grid[i, j]), x.ndim) for i in range(grid.shape[0]) for j in range(grid.shape[1])]
    return spark.createDataFrame(rows, "array string, row int, col int, value double, ndim int")


def frame_arrays(frame: DataFrame) -> dict[str, np.ndarray]:
    """The arrays of arrays_frame; for the small arrays of fits."""
    pdf = frame.toPandas()
    out = {}
    for name, part in pdf.groupby("array"):
        grid = np.zeros((part["row"].max() + 1, part["col"].max() + 1))
        grid[part["row"], part["col"]] = part["value"]
        rank = int(part["ndim"].iloc[0])
        out[name] = grid if rank == 2 else grid[:, 0] if rank == 1 else grid[0, 0]
    return out


def list_analyses(spark: SparkSession, folder: str) -> list[str]:
    """Names with a manifest, through Hadoop's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if fs.exists(Path(x.getPath(), "manifest")))


class Ledger:
    """Decisions as rows of an append-only JSON table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, kind: str, level: str, **payload) -> None:
        row = [(time.time(), kind, level, json.dumps(payload, sort_keys=True))]
        self.spark.createDataFrame(row, "at double, kind string, level string, detail string").coalesce(1).write.mode("append").json(self.path)

    def frame(self) -> DataFrame:
        rows = self.spark.read.schema("at double, kind string, level string, detail string").json(self.path)
        from pyspark.sql import Window

        return rows.withColumn("n", F.row_number().over(Window.orderBy("at")) - 1)  # a ledger of decisions is small

    def truncate(self, count: int) -> None:
        """Drop the last `count` decisions."""
        self.keep(self.frame().count() - count)

    def keep(self, which: int | list[int]) -> None:
        """Keep the first decisions, or those at the listed places."""
        cond = F.col("n") < which if isinstance(which, int) else F.col("n").isin(list(which))
        rows = [tuple(r[c] for c in ("at", "kind", "level", "detail")) for r in self.frame().filter(cond).orderBy("n").collect()]
        self.spark.createDataFrame(rows, "at double, kind string, level string, detail string").coalesce(1).write.mode("overwrite").json(self.path)


    def to_script(self) -> str:
        """The decisions as calls, in their order."""
        lines = []
        for r in self.frame().orderBy("n").collect():
            given = ", ".join(f"{k}={v!r}" for k, v in json.loads(r["detail"]).items())
            lines.append(f"session.{r['kind']}({r['level']!r}{', ' + given if given else ''})")
        return "\n".join(lines)


def demo(spark: SparkSession, n_per_subtype: int = 60, *, n_features: int = 24, family_sep: float = 9.0, subtype_sep: float = 2.6, seed: int = 0) -> DataFrame:
    """Three families of two subtypes each, with a depth gradient."""
    rows = spark.range(6 * n_per_subtype).withColumnRenamed("id", "cell_id")
    sub = F.floor(F.col("cell_id") / n_per_subtype)
    fam = F.floor(sub / 2)
    made = {f"m{k}": F.randn(seed + k) + F.when(fam == k % 3, family_sep).otherwise(0.0) + F.when(sub % 2 == k % 2, subtype_sep).otherwise(0.0) for k in range(n_features)}
    return rows.withColumns({"true_family": fam, "true_subtype": sub, "soma_depth_um": 100 + 100 * fam + F.randn(seed + 999) * 5} | made)
