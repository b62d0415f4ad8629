"""A descent through a table: cluster a level, look at cuts, commit one, go on within its clusters; every decision is on record."""

from __future__ import annotations

import queue
import threading
import tomllib
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.frame import CellFrame
from tessella.operators.hierarchy import Clustering
from tessella.sources.store import Ledger


@dataclass
class AppConfig:
    """What a session runs on; from_toml reads it from a file's [session] table."""

    folder: str = ""
    table_name: str = ""
    ledger_path: str = ""
    columns: str | list[str] | None = None
    order_by: str | None = None
    root_mask: str | None = None
    linkage_warn_cells: int = 25_000
    consensus_warn_gb: float = 8.0
    sweep: dict = field(default_factory=dict)

    @classmethod
    def from_toml(cls, path: str) -> AppConfig:
        with open(path, "rb") as f:
            given = tomllib.load(f).get("session", {})
        if unknown := sorted(set(given) - {x.name for x in fields(cls)}):
            raise ValueError(f"settings that there are not: {unknown}")
        return cls(**given)


class JobRunner:
    """One worker thread that takes jobs in their order, so that two large trees are never built at once."""

    def __init__(self):
        self._queue: queue.Queue = queue.Queue()
        self._jobs: dict[int, dict] = {}
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def submit(self, name: str, work: Callable) -> int:
        job = len(self._jobs)
        self._jobs[job] = {"job": job, "name": name, "status": "queued", "result": None, "error": None, "done": threading.Event()}
        self._queue.put((job, work))
        return job

    def _run(self) -> None:
        while True:
            job, work = self._queue.get()
            if work is None:
                return
            entry = self._jobs[job]
            entry["status"] = "running"
            try:
                entry["result"], entry["status"] = work(), "done"
            except Exception as error:  # noqa: BLE001  the job's error belongs to who asks for its result
                entry["error"], entry["status"] = error, "failed"
            entry["done"].set()

    def status(self, job: int | None = None):
        plain = lambda x: {k: x[k] for k in ("job", "name", "status")}
        return [plain(x) for x in self._jobs.values()] if job is None else plain(self._jobs[job])

    def result(self, job: int, timeout: float | None = None):
        entry = self._jobs[job]
        if not entry["done"].wait(timeout):
            raise TimeoutError(entry["name"])
        if entry["error"] is not None:
            raise entry["error"]
        return entry["result"]

    def close(self) -> None:
        self._queue.put((-1, None))
        self._thread.join(5)


@dataclass
class Level:
    """One place of the descent: a mask, its clustering, and the cut that was settled on."""

    name: str
    mask: str | None
    parent: str | None = None
    clustering: Clustering | None = None
    threshold: float | None = None
    min_cluster_size: int = 1
    scans: dict = field(default_factory=dict)


class LevelTree:
    """Named levels; clusterings stay with the most recently used ones only."""

    def __init__(self, *, max_resident: int = 3):
        self.max_resident = max_resident
        self.levels: dict[str, Level] = {}
        self._resident: OrderedDict[str, None] = OrderedDict()

    def add(self, name: str, mask: str | None, parent: str | None = None) -> Level:
        if name in self.levels:
            raise ValueError(f"level {name} exists")
        if parent is not None:
            self[parent]
        self.levels[name] = Level(name, mask, parent)
        return self.levels[name]

    def __getitem__(self, name: str) -> Level:
        if name not in self.levels:
            raise KeyError(f"no level {name}; there are {list(self.levels)}")
        return self.levels[name]

    def touch(self, name: str) -> list[str]:
        """Mark a level as used; names of the levels whose clustering had to go."""
        self._resident.pop(name, None)
        self._resident[name] = None
        gone = []
        while len(self._resident) > self.max_resident:
            old, _ = self._resident.popitem(last=False)
            self.levels[old].clustering, self.levels[old].scans = None, {}
            gone.append(old)
        return gone

    def children(self, name: str) -> list[str]:
        return [k for k, v in self.levels.items() if v.parent == name]

    def drop(self, name: str) -> None:
        for child in self.children(name):
            self.drop(child)
        self.levels.pop(name, None)
        self._resident.pop(name, None)


class Session:
    """The data verbs over one table. Decisions go to a ledger and can be rewound."""

    def __init__(self, frame: CellFrame, *, config: AppConfig | None = None, ledger: Ledger | None = None):
        self.frame, self.config, self.ledger = frame, config or AppConfig(), ledger
        self.tree = LevelTree()
        self.decisions: list[tuple[str, str, dict]] = []
        self._undo: list[Callable[[], None]] = []
        self.tree.add("root", self.config.root_mask)

    def _record(self, kind: str, level: str, undo: Callable[[], None], **payload) -> None:
        self.decisions.append((kind, level, payload))
        self._undo.append(undo)
        if self.ledger is not None:
            self.ledger.append(kind, level, **payload)

    def cluster(self, level: str, *, confirm: bool = False, **settings) -> Clustering:
        """Cluster the cells of a level; over the bound on cells only when confirmed."""
        here = self.tree[level]
        n = self.frame.df.filter(self.frame.mask(here.mask)).count()
        if n > self.config.linkage_warn_cells and not confirm:
            raise ValueError(f"{n} cells: a tree would hold {n * n * 8 / 1e9:.1f} GB; confirm or narrow the level")
        given = {"columns": self.config.columns, "order_by": self.config.order_by, **self.config.sweep, **settings}
        here.clustering, here.scans = self.frame.cluster(here.mask, **given), {}
        self.tree.touch(level)
        return here.clustering

    def _clustering(self, level: str) -> Clustering:
        found = self.tree[level].clustering
        if found is None:
            raise ValueError(f"level {level} is not clustered")
        self.tree.touch(level)
        return found

    def scan(self, level: str, *, lo: float | None = None, hi: float | None = None, n_points: int = 40, min_cluster_size: int = 1) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(scan, plateaus) of a range of thresholds, kept until the level is clustered again."""
        found, key = self._clustering(level), (lo, hi, n_points, min_cluster_size)
        held = self.tree[level].scans
        if key not in held:
            top = float(found.linkage[:, 2].max())
            at = np.linspace(0.0 if lo is None else lo, top if hi is None else hi, n_points)
            held[key] = found.threshold_scan(at, min_cluster_size=min_cluster_size), found.plateaus(at, min_cluster_size=min_cluster_size)
        return held[key]

    def coverage(self, level: str, **window) -> dict:
        """Runs within a window by axis and by realised cluster count, beside all of them."""
        runs = self._clustering(level).partitions
        summary = runs.summary().toPandas()  # a row a run
        inside = summary
        for key, value in window.items():
            column, _, edge = key.rpartition("_")
            inside = inside[inside[column] >= value] if edge == "min" else inside[inside[column] <= value]
        axes = lambda x: x.groupby(["graph_type", "n_neighbors"]).size().rename("n_runs").reset_index()
        counts = inside.groupby("n_clusters").size().rename("n_runs").reset_index()
        return {"n_runs": len(summary), "n_inside": len(inside), "axes": axes(summary), "axes_inside": axes(inside), "counts": counts}

    def preview_cut(self, level: str, *, distance_threshold: float, min_cluster_size: int = 1) -> dict:
        """What a cut would give, and whether it accepts merges that no resolution supports."""
        found = self._clustering(level)
        row = found.threshold_scan([distance_threshold], min_cluster_size=min_cluster_size).iloc[0].to_dict()
        ceiling = found.support_ceiling()
        codes = found.cluster_labels(distance_threshold, min_cluster_size=min_cluster_size)
        sizes = np.bincount(codes[codes >= 0]).tolist() if (codes >= 0).any() else []
        return {**row, "sizes": sizes, "support_ceiling": ceiling, "above_ceiling": None if ceiling is None else bool(distance_threshold > ceiling)}

    def set_cut(self, level: str, *, distance_threshold: float, min_cluster_size: int = 1) -> None:
        here = self.tree[level]
        here.threshold, here.min_cluster_size = distance_threshold, min_cluster_size

    def flow(self, level: str, *, heights=None, n_levels: int = 5, min_cluster_size: int = 1) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) between adjacent cuts: (level, cluster, n_cells) and (level, source, target, n_cells)."""
        labels = self._clustering(level).nested_labels(heights, n_levels=n_levels, min_cluster_size=min_cluster_size)
        names = [c for c in labels.columns if c != "cell_id"]
        long = labels.unpivot(["cell_id"], names, "level", "cluster").withColumn("level", F.substring("level", 7, 9).cast("int"))
        nodes = long.groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("n_cells"))
        after = long.select("cell_id", (F.col("level") - 1).alias("level"), F.col("cluster").alias("target"))
        edges = long.withColumnRenamed("cluster", "source").join(after, ["cell_id", "level"]).groupBy("level", "source", "target").agg(F.count(F.lit(1)).alias("n_cells"))
        return nodes, edges

    def scatter(self, level: str, *, embedding: str | None = None, distance_threshold: float | None = None, min_cluster_size: int = 1, color_by: str = "cluster") -> DataFrame:
        """(id, x, y, value): the first two coordinates with the cluster of a cut, or with the stability of each cell."""
        here, found = self.tree[level], self._clustering(level)
        view = self.frame.embedding_view(here.mask, name=embedding)
        if color_by == "cluster":
            at = here.threshold if distance_threshold is None else distance_threshold
            if at is None:
                raise ValueError("a distance_threshold, or a cut of the level")
            value = found.codes(at, min_cluster_size=min_cluster_size).select("cell_id", F.col("code").cast("double").alias("value"))
        elif color_by == "stability":
            value = found.cell_stability_frame().select("cell_id", F.col("stability").alias("value"))
        else:
            raise ValueError(color_by)
        key = self.frame.id_col
        return view.frame.select(F.col(key).alias("cell_id"), F.col(view.x).alias("x"), F.col(view.y).alias("y")).join(value, "cell_id").withColumnRenamed("cell_id", key)

    def commit(self, level: str, *, label_name: str | None = None, children: dict[str, list[str]] | None = None, record: bool = True) -> list[str]:
        """Attach the level's cut as labels, add a mask for each named group of clusters within the level's, and open a level on each."""
        here, found = self.tree[level], self._clustering(level)
        if here.threshold is None:
            raise ValueError(f"level {level} has no cut")
        name = label_name or f"label_{level}"
        before = self.frame.df, dict(self.frame.masks), dict(self.frame.labels), here.threshold
        labels = self.frame.label(found, distance_threshold=here.threshold, min_cluster_size=here.min_cluster_size, name=name)
        self.frame.attach(labels, overwrite=True)
        opened = []
        for child, names in (children or {}).items():
            if unknown := [x for x in names if x not in labels.names]:
                raise ValueError(f"no clusters {unknown}")
            self.frame.add_mask(child, F.col(name).isin(list(names)), based_on=here.mask)
            self.tree.add(child, child, level)
            opened.append(child)

        def undo() -> None:
            self.frame.df, self.frame.masks, self.frame.labels, here.threshold = before
            for child in opened:
                self.tree.drop(child)
                self.frame._forget(child)

        if record:
            self._record("commit", level, undo, distance_threshold=here.threshold, min_cluster_size=here.min_cluster_size, label_name=name, children=children or {})
        return opened

    def rewind(self, keep: int) -> None:
        """Undo all decisions but the first `keep`; the ledger follows."""
        while len(self.decisions) > keep:
            self.decisions.pop()
            self._undo.pop()()
        if self.ledger is not None:
            self.ledger.keep(keep)
