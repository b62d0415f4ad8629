"""Ensembles of partitions as a star schema, their co-clustering pairs, and hierarchies over them.

Partitions are rows (cell_id, run, label) beside a small run table (run, graph_type, n_neighbors, resolution).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.staging import cut_lineage


def run_summary(partitions: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: settings, n_clusters, n_unassigned, largest_cluster."""
    sizes = partitions.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("run").agg(
        F.sum((F.col("label") >= 0).cast("long")).alias("n_clusters"),
        F.sum(F.when(F.col("label") < 0, F.col("n")).otherwise(0)).alias("n_unassigned"),
        F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("n"))), F.lit(0)).alias("largest_cluster"),
    )
    return runs.join(per, "run")


def by_setting(summary: DataFrame) -> DataFrame:
    return summary.groupBy("graph_type", "n_neighbors", "resolution").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min("n_clusters").alias("min_clusters"),
        F.percentile("n_clusters", 0.5).alias("median_clusters"),
        F.max("n_clusters").alias("max_clusters"),
        F.avg("n_unassigned").alias("mean_unassigned"),
    )


def filter_runs(partitions: DataFrame, summary: DataFrame, **window) -> DataFrame:
    """Rows of the runs within a window: resolution_min/max, n_clusters_min/max, n_neighbors and graph_type (lists)."""
    cond = F.lit(True)
    for key, value in window.items():
        if value is None:
            continue
        column, _, edge = key.rpartition("_")
        if edge in ("min", "max"):
            cond &= F.col(column) >= value if edge == "min" else F.col(column) <= value
        else:
            cond &= F.col(key).isin(list(value) if isinstance(value, (list, tuple, set)) else [value])
    kept = summary.filter(cond).select("run")
    if kept.isEmpty():
        raise ValueError(f"no run within {window}")
    return partitions.join(F.broadcast(kept), "run", "left_semi")  # the run table is a few rows a setting


def density(partitions: DataFrame) -> float:
    """Predicted share of pairs that meet in some run: 1 - prod(1 - sum((s/n)^2)). Ask before making the pairs."""
    n = partitions.select("cell_id").distinct().count()
    sizes = partitions.filter("label >= 0").groupBy("run", "label").agg(F.count(F.lit(1)).alias("s"))
    per = sizes.groupBy("run").agg(F.sum((F.col("s") / n) ** 2).alias("p"))
    row = per.agg(F.sum(F.log1p(-F.least("p", F.lit(1 - 1e-12))))).first()
    return float(1 - np.exp(row[0] or 0.0))


#: Meetings of cells, over all runs, beyond which co-clustering refuses.
MOST_MEETINGS = 10**11
#: Cells of a block of a cluster; a task takes a pair of blocks at once.
BLOCK = 5_000


#: Pairs that a task looks at in one step.
STRIP = 1 << 19


def _blocks(partitions: DataFrame, most: int, block: int) -> tuple[DataFrame, int]:
    """Pairs of blocks of a cluster (run, label, block, other, a, b), the cells with their labels of all runs; and the count of runs.

    Only blocks are dealt out, never pairs of cells. Labels are -1 where a run left a cell out, -2 where it has no row.
    """
    runs = sorted(r[0] for r in partitions.select("run").distinct().collect())
    label = F.when(F.col("label") < 0, -1).otherwise(F.col("label"))
    codes = F.array(*[F.coalesce(F.max(F.when(F.col("run") == r, label)), F.lit(-2)).cast("long") for r in runs]) if runs else F.array().cast("array<long>")
    cells = cut_lineage(partitions.groupBy("cell_id").agg(codes.alias("codes")))
    rows = cells.select("cell_id", "codes", F.posexplode("codes").alias("run", "label")).filter("label >= 0")
    sizes = rows.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))
    meetings = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    if meetings and meetings > most:
        raise ValueError(f"{meetings:.3g} pairs would meet, over {most:.3g}")
    parts = sizes.select("run", "label", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = rows.join(parts, ["run", "label"]).withColumn("block", F.pmod(F.xxhash64("cell_id"), F.col("parts")).cast("int"))
    held = cut_lineage(dealt.groupBy("run", "label", "parts", "block").agg(F.sort_array(F.collect_list(F.struct("cell_id", "codes"))).alias("cells")))
    left = held.select("run", "label", "block", F.explode(F.sequence("block", F.col("parts") - 1)).alias("other"), F.col("cells").alias("a"))
    right = held.select("run", "label", F.explode(F.sequence(F.lit(0), "block")).alias("block"), F.col("block").alias("other"), F.col("cells").alias("b"))
    return left.join(right, ["run", "label", "block", "other"]), len(runs)


def _meet(batch: pa.RecordBatch, n_runs: int, normalize: bool):
    """For each pair of blocks of a batch and each strip of it: run, ids of a and b, whether the blocks are one, the strip's first row, meetings so far by run, runs that kept both."""
    kind = np.uint8 if n_runs < 256 else np.uint16 if n_runs < 65536 else np.uint32
    for at in range(batch.num_rows):
        run, same = batch.column("run")[at].as_py(), batch.column("block")[at].as_py() == batch.column("other")[at].as_py()
        ids, codes = [], []
        for side in ("a", "b"):
            cells = batch.column(side)[at].values
            ids.append(cells.field(0))
            codes.append(cells.field(1).flatten().to_numpy().reshape(len(cells), n_runs))
        a, b = codes
        out = [(x == -1).astype(np.float32) for x in codes]
        small = []
        for r in range(n_runs):  # short codes compare faster; what is not assigned equals nothing
            found, short = np.unique(np.concatenate((np.where(a[:, r] < 0, -1, a[:, r]), np.where(b[:, r] < 0, -2, b[:, r]))), return_inverse=True)
            short = short.astype(np.uint8 if len(found) < 256 else np.uint16 if len(found) < 65536 else np.uint32)
            small.append((short[: len(a)], short[len(a) :]))
        step = max(1, STRIP // len(b))
        for first in range(0, len(a), step):
            x = slice(first, first + step)
            co = np.zeros((len(a[x]), len(b)), kind)
            before = None
            for r, (p, q) in enumerate(small):
                if r == run:
                    before = co > 0
                co += p[x, None] == q[None, :]
            kept = 1.0
            if normalize:
                kept = n_runs - (out[0][x].sum(1)[:, None] + out[1].sum(1)[None, :] - out[0][x] @ out[1].T)
            yield run, ids, same, first, co, before, kept


def coclustering(partitions: DataFrame, *, normalize: bool = True, most: int = MOST_MEETINGS, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(i, j, freq), i < j: runs in which both are in one cluster, by the runs that kept both.

    The pairs are the operator's result. Their meetings number the sum of squared cluster sizes, which is counted first:
    over `most` it refuses. Clusters are dealt into blocks of about `block` cells, each pair of which meets in one task
    with the labels of all runs; a pair comes from the first run in which it meets, so no pair is shuffled. digits
    rounds the few distinct frequencies, half up.
    """
    pairs, n_runs = _blocks(partitions, most, block)
    kind = partitions.schema["cell_id"].dataType.simpleString()

    def values() -> np.ndarray:
        kept, co = np.meshgrid(np.arange(n_runs + 1), np.arange(n_runs + 1))
        v = co / np.maximum(kept, 1) if normalize else co.astype(np.float64)
        if digits is not None:
            unit = Decimal(1).scaleb(-digits)
            v = np.array([float(Decimal(repr(float(x))).quantize(unit, ROUND_HALF_UP)) for x in v.ravel()])
        return v.ravel()

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = values()
        for batch in batches:
            last = None
            for _, ids, same, first, co, before, kept in _meet(batch, n_runs, normalize):
                if ids is not last:
                    last, every = ids, pa.concat_arrays(ids)
                    n, plain = len(ids[0]), every.to_numpy(zero_copy_only=False)
                    rank = np.empty(len(plain), np.int64)
                    rank[np.argsort(plain, kind="stable")] = np.arange(len(plain))
                met = (co > 0) & ~before
                if same:
                    met &= np.arange(first, first + len(co))[:, None] < np.arange(co.shape[1])[None, :]
                at = np.flatnonzero(met)
                if not len(at):
                    continue
                x, y = np.divmod(at.astype(np.int32), np.int32(co.shape[1]))
                which = co.ravel()[at].astype(np.int64) * (n_runs + 1) + (np.asarray(kept).ravel()[at].astype(np.int64) if normalize else 1)
                x, y = x + first, y + n
                if same:  # sorted by id
                    lo, hi = x, y
                else:
                    swap = rank[x] > rank[y]
                    lo, hi = np.where(swap, y, x), np.where(swap, x, y)
                take = (lambda k: pa.array(plain[k], every.type)) if plain.dtype.kind in "iu" else (lambda k: every.take(pa.array(k)))
                yield pa.RecordBatch.from_arrays([take(lo), take(hi), pa.array(value[which])], ["i", "j", "freq"])

    return pairs.mapInArrow(run_, f"i {kind}, j {kind}, freq double")


def strength_of(partitions: DataFrame, cells: DataFrame, *, normalize: bool = True, most: int = MOST_MEETINGS, block: int = BLOCK) -> DataFrame:
    """strength of coclustering, without its pairs: a pair of blocks gives the best of each of its cells."""
    pairs, n_runs = _blocks(partitions, most, block)
    kind = partitions.schema["cell_id"].dataType.simpleString()

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held = None, []
            for _, ids, same, first, co, _, kept in _meet(batch, n_runs, normalize):
                if ids is not last:
                    last, best = ids, [np.zeros(len(x)) for x in ids]
                    held.append((ids, best))
                if same:
                    own = np.arange(len(co))
                    co[own, own + first] = 0
                freq = co / np.maximum(np.asarray(kept, np.float64), 1.0)
                best[0][first : first + len(co)] = freq.max(1)
                np.maximum(best[1], freq.max(0), out=best[1])
            for ids, best in held:
                for x, v in zip(ids, best, strict=True):
                    yield pa.RecordBatch.from_arrays([x, pa.array(v)], ["cell_id", "strength"])

    best = pairs.mapInArrow(run_, f"cell_id {kind}, strength double").groupBy("cell_id").agg(F.max("strength").alias("strength"))
    return cells.select("cell_id").join(best, "cell_id", "left").fillna(0.0, ["strength"])


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "freq"))


def strength(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, strength): the strongest co-clustering with another cell, 0 without any."""
    best = both_ways(pairs).groupBy(F.col("i").alias("cell_id")).agg(F.max("freq").alias("strength"))
    return cells.select("cell_id").join(best, "cell_id", "left").fillna(0.0, ["strength"])


def soft_labels(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """(cell_id, code, share): mean co-clustering with the members of each cluster, itself left out."""
    sizes = codes.filter("code >= 0").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    other = codes.filter("code >= 0").select(F.col("cell_id").alias("j"), "code")
    own = codes.select(F.col("cell_id").alias("i"), F.col("code").alias("own"))
    sums = both_ways(pairs).join(other, "j").groupBy("i", "code").agg(F.sum("freq").alias("total"))
    out = sums.join(sizes, "code").join(own, "i")
    less = (F.col("own") == F.col("code")).cast("int")
    return out.select(F.col("i").alias("cell_id"), "code", (F.col("total") / F.greatest(F.col("n") - less, F.lit(1))).alias("share"))


def block_means(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """(a, b, mean) of co-clustering between clusters, diagonal cells counted as 1."""
    known = codes.filter("code >= 0")
    sizes = known.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    sums = (
        both_ways(pairs)
        .join(known.select(F.col("cell_id").alias("i"), F.col("code").alias("a")), "i")
        .join(known.select(F.col("cell_id").alias("j"), F.col("code").alias("b")), "j")
        .groupBy("a", "b").agg(F.sum("freq").alias("s"))
    )
    own = sizes.select(F.col("code").alias("a"), F.col("code").alias("b"), F.col("n").cast("double").alias("s"))
    total = sums.union(own).groupBy("a", "b").agg(F.sum("s").alias("s"))
    na, nb = (sizes.select(F.col("code").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    return total.join(na, "a").join(nb, "b").select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("mean"))


def _tallied(partitions: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Assigned rows (cell_id, run, label, miss), cells of codes (cell_id, code, miss, given), tallies (run, label, code, miss, n) and the count of runs.

    miss: the runs that left a cell out. Two cells with the same one count the same runs with any third, so the sums of
    co-clustering need a row for each of these sets and code in a cluster, never the pairs.
    """
    cells = partitions.groupBy("cell_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("label") < 0, F.col("run")))).alias("miss"), F.count_if(F.col("label") >= 0).alias("given")
    )
    rows = partitions.filter("label >= 0").join(cells.select("cell_id", "miss"), "cell_id")
    known = codes.filter("code >= 0").select("cell_id", "code").join(cells, "cell_id")
    tallies = partitions.filter("label >= 0").join(known, "cell_id").groupBy("run", "label", "code", "miss").agg(F.count(F.lit(1)).alias("n"))
    return rows, known, tallies, partitions.select("run").distinct().count()


def _kept(n_runs: int, normalize: bool, a: str, b: str):
    """Runs that kept two cells, by the sets of those that did not."""
    return n_runs - F.size(F.array_union(a, b)) if normalize else F.lit(1)


def soft_labels_of(partitions: DataFrame, codes: DataFrame, *, normalize: bool = True) -> DataFrame:
    """soft_labels of coclustering, without its pairs: a cluster's members are added up by code and by the runs that left them out."""
    rows, known, tallies, n_runs = _tallied(partitions, codes)
    met = rows.join(tallies.withColumnRenamed("miss", "their"), ["run", "label"])
    sums = met.groupBy("cell_id", "code").agg(F.sum(F.col("n") / _kept(n_runs, normalize, "miss", "their")).alias("total"), F.sum("n").alias("met"))
    own = codes.select("cell_id", F.col("code").alias("own"))
    given = known.select("cell_id", "given", (F.col("given") / _kept(n_runs, normalize, "miss", "miss")).alias("self"))  # a cell meets itself too
    sizes = codes.filter("code >= 0").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    out = sums.join(sizes, "code").join(own, "cell_id").join(given, "cell_id", "left")
    same = F.col("own") == F.col("code")
    out = out.filter(F.col("met") > F.when(same, F.col("given")).otherwise(0))
    total = F.col("total") - F.when(same, F.col("self")).otherwise(0.0)
    return out.select("cell_id", "code", (total / F.greatest(F.col("n") - F.coalesce(same.cast("int"), F.lit(0)), F.lit(1))).alias("share"))


def block_means_of(partitions: DataFrame, codes: DataFrame, *, normalize: bool = True) -> DataFrame:
    """block_means of coclustering, without its pairs: only the tallies of a cluster meet each other."""
    _, known, tallies, n_runs = _tallied(partitions, codes)
    left, right = (tallies.select("run", "label", F.col("code").alias(x), F.col("miss").alias(f"m{x}"), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    sums = left.join(right, ["run", "label"]).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb") / _kept(n_runs, normalize, "ma", "mb")).alias("s"))
    alone = known.groupBy("code", "miss", "given").agg(F.count(F.lit(1)).alias("n"))  # cells meet themselves too, where they are to count as 1
    own = F.col("n") * (1 - F.coalesce(F.col("given") / _kept(n_runs, normalize, "miss", "miss"), F.lit(0.0)))
    sizes = codes.filter("code >= 0").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    strays = sizes.join(known.groupBy("code").agg(F.count(F.lit(1)).alias("k")), "code", "left").select("code", (F.col("n") - F.coalesce("k", F.lit(0))).cast("double").alias("s"))
    diagonal = alone.select("code", own.alias("s")).union(strays).select(F.col("code").alias("a"), F.col("code").alias("b"), "s")
    total = sums.union(diagonal).groupBy("a", "b").agg(F.sum("s").alias("s"))
    na, nb = (sizes.select(F.col("code").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b"))
    return total.join(na, "a").join(nb, "b").select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("mean"))


def plateaus(scan: DataFrame, key: str = "n_clusters", at: str = "distance_threshold") -> DataFrame:
    """Stretches of a scan over which the cluster count stays: n_clusters, lo, hi, midpoint, width, n_points."""
    order = Window.orderBy(at)  # a scan has tens of points
    changed = (F.lag(key).over(order) != F.col(key)).cast("int")
    island = F.sum(F.coalesce(changed, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = scan.withColumn("__island", island).groupBy("__island", key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n_points"))
    return out.filter(F.col(key) > 1).select(
        F.col(key).alias("n_clusters"), "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("midpoint"), (F.col("hi") - F.col("lo")).alias("width"), "n_points"
    )


def grain_coverage(summary: DataFrame, **window) -> DataFrame:
    """Runs and (graph, k) axes within a window beside all of them, and a verdict."""
    cond = F.lit(True)
    for key, value in window.items():
        column, _, edge = key.rpartition("_")
        cond &= F.col(column) >= value if edge == "min" else F.col(column) <= value
    axis = F.struct("graph_type", "n_neighbors")
    out = summary.agg(
        F.count(F.lit(1)).alias("n_runs_total"),
        F.sum(cond.cast("long")).alias("n_runs_in_window"),
        F.countDistinct(axis).alias("n_axes_total"),
        F.countDistinct(F.when(cond, axis)).alias("n_axes_in_window"),
    )
    verdict = (
        F.when(F.col("n_runs_in_window") == 0, "empty")
        .when(F.col("n_runs_in_window") < 10, "thin")
        .when((F.col("n_axes_in_window") == 1) & (F.col("n_axes_total") > 1), "un-marginalised")
        .when(F.col("n_axes_in_window") * 2 < F.col("n_axes_total"), "lopsided")
        .otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


# hierarchy, on the driver: the reference's own bound on cells applies


def linkage(similarity: np.ndarray, method: str = "average", most: int = 25_000) -> np.ndarray:
    """Merges (left, right, height, size) of max - similarity by the nearest-neighbour chain; refuses over `most` cells."""
    n = len(similarity)
    if n > most:
        raise ValueError(f"{n} cells: a linkage would hold {n * n * 8 / 1e9:.1f} GB")
    d = similarity.max() - similarity if n else np.zeros((0, 0))
    d = np.array(d, np.float64)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((a, b, d[a, b]))
        if method == "average":
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        else:
            new = np.minimum(d[a], d[b]) if method == "single" else np.maximum(d[a], d[b])
        d[b], d[:, b] = new, new
        d[b, b] = np.inf
        size[b] += size[a]
        alive[a] = False
    return _ordered(merges, n)


def _ordered(merges: list, n: int) -> np.ndarray:
    """Merges of slots (a, b, height) by height, as rows (left, right, height, size) of cluster numbers."""
    order = sorted(range(len(merges)), key=lambda k: merges[k][2])
    parent, name, count, out = list(range(n)), list(range(n)), [1] * n, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, which in enumerate(order):
        a, b, h = merges[which]
        a, b = find(a), find(b)
        total = count[a] + count[b]
        out.append((min(name[a], name[b]), max(name[a], name[b]), h, total))
        parent[a] = b
        name[b], count[b] = n + k, total
    return np.array(out, np.float64).reshape(-1, 4)


#: Numbers in the tables of linkage_of, beyond which it takes the matrix.
MOST_TABLE = 1 << 22


def label_matrix(partitions: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cell ids and their labels (cells, runs) on the driver: -1 where a run left a cell out, -2 where it has no row."""
    rows = partitions.select("cell_id", "run", F.when(F.col("label") < 0, -1).otherwise(F.col("label")).cast("long").alias("label")).filter("label IS NOT NULL").toArrow()
    ids, cell = np.unique(rows.column("cell_id").to_numpy(), return_inverse=True)
    runs, run = np.unique(rows.column("run").to_numpy(), return_inverse=True)
    labels = np.full((len(ids), len(runs)), -2, np.int64)
    labels[cell, run] = rows.column("label").to_numpy()
    return ids, labels


def linkage_of(labels: np.ndarray) -> np.ndarray:
    """Average linkage of co-clustering from the labels (cells, runs), without a matrix of cells.

    The co-clustering of two clusters is a sum over their members of meetings by the runs that kept both; a table of a
    cluster's members by run, label and left-out runs gives that of every cell with it. So a step of the
    nearest-neighbour chain takes cells * runs numbers, and the memory does too. Sums are whole numbers where they fit,
    so ties are ties. Takes the matrix, and refuses over its cells, where the runs leave out cells in too many ways.
    """
    n, n_runs = labels.shape
    out, pattern = np.unique(labels == -1, axis=0, return_inverse=True)
    pattern = pattern.ravel()
    kept = n_runs - (out[:, None, :] | out[None, :, :]).sum(2) if len(out) ** 2 * n_runs <= 16 * MOST_TABLE else None
    codes, width = np.empty((n_runs, n), np.int64), 0
    for r in range(n_runs):
        found, short = np.unique(labels[:, r], return_inverse=True)
        codes[r] = np.where(labels[:, r] < 0, -1, short.ravel() + width)
        width += len(found)
    if n < 2:
        return np.zeros((0, 4))
    if kept is None or len(out) ** 2 > MOST_TABLE or len(out) * (width + 1) > MOST_TABLE:
        return linkage(_matrix(labels))
    scale = math.lcm(*[int(k) for k in np.unique(kept) if k > 0]) if n else 1
    scale = scale if scale * n_runs * n * n < 2**53 else 1
    weight = np.where(kept > 0, scale / np.maximum(kept, 1), 0.0)
    place = pattern * (width + 1) + np.where(codes < 0, width, codes)  # the last column stays zero
    parts, run = [], 0  # runs that few cells tell apart are looked up together
    while run < n_runs:
        upto, found = run + 1, np.unique(place[run : run + 1], axis=1, return_inverse=True)
        while upto < n_runs:
            wider = np.unique(place[run : upto + 1], axis=1, return_inverse=True)
            if wider[0].shape[1] > max(64, n // 8):
                break
            upto, found = upto + 1, wider
        parts.append((found[0], found[1].ravel().astype(np.int32)))
        run = upto
    owner, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)
    gone = np.zeros(n)  # -inf for what was merged away
    members = [np.array([i]) for i in range(n)]
    merges: list = []
    chain: list = []
    lowest = 0
    while len(merges) < n - 1:
        if not chain:
            while not alive[lowest]:
                lowest += 1
            chain.append(lowest)
        while True:
            a = chain[-1]
            counts = np.bincount(place[:, members[a]].ravel(), minlength=len(out) * (width + 1)).reshape(len(out), width + 1)
            table = weight @ counts
            table[:, width] = 0
            table = np.rint(table).ravel() if scale > 1 else table.ravel()
            total = table[parts[0][0]].sum(0)[parts[0][1]]
            for rows, which in parts[1:]:
                total += table[rows].sum(0)[which]
            met = np.bincount(owner, total, n)
            met += gone
            met /= size
            met[a] = -np.inf
            b = int(met.argmax())
            if len(chain) > 1 and met[chain[-2]] >= met[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((a, b, 1.0 - met[b] / (scale * size[a])))
        owner[members[a]] = b
        members[b] = np.concatenate((members[b], members[a]))
        members[a] = members[a][:0]
        size[b] += size[a]
        alive[a], gone[a] = False, -np.inf
    return _ordered(merges, n)


def _matrix(labels: np.ndarray, most: int = 25_000) -> np.ndarray:
    """Co-clustering of all cells, with unit diagonal; refuses over `most` cells."""
    n = len(labels)
    if n > most:
        raise ValueError(f"{n} cells: a matrix would hold {n * n * 8 / 1e9:.1f} GB")
    m, out = np.eye(n), labels == -1
    for i in range(n):
        kept = labels.shape[1] - (out[i] | out).sum(1)
        m[i] = ((labels[i] == labels) & (labels >= 0)).sum(1) / np.maximum(kept, 1)
    np.fill_diagonal(m, 1.0)
    return m


def cut(merges: np.ndarray, n: int, height: float, min_size: int = 1) -> np.ndarray:
    """Codes of the clusters below a height; smaller ones are -1, the rest numbered by their first cell."""
    parent = np.arange(n + len(merges))
    for k, (a, b, h, _) in enumerate(merges):
        if h <= height:
            parent[int(a)] = parent[int(b)] = n + k
    for k in range(len(parent) - 1, -1, -1):
        parent[k] = parent[parent[k]]
    root = parent[:n]
    _, first, inverse, counts = np.unique(root, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(first), np.int64)
    kept = counts >= min_size
    order = np.argsort(np.where(kept, first, n))
    rank[order] = np.arange(len(order))
    return np.where(kept[inverse], rank[inverse], -1)


def threshold_scan(merges: np.ndarray, n: int, heights: np.ndarray, min_size: int = 1) -> pd.DataFrame:
    rows = []
    for h in heights:
        codes = cut(merges, n, h, min_size)
        sizes = np.bincount(codes[codes >= 0]) if (codes >= 0).any() else np.zeros(0, int)
        rows.append((float(h), len(sizes), int(sizes.sum()), int(n - sizes.sum()), int(sizes.max(initial=0)), float(np.median(sizes)) if len(sizes) else 0.0))
    names = ["distance_threshold", "n_clusters", "n_assigned", "n_unassigned", "largest_cluster", "median_cluster_size"]
    return pd.DataFrame(rows, columns=names)


def merge_table(merges: np.ndarray, n: int, top: float = 1.0) -> pd.DataFrame:
    size = lambda x: 1 if x < n else int(merges[int(x) - n, 3])
    rows = [(k, n + k, int(a), int(b), size(a), size(b), int(s), h, top - h) for k, (a, b, h, s) in enumerate(merges)]
    return pd.DataFrame(rows, columns=["merge", "cluster_id", "left", "right", "left_size", "right_size", "n_cells", "height", "coclustering_frequency"])


def dense(pairs: DataFrame, ids: list) -> np.ndarray:
    """The pair table as a matrix with unit diagonal; over 25,000 cells it refuses before it collects a pair."""
    if len(ids) > 25_000:
        raise ValueError(f"{len(ids)} cells: a matrix would hold {len(ids) ** 2 * 8 / 1e9:.1f} GB")
    at = {x: k for k, x in enumerate(ids)}
    m = np.eye(len(ids))
    pdf = pairs.toPandas()
    i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf["freq"]
    return m


# Leiden


def leiden(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0, min_size: int = 1) -> np.ndarray:
    """Communities of an undirected graph by modularity with resolution: local moves, refinement, aggregation."""
    rng = np.random.default_rng(seed)
    total = 2 * w.sum()
    if not total:
        return np.arange(n) if min_size <= 1 else np.full(n, -1)
    member = np.arange(n)
    while True:
        size = int(max(a.max(initial=0), b.max(initial=0))) + 1 if len(a) else len(np.unique(member))
        size = max(size, int(member.max()) + 1)
        src, dst, ww = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w))
        order = np.argsort(src, kind="stable")
        src, dst, ww = src[order], dst[order], ww[order]
        starts = np.searchsorted(src, np.arange(size + 1))
        degree = np.bincount(src, ww, size)
        code = _moved(np.arange(size), None, starts, dst, ww, degree, resolution, total, rng)
        refined = _moved(np.arange(size), code, starts, dst, ww, degree, resolution, total, rng)
        if len(np.unique(refined)) == size:
            if len(np.unique(code)) == size:
                break
            refined = code
        _, refined = np.unique(refined, return_inverse=True)
        member = refined[member]
        ra, rb = np.minimum(refined[a], refined[b]), np.maximum(refined[a], refined[b])
        keys, inverse = np.unique(ra * (refined.max() + 1) + rb, return_inverse=True)
        w = np.bincount(inverse, w)
        a, b = keys // (refined.max() + 1), keys % (refined.max() + 1)
    sizes = np.bincount(member)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return np.where(sizes[member] >= min_size, rank[member], -1)


def _moved(code, within, starts, dst, w, degree, resolution, total, rng) -> np.ndarray:
    """Move nodes to the neighbouring community of most gain until none gains; within: only inside these communities."""
    code = code.copy()
    mass = np.bincount(code, degree, len(code)).astype(np.float64)
    queue = rng.permutation(len(code)).tolist()
    waiting = np.ones(len(code), bool)
    at = 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting[v] = False
        near, weight = dst[starts[v] : starts[v + 1]], w[starts[v] : starts[v + 1]]
        ok = near != v
        if within is not None:
            ok &= within[near] == within[v]
        near, weight = near[ok], weight[ok]
        if not len(near):
            continue
        own = code[v]
        mass[own] -= degree[v]
        options, inverse = np.unique(np.append(code[near], own), return_inverse=True)
        links = np.bincount(inverse, np.append(weight, 0.0))
        gain = links - resolution * degree[v] * mass[options] / total
        best = options[gain.argmax()] if gain.max() > gain[options == own][0] + 1e-12 else own
        mass[best] += degree[v]
        if best != own:
            code[v] = best
            for u in near[code[near] != best].tolist():
                if not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return code


def modularity(codes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0) -> float:
    total = w.sum()
    degree = np.bincount(a, w, len(codes)) + np.bincount(b, w, len(codes))
    mass = np.bincount(codes, degree)
    return float((w[codes[a] == codes[b]].sum()) / total - resolution * ((mass / (2 * total)) ** 2).sum())


def leiden_runs(graphs: DataFrame, runs: DataFrame, seed: int = 0, min_size: int = 1) -> DataFrame:
    """(cell_id, run, label): one Leiden run a row of runs, side by side.

    graphs: (graph, a, b, weight) with few graphs, in which a cell without neighbours has an edge to itself of weight
    0; runs: (run, graph, resolution) and the run's own seed, where they have that column. A run is one task: as in
    any library of this kind a single graph must fit in a worker.
    """
    kind = graphs.schema["a"].dataType.simpleString()
    own = F.col("seed") if "seed" in runs.columns else F.lit(seed) + F.col("run")
    table = runs.select("run", "graph", "resolution", own.alias("seed")).join(graphs, "graph").select("run", "resolution", "seed", "a", "b", "weight")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        run = int(pdf["run"].iloc[0])
        pdf = pdf.sort_values(["a", "b"])  # the order of the rows shall not matter
        everyone, at = np.unique(np.concatenate((pdf["a"].to_numpy(), pdf["b"].to_numpy())), return_inverse=True)
        a, b, w = at[: len(pdf)], at[len(pdf) :], pdf["weight"].to_numpy(np.float64)
        real = w > 0
        codes = leiden(len(everyone), a[real], b[real], w[real], float(pdf["resolution"].iloc[0]), int(pdf["seed"].iloc[0]), min_size)
        return pd.DataFrame({"cell_id": everyone, "run": run, "label": codes})

    return table.groupBy("run").applyInPandas(one, f"cell_id {kind}, run long, label long")


def axis_stability(partitions: DataFrame, summary: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("graph_type",)) -> DataFrame:
    """ARI of each run against a reference (cell_id, code), by setting."""
    from tessella.operators.agreement import agreement

    table = partitions.join(reference, "cell_id").groupBy("run", F.col("label").alias("a_id"), F.col("code").alias("b_id")).agg(F.count(F.lit(1)).alias("n"))
    scored = agreement(table, ["run"]).select("run", "ari").join(summary, "run")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.percentile("n_clusters", 0.5).alias("median_clusters"), F.avg("ari").alias("mean_ari"),
        F.percentile("ari", 0.5).alias("median_ari"), F.min("ari").alias("min_ari"), F.max("ari").alias("max_ari"),
    )


def merge_support(partitions: DataFrame, bands: DataFrame, sides: DataFrame) -> DataFrame:
    """(merge, band, support): share of a band's runs in which both sides of a merge have one modal label.

    bands: (run, band); sides: (merge, side, cell_id), side 0 or 1. Ties of the mode go to the lowest label;
    unassigned cells do not count, and a run in which a side has no label does not agree.
    """
    votes = partitions.filter("label >= 0").join(sides, "cell_id").groupBy("merge", "run", "side", "label").agg(F.count(F.lit(1)).alias("n"))
    modal = votes.groupBy("merge", "run", "side").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m")).select("merge", "run", (-F.col("m.l")).alias("l"))
    agreed = modal.groupBy("merge", "run").agg(((F.count(F.lit(1)) == 2) & (F.min("l") == F.max("l"))).cast("double").alias("agree"))
    every = sides.select("merge").distinct().crossJoin(F.broadcast(bands))  # at most a few hundred merges by a run table
    return every.join(agreed, ["merge", "run"], "left").groupBy("merge", "band").agg(F.avg(F.coalesce("agree", F.lit(0.0))).alias("support"))


def merge_verdicts(support: DataFrame) -> DataFrame:
    low, high = F.min("support"), F.max("support")
    return support.groupBy("merge").agg(F.when(high <= 0.5, "unsupported").when(low > 0.5, "all-band").otherwise("fine-only").alias("verdict"))
