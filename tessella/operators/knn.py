"""Nearest neighbours, neighbour graphs and label reads over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.staging import cut_lineage

#: Bytes of the reference's vectors that one broadcast may hold.
BROADCAST_BYTES = 200 << 20


#: Candidates of a query row that are measured at once.
PORTION = 4096


def _best(q: np.ndarray, ids: np.ndarray, ref: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of these reference rows nearest to q, by (dist, id), measured in portions."""
    near, dist = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(rows), PORTION):
        some = rows[at : at + PORTION]
        near, dist = np.concatenate((near, some)), np.concatenate((dist, np.sqrt(((ref[some] - q) ** 2).sum(1))))
        order = np.lexsort((ids[near], dist))[:k]
        near, dist = near[order], dist[order]
    return near, dist


def _kernel(ids: np.ndarray, ref: np.ndarray, k: int, exclude_self: bool):
    squares = (ref**2).sum(1)
    unit = 4 * (ref.shape[1] + 8) * np.finfo(np.float64).eps  # rounding of both forms of a squared distance, as a share of the squared norms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                own, q = some["id"].to_numpy(), np.array(some["vec"].tolist(), np.float64).reshape(len(some), -1)
                d = (1 - unit) * ((q**2).sum(1)[:, None] + squares) - 2 * q @ ref.T  # bounds from below
                if exclude_self:
                    d[own[:, None] == ids] = np.inf
                take = min(len(ids), k + 8)
                near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(own), 1))
                exact = np.sqrt(((ref[near] - q[:, None, :]) ** 2).sum(2))
                exact[np.isinf(np.take_along_axis(d, near, 1))] = np.inf
                order = np.lexsort((ids[near], exact), axis=1)[:, :k]
                cut = np.take_along_axis(d, near, 1).max(1)  # what was left out is no nearer than this
                near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
                if take < len(ids):
                    # The cut loses nothing where the bounds left out pass the k-th distance; elsewhere all rows below it are measured, ties too.
                    reach = exact[:, -1] ** 2 * (1 + unit)
                    for r in np.flatnonzero(~(cut > reach)):
                        found, dist = _best(q[r], ids, ref, np.flatnonzero(np.isfinite(d[r]) & (d[r] <= reach[r])), k)
                        near[r, : len(found)], exact[r, : len(found)], exact[r, len(found) :] = found, dist, np.inf
                ok = np.isfinite(exact)
                rank = np.broadcast_to(np.arange(1, near.shape[1] + 1), near.shape)
                src = np.broadcast_to(own[:, None], near.shape)
                yield pd.DataFrame({"src": src[ok], "dst": ids[near][ok], "dist": exact[ok], "rank": rank[ok].astype(np.int32)})

    return run


#: Columns of vectors up to which boxes of reference rows are worth while, reference rows beyond which, and rows of a box.
TREE_WIDTH, TREE_ROWS, LEAF = 4, 2048, 256


def _boxes(ref: np.ndarray) -> list[np.ndarray]:
    """Rows in boxes of up to LEAF, by medians of the widest column."""
    out, waiting = [], [np.arange(len(ref))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        x = ref[rows]
        column = x[:, int(np.ptp(x, axis=0).argmax())]
        order = np.argpartition(column, len(rows) // 2)
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _tree_kernel(ids: np.ndarray, ref: np.ndarray, k: int, exclude_self: bool):
    """_kernel for few columns. Equal queries are asked once; of equal reference rows, the k + 1 of lowest id can be
    among the k nearest; boxes that lie farther than a query's k nearest so far are passed over. Exact, ties by id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = k + exclude_self
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        order = np.lexsort((rank, *ref.T))
        new = np.r_[True, (ref[order][1:] != ref[order][:-1]).any(1)]
        place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        kept = order[place < most]
        own, at, low = ids[kept], ref[kept], rank[kept]
        boxes = _boxes(at)
        least, last = (np.array([f(at[b], axis=0) for b in boxes]) for f in (np.min, np.max))

        def nearest(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places and distances (queries, most) of the best of these rows; infinite where there are fewer."""
            d = np.sqrt(((at[rows][None, :, :] - q[:, None, :]) ** 2).sum(2))
            limit = np.partition(d, most - 1, axis=1)[:, most - 1] if most < len(rows) else np.full(len(q), np.inf)
            which, column = np.nonzero(d <= limit[:, None])
            found = d[which, column]
            sort = np.lexsort((low[rows[column]], found, which))
            which, column, found = which[sort], column[sort], found[sort]
            nth = np.arange(len(which)) - np.searchsorted(which, which)
            ok = nth < most
            near, dist = np.zeros((len(q), most), np.int64), np.full((len(q), most), np.inf)
            near[which[ok], nth[ok]], dist[which[ok], nth[ok]] = rows[column[ok]], found[ok]
            return near, dist

        for pdf in batches:
            for start in range(0, len(pdf), 4096):
                some = pdf.iloc[start : start + 4096]
                asked = some["id"].to_numpy()
                q, back = np.unique(np.array(some["vec"].tolist(), np.float64).reshape(len(some), -1), axis=0, return_inverse=True)
                gap = np.zeros((len(q), len(boxes)))
                for c in range(q.shape[1]):
                    gap += np.maximum(np.maximum(least[:, c] - q[:, c, None], q[:, c, None] - last[:, c]), 0) ** 2
                gap = np.sqrt(gap) * (1 - 1e-12)
                home = gap.argmin(1)
                near, dist = np.zeros((len(q), most), np.int64), np.full((len(q), most), np.inf)
                group = np.argsort(home, kind="stable")
                for rows in np.split(group, np.flatnonzero(np.diff(home[group])) + 1):
                    for part in range(0, len(rows), 64):
                        few = rows[part : part + 64]
                        _, first = nearest(q[few], boxes[home[few[0]]])
                        wanted = np.flatnonzero((gap[few] <= first[:, -1:]).any(0))
                        near[few], dist[few] = nearest(q[few], np.concatenate([boxes[w] for w in wanted]) if len(wanted) else boxes[home[few[0]]])
                near, dist = near[back.ravel()], dist[back.ravel()]
                if exclude_self:
                    mine = (own[near] == asked[:, None]) & np.isfinite(dist)
                    shift = np.argsort(mine, axis=1, kind="stable")[:, :k]
                    near, dist = np.take_along_axis(near, shift, 1), np.take_along_axis(dist, shift, 1)
                ok = np.isfinite(dist)
                nth = np.broadcast_to(np.arange(1, near.shape[1] + 1, dtype=np.int32), near.shape)
                yield pd.DataFrame({"src": np.broadcast_to(asked[:, None], near.shape)[ok], "dst": own[near][ok], "dist": dist[ok], "rank": nth[ok]})

    return run


def knn(query: DataFrame, ref: DataFrame, k: int, id_col: str = "cell_id", vec_col: str = "features", *, exclude_self: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(src, dst, dist, rank): the k nearest reference rows of each query row, ties by id.

    The size of the reference decides the way. Within broadcast_bytes it goes to every task once, and vectors of few
    columns are looked up in boxes there. Beyond, rows are dealt
    to the cells of pivots, and a query meets only the cells that may hold a nearer row than its k nearest so far. Both
    ways are exact.
    """
    kind = ref.schema[id_col].dataType.simpleString()
    schema = f"src {kind}, dst {kind}, dist double, rank int"
    rows = ref.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    asked = query.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return query.sparkSession.createDataFrame([], schema)
    if n * width * 8 <= broadcast_bytes:
        held = rows.toArrow().combine_chunks()
        names = held.column("id").to_numpy()
        vectors = held.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width)
        few = width <= TREE_WIDTH and n > TREE_ROWS and np.isfinite(vectors).all()
        return asked.mapInPandas((_tree_kernel if few else _kernel)(names, vectors, k, exclude_self), schema)
    return _by_cells(asked, rows, k, n, max(k + 1, broadcast_bytes // (16 * width)), exclude_self, schema)


class Pivots:
    """A few reference rows that the others are dealt to. Distances to them have a bound on their rounding."""

    def __init__(self, points: np.ndarray):
        self.centre = points.mean(0)  # vectors far from the origin would lose their digits
        self.points = points - self.centre
        self.squares = (self.points**2).sum(1)
        self.unit = 4 * (points.shape[1] + 8) * np.finfo(np.float64).eps
        self.slack = 1e-6 * float(np.sqrt(self.squares.max(initial=0)))  # beyond what rounding can do to a choice of cell

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows, pivots)."""
        y = x - self.centre
        norm = (y**2).sum(1)[:, None] + self.squares
        d2, slack = norm - 2 * y @ self.points.T, self.unit * norm
        return np.sqrt(np.maximum(d2 - slack, 0)), np.sqrt(np.maximum(d2, 0) + slack)


def _by_cells(asked: DataFrame, rows: DataFrame, k: int, n: int, block: int, exclude_self: bool, schema: str, most_pivots: int = 4096) -> DataFrame:
    """Rows meet by cells of pivots. A query's own cell bounds the distance of its k-th neighbour; a cell whose rows are
    all farther, by the triangle inequality, is passed over. Cells of over `block` rows are split, and so are the queries
    that ask one cell: no task holds more than a block of each. The driver holds most_pivots rows and counts."""
    spark = rows.sparkSession
    pivots = rows.orderBy(F.xxhash64("id"), "id").limit(min(most_pivots, 2 * -(-n // block))).toPandas()
    pivots = Pivots(np.array(pivots["vec"].tolist(), np.float64))
    kind = rows.schema["id"].dataType.simpleString()

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                _, high = pivots.distances(np.array(some["vec"].tolist(), np.float64))
                cell = high.argmin(1)
                yield some.assign(cell=cell.astype(np.int32), reach=high[np.arange(len(some)), cell])

    placed = f"id {kind}, vec array<double>, cell int, reach double"
    held = cut_lineage(rows.withColumn("vec", F.col("vec").cast("array<double>")).mapInPandas(dealt, placed))
    queries = cut_lineage(asked.withColumn("vec", F.col("vec").cast("array<double>")).mapInPandas(dealt, placed))
    cells = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).toPandas()  # a row a pivot
    radius = np.full(len(pivots.points), -np.inf)
    radius[cells["cell"]] = cells["radius"]
    parts = dict(zip(cells["cell"].tolist(), (-(-cells["n"] // block)).tolist(), strict=True))

    def meet(some: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(ref):
            return pd.DataFrame({"src": [], "dst": [], "dist": [], "rank": []})
        near = _kernel(ref["id"].to_numpy(), np.array(ref["vec"].tolist(), np.float64), k, exclude_self)
        return pd.concat(list(near(iter([some[["id", "vec"]]]))))

    def met(pairs: DataFrame) -> DataFrame:
        """Candidates of (id, vec, cell) from these cells, k of each block."""
        waiting = {r["cell"]: -(-r["n"] // block) for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
        table = spark.createDataFrame([(int(c), int(parts.get(c, 0)), int(waiting.get(c, 0))) for c in set(parts) | set(waiting)], "cell int, parts int, groups int")
        few = F.broadcast(table)
        left = pairs.join(few, "cell").filter("parts > 0").withColumn("g", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = held.join(few, "cell").filter("groups > 0").withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
        right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        return left.select("id", "vec", "cell", "g", "b").groupBy("cell", "g", "b").cogroup(right.select("id", "vec", "cell", "g", "b").groupBy("cell", "g", "b")).applyInPandas(meet, schema)

    best = Window.partitionBy("src").orderBy("dist", "dst")
    top = lambda x: x.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = cut_lineage(top(met(queries.select("id", "vec", "cell"))))
    bound = first.filter(F.col("rank") == k).select(F.col("src").alias("id"), F.col("dist").alias("bound"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                low, _ = pivots.distances(np.array(some["vec"].tolist(), np.float64))
                own, limit = some["cell"].to_numpy(), some["bound"].fillna(np.inf).to_numpy()
                # a row of another cell is nearer to that cell's pivot than to the query's, and within its radius
                least = np.maximum(low - radius, (low - some["reach"].to_numpy()[:, None]) / 2)
                wanted = (least <= limit[:, None] * (1 + 1e-9) + pivots.slack) & np.isfinite(radius)
                wanted[np.arange(len(some)), own] = False
                yield pd.DataFrame({"id": some["id"], "vec": some["vec"], "cells": [np.flatnonzero(w).astype(np.int32) for w in wanted]})

    more = cut_lineage(queries.join(bound, "id", "left").mapInPandas(others, f"id {kind}, vec array<double>, cells array<int>"))
    second = met(more.select("id", "vec", F.explode("cells").alias("cell")))
    return top(first.drop("rank").unionByName(second.drop("rank"))).select("src", "dst", "dist", F.col("rank").cast("int").alias("rank"))


def mutual_fraction(edges: DataFrame) -> DataFrame:
    """Share of a row's neighbours that name it back: (src, mutual_fraction)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("hit"))
    return edges.join(back, ["src", "dst"], "left").groupBy("src").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("mutual_fraction"))


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})


def knn_graph(edges: DataFrame, *, mutual_only: bool = False) -> DataFrame:
    """(a, b): union of the directed edges, or those found from both ends."""
    out = _undirected(edges).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return (out.filter("n = 2") if mutual_only else out).select("a", "b")


def distance_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight): exp(-d / mean d of the row), the larger of both directions; a row of zero distances weighs 1."""
    mean = F.avg("dist").over(Window.partitionBy("src"))
    w = F.when(mean > 0, F.exp(-F.col("dist") / mean)).otherwise(1.0)
    return _undirected(edges.withColumn("w", w)).groupBy("a", "b").agg(F.max("w").alias("weight"))


def fuzzy_weights(edges: DataFrame, *, steps: int = 64, tolerance: float = 1e-5) -> DataFrame:
    """(a, b, weight): memberships exp(-(d - rho) / sigma) with sum log2(k), joined as a + b - ab. k distances a row are gathered, no more."""

    @F.pandas_udf("array<double>")
    def members(rows: pd.Series) -> pd.Series:
        out = []
        for d in rows:
            d = np.asarray(d, np.float64)
            positive = d[d > 0]
            rho, target, lo, hi, sigma = positive.min() if len(positive) else 0.0, np.log2(len(d)), 0.0, np.inf, 1.0
            for _ in range(steps):
                total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
                if abs(total - target) < tolerance:
                    break
                if total > target:
                    hi, sigma = sigma, (lo + sigma) / 2
                else:
                    lo, sigma = sigma, sigma * 2 if np.isinf(hi) else (sigma + hi) / 2
            sigma = max(sigma, 1e-3 * d.mean(), 1e-300)
            out.append(np.exp(-np.maximum(d - rho, 0) / sigma))
        return pd.Series(out)

    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("near"))
    rows = rows.withColumn("w", members(F.transform("near", lambda x: x["dist"])))
    each = rows.select("src", F.explode(F.arrays_zip(F.transform("near", lambda x: x["dst"]).alias("dst"), F.col("w"))).alias("x"))
    each = _undirected(each.select("src", F.col("x.dst").alias("dst"), F.col("x.w").alias("w")))
    return each.groupBy("a", "b").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("weight"))


def jaccard_weights(edges: DataFrame, *, prune: float = 0.0) -> DataFrame:
    """(a, b, weight): Jaccard share of closed neighbourhoods on neighbour edges, those over prune."""
    hoods = edges.groupBy("src").agg(F.collect_set("dst").alias("near")).select("src", F.array_union("near", F.array("src")).alias("near"))
    pairs = knn_graph(edges)
    left, right = (hoods.select(F.col("src").alias(s), F.col("near").alias(f"n{s}")) for s in ("a", "b"))
    share = F.size(F.array_intersect("na", "nb")) / F.size(F.array_union("na", "nb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", share.alias("weight")).filter(F.col("weight") > prune)


def with_codes(edges: DataFrame, codes: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """Edges with the code of both ends: own, other (-1 where a label is missing)."""
    own = codes.select(F.col(id_col).alias("src"), F.col("code").alias("own"))
    other = codes.select(F.col(id_col).alias("dst"), F.col("code").alias("other"))
    return edges.join(own, "src", "left").join(other, "dst", "left").fillna(-1, ["own", "other"])


def purity(edges: DataFrame, codes: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """Share of neighbours with the own code; -1 counts as a code."""
    return with_codes(edges, codes, id_col).groupBy("src").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("purity"))


def triage(edges: DataFrame, codes: DataFrame, *, majority: float = 0.5, id_col: str = "cell_id") -> DataFrame:
    """Own share among assigned neighbours, the strongest other code and a verdict: own, other, mixed or unassigned."""
    votes = with_codes(edges, codes, id_col).filter("other >= 0").groupBy("src", "own", "other").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("src"))
    shares = votes.withColumn("share", F.col("n") / total)
    per = shares.groupBy("src", "own").agg(
        F.coalesce(F.max(F.when(F.col("own") == F.col("other"), F.col("share"))), F.lit(0.0)).alias("own_fraction"),
        F.max(F.when(F.col("own") != F.col("other"), F.struct("share", -F.col("other")))).alias("top"),
    )
    cells = edges.select("src").distinct().join(codes.select(F.col(id_col).alias("src"), F.col("code").alias("code")), "src", "left")
    out = cells.join(per.drop("own"), "src", "left")
    other = F.coalesce(F.col("top.share"), F.lit(0.0))
    verdict = (
        F.when(F.coalesce("code", F.lit(-1)) < 0, "unassigned").when(F.col("own_fraction") > majority, "own").when(other > majority, "other").otherwise("mixed")
    )
    return out.select(
        "src", F.coalesce("code", F.lit(-1)).alias("code"), F.coalesce("own_fraction", F.lit(0.0)).alias("own_fraction"),
        (-F.col("top.col2")).alias("top_other"), other.alias("top_other_fraction"), verdict.alias("verdict"),
    )


def shares(edges: DataFrame, codes: DataFrame, *, weights: str = "uniform", id_col: str = "cell_id") -> DataFrame:
    """(src, code, share): the normalised votes of each row's labelled neighbours."""
    voted = edges.join(codes.filter("code >= 0").select(F.col(id_col).alias("dst"), "code"), "dst")
    if weights == "distance":
        middle = edges.filter("dist > 0").agg(F.percentile("dist", 0.5)).first()[0] or 1.0
        w = 1 / (F.col("dist") + 1e-3 * middle)
    else:
        w = F.lit(1.0)
    tally = voted.groupBy("src", "code").agg(F.sum(w).alias("v"))
    return tally.select("src", "code", (F.col("v") / F.sum("v").over(Window.partitionBy("src"))).alias("share"))


def vote(edges: DataFrame, codes: DataFrame, *, weights: str = "uniform", min_confidence: float | None = None, id_col: str = "cell_id") -> DataFrame:
    """(src, code, confidence): the code with most votes of labelled neighbours, ties to the lowest; -1 without votes or below min_confidence."""
    per = shares(edges, codes, weights=weights, id_col=id_col)
    best = per.groupBy("src").agg(F.max(F.struct("share", (-F.col("code")).alias("c"))).alias("best"))
    out = edges.select("src").distinct().join(best, "src", "left")
    confidence = F.coalesce(F.col("best.share"), F.lit(0.0))
    code = F.coalesce(-F.col("best.c"), F.lit(-1))
    if min_confidence is not None:
        code = F.when(confidence >= min_confidence, code).otherwise(-1)
    return out.select("src", code.alias("code"), confidence.alias("confidence"))
