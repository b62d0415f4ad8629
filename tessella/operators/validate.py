"""Validation reads: purity against an audit, paired recovery, stability, conformal assignment."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.quantiles import running_total
from tessella.operators.knn import vote
from tessella.sources.staging import cut_lineage


#: Classes that a classifier is trained for.
MOST_CLASSES = 1000


def label_purity(codes: DataFrame, audit: DataFrame) -> DataFrame:
    """Per cluster of (cell_id, code) against (cell_id, audit): dominant audit label (ties by name), purity over known, null count."""
    x = codes.filter("code >= 0").join(audit, "cell_id", "left").groupBy("code", "audit").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("audit").isNotNull()
    top = Window.partitionBy("code").orderBy(F.desc(known), F.desc("n"), "audit")
    x = x.withColumn("r", F.row_number().over(top))
    out = x.groupBy(F.col("code").alias("cluster")).agg(
        F.sum("n").alias("n_cells"),
        F.sum(known.cast("long")).alias("n_audit_labels"),
        F.max(F.when((F.col("r") == 1) & known, F.col("audit"))).alias("dominant"),
        F.max(F.when((F.col("r") == 1) & known, F.col("n"))).alias("top"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("n_audit_null"),
    )
    return out.select("cluster", "n_cells", "n_audit_labels", "dominant", (F.col("top") / (F.col("n_cells") - F.col("n_audit_null"))).alias("purity"), "n_audit_null")


def confusion(scored: DataFrame) -> DataFrame:
    """(truth, predicted, n, fraction within truth)."""
    counts = scored.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def paired_recovery(correct: DataFrame) -> DataFrame:
    """McNemar's exact test of each pair of representations over (name, cell_id, correct, weight)."""
    a = correct.select("cell_id", F.col("name").alias("a"), F.col("correct").cast("int").alias("ca"), "weight")
    b = correct.select("cell_id", F.col("name").alias("b"), F.col("correct").cast("int").alias("cb"))
    x = a.join(b, "cell_id").filter("a < b").groupBy("a", "b").agg(
        F.avg("ca").alias("accuracy_a"), F.avg("cb").alias("accuracy_b"),
        (F.sum(F.col("weight") * (F.col("cb") - F.col("ca"))) / F.sum("weight")).alias("delta_accuracy_ipw"),
        F.sum(((F.col("ca") == 1) & (F.col("cb") == 0)).cast("long")).alias("n_correct_a_only"),
        F.sum(((F.col("ca") == 0) & (F.col("cb") == 1)).cast("long")).alias("n_correct_b_only"),
    )
    p = F.udf(lambda u, v: binomial_p(u, v), "double")  # one row a pair of representations
    return x.select("a", "b", "accuracy_a", "accuracy_b", (F.col("accuracy_b") - F.col("accuracy_a")).alias("delta_accuracy"), "delta_accuracy_ipw", "n_correct_a_only", "n_correct_b_only", (F.col("n_correct_a_only") + F.col("n_correct_b_only")).alias("n_discordant"), p("n_correct_a_only", "n_correct_b_only").alias("mcnemar_p"))


def binomial_p(a: int, b: int) -> float:
    """Two-sided exact p of a of a + b under one half."""
    n, k = a + b, min(a, b)
    if not n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * sum(math.exp(log(i)) for i in range(k + 1)) - (math.exp(log(k)) if 2 * k == n else 0))


def path_recovery(graph: DataFrame, truth: DataFrame, *, k: int = 15, cost: str = "neg_log", max_sources: int | None = 2000, seed: int = 0) -> DataFrame:
    """(cell_id, truth, predicted, correct): labels read off the k labelled cells nearest along a graph (a, b, weight).

    Path costs are -ln(weight) or 1 - weight ("complement"), hops where the graph has no weight. Labelled cells beyond
    max_sources are sampled by a hash; the sample both asks and votes; None takes all. A cell that reaches no other abstains: -1.
    All sources advance together; paths longer than a source's k-th nearest labelled cell so far are given up, which
    loses none of the k nearest, as costs are never negative.
    """
    if cost not in ("neg_log", "complement"):
        raise ValueError(cost)
    labelled = truth.filter("code >= 0").select("cell_id", "code")
    n = labelled.count()
    if n < 3:
        raise ValueError("paths need three labelled cells")
    if max_sources is not None and n > max_sources:
        labelled, n = labelled.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(max_sources), max_sources
    labelled = cut_lineage(labelled)
    k = min(k, n - 1)
    price = F.lit(1.0)
    if "weight" in graph.columns:
        price = -F.log(F.greatest("weight", F.lit(1e-12))) if cost == "neg_log" else 1 - F.col("weight")
    one = graph.select("a", "b", F.greatest(price, F.lit(0.0)).alias("c"))
    steps = cut_lineage(one.select(F.col("a").alias("node"), F.col("b").alias("to"), "c").unionByName(one.select(F.col("b").alias("node"), F.col("a").alias("to"), "c")))
    ends = labelled.select(F.col("cell_id").alias("node"), F.lit(True).alias("end"))
    known = labelled.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh"))
    kth = Window.partitionBy("src", "ends").orderBy("d", "node")
    while known.filter("fresh").limit(1).count():
        moved = known.filter("fresh").join(steps, "node").select("src", F.col("to").alias("node"), (F.col("d") + F.col("c")).alias("d"), F.lit(True).alias("fresh"))
        x = known.withColumn("fresh", F.lit(False)).unionByName(moved).groupBy("src", "node").agg(F.min(F.struct("d", "fresh")).alias("m")).select("src", "node", "m.*")
        x = x.join(ends, "node", "left").withColumn("ends", F.coalesce("end", F.lit(False)) & (F.col("src") != F.col("node"))).withColumn("r", F.row_number().over(kth))
        bound = F.max(F.when(F.col("ends") & (F.col("r") == k), F.col("d"))).over(Window.partitionBy("src"))
        known = cut_lineage(x.withColumn("bound", bound).filter("bound IS NULL OR d <= bound").select("src", "node", "d", "fresh"))
    near = known.filter("src <> node").join(ends, "node").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d", "node")))
    edges = near.filter(F.col("rank") <= k).select("src", F.col("node").alias("dst"), F.col("d").alias("dist"), "rank")
    read = vote(edges, labelled).select(F.col("src").alias("cell_id"), F.col("code").alias("predicted"))
    out = labelled.withColumnRenamed("code", "truth").join(read, "cell_id", "left").fillna(-1, ["predicted"])
    return out.withColumn("correct", F.col("truth") == F.col("predicted"))


def retention(reference: DataFrame, drawn: DataFrame) -> DataFrame:
    """(cell_id, kept): share of a cell's reference cluster-mates in the draw that stayed with it."""
    x = reference.filter("code >= 0").select("cell_id", F.col("code").alias("r")).join(drawn.select("cell_id", F.col("code").alias("d")), "cell_id")
    own = Window.partitionBy("r")
    counted = x.groupBy("r", "d").agg(F.count(F.lit(1)).alias("both"))
    counted = counted.withColumn("all", F.sum("both").over(own))
    out = x.join(counted, ["r", "d"])
    kept = F.when(F.col("d") < 0, 0.0).when(F.col("all") > 1, (F.col("both") - 1) / (F.col("all") - 1))
    return out.select("cell_id", kept.alias("kept"))


def conformal_p_values(calibration: DataFrame, test: DataFrame) -> DataFrame:
    """Class-conditional p-values (count of calibration scores >= t, plus 1) / (m + 1).

    calibration: (class_id, score) of rows of that class; test: (cell_id, class_id, score). Scores are nonconformities.
    Distinct scores are counted once a class; a running count from above gives every test row its p-value.
    """
    n = calibration.groupBy("class_id", "score").agg(F.count(F.lit(1)).alias("n"))
    asked = test.select("class_id", "score").distinct().withColumn("n", F.lit(0).cast("long"))
    points = n.unionByName(asked).groupBy("class_id", "score").agg(F.sum("n").alias("n"))
    above = running_total(points, ["class_id"], "score", "n", "above", descending=True).drop("n")
    total = n.groupBy("class_id").agg(F.sum("n").alias("m"))
    x = test.join(above, ["class_id", "score"]).join(total, "class_id", "left").fillna(0, ["m"])
    return x.select("cell_id", "class_id", ((F.col("above") + 1) / (F.col("m") + 1)).alias("p_value"))


def weighted_p_values(calibration: DataFrame, test: DataFrame) -> DataFrame:
    """Class-conditional p-values under shift: (weight of calibration scores >= t, plus the row's own) over (all weight of the class, plus its own).

    calibration: (class_id, score, weight); test: (cell_id, class_id, score, weight). A class without calibration rows gives 1.
    """
    mass = calibration.groupBy("class_id", "score").agg(F.sum(F.col("weight").cast("double")).alias("w"))
    asked = test.select("class_id", "score").distinct().withColumn("w", F.lit(0.0))
    points = mass.unionByName(asked).groupBy("class_id", "score").agg(F.sum("w").alias("w"))
    above = running_total(points, ["class_id"], "score", "w", "above", descending=True).drop("w")
    total = mass.groupBy("class_id").agg(F.sum("w").alias("all"))
    x = test.join(above, ["class_id", "score"]).join(total, "class_id", "left").fillna(0.0, ["all"])
    return x.select("cell_id", "class_id", ((F.col("above") + F.col("weight")) / (F.col("all") + F.col("weight"))).alias("p_value"))


def prediction_sets(p: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(cell_id, plausibility, set_size, classes, assigned): classes with p > alpha; a singleton is assigned, else -1."""
    inside = F.when(F.col("p_value") > alpha, F.col("class_id"))
    x = p.groupBy("cell_id").agg(F.max("p_value").alias("plausibility"), F.sort_array(F.collect_list(inside)).alias("classes"))  # one entry a class
    size = F.size("classes")
    return x.select("cell_id", "plausibility", size.alias("set_size"), "classes", F.when(size == 1, F.col("classes")[0]).otherwise(-1).alias("assigned"))


def coverage(p: DataFrame, truth: DataFrame, alpha: float = 0.1) -> DataFrame:
    x = p.join(truth, "cell_id").filter("class_id = code")
    return x.groupBy(F.col("class_id").alias("class")).agg(F.count(F.lit(1)).alias("n_reference"), F.avg((F.col("p_value") > alpha).cast("double")).alias("coverage"))


def class_scores(train: DataFrame, rows: DataFrame, vec_col: str = "features", label: str = "code", seed: int = 0):
    """(cell_id, class_id, score = 1 - probability) of a random forest trained on (features, code)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = lambda df: df.withColumn("__v", array_to_vector(vec_col))
    model = RandomForestClassifier(featuresCol="__v", labelCol=label, seed=seed, numTrees=50).fit(ready(train).withColumn(label, F.col(label).cast("double")))
    out = model.transform(ready(rows)).select("cell_id", F.posexplode(vector_to_array("probability")).alias("class_id", "prob"))
    return out.select("cell_id", F.col("class_id").cast("long").alias("class_id"), (1 - F.col("prob")).alias("score"))


def density_ratio_weights(calibration: DataFrame, target: DataFrame, covariates: list[str]) -> DataFrame:
    """(cell_id, target, weight): odds of being a target row, by a logistic regression on the covariates with unit ridge."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = array_to_vector(F.array(*[F.col(c).cast("double") for c in covariates])).alias("__v")
    both = calibration.select("cell_id", vec, F.lit(0.0).alias("__y")).unionByName(target.select("cell_id", vec, F.lit(1.0).alias("__y")))
    ridge = 1 / max(both.count(), 1)  # the loss is a mean, so that the penalty is one over all rows
    model = LogisticRegression(featuresCol="__v", labelCol="__y", maxIter=1000, regParam=ridge, standardization=False).fit(both)
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), vector_to_array("probability")[1]))
    return model.transform(both).select("cell_id", (F.col("__y") == 1).alias("target"), (p / (1 - p)).alias("weight"))


def crossfit_assessment(rows: DataFrame, *, folds: int = 5, mondrian: bool = True, seed: int = 0) -> DataFrame:
    """(cell_id, class_id, p_value) of (cell_id, features, code) for all rows and classes; code -1 has no label.

    Labelled rows are dealt into folds by a hash of their id. A labelled row is scored by the model that held its fold
    out and ranked against all other calibration rows; a row without label is scored by every fold's model, each
    judged by that fold's calibration rows. mondrian ranks within the class, otherwise against all classes.
    """
    x = rows.select("cell_id", "features", "code", F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(folds)).alias("fold"))
    classes = sorted(r["code"] for r in x.filter("code >= 0").select("code").distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"over {MOST_CLASSES} classes: a forest is not for them")
    if len(classes) < 2:
        raise ValueError("an assessment needs two classes")
    parts = []
    for j in range(folds):
        train = x.filter((F.col("code") >= 0) & (F.col("fold") != j))
        asked = x.filter((F.col("code") < 0) | (F.col("fold") == j))
        part = class_scores(train, asked, seed=seed).filter(F.col("class_id").isin(classes)).withColumn("fold", F.lit(j))
        # a forest that saw too few classes gives none of the last ones: they are as unlikely as can be
        every = asked.select("cell_id", F.explode(F.array(*[F.lit(c).cast("long") for c in classes])).alias("class_id"), F.lit(j).alias("fold"))
        parts.append(every.join(part, ["cell_id", "class_id", "fold"], "left").fillna(1.0, ["score"]))
    scores = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts).join(x.select("cell_id", "code"), "cell_id"))
    own = scores.filter("code = class_id")
    group = F.array("class_id") if mondrian else F.array(*[F.lit(c).cast("long") for c in classes])
    cal = own.select(F.explode(group).alias("class_id"), "fold", "score").groupBy("class_id", "fold", "score").agg(F.count(F.lit(1)).alias("n"))

    def above(asked: DataFrame, by: list[str]) -> DataFrame:
        """Calibration rows whose score is that of the row or higher, counted over distinct scores."""
        points = cal.groupBy(*by, "score").agg(F.sum("n").alias("n")).unionByName(asked.select(*by, "score").distinct().withColumn("n", F.lit(0).cast("long")))
        points = points.groupBy(*by, "score").agg(F.sum("n").alias("n"))
        return asked.join(running_total(points, by, "score", "n", "above", descending=True).drop("n"), [*by, "score"])

    total = cal.groupBy("class_id").agg(F.sum("n").alias("m"))
    inside = (F.col("code") == F.col("class_id")) if mondrian else F.lit(True)
    # outside its own class a row's calibration score differs from the score asked for; it counts itself if it is as high
    itself = own.select("cell_id", F.col("score").alias("own_score"))
    known = above(scores.filter("code >= 0"), ["class_id"]).join(itself, "cell_id").join(total, "class_id")
    counted = (inside & (F.col("own_score") >= F.col("score"))).cast("long")
    known = known.select("cell_id", "class_id", ((F.col("above") - counted + 1) / (F.col("m") - inside.cast("long") + 1)).alias("p_value"))
    new = above(scores.filter("code < 0"), ["class_id", "fold"]).groupBy("cell_id", "class_id").agg(F.sum("above").alias("above"))
    new = new.join(total, "class_id").select("cell_id", "class_id", ((F.col("above") + 1) / (F.col("m") + 1)).alias("p_value"))
    return known.unionByName(new)


def by_stratum(scored: DataFrame) -> DataFrame:
    """(stratum, n, accuracy, weight) of (stratum, correct, weight)."""
    return scored.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum("weight").alias("weight"))


def dip_statistic(values: np.ndarray) -> float:
    """Hartigan's dip: least distance of the empirical distribution from a unimodal one, by greatest convex minorants and least concave majorants."""
    x = np.sort(np.asarray(values, np.float64))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 0.5 / max(n, 1)
    lo, hi = 0, n - 1
    ecdf = np.arange(1, n + 1)
    best = 1.0
    while True:
        gcm, lcm = _hull(x, ecdf, lo, hi, 1), _hull(x, ecdf, lo, hi, -1)
        g = np.interp(x[lo : hi + 1], x[gcm], ecdf[gcm])
        u = np.interp(x[lo : hi + 1], x[lcm], ecdf[lcm])
        at = np.unique(np.concatenate((gcm, lcm)))
        gap = u[at - lo] - g[at - lo]
        d = gap.max()
        if d <= best:
            break
        k = at[gap.argmax()]
        new_lo, new_hi = gcm[gcm <= k].max(), lcm[lcm >= k].min()
        left = np.abs(g[: new_lo - lo + 1] - (ecdf[lo : new_lo + 1] - 1)).max(initial=0)
        right = np.abs((ecdf[new_hi : hi + 1]) - u[new_hi - lo :]).max(initial=0)
        best = max(best, left, right)
        if (new_lo, new_hi) == (lo, hi):
            break
        lo, hi = new_lo, new_hi
    return best / (2 * n)


def _hull(x: np.ndarray, y: np.ndarray, lo: int, hi: int, sign: int) -> np.ndarray:
    rest = np.arange(lo, hi + 1)
    while len(rest) > 2:  # what lies on or beyond the chord of its neighbours is no corner; most rows go so, all at once
        u, v = x[rest].astype(np.float64), y[rest].astype(np.float64)
        keep = np.ones(len(rest), bool)
        keep[1:-1] = sign * ((v[1:-1] - v[:-2]) * (u[2:] - u[:-2]) - (v[2:] - v[:-2]) * (u[1:-1] - u[:-2])) < 0
        gone = len(rest) - int(keep.sum())
        rest = rest[keep]
        if gone < len(rest) / 8:
            break
    out: list[int] = []
    for k in rest.tolist():
        while len(out) > 1 and sign * ((y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-2]]) - (y[k] - y[out[-2]]) * (x[out[-1]] - x[out[-2]])) >= 0:
            out.pop()
        out.append(k)
    return np.array(out)
