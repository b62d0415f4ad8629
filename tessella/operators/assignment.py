"""Conformal assignment of cells to reference classes, and classifiers carried across datasets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import validate as va
from tessella.operators.labels import Label, LabelSet
from tessella.sources.staging import cut_lineage


@dataclass
class Assignment:
    """p-values (cell_id, class_id, p_value) of every cell and class, probabilities beside them where they could be made."""

    p_values: DataFrame
    class_ids: list[int]
    reference: LabelSet
    calibration_counts: dict[int, int] = field(default_factory=dict)
    probabilities: DataFrame | None = None
    name: str = "assign"
    mask: str | None = None
    params: dict = field(default_factory=dict)

    @property
    def cell_ids(self) -> DataFrame:
        return self.p_values.select("cell_id").distinct()

    @property
    def class_names(self) -> list[str]:
        return [self.reference.meta[c].name if c in self.reference.meta else str(c) for c in self.class_ids]

    def prediction_set(self, alpha: float = 0.1) -> DataFrame:
        """(cell_id, class_id, inside): inside where p > alpha."""
        return self.p_values.select("cell_id", "class_id", (F.col("p_value") > alpha).alias("inside"))

    def set_sizes(self, alpha: float = 0.1) -> DataFrame:
        return va.prediction_sets(self.p_values, alpha).select("cell_id", "set_size")

    def plausibility(self) -> DataFrame:
        return self.p_values.groupBy("cell_id").agg(F.max("p_value").alias("plausibility"))

    def to_labelset(self, alpha: float = 0.1, *, name: str | None = None) -> LabelSet:
        """Cells whose set holds one class; the rest are unassigned."""
        codes = va.prediction_sets(self.p_values, alpha).select("cell_id", F.col("assigned").cast("long").alias("code"))
        meta = {k: Label(v.name, v.color, v.description) for k, v in self.reference.meta.items()}
        return LabelSet(codes, meta, name or self.name)

    def frame(self, *, alpha: float | None = None) -> DataFrame:
        """A row a cell: p_<class>, prob_<class>, plausibility; with alpha also set_size and the assigned class."""
        each = [F.max(F.when(F.col("class_id") == c, F.col("p_value"))).alias(f"p_{n}") for c, n in zip(self.class_ids, self.class_names, strict=True)]
        out = self.p_values.groupBy("cell_id").agg(*each, F.max("p_value").alias("plausibility"))
        if self.probabilities is not None:
            probs = [F.max(F.when(F.col("class_id") == c, F.col("prob"))).alias(f"prob_{n}") for c, n in zip(self.class_ids, self.class_names, strict=True)]
            out = out.join(self.probabilities.groupBy("cell_id").agg(*probs), "cell_id", "left")
        if alpha is not None:
            out = out.join(va.prediction_sets(self.p_values, alpha).select("cell_id", "set_size", "assigned"), "cell_id")
        return out

    def coverage(self, alpha: float = 0.1) -> DataFrame:
        """(class, n_reference, n_calibration, coverage) over the reference cells."""
        truth = self.reference.fact.filter("code >= 0").select(F.col(self.reference.id_col).alias("cell_id"), "code")
        spark = truth.sparkSession
        counts = spark.createDataFrame([(int(k), int(v)) for k, v in self.calibration_counts.items()] or [(-1, 0)], "class long, n_calibration long")
        return va.coverage(self.p_values, truth, alpha).join(counts, "class", "left").fillna(0, ["n_calibration"]).select("class", "n_reference", "n_calibration", "coverage")


def calibration_split(codes: DataFrame, fraction: float = 0.25, seed: int = 0) -> DataFrame:
    """(cell_id, code, calibration) of labelled rows: a share of each class, one at least and one left, by a seeded hash; classes of one row are left out."""
    if not 0 < fraction < 1:
        raise ValueError("the calibration fraction lies between 0 and 1")
    known = codes.filter("code >= 0")
    sizes = known.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id"))
    wanted = F.least(F.greatest(F.round(F.col("n") * fraction), F.lit(1)), F.col("n") - 1)
    return known.withColumn("place", place).join(F.broadcast(sizes), "code").select("cell_id", "code", (F.col("place") <= wanted).alias("calibration"))


def platt(scores: DataFrame, truth: DataFrame, class_ids: list[int]) -> DataFrame:
    """(cell_id, class_id, prob): each class's score through a sigmoid fitted on calibration rows, normalised over classes.

    scores: (cell_id, class_id, score = 1 - probability) of all rows; truth: (cell_id, code) of the calibration rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    made = []
    for c in class_ids:
        own = scores.filter(F.col("class_id") == c)
        rows = own.join(truth, "cell_id").select(array_to_vector(F.array(1 - F.col("score"))).alias("x"), (F.col("code") == c).cast("double").alias("y"))
        if rows.agg(F.min("y") == F.max("y")).first()[0]:
            raise ValueError(f"calibration rows of class {c} alone, or of none")
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-6, standardization=False).fit(rows)
        z = float(model.coefficients[0]) * (1 - F.col("score")) + float(model.intercept)
        made.append(own.select("cell_id", "class_id", (1 / (1 + F.exp(-z))).alias("prob")))
    every = reduce(lambda a, b: a.unionByName(b), made)
    return every.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy("cell_id")))


def assigned(
    rows: DataFrame, reference: LabelSet, *, fraction: float = 0.25, mondrian: bool = True, covariates: DataFrame | None = None, names: list[str] | None = None, seed: int = 0, name: str = "assign"
) -> Assignment:
    """Split-conformal p-values of rows (cell_id, features, code): a forest on one part of the reference, ranks among the other.

    With covariates (cell_id, names...) calibration rows weigh by how likely their covariates are among all rows.
    Probabilities are left out where a class has too few calibration rows to fit a sigmoid.
    """
    rows = cut_lineage(rows)
    split = cut_lineage(calibration_split(rows.select("cell_id", "code"), fraction, seed))
    counts = {r["code"]: r["n"] for r in split.filter("calibration").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    classes = sorted(counts)
    if len(classes) < 2 or sum(counts.values()) < 2:
        raise ValueError("an assignment needs two classes of two reference cells")
    train = rows.drop("code").join(split.filter(~F.col("calibration")).select("cell_id", "code"), "cell_id")
    scores = cut_lineage(va.class_scores(train, rows, seed=seed).filter(F.col("class_id").isin(classes)))
    truth = split.filter("calibration").select("cell_id", "code")
    own = scores.join(truth, "cell_id").filter("class_id = code").drop("code")
    if covariates is not None:
        weights = cut_lineage(va.density_ratio_weights(covariates.join(truth.select("cell_id"), "cell_id"), covariates, list(names)))
        target = weights.filter("target").select("cell_id", "weight")
        p = va.weighted_p_values(own.join(weights.filter(~F.col("target")).select("cell_id", "weight"), "cell_id"), scores.join(target, "cell_id"))
    else:
        calibration = own if mondrian else own.select("cell_id", "score", F.explode(F.array(*[F.lit(c).cast("long") for c in classes])).alias("class_id"))
        p = va.conformal_p_values(calibration.select("class_id", "score"), scores)
    try:
        probabilities = platt(scores, truth, classes)
    except ValueError:
        probabilities = None
    params = {"calibration_fraction": fraction, "mondrian": mondrian, "shift_covariates": names, "seed": seed}
    return Assignment(p, classes, reference, {int(k): int(v) for k, v in counts.items()}, probabilities, name, params=params)


def pinball_fit(x: np.ndarray, y: np.ndarray, level: float, rounds: int = 200) -> np.ndarray:
    """Linear quantile regression: argmin of the pinball loss, by iteratively reweighted least squares."""
    w, eps = np.linalg.lstsq(x, y, rcond=None)[0], 1e-6
    for _ in range(rounds):
        r = y - x @ w
        weight = np.where(r >= 0, level, 1 - level) / np.maximum(np.abs(r), eps)
        new = np.linalg.lstsq(x * np.sqrt(weight)[:, None], y * np.sqrt(weight), rcond=None)[0]
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def conditional_prediction_set(calibration: DataFrame, test: DataFrame, covariates: list[str], *, alpha: float = 0.1, most: int = 50_000) -> DataFrame:
    """(cell_id, class_id, inside): classes whose score is below a quantile that is linear in the covariates.

    calibration: (score of the true class, covariates...); test: (cell_id, class_id, score, covariates...). The 1 - alpha
    quantile of the calibration scores is fitted on [1, covariates], on at most `most` rows drawn by a hash (a
    parameter); each test row counts itself in the level, (1 - alpha)(1 + 1/m).
    """
    columns = [F.col(c).cast("double").alias(c) for c in covariates]
    rows = calibration.select(F.col("score").cast("double").alias("score"), *columns)
    pdf = rows.orderBy(F.xxhash64("score", *covariates)).limit(most).toPandas()
    if len(pdf) <= len(covariates) + 1:
        raise ValueError("too few calibration rows for these covariates")
    x = np.column_stack((np.ones(len(pdf)), pdf[covariates].to_numpy()))
    w = pinball_fit(x, pdf["score"].to_numpy(), min(1.0, (1 - alpha) * (1 + 1 / len(pdf))))
    bound = reduce(lambda a, b: a + b, (F.col(c).cast("double") * float(v) for c, v in zip(covariates, w[1:], strict=True)), F.lit(float(w[0])))
    return test.select("cell_id", "class_id", (F.col("score") <= bound).alias("inside"))


@dataclass
class TransferScore:
    """A classifier trained on one dataset's labels, read on another's: (cell_id, truth, predicted), all names."""

    scored: DataFrame
    train_classes: list[str]
    train: str
    test: str

    @property
    def n_cells(self) -> int:
        return self.scored.count()

    @property
    def shared(self) -> DataFrame:
        """(cell_id, shared): whether the classifier could have said the truth."""
        return self.scored.select("cell_id", F.col("truth").isin(self.train_classes).alias("shared"))

    @property
    def accuracy(self) -> float:
        got = self.scored.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double"))).first()[0]
        return float("nan") if got is None else got

    @property
    def accuracy_shared(self) -> float:
        got = self.scored.filter(F.col("truth").isin(self.train_classes)).agg(F.avg((F.col("truth") == F.col("predicted")).cast("double"))).first()[0]
        return float("nan") if got is None else got

    def confusion(self) -> DataFrame:
        return va.confusion(self.scored).withColumnRenamed("n", "n_cells")

    def by_label(self) -> DataFrame:
        """(truth, n_cells, in_train, recall, top_prediction, top_fraction); the first name where predictions tie."""
        counts = self.scored.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
        top = Window.partitionBy("truth").orderBy(F.desc("n"), "predicted")
        first = counts.withColumn("r", F.row_number().over(top))
        out = first.groupBy("truth").agg(
            F.sum("n").alias("n_cells"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"),
            F.max(F.when(F.col("r") == 1, F.col("predicted"))).alias("top_prediction"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("top"),
        )
        share = lambda c: F.col(c) / F.col("n_cells")
        return out.select("truth", "n_cells", F.col("truth").isin(self.train_classes).alias("in_train"), share("hit").alias("recall"), "top_prediction", share("top").alias("top_fraction"))


def cross_dataset_classification(rows: DataFrame, *, train: str, test: str, seed: int = 0) -> TransferScore:
    """A forest on the labelled rows of one dataset, asked about those of another: rows (cell_id, features, label, dataset), labels null where unknown."""
    if train == test:
        raise ValueError("train and test are one dataset")
    known = rows.filter(F.col("label").isNotNull() & F.col("dataset").isin(train, test))
    counts = {r["dataset"]: r["n"] for r in known.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).collect()}
    if bad := [x for x in (train, test) if not counts.get(x)]:
        raise ValueError(f"no labelled rows in {bad}")
    labels = LabelSet.from_labels(known.filter(F.col("dataset") == train), "label")
    fit = known.filter(F.col("dataset") == train).select("cell_id", "features").join(labels.fact, "cell_id")
    asked = known.filter(F.col("dataset") == test)
    scores = va.class_scores(fit, asked, seed=seed)
    best = scores.groupBy("cell_id").agg(F.min(F.struct("score", "class_id")).alias("b")).select("cell_id", F.col("b.class_id").alias("code"))
    names = labels.dimension().select(F.col("id").alias("code"), F.col("name").alias("predicted"))
    scored = asked.select("cell_id", F.col("label").cast("string").alias("truth")).join(best, "cell_id").join(F.broadcast(names), "code").select("cell_id", "truth", "predicted")
    return TransferScore(cut_lineage(scored), sorted(v.name for v in labels.meta.values()), train, test)
