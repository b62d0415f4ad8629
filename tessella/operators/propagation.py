"""Labels carried to cells without one, with the confidence and the recovery read that go with them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import knn as kn
from tessella.operators import transfer as tr
from tessella.operators.labels import Label, LabelSet
from tessella.sources.staging import cut_lineage


@dataclass
class Recovery:
    """How a method finds reference labels again that were withheld from it: (cell_id, truth, predicted), -1 where it abstains."""

    scored: DataFrame
    estimator: str = "leave-one-out"
    names: dict[int, str] = field(default_factory=dict)

    def _shares(self) -> tuple[float, float]:
        hit = (F.col("truth") == F.col("predicted")).cast("double")
        row = self.scored.agg(F.avg(hit), F.avg((F.col("predicted") < 0).cast("double"))).first()
        return (float("nan"), float("nan")) if row[0] is None else (row[0], row[1])

    @property
    def agreement(self) -> float:
        return self._shares()[0]

    @property
    def abstained(self) -> float:
        return self._shares()[1]

    @property
    def misassigned(self) -> float:
        agreement, abstained = self._shares()
        return max(0.0, 1 - agreement - abstained)

    def by_label(self) -> DataFrame:
        return tr.recovery_by_label(self.scored)

    def confusion(self) -> DataFrame:
        """Labels by what they were recovered as, `abstained` last."""
        named = lambda c: F.coalesce(_name_of(self.names, c), c.cast("string"))
        rows = self.scored.select(
            named(F.col("truth")).alias("label"), F.when(F.col("predicted") < 0, "abstained").otherwise(named(F.col("predicted"))).alias("recovered_as")
        )
        table = rows.groupBy("label").pivot("recovered_as").count().fillna(0)
        columns = sorted(c for c in table.columns if c not in ("label", "abstained"))
        return table.select("label", *[f"`{c}`" for c in columns], *(["abstained"] if "abstained" in table.columns else []))


def _name_of(names: dict[int, str], code):
    if not names:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (int(k), v)]), code.cast("int"))


@dataclass
class Propagation:
    """A propagated label set, the confidence of each cell, and the recovery read of the method."""

    labels: LabelSet
    reference: LabelSet
    confidence: DataFrame
    recovery: Recovery | None = None
    method: str = "vote"
    n_neighbors: int = 30
    space: str = "scaled"
    params: dict = field(default_factory=dict)
    rungs: DataFrame | None = None
    rung_names: list[str] | None = None
    rung_recovery: dict[str, Recovery] | None = None

    def frame(self) -> DataFrame:
        """(id, name, <name>_id, <name>_confidence)."""
        own = self.labels.to_frame()
        key = self.labels.id_col
        return own.join(self.confidence.select(F.col("cell_id").alias(key), F.col("confidence").alias(f"{self.labels.name}_confidence")), key, "left")

    def self_agreement(self) -> float:
        return float("nan") if self.recovery is None else self.recovery.agreement

    def n_reference(self) -> int:
        return self.reference.fact.filter("code >= 0").count()


def stratified_folds(codes: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """(cell_id, code, fold) of labelled rows: each class is dealt round, in the order of a seeded hash, going on where the class before stopped."""
    known = codes.filter("code >= 0")
    sizes = known.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a class
    starts = sizes.select("code", start.alias("start"))
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id")) - 1
    return known.withColumn("place", place).join(F.broadcast(starts), "code").select("cell_id", "code", ((F.col("start") + F.col("place")) % folds).cast("int").alias("fold"))


def _decided(asked: DataFrame, votes: DataFrame, *, preserve: bool, min_confidence: float | None) -> DataFrame:
    """(cell_id, code, confidence) of asked (cell_id, code) from normalised votes (src, code, share)."""
    best = votes.groupBy(F.col("src").alias("cell_id")).agg(F.max(F.struct("share", (-F.col("code")).alias("c"))).alias("b"))
    own = votes.select(F.col("src").alias("cell_id"), "code", F.col("share").alias("own"))
    x = asked.select("cell_id", "code").join(best, "cell_id", "left").join(own, ["cell_id", "code"], "left")
    kept = F.col("code") >= 0 if preserve else F.lit(False)
    sure = F.coalesce("b.share", F.lit(0.0))
    new = -F.col("b.c") if min_confidence is None else F.when(sure >= min_confidence, -F.col("b.c"))
    code = F.when(kept, F.col("code")).otherwise(F.coalesce(new, F.lit(-1))).cast("long")
    return x.select("cell_id", code.alias("code"), F.when(kept, F.coalesce("own", F.lit(0.0))).otherwise(sure).alias("confidence"))


def propagate_knn(rows: DataFrame, *, k: int = 30, weights: str = "uniform", preserve: bool = True, min_confidence: float | None = None, folds: int = 0, seed: int = 0) -> tuple[DataFrame, Recovery]:
    """((cell_id, code, confidence), recovery) of rows (cell_id, features, code): votes of the k nearest labelled rows, itself excluded."""
    rows = cut_lineage(rows)
    reference = rows.filter("code >= 0")
    n = reference.count()
    if n < 2:
        raise ValueError("a vote needs two labelled rows")
    if preserve and rows.filter("code < 0").isEmpty():
        raise ValueError("every row is labelled already")
    k = min(k, n - 1)
    votes = cut_lineage(kn.shares(kn.knn(rows, reference, k), reference, weights=weights))
    out = _decided(rows, votes, preserve=preserve, min_confidence=min_confidence)
    if folds < 2:
        again = _decided(reference.withColumn("code", F.lit(-1)), votes, preserve=False, min_confidence=None)
        scored = reference.select("cell_id", F.col("code").alias("truth")).join(again.select("cell_id", F.col("code").alias("predicted")), "cell_id")
        return out, Recovery(scored)
    dealt = cut_lineage(reference.join(stratified_folds(reference.select("cell_id", "code"), folds, seed).select("cell_id", "fold"), "cell_id"))
    parts = []
    for j in range(folds):
        kept, asked = dealt.filter(F.col("fold") != j), dealt.filter(F.col("fold") == j)
        m = kept.count()
        if m and not asked.isEmpty():
            found = kn.shares(kn.knn(asked, kept, min(k, m)), kept, weights=weights)
            again = _decided(asked.withColumn("code", F.lit(-1)), found, preserve=False, min_confidence=None)
            parts.append(asked.select("cell_id", F.col("code").alias("truth")).join(again.select("cell_id", F.col("code").alias("predicted")), "cell_id"))
    return out, Recovery(reduce(lambda a, b: a.unionByName(b), parts), f"{folds}-fold")


def propagate_spread(
    rows: DataFrame, *, k: int = 30, mutual: bool = True, preserve: bool = True, alpha: float = 0.8, min_confidence: float | None = None, folds: int = 5, seed: int = 0
) -> tuple[DataFrame, Recovery | None]:
    """((cell_id, code, confidence), recovery): labels diffused over the neighbour graph of all rows (cell_id, features, code)."""
    rows = cut_lineage(rows)
    n = rows.count()
    step = cut_lineage(tr.transition(kn.knn(rows, rows, min(k, n - 1)), mutual=mutual))
    codes = rows.select("cell_id", "code")
    out = tr.spread(step, codes, clamp=preserve, alpha=alpha)
    if min_confidence is not None:
        given = codes.select("cell_id", (F.col("code") >= 0).alias("given"))
        cut = F.when((F.col("given") & F.lit(preserve)) | (F.col("confidence") >= min_confidence), F.col("code")).otherwise(-1)
        out = out.join(given, "cell_id").select("cell_id", cut.alias("code"), "confidence")
    if folds < 2:
        return out, None
    dealt = cut_lineage(codes.join(stratified_folds(codes, folds, seed).select("cell_id", "fold"), "cell_id", "left"))
    parts = []
    for j in range(folds):
        held = F.coalesce(F.col("fold") == j, F.lit(False))
        found = tr.spread(step, dealt.select("cell_id", F.when(held, -1).otherwise(F.col("code")).cast("long").alias("code")), clamp=preserve, alpha=alpha)
        parts.append(dealt.filter(held).select("cell_id", F.col("code").alias("truth")).join(found.select("cell_id", F.col("code").alias("predicted")), "cell_id"))
    return out, Recovery(cut_lineage(reduce(lambda a, b: a.unionByName(b), parts)), f"{folds}-fold")


def named(codes: DataFrame, reference: LabelSet, name: str, id_col: str = "cell_id") -> LabelSet:
    """Codes of new cells under the identities of a reference."""
    meta = {k: Label(v.name, v.color, v.description) for k, v in reference.meta.items()}
    return LabelSet(codes.select(F.col("cell_id").alias(id_col), F.col("code").cast("long").alias("code")), meta, name, id_col)
