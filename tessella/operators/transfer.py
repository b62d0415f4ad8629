"""Label transfer: spreading over a graph, recovery, confidence curves, and bridges between two datasets."""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.quantiles import running_total
from tessella.functions.scalers import fit_scaler
from tessella.operators import knn as kn
from tessella.operators.frame import CellFrame
from tessella.operators.space import fit_space
from tessella.sources.staging import cut_lineage

#: One-sided verdicts of clusters whose image is clean.
PASSING = ("reproduces", "weak")


def transition(edges: DataFrame, *, mutual: bool = True) -> DataFrame:
    """Row-normalised affinity 1/(d + floor) over (mutual) neighbour edges: (src, dst, t)."""
    middle = edges.filter("dist > 0").agg(F.percentile("dist", 0.5)).first()[0] or 1.0
    if mutual:
        edges = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    w = 1 / (F.col("dist") + 1e-3 * middle)
    return edges.select("src", "dst", (w / F.sum(w).over(Window.partitionBy("src"))).alias("t"))


def spread(step: DataFrame, codes: DataFrame, *, clamp: bool = True, alpha: float = 0.8, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(cell_id, code, confidence): one-hot labels diffused over the transitions until they settle, then one step more.

    clamp keeps labelled rows at their label; otherwise each step mixes alpha of the neighbours with the labels.
    """
    seeds = codes.filter("code >= 0").select(F.col("cell_id").alias("src"), F.col("code").alias("c"), F.lit(1.0).alias("f"))
    step = cut_lineage(step)
    field = seeds

    def moved(field: DataFrame) -> DataFrame:
        there = field.select(F.col("src").alias("dst"), "c", "f")
        return step.join(there, "dst").groupBy("src", "c").agg(F.sum(F.col("t") * F.col("f")).alias("f"))

    for _ in range(most):
        new = moved(field)
        if clamp:
            new = new.join(seeds.select("src"), "src", "left_anti").unionByName(seeds)
        else:
            mixed = new.withColumn("f", F.col("f") * alpha).unionByName(seeds.withColumn("f", F.col("f") * (1 - alpha)))
            new = mixed.groupBy("src", "c").agg(F.sum("f").alias("f"))
        new = cut_lineage(new)
        change = new.join(field.withColumnRenamed("f", "g"), ["src", "c"], "full").agg(F.max(F.abs(F.coalesce("f", F.lit(0.0)) - F.coalesce("g", F.lit(0.0))))).first()[0]
        field = new
        if change is None or change < tolerance:
            break
    else:
        warnings.warn(f"labels had not settled after {most} rounds: the last change was {change:.2g}", stacklevel=2)
    support = moved(field)
    best = support.groupBy("src").agg(F.max(F.struct("f", (-F.col("c")).alias("c"))).alias("b"), F.sum("f").alias("total"))
    x = codes.join(best.withColumnRenamed("src", "cell_id"), "cell_id", "left")
    own = support.select(F.col("src").alias("cell_id"), F.col("c").alias("code"), F.col("f").alias("own"))
    x = x.join(own, ["cell_id", "code"], "left")
    given = F.col("code") >= 0 if clamp else F.lit(False)
    code = F.when(given, F.col("code")).otherwise(F.coalesce(-F.col("b.c"), F.lit(-1)))
    got = F.when(given, F.col("own")).otherwise(F.col("b.f")) / F.col("total")
    return x.select("cell_id", code.alias("code"), F.coalesce(got, F.lit(0.0)).alias("confidence"))


def confidence_curve(scored: DataFrame) -> DataFrame:
    """(cut, n_kept, kept_fraction, error_rate) at every distinct confidence of (truth, predicted, confidence), known truths only."""
    known = scored.filter("truth >= 0")
    per = known.groupBy(F.col("confidence").alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("truth") != F.col("predicted")).cast("long")).alias("wrong"))
    total = known.agg(F.count(F.lit(1)).alias("all"))
    per = per.withColumn("__one", F.lit(0))
    kept = running_total(per, ["__one"], "cut", "n", "n_kept", descending=True)
    x = running_total(kept, ["__one"], "cut", "wrong", "w", descending=True)
    return x.join(F.broadcast(total)).select("cut", "n_kept", (F.col("n_kept") / F.col("all")).alias("kept_fraction"), (F.col("w") / F.col("n_kept")).alias("error_rate"))


def recovery_by_label(scored: DataFrame) -> DataFrame:
    """Of (truth, predicted): n, recovered, abstained, the strongest confusion and its share."""
    counts = scored.filter("truth >= 0").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(F.col("truth").alias("label")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("predicted") < 0, F.col("n")).otherwise(0)).alias("lost"),
        F.max(F.when((F.col("predicted") >= 0) & (F.col("predicted") != F.col("truth")), F.struct("n", (-F.col("predicted")).alias("p")))).alias("top"),
    )
    return out.select("label", "n", (F.col("hit") / F.col("n")).alias("recovered"), (F.col("lost") / F.col("n")).alias("abstained"), (-F.col("top.p")).alias("top_confusion"), (F.col("top.n") / F.col("n")).alias("top_confusion_share"))


def propagate_ladder(
    frame: CellFrame, codes: DataFrame, ladder: list[str | list[str]], *, k: int = 30, weights: str = "uniform", pca: float | int | None = 0.95, preserve: bool = True, min_confidence: float | None = None
) -> DataFrame:
    """(cell_id, code, confidence, rung): each cell is labelled in the first feature set of the ladder that is valid for it.

    A rung is usable if two or more labelled cells are valid in it. Its scaler and space are fitted on the cells that
    vote in it (all labelled, valid ones) or are labelled by it. A cell without a rung has code, rung -1 and confidence 0.
    preserve keeps given labels, with their own share of the votes as confidence where the rung also labels others.
    """
    columns = [frame.resolve(c) for c in ladder]
    given = codes.select(F.col("cell_id").alias(frame.id_col), F.col("code").cast("long").alias("__code"))
    x = frame.df.join(given, frame.id_col, "left").fillna(-1, ["__code"])
    for i, cols in enumerate(columns):
        there = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]
        x = x.withColumn(f"__ok{i}", F.coalesce(reduce(lambda a, b: a & b, there, frame.fully_valid(cols)), F.lit(False)))
    counts = x.agg(*[F.count_if(F.col(f"__ok{i}") & (F.col("__code") >= 0)) for i in range(len(ladder))]).first()
    usable = [i for i in range(len(ladder)) if counts[i] >= 2]
    if not usable:
        raise ValueError("no rung of the ladder has two labelled, valid cells")
    x = x.withColumn("__rung", F.coalesce(*[F.when(F.col(f"__ok{i}"), i) for i in usable], F.lit(-1)))
    found = []
    for i in usable:
        voter, asked = F.col(f"__ok{i}") & (F.col("__code") >= 0), F.col("__rung") == i
        part = x.filter(voter | asked).select(F.col(frame.id_col).alias("cell_id"), F.col("__code").alias("code"), voter.alias("voter"), asked.alias("asked"), *columns[i])
        scaled = fit_scaler(part, columns[i], frame.rule, frame.transforms).apply(part)
        scaled = scaled.withColumn("features", F.array(*[F.col(c).cast("double") for c in columns[i]]))
        if pca is not None:
            at = fit_space(scaled, explained=pca).transform(scaled, "cell_id")
            scaled = part.join(at, "cell_id")
        voters, queried = scaled.filter("voter"), scaled.filter("asked")
        votes = kn.shares(kn.knn(queried, voters, min(k, counts[i] - 1)), voters, weights=weights)
        best = votes.groupBy(F.col("src").alias("cell_id")).agg(F.max(F.struct("share", (-F.col("code")).alias("c"))).alias("b"))
        own = votes.select(F.col("src").alias("cell_id"), "code", F.col("share").alias("own"))
        out = part.filter("asked").select("cell_id", "code").join(best, "cell_id", "left").join(own, ["cell_id", "code"], "left")
        others = part.filter("asked AND code < 0").limit(1).count() > 0
        kept = F.col("code") >= 0 if preserve else F.lit(False)
        sure = F.coalesce("b.share", F.lit(0.0))
        new = -F.col("b.c") if min_confidence is None else F.when(sure >= min_confidence, -F.col("b.c"))
        confidence = F.when(kept, F.coalesce("own", F.lit(0.0))).otherwise(sure) if others else sure
        found.append(out.select("cell_id", F.when(kept, F.col("code")).otherwise(F.coalesce(new, F.lit(-1))).alias("code"), confidence.alias("confidence"), F.lit(i).alias("rung")))
    alone = x.filter("__rung < 0").select(F.col(frame.id_col).alias("cell_id"), (F.col("__code") if preserve else F.lit(-1)).cast("long").alias("code"), F.lit(0.0).alias("confidence"), F.lit(-1).alias("rung"))
    return reduce(lambda a, b: a.unionByName(b), found, alone)


# bridges


def cross_votes(into: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """(tgt, src, w) of neighbour edges tgt -> src, those found from both sides where back (src -> tgt) is given, normalised by target."""
    edges = into.select(F.col("src").alias("tgt"), F.col("dst").alias("src"))
    if back is not None:
        edges = edges.join(back.select("src", F.col("dst").alias("tgt")), ["tgt", "src"], "left_semi")
    return edges.withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("tgt")))


def carry(votes: DataFrame, codes: DataFrame, targets: DataFrame, *, min_confidence: float | None = None) -> DataFrame:
    """(tgt, code, confidence) for each target: normalised votes of assigned neighbours; -1 abstains."""
    known = codes.filter("code >= 0").select(F.col("cell_id").alias("src"), "code")
    mass = votes.join(known, "src").groupBy("tgt", "code").agg(F.sum("w").alias("m"))
    best = mass.groupBy("tgt").agg(F.max(F.struct("m", (-F.col("code")).alias("c"))).alias("b"), F.sum("m").alias("total"))
    x = targets.select(F.col("cell_id").alias("tgt")).join(best, "tgt", "left")
    confidence = F.coalesce(F.col("b.m") / F.col("total"), F.lit(0.0))
    code = F.coalesce(-F.col("b.c"), F.lit(-1))
    if min_confidence is not None:
        code = F.when(confidence >= min_confidence, code).otherwise(-1)
    return x.select("tgt", code.alias("code"), confidence.alias("confidence"))


def carried_mass(votes: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(cluster, match, m): the votes of each source cluster that land in each target cluster, one vote a target."""
    known = source.filter("code >= 0").select(F.col("cell_id").alias("src"), F.col("code").alias("cluster"))
    there = target.filter("code >= 0").select(F.col("cell_id").alias("tgt"), F.col("code").alias("match"))
    share = votes.join(known, "src").withColumn("m", F.col("w") / F.sum("w").over(Window.partitionBy("tgt")))
    return share.join(there, "tgt").groupBy("cluster", "match").agg(F.sum("m").alias("m"))


def carried_purity(votes: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Per source cluster: image mass in the target, its best match and the share of the mass there."""
    sizes = source.filter("code >= 0").groupBy(F.col("code").alias("cluster")).agg(F.count(F.lit(1)).alias("n_cells"))
    per = carried_mass(votes, source, target).groupBy("cluster").agg(F.sum("m").alias("image_mass"), F.max(F.struct("m", (-F.col("match")).alias("c"))).alias("b"))
    x = sizes.join(per, "cluster", "left").fillna(0.0, ["image_mass"])
    enough = F.col("image_mass") >= F.greatest(F.lit(3.0), 0.1 * F.col("n_cells"))
    return x.select("cluster", "n_cells", "image_mass", (-F.col("b.c")).alias("best_match"), F.when(enough, F.col("b.m") / F.col("image_mass")).alias("purity"))


def verdicts(cross: DataFrame, ceiling: DataFrame, *, floor: float = 0.6, passes: float = 0.85, refutes: float = 0.7, small: int = 20) -> DataFrame:
    """One-sided verdict of each cluster from its carried purity and its ceiling."""
    x = cross.join(ceiling.select("cluster", F.col("purity").alias("ceiling_purity")), "cluster", "left").withColumn("efficiency", F.col("purity") / F.col("ceiling_purity"))
    verdict = (
        F.when(F.col("n_cells") < small, "small")
        .when(F.col("ceiling_purity").isNull() | (F.col("ceiling_purity") < floor), "unverifiable")
        .when(F.col("purity").isNull(), "absent")
        .when(F.col("efficiency") >= passes, "reproduces")
        .when(F.col("efficiency") < refutes, "refuted")
        .otherwise("weak")
    )
    return x.withColumn("verdict", verdict)


def mutual_verdicts(ab: DataFrame, ba: DataFrame, mass: DataFrame | None = None, *, passes: float = 0.85) -> DataFrame:
    """Two-sided verdicts of ab's clusters, with mutual and split_into.

    A cluster passes if its one-sided verdict is reproduces or weak. Passing clusters that are each other's best match
    reproduce where both do, else are weak; other passing ones are nested. Given mass = carried_mass(ab's side), a
    refuted cluster is split if two or more passing clusters across have it as their best match and together hold
    passes of its image, relative to its ceiling.
    """
    other = ba.select(F.col("cluster").alias("best_match"), F.col("best_match").alias("back"), F.col("verdict").alias("their"))
    x = ab.join(other, "best_match", "left").withColumn("mutual", F.coalesce(F.col("back") == F.col("cluster"), F.lit(False)))
    passing, they = F.col("verdict").isin(*PASSING), F.coalesce(F.col("their").isin(*PASSING), F.lit(False))
    both = (F.col("verdict") == "reproduces") & (F.col("their") == "reproduces")
    two = F.when(passing & F.col("mutual") & they, F.when(both, "reproduces").otherwise("weak")).when(passing, "nested").otherwise(F.col("verdict"))
    none = F.array().cast("array<bigint>")
    if mass is None:
        return x.withColumns({"verdict": two, "split_into": none}).drop("back", "their")
    parts = ba.filter(F.col("verdict").isin(*PASSING)).select(F.col("best_match").alias("cluster"), F.col("cluster").alias("match"))
    held = parts.join(mass, ["cluster", "match"], "left").groupBy("cluster").agg(F.sort_array(F.collect_list("match")).cast("array<bigint>").alias("parts"), F.sum("m").alias("held"))
    x = x.join(held, "cluster", "left")
    split = (F.col("verdict") == "refuted") & (F.size("parts") >= 2) & (F.col("held") / F.col("image_mass") / F.col("ceiling_purity") >= passes)
    split = F.coalesce(split, F.lit(False))
    return x.withColumns({"verdict": F.when(split, "split").otherwise(two), "split_into": F.when(split, F.col("parts")).otherwise(none)}).drop("back", "their", "parts", "held")


def anchors(ab: DataFrame, ba: DataFrame) -> DataFrame:
    """(kind, support, a, b, n_a, n_b, efficiency_ab, efficiency_ba) from the two-sided verdicts of both directions.

    one-to-one: mutual best matches that pass; split: one cluster and the parts across that cover it; nested: a
    passing cluster within one across of which it is not already a part. a and b are sorted lists of clusters.
    """

    def laid(df: DataFrame, flip: bool) -> DataFrame:
        one, two = ("b", "a") if flip else ("a", "b")
        here, there = ("efficiency_ba", "efficiency_ab") if flip else ("efficiency_ab", "efficiency_ba")
        names = {"own": one, "others": two, "n_own": f"n_{one}", "n_others": f"n_{two}", "e_own": here, "e_others": there}
        return df.select("kind", "support", *[F.col(k).alias(v) for k, v in names.items()])

    def side(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(F.col("cluster").alias("own"), F.col("n_cells").alias("n_own"), F.col("efficiency").alias("e_own"), "verdict", *keep)

    def across(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("cluster").alias(key), F.col("n_cells").alias("n_others"), F.col("efficiency").alias("e_others"))

    found = []
    for here, there, flip in ((ab, ba, False), (ba, ab, True)):
        parts = side(here, F.explode("split_into").alias("part")).join(across(there, "part"), "part")
        split = parts.groupBy("own", "n_own", "e_own").agg(F.sort_array(F.collect_list("part")).alias("others"), F.sum("n_others").alias("n_others"), F.avg("e_others").alias("e_others"))
        found.append(laid(split.withColumns({"own": F.array("own"), "kind": F.lit("split"), "support": F.lit("split")}), flip))
        matched = side(here, "best_match").join(across(there, "best_match"), "best_match")
        matched = matched.withColumns({"others": F.array("best_match"), "support": F.col("verdict")})
        if not flip:
            pairs = matched.filter(F.col("verdict").isin(*PASSING))
            found.append(laid(pairs.withColumns({"own": F.array("own"), "kind": F.lit("one-to-one")}), flip))
        counted = there.select(F.explode("split_into").alias("own"))
        nested = matched.filter("verdict = 'nested'").join(counted, "own", "left_anti").withColumns({"kind": F.lit("nested"), "e_others": F.lit(None).cast("double")})
        found.append(laid(nested.withColumn("own", F.array("own")), flip))
    return reduce(lambda x, y: x.unionByName(y), found)


def best_pairs(scores: DataFrame, by: str = "ami") -> DataFrame:
    """Run pairs that are best for at least one of their runs; ties to the lower run."""
    a = Window.partitionBy("run_a").orderBy(F.desc(by), "run_b")
    b = Window.partitionBy("run_b").orderBy(F.desc(by), "run_a")
    return scores.withColumns({"ra": F.row_number().over(a), "rb": F.row_number().over(b)}).filter("ra = 1 OR rb = 1").drop("ra", "rb")


def grain_curve(scores: DataFrame, *, metric: str = "ami", ratio: float = 1.25) -> DataFrame:
    """Mean and standard error of a metric in log-spaced bins of the grain sqrt(k_a * k_b)."""
    grain = F.sqrt(F.col("k_a") * F.col("k_b"))
    bin_ = F.round(F.log(grain) / float(np.log(ratio))).cast("long")
    out = scores.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(grain).alias("grain"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    return out.select("bin", "grain", "n_pairs", "mean", (F.col("sd") / F.sqrt("n_pairs")).alias("se"))
