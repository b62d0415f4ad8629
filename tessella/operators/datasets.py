"""Several datasets on one scale."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.quantiles import running_total
from tessella.functions.scalars import nan_to_null
from tessella.functions.scalers import FittedScaler, ScalerRule, fit_scaler
from tessella.operators.labels import LabelSet
from tessella.sources.staging import cut_lineage


def stacked(tables: dict[str, DataFrame], id_col: str, *, dataset_col: str = "dataset") -> DataFrame:
    """Rows of all datasets with `cell_id` = "dataset:id", `source_id` and the dataset's name; columns that one lacks are null."""
    out = None
    for name, df in tables.items():
        part = df.select(
            F.concat_ws(":", F.lit(name), F.col(id_col).cast("string")).alias("cell_id"), F.lit(name).alias(dataset_col),
            F.col(id_col).cast("string").alias("source_id"), *[F.col(c) for c in df.columns if c != id_col],
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stratum_moments(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., c_mean, c_sd...) and n of each stratum."""
    made = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *made)


def harmonized(df: DataFrame, columns: list[str], reference: str, *, dataset_col: str = "dataset", stratum_col: str = "stratum", min_cells: int = 50) -> DataFrame:
    """Each dataset's values in the reference's units: z-scored in the own stratum, put back by the reference's.

    Rows of the reference stay. A stratum of fewer than min_cells rows, or one that the reference lacks, is an error.
    The moments have one row a dataset and stratum.
    """
    fits = stratum_moments(df, columns, [dataset_col, stratum_col])
    own = [(r[dataset_col], r[stratum_col], r["n"]) for r in fits.select(dataset_col, stratum_col, "n").collect()]
    there = {s for d, s, _ in own if d == reference}
    if bad := [(d, s) for d, s, n in own if n < min_cells or s not in there]:
        raise ValueError(f"strata too small or not in the reference: {bad}")
    ref = fits.filter(F.col(dataset_col) == reference).select(stratum_col, *[F.col(f"{c}_{k}").alias(f"__ref_{c}_{k}") for c in columns for k in ("mean", "sd")])
    few = F.broadcast if len(own) * len(columns) <= 1_000_000 else (lambda x: x)  # one row a dataset and stratum, already counted
    joined = df.join(few(fits.drop("n")), [dataset_col, stratum_col]).join(few(ref), stratum_col)

    def mapped(c: str) -> Column:
        sd = F.when(F.col(f"{c}_sd") > 0, F.col(f"{c}_sd")).otherwise(1.0)
        z = (F.col(c) - F.col(f"{c}_mean")) / sd
        return F.when(F.col(dataset_col) == reference, F.col(c).cast("double")).otherwise(z * F.col(f"__ref_{c}_sd") + F.col(f"__ref_{c}_mean"))

    return joined.withColumns({c: mapped(c) for c in columns}).select(*df.columns)


def source_ids(joined: DataFrame, ids: DataFrame) -> DataFrame:
    """(cell_id, dataset, source_id); an unknown id is an error."""
    out = ids.select("cell_id").join(joined.select("cell_id", "dataset", "source_id"), "cell_id", "left")
    if not out.filter("dataset IS NULL").isEmpty():
        raise KeyError("unknown ids")
    return out


def labels_by_dataset(joined: DataFrame, codes: DataFrame) -> DataFrame:
    """(dataset, source_id, code)."""
    return codes.join(joined.select("cell_id", "dataset", "source_id"), "cell_id").select("dataset", "source_id", "code")


# whole tables


@dataclass
class DatasetJoin:
    """How a table was joined: its columns, the reference, and the fit of each (dataset, stratum)."""

    dataset_column: str
    source_id_column: str
    stratum_column: str | None
    reference: str
    features: list[str]
    datasets: dict[str, dict]
    scalers: dict[tuple[str, str | None], FittedScaler]

    def mapped(self, data: DataFrame, dataset: str, strata: str | None = None) -> DataFrame:
        """Raw rows of a dataset in the reference's units: own fit, then the reference's backwards, stratum by stratum."""
        if dataset not in self.datasets:
            raise KeyError(f"no dataset {dataset}; there are {sorted(self.datasets)}")
        if dataset == self.reference:
            return data
        if self.stratum_column is None:
            groups, stratum = [None], None
        else:
            groups = sorted(s for d, s in self.scalers if d == dataset)
            stratum = F.col(strata or self.datasets[dataset]["strata"]).cast("string")
            bad = F.raise_error(F.concat(F.lit(f"no fit for stratum of {dataset}: "), F.coalesce(stratum, F.lit("null")))).cast("double")
        out = {}
        for c in self.features:
            value = None if stratum is None else bad
            for group in reversed(groups):
                own, ref = self.scalers[dataset, group], self.scalers[self.reference, group]
                there = nan_to_null(ref.inverse(c, own.scaled(c)))
                value = there if stratum is None else F.when(stratum == group, there).otherwise(value)
            out[c] = value
        return data.withColumns(out)


#: Strata of a dataset whose fits are written into one expression.
MOST_STRATA = 500


def _per_dataset(given, names: list[str], what: str) -> dict[str, str | None]:
    if given is None or isinstance(given, str):
        return dict.fromkeys(names, given)
    if missing := [n for n in names if n not in given]:
        raise ValueError(f"{what} says nothing of {missing}")
    return {n: given[n] for n in names}


def join_datasets(
    tables: dict, *, rule: ScalerRule | None = None, reference: str | None = None, strata=None, stratum_column: str = "stratum", min_cells: int = 50, columns: list[str] | None = None, fit_mask=None,
    dataset_column: str = "dataset", id_column: str = "cell_id", source_id_column: str | None = None, dataset_masks: bool = True, output_rule: ScalerRule | None = None, seed: int = 0,
):
    """One table of several, in the units of a reference, with new ids (place + 1) * 10**digits + row.

    Rows of a dataset are numbered in the order of their ids. A fit takes min_cells rows or more, within fit_mask. Masks
    are false in datasets that lack them; collections and validity domains must agree; labels of one name become one
    label set, clusters of one name one cluster; metadata columns of types that do not go together are refused.
    """
    from tessella.operators.frame import MASK, CellFrame

    names = list(tables)
    if len(names) < 2:
        raise ValueError("a join takes two tables or more")
    if bad := [n for n in names if not n or n == "all" or "/" in n or n.startswith(MASK)]:
        raise ValueError(f"names become masks, so these will not do: {bad}")
    reference = reference or names[0]
    if reference not in tables:
        raise ValueError(f"no dataset {reference}")
    if min_cells < 2:
        raise ValueError("a fit needs two rows")
    shared = [c for c in tables[reference].feature_names if all(c in t.feature_names for t in tables.values())] if columns is None else list(columns)
    if missing := [(n, c) for n, t in tables.items() for c in shared if c not in t.feature_names]:
        raise ValueError(f"features that a dataset lacks: {missing}")
    source_id_column = source_id_column or f"source_{id_column}"
    reserved = [id_column, source_id_column, dataset_column, *([stratum_column] if strata is not None else [])]
    for name, t in tables.items():
        if clash := sorted((set(t.columns) - {t.id_col}) & set(reserved)):
            raise ValueError(f"{name} has columns {clash}, which the joined table needs")
    kinds = {n: dict(t.df.dtypes)[t.id_col] for n, t in tables.items()}
    if len({k == "string" for k in kinds.values()}) > 1:
        raise ValueError(f"ids of different kinds: {kinds}")
    clashing = [c for c in shared if len({t.transforms.get(c) for t in tables.values()}) > 1]
    if clashing:
        raise ValueError(f"transforms differ between datasets: {clashing}")
    masks, groups = _per_dataset(fit_mask, names, "fit_mask"), _per_dataset(strata, names, "strata")
    rule = rule or tables[reference].rule
    sizes = {n: t.n_cells for n, t in tables.items()}
    block = 10 ** len(str(max(sizes.values())))

    scalers: dict[tuple[str, str | None], FittedScaler] = {}
    wanted: dict[str, list] = {}
    for name, t in tables.items():
        rows = t.df.filter(t.mask(masks[name]))
        if strata is None:
            wanted[name] = [(None, rows.count(), rows)]
            continue
        stratum = F.col(groups[name]).cast("string")
        if name != reference and not t.df.filter(stratum.isNull()).isEmpty():
            raise ValueError(f"cells of {name} have no stratum")
        found = {r["s"]: r["n"] for r in rows.groupBy(stratum.alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_STRATA + 1).collect()}
        if len(found) > MOST_STRATA:
            raise ValueError(f"{name} has over {MOST_STRATA} strata")
        wanted[name] = [(s, n, rows.filter(stratum == s)) for s, n in sorted(found.items()) if s is not None]
    used = {s for n in names if n != reference for s, *_ in wanted[n]}
    there = {s for s, *_ in wanted[reference]}
    if strata is not None and (lost := sorted(used - there)):
        raise ValueError(f"strata that {reference} lacks: {lost}")
    for name in names:
        for s, n, rows in wanted[name]:
            if name == reference and s not in used:
                continue
            if n < min_cells:
                raise ValueError(f"{name}{'' if s is None else ', stratum ' + s} has {n} fit cells, under {min_cells}")
            scalers[name, s] = fit_scaler(rows, shared, rule, {c: k for c, k in tables[name].transforms.items() if c in shared})
    info = DatasetJoin(
        dataset_column, source_id_column, stratum_column if strata is not None else None, reference, shared,
        {n: {"id_column": t.id_col, "fit_mask": masks[n], "strata": groups[n], "n_cells": sizes[n], "id_offset": (k + 1) * block} for k, (n, t) in enumerate(tables.items())}, scalers,
    )

    label_names = list(dict.fromkeys(x for t in tables.values() for x in t.label_names))
    frames = []
    for name, t in tables.items():
        gone = [c for c in t.df.columns if c.startswith(MASK)] + [c for x in label_names if x in t.label_names for c in (x, f"{x}_id", f"{x}_confidence") if c in t.df.columns]
        gone += [c for c in t.feature_names if c not in shared]
        rows = info.mapped(t.df, name, groups[name]).withColumns({c: F.col(c).cast("double") for c in shared} if name == reference else {})
        number = running_total(t.df.select(F.col(t.id_col).alias("__id"), F.lit(1).cast("long").alias("__k"), F.lit(0).alias("__one")), ["__one"], "__id", "__k", "__place")
        rows = rows.join(number.select(F.col("__id").alias(t.id_col), (F.col("__place") - 1 + info.datasets[name]["id_offset"]).alias("__new")), t.id_col)
        if strata is not None:
            rows = rows.withColumn("__stratum", F.col(groups[name]).cast("string"))
        rows = rows.drop(*gone).withColumnRenamed(t.id_col, source_id_column).withColumnRenamed("__new", id_column).withColumnRenamed("__stratum", stratum_column).withColumn(dataset_column, F.lit(name))
        held = {m: t.mask(m) for m in t.masks}
        kept = t.df.select(F.col(t.id_col).alias(source_id_column), *[F.coalesce(x, F.lit(False)).alias(f"__m_{m}") for m, x in held.items()])
        frames.append((rows.join(kept, source_id_column) if held else rows, t))
    _check_types([f for f, _ in frames], names)
    rows = None
    for frame, _ in frames:
        rows = frame if rows is None else rows.unionByName(frame, allowMissingColumns=True)
    every = list(dict.fromkeys(m for t in tables.values() for m in t.masks))
    if dataset_masks and (clash := sorted(set(every) & set(names))):
        raise ValueError(f"masks and datasets share names: {clash}")
    if partial := sorted({m for m in every for t in tables.values() if m not in t.masks}):
        warnings.warn(f"masks that some datasets lack: {partial}; their cells are outside", stacklevel=2)
    flags = {m: F.coalesce(F.col(f"__m_{m}"), F.lit(False)) for m in every}
    lead = [id_column, dataset_column, source_id_column, *([stratum_column] if strata is not None else [])]
    plain = [c for c in rows.columns if c not in lead and not c.startswith("__m_")]
    body = cut_lineage(rows.select(*lead, *plain, *[x.alias(f"__m_{m}") for m, x in flags.items()]))
    out = CellFrame(body.drop(*[f"__m_{m}" for m in every]), shared, id_col=id_column, metadata=_merged_metadata(tables, shared), rule=output_rule, seed=seed, check=False)
    out.df = body
    for m in every:
        out.add_mask(m, F.col(f"__m_{m}"))
    out.df = out.df.drop(*[f"__m_{m}" for m in every])
    if dataset_masks:
        for name in names:
            out.add_mask(name, F.col(dataset_column) == name)
    out.transforms = {c: k for c, k in tables[reference].transforms.items() if c in shared}
    out.join = info
    _carry_collections(out, tables, shared)
    _carry_validity(out, tables, shared)
    _carry_labels(out, tables, label_names)
    return out


def _check_types(frames: list[DataFrame], names: list[str]) -> None:
    """Columns that several datasets have must be of one type, or all numeric."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    seen: dict[str, dict[str, str]] = {}
    for name, frame in zip(names, frames, strict=True):
        for column, kind in frame.dtypes:
            seen.setdefault(column, {})[name] = kind
    bad = {c: k for c, k in seen.items() if len(set(k.values())) > 1 and not all(x in numeric or x.startswith("decimal") for x in k.values())}
    if bad:
        raise ValueError(f"columns of types that do not go together: {bad}")


def _merged_metadata(tables: dict, columns: list[str]) -> DataFrame | None:
    """One row a feature; datasets that annotate it differently are refused."""
    parts = [t.metadata for t in tables.values() if t.metadata is not None]
    if not parts:
        return None
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).filter(F.col("feature_id").isin(columns))
    attributes = [c for c in every.columns if c != "feature_id"]
    if not attributes:
        return None
    made = every.groupBy("feature_id").agg(*[F.max(c).alias(c) for c in attributes], *[F.countDistinct(c).alias(f"__n_{c}") for c in attributes])
    clash = made.filter(reduce(lambda a, b: a | b, (F.col(f"__n_{c}") > 1 for c in attributes))).select("feature_id").limit(10).collect()
    if clash:
        raise ValueError(f"datasets annotate features differently: {[r[0] for r in clash]}")
    return made.select("feature_id", *attributes)


def _carry_collections(out, tables: dict, columns: list[str]) -> None:
    merged: dict[str, list[str]] = {}
    for name, t in tables.items():
        for key, cols in t.collections.items():
            if merged.setdefault(key, list(cols)) != list(cols):
                raise ValueError(f"collection {key} has other columns in {name}")
    if lost := [k for k, cols in merged.items() if not set(cols) <= set(columns)]:
        warnings.warn(f"collections with features that were not joined are left out: {lost}", stacklevel=3)
    out.collections = {k: v for k, v in merged.items() if k not in lost}


def _carry_validity(out, tables: dict, columns: list[str]) -> None:
    for c in sorted({c for t in tables.values() for c in t.validity if c in columns}):
        domains = {t.validity.get(c) for t in tables.values()}
        if len(domains) > 1:
            raise ValueError(f"{c} has different validity domains: {sorted(map(str, domains))}")
        out.set_validity([c], domains.pop())


def _carry_labels(out, tables: dict, label_names: list[str]) -> None:
    j = out.join
    keys = out.df.select(F.col(out.id_col).alias("__new"), F.col(j.dataset_column).alias("__d"), F.col(j.source_id_column).alias("__old"))
    for label in label_names:
        parts, sure = [], None
        for name, t in tables.items():
            if label not in t.label_names:
                continue
            own = t.labelset(label)
            mine = keys.filter(F.col("__d") == name).select(F.col("__old").alias(t.id_col), F.col("__new"))
            parts.append(LabelSet(own.fact.join(mine, t.id_col).select(F.col("__new").alias(out.id_col), "code"), dict(own.meta), label, out.id_col))
            if f"{label}_confidence" in t.df.columns:
                found = t.df.select(t.id_col, F.col(f"{label}_confidence").cast("double").alias("confidence")).join(mine, t.id_col).select(F.col("__new").alias(out.id_col), "confidence")
                sure = found if sure is None else sure.unionByName(found)
        out.attach(parts[0].combine(*parts[1:], mode="priority", name=label), confidence=sure)
