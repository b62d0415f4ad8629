"""Transforms and scalers: one aggregation fits them, column expressions apply them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.quantiles import percentiles
from tessella.functions.scalars import checked, clip, ihs, nan_to_null

LOG_FLOOR = 1e-9


@dataclass(frozen=True)
class ScalerRule:
    """base: standard, robust or identity. clip_mode: None, percentile (of the raw values) or sigma (of the scaled ones)."""

    base: str = "standard"
    clip_mode: str | None = None
    lower: float = 0.1
    upper: float = 99.9
    n_sigma: float = 5.0

    def __post_init__(self):
        if self.base not in ("standard", "robust", "identity") or self.clip_mode not in (None, "percentile", "sigma"):
            raise ValueError(f"unknown scaler {self}")


def robust_clipped(lower: float = 0.1, upper: float = 99.9, *, mode: str = "percentile", n_sigma: float = 5.0, base: str = "robust") -> ScalerRule:
    return ScalerRule(base, mode, lower, upper, n_sigma)


@dataclass
class FittedScaler:
    rule: ScalerRule
    columns: list[str]
    transforms: dict[str, str] = field(default_factory=dict)
    stats: dict[str, dict[str, float]] = field(default_factory=dict)

    def transformed(self, name: str, x: Column | None = None) -> Column:
        x = F.col(name).cast("double") if x is None else x
        kind = self.transforms.get(name)
        if kind == "ihs":
            return ihs(x)
        if kind == "sqrt":
            return F.sqrt(checked(x, x >= 0, f"sqrt of a negative value in {name}"))
        if kind == "log":
            shifted = x + self.stats[name]["shift"]
            return F.log(checked(shifted, shifted > 0, f"log outside the fitted domain of {name}"))
        return x

    def scaled(self, name: str) -> Column:
        s, x = self.stats[name], self.transformed(name)
        out = (x - s["center"]) / s["scale"]
        if self.rule.clip_mode == "percentile":
            out = clip(out, s["lo"], s["hi"])
        elif self.rule.clip_mode == "sigma":
            out = clip(out, -self.rule.n_sigma, self.rule.n_sigma)
        return out

    def inverse(self, name: str, z: Column) -> Column:
        """Back to raw units; clipping is not undone."""
        s = self.stats[name]
        x = z * s["scale"] + s["center"]
        kind = self.transforms.get(name)
        if kind == "ihs":
            return F.sinh(x)
        if kind == "sqrt":
            return F.when(x > 0, x * x).otherwise(F.when(x.isNotNull(), F.lit(0.0)))
        return F.exp(x) - s["shift"] if kind == "log" else x

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})

    def to_json(self) -> str:
        return json.dumps({"rule": asdict(self.rule), "columns": self.columns, "transforms": self.transforms, "stats": self.stats}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FittedScaler:
        made = json.loads(text)
        return cls(ScalerRule(**made["rule"]), made["columns"], made["transforms"], made["stats"])


def screen(df: DataFrame, columns: list[str], *, method: str = "ihs", threshold: float = 1.5) -> dict[str, str]:
    """The transform of each skewed column, by the biased skewness of its non-null values, from one pass."""
    if method not in ("ihs", "log", "sqrt"):
        raise ValueError(method)
    row = df.agg(*[f(nan_to_null(F.col(c).cast("double"))).alias(f"{c}:{n}") for c in columns for n, f in (("skew", F.skewness), ("min", F.min))]).first()
    out = {}
    for c in columns:
        skew, least = row[f"{c}:skew"], row[f"{c}:min"]
        if skew is not None and skew > threshold and (method == "ihs" or least >= 0):
            out[c] = method
    return out


def fit_scaler(df: DataFrame, columns: list[str], rule: ScalerRule = ScalerRule(), transforms: dict[str, str] | None = None) -> FittedScaler:
    """Fit all columns together: one aggregation for moments, exact quantiles for the rest, and one before where a log needs its shift."""
    fitted = FittedScaler(rule, list(columns), dict(transforms or {}))
    logs = [c for c in columns if fitted.transforms.get(c) == "log"]
    if logs:
        least = df.agg(*[F.min(nan_to_null(F.col(c).cast("double"))).alias(c) for c in logs]).first()
        for c in logs:
            fitted.stats[c] = {"shift": LOG_FLOOR - least[c] if least[c] is not None and least[c] <= 0 else 0.0}
    moments, ranks = [], {}
    for c in columns:
        x = nan_to_null(fitted.transformed(c))
        if rule.base == "standard":
            moments += [F.avg(x).alias(f"{c}:center"), F.stddev_pop(x).alias(f"{c}:scale")]
        shares = [0.25, 0.5, 0.75] * (rule.base == "robust") + [rule.lower / 100, rule.upper / 100] * (rule.clip_mode == "percentile")
        if shares:
            ranks[c] = (x, shares)
    row = df.agg(*moments).first().asDict() if moments else {}
    found = percentiles(df, ranks) if ranks else {}
    for c in columns:
        center, scale = row.get(f"{c}:center", 0.0), row.get(f"{c}:scale", 1.0)
        if rule.base == "robust":
            q = (found[c] or (0.0, 0.0, 1.0))[:3]
            center, scale = q[1], q[2] - q[0]
        stats = fitted.stats.setdefault(c, {})
        stats |= {"center": center or 0.0, "scale": scale or 1.0}
        if rule.clip_mode == "percentile":
            lo, hi = (found[c] or (0.0, 0.0))[-2:]
            stats |= {"lo": (lo - stats["center"]) / stats["scale"], "hi": (hi - stats["center"]) / stats["scale"]}
    return fitted


def _at_most(x: Column):
    return lambda mark: mark <= x


def quantile_scaled(df: DataFrame, columns: list[str], *, lower: float = 1.0, upper: float = 99.0, n_quantiles: int = 101, normal: bool = True) -> DataFrame:
    """Map each column through its quantiles, to a uniform or normal shape; landmarks come from one aggregation.

    The map is a piecewise-linear expression over the landmarks, so it runs inside code generation.
    """
    ranks = [k / (n_quantiles - 1) for k in range(n_quantiles)]
    at = [(lower + (upper - lower) * r) / 100 for r in ranks]
    row = percentiles(df, {c: (F.col(c), at) for c in columns})
    edge = NormalDist().inv_cdf
    out = {}
    for c in columns:
        x, marks = F.col(c).cast("double"), F.lit(row[c]).cast("array<double>")
        below = F.size(F.filter(marks, _at_most(x)))
        k = F.greatest(F.lit(1), F.least(F.lit(n_quantiles - 1), below))
        lo, hi = F.element_at(marks, k), F.element_at(marks, k + 1)
        step = F.when(hi > lo, (clip(x, row[c][0], row[c][-1]) - lo) / (hi - lo)).otherwise(0.0)
        uniform = (k - 1 + step) / (n_quantiles - 1)
        if normal:
            table = F.lit([edge(min(max(r, 1e-7), 1 - 1e-7)) for r in ranks]).cast("array<double>")
            a, b = F.element_at(table, k), F.element_at(table, k + 1)
            uniform = a + (b - a) * step
        out[c] = F.when(x.isNotNull(), uniform)
    return df.withColumns(out)
