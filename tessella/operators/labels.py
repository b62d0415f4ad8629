"""Label sets: a fact table (id, code) and a small dimension of names, colours and descriptions. -1 is unassigned."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Names that a label set's dimension may hold; it lives on the driver.
MOST_CLASSES = 100_000


@dataclass
class Label:
    name: str
    color: str | None = None
    description: str | None = None


@dataclass
class LabelSet:
    fact: DataFrame
    meta: dict[int, Label] = field(default_factory=dict)
    name: str = "label"
    id_col: str = "cell_id"

    @classmethod
    def from_labels(cls, df: DataFrame, value: str, *, id_col: str = "cell_id", name: str | None = None, unassigned: tuple = ()) -> LabelSet:
        """Codes by sorted distinct value; null, NaN and the sentinels are unassigned."""
        x = F.col(value)
        known = x.isNotNull() & ~x.cast("string").isin("NaN", *map(str, unassigned))
        values = sorted(r[0] for r in df.filter(known).select(value).distinct().limit(MOST_CLASSES + 1).collect())
        if len(values) > MOST_CLASSES:
            raise ValueError(f"{value} has over {MOST_CLASSES} values: that is no label")
        spark = df.sparkSession
        if not values:
            return cls(df.select(id_col, F.lit(-1).cast("long").alias("code")), {}, name or value, id_col)
        codes = spark.createDataFrame(list(enumerate(values)), f"code long, `{value}` {df.schema[value].dataType.simpleString()}")
        fact = df.select(id_col, value).join(codes, value, "left").select(id_col, F.coalesce("code", F.lit(-1).cast("long")).alias("code"))
        return cls(fact, {k: Label(str(v)) for k, v in enumerate(values)}, name or value, id_col)

    def _with(self, code: Column | None = None, meta: dict[int, Label] | None = None, fact: DataFrame | None = None) -> LabelSet:
        fact = self.fact if fact is None else fact
        if code is not None:
            fact = fact.withColumn("code", code.cast("long"))
        return replace(self, fact=fact, meta=dict(self.meta if meta is None else meta))

    @classmethod
    def from_clustering(cls, clustering, *, distance_threshold: float, min_cluster_size: int = 1, name: str = "label") -> LabelSet:
        return clustering.label(distance_threshold=distance_threshold, min_cluster_size=min_cluster_size, name=name, order=False)

    @property
    def ids(self) -> list[int]:
        return sorted(self.meta)

    @property
    def names(self) -> list[str]:
        return [self.meta[k].name for k in sorted(self.meta)]

    @property
    def n_clusters(self) -> int:
        return len(self.meta)

    @property
    def cell_ids(self) -> DataFrame:
        return self.fact.select(self.id_col)

    @property
    def codes(self) -> DataFrame:
        return self.fact.select(self.id_col, "code")

    @property
    def assigned(self) -> DataFrame:
        """(id, assigned) of every cell."""
        return self.fact.select(self.id_col, (F.col("code") >= 0).alias("assigned"))

    def with_codes(self, fact: DataFrame, *, name: str | None = None) -> LabelSet:
        """Other cells (id, code) under the same identities."""
        return LabelSet(fact.select(self.id_col, F.col("code").cast("long").alias("code")), {k: replace(v) for k, v in self.meta.items()}, name or self.name, self.id_col)

    def decode(self, codes: DataFrame) -> DataFrame:
        """codes (..., code) with the cluster's name, null where it is unassigned or unknown."""
        return codes.join(F.broadcast(self.dimension().select(F.col("id").alias("code"), F.col("name").alias("label"))), "code", "left")

    def to_names(self) -> DataFrame:
        """(id, name) of every cell, null where it is unassigned."""
        return self.to_frame().select(self.id_col, F.col(self.name).alias("name"))

    to_series = to_names

    def code_of(self, key: int | str) -> int:
        found = [k for k, label in self.meta.items() if key in (k, label.name)]
        if len(found) != 1:
            raise KeyError(key)
        return found[0]

    def cluster(self, key: int | str) -> Label:
        return self.meta[self.code_of(key)]

    def copy(self, name: str | None = None) -> LabelSet:
        return replace(self, meta={k: replace(v) for k, v in self.meta.items()}, name=name or self.name)

    def check(self) -> None:
        """Unique non-null ids and codes of -1 or more, in one pass."""
        row = self.fact.agg(F.count(F.lit(1)), F.countDistinct(self.id_col), F.min("code")).first()
        if row[0] != row[1]:
            raise ValueError("ids are not unique or are null")
        if row[2] is not None and row[2] < -1:
            raise ValueError("codes below -1")

    def dimension(self) -> DataFrame:
        rows = [(k, v.name, v.color, v.description) for k, v in sorted(self.meta.items())]
        return self.fact.sparkSession.createDataFrame(rows, "id long, name string, color string, description string")

    def catalog(self) -> DataFrame:
        counts = self.fact.filter("code >= 0").groupBy(F.col("code").alias("id")).agg(F.count(F.lit(1)).alias("n_cells"))
        return self.dimension().join(counts, "id", "left").fillna(0, ["n_cells"])

    def counts(self) -> DataFrame:
        return self.catalog().select("name", "n_cells")

    def n_unassigned(self) -> int:
        return self.fact.filter("code < 0").count()

    def to_frame(self) -> DataFrame:
        names = self.dimension().select(F.col("id").alias("code"), F.col("name").alias(self.name))
        return self.fact.join(names, "code", "left").select(self.id_col, self.name, F.col("code").alias(f"{self.name}_id"))

    def color_map(self) -> dict[str, str | None]:
        return {v.name: v.color for v in self.meta.values()}

    def codes_for(self, ids: DataFrame, *, missing: int = -1) -> DataFrame:
        return ids.select(self.id_col).join(self.fact, self.id_col, "left").select(self.id_col, F.coalesce("code", F.lit(missing).cast("long")).alias("code"))

    def subset(self, ids: DataFrame) -> LabelSet:
        absent = ids.select(self.id_col).join(self.fact, self.id_col, "left_anti")
        if not absent.isEmpty():
            raise KeyError(f"ids without a label: {[r[0] for r in absent.limit(5).collect()]}")
        return self._with(fact=self.fact.join(ids.select(self.id_col), self.id_col, "left_semi"))

    def reindex(self, ids: DataFrame, *, fill: str | None = None) -> LabelSet:
        """Exactly these ids; the missing are unassigned, or get the cluster named fill, made where there is none."""
        meta, code = dict(self.meta), -1
        if fill is not None:
            code = next((k for k, v in meta.items() if v.name == fill), max(meta, default=-1) + 1)
            meta.setdefault(code, Label(fill))
        return self._with(meta=meta, fact=self.codes_for(ids, missing=code))

    def drop_unassigned(self) -> LabelSet:
        return self._with(fact=self.fact.filter("code >= 0"))

    def rename(self, names: dict[int | str, str]) -> LabelSet:
        meta = {k: replace(v) for k, v in self.meta.items()}
        for key, name in names.items():
            meta[self.code_of(key)].name = name
        return self._with(meta=meta)

    def described(self, what: str, mapping: dict[int | str, str]) -> LabelSet:
        """Set `color` or `description` by cluster."""
        meta = {k: replace(v) for k, v in self.meta.items()}
        for key, value in mapping.items():
            setattr(meta[self.code_of(key)], what, value)
        return self._with(meta=meta)

    def merge(self, members: list[int | str], *, into: str) -> LabelSet:
        codes = sorted(map(self.code_of, members))
        if len(set(codes)) < 2:
            raise ValueError("merge takes two clusters or more")
        if any(v.name == into and k not in codes for k, v in self.meta.items()):
            raise ValueError(f"{into} is taken")
        meta = {k: v for k, v in self.meta.items() if k not in codes[1:]}
        meta[codes[0]] = replace(meta[codes[0]], name=into)
        return self._with(F.when(F.col("code").isin(codes), codes[0]).otherwise(F.col("code")), meta)

    def assign(self, ids: DataFrame, to: int | str | None) -> LabelSet:
        meta, code = dict(self.meta), -1
        if to is not None:
            code = next((k for k, v in meta.items() if to in (k, v.name)), None)
            if code is None:
                code = max(meta, default=-1) + 1
                meta[code] = Label(str(to))
        self.subset(ids)
        moved = ids.select(self.id_col).distinct().withColumn("__moved", F.lit(True))
        fact = self.fact.join(moved, self.id_col, "left")
        return self._with(meta=meta, fact=fact.select(self.id_col, F.when(F.col("__moved"), F.lit(code)).otherwise(F.col("code")).cast("long").alias("code")))

    def unassign(self, members: list[int | str]) -> LabelSet:
        codes = [self.code_of(m) for m in members]
        return self._with(F.when(F.col("code").isin(codes), -1).otherwise(F.col("code")), {k: v for k, v in self.meta.items() if k not in codes})

    def _renumbered(self, order: list[int]) -> LabelSet:
        new = {old: k for k, old in enumerate(order)}
        mapping = F.create_map(*[F.lit(x).cast("long") for pair in new.items() for x in pair]) if new else None
        code = F.col("code") if mapping is None else F.coalesce(F.element_at(mapping, F.col("code")), F.lit(-1))
        return self._with(code, {new[k]: v for k, v in self.meta.items()})

    def reorder(self, order: list[int | str]) -> LabelSet:
        codes = [self.code_of(x) for x in order]
        populated = {r["id"] for r in self.catalog().filter("n_cells > 0").collect()}
        if not populated <= set(codes) or len(set(codes)) != len(codes):
            raise ValueError("order must name every populated cluster once")
        return self._renumbered([*codes, *(k for k in sorted(self.meta) if k not in codes)])

    def compact(self) -> LabelSet:
        """Contiguous codes in their order, empty clusters last."""
        populated = {r["id"] for r in self.catalog().filter("n_cells > 0").collect()}
        return self._renumbered(sorted(self.meta, key=lambda k: (k not in populated, k)))

    def reorder_by(self, values: DataFrame, value: str, *, agg: str = "mean", ascending: bool = True) -> LabelSet:
        """Codes by the mean or median of a value; NaN and null are left out, clusters without a value come last."""
        x = F.nanvl(F.col(value).cast("double"), F.lit(None))
        measure = F.avg(x) if agg == "mean" else F.percentile(x, 0.5)
        found = {r["code"]: r["m"] for r in self.fact.join(values, self.id_col).groupBy("code").agg(measure.alias("m")).collect()}
        key = lambda k: (found.get(k) is None, (found.get(k) or 0.0) * (1 if ascending else -1), k)
        return self._renumbered(sorted(self.meta, key=key))

    def combine(self, *others: LabelSet, mode: str = "disjoint", name: str | None = None) -> LabelSet:
        """Union of label sets. disjoint: shared ids are an error, codes are shifted. priority: the first assigned wins, equal names are one cluster."""
        parts = [self, *others]
        meta: dict[int, Label] = {}
        facts = []
        for k, part in enumerate(parts):
            new = {}
            for code, label in sorted(part.meta.items()):
                same = next((c for c, v in meta.items() if v.name == label.name), None) if mode == "priority" else None
                new[code] = len(meta) if same is None else same
                meta.setdefault(new[code], label)
            mapping = F.create_map(*[F.lit(x).cast("long") for pair in new.items() for x in pair]) if new else None
            code = F.lit(-1).cast("long") if mapping is None else F.coalesce(F.element_at(mapping, F.col("code")), F.lit(-1).cast("long"))
            facts.append(part.fact.select(self.id_col, code.alias("code"), F.lit(k).alias("source")))
        stacked = facts[0]
        for fact in facts[1:]:
            stacked = stacked.union(fact)
        if mode == "disjoint":
            if not stacked.groupBy(self.id_col).count().filter("count > 1").isEmpty():
                raise ValueError("label sets share ids")
            fact = stacked.select(self.id_col, "code")
        else:
            first = F.min(F.struct((F.col("code") < 0).alias("un"), "source", "code"))
            fact = stacked.groupBy(self.id_col).agg(first.alias("x")).select(self.id_col, F.col("x.code").alias("code"))
        return LabelSet(fact, meta, name or self.name, self.id_col)

    def to_enum(self, class_name: str = "Labels") -> type[IntEnum]:
        return IntEnum(class_name, {v.name: k for k, v in self.meta.items()})

    def apply_enum(self, enum: type[IntEnum]) -> LabelSet:
        return self.rename({int(x): x.name for x in enum})


def dense_codes(df: DataFrame, value: str, id_col: str) -> DataFrame:
    """(id, code) by sorted distinct value, all in one plan: the distinct values are numbered, then joined back."""
    values = df.select(value).filter(F.col(value).isNotNull()).distinct()
    numbered = values.withColumn("code", (F.row_number().over(Window.orderBy(value)) - 1).cast("long"))
    return df.select(id_col, value).join(numbered, value, "left").select(id_col, F.coalesce("code", F.lit(-1).cast("long")).alias("code"))
