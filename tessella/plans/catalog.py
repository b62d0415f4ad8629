"""The registered queries of the library, each with the SQL that gives the same rows.

A cell is a row of a test table: embeddings are the feature table, part, customer, supplier and lineitem give numeric
features, documents with labels a partial label set, users under several bucketings an ensemble of partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import ihs
from tessella.functions.scalers import ScalerRule, fit_scaler, quantile_scaled, screen
from tessella.operators import agreement as ag
from tessella.operators import boundary as bd
from tessella.operators import consensus as cs
from tessella.operators import datasets as ds
from tessella.operators import diagnostics as dg
from tessella.operators import gradient as gr
from tessella.operators import knn as kn
from tessella.operators import outliers as ot
from tessella.operators import transfer as tr
from tessella.operators import validate as va
from tessella.operators.frame import CellFrame
from tessella.operators.labels import LabelSet, dense_codes
from tessella.operators.space import fit_space
from tessella.sources.store import read_table
from tessella.streaming.project import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contingency(spark, sf_dir)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded, negative zero made zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def part_frame(spark: SparkSession, sf_dir: str) -> CellFrame:
    return CellFrame(read_table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_size", "p_retailprice"], id_col="p_partkey", check=False)


def customer_frame(spark: SparkSession, sf_dir: str) -> CellFrame:
    nation = F.broadcast(read_table(spark, sf_dir, "nation"))  # 25 rows in any size
    df = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    frame = CellFrame(df.select("c_custkey", "c_acctbal", "c_mktsegment", "n_regionkey"), ["c_acctbal"], id_col="c_custkey", check=False)
    return frame.add_mask("positive", F.col("c_acctbal") > 0).add_mask("rich", F.col("c_acctbal") > 5000, based_on="positive")


def customer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, a_id, b_id): market segment against region; a missing region code is never there."""
    rows = customer_frame(spark, sf_dir).view("positive").withColumnRenamed("c_custkey", "cell_id")
    seg = dense_codes(rows, "c_mktsegment", "cell_id")
    return ag.shared(seg, rows.select("cell_id", F.col("n_regionkey").alias("code")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("code"))


def edges(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return kn.knn(rows, rows, k)


KNN_SQL = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label::BIGINT AS code FROM embeddings),
p AS (SELECT a.id AS src, b.id AS dst, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.id <> b.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM p) WHERE rank <= 10)
"""
CUSTOMER_SQL = """
WITH c AS (
  SELECT c_custkey AS cell_id, c_acctbal, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS a_id, n_regionkey::BIGINT AS b_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
), t AS (SELECT a_id, b_id, count(*) AS n FROM c GROUP BY ALL)
"""
RUNS = ((3, 3), (4, 4), (5, 5), (7, 7), (11, 8), (13, 9))
PARTITION_SQL = (
    "WITH u AS (SELECT DISTINCT user_id AS cell_id FROM events), runs AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, 'knn', {10 + 5 * (i % 2)}, {m / 4.0})" for i, (m, _) in enumerate(RUNS))
    + ") AS r(run, graph_type, n_neighbors, resolution)), p AS ("
    + " UNION ALL ".join(f"SELECT cell_id, {i}::BIGINT AS run, (CASE WHEN cell_id % 17 = {k} THEN -1 ELSE cell_id % {m} END)::BIGINT AS label FROM u" for i, (m, k) in enumerate(RUNS))
    + ")"
)


def partitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users bucketed by several moduli: an ensemble of runs that any engine can repeat."""
    users = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id")).distinct()
    each = [F.struct(F.lit(i).cast("long").alias("run"), F.when(F.col("cell_id") % 17 == k, -1).otherwise(F.col("cell_id") % m).cast("long").alias("label")) for i, (m, k) in enumerate(RUNS)]
    rows = users.select("cell_id", F.explode(F.array(*each)).alias("x")).select("cell_id", "x.run", "x.label")
    runs = spark.createDataFrame([(i, "knn", 10 + 5 * (i % 2), m / 4.0) for i, (m, _) in enumerate(RUNS)], "run long, graph_type string, n_neighbors int, resolution double")
    return rows, runs


# views, masks, validity


@query("""
SELECT mask, n::BIGINT AS n FROM (
  SELECT count(*) AS "all", count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_acctbal > 5000) AS rich FROM customer
) UNPIVOT (n FOR mask IN ("all", positive, rich))""")
def mask_hierarchy(spark, sf_dir):
    return customer_frame(spark, sf_dir).mask_counts()


@query("SELECT c_custkey, c_acctbal, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def masked_view(spark, sf_dir):
    return customer_frame(spark, sf_dir).view("rich")


@query("SELECT count(*) AS n, count(*) FILTER (p_size > 25 AND p_retailprice > 1000) AS kept FROM part")
def mask_null_false(spark, sf_dir):
    frame = part_frame(spark, sf_dir)
    maybe = F.when(F.col("p_size") > 25, F.col("p_retailprice") > 1000)
    return frame.add_mask("m", maybe).df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_mask_m").cast("long")).alias("kept"))


@query("""
SELECT count(*) AS n_cells, len(f)::INT AS n_invalid, f AS invalid_features FROM (
  SELECT list_filter([CASE WHEN NOT p_size > 10 THEN 'p_size' END, CASE WHEN NOT p_retailprice > 1200 THEN 'p_retailprice' END], lambda x: x IS NOT NULL) AS f FROM part
) GROUP BY f""")
def validity_patterns(spark, sf_dir):
    frame = part_frame(spark, sf_dir).add_mask("big", F.col("p_size") > 10).add_mask("dear", F.col("p_retailprice") > 1200)
    return frame.set_validity(["p_size"], "big").set_validity(["p_retailprice"], "dear").validity_patterns()


# transforms and scalers


@query("""
WITH m AS (SELECT avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS b, avg(l_quantity) AS c, stddev_pop(l_quantity) AS d FROM lineitem)
SELECT 'l_extendedprice' AS feature, round(avg(power(l_extendedprice - a, 3)) / power(any_value(b), 3), 6) AS skewness FROM lineitem, m
UNION ALL SELECT 'l_quantity', round(avg(power(l_quantity - c, 3)) / power(any_value(d), 3), 6) + 0.0 FROM lineitem, m""")
def skew_screen(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    cols = ["l_extendedprice", "l_quantity"]
    row = df.agg(*[F.skewness(c).alias(c) for c in cols])
    return rounded(row.unpivot([], cols, "feature", "skewness"), "skewness")


@query("SELECT c_custkey, round(asinh(c_acctbal), 6) + 0.0 AS value FROM customer")
def ihs_transform(spark, sf_dir):
    return rounded(read_table(spark, sf_dir, "customer").select("c_custkey", ihs(F.col("c_acctbal")).alias("value")), "value")


@query("""
WITH m AS (SELECT avg(p_size) a, stddev_pop(p_size) b, avg(p_retailprice) c, stddev_pop(p_retailprice) d FROM part)
SELECT p_partkey, round((p_size - a) / b, 6) + 0.0 AS p_size, round((p_retailprice - c) / d, 6) + 0.0 AS p_retailprice FROM part, m""")
def standard_scaled(spark, sf_dir):
    return rounded(part_frame(spark, sf_dir).view(scaled=True).select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("""
WITH m AS (SELECT quantile_cont(l_extendedprice, [0.001, 0.25, 0.5, 0.75, 0.999]) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round((least(greatest(l_extendedprice, q[1]), q[5]) - q[3]) / (q[4] - q[2]), 6) + 0.0 AS value FROM lineitem, m""")
def robust_clip_scaled(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    fit = fit_scaler(df, ["l_extendedprice"], ScalerRule("robust", "percentile"))
    return rounded(df.select("l_orderkey", "l_linenumber", fit.scaled("l_extendedprice").alias("value")), "value")


@query("""
WITH m AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)
SELECT c_custkey, round(least(greatest((c_acctbal - q[2]) / (q[3] - q[1]), -0.5), 0.5), 6) + 0.0 AS value FROM customer, m""")
def sigma_clip(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer")
    fit = fit_scaler(df, ["c_acctbal"], ScalerRule("robust", "sigma", n_sigma=0.5))
    return rounded(df.select("c_custkey", fit.scaled("c_acctbal").alias("value")), "value")


@query("SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part")
def scaler_round_trip(spark, sf_dir):
    df = read_table(spark, sf_dir, "part")
    fit = fit_scaler(df, ["p_retailprice"], ScalerRule(), {"p_retailprice": "log"})
    return rounded(df.select("p_partkey", fit.inverse("p_retailprice", fit.scaled("p_retailprice")).alias("p_retailprice")), "p_retailprice")


@query()
def quantile_shape(spark, sf_dir):
    return quantile_scaled(read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])


@query("""WITH x AS (SELECT 'value' AS feature, value AS v FROM events UNION ALL SELECT 'spent', exp(value / 40) FROM events UNION ALL SELECT 'flat', (event_id % 7)::DOUBLE FROM events), m AS (SELECT feature, avg(v) AS a, stddev_pop(v) AS s FROM x GROUP BY 1)
SELECT feature, 'ihs' AS transform FROM x JOIN m USING (feature) GROUP BY feature HAVING avg(pow(v - a, 3)) / pow(any_value(s), 3) > 1.5""")
def screened_transforms(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").withColumns({"spent": F.exp(F.col("value") / 40), "flat": (F.col("event_id") % 7).cast("double")})
    found = screen(rows, ["value", "spent", "flat"])
    return spark.createDataFrame(sorted(found.items()), "feature string, transform string")


# labels


@query("SELECT c_custkey AS cell_id, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def from_labels(spark, sf_dir):
    return LabelSet.from_labels(read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cell_id"), "c_mktsegment").fact


@query("""SELECT dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS id, c_mktsegment AS name, count(*) AS n_cells FROM customer GROUP BY c_mktsegment""")
def label_catalog(spark, sf_dir):
    return LabelSet.from_labels(read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cell_id"), "c_mktsegment").catalog().select("id", "name", "n_cells")


@query("""
SELECT CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY 1 LIMIT 2) THEN 'joined' ELSE p_brand END AS name, count(*) AS n_cells FROM part GROUP BY 1""")
def merge_labels(spark, sf_dir):
    labels = LabelSet.from_labels(read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "cell_id"), "p_brand")
    return labels.merge([0, 1], into="joined").compact().counts()


@query("""SELECT row_number() OVER (ORDER BY avg(c_acctbal), c_mktsegment) - 1 AS id, c_mktsegment AS name, count(*) AS n_cells FROM customer GROUP BY c_mktsegment""")
def reorder_by_mean(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cell_id")
    return LabelSet.from_labels(df, "c_mktsegment").reorder_by(df.select("cell_id", "c_acctbal"), "c_acctbal").catalog().select("id", "name", "n_cells")


@query("SELECT d.doc_id AS cell_id, coalesce(quality, 2)::BIGINT AS code FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def reindex_fill(spark, sf_dir):
    known = LabelSet.from_labels(read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "cell_id"), "quality")
    return known.reindex(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id")), fill="unknown").fact


@query("""
SELECT c_custkey AS cell_id, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' END AS label FROM customer
WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'""")
def flatten_labels(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "cell_id")
    first = LabelSet.from_labels(df.filter("c_acctbal > 5000").withColumn("v", F.lit("rich")), "v")
    second = LabelSet.from_labels(df.filter("c_mktsegment = 'BUILDING'"), "c_mktsegment")
    return first.combine(second, mode="priority", name="label").to_frame().select("cell_id", "label")


# agreement


@query(CUSTOMER_SQL + "SELECT a_id, b_id, n, round(n / sum(n) OVER (), 6) AS fraction FROM t")
def contingency(spark, sf_dir):
    return rounded(ag.contingency(customer_codes(spark, sf_dir), normalize=True), "fraction")


@query(CUSTOMER_SQL + "SELECT a_id AS source_id, b_id AS target_id, n AS value FROM t")
def alluvial(spark, sf_dir):
    return ag.alluvial(customer_codes(spark, sf_dir))


@query(CUSTOMER_SQL + """
, a AS (SELECT a_id, sum(n) AS m FROM t GROUP BY 1), b AS (SELECT b_id, sum(n) AS m FROM t GROUP BY 1), s AS (
  SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS s, (SELECT sum(m * (m - 1) / 2.0) FROM a) AS pa, (SELECT sum(m * (m - 1) / 2.0) FROM b) AS pb,
         (SELECT sum(n) FROM t)::DOUBLE AS n, (SELECT sum(n * ln(n)) FROM t) AS hab, (SELECT sum(m * ln(m)) FROM a) AS ha, (SELECT sum(m * ln(m)) FROM b) AS hb
)
SELECT round((s - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) + 0.0 AS ari,
       round((ln(n) + (hab - ha - hb) / n) / (((ln(n) - ha / n) + (ln(n) - hb / n)) / 2), 6) + 0.0 AS nmi,
       round(s / sqrt(pa * pb), 6) AS fmi, round(s / (pa + pb - s), 6) AS jaccard,
       n::BIGINT AS n, n::BIGINT AS n_a_assigned, n::BIGINT AS n_b_assigned, 1.0::DOUBLE AS coverage FROM s""")
def agreement(spark, sf_dir):
    return rounded(ag.agreement(ag.contingency(customer_codes(spark, sf_dir))), "ari", "nmi", "fmi", "jaccard", "coverage")


# diagnostics


@query("""
WITH x AS (SELECT 'l_discount' AS feature, l_discount AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem)
SELECT feature, count(DISTINCT v) AS n_distinct, round(count(DISTINCT v) / count(*), 6) AS frac_distinct, (count(*) FILTER (v = lo))::BIGINT AS n_at_min,
       (count(*) FILTER (v = hi))::BIGINT AS n_at_max, (count(*) FILTER (v = 0))::BIGINT AS n_zero
FROM x JOIN (SELECT feature, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1) USING (feature) GROUP BY 1""")
def tie_report(spark, sf_dir):
    return rounded(dg.tie_report(read_table(spark, sf_dir, "lineitem"), ["l_discount", "l_quantity"]), "frac_distinct")


@query("""
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique_rows, (sum(n) - count(*))::BIGINT AS n_duplicate_rows, count(*) FILTER (n > 1) AS n_duplicate_groups, max(n) AS max_tie_block
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax)""")
def duplicate_rows(spark, sf_dir):
    return dg.duplicate_rows(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q FROM lineitem)
SELECT 'l_extendedprice' AS feature, count(*) AS n_rows, count(*) FILTER (l_extendedprice < q[1] OR l_extendedprice > q[5]) AS n_clipped_percentile,
       count(*) FILTER (abs(l_extendedprice - q[3]) / (q[4] - q[2]) > 1) AS n_clipped_sigma, round(count(*) * 0.02, 6) AS expected_percentile_cells,
       round(max(abs(l_extendedprice - q[3]) / (q[4] - q[2])), 6) AS max_abs_sigma, 1.0::DOUBLE AS n_sigma, 1.34898::DOUBLE AS n_sigma_gaussian_equivalent
FROM lineitem, q""")
def clip_comparison(spark, sf_dir):
    out = dg.clip_comparison(read_table(spark, sf_dir, "lineitem"), ["l_extendedprice"], lower=1.0, upper=99.0, n_sigma=1.0)
    return rounded(out, "expected_percentile_cells", "max_abs_sigma", "n_sigma_gaussian_equivalent")


@query("""
WITH r AS (
  SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS x,
         rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS y FROM lineitem
) SELECT 'l_extendedprice' AS feature, round(corr(x, y), 6) AS spearman_rho, count(*) AS n_finite FROM r""")
def covariate_sensitivity(spark, sf_dir):
    out = dg.covariate_sensitivity(read_table(spark, sf_dir, "lineitem"), ["l_extendedprice"], "l_quantity")
    return rounded(out.select("feature", "spearman_rho", "n_finite"), "spearman_rho")


@query("""
WITH s AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer), ref AS (SELECT v FROM s WHERE g = 'BUILDING'),
q AS (SELECT quantile_cont(v, [0.25, 0.5, 0.75]) AS q, count(*) AS m FROM ref),
o AS (SELECT g, count(*) AS n, quantile_cont(v, 0.5) AS med FROM s WHERE g <> 'BUILDING' GROUP BY g HAVING count(*) >= 20),
pts AS (SELECT g, v, 1 AS a, 0 AS b FROM s JOIN o USING (g) UNION ALL SELECT g, v, 0, 1 FROM ref, o),
c AS (SELECT g, v, sum(a) OVER (PARTITION BY g ORDER BY v) AS ca, sum(b) OVER (PARTITION BY g ORDER BY v) AS cb FROM pts)
SELECT 'c_acctbal' AS feature, g AS c_mktsegment, n AS n_cells, round(max(abs(ca / n - cb / m)), 6) AS ks_statistic, round(any_value((med - q[2]) / (q[3] - q[1])), 6) + 0.0 AS median_shift_iqr
FROM c JOIN o USING (g), q GROUP BY g, n""")
def stratum_shift(spark, sf_dir):
    return rounded(dg.stratum_shift(read_table(spark, sf_dir, "customer"), ["c_acctbal"], "c_mktsegment", "BUILDING"), "ks_statistic", "median_shift_iqr")


@query("""
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS rho FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) + 0.0 FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) + 0.0 FROM lineitem""")
def feature_correlation(spark, sf_dir):
    return rounded(dg.feature_correlation(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "rho")


@query("""
WITH x AS (SELECT dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, c_acctbal AS v FROM customer), g AS (SELECT count(*) AS t, avg(v) AS m FROM x),
p AS (SELECT code, count(*) AS n, avg(v) AS pm, var_pop(v) AS pv FROM x GROUP BY 1)
SELECT 'c_acctbal' AS feature, round((sum(n * (pm - m) ** 2) / (count(*) - 1)) / (sum(n * pv) / (any_value(t) - count(*))), 6) AS f_stat,
       arg_max(code, pm)::BIGINT AS high, arg_min(code, pm)::BIGINT AS low FROM p, g""")
def discriminative_f(spark, sf_dir):
    df = read_table(spark, sf_dir, "customer")
    codes = dense_codes(df, "c_mktsegment", "c_custkey")
    out = dg.discriminative_features(df.join(codes, "c_custkey"), ["c_acctbal"])
    return rounded(out.select("feature", "f_stat", "high", "low"), "f_stat")


# neighbours


@query(KNN_SQL + "SELECT src, dst, round(dist, 6) AS dist, rank::INT AS rank FROM k")
def knn_edges(spark, sf_dir):
    return rounded(edges(spark, sf_dir), "dist")


@query(KNN_SQL + "SELECT a.src, round(avg(CASE WHEN b.src IS NULL THEN 0.0 ELSE 1.0 END), 6) AS mutual_fraction FROM k a LEFT JOIN k b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def mutual_fraction(spark, sf_dir):
    return rounded(kn.mutual_fraction(edges(spark, sf_dir)), "mutual_fraction")


@query(KNN_SQL + "SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM k GROUP BY ALL HAVING count(*) = 2")
def mutual_graph(spark, sf_dir):
    return kn.knn_graph(edges(spark, sf_dir), mutual_only=True)


@query(KNN_SQL + ", w AS (SELECT src, dst, exp(-dist / avg(dist) OVER (PARTITION BY src)) AS w FROM k) SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(w), 6) AS weight FROM w GROUP BY ALL")
def knn_distance_weights(spark, sf_dir):
    return rounded(kn.distance_weights(edges(spark, sf_dir)), "weight")


@query(KNN_SQL + """
, h AS (SELECT src, list(dst) || [src] AS near FROM k GROUP BY src), e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM k)
SELECT a, b, round(len(list_intersect(x.near, y.near)) / len(list_distinct(x.near || y.near)), 6) AS weight FROM e JOIN h x ON x.src = a JOIN h y ON y.src = b
WHERE len(list_intersect(x.near, y.near)) > 0""")
def snn_jaccard(spark, sf_dir):
    return rounded(kn.jaccard_weights(edges(spark, sf_dir)), "weight")


@query()
def umap_fuzzy(spark, sf_dir):
    return rounded(kn.fuzzy_weights(edges(spark, sf_dir)), "weight")


@query(KNN_SQL + "SELECT src, round(avg((x.code = y.code)::INT), 6) AS purity FROM k JOIN v x ON x.id = src JOIN v y ON y.id = dst GROUP BY src")
def neighborhood_purity(spark, sf_dir):
    return rounded(kn.purity(edges(spark, sf_dir), vectors(spark, sf_dir)), "purity")


VOTE_SQL = """, n AS (SELECT src, y.code, count(*) AS n FROM k JOIN v y ON y.id = dst GROUP BY ALL),
r AS (SELECT src, code, n / sum(n) OVER (PARTITION BY src) AS share, row_number() OVER (PARTITION BY src ORDER BY n DESC, code) AS r FROM n)"""


@query(KNN_SQL + VOTE_SQL + "SELECT src, code, round(share, 6) AS confidence FROM r WHERE r = 1")
def knn_vote(spark, sf_dir):
    return rounded(kn.vote(edges(spark, sf_dir), vectors(spark, sf_dir)), "confidence")


@query(KNN_SQL + VOTE_SQL + """
SELECT id AS src, v.code, round(coalesce(o.share, 0), 6) AS own_fraction, t.code AS top_other, round(coalesce(t.share, 0), 6) AS top_other_fraction,
       CASE WHEN coalesce(o.share, 0) > 0.5 THEN 'own' WHEN coalesce(t.share, 0) > 0.5 THEN 'other' ELSE 'mixed' END AS verdict
FROM v LEFT JOIN r o ON o.src = id AND o.code = v.code
LEFT JOIN (SELECT r.src, arg_max(r.code, (r.share, -r.code)) AS code, max(r.share) AS share FROM r JOIN v ON v.id = r.src AND v.code <> r.code GROUP BY r.src) t ON t.src = id""")
def triage_labels(spark, sf_dir):
    return rounded(kn.triage(edges(spark, sf_dir), vectors(spark, sf_dir)), "own_fraction", "top_other_fraction")


@query(KNN_SQL + VOTE_SQL + "SELECT v.code AS label, count(*) AS n, round(avg((r.code = v.code)::INT), 6) AS recovered FROM r JOIN v ON id = src WHERE r.r = 1 GROUP BY 1")
def loo_recovery(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    scored = kn.vote(edges(spark, sf_dir), rows).select(F.col("src").alias("cell_id"), F.col("code").alias("predicted")).join(rows.select("cell_id", F.col("code").alias("truth")), "cell_id")
    return rounded(tr.recovery_by_label(scored).select("label", "n", "recovered"), "recovered")


@query(KNN_SQL + """
, s AS (SELECT src, id % 2 AS stratum, x.code AS d, avg((x.code = y.code)::INT) AS share FROM k JOIN v x ON x.id = src JOIN v y ON y.id = dst GROUP BY ALL),
c AS (SELECT id % 2 AS stratum, code AS d, count(*) AS nd FROM v GROUP BY ALL), e AS (SELECT stratum, d, (nd - 1) / (sum(nd) OVER (PARTITION BY stratum) - 1) AS expected FROM c)
SELECT d AS dataset, stratum, count(*) AS n_cells, round(avg(share), 6) AS observed, round(avg(expected), 6) AS expected, round(avg(share) - avg(expected), 6) + 0.0 AS gap
FROM s JOIN e USING (stratum, d) GROUP BY GROUPING SETS ((), (d), (d, stratum))""".replace("src, id % 2", "src, x.id % 2"))
def dataset_mixing(spark, sf_dir):
    cells = vectors(spark, sf_dir).select("cell_id", "code", (F.col("cell_id") % 2).alias("stratum"))
    return rounded(dg.dataset_mixing(edges(spark, sf_dir), cells), "observed", "expected", "gap")


@query(KNN_SQL + "SELECT count(*) AS n FROM k")
def knn_edge_count(spark, sf_dir):
    return edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


# datasets


def two_datasets(spark, sf_dir):
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("stratum")))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x")).join(nation, "k").drop("k")
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x")).join(nation, "k").drop("k")
    return ds.stacked({"customer": c, "supplier": s}, "id")


DATASET_SQL = """WITH d AS (
  SELECT 'customer:' || c_custkey AS cell_id, 'customer' AS dataset, c_custkey::VARCHAR AS source_id, c_acctbal AS x, n_regionkey::BIGINT AS stratum FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_suppkey::VARCHAR, s_acctbal, n_regionkey::BIGINT FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(DATASET_SQL + """, m AS (SELECT dataset, stratum, avg(x) AS a, stddev_pop(x) AS s FROM d GROUP BY ALL)
SELECT d.cell_id, d.dataset, d.stratum, round(CASE WHEN d.dataset = 'customer' THEN x ELSE (x - o.a) / CASE WHEN o.s > 0 THEN o.s ELSE 1 END * r.s + r.a END, 5) + 0.0 AS x
FROM d JOIN m o ON o.dataset = d.dataset AND o.stratum = d.stratum JOIN m r ON r.dataset = 'customer' AND r.stratum = d.stratum""")
def join_datasets_standard(spark, sf_dir):
    out = ds.harmonized(two_datasets(spark, sf_dir), ["x"], "customer", min_cells=1)
    return rounded(out.select("cell_id", "dataset", "stratum", "x"), "x", digits=5)


@query(DATASET_SQL + "SELECT cell_id, dataset, source_id FROM d WHERE stratum = 2")
def source_ids(spark, sf_dir):
    both = two_datasets(spark, sf_dir)
    return ds.source_ids(both, both.filter("stratum = 2"))


@query(DATASET_SQL + "SELECT dataset, source_id, stratum AS code FROM d")
def labels_by_dataset(spark, sf_dir):
    both = two_datasets(spark, sf_dir)
    return ds.labels_by_dataset(both, both.select("cell_id", F.col("stratum").alias("code")))


# consensus


SUMMARY_SQL = """, s AS (SELECT run, label, count(*) AS n FROM p GROUP BY ALL), rs AS (
SELECT r.run::BIGINT AS run, graph_type, n_neighbors, resolution::DOUBLE AS resolution, count(*) FILTER (label >= 0)::BIGINT AS n_clusters,
       coalesce(sum(n) FILTER (label < 0), 0)::BIGINT AS n_unassigned, coalesce(max(n) FILTER (label >= 0), 0)::BIGINT AS largest_cluster
FROM runs r JOIN s ON s.run = r.run GROUP BY ALL) """


@query(PARTITION_SQL + SUMMARY_SQL + "SELECT * FROM rs")
def run_summary(spark, sf_dir):
    return cs.run_summary(*partitions(spark, sf_dir))


@query(PARTITION_SQL + SUMMARY_SQL + """SELECT graph_type, n_neighbors, resolution, count(*) AS n_runs, min(n_clusters) AS min_clusters, median(n_clusters)::DOUBLE AS median_clusters,
max(n_clusters) AS max_clusters, avg(n_unassigned) AS mean_unassigned FROM rs GROUP BY ALL""")
def by_setting(spark, sf_dir):
    return cs.by_setting(cs.run_summary(*partitions(spark, sf_dir)))


PAIRS_SQL = """, co AS (SELECT a.cell_id AS i, b.cell_id AS j, count(*) AS co FROM p a JOIN p b ON a.run = b.run AND a.label = b.label AND a.label >= 0 AND a.cell_id < b.cell_id GROUP BY ALL),
ok AS (SELECT a.cell_id AS i, b.cell_id AS j, count(*) AS kept FROM p a JOIN p b ON a.run = b.run AND a.label >= 0 AND b.label >= 0 AND a.cell_id < b.cell_id GROUP BY ALL),
f AS (SELECT i, j, co / kept AS freq FROM co JOIN ok USING (i, j)), ff AS (SELECT i, j, freq FROM f UNION ALL SELECT j, i, freq FROM f) """


@query(PARTITION_SQL + PAIRS_SQL + "SELECT i, j, round(freq, 6) AS freq FROM f")
def coclustering_pairs(spark, sf_dir):
    return cs.coclustering(partitions(spark, sf_dir)[0], digits=6)


@query(PARTITION_SQL + PAIRS_SQL + "SELECT cell_id, round(coalesce(max(freq), 0), 6) AS strength FROM u LEFT JOIN ff ON i = cell_id GROUP BY 1")
def consensus_strength(spark, sf_dir):
    rows, _ = partitions(spark, sf_dir)
    return rounded(cs.strength_of(rows, rows.select("cell_id").distinct()), "strength")


CODES_SQL = ", q AS (SELECT cell_id, (cell_id % 3)::BIGINT AS code FROM u), z AS (SELECT code, count(*) AS n FROM q GROUP BY 1) "


def three_codes(rows: DataFrame) -> DataFrame:
    return rows.select("cell_id").distinct().withColumn("code", F.col("cell_id") % 3)


@query(PARTITION_SQL + PAIRS_SQL + CODES_SQL + """SELECT i AS cell_id, b.code, round(sum(freq) / greatest(any_value(n) - (any_value(a.code) = b.code)::INT, 1), 6) AS share
FROM ff JOIN q b ON b.cell_id = j JOIN z ON z.code = b.code JOIN q a ON a.cell_id = i GROUP BY i, b.code""")
def soft_labels(spark, sf_dir):
    rows, _ = partitions(spark, sf_dir)
    return rounded(cs.soft_labels_of(rows, three_codes(rows)), "share")


@query(PARTITION_SQL + PAIRS_SQL + CODES_SQL + """, s AS (SELECT a.code AS a, b.code AS b, sum(freq) AS s FROM ff JOIN q a ON a.cell_id = i JOIN q b ON b.cell_id = j GROUP BY ALL
UNION ALL SELECT code, code, n FROM z) SELECT a, b, round(sum(s) / any_value(x.n * y.n), 6) AS mean FROM s JOIN z x ON x.code = a JOIN z y ON y.code = b GROUP BY ALL""")
def block_means(spark, sf_dir):
    rows, _ = partitions(spark, sf_dir)
    return rounded(cs.block_means_of(rows, three_codes(rows)), "mean")


@query(PARTITION_SQL + SUMMARY_SQL + """SELECT count(*) AS n_runs_total, count(*) FILTER (resolution >= 1)::BIGINT AS n_runs_in_window, count(DISTINCT n_neighbors) AS n_axes_total,
count(DISTINCT n_neighbors) FILTER (resolution >= 1) AS n_axes_in_window,
CASE WHEN count(*) FILTER (resolution >= 1) = 0 THEN 'empty' WHEN count(*) FILTER (resolution >= 1) < 10 THEN 'thin' WHEN count(DISTINCT n_neighbors) FILTER (resolution >= 1) = 1 AND count(DISTINCT n_neighbors) > 1 THEN 'un-marginalised'
WHEN 2 * count(DISTINCT n_neighbors) FILTER (resolution >= 1) < count(DISTINCT n_neighbors) THEN 'lopsided' ELSE 'ok' END AS verdict FROM rs""")
def grain_coverage(spark, sf_dir):
    return cs.grain_coverage(cs.run_summary(*partitions(spark, sf_dir)), resolution_min=1.0)


@query("""WITH s AS (SELECT i / 10.0 AS t, 1 + i // 4 AS c FROM range(0, 20) r(i))
SELECT c::BIGINT AS n_clusters, round(min(t), 6)::DOUBLE AS lo, round(max(t), 6)::DOUBLE AS hi, round((min(t) + max(t)) / 2, 6)::DOUBLE AS midpoint, round(max(t) - min(t), 6)::DOUBLE AS width, count(*) AS n_points FROM s WHERE c > 1 GROUP BY c""")
def plateaus(spark, sf_dir):
    scan = spark.range(20).select((F.col("id") / 10).alias("distance_threshold"), (F.lit(1) + F.floor(F.col("id") / 4)).alias("n_clusters"))
    return rounded(cs.plateaus(scan), "lo", "hi", "midpoint", "width")


@query()
def consensus_plateaus(spark, sf_dir):
    """Plateaus of the cluster count over cuts of the users' hierarchy, at every hundredth of its height."""
    _, labels = cs.label_matrix(partitions(spark, sf_dir)[0])
    scan = cs.threshold_scan(cs.linkage_of(labels), len(labels), np.arange(101) / 100)
    return rounded(cs.plateaus(spark.createDataFrame(scan)), "lo", "hi", "midpoint", "width")


@query()
def leiden_consensus(spark, sf_dir):
    graph = kn.distance_weights(edges(spark, sf_dir)).select(F.lit(0).alias("graph"), "a", "b", "weight")
    runs = spark.createDataFrame([(i, 0, 0.5 + 0.5 * i) for i in range(4)], "run long, graph int, resolution double")
    return cs.leiden_runs(graph, runs)  # every row has neighbours, so every row has an edge


# transfer and validation


BRIDGE_SQL = KNN_SQL + """, x AS (SELECT a.id AS tgt, b.id AS src, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS r, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1),
y AS (SELECT a.id AS src, b.id AS tgt, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS r FROM v a JOIN v b ON a.id % 2 = 1 AND b.id % 2 = 0),
m AS (SELECT x.tgt, x.src, 1 / count(*) OVER (PARTITION BY x.tgt) AS w FROM x JOIN y ON x.tgt = y.tgt AND x.src = y.src WHERE x.r <= 10 AND y.r <= 10),
c AS (SELECT tgt, code, sum(w) AS s FROM m JOIN v ON id = src GROUP BY ALL) """


def bridge(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    a, b = rows.filter("cell_id % 2 = 0"), rows.filter("cell_id % 2 = 1")
    return a, b, tr.cross_votes(kn.knn(a, b, 10, exclude_self=False), kn.knn(b, a, 10, exclude_self=False))


@query(BRIDGE_SQL + """, t AS (SELECT tgt, code, s, row_number() OVER (PARTITION BY tgt ORDER BY round(s, 9) DESC, code) AS r, sum(s) OVER (PARTITION BY tgt) AS total FROM c)
SELECT id AS tgt, coalesce(t.code, -1) AS code, round(coalesce(s / total, 0), 6) AS confidence FROM v LEFT JOIN t ON tgt = id AND r = 1 WHERE id % 2 = 0""")
def carry_votes(spark, sf_dir):
    a, b, votes = bridge(spark, sf_dir)
    return rounded(tr.carry(votes.withColumn("w", F.round("w", 12)), b, a), "confidence")


@query("""
WITH x AS (SELECT quality AS code, lang AS audit, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, audit) AS r FROM x)
SELECT code::BIGINT AS cluster, sum(n)::BIGINT AS n_cells, count(*) AS n_audit_labels, max(audit) FILTER (r = 1) AS dominant, round(max(n) FILTER (r = 1) / sum(n), 6) AS purity, 0::BIGINT AS n_audit_null FROM t GROUP BY code""")
def label_purity(spark, sf_dir):
    codes = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id"), F.col("quality").cast("long").alias("code"))
    return rounded(va.label_purity(codes, read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("audit"))), "purity")


@query("SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS fraction FROM (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL)")
def confusion(spark, sf_dir):
    return rounded(va.confusion(read_table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))), "fraction")


@query("""
WITH c AS (SELECT c_nationkey % 3 AS class_id, c_acctbal AS score FROM customer), t AS (SELECT s_suppkey AS cell_id, s_nationkey % 3 AS class_id, s_acctbal AS score FROM supplier)
SELECT t.cell_id, t.class_id, round((count(*) FILTER (c.score >= t.score) + 1) / (count(*) + 1), 6) AS p_value FROM t JOIN c USING (class_id) GROUP BY ALL""")
def conformal_p_values(spark, sf_dir):
    cal = read_table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("class_id"), F.col("c_acctbal").alias("score"))
    test = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 3).alias("class_id"), F.col("s_acctbal").alias("score"))
    return rounded(va.conformal_p_values(cal, test), "p_value")


@query("""
WITH s AS (SELECT l_discount AS conf, (l_returnflag <> 'N')::INT AS wrong FROM lineitem), g AS (SELECT conf AS cut, count(*) AS n, sum(wrong) AS w FROM s GROUP BY 1)
SELECT cut, (sum(n) OVER o)::BIGINT AS n_kept, round((sum(n) OVER o) / (sum(n) OVER ()), 6) AS kept_fraction, round((sum(w) OVER o) / (sum(n) OVER o), 6) AS error_rate FROM g WINDOW o AS (ORDER BY cut DESC)""")
def confidence_curve(spark, sf_dir):
    scored = read_table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("confidence"), F.lit(0).alias("truth"), (F.col("l_returnflag") != "N").cast("int").alias("predicted"))
    return rounded(tr.confidence_curve(scored), "kept_fraction", "error_rate")


@query()
def spread_labels(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    seeds = rows.select("cell_id", F.when(F.col("cell_id") % 5 == 0, F.col("code")).otherwise(-1).alias("code"))
    return rounded(tr.spread(tr.transition(edges(spark, sf_dir), mutual=False), seeds), "confidence")


# spaces and gradients


@query()
def pca_spectrum(spark, sf_dir):
    return spark.createDataFrame(fit_space(vectors(spark, sf_dir)).spectrum())


@query()
def pca_coordinates(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return fit_space(rows, explained=2).transform(rows, "cell_id")


@query()
def principal_curve(spark, sf_dir):
    return gr.principal_curve(vectors(spark, sf_dir))[1]


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)
SELECT ((l_extendedprice >= q[1])::INT + (l_extendedprice >= q[2])::INT + (l_extendedprice >= q[3])::INT)::BIGINT AS code, count(*) AS n FROM lineitem, q GROUP BY 1""")
def gradient_bins(spark, sf_dir):
    coords = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_extendedprice").alias("coord"))
    return gr.binned(coords, 4).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    return rounded(windowed_counts(read_table(spark, sf_dir, "events")), "total", digits=4)


# boundaries, outliers, shift


@query(KNN_SQL + """, g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM k),
d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM g UNION ALL SELECT b FROM g) GROUP BY id),
h AS (SELECT src AS id, 1 / max(dist) AS rho FROM k GROUP BY src),
s AS (SELECT code, count(*) AS n, sum(degree) AS volume, quantile_cont(rho, 0.9) AS peak FROM v JOIN d USING (id) JOIN h USING (id) GROUP BY code),
c AS (SELECT least(x.code, y.code) AS ca, greatest(x.code, y.code) AS cb, count(*) AS seen, max(least(hx.rho, hy.rho)) AS saddle
      FROM g JOIN v x ON x.id = g.a JOIN v y ON y.id = g.b JOIN h hx ON hx.id = g.a JOIN h hy ON hy.id = g.b WHERE x.code <> y.code GROUP BY ALL),
r AS (SELECT s.code AS cluster_a, t.code AS cluster_b, s.n AS n_a, t.n AS n_b, coalesce(seen, 0) / (s.volume * t.volume / (2.0 * (SELECT count(*) FROM g))) AS con,
      coalesce(saddle, 0) / least(s.peak, t.peak) AS val FROM s JOIN s t ON s.code < t.code LEFT JOIN c ON ca = s.code AND cb = t.code),
o AS (SELECT *, CASE WHEN con < 0.1 THEN 'discrete' WHEN con > 0.5 THEN 'continuous' END AS vc, CASE WHEN val < 0.5 THEN 'discrete' ELSE 'continuous' END AS vv FROM r)
SELECT cluster_a, cluster_b, n_a, n_b, CASE WHEN least(n_a, n_b) >= 10 THEN round(con, 6) END AS connectivity_ratio, CASE WHEN least(n_a, n_b) >= 10 THEN round(val, 6) END AS valley_ratio,
       CASE WHEN least(n_a, n_b) < 10 THEN 'too_small' WHEN vc = vv THEN vc ELSE 'ambiguous' END AS verdict FROM o""")
def boundary_edges(spark, sf_dir):
    out = bd.boundary_report(vectors(spark, sf_dir), edges(spark, sf_dir), dips=False)
    return rounded(out.select("cluster_a", "cluster_b", "n_a", "n_b", "connectivity_ratio", "valley_ratio", "verdict"), "connectivity_ratio", "valley_ratio")


@query()
def boundary_report(spark, sf_dir):
    return bd.boundary_report(vectors(spark, sf_dir), edges(spark, sf_dir))


@query()
def outlier_scores(spark, sf_dir):
    return ot.outlier_score(vectors(spark, sf_dir))


@query("""
WITH c AS (SELECT c_nationkey % 3 AS class_id, c_acctbal AS score, 1 + c_nationkey % 4 AS weight FROM customer),
t AS (SELECT s_suppkey AS cell_id, s_nationkey % 3 AS class_id, s_acctbal AS score, 1 + s_nationkey % 4 AS weight FROM supplier)
SELECT t.cell_id, t.class_id, round((coalesce(sum(c.weight) FILTER (c.score >= t.score), 0) + t.weight) / (sum(c.weight) + t.weight), 6) AS p_value FROM t JOIN c USING (class_id) GROUP BY t.cell_id, t.class_id, t.weight""")
def weighted_p_values(spark, sf_dir):
    def scores(key):
        return ((F.col(f"{key}_nationkey") % 3).alias("class_id"), F.col(f"{key}_acctbal").alias("score"), (1 + F.col(f"{key}_nationkey") % 4).cast("double").alias("weight"))

    cal = read_table(spark, sf_dir, "customer").select(*scores("c"))
    test = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), *scores("s"))
    return rounded(va.weighted_p_values(cal, test), "p_value")


# ladders, anchors, paths


@query()
def ladder_labels(spark, sf_dir):
    """Parts without a price are labelled by their size alone."""
    part = read_table(spark, sf_dir, "part").withColumns({"p_size": F.col("p_size").cast("double"), "p_retailprice": F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice"))})
    frame = CellFrame(part, ["p_size", "p_retailprice"], id_col="p_partkey", check=False)
    codes = part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("cell_id"), (F.col("p_size") > 25).cast("long").alias("code"))
    return rounded(tr.propagate_ladder(frame, codes, [["p_size", "p_retailprice"], ["p_size"]], k=10), "confidence")


@query("""
WITH n AS (SELECT n_regionkey AS r, n_nationkey AS c, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
g AS (SELECT r, sum(n) AS n, max(n) / sum(n) AS e, list(c ORDER BY c) FILTER (n >= 3) AS parts, sum(n) FILTER (n >= 3) AS held FROM n GROUP BY r),
s AS (SELECT * FROM g WHERE len(parts) >= 2 AND held / n >= 0.85 AND e < 0.7)
SELECT 'split' AS kind, 'split' AS support, [r]::BIGINT[] AS a, parts::BIGINT[] AS b, n::BIGINT AS n_a, held::BIGINT AS n_b, round(e, 6) AS efficiency_ab, 1.0::DOUBLE AS efficiency_ba FROM s
UNION ALL SELECT 'nested', 'nested', [r]::BIGINT[], [c]::BIGINT[], g.n::BIGINT, n.n::BIGINT, NULL, 1.0 FROM n JOIN g USING (r) WHERE n.n >= 3 AND r NOT IN (SELECT r FROM s)""")
def bridge_anchors(spark, sf_dir):
    """Regions against nations: every customer is its own bridge."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation"))  # 25 rows in any size
    both = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a, b = (both.select(F.col("c_custkey").alias("cell_id"), F.col(c).cast("long").alias("code")) for c in ("n_regionkey", "n_nationkey"))
    votes = a.select(F.col("cell_id").alias("tgt"), F.col("cell_id").alias("src"), F.lit(1.0).alias("w"))
    sides = [tr.verdicts(tr.carried_purity(votes, x, y), tr.carried_purity(votes, x, x), small=1) for x, y in ((a, b), (b, a))]
    ab = tr.mutual_verdicts(sides[0], sides[1], tr.carried_mass(votes, a, b))
    ba = tr.mutual_verdicts(sides[1], sides[0], tr.carried_mass(votes, b, a))
    return rounded(tr.anchors(ab, ba), "efficiency_ab", "efficiency_ba")


@query()
def path_recovery(spark, sf_dir):
    return va.path_recovery(kn.distance_weights(edges(spark, sf_dir)), vectors(spark, sf_dir), max_sources=None)


@query()
def density_ratio(spark, sf_dir):
    """Customers weighted towards the balances of suppliers."""
    cal, target = (read_table(spark, sf_dir, t).select(F.col(k).alias("cell_id"), (F.col(b) / 1000).alias("balance")) for t, k, b in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal")))
    return rounded(va.density_ratio_weights(cal, target, ["balance"]), "weight", digits=4)


@query()
def crossfit_p_values(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("code", F.when(F.col("cell_id") % 4 > 0, F.col("code") % 2).otherwise(-1))
    return rounded(va.crossfit_assessment(rows, folds=3), "p_value")


from tessella.plans import results  # noqa: E402, F401  registers further queries
