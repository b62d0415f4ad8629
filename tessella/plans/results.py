"""Registered queries of the table's own verbs and results, each beside its SQL. Names of the catalog are used; the catalog takes these in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import assignment as asg
from tessella.operators import bridge as br
from tessella.operators import consensus as cs
from tessella.operators import diagnostics as dg
from tessella.operators import gradient as gr
from tessella.operators import knn as kn
from tessella.operators import propagation as pp
from tessella.operators import stability as st
from tessella.operators import transfer as tr
from tessella.operators import validate as va
from tessella.operators.frame import CellFrame
from tessella.operators.labels import LabelSet
from tessella.plans.catalog import CUSTOMER_SQL, KNN_SQL, BRIDGE_SQL, PARTITION_SQL, bridge, edges, part_frame, partitions, query, rounded, vectors
from tessella.sources.store import read_table

# tables


@query("SELECT c_custkey, c_acctbal, c_name FROM customer")
def id_map_join(spark, sf_dir):
    """Customers keyed by a name that a map brings in."""
    rows = read_table(spark, sf_dir, "customer")
    return CellFrame(rows.select("c_custkey", "c_acctbal"), ["c_acctbal"], id_col="c_name", id_map=rows.select("c_custkey", "c_name")).view()


@query("""SELECT c_custkey, c_acctbal, n_orders, round(spent, 2) AS spent FROM customer
LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def added_features(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    frame = CellFrame(read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], id_col="c_custkey", check=False)
    return rounded(frame.add_features(orders, allow_missing=True, collection="orders").view(), "spent", digits=2)


@query("SELECT * FROM (VALUES ('p_size', 'shape'), ('p_retailprice', NULL)) AS t(feature_id, family)")
def feature_metadata(spark, sf_dir):
    frame = part_frame(spark, sf_dir)
    frame.metadata = spark.createDataFrame([("p_size", "shape")], "feature_id string, family string")
    return frame.var


@query("SELECT p_partkey, [true, p_size > 25] AS valid FROM part")
def validity_flags(spark, sf_dir):
    frame = part_frame(spark, sf_dir).add_mask("large", F.col("p_size") > 25).set_validity(["p_retailprice"], "large")
    return frame.validity_matrix()


@query("""SELECT p_partkey, p_size::DOUBLE AS p_size, round(p_retailprice / 100, 6) AS map0, p_size * 2.0::DOUBLE AS map1, CASE WHEN p_brand <> 'Brand#11' THEN p_brand END AS brand,
CASE WHEN p_brand <> 'Brand#11' THEN (SELECT count(DISTINCT q.p_brand) FROM part q WHERE q.p_brand <> 'Brand#11' AND q.p_brand < part.p_brand) ELSE -1 END::BIGINT AS brand_id FROM part WHERE p_size > 25""")
def joined_view(spark, sf_dir):
    """A masked view with outside coordinates and labels joined to it."""
    frame = part_frame(spark, sf_dir).add_mask("large", F.col("p_size") > 25)
    frame.add_embedding(frame.df.select("p_partkey", F.round(F.col("p_retailprice") / 100, 6).alias("x"), (F.col("p_size") * 2).alias("y")), "large", name="map")
    labels = LabelSet.from_labels(frame.df, "p_brand", id_col="p_partkey", name="brand", unassigned=("Brand#11",))
    return frame.dataframe("large", columns=["p_size"], embedding="map", labels=labels).select("p_partkey", "p_size", "map0", "map1", "brand", "brand_id")


@query("""WITH c AS (SELECT 10000000 AS big), a AS (SELECT greatest((SELECT count(*) FROM customer), (SELECT count(*) FROM supplier)) AS n),
b AS (SELECT pow(10, length(n::VARCHAR))::BIGINT AS block FROM a), m AS (SELECT avg(c_acctbal) AS ca, stddev_pop(c_acctbal) AS cs FROM customer), s AS (SELECT avg(s_acctbal) AS sa, stddev_pop(s_acctbal) AS ss FROM supplier)
SELECT (block + row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS cell_id, 'customers' AS dataset, c_custkey AS source_cell_id, round(c_acctbal, 4) + 0.0 AS balance, c_acctbal > 0 AS positive FROM customer, b
UNION ALL SELECT (2 * block + row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT, 'suppliers', s_suppkey, round((s_acctbal - sa) / ss * cs + ca, 4) + 0.0, s_acctbal > 0 FROM supplier, b, m, s""")
def join_datasets_ids(spark, sf_dir):
    """Customers and suppliers as one table in the customers' units, ids, values and a carried mask."""
    tables = {}
    for name, key in (("customers", "c"), ("suppliers", "s")):
        own = read_table(spark, sf_dir, name[:-1])
        ident = own.columns[0]
        rows = own.select(F.col(ident).alias(f"{key}_id"), F.col(f"{key}_acctbal").alias("balance"))
        tables[name] = CellFrame(rows, ["balance"], id_col=f"{key}_id", check=False).add_mask("positive", F.col("balance") > 0)
    joined = CellFrame.join_datasets(tables, min_cells=2)
    return rounded(joined.df.select("cell_id", "dataset", "source_cell_id", "balance", joined.mask("positive").alias("positive")), "balance", digits=4)


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, list_transform(range(0, 21), lambda r: (1 + 98 * r / 20.0) / 100)) AS q FROM part),
x AS (SELECT p_partkey, least(greatest(p_retailprice, q[1]), q[21]) AS v, greatest(1, least(20, len(list_filter(q, lambda m: m <= p_retailprice)))) AS k, q FROM part, q)
SELECT p_partkey, round((k - 1 + CASE WHEN q[k + 1] > q[k] THEN (v - q[k]) / (q[k + 1] - q[k]) ELSE 0 END) / 20, 6) AS p_retailprice FROM x""")
def quantile_uniform(spark, sf_dir):
    from tessella.functions.scalers import quantile_scaled

    return rounded(quantile_scaled(read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], n_quantiles=21, normal=False), "p_retailprice")


# labels


@query("SELECT c_custkey AS cell_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS name FROM customer")
def decoded_labels(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), "c_mktsegment")
    return LabelSet.from_labels(rows, "c_mktsegment", unassigned=("BUILDING",)).to_names()


#: Agreement of contingencies t(g, a, b, n) by g; -1 is unassigned.
SCORES_SQL = """, t2 AS (SELECT * FROM t WHERE a >= 0 AND b >= 0), ma AS (SELECT g, a, sum(n) AS m FROM t2 GROUP BY ALL), mb AS (SELECT g, b, sum(n) AS m FROM t2 GROUP BY ALL),
pa AS (SELECT g, sum(m * (m - 1) / 2.0) AS p, sum(m * ln(m)) AS h FROM ma GROUP BY g), pb AS (SELECT g, sum(m * (m - 1) / 2.0) AS p, sum(m * ln(m)) AS h FROM mb GROUP BY g),
pt AS (SELECT g, sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2.0) AS s, sum(n * ln(n)) AS h FROM t2 GROUP BY g),
un AS (SELECT g, sum(n) FILTER (a >= 0) AS na, sum(n) FILTER (b >= 0) AS nb, sum(n) FILTER (a >= 0 OR b >= 0) AS nn FROM t GROUP BY g),
sc AS (SELECT g, n, na, nb, n / nn AS coverage, CASE WHEN abs((pa.p + pb.p) / 2 - pa.p * pb.p / (n * (n - 1) / 2)) < 1e-12 THEN 1.0 ELSE (s - pa.p * pb.p / (n * (n - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (n * (n - 1) / 2)) END AS ari,
(ln(n) + (pt.h - pa.h - pb.h) / n) / (((ln(n) - pa.h / n) + (ln(n) - pb.h / n)) / 2) AS nmi, s / sqrt(pa.p * pb.p) AS fmi, s / (pa.p + pb.p - s) AS jaccard
FROM pt JOIN pa USING (g) JOIN pb USING (g) JOIN un USING (g)) """


@query("""WITH t AS (SELECT 0 AS g, CASE WHEN c_mktsegment <> 'BUILDING' THEN dense_rank() OVER (ORDER BY c_mktsegment) ELSE -1 END AS a, CASE WHEN n_regionkey > 0 THEN n_regionkey ELSE -1 END AS b, 1 AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey), t0 AS (SELECT g, a, b, count(*) AS n FROM t GROUP BY ALL)""" + SCORES_SQL.replace("FROM t ", "FROM t0 ").replace("FROM t WHERE", "FROM t0 WHERE")
+ "SELECT round(ari, 6) + 0.0 AS ari, round(nmi, 6) + 0.0 AS nmi, round(fmi, 6) AS fmi, round(jaccard, 6) AS jaccard, n::BIGINT AS n, na::BIGINT AS n_a_assigned, nb::BIGINT AS n_b_assigned, round(coverage, 6) AS coverage FROM sc")
def agreement_partial(spark, sf_dir):
    """Segments against regions, each with unassigned cells."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation"))  # 25 rows in any size
    rows = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("c_custkey", "cell_id")
    frame = CellFrame(rows.select("cell_id", "c_acctbal"), ["c_acctbal"], check=False)
    segment = LabelSet.from_labels(rows, "c_mktsegment", unassigned=("BUILDING",))
    region = LabelSet(rows.select("cell_id", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).otherwise(-1).cast("long").alias("code")))
    return rounded(frame.compare(segment, region), "ari", "nmi", "fmi", "jaccard", "coverage")


@query(PARTITION_SQL + ", t AS (SELECT 'r' || x.run || ' r' || y.run AS g, x.label AS a, y.label AS b, count(*) AS n FROM p x JOIN p y ON x.cell_id = y.cell_id AND x.run < y.run GROUP BY ALL)" + SCORES_SQL
+ """, o AS (SELECT split_part(g, ' ', 1) AS a, split_part(g, ' ', 2) AS b, round(ari, 6) + 0.0 AS value FROM sc)
SELECT a, b, value FROM o UNION ALL SELECT b, a, value FROM o UNION ALL SELECT DISTINCT 'r' || run, 'r' || run, 1.0 FROM p""")
def compare_many(spark, sf_dir):
    from tessella.operators import agreement as ag

    rows, _ = partitions(spark, sf_dir)
    return rounded(ag.compare_many(rows.select("cell_id", F.concat(F.lit("r"), F.col("run").cast("string")).alias("name"), F.col("label").alias("code"))), "value")


@query(PARTITION_SQL + ", t AS (SELECT run AS g, label AS a, cell_id % 3 AS b, count(*) AS n FROM p GROUP BY ALL)" + SCORES_SQL
+ """, k AS (SELECT run AS g, count(DISTINCT label) FILTER (label >= 0) AS k FROM p GROUP BY 1)
SELECT graph_type, n_neighbors, count(*) AS n_runs, quantile_cont(k, 0.5)::DOUBLE AS median_clusters, round(avg(ari), 6) + 0.0 AS mean_ari, round(quantile_cont(ari, 0.5), 6) + 0.0 AS median_ari, round(min(ari), 6) + 0.0 AS min_ari, round(max(ari), 6) + 0.0 AS max_ari
FROM sc JOIN runs ON run = g JOIN k USING (g) GROUP BY ALL""")
def axis_stability(spark, sf_dir):
    rows, runs = partitions(spark, sf_dir)
    reference = rows.select("cell_id").distinct().withColumn("code", F.col("cell_id") % 3)
    return rounded(cs.axis_stability(rows, cs.run_summary(rows, runs), reference, ("graph_type", "n_neighbors")), "mean_ari", "median_ari", "min_ari", "max_ari")


# runs


@query(PARTITION_SQL + """, s AS (SELECT m, side, cell_id FROM u, (VALUES (0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 3)) AS x(m, side, r) WHERE cell_id % 4 = r),
c AS (SELECT m, run, side, label, count(*) AS n FROM s JOIN p USING (cell_id) WHERE label >= 0 GROUP BY ALL), d AS (SELECT m, run, side, label, row_number() OVER (PARTITION BY m, run, side ORDER BY n DESC, label) AS r FROM c),
e AS (SELECT m, run, (count(*) = 2 AND min(label) = max(label))::INT AS agree FROM d WHERE r = 1 GROUP BY ALL)
SELECT m AS "merge", (run % 2)::INT AS band, round(avg(agree), 6) AS support FROM e GROUP BY ALL""")
def merge_support_by_band(spark, sf_dir):
    rows, runs = partitions(spark, sf_dir)
    side = F.array(*[F.struct(F.lit(m).alias("merge"), F.lit(s).alias("side"), F.lit(r).alias("r")) for m, s, r in ((0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 3))])
    sides = rows.select("cell_id").distinct().select("cell_id", F.explode(side).alias("x")).filter("cell_id % 4 = x.r").select(F.col("x.merge").alias("merge"), F.col("x.side").alias("side"), "cell_id")
    return rounded(cs.merge_support(rows, runs.select("run", (F.col("run") % 2).cast("int").alias("band")), sides), "support")


@query("""WITH r AS (SELECT doc_id, quality AS r, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE toxic + 2 * (doc_id % 2) END AS d FROM labels), p AS (SELECT r, d, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT r, sum(n) AS n FROM p GROUP BY r)
SELECT doc_id AS cell_id, round(CASE WHEN d < 0 THEN 0 ELSE p.n / s.n END, 6) AS kept FROM r JOIN p USING (r, d) JOIN s USING (r)""")
def cells_that_stayed(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "cell_id")
    drawn = rows.select("cell_id", F.when(F.col("cell_id") % 7 == 0, -1).otherwise(F.col("toxic") + 2 * (F.col("cell_id") % 2)).alias("code"))
    return rounded(st.stayed(rows.select("cell_id", F.col("quality").alias("code")), drawn), "kept")


# recovery and transfer


@query("""WITH x AS (SELECT quality = 1 AS a, toxic = 0 AS b, (1 + doc_id % 3)::DOUBLE AS w FROM labels), s AS (SELECT avg(a::INT) AS aa, avg(b::INT) AS ab, sum(w * (b::INT - a::INT)) / sum(w) AS d,
count(*) FILTER (a AND NOT b) AS oa, count(*) FILTER (b AND NOT a) AS ob FROM x),
q AS (SELECT least(1.0, 2 * sum(exp(lgamma(oa + ob + 1) - lgamma(i + 1) - lgamma(oa + ob - i + 1) - (oa + ob) * ln(2)))) AS p FROM s, range(0, 100000) r(i) WHERE i <= least(oa, ob))
SELECT 'clean' AS a, 'good' AS b, round(ab, 6) AS accuracy_a, round(aa, 6) AS accuracy_b, round(aa - ab, 6) AS delta_accuracy, round(-d, 6) AS delta_accuracy_ipw, ob AS n_correct_a_only, oa AS n_correct_b_only, oa + ob AS n_discordant,
CASE WHEN oa = ob THEN 1.0 ELSE round(p, 6) END AS mcnemar_p FROM s, q""")
def paired_recovery(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels")
    base = [F.col("doc_id").alias("cell_id"), (1 + F.col("doc_id") % 3).cast("double").alias("weight")]
    both = rows.select(F.lit("good").alias("name"), *base, (F.col("quality") == 1).alias("correct")).unionByName(rows.select(F.lit("clean").alias("name"), *base, (F.col("toxic") == 0).alias("correct")))
    out = va.paired_recovery(both)
    return rounded(out, "accuracy_a", "accuracy_b", "delta_accuracy", "delta_accuracy_ipw", "mcnemar_p")


@query("SELECT lang AS stratum, count(*) AS n, round(avg(quality), 6) AS accuracy, sum(n_chars)::BIGINT AS weight FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def recovery_by_stratum(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    scored = rows.select(F.col("doc_id").alias("cell_id"), F.lit(1).alias("truth"), F.col("quality").alias("predicted"), (F.col("quality") == 1).alias("correct"), F.col("lang").alias("stratum"), F.col("n_chars").alias("weight"))
    return rounded(st.RecoveryScore(scored).by_stratum(), "accuracy")


@query("""SELECT CASE quality WHEN 0 THEN 'low' ELSE 'high' END AS label, count(*) FILTER (p = 1) AS high, count(*) FILTER (p = 0) AS low, count(*) FILTER (p = -1) AS abstained
FROM (SELECT quality, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE toxic END AS p FROM labels) GROUP BY 1""")
def recovery_confusion(spark, sf_dir):
    scored = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id"), F.col("quality").alias("truth"), F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("toxic")).alias("predicted"))
    return pp.Recovery(scored, names={0: "low", 1: "high"}).confusion()


@query("""WITH x AS (SELECT lang AS truth, CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS predicted FROM documents), c AS (SELECT truth, predicted, count(*) AS n FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n DESC, predicted) AS k, sum(n) OVER (PARTITION BY truth) AS total FROM c)
SELECT truth, total::BIGINT AS n_cells, truth IN ('en', 'de') AS in_train, round(sum(n) FILTER (truth = predicted) / total, 6) AS recall, max(predicted) FILTER (k = 1) AS top_prediction, round(max(n) FILTER (k = 1) / total, 6) AS top_fraction FROM r GROUP BY truth, total""")
def transfer_by_label(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents")
    scored = rows.select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("truth"), F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang")).alias("predicted"))
    return rounded(asg.TransferScore(scored, ["de", "en"], "a", "b").by_label(), "recall", "top_fraction")


CONFORMAL_SQL = """WITH c AS (SELECT c_nationkey % 3 AS class_id, c_acctbal AS score FROM customer), t AS (SELECT s_suppkey AS cell_id, s_nationkey % 3 AS code, k AS class_id, s_acctbal + 1500 * k AS score FROM supplier, range(0, 3) r(k)),
p AS (SELECT t.cell_id, t.code, t.class_id, (count(*) FILTER (c.score >= t.score) + 1) / (count(*) + 1) AS p FROM t JOIN c USING (class_id) GROUP BY ALL) """


def assignment(spark, sf_dir) -> asg.Assignment:
    """Suppliers against classes calibrated on customers."""
    cal = read_table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).cast("long").alias("class_id"), F.col("c_acctbal").alias("score"))
    rows = read_table(spark, sf_dir, "supplier")
    test = rows.select(F.col("s_suppkey").alias("cell_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("class_id"), (F.col("s_acctbal") + 1500 * k).alias("score")) for k in range(3)])).alias("x")).select("cell_id", "x.*")
    truth = LabelSet(rows.select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 3).cast("long").alias("code")))
    return asg.Assignment(va.conformal_p_values(cal, test), [0, 1, 2], truth, {0: 5, 2: 7})


@query(CONFORMAL_SQL + """SELECT cell_id, round(max(p) FILTER (class_id = 0), 6) AS p_0, round(max(p) FILTER (class_id = 1), 6) AS p_1, round(max(p) FILTER (class_id = 2), 6) AS p_2, round(max(p), 6) AS plausibility,
(count(*) FILTER (p > 0.4))::INT AS set_size, CASE WHEN count(*) FILTER (p > 0.4) = 1 THEN max(class_id) FILTER (p > 0.4) ELSE -1 END::BIGINT AS assigned FROM p GROUP BY cell_id""")
def assignment_frame(spark, sf_dir):
    return rounded(assignment(spark, sf_dir).frame(alpha=0.4), "p_0", "p_1", "p_2", "plausibility")


@query(CONFORMAL_SQL + """SELECT class_id AS "class", count(*) AS n_reference, CASE class_id WHEN 0 THEN 5 WHEN 2 THEN 7 ELSE 0 END::BIGINT AS n_calibration, round(avg((p > 0.4)::INT), 6) AS coverage FROM p WHERE code = class_id GROUP BY 1""")
def assignment_coverage(spark, sf_dir):
    return rounded(assignment(spark, sf_dir).coverage(0.4), "coverage")


# neighbours and bridges


@query(KNN_SQL + "SELECT src AS cell_id, list(v.code ORDER BY rank) AS predictions FROM k JOIN v ON v.id = dst GROUP BY src")
def self_predictions(spark, sf_dir):
    known = kn.with_codes(edges(spark, sf_dir), vectors(spark, sf_dir).select("cell_id", "code"))
    near = F.sort_array(F.collect_list(F.struct("rank", "other")))
    return known.groupBy(F.col("src").alias("cell_id")).agg(F.transform(near, lambda x: x["other"]).alias("predictions"))


@query(KNN_SQL + "SELECT round(count(*) / sum(ln(greatest(r2 / r1, 1 + 1e-12))), 5) AS dimension FROM (SELECT src, min(dist) AS r1, max(dist) AS r2 FROM k WHERE rank <= 2 GROUP BY src)")
def twonn_dimension(spark, sf_dir):
    """The dimension at all rows, the first entry of the profile."""
    found = gr.twonn_profile(vectors(spark, sf_dir).select("cell_id", "features"), levels=1)
    return rounded(spark.createDataFrame([(found[0]["dimension"],)], "dimension double"), "dimension", digits=5)


@query(BRIDGE_SQL + """, n AS (SELECT code AS cluster, count(*) AS n_cells FROM v WHERE id % 2 = 1 GROUP BY 1),
cm AS (SELECT s.code AS cluster, t.code AS match, sum(w) AS m FROM m JOIN v s ON s.id = src JOIN v t ON t.id = tgt GROUP BY ALL), ci AS (SELECT cluster, sum(m) AS image FROM cm GROUP BY 1),
cb AS (SELECT cluster, match, m, row_number() OVER (PARTITION BY cluster ORDER BY round(m, 9) DESC, match) AS r FROM cm),
ok AS (SELECT a.id AS tgt, b.id AS src, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS r FROM v a JOIN v b ON a.id % 2 = 1 AND b.id % 2 = 1 AND a.id <> b.id),
om AS (SELECT s.code AS cluster, t.code AS match, 0.1 * count(*) AS m FROM ok JOIN v s ON s.id = src JOIN v t ON t.id = tgt WHERE r <= 10 GROUP BY ALL), oi AS (SELECT cluster, sum(m) AS image, coalesce(sum(m) FILTER (match = cluster), 0) AS own FROM om GROUP BY 1),
z AS (SELECT n.cluster, n_cells, coalesce(ci.image, 0) AS image, cb.match, CASE WHEN coalesce(ci.image, 0) >= greatest(3, 0.1 * n_cells) THEN cb.m / ci.image END AS p, CASE WHEN coalesce(oi.image, 0) >= greatest(3, 0.1 * n_cells) THEN own / oi.image END AS c
FROM n LEFT JOIN ci USING (cluster) LEFT JOIN cb ON cb.cluster = n.cluster AND cb.r = 1 LEFT JOIN oi ON oi.cluster = n.cluster)
SELECT cluster, n_cells, round(image, 6) AS image_mass, match AS best_match, round(p, 6) AS purity, round(c, 6) AS ceiling_purity,
CASE WHEN n_cells < 20 THEN 'small' WHEN c IS NULL OR c < 0.05 THEN 'unverifiable' WHEN p IS NULL THEN 'absent' WHEN p / c >= 0.85 THEN 'reproduces' WHEN p / c < 0.7 THEN 'refuted' ELSE 'weak' END AS verdict FROM z""")
def cluster_verdicts(spark, sf_dir):
    """Verdicts of the odd rows' labels in the even ones, with a low floor for the ceiling, so that labels without structure get one too."""
    a, b, votes = bridge(spark, sf_dir)
    own = kn.knn(b, b, 10).select(F.col("src").alias("tgt"), F.col("dst").alias("src"), F.lit(0.1).alias("w"))
    sizes = b.groupBy(F.col("code").alias("cluster")).agg(F.count(F.lit(1)).alias("n_cells"))

    def mass(edges_: DataFrame, target: DataFrame) -> DataFrame:
        out = tr.carried_mass(edges_, b.select("cell_id", "code"), target.select("cell_id", "code"))
        return out.withColumn("m", F.round("m", 9))

    rule = br.VerdictRule(ceiling_floor=0.05)
    found = rule.classify(br.cross_purity(mass(votes, a), sizes), br.own_purity(mass(own, b), sizes))
    return rounded(found.drop("efficiency"), "image_mass", "purity", "ceiling_purity")


# profiles


@query("""WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT l_returnflag AS code, (CASE WHEN l_quantity = hi THEN 10 ELSE floor(10 * (l_quantity - lo) / (hi - lo)) + 1 END - 1)::BIGINT AS bin, count(*) AS n FROM lineitem, b GROUP BY ALL""")
def column_histogram(spark, sf_dir):
    return dg.column_histogram(read_table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", 10).withColumnRenamed("l_returnflag", "code")


@query("""SELECT 'l_discount' AS feature, min(l_discount) AS lo, max(l_discount) AS hi, count(DISTINCT l_discount) AS n_distinct FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity), count(DISTINCT l_quantity) FROM lineitem""")
def numeric_profile(spark, sf_dir):
    return dg.numeric_profile(read_table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(1.0)), ["l_discount", "l_quantity", "constant"])


@query("SELECT p_partkey AS cell_id, p_size::DOUBLE AS feature, p_retailprice AS against, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 4 ELSE -1 END AS code FROM part WHERE p_partkey % 5 > 0")
def feature_scatter(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell_id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    return dg.feature_scatter(rows, rows.filter("cell_id % 2 = 0").select("cell_id", (F.col("cell_id") % 4).alias("code")), "p_size", "p_retailprice")


@query("""WITH x AS (SELECT p_partkey % 4 AS code, unnest(['p_size', 'p_retailprice']) AS feature, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part), a AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM x GROUP BY 1),
g AS (SELECT feature, code, count(*) AS n, avg(v) AS m, var_pop(v) AS q FROM x GROUP BY ALL),
f AS (SELECT g.feature, (sum(g.n * pow(g.m - a.m, 2)) / 3) / (sum(g.n * g.q) / (any_value(a.n) - 4)) AS f FROM g JOIN a USING (feature) GROUP BY 1), r AS (SELECT feature, row_number() OVER (ORDER BY f DESC, feature) AS place FROM f)
SELECT feature, place::INT AS place, code, round((g.m - a.m) / a.s, 5) + 0.0 AS mean_z FROM g JOIN a USING (feature) JOIN r USING (feature)""")
def cluster_heatmap(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").withColumn("code", F.col("p_partkey") % 4)
    return rounded(dg.cluster_heatmap(rows, ["p_size", "p_retailprice"]), "mean_z", digits=5)


@query(CUSTOMER_SQL + "SELECT count(*) AS n_uncovered FROM customer WHERE c_acctbal > 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def uncovered_cells(spark, sf_dir):
    """Customers of a mask that a table of orders does not cover."""
    frame = CellFrame(read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], id_col="c_custkey", check=False).add_mask("rich", F.col("c_acctbal") > 5000)
    return spark.createDataFrame([(frame.uncovered(read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "rich"),)], "n_uncovered long")
