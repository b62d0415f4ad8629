"""Exact deduplication by a stateful stream.

Every row is digested once into a narrow index (digest, length, id, place of the row). A Structured Streaming
query reads that index and keeps, in a RocksDB state store without expiry, one entry a digest: the row that stays
(its stable id and the place of its content) and the number of rows seen. The state is then read as a table. On a
hit the full bytes are compared: the normalised text of each further row is joined with that of the row that stays,
and rows that differ in spite of an equal digest are regrouped by their text itself.

Only DataFrame operations run; there is no Python on the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, delete_path, documents, drop_staged, inner, located, restored, shared_dir, staged

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rank() -> Column:
    """Least for the row that stays: most code points, then smallest id (null last), then first place."""
    return F.struct(
        (-F.col("n_chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("__file"), F.col("__row")
    )


def digest_state(index: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    """Run the index through the stateful stream; return (digest, best, n) read from its state store.

    files_per_trigger bounds what one micro-batch takes in; the state, on disk and in the checkpoint, carries over
    from batch to batch, and a rerun after a failure goes on from the last committed batch.
    """
    spark = index.sparkSession
    path = index.inputFiles()
    if not path:
        return spark.createDataFrame([], "digest binary, best struct<neg_chars:int,no_id:boolean,doc_id:bigint,__file:string,__row:bigint>, n bigint")
    own = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }.items():
        own.conf.set(key, value)
    checkpoint = f"{shared_dir(spark)}/dedup-state-{uuid.uuid4().hex}"
    stream = (
        own.readStream.schema(index.schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path[0].rsplit("/", 1)[0])
        .groupBy("digest")
        .agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    query = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    state = own.read.format("statestore").load(checkpoint)
    best, n = (F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields)
    kept = staged(state.select(F.col("key.digest").alias("digest"), best.alias("best"), n.alias("n")), "digests")
    delete_path(spark, checkpoint)
    return spark.read.schema(kept.schema).parquet(kept.inputFiles()[0].rsplit("/", 1)[0])


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    digest: Callable[[Column], Column] = sha256,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """One row a row of df: doc_id, keep_id, group_size, kept, text_sha256 and the row's place (`__file`, `__row`).

    Texts are equal when they are identical without white space. Of equal texts the row with the most code points
    stays, then the one with the smallest id; a null text is the empty text, a null id comes last, and of rows
    repeated with one id the first in the input's files stays. An empty table gives no rows. Very long texts are read whole.
    digest may be replaced (tests use a poor one): the bytes decide, the digest only finds candidates.
    """
    rows = located(df)
    text = inner(df, text_col).cast("string")
    norm = normalised(text)
    keyed = rows.select(
        digest(norm).alias("digest"), inner(df, id_col).alias("doc_id"), "__file", "__row", norm.alias("norm"), text.alias("text")
    )
    index = staged(
        keyed.select("digest", F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), "doc_id", "__file", "__row"), "index"
    )
    state = digest_state(index, files_per_trigger)
    best = state.select(
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.__file").alias("best_file"),
        F.col("best.__row").alias("best_row"),
        F.col("n").alias("group_size"),
    )
    here = (F.col("__file") == F.col("best_file")) & (F.col("__row") == F.col("best_row"))

    hits = staged(
        keyed.drop("text").join(best.filter("group_size > 1").drop("keep_id", "group_size"), "digest").select("digest", "doc_id", "__file", "__row", "norm", here.alias("first")),
        "hits",
    )
    firsts = hits.filter("first").select("digest", F.col("norm").alias("first_norm"))
    differ = staged(
        hits.filter(~F.col("first")).join(firsts, "digest").filter(F.col("norm") != F.col("first_norm")).select("digest", "__file", "__row"), "differ"
    )
    out = index.join(best, "digest").select("digest", "doc_id", "__file", "__row", "keep_id", "group_size", here.alias("kept"))
    if not differ.isEmpty():
        out = _regrouped(out, index, hits, differ)
    elif digest is sha256:
        drop_staged(hits, differ)
    if digest is not sha256:  # what is returned is the SHA-256, whatever found the candidates
        digests = keyed.select("__file", "__row", sha256(F.col("norm")).alias("sha"))
        out = out.join(digests, ["__file", "__row"]).withColumn("digest", F.col("sha"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "__file", "__row")


def _regrouped(out: DataFrame, index: DataFrame, hits: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows whose bytes differ from those of their digest's first row are grouped by the text itself."""
    place = ["__file", "__row"]
    apart = (
        hits.join(differ.drop("digest"), place, "left_semi")
        .join(index.select("n_chars", *place), place)
        .select("digest", "norm", "n_chars", "doc_id", *place)
    )
    apart = staged(apart, "apart")
    groups = apart.groupBy("digest", "norm").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))
    moved = apart.join(groups, ["digest", "norm"]).select(
        *place,
        F.col("best.doc_id").alias("new_keep"),
        F.col("n").alias("new_size"),
        ((F.col("best.__file") == F.col("__file")) & (F.col("best.__row") == F.col("__row"))).alias("new_kept"),
    )
    fewer = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    out = out.join(moved, place, "left").join(fewer, "digest", "left")
    was_moved = F.col("new_size").isNotNull()
    return out.select(
        "digest",
        "doc_id",
        *place,
        F.when(was_moved, F.col("new_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(was_moved, F.col("new_size")).otherwise(F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        F.coalesce("new_kept", "kept").alias("kept"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_dedup drops, all columns as they were."""
    rows = located(df)
    gone = exact_dedup(df, id_col, text_col).filter(~F.col("kept")).select("__file", "__row")
    return restored(rows.join(gone, ["__file", "__row"], "left_anti"), df)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("__file", "__row")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -length(text), b := doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
