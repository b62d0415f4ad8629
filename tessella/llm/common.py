"""What the corpus operators share: staged tables, row locators and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: blank and \t \n \v \f \r. bytes.split() splits at just these.
SPACES = " \t\n\v\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is set and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def located(df: DataFrame) -> DataFrame:
    """df with its columns renamed to __c0, __c1, ... and the place of each row as `__file` and `__row`.

    No name of df can clash with these. Rows that come from no file are staged first.
    """
    own = df.select(*[quoted(c).alias(f"__c{k}") for k, c in enumerate(df.columns)])
    try:
        place = df.metadataColumn("_metadata")
        columns = [quoted(c).alias(f"__c{k}") for k, c in enumerate(df.columns)]
        return df.select(*columns, place["file_path"].alias("__file"), place["row_index"].alias("__row"))
    except AnalysisException:
        own = staged(own, "rows")
    return own.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def inner(df: DataFrame, name: str) -> Column:
    """The column of located(df) that was called name in df."""
    return F.col(f"__c{df.columns.index(name)}")


def restored(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of located(df) with the columns of df."""
    return rows.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(df.columns)])


def quoted(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what a text operator reads, so that no extra column can clash with its own names."""
    return df.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of few rows, so that a batch of very long texts stays small as Python objects."""
    for batch in batches:
        step = rows
        if batch.num_rows and batch.nbytes / batch.num_rows * step > chars:
            step = max(1, int(chars / (batch.nbytes / batch.num_rows)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def runs(texts: list[str], rows: int = 256, chars: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """Runs of few texts of bounded length in all (a longer text is a run of its own), each with its first place."""
    at, total = 0, 0
    for k, text in enumerate(texts):
        if k > at and (k - at == rows or total + len(text) > chars):
            yield at, texts[at:k]
            at, total = k, 0
        total += len(text)
    if at < len(texts):
        yield at, texts[at:]


def map_texts(df: DataFrame, function: Callable[[list, list[str]], dict[str, list]], schema: str) -> DataFrame:
    """Apply function(ids, texts) -> columns to small batches of (doc_id, text); null texts come as empty ones."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out = function(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
