"""Small helpers the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a reader unpacks at once; at Spark's 4,096 the texts or sets of one batch are many MB in one piece of heap.
READ = 512
#: Bytes of a row group, which a writing task holds on the heap, of what written() writes.
ROW_GROUP = 16 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z only, so that both engines agree on every other letter."""
    return F.translate(column, UPPER, UPPER.lower())


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts go to Python in batches of at most so many rows, so that a worker's memory stays small beside the heap; readers unpack ``READ`` at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ:
        spark.conf.set(name, READ)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; on a local master that names none, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="seedplane-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # a marker would be two more processes (chmod) that the driver starts on a local file system; nothing looks for it
    df.write.option("parquet.block.size", ROW_GROUP).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seedplane_path = path
    return out


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like written(), in buckets by a column: what is grouped or joined by it later leaves these rows where they lie."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._seedplane_path, out._seedplane_table = path, name
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    path, name = getattr(df, "_seedplane_path", None), getattr(df, "_seedplane_table", None)
    if name:
        df.sparkSession.sql(f"drop table if exists {name}")
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keyed_rows(df: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """Only the named columns, cast to the wanted types; extra columns never clash."""
    types = dict(part.strip().split(" ", 1) for part in schema.split(","))
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in columns])
