"""Reading and writing tables, and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def stream_table(spark: SparkSession, root: str, name: str, **options) -> DataFrame:
    """The same table as a stream; works for one file and for a directory of part files."""
    schema = read_table(spark, root, name).schema
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(f"{root}/{{{name}}}.parquet")


#: Temporary folders of local sessions that name no shared one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    run = spark.sparkContext.applicationId
    if run not in _LOCAL:
        _LOCAL[run] = tempfile.mkdtemp(prefix="rowtide-")
    return _LOCAL[run]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a result that several later steps use, so that it is computed once and survives the
    loss of executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, label: str, within: str | None = None) -> DataFrame:
    """The same rows, written once as a table in the shared folder and read from there.

    ``within`` names a column to sort by inside each file, so that later filters on it skip most
    of every file.
    """
    path = run_dir(df.sparkSession, label)
    rows = df if within is None else df.sortWithinPartitions(within)
    rows.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run, below the shared folder."""
    return f"{shared_dir(spark)}/rowtide/{label}-{uuid.uuid4().hex}"


def key_bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def save_table(df: DataFrame, path: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """Write a table partitioned by ``bucket``, a hash of its key.

    The rows are clustered by bucket and a second hash of the key, so that each bucket
    directory gets a few well-filled files and no bucket is written by one task alone.
    """
    (
        df.withColumn("bucket", key_bucket(keys, buckets))
        .repartition(F.col("bucket"), F.pmod(F.hash(*[F.col(k) for k in keys]), F.lit(4)))
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def load_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """Create an empty catalog table from a record schema if it is not there yet."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)
    return spark.table(name)
