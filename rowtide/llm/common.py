"""Helpers that several operators of this package use."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.sources.tables import stored

#: Words are what lies between ASCII blanks; ``bytes.split()`` cuts at the same six characters.
WORDS = "[^\\x20\\x09-\\x0D]+"

#: Letters and numbers up to U+017F as pattern ranges, and what a text must not have to be read with them:
#: anything beyond, or U+0130, whose lower case has two characters.
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")

#: Ids that are null sort after every other id.
LAST_ID = 2**63 - 1


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it from there; then let Spark
    remove the shuffle files of the work that made it."""
    out = stored(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``keep`` made, when nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; null results are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def order_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def same(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that others cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def whole(docs: DataFrame) -> DataFrame:
    """Rows as one column ``row``, with ``doc_id`` and ``text`` beside it under their own types, so that
    no column of the caller's can clash with an operator's; ``row.*`` gives them back."""
    fields = [F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns]
    return docs.select(F.struct(*fields).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and hash of doc_id and text are not among ``gone(doc_id, rid)``."""
    told = whole(docs).select("row", "doc_id", F.xxhash64("doc_id", "text").alias("rid"))
    return told.join(gone.distinct(), ["doc_id", "rid"], "left_anti").select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
