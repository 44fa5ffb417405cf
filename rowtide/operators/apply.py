"""Applying change events to tables.

A *state* is a table with its data columns and three bookkeeping columns: ``_version`` (the
version that wrote the row), ``_deleted`` (tombstone kept so that a late, older event cannot
bring a deleted row back) and ``_schema_version``. ``live`` gives the plain table.

All of it rests on one aggregate per key. ``max_by`` is computed partially before the shuffle,
so a key with very many changes sends one row per task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rowtide.sources import versions
from rowtide.sources.changes import union_all, version
from rowtide.sources.tables import key_bucket

BOOKKEEPING = ["_version", "_deleted", "_schema_version"]


def dedupe_delivery(events: DataFrame) -> DataFrame:
    """One row per log position. Needed where events are counted; the upsert does not need it.

    Events of a snapshot or a table comparison have no position yet; they are told apart by topic,
    key, source position and operation; without a key column each of them is kept.
    """
    placed = F.col("partition").isNotNull() & F.col("offset").isNotNull()
    known = [c for c in ("key", "source.lsn", "source.seq", "op") if c.split(".")[0] in events.columns]
    own = F.struct(*[F.col(c).alias(c.replace(".", "_")) for c in known]) if "key" in known else F.monotonically_increasing_id()
    marked = events.withColumn("_own", F.when(~placed, own))
    return marked.dropDuplicates(["topic", "partition", "offset", "_own"]).drop("_own")


def change_rows(events: DataFrame, key: list[str], deletes: str = "drop") -> DataFrame:
    """Events as state rows. With ``drop`` the deletes go away *before* the latest-per-key step,
    so the row survives with its last image; with ``apply`` they take part in it."""
    if deletes not in ("drop", "apply"):
        raise ValueError(f"unknown delete handling {deletes!r}")
    real = events.filter(F.col("op").isNotNull())
    if deletes == "drop":
        real = real.filter(F.col("op") != "d")
    values = [c for c in events.schema["after"].dataType.names if c not in key]
    return real.select(
        *[F.col(f"key.{k}").alias(k) for k in key],
        *[F.col(f"after.{c}").alias(c) for c in values],
        version().alias("_version"),
        (F.col("op") == "d").alias("_deleted"),
        F.col("schema_version").alias("_schema_version"),
    )


def latest(rows: DataFrame, key: list[str], added: dict[str, int] | None = None) -> DataFrame:
    """Highest version per key.

    ``added`` maps a column to the schema version that introduced it: such a column takes its
    value from the newest row whose writer knew it, so a row from an old writer does not blank it.
    """
    added = added or {}
    values = [c for c in rows.columns if c not in key and c not in BOOKKEEPING]
    base = [c for c in values if c not in added]
    aggs = [
        F.max_by(F.struct(*[F.col(c) for c in base + ["_deleted"]]), "_version").alias("_row"),
        F.max("_version").alias("_v"),
        F.max("_schema_version").alias("_s"),
    ]
    for since in sorted(set(added.values())):
        cols = [c for c in values if added.get(c) == since]
        if cols:
            known = (F.col("_schema_version") >= since) | F.col("_deleted")
            aggs.append(F.max_by(F.struct(*cols), F.when(known, F.col("_version"))).alias(f"_since{since}"))
    out = rows.groupBy(*key).agg(*aggs)
    pick = {c: F.col(f"_since{added[c]}.{c}") if c in added else F.col(f"_row.{c}") for c in values}
    return out.select(
        *key,
        *[pick[c].alias(c) for c in values],
        F.col("_v").alias("_version"),
        F.col("_row._deleted").alias("_deleted"),
        F.col("_s").alias("_schema_version"),
    )


def upsert(state: DataFrame | None, events: DataFrame, key: list[str], deletes: str = "drop",
           added: dict[str, int] | None = None) -> DataFrame:
    """New state after a set of changes, in any order and with any number of redeliveries.

    New columns of the changes are added to the state as nullable columns; a column whose type
    changed is refused (see ``evolve``). One shuffle, on the key.
    """
    rows = change_rows(events, key, deletes)
    if state is not None:
        rows = union_all(list(evolve(state, rows)))
    return latest(rows, key, added)


def evolve(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check that a union by name is safe: columns may be added, types may not change."""
    changed = [
        c for c in rows.columns
        if c in state.columns and state.schema[c].dataType.simpleString() != rows.schema[c].dataType.simpleString()
    ]
    if changed:
        raise TypeError(f"column type changed, not applied: {changed}")
    return state, rows


def live(state: DataFrame) -> DataFrame:
    return state.filter(~F.col("_deleted")).drop(*BOOKKEEPING)


def as_state(table: DataFrame, lsn: int = -1, schema_version: int = 1) -> DataFrame:
    """A plain table as a state whose rows are older than any change."""
    ver = F.struct(
        F.lit(lsn).cast("bigint").alias("lsn"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(None).cast("int").alias("partition"), F.lit(None).cast("bigint").alias("offset"),
    )
    return table.withColumns(
        {"_version": ver, "_deleted": F.lit(False), "_schema_version": F.lit(schema_version)}
    )


def net_changes(events: DataFrame, key: list[str], from_lsn: int, to_lsn: int) -> DataFrame:
    """One final change per key for ``from_lsn <= lsn <= to_lsn``.

    A key created and deleted inside the range has no net change; created and then updated is
    one create; deleted and created again is one update. An initial read counts as a create.
    """
    real = events.filter(
        F.col("op").isNotNull() & F.col("source.lsn").between(from_lsn, to_lsn)
    )
    agg = real.groupBy("key").agg(
        F.min_by("op", version()).alias("_first"),
        F.max_by(F.struct("op", "after", F.col("source.lsn").alias("lsn")), version()).alias("_last"),
    )
    born = F.col("_first").isin("c", "r")
    gone = F.col("_last.op") == "d"
    op = F.when(gone, "d").when(born, "c").otherwise("u")
    return agg.filter(~(born & gone)).select(
        *[F.col(f"key.{k}").alias(k) for k in key],
        op.alias("op"),
        F.col("_last.lsn").alias("lsn"),
        F.col("_last.after").alias("after"),
    )


def latest_documents(log: DataFrame, deletes: str = "drop") -> DataFrame:
    """Latest JSON value per (target table, key) of a log that mixes many tables.

    One job for all tables: the table is part of the key. Decode each table's rows afterwards
    with its own schema (``table_view``).
    """
    real = log.filter(F.col("op").isNotNull())
    if deletes == "drop":
        real = real.filter(F.col("op") != "d")
    ver = F.struct("lsn", "partition", "offset")
    out = real.groupBy("target", "key").agg(F.max_by(F.struct("op", "value"), ver).alias("_row"))
    return out.filter(F.col("_row.op") != "d").select("target", "key", F.col("_row.value").alias("value"))


def _read(schema: StructType) -> Column:
    """The value parsed with a schema; ``_unread`` holds a text that does not fit it."""
    whole = StructType([*schema.fields, StructField("_unread", StringType())])
    return F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})


def split_documents(log: DataFrame, schemas: dict[str, StructType]) -> tuple[DataFrame, DataFrame]:
    """Events whose value can be read with the schema of their target, and the dead letters.

    Done before the latest value is chosen, so that an unreadable update leaves the row as it was.
    Deletes, tombstones and targets without a schema pass.
    """
    ok = F.lit(True)
    for target, schema in schemas.items():
        read = _read(schema)
        ok = F.when(F.col("target") == target, read.isNotNull() & read["_unread"].isNull()).otherwise(ok)
    marked = log.withColumn("_ok", F.col("op").isNull() | (F.col("op") == "d") | ok)
    return marked.filter("_ok").drop("_ok"), marked.filter("NOT _ok").drop("_ok")


def table_view(documents: DataFrame, target: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of one table, and the keys and values that its schema cannot read."""
    rows = documents.filter(F.col("target") == target).withColumn("_row", _read(schema))
    ok = F.col("_row").isNotNull() & F.col("_row._unread").isNull()
    return rows.filter(ok).select("key", "_row.*").drop("_unread"), rows.filter(~ok).select("key", "value")


def write_fanout(documents: DataFrame, path: str, buckets: int) -> None:
    """Write all target tables in one pass, partitioned by table and key bucket.

    The shuffle is by table and bucket, so one big table is written by as many tasks as it has
    buckets.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    (
        documents.withColumn("bucket", bucket)
        .repartition("target", "bucket")
        .write.mode("overwrite")
        .partitionBy("target", "bucket")
        .parquet(path)
    )


def bidirectional(a: DataFrame, b: DataFrame, changes_a: DataFrame, changes_b: DataFrame, key: list[str],
                  deletes: str = "drop") -> tuple[DataFrame, DataFrame]:
    """New states of two sites after each applied its own changes and the other's.

    Both sites reach the same result for a table that flows both ways, because the version
    decides and not the direction. Filter tables first (``select_tables``) for one-way flows.
    """
    both = union_all([changes_a, changes_b])
    return upsert(a, both, key, deletes), upsert(b, both, key, deletes)


def unique_conflicts(rows: DataFrame, key: list[str], unique: list[str]) -> DataFrame:
    """Rows whose unique value is already taken by a row with a smaller key.

    Nulls never conflict. The owner of each value is found with a partial aggregate; only
    values that occur under more than one key are joined back.
    """
    ident = F.struct(*[F.col(k) for k in key])
    filled = rows.dropna(subset=unique)
    owners = filled.groupBy(*unique).agg(F.min(ident).alias("_owner"), F.max(ident).alias("_other"))
    contested = owners.filter(F.col("_owner") != F.col("_other")).drop("_other")
    return filled.join(contested, unique).filter(ident != F.col("_owner")).drop("_owner")


def merge_batch(spark: SparkSession, path: str, events: DataFrame, key: list[str], buckets: int, batch_id: int,
                staging: str, deletes: str = "drop", added: dict[str, int] | None = None,
                bucket_bytes: int = 128 << 20) -> None:
    """Merge one batch into a bucketed state table on plain files (see ``rowtide.sources.versions``).

    The batch is evaluated once, into ``staging``; then only buckets it touches are read, merged and
    written to a new folder, and a new version of the table names that folder for them. Nothing is
    overwritten: a reader sees the table before or after the batch, and a job that is lost in between
    leaves the table as it was. A batch may come again at any time, also after others, since it is
    always merged with the newest version and the row versions decide; of two writers at once the
    second merges again with what the first has left. A bucket is written by one task for every
    ``bucket_bytes`` of its size.
    """
    rows = change_rows(events, key, deletes)
    if not added:
        rows = latest(rows, key)
    arrived = f"{staging}/batch={batch_id}-{uuid.uuid4().hex}"
    # few files for a bucket, unless it is large: adaptive execution merges small partitions and splits large ones
    rows.withColumn("bucket", key_bucket(key, buckets)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(arrived)
    hit = versions.partition_bytes(spark, arrived, "bucket")
    try:
        while hit:
            base = versions.current(spark, path)
            batch, state = spark.read.parquet(arrived).drop("bucket"), versions.read(spark, base, hit)
            merged = latest(batch if state is None else union_all(list(evolve(state, batch))), key, added)
            parts = {b: 1 + (n + versions.folder_bytes(spark, base, b)) // bucket_bytes for b, n in hit.items()}
            bucket = key_bucket(key, buckets)
            split = F.element_at(F.create_map(*[F.lit(x) for bn in parts.items() for x in bn]), bucket)
            spread = merged.withColumn("bucket", bucket).repartition(sum(parts.values()), F.col("bucket"), F.pmod(F.hash(*key), split))
            folder = f"{path}/data-{uuid.uuid4().hex}"
            spread.write.partitionBy("bucket").parquet(folder)
            if versions.publish(spark, path, base, merged.schema, {b: f"{folder}/bucket={b}" for b in hit}):
                break
    finally:
        versions.remove(spark, arrived)


def merge_into(table: str, events: DataFrame, key: list[str], deletes: str = "drop") -> None:
    """The same merge on a catalog table with row-level operations (``MERGE INTO``)."""
    rows = latest(change_rows(events, key, deletes), key).alias("s")
    on: Column = F.lit(True)
    for k in key:
        on = on & (F.col(f"s.{k}") == F.col(f"{table}.{k}"))
    newer = F.col("s._version") > F.col(f"{table}._version")
    rows.mergeInto(table, on).whenMatched(newer).updateAll().whenNotMatched().insertAll().merge()


def write_jdbc(table: DataFrame, url: str, name: str, options: dict[str, str]) -> None:
    """Write a table to a database in batches (needs the JDBC driver)."""
    table.write.format("jdbc").mode("append").options(url=url, dbtable=name, **options).save()
