"""Change events: where they come from and how a log of them is read.

A change event is a row with the columns

``topic, partition, offset, ts``  place and arrival time in the log
``key``                           struct with the key columns
``op``                            r (initial read), c, u, d; null for a tombstone
``before``, ``after``             row images as structs; ``after`` is null for d
``source``                        struct(db, schema, table, lsn, seq, ts, snapshot)
``headers``                       map<string,string>
``schema_version``                version of the writer's schema

The version that orders the events of one key is ``(lsn, seq, partition, offset)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rowtide.functions.names import matches_whole, topic_class
from rowtide.operators import digests
from rowtide.sources.profiles import Profile
from rowtide.sources.tables import stored

#: Parts of a topic's partition that meet the ranges of a replay in tasks of their own.
SLICES = 64


def source_struct(topic: str, lsn, ts: Column, snapshot: bool, seq=0) -> Column:
    parts = topic.split(".")
    db = parts[1] if len(parts) == 4 else None
    schema, table = parts[-2], parts[-1]
    lsn = lsn if isinstance(lsn, Column) else F.lit(lsn)
    return F.struct(
        F.lit(db).cast("string").alias("db"),
        F.lit(schema).alias("schema"),
        F.lit(table).alias("table"),
        lsn.cast("bigint").alias("lsn"),
        F.lit(seq).cast("bigint").alias("seq"),
        ts.alias("ts"),
        F.lit(snapshot).alias("snapshot"),
    )


def no_headers() -> Column:
    return F.lit(None).cast("map<string,string>")


def version() -> Column:
    return F.struct(
        F.col("source.lsn").alias("lsn"),
        F.col("source.seq").alias("seq"),
        F.col("partition").alias("partition"),
        F.col("offset").alias("offset"),
    )


def event_columns(
    topic: str, key: list[str], op: Column, before: Column, after: Column, lsn, ts: Column, snapshot: bool,
    schema_version: int,
) -> list[Column]:
    return [
        F.lit(topic).alias("topic"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
        ts.alias("ts"),
        F.struct(*[F.col(k).alias(k) for k in key]).alias("key"),
        op.alias("op"),
        before.alias("before"),
        after.alias("after"),
        source_struct(topic, lsn, ts, snapshot).alias("source"),
        no_headers().alias("headers"),
        F.lit(schema_version).alias("schema_version"),
    ]


def snapshot_events(
    df: DataFrame, topic: str, key: list[str], lsn: int, ts: Column | None = None, schema_version: int = 1
) -> DataFrame:
    """One ``r`` event per row of a table, at the position the snapshot was taken."""
    ts = F.lit(None).cast("timestamp_ntz") if ts is None else ts
    row = F.struct(*[F.col(c) for c in df.columns])
    empty = F.lit(None).cast(df.schema)
    return df.select(*event_columns(topic, key, F.lit("r"), empty, row, lsn, ts, True, schema_version))


def diff_capture(
    old: DataFrame, new: DataFrame, topic: str, key: list[str], lsn: int, ts: Column | None = None,
    schema_version: int = 1, leaf_bits: int | None = None,
) -> DataFrame:
    """Changes that turn one version of a table into the next.

    One full outer join on the key, which is unique on both sides, and a null-safe
    comparison of the two row images; unchanged rows give no event. The images have the columns
    of both versions; one that a version does not have is null there. With ``leaf_bits`` the
    versions are first compared by a tree of digests and only rows of leaves that differ are joined.
    """
    ts = F.lit(None).cast("timestamp_ntz") if ts is None else ts
    old, new = digests.aligned(old, new)
    cols = old.columns
    if leaf_bits is not None:
        old, new = digests.unequal_rows(old, new, key, leaf_bits)
    a = old.select(*key, F.struct(*cols).alias("before"))
    b = new.select(*key, F.struct(*cols).alias("after"))
    both = a.join(b, on=key, how="full")
    op = F.when(F.col("before").isNull(), "c").when(F.col("after").isNull(), "d").otherwise("u")
    changed = both.filter(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(
        *event_columns(topic, key, op, F.col("before"), F.col("after"), lsn, ts, False, schema_version)
    )


def bootstrap(
    snapshot: DataFrame, changes: DataFrame, mode: str, snapshot_lsn: int = 0, has_offsets: bool = False
) -> DataFrame:
    """Hand over from the snapshot to the log.

    ``initial`` gives the snapshot and every change after it; with stored offsets, or in
    mode ``no_data``, the snapshot is left out.
    """
    if mode not in ("initial", "no_data"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "no_data" or has_offsets:
        return changes
    return snapshot.unionByName(changes.filter(F.col("source.lsn") > snapshot_lsn))


def select_tables(events: DataFrame, include=(), exclude=(), schemas=()) -> DataFrame:
    """Keep the listed tables (``schema.table``). An include list wins over an exclude list;
    without lists every captured table of the listed schemas (or of all) is kept."""
    name = F.concat_ws(".", F.col("source.schema"), F.col("source.table"))
    cond = F.lit(True)
    if schemas:
        cond = cond & F.col("source.schema").isin(list(schemas))
    if include:
        cond = cond & name.isin(list(include))
    elif exclude:
        cond = cond & ~name.isin(list(exclude))
    return events.filter(cond)


def subscribe(events: DataFrame, pattern: str) -> DataFrame:
    """Events of all topics whose whole name matches."""
    return events.filter(matches_whole(F.col("topic"), pattern))


def replay(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Re-read a log between offsets; ``ranges`` has (topic, partition, start, end), end exclusive.

    A null ``start`` means from the earliest record, a null ``end`` up to the latest. The ranges are stored
    first, so that Spark knows their size and broadcasts them if they are few, never the log for want of it;
    if they are many, a partition of the log meets them in ``SLICES`` tasks.
    """
    r = stored(ranges.select("topic", "partition", F.col("start").alias("_start"), F.col("end").alias("_end")), "ranges")
    r = r.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    inside = (F.col("_start").isNull() | (F.col("offset") >= F.col("_start"))) & (
        F.col("_end").isNull() | (F.col("offset") < F.col("_end"))
    )
    rows = log.withColumn("_slice", F.pmod(F.xxhash64("offset"), F.lit(SLICES)).cast("int"))
    out = rows.join(r, ["topic", "partition", "_slice"]).filter(inside)
    return out.select(*log.columns)


def _edge(log: DataFrame, n: int, newest: bool) -> DataFrame:
    order = [F.col("offset"), F.col("partition")]
    w = Window.partitionBy("topic").orderBy(*[c.desc() if newest else c.asc() for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def tail_topic(log: DataFrame, n: int) -> DataFrame:
    """The last n records of each topic; every task keeps n per topic before the shuffle."""
    return _edge(log, n, newest=True)


def head_topic(log: DataFrame, n: int) -> DataFrame:
    return _edge(log, n, newest=False)


def topic_catalog(log: DataFrame) -> DataFrame:
    """Topics and partitions with their end offset, record count and class."""
    return (
        log.groupBy("topic", "partition")
        .agg((F.max("offset") + 1).alias("end_offset"), F.count("*").alias("records"))
        .withColumn("class", topic_class(F.col("topic")))
    )


def decode(events: DataFrame, registry: dict[int, StructType], value: str = "value") -> DataFrame:
    """Parse JSON values, each with the schema version it was written with.

    Adds ``after`` (all columns of all versions; a column the writer did not know is null,
    see ``schema_version``) and ``decode_ok``. Values that do not parse, or that name a version
    the registry lacks, stay in the result with ``decode_ok = false`` for the dead-letter split.
    """
    corrupt = "_corrupt_record"
    parsed = {}
    for v, schema in registry.items():
        with_corrupt = StructType(schema.fields + [StructField(corrupt, StringType())])
        whole = F.from_json(F.col(value), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
        parsed[v] = F.when(F.col("schema_version") == v, whole)
    out = events.withColumns({f"_v{v}": c for v, c in parsed.items()})
    names = list(dict.fromkeys(f for s in registry.values() for f in s.names))
    fields = [
        F.coalesce(*[F.col(f"_v{v}").getField(n) for v, s in registry.items() if n in s.names]).alias(n)
        for n in names
    ]
    known = F.col("schema_version").isin(list(registry))
    broken = F.coalesce(*[F.col(f"_v{v}").getField(corrupt) for v in registry]).isNotNull()
    ok = known & F.col(value).isNotNull() & ~broken
    return out.withColumns(
        {"after": F.when(ok, F.struct(*fields)), "decode_ok": ok}
    ).drop(*[f"_v{v}" for v in registry])


def read_changes(
    spark: SparkSession, path: str, schema: StructType, profile: Profile | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Follow a log that arrives as files."""
    options = (profile or Profile.streaming()).file_options()
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def read_topics(spark: SparkSession, servers: str, pattern: str, profile: Profile | None = None) -> DataFrame:
    """Follow the topics of a Kafka cluster (needs the Kafka source on the class path).

    New topics that match are picked up when the client refreshes its metadata (30 s).
    """
    options = (profile or Profile.streaming()).kafka_options()
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", pattern)
        .option("kafka.metadata.max.age.ms", "30000")
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
        .options(**options)
        .load()
    )


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int,
              profile: Profile | None = None, **options) -> DataFrame:
    """Read a database table in parallel ranges of a numeric column (needs the JDBC driver)."""
    opts = (profile or Profile.snapshot()).jdbc_read_options(column, low, high, partitions)
    return spark.read.format("jdbc").options(url=url, dbtable=table, **opts, **options).load()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
