"""Single-record transforms; none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from rowtide.functions.names import matches_whole, routed_name, topic_parts

ORIGIN_HEADER = "__origin"


def unwrap(events: DataFrame, deletes: str = "drop", drop_tombstones: bool = True) -> DataFrame:
    """Replace each event by its new-row image.

    ``deletes='drop'`` removes delete events, so a target row survives a source delete;
    ``'keep'`` passes them on with null value columns and ``op = 'd'``.
    """
    if deletes not in ("drop", "keep"):
        raise ValueError(f"unknown delete handling {deletes!r}")
    kept = events
    if drop_tombstones:
        kept = kept.filter(F.col("op").isNotNull())
    if deletes == "drop":
        kept = kept.filter(~F.col("op").eqNullSafe("d"))
    return kept.select("topic", "key", "op", F.col("source.lsn").alias("lsn"), "after.*")


def route(events: DataFrame, pattern: str, replacement: str = "$1", to: str = "target") -> DataFrame:
    """Add the target name a topic is routed to."""
    return events.withColumn(to, routed_name(F.col("topic"), pattern, replacement))


def parse_topic(events: DataFrame, topic: str = "topic") -> DataFrame:
    return events.withColumn("name", topic_parts(F.col(topic)))


def parse_key_spec(spec: str) -> dict[str, list[str]]:
    """``db.schema.table:c1,c2;other:c3`` -> columns per table."""
    out = {}
    for entry in filter(None, (e.strip() for e in spec.split(";"))):
        table, sep, cols = entry.partition(":")
        names = [c.strip() for c in cols.split(",") if c.strip()]
        if not sep or not table.strip() or not names:
            raise ValueError(f"bad key entry {entry!r}, expected table:col1,col2")
        out[table.strip()] = names
    return out


def assign_key(events: DataFrame, spec: str, image: str = "after") -> DataFrame:
    """Build the key from value columns, for the tables the spec names.

    ``key_json`` is a JSON object of the listed columns; tables without an entry keep the key
    they came with. Events without the image get no key.
    """
    name3 = F.concat_ws(".", F.col("source.db"), F.col("source.schema"), F.col("source.table"))
    name2 = F.concat_ws(".", F.col("source.schema"), F.col("source.table"))
    key = F.to_json(F.col("key"), {"ignoreNullFields": "false"})
    for table, cols in parse_key_spec(spec).items():
        built = F.to_json(
            F.struct(*[F.col(f"{image}.{c}").alias(c) for c in cols]), {"ignoreNullFields": "false"}
        )
        here = (name3 == table) | (name2 == table)
        key = F.when(here & F.col(image).isNotNull(), built).when(here, F.lit(None)).otherwise(key)
    return events.withColumn("key_json", key)


def _neutral(dtype: DataType) -> Column:
    if isinstance(dtype, BooleanType):
        return F.lit(False)
    if isinstance(dtype, NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, DateType):
        return F.lit("1970-01-01").cast(dtype)
    if isinstance(dtype, TimestampType | TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    if isinstance(dtype, BinaryType):
        return F.lit("").cast(dtype)
    raise TypeError(f"no neutral value of type {dtype.simpleString()}")


def mask_fields(df: DataFrame, fields: list[str], replacement: str = "") -> DataFrame:
    """Overwrite fields: strings with the replacement, other types with their zero value.

    Null stays null, so masking does not reveal or hide which values are set. Binary fields become
    empty; fields of arrays, maps and structs are refused.
    """
    missing = set(fields) - set(df.columns)
    if missing:
        raise ValueError(f"no such fields: {sorted(missing)}")
    masked = {}
    for f in fields:
        dtype = df.schema[f].dataType
        new = F.lit(replacement) if isinstance(dtype, StringType) else _neutral(dtype)
        masked[f] = F.when(F.col(f).isNotNull(), new)
    return df.withColumns(masked)


def cast_fields(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast fields; ``cast_error`` holds the first field whose value does not fit, else null."""
    err = F.coalesce(
        *[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()]
    )
    casts = {c: F.col(c).try_cast(t) for c, t in types.items()}
    return df.withColumn("cast_error", err).withColumns(casts)


def replace_fields(df: DataFrame, drop=(), rename: dict[str, str] | None = None) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(rename or {})


def tag_origin(events: DataFrame, origin: str) -> DataFrame:
    """Add the origin header; an event that has one keeps it."""
    empty = F.create_map().cast("map<string,string>")
    have = F.coalesce(F.col("headers"), empty)
    tagged = F.when(F.map_contains_key(have, ORIGIN_HEADER), have).otherwise(
        F.map_concat(have, F.create_map(F.lit(ORIGIN_HEADER), F.lit(origin)))
    )
    return events.withColumn("headers", tagged)


def drop_origin(events: DataFrame, origin: str) -> DataFrame:
    """Remove events that came from ``origin``; events without the header stay."""
    have = F.try_element_at(F.col("headers"), F.lit(ORIGIN_HEADER))
    return events.filter(~have.eqNullSafe(origin))


def header_keys(events: DataFrame) -> DataFrame:
    return events.withColumn("header_keys", F.array_sort(F.map_keys(F.col("headers"))))


def outcome(drop_pattern: str | None = None) -> Column:
    """How the connector treats an event: erroneous, skipped, filtered or passed."""
    no_key = F.col("key").isNull()
    no_image = F.col("op").isin("c", "u", "r") & F.col("after").isNull()
    skipped = F.col("op").isNull()
    filtered = matches_whole(F.col("topic"), drop_pattern) if drop_pattern else F.lit(False)
    return (
        F.when(no_key | no_image, "erroneous").when(skipped, "skipped").when(filtered, "filtered").otherwise("passed")
    )


def event_outcomes(events: DataFrame, drop_pattern: str | None = None) -> DataFrame:
    """Number of events per topic, operation and outcome."""
    return (
        events.select("topic", F.coalesce("op", F.lit("tombstone")).alias("op"), outcome(drop_pattern).alias("outcome"))
        .groupBy("topic", "op", "outcome")
        .agg(F.count("*").alias("events"))
    )


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill columns the record does not have. A column that is there keeps its nulls."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in have})


def default_for_version(col: Column, writer_version: Column, since: int, default: object) -> Column:
    """Default for records written before the column existed; explicit nulls stay."""
    return F.when(writer_version < since, F.lit(default)).otherwise(col)


def length_error(limits: dict[str, int], max_bytes: int | None = None, payload: str | None = None) -> Column:
    """First column that is longer than its limit, or ``message`` for an oversized payload."""
    checks = [F.when(F.length(c) > n, F.lit(c)) for c, n in limits.items()]
    if max_bytes is not None:
        checks.insert(0, F.when(F.octet_length(F.col(payload)) > max_bytes, F.lit("message")))
    return F.coalesce(*checks)


def check_lengths(df: DataFrame, limits: dict[str, int], max_bytes: int | None = None,
                  payload: str | None = None) -> DataFrame:
    return df.withColumn("length_error", length_error(limits, max_bytes, payload))


def scan_log(lines: DataFrame, pattern: str, n: int, order: list[str], text: str = "line") -> DataFrame:
    """The last n lines that contain a match, upper and lower case alike."""
    hits = lines.filter(F.col(text).rlike(f"(?i){pattern}"))
    return hits.orderBy(*[F.col(c).desc() for c in order]).limit(n)
