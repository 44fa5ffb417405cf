"""The upsert with its state inside the stream, beside the form that merges into files.

The state of a key is its newest row and the row's version. It can begin with a snapshot, so a table
that was loaded earlier is continued without reading it again, and it can expire. Keys are spread over
buckets by hash; a call sees the changes of one bucket in one batch, chunk by chunk, keeps one row of each
key and rewrites the bucket if any of them changed, so its cost is that of a bucket, not of each key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rowtide.operators.apply import BOOKKEEPING, change_rows
from rowtide.sources.tables import key_bucket

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A version as four whole numbers, an absent one before all others.
_ORDER = ["v0", "v1", "v2", "v3"]
_ROWS = pa.schema([("key", pa.string()), *[(v, pa.int64()) for v in _ORDER], ("image", pa.string()), ("at", pa.int64())])
#: Buckets of keys. A state of many more than a few thousand rows for each wants a higher number.
BUCKETS = 4096
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextmanager
def keyed_state(spark: SparkSession):
    """A state store that operators of this module can use, for streams started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _best(rows: pd.DataFrame) -> pd.DataFrame:
    """The row of the highest version of each key, the last of equal ones."""
    order = np.lexsort([rows[c].to_numpy() for c in reversed(_ORDER)])
    return rows.iloc[order].drop_duplicates("key", keep="last")


class _Newest(StatefulProcessor):
    """Keeps the row of the highest version of each key of a bucket and gives it out when it changes.
    The state is the bucket's rows in Arrow's format, each with the time it was stored if they expire."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a bucket that nothing has changed for so long holds expired rows only
        self.newest = handle.getValueState("newest", "rows binary", self.ttl_ms)

    def _merge(self, frames: Iterator[pd.DataFrame], timers) -> pd.DataFrame:
        """Stores what ``frames`` change and returns it."""
        found = None
        for rows in frames:
            if len(rows):
                found = _best(rows if found is None else pd.concat([found, rows]))
        if found is None:
            return pd.DataFrame({"image": pd.Series([], dtype=object)})
        now = 0 if self.ttl_ms is None else timers.getCurrentProcessingTimeInMs()
        found = found[["key", *_ORDER, "image"]].assign(at=now, old=False)
        if self.newest.exists():
            held = pa.ipc.open_stream(bytes(self.newest.get()[0])).read_pandas()
            if self.ttl_ms is not None:
                held = held[held["at"] > now - self.ttl_ms]
            found = _best(pd.concat([found, held.assign(old=True)]))  # of equal versions the held one stays
        told = found[~found["old"].to_numpy(bool)]
        if len(told):
            table = pa.Table.from_pandas(found.drop(columns="old"), _ROWS, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ROWS) as out:
                out.write_table(table)
            self.newest.update((sink.getvalue().to_pybytes(),))
        return told[["image"]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._merge(iter([initialState]), timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._merge(rows, timerValues)

    def close(self) -> None:
        pass


def _flat(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    least = F.lit(-(2**63)).cast("bigint")
    places = ["lsn", "seq", "partition", "offset"]
    order = [F.coalesce(F.col(f"_version.{p}").cast("bigint"), least).alias(v) for p, v in zip(places, _ORDER)]
    name, image = (F.to_json(F.struct(*cols), _JSON) for cols in (key, rows.columns))
    return rows.select(key_bucket(key, buckets).alias("bucket"), name.alias("key"), *order, image.alias("image"))


def stream_upsert_state(events: DataFrame, key: list[str], deletes: str = "drop", snapshot: DataFrame | None = None,
                        ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Changed state rows of a stream of change events, as ``upsert`` would hold them.

    ``snapshot`` is a state (``as_state`` makes one of a table) that keys begin with. A row is given out
    whenever a higher version of its key arrives; late and repeated events change nothing. With
    ``ttl_ms`` a key that has not changed for so long is forgotten, so that an older event may come back
    afterwards. Null keys are a key like any other. Write it in update mode within ``keyed_state``, to
    ``update_sink``; ``latest_epoch`` then reads the whole state, to which the snapshot's unchanged rows
    belong as well. Keys are held in ``buckets``; a batch rewrites those it changes, and a checkpoint is
    continued with the number it began with.
    """
    rows = change_rows(events, key, deletes)
    image: StructType = rows.schema
    begin = None
    if snapshot is not None:
        begin = _flat(snapshot.select(*rows.columns), key, buckets).groupBy("bucket")
    out = _flat(rows, key, buckets).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Newest(ttl_ms), outputStructType="image string", outputMode="Update",
        timeMode="None" if ttl_ms is None else "ProcessingTime", initialState=begin)
    told = out.select(F.from_json("image", image, _JSON).alias("r"))
    return told.select(*[F.col(f"r.{c}").alias(c) for c in [*key, *[c for c in image.names if c not in key and c not in BOOKKEEPING], *BOOKKEEPING]])
