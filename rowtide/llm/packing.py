"""Packing of documents into training sequences along a space-filling curve.

A document's token counts are hashed into a vector, projected to three dimensions and put on a grid;
its cell's place on the Hilbert curve is its key. Documents are range-sorted by key, so neighbours in
the order are alike, and laid end to end; the stream is cut every ``size`` tokens. Nothing but one
running total for each partition of the sort passes through the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.common import bytes_of, keep, map_batches, same, table

SIZE = 2048
#: The id that ends each document.
END = 1
#: Rows that a worker encodes at a time.
ROWS = 1_000
#: Buckets that token counts are hashed to, dimensions they are projected to, bits of a grid axis.
BUCKETS, AXES, GRID = 4096, 3, 10


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokens:
    """The byte-level BPE ids of texts, as unsigned 16-bit little-endian bytes.

    The vocabulary's own string ``<|endoftext|>`` is its id 50256 wherever it occurs. A long run of
    blanks overflows the pattern engine's stack. The pattern makes one piece of such a run, less its
    last blank where something follows, so the piece is cut out and encoded as one.
    """

    SPECIAL = "<|endoftext|>"
    RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

    def __init__(self, path: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.coder = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.SPECIAL: len(ranks)})

    def encode(self, text: str) -> bytes:
        if self.SPECIAL in text:  # no run reaches across one
            close = np.array([self.coder.n_vocab - 1], "<u2").tobytes()
            return close.join(map(self._plain, text.split(self.SPECIAL)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        ids, at = [], 0
        for run in self.RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.coder.encode_ordinary(text[at : run.start()]) + self.coder._encode_single_piece(text[run.start() : end])
            at = end
        return np.array(ids + self.coder.encode_ordinary(text[at:]), "<u2").tobytes()


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


@cache
def _projection() -> np.ndarray:
    """Signs of every bucket on every axis, from the bits of a hash of the bucket."""
    x = np.arange(BUCKETS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.stack([((x >> np.uint64(40 + a)) & np.uint64(1)).astype(np.float64) * 2 - 1 for a in range(AXES)], axis=1)


def place(ids: np.ndarray) -> np.ndarray:
    """Grid cell of a document: its hashed token counts, damped, projected and squeezed."""
    buckets = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.sqrt(np.bincount(buckets, minlength=BUCKETS))
    spot = counts @ _projection() / max(1.0, float(np.sqrt(counts @ counts)))
    return np.minimum((np.tanh(spot / 2) + 1) / 2 * (1 << GRID), (1 << GRID) - 1).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = GRID) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, key, n, ids)`` of each row: Hilbert key, number of ids, ids with the closing one."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _tokens(path)
        close = np.array([END], "<u2").tobytes()
        ids = [coder.encode(t or "") + close for t in batch.column(1).to_pylist()]
        cells = np.array([place(np.frombuffer(i, "<u2")) for i in ids])
        cols = [batch.column(0), pa.array(hilbert(cells)), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n", "ids"])

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield run(batch.slice(start, ROWS))

    rows = same(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(few, "doc_id long, key long, n long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that come before each row in its partition."""
    total = 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - n), batch.column(2)], names=["part", "rid", "before", "n"])
        total = int(ends[-1]) if len(ends) else total


def cuts(total: int, size: int) -> list[int]:
    """Starts of the sequences after the last full one: what remains is cut into powers of two, so
    that no sequence needs padding."""
    at, rest, out = total - total % size, total % size, []
    while rest:
        out.append(at)
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
    return out


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """One row for each piece of a document of ``docs(doc_id, text)``: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, key, ids`` (``ids`` as unsigned 16-bit bytes).

    The pieces of a sequence fill it without gaps. All sequences have ``size`` ids but the last few,
    which are powers of two, so none needs padding. Null and empty texts are just the closing id; rows
    that are alike, also in doc_id, are packed each; a null doc_id stays null. Other columns are
    ignored, and an empty table gives an empty result. Whole texts are encoded, however long.
    """
    coded = keep(tokenized(docs, path).withColumn("rid", F.monotonically_increasing_id()), "ids")
    small = coded.select("key", "doc_id", "rid", "n")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = small.repartitionByRange(parts, "key", "doc_id", "rid").sortWithinPartitions("key", "doc_id", "rid")
    order = ranged.select(F.spark_partition_id().alias("part"), "rid", "n").mapInArrow(_running, "part int, rid long, before long, n long")
    order = keep(order, "order")
    sums = sorted(map(tuple, order.groupBy("part").agg(F.sum("n")).collect()))  # a number for each partition
    starts = dict(zip([p for p, _ in sums], np.cumsum([0] + [n for _, n in sums]).tolist()))
    total = sum(n for _, n in sums)
    last = cuts(total, size)
    whole = total // size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, key, n, part, before, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), bytes_of(batch, "ids")):
            wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            at, done = starts[part] + before, 0
            while done < n:
                if at < whole * size:
                    sequence, begin = at // size, at // size * size
                    end = begin + size
                else:
                    i = bisect_right(last, at) - 1
                    sequence, begin = whole + i, last[i]
                    end = last[i + 1] if i + 1 < len(last) else total
                take = min(n - done, end - at)
                crc = zlib.crc32(wide[4 * done : 4 * (done + take)])
                rows.append((doc, done, take, crc, n, sequence, at - begin, key, ids[2 * done : 2 * (done + take)]))
                done, at = done + take, at + take
        kinds = [pa.int64()] * 8 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "key", "ids"]
    schema = ", ".join(f"{n} long" for n in names[:-1]) + ", ids binary"
    joined = coded.join(order.select("rid", "part", "before"), "rid").select("doc_id", "key", "n", "part", "before", "ids")
    return map_batches(joined, lambda b: run(b) if b.num_rows else None, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
