"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are found by cutting the 64 bits into m groups
with thresholds T_1 ... T_m that add up to ``radius - m + 1``: whatever the pair, some group differs
in at most its own threshold (-1: that group is never probed). Correlated bits go into one group, so
that the groups are as independent as possible, and a dynamic programme gives out the thresholds by
the number of candidates each would bring.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.common import bytes_of, discard, keep, map_batches, same, table, without
from rowtide.llm.components import components

BITS = 64
#: Fingerprints looked at to choose groups and thresholds; the choice affects speed, never results.
SAMPLE = 2048
#: Rows that one task compares at a time, on average.
SHARD_ROWS = 100_000
#: Buckets above this size are linked by enumerating neighbours instead of by comparison.
BUCKET_ROWS = 2**17
#: Buckets up to this size give one link for each pair, larger ones a spanning forest.
SMALL = 48

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text's word shingles; zero without words."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    hashes = np.fromiter(map(_hash, shingles), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp, rid)`` with a 64-bit fingerprint and a hash of doc_id and text for each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t or b"", words) for t in bytes_of(batch, "text")), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "rid"])

    rows = same(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows.withColumn("rid", F.xxhash64("doc_id", "text")), run, "doc_id long, fp long, rid long")


# -- choice of groups and thresholds ---------------------------------------------------------


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """Put the 64 bits into m groups; each grows from its first bit by the most correlated ones."""
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    tied = np.abs(centred.T @ centred) / max(1, len(bits))
    free, out = list(range(BITS)), []
    for size in [len(x) for x in np.array_split(np.arange(BITS), m)]:
        group = [max(free, key=lambda b: tied[b, free].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: tied[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _share(sample: np.ndarray, bits: np.ndarray, group: list[int], radius: int) -> np.ndarray:
    """Share of pairs that differ in at most 0 ... radius bits of a group: as sampled, or as
    independent bits would have it if that is more."""
    one = bits[:, group].mean(axis=0)
    unlike = 2 * one * (1 - one)
    spread = np.array([1.0])
    for p in unlike:
        spread = np.convolve(spread, [1 - p, p])
    model = np.cumsum(spread)[: radius + 1]
    part = sample & np.uint64(sum(1 << b for b in group))
    seen = np.zeros(radius + 1)
    for i in range(1, len(part)):
        seen += np.bincount(np.minimum(np.bitwise_count(part[i] ^ part[:i]), radius + 1), minlength=radius + 2)[: radius + 1]
    pairs = max(1, len(part) * (len(part) - 1) // 2)
    return np.maximum(model, np.cumsum(seen) / pairs)


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each group, that add up to ``total`` at the least cost.
    ``cost[i][t]`` is that of threshold t in group i; -1 costs nothing."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (paid, chosen) in best.items():
            for t, c in enumerate([0.0, *row], start=-1):
                if have + t not in step or paid + c < step[have + t][0]:
                    step[have + t] = (paid + c, [*chosen, t])
        best = step
    return best[total]


def plan_probes(sample: np.ndarray, count: int, radius: int) -> list[tuple[int, int]]:
    """``(mask, threshold)`` of every group to probe, for ``count`` fingerprints like the sample."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(2, radius + 4):
        groups = _groups(bits, m)
        cost = []
        for g in groups:
            ball = np.cumsum([comb(len(g), t) for t in range(radius + 1)])
            cost.append(list(count * ball * 1.0 + _share(sample, bits, g, radius) * ball * count * count / 2))
        paid, chosen = allocate(cost, radius - m + 1)
        if best is None or paid < best[0]:
            best = paid, [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen) if t >= 0]
    return best[1] if best else []


# -- candidates and verification --------------------------------------------------------------


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _flips(mask: int, radius: int) -> list[int]:
    """Every change of up to ``radius`` bits within the mask."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [_signed(sum(c)) for r in range(radius + 1) for c in combinations(bits, r)]


def _longs(values: list[int]) -> Column:
    """An array literal as text, which stays small in the plan."""
    return F.transform(F.split(F.lit(",".join(map(str, values))), ","), lambda x: x.cast("long"))


def _probes(fps: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """``(part, key, fp)``: in group ``part`` the fingerprint or one near it has the bits ``key``."""
    def around(i: int, mask: int, t: int) -> Column:
        held = F.col("fp").bitwiseAND(_signed(mask))
        return F.transform(_longs(_flips(mask, t)), lambda f: F.struct(F.lit(i).alias("part"), held.bitwiseXOR(f).alias("key")))

    keys = [around(i, mask, t) for i, (mask, t) in enumerate(plan)]
    return fps.select("fp", F.explode(F.concat(*keys)).alias("k")).select("k.part", "k.key", "fp")


def _forest(fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links inside one bucket: visit each value once, dropping what it
    reaches from those still to be reached."""
    left = fp
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                yield np.full(int(near.sum()), at), left[near]
                queue.extend(left[near])
                left = left[~near]


def _compare(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Verified links within the buckets of one shard."""
    order = np.lexsort((rows["fp"].to_numpy(), rows["key"].to_numpy(), rows["part"].to_numpy()))
    part, key = rows["part"].to_numpy()[order], rows["key"].to_numpy()[order]
    fp = rows["fp"].to_numpy()[order].view(np.uint64)
    new = np.ones(len(fp), bool)
    new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        found.extend(_forest(np.unique(fp[s : s + n]), radius))
    left = np.repeat(sizes, sizes) - (np.arange(len(fp)) - np.repeat(starts, sizes))  # rows of the bucket from here on
    left[np.repeat(sizes, sizes) > SMALL] = 0
    for step in range(1, SMALL):
        at = np.flatnonzero(left > step)
        if not len(at):
            break
        a, b = fp[at], fp[at + step]
        near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
        found.append((a[near], b[near]))
    a = np.concatenate([x for x, _ in found]) if found else np.array([], np.uint64)
    b = np.concatenate([y for _, y in found]) if found else np.array([], np.uint64)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()


def _neighbours(hot: DataFrame, radius: int) -> DataFrame:
    """Links of the values in very large buckets without comparing them: two values within 3 bits
    meet at a value one bit from the first and two from the second. All that reach a meeting point
    are linked to the least of those that are near enough for the link to be certain."""
    near, far = _longs(_flips(2**BITS - 1, radius // 2)), _longs(_flips(2**BITS - 1, radius - radius // 2))
    values = hot.select("fp").distinct()
    close = values.select("fp", F.explode(near).alias("f")).select(F.col("fp").bitwiseXOR(F.col("f")).alias("at"), "fp")
    hub = close.groupBy("at").agg(F.min("fp").alias("hub"))
    reach = values.select("fp", F.explode(far).alias("f")).select(F.col("fp").bitwiseXOR(F.col("f")).alias("at"), "fp")
    return reach.join(hub, "at").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def link(fps: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect everything within ``radius``
    bits: every pair in small buckets, a spanning forest in large ones."""
    values = keep(fps.select("fp").distinct(), "values")
    count = values.count()
    pick = values.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, count // SAMPLE))) == 0).limit(2 * SAMPLE)
    sample = np.array([r[0] for r in pick.collect()], np.int64).view(np.uint64)
    if count < 2:
        return values.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    probes = _probes(values, plan_probes(sample, count, radius))
    sizes = keep(probes.groupBy("part", "key").count().where("count > 1"), "buckets")
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    if not total:
        return values.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    shards = max(1, -(-total // shard_rows))
    filled = probes.join(sizes.where(F.col("count") <= bucket_rows), ["part", "key"], "left_semi")
    sharded = filled.withColumn("shard", F.pmod(F.xxhash64("part", "key"), F.lit(shards)))
    links = sharded.groupBy("shard").applyInPandas(lambda rows: _compare(rows, radius), "a long, b long")
    if largest > bucket_rows:
        hot = probes.join(sizes.where(F.col("count") > bucket_rows), ["part", "key"], "left_semi")
        links = links.unionByName(_neighbours(hot, radius))
    return links


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    Rows with equal fingerprints are one group, groups within ``radius`` bits are linked, and
    ``component_id`` is the smallest doc_id that can be reached. Null and empty texts have
    fingerprint zero and are linked like any other. Rows repeat if they repeat in the input; a null
    doc_id never becomes a component's id unless all its rows have none. Other columns are ignored,
    an empty table gives an empty result. Whole texts are read, however long.
    """
    return _grouped(docs, words, radius, bucket_rows).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, words: int = 3, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``near_duplicates`` with ``rid``, a hash of doc_id and text."""
    fps = keep(fingerprints(docs, words), "fingerprints")
    roots = components(link(fps, radius, bucket_rows)).select(F.col("node").alias("fp"), "root")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp", "left")
    groups = keep(groups.select("fp", "first", F.coalesce("root", "fp").alias("root")), "groups")
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(groups.join(least, "root").select("fp", "component_id"), "named")
    discard(groups)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "rid")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that come first in their near-duplicate group, with all their columns.
    Of rows that share the smallest doc_id each is kept, as are rows without an id. An id with two
    texts loses only those that are copies."""
    found = _grouped(docs, **options)
    return without(docs, found.where("doc_id > component_id").select("doc_id", "rid"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
