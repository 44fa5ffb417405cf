"""Ordered work on long series, split along time.

A plain window ``partitionBy(series)`` sorts a whole series in one task; one busy series can be
a third of all data. The functions here cut each series into chunks of time, so the shuffle is
by (series, chunk), and carry over just what the next chunk needs. Results do not depend on the
chunk length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rowtide.sources.tables import cut_lineage

DAY = 86_400_000_000


def _start(t: Column, size: int) -> Column:
    return t - F.pmod(t, F.lit(size))


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows by hash in ``spark.sql.shuffle.partitions`` tasks, however small they are: adaptive execution
    would join them by their compressed size, and rows of a few series are many times larger in memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def grid_points(df: DataFrame, first: Column, last: Column, step_us: int, name: str) -> DataFrame:
    """One row per grid point from ``first`` to ``last``. Done in blocks, so that an interval of
    years does not become one huge array."""
    block = step_us * 4096
    ends = df.withColumns({"_first": first, "_last": last})
    blocks = ends.withColumn("_block", F.explode(F.sequence("_first", "_last", F.lit(block))))
    upto = F.least(F.col("_block") + (block - step_us), F.col("_last"))
    points = blocks.withColumn(name, F.explode(F.sequence("_block", upto, F.lit(step_us))))
    return points.drop("_first", "_last", "_block")


class Frames:
    """Rows laid out for frames over (t - frame, t], one window partition per (series, chunk).

    ``rows`` holds every row in its own chunk (``_own``) and, where a frame of the next chunk
    reaches back to it, a second time in that chunk. With ``carry`` each chunk also starts with
    the newest row before all of that, so ``lag`` is exact at the chunk border.
    """

    def __init__(self, df: DataFrame, by: list[str], t: Column, frame_us: int, chunk_us: int = DAY,
                 carry: list[str] | None = None):
        self.by, self.frame_us = by, frame_us
        size = max(chunk_us, frame_us)
        base = df.withColumn("_t", t)
        home = _start(F.col("_t"), size)
        here = F.struct(home.alias("_chunk"), F.lit(True).alias("_own"))
        after = F.struct((home + size).alias("_chunk"), F.lit(False).alias("_own"))
        reaches = F.col("_t") + frame_us > home + size
        places = F.when(reaches, F.array(here, after)).otherwise(F.array(here))
        self.rows = base.select("*", F.inline(places))
        if carry:
            self.rows = self.rows.unionByName(self._carried(base, home, size, carry), allowMissingColumns=True)
        self.rows = spread(self.rows, [*by, "_chunk"])

    def _carried(self, base: DataFrame, home: Column, size: int, carry: list[str]) -> DataFrame:
        by, t = self.by, F.col("_t")
        # the chunk after _seen is the first whose frames do not reach back to the row
        seen = _start(t + (self.frame_us - 1), size)
        newest = [F.max(t).alias("_t"), *[F.max_by(c, t).alias(c) for c in carry]]
        cells = base.groupBy(*by, home.alias("_home"), seen.alias("_seen")).agg(*newest)
        tail = F.struct("_t", *carry)
        empty = F.lit(None).cast(cells.select(tail.alias("x")).schema["x"].dataType)
        # one row per series and chunk from here on: what a cell leaves behind, and who asks for it
        leaves = F.struct((F.col("_seen") + size).alias("_pos"), F.lit(0).alias("_rank"), tail.alias("_tail"))
        asks = F.struct(F.col("_home").alias("_pos"), F.lit(1).alias("_rank"), empty.alias("_tail"))
        moves = cells.select(*by, F.inline(F.array(leaves, asks)))
        w = Window.partitionBy(*by).orderBy("_pos", "_rank", "_tail._t").rowsBetween(Window.unboundedPreceding, 0)
        found = moves.withColumn("_tail", F.last("_tail", ignorenulls=True).over(w))
        found = found.filter((F.col("_rank") == 1) & F.col("_tail").isNotNull()).dropDuplicates([*by, "_pos"])
        return found.select(*by, "_tail.*", F.col("_pos").alias("_chunk"), F.lit(False).alias("_own"))

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.by, "_chunk").orderBy("_t")

    @property
    def frame(self) -> WindowSpec:
        return self.ordered.rangeBetween(-(self.frame_us - 1), 0)

    @staticmethod
    def own(df: DataFrame) -> DataFrame:
        return df.filter("_own").drop("_own", "_chunk", "_t")


_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def merge_runs(df: DataFrame, by: list[str], t: Column, gap_us: int, aggs: dict[str, tuple[str, str]] | None = None,
               chunk_us: int = DAY) -> DataFrame:
    """Runs of rows that follow each other by at most ``gap_us``.

    Result: ``by``, ``start_us``, ``end_us``, ``rows`` and the asked aggregates, given as
    name -> (sum|count|min|max, column). Runs are found inside each chunk first. Only the first
    and last run of a chunk can continue in another one, so the second step orders at most two
    rows per series and chunk; all other runs are already complete.
    """
    aggs = aggs or {}
    base = df.withColumn("_t", t).withColumn("_chunk", _start(F.col("_t"), max(chunk_us, gap_us)))
    w = Window.partitionBy(*by, "_chunk").orderBy("_t")
    gap = F.col("_t") - F.lag("_t").over(w)
    starts = F.when(gap.isNull() | (gap > gap_us), 1).otherwise(0)
    runs = (
        base.withColumn("_new", starts)
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_chunk", "_run")
        .agg(
            F.min("_t").alias("_s"), F.max("_t").alias("_e"), F.count("*").alias("_n"),
            *[_FIRST[fn](F.col(c)).alias(name) for name, (fn, c) in aggs.items()],
        )
    )
    merged = [F.sum("_n").alias("rows"), *[_MERGE[fn](F.col(name)).alias(name) for name, (fn, _) in aggs.items()]]
    return _across_chunks(runs, by, gap_us, merged)


def _across_chunks(runs: DataFrame, by: list[str], gap_us: int, merged: list[Column]) -> DataFrame:
    """Join the runs of neighbouring chunks; those in the middle of a chunk are complete."""
    runs = runs.withColumn("_runs", F.max("_run").over(Window.partitionBy(*by, "_chunk")))
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    laned = runs.withColumn("_lane", F.when(~edge, F.col("_chunk")))
    w2 = Window.partitionBy(*by, "_lane").orderBy("_s")
    gap2 = F.col("_s") - F.lag("_e").over(w2)
    starts2 = F.when(gap2.isNull() | (gap2 > gap_us), 1).otherwise(0)
    return (
        laned.withColumn("_new", starts2)
        .withColumn("_whole", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_lane", "_whole")
        .agg(F.min("_s").alias("start_us"), F.max("_e").alias("end_us"), *merged)
        .drop("_lane", "_whole")
    )


def next_start(df: DataFrame, by: list[str], t: str, order: list[str], name: str, chunk_us: int = DAY) -> DataFrame:
    """``df`` with ``name``, the time ``t`` of the row that follows within ``by`` by (t, ``order``); null
    for the last one. Rows are ordered within chunks of time, and one row for each chunk carries the
    first time of the next one over."""
    base = df.withColumn("_chunk", _start(F.col(t), chunk_us))
    inside = base.withColumn("_in", F.lead(t).over(Window.partitionBy(*by, "_chunk").orderBy(t, *order)))
    firsts = base.groupBy(*by, "_chunk").agg(F.min(t).alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*by).orderBy("_chunk"))).drop("_first")
    same = F.lit(True)
    for c in [*by, "_chunk"]:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"a.{c}"))
    joined = inside.alias("i").join(after.alias("a"), same)
    return joined.select(*[F.col(f"i.{c}") for c in df.columns], F.coalesce("_in", "_after").alias(name))


def split_intervals(df: DataFrame, chunk_us: int = DAY) -> DataFrame:
    """Cut each interval ``start_us`` to ``end_us``, both included, at the borders of the chunks:
    one row ``_chunk, _s, _e`` for each chunk it touches, however many instants lie in it."""
    chunks = F.sequence(_start(F.col("start_us"), chunk_us), F.col("end_us"), F.lit(chunk_us))
    return df.withColumn("_chunk", F.explode(chunks)).withColumns({
        "_s": F.greatest("start_us", "_chunk"), "_e": F.least(F.col("end_us"), F.col("_chunk") + (chunk_us - 1)),
    })


def merge_intervals(df: DataFrame, by: list[str], gap_us: int, chunk_us: int = DAY) -> DataFrame:
    """Union of intervals ``start_us`` to ``end_us``; those at most ``gap_us`` apart become one.
    Result: ``by``, ``start_us``, ``end_us``."""
    pieces = split_intervals(df.select(*by, "start_us", "end_us"), max(chunk_us, gap_us))
    w = Window.partitionBy(*by, "_chunk").orderBy("_s", "_e")
    reached = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reached.isNull() | (F.col("_s") - reached > gap_us), 1).otherwise(0)
    runs = pieces.withColumn("_new", starts).withColumn(
        "_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy(*by, "_chunk", "_run").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    return _across_chunks(runs, by, gap_us, [])


def cut_out(df: DataFrame, holes: DataFrame, on: list[str], step_us: int, chunk_us: int = DAY) -> DataFrame:
    """What is left of the intervals of ``df`` where no interval of ``holes`` with equal ``on`` lies.

    Ends are included and lie on a grid of ``step_us``. Both sides are cut into chunks and meet by
    (on, chunk); holes are merged first, so a piece meets at most one for every two grid points of
    its chunk. Other columns of ``df`` are kept and tell its intervals apart.
    """
    size = max(chunk_us, step_us)
    keys = [c for c in df.columns if c not in ("start_us", "end_us")]
    phase = F.pmod(F.col("start_us"), F.lit(step_us))
    pieces = split_intervals(df.withColumn("_phase", phase), size)
    pieces = pieces.withColumns({
        "_s": F.col("_s") + F.pmod(F.col("_phase") - F.col("_s"), F.lit(step_us)),
        "_e": F.col("_e") - F.pmod(F.col("_e") - F.col("_phase"), F.lit(step_us)),
    }).filter("_s <= _e")
    gone = split_intervals(merge_intervals(holes, on, step_us, chunk_us), size)
    return merge_intervals(_outside(pieces, gone, [*on, "_chunk"], keys, step_us), keys, step_us, chunk_us)


def _outside(pieces: DataFrame, gone: DataFrame, on: list[str], keys: list[str], step_us: int, join: str | None = None) -> DataFrame:
    """What the intervals ``_s`` to ``_e`` of ``gone``, apart from each other, leave of those of
    ``pieces`` with equal ``on``: one row ``keys, start_us, end_us`` for each part."""
    gone = gone.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_s", "_e"))).alias("_holes"))
    met = pieces.join(gone.hint(join) if join else gone, on, "left").withColumn(
        "_holes", F.coalesce("_holes", F.expr("cast(array() as array<struct<_s: bigint, _e: bigint>>)")))
    froms = F.concat(F.array("_s"), F.transform("_holes", lambda h: F.greatest(F.col("_s"), h["_e"] + step_us)))
    tos = F.concat(F.transform("_holes", lambda h: F.least(F.col("_e"), h["_s"] - step_us)), F.array("_e"))
    left = F.filter(F.arrays_zip(froms.alias("start_us"), tos.alias("end_us")), lambda x: x["start_us"] <= x["end_us"])
    return met.select(*keys, F.inline(left))


#: Buckets of keys that are counted, and rows from which on a bucket's keys are cut along time.
BUCKETS, BUSY = 4096, 1 << 20


def busy_keys(sides: list[DataFrame], keys: list[Column], busy: int = BUSY) -> Column | None:
    """Whether a key, ``keys`` on any of the ``sides``, may have so many rows that one task must not order
    them: true for the keys of hash buckets with more than ``busy`` rows, and more than eight times the
    average, over all ``sides``; None if there are none. One scan counts the buckets; the numbers of those found are collected, at
    most an eighth."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counted = reduce(DataFrame.union, [df.select(bucket.alias("b")) for df in sides]).groupBy("b").count()
    sizes = counted.agg(F.sum("count").alias("rows"), F.collect_list(F.struct("b", "count")).alias("all"))
    limit = F.greatest(F.lit(busy), F.col("rows") * 8 / BUCKETS)
    found = sizes.select(F.filter("all", lambda x: x["count"] > limit)["b"].alias("b")).first()[0]
    return bucket.isin(found) if found else None


def lasting(log: DataFrame, by: list[str], state: list[str], order: list[str], until: int) -> DataFrame:
    """Intervals ``by, state, start_us, end_us``, ends included, in which a key keeps its state: from the
    change ``at`` that brought it to the instant before the next change to another one, or to ``until``.
    Of changes at one instant the last by ``order`` counts. A key is ordered in one task."""
    w = Window.partitionBy(*by).orderBy("at", *order)
    now = F.struct(*state)
    seen = log.where(F.col("at") <= until).withColumn("_next", F.lead("at").over(w)).where("_next is null or _next > at")
    turns = seen.withColumn("_before", F.lag(now).over(w)).where(~F.col("_before").eqNullSafe(now))
    ends = F.coalesce(F.lead("at").over(w) - 1, F.lit(until)).cast("bigint")
    return turns.select(*by, *[c for c in state if c not in by], F.col("at").cast("bigint").alias("start_us"), ends.alias("end_us"))


def cut_out_whole(df: DataFrame, holes: DataFrame, on: list[str]) -> DataFrame:
    """``cut_out`` by whole numbers for holes that lie apart, without cutting intervals into chunks: the
    rows of equal ``on`` meet in one task. Always by a shuffle: a scan tells too little of how many rows
    its changes become, and a broadcast once planned is kept."""
    keys = [c for c in df.columns if c not in ("start_us", "end_us")]
    pieces, gone = (d.withColumnsRenamed({"start_us": "_s", "end_us": "_e"}) for d in (df, holes))
    return _outside(pieces, gone, on, keys, 1, "merge")


def interval_join(a: DataFrame, b: DataFrame, key: list[str], ta: Column, tb: Column, low_us: int, high_us: int,
                  how: str = "inner") -> DataFrame:
    """Pairs with equal key and ``ta + low <= tb <= ta + high``.

    Both sides are cut into time slots as long as the interval. Each row of ``b`` lies in one
    slot and each row of ``a`` looks into at most two, so a pair is found exactly once and a
    busy key is spread over its slots. Column names other than the key must differ.

    With ``how`` ``left``, ``right`` or ``full`` the rows of that side that are in no pair follow, with
    nulls for the other side: a row of ``b`` is looked for in its slot, a row of ``a`` in its first and
    then in its last one. Rows with a null key or time are in no pair.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown interval join {how!r}")
    if high_us < low_us:
        raise ValueError("empty interval")
    slot = max(high_us - low_us, 1)
    a = a.withColumn("_ta", ta)
    first = _start(F.col("_ta") + low_us, slot)
    last = _start(F.col("_ta") + high_us, slot)
    slots = F.when(first == last, F.array(first)).otherwise(F.array(first, last))
    left = a.withColumn("_slot", F.explode(slots))
    right = b.withColumn("_tb", tb).withColumn("_slot", _start(F.col("_tb"), slot))
    within = F.col("_tb").between(F.col("_ta") + low_us, F.col("_ta") + high_us)
    out = left.join(right, key + ["_slot"]).filter(within).drop("_slot", "_ta", "_tb")
    if how in ("left", "full"):
        lone = a.withColumns({"_first": first, "_last": last})
        for slot_of in ("_first", "_last"):
            on = _all_equal([(f"l.{k}", f"r.{k}") for k in [*key]] + [(f"l.{slot_of}", "r._slot")]) & within
            lone = lone.alias("l").join(right.alias("r"), on, "left_anti")
        out = out.unionByName(lone.drop("_first", "_last", "_ta"), allowMissingColumns=True)
    if how in ("right", "full"):
        on = _all_equal([(f"l.{k}", f"r.{k}") for k in [*key, "_slot"]]) & within
        lone = right.alias("r").join(left.alias("l"), on, "left_anti")
        out = out.unionByName(lone.drop("_slot", "_tb"), allowMissingColumns=True)
    return out


def _all_equal(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for x, y in pairs:
        out = out & (F.col(x) == F.col(y))
    return out


def asof_join(left: DataFrame, right: DataFrame, by: list[str], tl: Column, tr: Column, cols: list[str],
              chunk_us: int = DAY) -> DataFrame:
    """Each left row with ``cols`` of the newest right row at or before it (nulls if none).

    Cut along time like ``Frames``: every chunk starts with the newest right row of the chunks
    before it, so only (series, chunk) sized groups are ordered in one task.
    """
    found = F.struct(*[F.col(c) for c in cols])
    a = left.withColumn("_t", tl).withColumn("_chunk", _start(F.col("_t"), chunk_us))
    b = right.select(*by, tr.alias("_t"), found.alias("_found"))
    b = b.withColumn("_chunk", _start(F.col("_t"), chunk_us))
    tails = b.groupBy(*by, "_chunk").agg(F.max_by(F.struct("_t", "_found"), "_t").alias("_tail")).select(
        *by, (F.col("_chunk") + chunk_us).alias("_pos"), F.lit(0).alias("_rank"), "_tail"
    )
    empty = F.lit(None).cast(tails.schema["_tail"].dataType).alias("_tail")
    keys = a.select(*by, F.col("_chunk").alias("_pos"), F.lit(1).alias("_rank"), empty).distinct()
    w = Window.partitionBy(*by).orderBy("_pos", "_rank")
    carried = tails.unionByName(keys).withColumn("_tail", F.last("_tail", ignorenulls=True).over(w))
    carried = carried.filter((F.col("_rank") == 1) & F.col("_tail").isNotNull()).select(
        *by, F.col("_tail._t").alias("_t"), F.col("_tail._found").alias("_found"), F.col("_pos").alias("_chunk")
    )
    rows = a.withColumn("_left", F.lit(1)).unionByName(
        b.unionByName(carried).withColumn("_left", F.lit(0)), allowMissingColumns=True
    )
    newest = Window.partitionBy(*by, "_chunk").orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_found", F.last("_found", ignorenulls=True).over(newest)).filter("_left = 1")
    return out.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in cols])


#: Distinct values that one task ranks, and parts that a larger cell is cut into.
RANKED, PARTS = 1 << 20, 128


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], ranked: int = RANKED, parts: int = PARTS) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    Equal values are counted before the shuffle, so a value that half of all rows have is one row.
    Each group is a cell first; while a cell that holds a wanted rank has more than ``ranked`` distinct
    values, it is cut into ``parts`` of about equal size by approximate quantiles of its values, the
    exact row counts of the parts tell which of them hold the ranks, and all others go. So a task ranks
    no more than ``ranked`` values, and the rounds are the logarithm of a group's size.
    Result: ``by``, ``q``, ``value``. Null values do not count.
    """
    data = df.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    rows = data.groupBy("g", "v").agg(F.count("*").alias("n")).withColumn("cell", F.lit(0).cast("bigint"))
    asked = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    cells = rows.groupBy("g", "cell").agg(F.count("*").alias("values"), F.sum("n").alias("total")).withColumn("before", F.lit(0).cast("bigint"))
    size = cells.agg(F.max("values")).first()[0] or 0
    if size > ranked:
        rows, cells = cut_lineage(rows), cut_lineage(cells)
    pos = F.col("q") * (F.col("total") - 1)
    wanted = cells.select("g", "total", asked.alias("q")).select("g", "q", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))).alias("rank"), pos.alias("pos"))
    while size > ranked:
        marks = [i / parts for i in range(1, parts)]
        edges = rows.join(cells.where(F.col("values") > ranked).select("g", "cell"), ["g", "cell"], "left_semi").groupBy("g", "cell").agg(
            F.array_distinct(F.percentile_approx("v", marks, 100 * parts)).alias("edges"))
        at = F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("v"))), F.lit(0))
        cut = rows.join(edges, ["g", "cell"], "left").select("g", "v", "n", (F.col("cell") * parts + at).alias("cell"), "cell").toDF("g", "v", "n", "cell", "up")
        sums = cut.groupBy("g", "up", "cell").agg(F.count("*").alias("values"), F.sum("n").alias("rows"))
        upto = Window.partitionBy("g", "up").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("inner", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
        placed = sums.join(cells.select("g", F.col("cell").alias("up"), "before"), ["g", "up"]).withColumn("before", F.col("before") + F.col("inner"))
        hit = (F.col("w.rank") >= F.col("p.before")) & (F.col("w.rank") < F.col("p.before") + F.col("p.rows"))
        held = placed.alias("p").join(wanted.alias("w"), (F.col("p.g") == F.col("w.g")) & hit, "left_semi")
        cells = cut_lineage(held.select("g", "cell", "values", "before"))
        rows = cut_lineage(cut.join(cells.select("g", "cell"), ["g", "cell"], "left_semi").select("g", "v", "n", "cell"))
        last, size = size, cells.agg(F.max("values")).first()[0]
        parts = parts if size < last else 2 * parts  # a cell that did not shrink is cut finer
    in_cell = Window.partitionBy("g", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.join(cells.select("g", "cell", "before"), ["g", "cell"]).withColumn("end", F.col("before") + F.sum("n").over(in_cell))
    hit = (F.col("w.rank") >= F.col("r.end") - F.col("r.n")) & (F.col("w.rank") < F.col("r.end"))
    found = ends.alias("r").join(wanted.alias("w"), F.col("r.g").eqNullSafe(F.col("w.g")) & hit).select("w.g", "q", "pos", "rank", "v")
    low = F.max(F.when(F.col("rank") == F.floor("pos"), F.col("v")))
    high = F.max(F.when(F.col("rank") == F.ceil("pos"), F.col("v")))
    told = found.groupBy("g", "q").agg(low.alias("l"), high.alias("h"), F.max(F.col("pos") - F.floor("pos")).alias("f"))
    return told.select("g.*", "q", (F.col("l") + (F.col("h") - F.col("l")) * F.col("f")).alias("value"))
