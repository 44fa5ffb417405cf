"""Metric samples as a table: ``ts, metric, labels map<string,string>, value double``.

A series is one metric with one label set; ``with_series`` adds its key as text. Range
functions look at (t - window, t] and return one row per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions.clock import SECOND, from_micros, micros, seconds
from rowtide.functions.labels import label, matcher, series_key
from rowtide.operators.windows import DAY, Frames, exact_quantiles, grid_points

SERIES = ["metric", "series"]


def with_series(samples: DataFrame) -> DataFrame:
    """Add the series key; a store that keeps it next to the labels saves sorting them again."""
    if "series" in samples.columns:
        return samples
    return samples.withColumn("series", series_key(F.col("labels")))


def select_series(samples: DataFrame, metric: str, eq=None, regex=None, not_regex=None) -> DataFrame:
    return samples.filter((F.col("metric") == metric) & matcher(F.col("labels"), eq, regex, not_regex))


RangeSpecs = dict[str, tuple[str, int]]


def range_columns(samples: DataFrame, specs: RangeSpecs, by: list[str] = SERIES, chunk_us: int = DAY) -> DataFrame:
    """Several range functions at once, name -> (function, window in seconds), with one shuffle.

    Functions: ``rate``, ``changes``, ``deriv``, and ``avg``, ``min``, ``max``, ``sum``, ``count``
    of the samples in the window.
    """
    needs_previous = any(fn in ("rate", "changes") for fn, _ in specs.values())
    f = Frames(samples, by, micros(F.col("ts")), max(seconds(w) for _, w in specs.values()), chunk_us,
               carry=["value"] if needs_previous else None)
    rows = f.rows
    if needs_previous:
        prev = F.lag("value").over(f.ordered)
        grown = F.when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev)
        moved = F.when(F.col("value") != prev, 1).otherwise(0)
        rows = rows.withColumns({"_inc": grown, "_moved": moved})
    if any(fn == "deriv" for fn, _ in specs.values()):
        rows = rows.withColumn("_x", (F.col("_t") - F.col("_chunk")) / F.lit(float(SECOND)))
    simple = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    made = {}
    for name, (fn, window_s) in specs.items():
        w = f.ordered.rangeBetween(-(seconds(window_s) - 1), 0)
        if fn == "rate":
            made[name] = F.sum("_inc").over(w) / F.lit(float(window_s))
        elif fn == "changes":
            made[name] = F.sum("_moved").over(w)
        elif fn == "deriv":
            made[name] = F.regr_slope("value", "_x").over(w)
        else:
            made[name] = simple[fn]("value").over(w)
    return f.own(rows.withColumns(made)).drop("_inc", "_moved", "_x")


def rate(samples: DataFrame, window_s: int, by: list[str] = SERIES, chunk_us: int = DAY) -> DataFrame:
    """Counter increase per second over the window.

    A value below the one before it is a reset: the counter started again at zero, so the
    increase is the new value. An increase counts at the time of its later sample, and nothing
    is extrapolated to the window borders. The first sample of a series has no rate.
    """
    out = range_columns(samples, {"rate": ("rate", window_s)}, by, chunk_us)
    return out.filter(F.col("rate").isNotNull())


def over_time(samples: DataFrame, fn: str, window_s: int, by: list[str] = SERIES, chunk_us: int = DAY) -> DataFrame:
    """avg, min, max, sum or count of the samples in the window."""
    return range_columns(samples, {f"{fn}_over_time": (fn, window_s)}, by, chunk_us)


def deriv(samples: DataFrame, window_s: int, by: list[str] = SERIES, chunk_us: int = DAY) -> DataFrame:
    """Least-squares slope per second of the samples in the window; null with a single sample."""
    return range_columns(samples, {"deriv": ("deriv", window_s)}, by, chunk_us)


def changes(samples: DataFrame, window_s: int, by: list[str] = SERIES, chunk_us: int = DAY) -> DataFrame:
    """How often the value differs from the sample before it, within the window."""
    return range_columns(samples, {"changes": ("changes", window_s)}, by, chunk_us)


def agg_series(samples: DataFrame, fn: str, by: list[str], value: str = "value") -> DataFrame:
    """``sum by``, ``avg by`` ... at each instant; ``by`` are label names."""
    agg = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[fn]
    return samples.groupBy("ts", *[label(F.col("labels"), b).alias(b) for b in by]).agg(agg(value).alias("value"))


def grid(samples: DataFrame, step_s: int) -> DataFrame:
    """All step starts between the first and last sample, whether or not a sample lies there."""
    step = seconds(step_s)
    t = micros(F.col("ts"))
    ends = samples.agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    first, last = F.col("_a") - F.pmod("_a", F.lit(step)), F.col("_b") - F.pmod("_b", F.lit(step))
    return grid_points(ends, first, last, step, "_g").select(from_micros(F.col("_g")).alias("ts"))


def or_zero(series: DataFrame, instants: DataFrame) -> DataFrame:
    """Zero at every instant that has no value (``or vector(0)``)."""
    return instants.join(series, "ts", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def combine(a: DataFrame, b: DataFrame, on: list[str], result: Column) -> DataFrame:
    """Arithmetic on series with equal labels; ``result`` uses ``a_value`` and ``b_value``."""
    left = a.select(*on, F.col("value").alias("a_value"))
    right = b.select(*on, F.col("value").alias("b_value"))
    return left.join(right, on).select(*on, result.alias("value"))


def used_percent(samples: DataFrame, free: str, total: str, on: list[str], eq=None) -> DataFrame:
    """(1 - free / total) * 100 from two metrics, in one pass instead of a self join."""
    both = samples.filter(F.col("metric").isin(free, total) & matcher(F.col("labels"), eq))
    keys = [label(F.col("labels"), k).alias(k) for k in on]
    pivot = both.groupBy("ts", *keys).agg(
        F.max(F.when(F.col("metric") == free, F.col("value"))).alias("_f"),
        F.max(F.when(F.col("metric") == total, F.col("value"))).alias("_t"),
    )
    whole = pivot.filter(F.col("_f").isNotNull() & F.col("_t").isNotNull())
    return whole.select("ts", *on, ((1 - F.col("_f") / F.col("_t")) * 100).alias("value"))


def busy_percent(idle_rate: DataFrame, by: list[str]) -> DataFrame:
    """100 - average idle rate * 100, from the rate of the idle counters."""
    keys = [label(F.col("labels"), k).alias(k) for k in by]
    return idle_rate.groupBy("ts", *keys).agg((100 - F.avg("rate") * 100).alias("value"))


def both(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` that have a partner in ``b`` at the same instant."""
    return a.join(b.select(*on).distinct(), on, "left_semi")


def resample(samples: DataFrame, step_s: int, by: list[str] = SERIES) -> DataFrame:
    """Last value per step, stamped with the start of the step."""
    t = micros(F.col("ts"))
    cell = t - F.pmod(t, F.lit(seconds(step_s)))
    out = samples.groupBy(*by, cell.alias("_cell")).agg(F.max_by("value", "ts").alias("value"))
    return out.withColumn("ts", from_micros(F.col("_cell"))).drop("_cell")


def last_value(samples: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """Newest value per series that is neither null nor NaN."""
    real = samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return real.groupBy(*by).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def label_values(samples: DataFrame, metric: str, name: str) -> DataFrame:
    found = samples.filter(F.col("metric") == metric).select(label(F.col("labels"), name).alias("value"))
    return found.filter(F.col("value") != "").distinct()


def with_target_labels(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the static labels of the scrape target; a label the sample has wins."""
    t = targets.select("job", "instance", F.col("labels").alias("_static"))
    inst = samples.withColumns(
        {"job": label(F.col("labels"), "job"), "instance": label(F.col("labels"), "instance")}
    )
    joined = inst.join(t, ["job", "instance"], "left")
    empty = F.create_map().cast("map<string,string>")
    static = F.coalesce("_static", empty)
    extra = F.map_filter(static, lambda k, v: ~F.map_contains_key(F.col("labels"), k))
    return joined.withColumn("labels", F.map_concat("labels", extra)).drop("_static", "job", "instance")


def lag_ms(events: DataFrame) -> DataFrame:
    """How far behind the source each event arrived."""
    lag = (micros(F.col("ts")) - micros(F.col("source.ts"))) / F.lit(1000.0)
    return events.withColumn("lag_ms", lag)


def idle_ms(events: DataFrame, step_s: int, by: list[str], until_us: int) -> DataFrame:
    """Milliseconds since the last event, per series and grid point up to ``until_us``.

    Events are reduced to the newest per step before anything is ordered, so a busy series has
    no more rows than there are grid points; each of them then fills the points up to the next.
    """
    step = seconds(step_s)
    t = micros(F.col("ts"))
    up = t + F.pmod(-t, F.lit(step))
    cells = events.groupBy(*by, up.alias("_g")).agg(F.max(t).alias("_seen"))
    w = Window.partitionBy(*by).orderBy("_g")
    upto = F.coalesce(F.lead("_g").over(w) - step, F.lit(until_us).cast("bigint"))
    points = grid_points(cells, F.col("_g"), F.greatest(upto, F.col("_g")), step, "_point")
    idle = (F.col("_point") - F.col("_seen")) / F.lit(1000.0)
    return points.select(*by, from_micros(F.col("_point")).alias("ts"), idle.alias("idle_ms"))


def consumer_lag(end_offsets: DataFrame, committed: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Records a consumer group has not read: end offset minus committed offset, summed.

    ``subscribed(group, topic, partition)`` names what each group reads, beside what it has committed
    to. A partition without a commit counts as a whole, and one whose end offset is not known makes
    the lag unknown.
    """
    # No lag passes, below 1000 records warns, anything above fails.
    lag = F.greatest(F.col("end_offset") - F.coalesce("committed", F.lit(0)), F.lit(0))
    out = committed.select("group", "topic", "partition", "committed")
    reads = subscribed.select("group", "topic", "partition").unionByName(out.drop("committed")).distinct()
    out = reads.join(out, ["group", "topic", "partition"], "left")
    out = out.join(end_offsets.select("topic", "partition", "end_offset"), ["topic", "partition"], "left")
    unknown = F.max(F.col("end_offset").isNull())
    total = out.groupBy("group").agg(F.when(~unknown, F.sum(lag)).alias("lag"))
    status = F.when(F.col("lag") == 0, "PASS").when(F.col("lag") < 1000, "WARN").when(F.col("lag").isNull(), "UNKNOWN").otherwise("FAIL")
    return total.withColumn("status", status)


def dlq_depth(catalog: DataFrame, expected: DataFrame) -> DataFrame:
    """Records per expected dead-letter topic; a topic that does not exist yet is only noted."""
    sums = catalog.groupBy("topic").agg(F.sum("end_offset").alias("records"))
    status = F.when(F.col("records").isNull(), "INFO").when(F.col("records") == 0, "PASS").otherwise("FAIL")
    return expected.select("topic").join(sums, "topic", "left").withColumn("status", status)


def event_mix(events: DataFrame, window: str) -> DataFrame:
    """Events per window and kind."""
    return events.groupBy(F.window("ts", window).alias("_w")).agg(
        *[F.count_if(F.col("op") == op).alias(name) for op, name in
          (("r", "reads"), ("c", "creates"), ("u", "updates"), ("d", "deletes"))]
    ).select(F.col("_w.start").alias("ts"), "reads", "creates", "updates", "deletes")


def throughput(events: DataFrame, window_s: int, by: list[str], size: Column) -> DataFrame:
    """Records, bytes and megabytes per second and tumbling window."""
    span = float(window_s)
    return (
        events.withColumn("_size", size)
        .groupBy(*by, F.window("ts", f"{window_s} seconds").alias("_w"))
        .agg(F.count("*").alias("_n"), F.sum("_size").alias("_b"))
        .select(
            *by, F.col("_w.start").alias("ts"),
            (F.col("_n") / F.lit(span)).alias("records_per_s"),
            (F.col("_b") / F.lit(span)).alias("bytes_per_s"),
            (F.col("_b") / F.lit(span) / F.lit(1048576.0)).alias("mb_per_s"),
        )
    )


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, maximum and the 50th, 75th, 95th and 99th percentile, exact."""
    qs = {0.5: "p50", 0.75: "p75", 0.95: "p95", 0.99: "p99"}
    quantiles = exact_quantiles(df, by, value, list(qs))
    wide = quantiles.groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in qs.items()]
    )
    basics = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return basics.join(wide, by)


def target_health(targets: DataFrame) -> DataFrame:
    """Targets up per job, and the check's outcome."""
    out = targets.groupBy("job").agg(F.count_if(F.col("health") == "up").alias("up"), F.count("*").alias("total"))
    return out.withColumn("status", F.when(F.col("up") == F.col("total"), "PASS").otherwise("WARN"))


def connector_status(status: DataFrame) -> DataFrame:
    """Roll-up of a connector's state and its tasks' states (array of struct with ``state``)."""
    all_run = F.forall(F.coalesce("tasks", F.array().cast(status.schema["tasks"].dataType)),
                       lambda t: F.coalesce(t["state"], F.lit("UNKNOWN")) == "RUNNING")
    state = F.coalesce("state", F.lit("UNKNOWN"))
    verdict = (
        F.when((state == "RUNNING") & all_run, "PASS").when(state.isin("RUNNING", "PAUSED"), "WARN").otherwise("FAIL")
    )
    running = F.size(F.filter("tasks", lambda t: t["state"] == "RUNNING"))
    return status.select("cluster", "connector", state.alias("state"), running.alias("running_tasks"),
                         F.size("tasks").alias("tasks"), verdict.alias("status"))


def queue_use(samples: DataFrame, remaining: str, total: str, on: list[str]) -> DataFrame:
    """Share of the queue in use, in percent."""
    return used_percent(samples, remaining, total, on)


def stage_latency(stages: DataFrame) -> DataFrame:
    """Milliseconds per path and stage with the total of each path."""
    out = stages.rollup("path", "stage").agg(F.sum("ms").alias("ms"), F.grouping("stage").alias("_all"),
                                             F.grouping("path").alias("_top"))
    return out.filter(F.col("_top") == 0).select(
        "path", F.when(F.col("_all") == 1, "total").otherwise(F.col("stage")).alias("stage"), "ms"
    )


def top_topics(log: DataFrame, k: int, size: Column) -> DataFrame:
    sums = log.groupBy("topic").agg(F.sum(size.cast("bigint")).alias("bytes"))
    return sums.orderBy(F.col("bytes").desc(), "topic").limit(k)


def service_rollup(lines: DataFrame) -> DataFrame:
    """Services per node from status lines, one JSON object per line.

    A service runs if its state is ``running`` or its status starts with ``Up``. A node that
    gave no line that can be read is unreachable.
    """
    schema = "Name string, Names string, State string, Status string"
    s = F.from_json("line", schema)
    flat = lines.select("node", F.coalesce(s["Name"], s["Names"]).alias("name"), s["State"].alias("state"),
                        s["Status"].alias("st"))
    runs = (F.col("state") == "running") | F.coalesce(F.col("st").rlike("^Up"), F.lit(False))
    runs = F.coalesce(runs, F.lit(False))
    named = F.col("name").isNotNull()
    out = flat.groupBy("node").agg(
        F.count_if(named & runs).alias("running"), F.count_if(named & ~runs).alias("stopped")
    )
    state = F.when(F.col("running") + F.col("stopped") == 0, "unreachable").when(F.col("stopped") > 0, "degraded")
    return out.withColumn("status", state.otherwise("up"))
