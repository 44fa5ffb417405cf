"""Chunked operators against brute force, with chunk lengths that cut everywhere."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from rowtide.operators import telemetry as tm
from rowtide.operators import windows as win

S = 1_000_000
CHUNKS = [60 * S, 7 * S * 97, win.DAY]


def samples(seed, n=300):
    rng, out = random.Random(seed), []
    for series in ("a", "b", "busy"):
        t, v = rng.randrange(1000), 0.0
        for _ in range(n if series == "busy" else n // 5):
            t += rng.choice([1, 5, 15, 15, 15, 90, 700])
            v = float(rng.randrange(5)) if rng.random() < 0.1 else v + rng.randrange(0, 4)
            out.append((series, t, v))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "series string, t bigint, value double")
    return df.withColumn("metric", F.lit("m")).withColumn("ts", F.timestamp_micros(F.col("t") * S).cast("timestamp_ntz"))


def brute(rows, window, fn):
    out = []
    for s in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == s)
        for i, (t, _) in enumerate(mine):
            inside = [j for j in range(i + 1) if mine[j][0] > t - window]
            value = fn(mine, inside)
            if value is not None:
                out.append((s, t, value))
    return sorted(out)


def grown(m, j):
    if j == 0:
        return None
    return m[j][1] if m[j][1] < m[j - 1][1] else m[j][1] - m[j - 1][1]


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("window", [30, 600])
def test_rate_and_changes(spark, chunk, window):
    rows = samples(1)

    def rate(m, inside):
        incs = [x for x in (grown(m, j) for j in inside) if x is not None]
        return sum(incs) / float(window) if incs else None

    got = tm.rate(frame(spark, rows), window, chunk_us=chunk).select("series", "t", "rate")
    assert [(a, b, pytest.approx(c)) for a, b, c in brute(rows, window, rate)] == sorted(tuple(r) for r in got.collect())

    def moved(m, inside):
        return sum(1 for j in inside if j > 0 and m[j][1] != m[j - 1][1])

    got = tm.changes(frame(spark, rows), window, chunk_us=chunk).select("series", "t", "changes")
    assert brute(rows, window, moved) == sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("chunk", CHUNKS)
def test_average_and_slope(spark, chunk):
    rows = samples(2)
    got = tm.over_time(frame(spark, rows), "avg", 600, chunk_us=chunk).select("series", "t", "avg_over_time")
    want = brute(rows, 600, lambda m, js: float(np.mean([m[j][1] for j in js])))
    assert [(a, b, pytest.approx(c)) for a, b, c in want] == sorted(tuple(r) for r in got.collect())

    def slope(m, js):
        return float(np.polyfit([m[j][0] - m[js[0]][0] for j in js], [m[j][1] for j in js], 1)[0]) if len(js) > 1 else None

    got = tm.deriv(frame(spark, rows), 600, chunk_us=chunk).filter("deriv IS NOT NULL").select("series", "t", "deriv")
    assert [(a, b, pytest.approx(c, abs=1e-6)) for a, b, c in brute(rows, 600, slope)] == sorted(
        tuple(r) for r in got.collect())


def test_counter_reset(spark):
    rows = [("a", 0, 10.0), ("a", 15, 40.0), ("a", 30, 5.0), ("a", 45, 6.0)]
    got = tm.rate(frame(spark, rows), 60, chunk_us=20 * S).select("t", "rate").collect()
    assert {r.t: r.rate * 60 for r in got} == {15: 30.0, 30: 35.0, 45: 36.0}


@pytest.mark.parametrize("chunk", CHUNKS)
def test_runs(spark, chunk):
    rows, gap, want = samples(3), 60, []
    for s in {r[0] for r in rows}:
        run = []
        for _, t, v in sorted(r for r in rows if r[0] == s) + [(s, None, None)]:
            if run and (t is None or t - run[-1][0] > gap):
                want.append((s, run[0][0], run[-1][0], len(run), sum(x for _, x in run)))
                run = []
            run.append((t, v))
    got = win.merge_runs(frame(spark, rows), ["series"], F.col("t") * S, gap * S, {"total": ("sum", "value")}, chunk)
    got = got.select("series", (F.col("start_us") / S).cast("int"), (F.col("end_us") / S).cast("int"), "rows", "total")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_interval_join(spark):
    a = [(k, t) for k, t, _ in samples(4, 120)]
    b = [(k, t) for k, t, _ in samples(5, 120)]
    left = spark.createDataFrame(a, "series string, ta bigint")
    right = spark.createDataFrame(b, "series string, tb bigint")
    for low, high in ((0, 50), (-30, 30), (10, 10), (-100, -20)):
        got = win.interval_join(left, right, ["series"], F.col("ta"), F.col("tb"), low, high)
        want = sorted((k, t, u) for k, t in a for j, u in b if j == k and t + low <= u <= t + high)
        assert sorted(tuple(r) for r in got.select("series", "ta", "tb").collect()) == want


@pytest.mark.parametrize("chunk", [50, 1000, 10**9])
def test_asof_join(spark, chunk):
    a, b = samples(6, 100), samples(7, 40)
    left = spark.createDataFrame([(k, t) for k, t, _ in a], "series string, t bigint")
    right = spark.createDataFrame([(k, t, t) for k, t, _ in b], "series string, t bigint, seen bigint")
    got = win.asof_join(left, right, ["series"], F.col("t"), F.col("t"), ["seen"], chunk)
    want = [(k, t, max((u for j, u, _ in b if j == k and u <= t), default=None)) for k, t, _ in a]
    assert rows_of(got, ["series", "t", "seen"]) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("ranked, parts", [(1, 4), (10, 3), (1 << 20, 128)])
def test_exact_quantiles(spark, ranked, parts):
    rng = random.Random(8)
    values = {
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, "ties": [float(rng.randrange(4)) for _ in range(400)],
        "wide": [rng.lognormvariate(0, 3) for _ in range(1000)],
        "half": [5.0] * 500 + [rng.random() * 10 for _ in range(500)], None: [1.0, 4.0],
    }
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("two", None)], "g string, v double")
    qs = [0.0, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = {(r.g, r.q): r.value for r in win.exact_quantiles(df, ["g"], "v", qs, ranked, parts).collect()}
    assert got == {(g, q): pytest.approx(float(np.quantile(vs, q)), rel=1e-12) for g, vs in values.items() for q in qs}


def grid_runs(points, step):
    out = []
    for p in sorted(points):
        if out and p - out[-1][1] <= step:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("chunk", [20, 1000])
@pytest.mark.parametrize("phase", [0, 3])
def test_intervals_cut_out_like_points(spark, chunk, phase):
    rng, step = random.Random(chunk + phase), 5

    def some(n):
        out = []
        for _ in range(n):
            a = rng.randrange(0, 60) * step + phase
            out.append((rng.choice("xy"), a, a + rng.randrange(0, 14) * step))
        return out

    rows, holes = some(12), some(8) + [("z", 5, 10)]
    spread = lambda part: {(k, p) for k, a, b in part for p in range(a, b + 1, step)}
    keyed = [(k, i, a, b) for i, (k, a, b) in enumerate(rows)]
    schema = "start_us bigint, end_us bigint"
    df = spark.createDataFrame(keyed, f"k string, i int, {schema}")
    gone = spark.createDataFrame(holes, f"k string, {schema}")
    got = win.cut_out(df, gone, ["k"], step, chunk)
    want = [(k, i, *r) for k, i, a, b in keyed
            for r in grid_runs({p for p in range(a, b + 1, step) if (k, p) not in spread(holes)}, step)]
    assert sorted((r.k, r.i, r.start_us, r.end_us) for r in got.collect()) == sorted(want)
    merged = win.merge_intervals(df.drop("i"), ["k"], step, chunk)
    want = [(k, *r) for k in "xy" for r in grid_runs({p for x, p in spread(rows) if x == k}, step)]
    assert sorted(tuple(r) for r in merged.collect()) == sorted(want)
    assert win.cut_out(df, gone.where("false"), ["k"], step, chunk).count() == len(rows)
    assert win.cut_out(df.where("false"), gone, ["k"], step, chunk).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("low, high", [(0, 7), (-5, 5), (3, 3)])
def test_outer_interval_joins(spark, how, low, high):
    rng = random.Random(how + str(low))
    a = [(rng.choice(["x", "y", None]), rng.choice([None, *range(60)]), i) for i in range(40)]
    b = [(rng.choice(["x", "y", "z"]), rng.choice([None, *range(60)]), 100 + i) for i in range(40)]
    left, right = spark.createDataFrame(a, "k string, s bigint, i int"), spark.createDataFrame(b, "k string, t bigint, j int")
    pairs = [(x[0], x[2], y[2]) for x in a for y in b if x[0] == y[0] and None not in (x[0], x[1], y[1]) and x[1] + low <= y[1] <= x[1] + high]
    want = list(pairs)
    if how in ("left", "full"):
        want += [(x[0], x[2], None) for x in a if x[2] not in {p[1] for p in pairs}]
    if how in ("right", "full"):
        want += [(y[0], None, y[2]) for y in b if y[2] not in {p[2] for p in pairs}]
    got = win.interval_join(left, right, ["k"], F.col("s"), F.col("t"), low, high, how)
    assert sorted(map(tuple, got.select("k", "i", "j").collect()), key=str) == sorted(want, key=str)
