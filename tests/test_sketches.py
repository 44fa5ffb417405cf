"""Merged sketches against exact figures."""

from __future__ import annotations

import bisect
import datetime
import random

from pyspark.sql import functions as F

from rowtide.operators import sketches as sk


def test_rollup_of_hours_stays_within_its_error(spark):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(s, start + datetime.timedelta(seconds=rng.randrange(3 * 86_400)), rng.lognormvariate(0, 2) if rng.random() < 0.9 else 5.0, rng.randrange(3000)) for s in ("a", "b") for _ in range(20_000)]
    rows += [("c", start, None, 1)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double, id int")
    days = sk.latency_rollup(sk.hourly(df, ["series"], "ts", "v", "id"), ["series"])
    qs = [0.01, 0.5, 0.95, 0.99]
    got = days.select("series", "day", "rows", "n", "least", "most", sk.distinct_idents().alias("ids"), *[sk.quantile(q).alias(f"q{i}") for i, q in enumerate(qs)]).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.series and x[1].date() == r.day.date()]
        values = sorted(x[2] for x in mine if x[2] is not None)
        assert (r.rows, r.n) == (len(mine), len(values))
        assert abs(r.ids - len({x[3] for x in mine})) <= sk.COUNT_ERROR * len({x[3] for x in mine}) + 1
        if not values:
            assert r.q1 is None
            continue
        assert (r.least, r.most) == (values[0], values[-1])
        for i, q in enumerate(qs):
            low, high = bisect.bisect_left(values, r[f"q{i}"]), bisect.bisect_right(values, r[f"q{i}"])
            assert low / len(values) - 2 * sk.RANK_ERROR <= q <= high / len(values) + 2 * sk.RANK_ERROR
    assert len(got) == 7


def test_key_overlap(spark):
    a, b = spark.range(0, 60_000).toDF("k"), spark.range(15_000, 70_000).toDF("k")
    r = sk.key_overlap(sk.key_sketch(a, ["k"]), sk.key_sketch(b, ["k"])).first()
    for got, want in zip(r, (60_000, 55_000, 45_000, 15_000, 10_000)):
        assert abs(got - want) <= sk.THETA_ERROR * 70_000
    small = sk.key_overlap(sk.key_sketch(a.where("k < 900"), ["k"]), sk.key_sketch(a.where("k >= 300 and k < 1000"), ["k"])).first()
    assert tuple(small) == (900, 700, 600, 300, 100)
    none = sk.key_overlap(sk.key_sketch(a.where("false"), ["k"]), sk.key_sketch(a.where("k < 5"), ["k"])).first()
    assert tuple(none) == (0, 5, 0, 0, 5)
    twice = sk.key_sketch(a.where("k < 50").select(F.col("k"), F.lit(None).cast("int").alias("j")), ["k", "j"])
    assert sk.key_overlap(twice, twice).first().common == 50
