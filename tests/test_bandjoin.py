import random
from datetime import datetime, timedelta

import pytest

from airtrace.operators.bandjoin import Band, band_join, range_join, sweep_join, swept

T0 = datetime(2024, 1, 1)


def frames(spark, seed, n=300, hot=False):
    rng = random.Random(seed)
    key = lambda: "K" if hot and rng.random() < 0.7 else f"k{rng.randrange(5)}"
    left = [(i, key(), rng.randrange(-50, 400), rng.randrange(0, 2000)) for i in range(n)]
    right = [(i, key(), rng.randrange(-50, 400), rng.randrange(0, 2000)) for i in range(n // 2)]
    return left, right, spark.createDataFrame(left, "id int, k string, f bigint, t bigint"), spark.createDataFrame(
        right, "rid int, rk string, rf bigint, rt bigint")


def brute(left, right):
    return sorted((a[0], b[0]) for a in left for b in right
                  if a[1] == b[1] and abs(a[2] - b[2]) <= 7 and abs(a[3] - b[3]) <= 100 and (a[0] + b[0]) % 3)


BANDS = [Band("f", "rf", 7), Band("t", "rt", 100)]


@pytest.mark.parametrize("pieces", [1, 2, 5, 40])
@pytest.mark.parametrize("hot", [False, True])
def test_inner_and_semi_match_brute_force(spark, pieces, hot):
    left, right, l, r = frames(spark, 7 + hot, hot=hot)
    want = brute(left, right)
    args = dict(on=[("k", "rk")], condition=lambda a, b: (a("id") + b("rid")) % 3 != 0, pieces=pieces)
    got = sorted((x.id, x.rid) for x in band_join(l, r, BANDS, **args).collect())
    assert got == want
    semi = sorted(x.id for x in band_join(l, r, BANDS, how="left_semi", **args).collect())
    assert semi == sorted({a for a, _ in want})


def test_edges_of_the_band_are_inside(spark):
    l = spark.createDataFrame([(1, 100), (2, 99), (3, -5)], "id int, f bigint")
    r = spark.createDataFrame([(105,), (0,)], "rf bigint")
    got = band_join(l, r, [Band("f", "rf", 5)])
    assert sorted((x.id, x.rf) for x in got.collect()) == [(1, 105), (3, 0)]


def test_plan_is_an_equi_join(spark):
    _, _, l, r = frames(spark, 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left_semi"):
            plan = band_join(l, r, BANDS, how=how)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hours", [1, 6])
def test_range_join(spark, hours):
    rng = random.Random(3)
    points = [(i, f"k{rng.randrange(3)}", T0 + timedelta(minutes=rng.randrange(6000))) for i in range(200)]
    ranges = []
    for i in range(60):
        start = T0 + timedelta(minutes=rng.randrange(6000))
        ranges.append((i, f"k{rng.randrange(3)}", start, start + timedelta(minutes=rng.randrange(-20, 1500))))
    p = spark.createDataFrame(points, "id int, k string, at timestamp")
    r = spark.createDataFrame(ranges, "rid int, rk string, a timestamp, b timestamp")
    want = sorted((x[0], y[0]) for x in points for y in ranges if x[1] == y[1] and y[2] <= x[2] <= y[3])
    got = range_join(p, r, "at", "a", "b", on=[("k", "rk")], hours=hours)
    assert sorted((x.id, x.rid) for x in got.collect()) == want
    semi = range_join(p, r, "at", "a", "b", on=[("k", "rk")], how="left_semi", hours=hours)
    assert sorted(x.id for x in semi.collect()) == sorted({a for a, _ in want})


def test_unknown_kind_is_refused(spark):
    _, _, l, r = frames(spark, 1, 4)
    with pytest.raises(ValueError):
        band_join(l, r, BANDS, how="left_anti")


def busy(spark, n):
    """Nine tenths of all points in one hour, a third of them in one instant."""
    at = lambda i: T0 + (timedelta(hours=5) if i % 3 == 0 else timedelta(hours=5, seconds=i % 3600) if i % 10 else timedelta(minutes=37 * i))
    return [(i, at(i)) for i in range(n)]


@pytest.mark.parametrize("rows", [7, 50_000])
def test_sweep_join(spark, rows):
    rng = random.Random(5)
    points = busy(spark, 400) + [(1000, None)]
    ranges = [(i, T0 + timedelta(minutes=a), T0 + timedelta(minutes=a + rng.randrange(-5, 900))) for i, a in ((i, rng.randrange(14_000)) for i in range(40))]
    ranges += [(90, T0 + timedelta(hours=5), T0 + timedelta(hours=5)), (91, T0 - timedelta(days=3), T0 + timedelta(days=90)), (92, None, T0), (91, T0 - timedelta(days=3), T0 + timedelta(days=90))]
    p = spark.createDataFrame(points, "id int, at timestamp")
    r = spark.createDataFrame(ranges, "rid int, a timestamp, b timestamp")
    want = sorted((x[0], y[0]) for x in points for y in ranges if x[1] and y[1] and y[1] <= x[1] <= y[2])
    got = sweep_join(p, r, "at", "a", "b", rows=rows)
    assert got.columns == ["id", "at", "rid", "a", "b"] and sorted((x.id, x.rid) for x in got.collect()) == want
    assert sweep_join(p.limit(0), r, "at", "a", "b").count() == 0 and sweep_join(p, r.limit(0), "at", "a", "b").count() == 0


def test_pieces_of_a_busy_hour_are_even(spark):
    p = spark.range(200_000).selectExpr(
        "id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 5, 0, case when id % 3 = 0 then 0 when id % 10 > 0 then id % 3600 else 97 * id end) as at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in swept(p, "at", 1000).groupBy("_piece").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2] and len(sizes) >= 200
