import random
from datetime import datetime, timedelta

import pytest

from airtrace.operators.ordered import neighbour
from airtrace.plans.requirements import concurrent_peak

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("back", [True, False])
@pytest.mark.parametrize("chunk_hours", [1, 24])
def test_neighbour_equals_a_sorted_list(spark, back, chunk_hours):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        key = "HOT" if rng.random() < 0.6 else f"k{rng.randrange(4)}"
        rows.append((i, key, T0 + timedelta(minutes=rng.randrange(9000)), rng.choice([None, "a", "b"])))
    df = spark.createDataFrame(rows, "id int, k string, at timestamp, v string")
    want = {}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for j, r in enumerate(mine):
            other = j - 1 if back else j + 1
            want[r[0]] = mine[other][3] if 0 <= other < len(mine) else None
    got = neighbour(df, "k", "at", "v", "n", back, ties=["id"], chunk_hours=chunk_hours)
    assert {r.id: r.n for r in got.collect()} == want


def test_concurrent_peak(spark):
    rng = random.Random(4)
    spans = [(T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + rng.randrange(0, 9000))) for s in (rng.randrange(0, 200000) for _ in range(300))]
    df = spark.createDataFrame(spans, "a timestamp, b timestamp")
    levels = {t: sum(a <= t <= b for a, b in spans) for t in {a for a, _ in spans}}
    peak = max(levels.values())
    first = min(t for t, n in levels.items() if n == peak)
    for hours in (1, 24):
        got = concurrent_peak(df, "a", "b", hours).first()
        assert (got.peak, got.peak_time) == (peak, first)
