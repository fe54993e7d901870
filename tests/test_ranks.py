"""Values at ranks against sorted lists, and plans without lists or windows over a group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranks


def groups():
    draw = random.Random(2)
    held = {
        "even": [draw.random() for _ in range(3000)],
        "ties": [draw.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(2500)],
        "one value": [4.0] * 2000,
        "outlier": [draw.gauss(0, 1) for _ in range(1500)] + [1e300, -1e308, math.inf, -math.inf],
        "steep": [10.0 ** draw.uniform(-200, 200) for _ in range(1200)],
        "single": [3.0],
        None: [1.0, 5.0, 9.0],
    }
    rows = [(k, v) for k, values in held.items() for v in values] + [("even", None), ("even", math.nan), ("nothing", None)]
    draw.shuffle(rows)
    return held, rows


@pytest.mark.parametrize("bins, few", [(1024, 4096), (64, 8)])
def test_at_ranks(spark, monkeypatch, bins, few):
    monkeypatch.setattr(ranks, "BINS", bins)
    monkeypatch.setattr(ranks, "FEW", few)
    held, rows = groups()
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    wanted = {"first": F.lit(0), "middle": F.floor(F.col("n") / 2), "p95": ranks.lower_rank(0.95), "last": F.col("n") - 1}
    got = {r.k: r for r in ranks.at_ranks(frame, ["k"], "v", wanted, {"high": F.max("v")}).collect()}
    assert set(got) == set(held)
    for k, values in held.items():
        values, n = sorted(values), len(values)
        r = got[k]
        assert (r.n, r.high) == (n, values[-1])
        assert [r.first, r.middle, r.p95, r.last] == [values[0], values[n // 2], values[min(n - 1, int(n * 0.95))], values[-1]], k


def test_percentiles(spark):
    draw = random.Random(1)
    small, large = [draw.random() for _ in range(99)], [draw.random() for _ in range(1001)]
    frame = spark.createDataFrame([("s", v) for v in small] + [("l", v) for v in large], "k string, v double")
    got = {r.k: r for r in ranks.percentiles(frame, ["k"], "v", {"p10": 10, "p50": 50, "p99": 99}).collect()}
    small, large = sorted(small), sorted(large)
    assert [got["s"].p10, got["s"].p50, got["s"].p99] == [small[int(99 * p / 100)] for p in (10, 50, 99)]
    for name, p in (("p10", 10), ("p50", 50), ("p99", 99)):
        at = 1000 * p / 100
        low = int(at)
        assert got["l"][name] == pytest.approx(large[low] + (large[min(low + 1, 1000)] - large[low]) * (at - low), abs=1e-12)


def test_all_rows_as_one_group(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert tuple(ranks.at_ranks(frame, [], "v", {"mid": F.lit(4)}).first()) == (10, 4.0)
    assert ranks.at_ranks(frame.filter("v < 0"), [], "v", {"mid": F.lit(4)}).count() == 0


def test_no_list_and_no_window_over_a_group(spark, monkeypatch):
    """Whatever is written on the way, too."""
    plans = []
    keep = ranks.written
    monkeypatch.setattr(ranks, "written", lambda rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), keep(rows))[1])
    _, rows = groups()
    out = ranks.at_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"mid": F.floor(F.col("n") / 2)})
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "collect_list" not in plan and "percentile" not in plan
        assert "Window" not in plan or "HashAggregate" in plan.split("Window", 1)[1]


def test_sketches_are_made_for_flags_not_parts(spark, tmp_path):
    from tessera.plans import relational_pack

    rows = [(f, p, float(q)) for f in "AN" for p in range(40) for q in range(1, 6)] + [("R", None, 1.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = relational_pack.approximate(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("A", 40, True, True), ("N", 40, True, True), ("R", 0, True, True)]
    made = [line.split("keys=[")[1].split("]")[0] for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "percentile_approx(" in line and "keys=[" in line]
    assert made and all("l_partkey" not in keys for keys in made)
