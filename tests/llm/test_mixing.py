import random

import pytest
from pyspark.sql import functions as F

from prosegauge.llm import mixing


def brute_targets(sizes, weights, share, cap):
    """The rule as stated: stop at the cap and share the excess anew, until none is above."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(w[n] for n in open_)
        over = [n for n in open_ if left * w[n] / total > cap * sizes[n]]
        if not over:
            return out | {n: left * w[n] / total for n in open_}
        for n in over:
            out[n] = cap * sizes[n]
            open_.remove(n)
        left = max(0.0, share * sum(sizes.values()) - sum(out.values()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takings(spark, seed):
    rng = random.Random(seed)
    names = [None, "b", "a", "é", "zz", "B"]
    rows = [(i if i % 17 else None, None if i % 13 == 0 else "w " * rng.choice([0, 1, 5, 90, 400]), rng.choices(names, [1, 30, 3, 4, 2, 1])[0], i) for i in range(300)]
    rows += rows[:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source])
        assert 0 <= r.mix_taken <= 2 * r.mix_size and sum(d.words for d in r.mix_delivered) == r.mix_taken
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    at = [r.mix_position for r in got if r.mix_position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.mix_taken == 0 for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect())


@pytest.mark.parametrize("schedule", [(1.0, 1.0), (0.5, 1.5), (1.5, 0.5), (0.0, 1.0, 0.0), (2.0, 0.0, 1.0)])
def test_positions_invert_the_integral(spark, schedule):
    points = spark.range(1001).select((F.col("id") / 1000).alias("u"))
    got = points.select("u", mixing.position(F.col("u"), schedule).alias("t")).orderBy("u").collect()

    def integral(t, n=2000):
        pieces = len(schedule) - 1
        def w(x):
            k = min(int(x * pieces), pieces - 1)
            return schedule[k] + (schedule[k + 1] - schedule[k]) * (x * pieces - k)
        return sum((w(t * i / n) + w(t * (i + 1) / n)) / 2 for i in range(n)) * t / n

    whole = integral(1.0)
    for r in got[::50]:
        assert integral(r.t) / whole == pytest.approx(r.u, abs=2e-3)
    assert [r.t for r in got] == sorted(r.t for r in got)


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
