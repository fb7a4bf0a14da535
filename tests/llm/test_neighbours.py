import math
from pathlib import Path

import numpy as np
import pytest

from prosegauge.llm import neighbours


def brute(rows, k, modulus):
    """rows: id -> vector (valid). (query, rank, id, distance)."""
    out = []
    for q, v in rows.items():
        if q % modulus:
            continue
        near = sorted((math.dist(v, w), i) for i, w in rows.items() if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return out


def test_clusters_copies_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    vectors = {i: (centres[i % 20] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(600)}
    for i in range(600, 760):
        vectors[i] = vectors[0]
    rows = [(i, v, "x") for i, v in vectors.items()]
    bad = [(1000, None, "x"), (1010, [0.0] * 16, "x"), (1020, [float("nan")] * 16, "x"), (1030, [None] * 16, "x"), (None, vectors[1], "x"), (1040, [], "x"), (1050, [float("inf")] + [1.0] * 15, "x")]
    frame = spark.createDataFrame([*rows, *bad, *rows[:30]], "vec_id long, embedding array<float>, rank string")
    got = neighbours.nearest_neighbours(frame, query_modulus=10).collect()
    want = brute(vectors, 10, 10)
    assert len(got) == len(want)
    pairs = {(r.query_id, r.vec_id) for r in got}
    assert len(pairs & {(q, i) for q, _, i, _ in want}) >= 0.97 * len(want)
    exact = {(q, i): math.dist(vectors[q], vectors[i]) for q, i in pairs}
    for r in got:
        assert r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12)
    hot = [(r.rank, r.vec_id) for r in got if r.query_id == 0]
    assert sorted(hot) == list(zip(range(1, 11), range(600, 610)))


def test_few_rows_have_all_candidates(spark):
    vectors = {0: [1.0, 0.0], 100: [0.0, 1.0], 7: [1.0, 1.0], 8: [3.0, 4.0, 5.0]}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest_neighbours(frame).collect())
    assert got == sorted(brute(vectors, 10, 100))
    assert neighbours.nearest_neighbours(frame.limit(0)).count() == 0


def test_probes_come_by_chance_and_reach_enough():
    x = np.array([0.1, 0.5, 0.9])
    seen = list(neighbours.probes(x, 1.5, 1.0, 0.9))
    assert seen[0] == (0, 0, 0) and len(set(seen)) == len(seen)

    def chance(shift):
        p = 1.0
        for s, a in zip(shift, x):
            z = [(s + e - a) * 1.5 / math.sqrt(2) for e in (0, 1)]
            p *= (math.erf(z[1]) - math.erf(z[0])) / 2
        return p

    found = [chance(s) for s in seen]
    assert found == sorted(found, reverse=True) or np.allclose(found, sorted(found, reverse=True))
    assert 0.9 <= sum(found) <= 1.0 and sum(found[:-1]) < 0.9


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 40)
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=4).tolist() for i in range(300)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(frame, query_modulus=50).collect()}
    want = {(q, i) for q, _, i, _ in brute(vectors, 10, 50)}
    assert len(got & want) >= 0.9 * len(want)


def test_queries_in_sparse_parts_keep_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 300)  # several groups, so that queries find more than k rows
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 8))
    vectors = {2 * i + 1: (centres[i % 60] + 0.25 * rng.normal(size=8)).tolist() for i in range(2400)}
    vectors |= {2 * i: rng.normal(size=8).tolist() for i in range(1200)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(frame, query_modulus=20).collect()}
    want = {(q, i) for q, _, i, _ in brute(vectors, 10, 20)}
    assert len(got & want) >= 0.97 * len(want)


def test_further_probes_reach_the_chance_at_the_found_distance():
    x = np.array([0.1, 0.5])
    first = list(neighbours.probes(x, 1.5, 1.0, 0.8))
    more = neighbours.further_probes(x, 1.5, 1.0, 2.0, 0.8, 100)
    chance = neighbours.chances(x, 1.5, 2.0)
    total = [math.prod(chance[j, s + neighbours.REACH] for j, s in enumerate(shift)) for shift in first + more]
    assert more and not set(more) & set(first) and sum(total) >= 0.8 > sum(total[:-1])
    assert neighbours.further_probes(x, 1.5, 1.0, 1.0, 0.8, 0) == []
    assert neighbours.further_probes(x, 1.5, 1.0, 2.0, 0.8, len(more) - 1) is None
    assert neighbours.further_probes(x, 1.5, 1.0, 50.0, 0.8, 100) is None


def test_hits_of_both_tables_count_once(spark):
    rows = [(0, cell, [i], [float(i)]) for cell in (1, 2) for i in range(1, 31)]
    index = spark.createDataFrame(rows, "grp long, cell long, ids array<long>, vec array<double>")
    visits = spark.createDataFrame([(0, cell, 0) for cell in (1, 2)], "grp long, cell long, query long")
    queries = spark.createDataFrame([(0, [0.0])], "query long, vec array<double>")
    got = sorted((r.distance, r.id) for r in neighbours.search_groups(index, visits, queries, 10).collect())
    assert got == [(float(i), i) for i in range(1, 12)]


def test_many_visits_to_a_group_are_split(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(50, 3))
    tests = rng.normal(size=(40, 3))
    index = spark.createDataFrame([(0, 7, [1000 + i], v.tolist()) for i, v in enumerate(points)], "grp long, cell long, ids array<long>, vec array<double>")
    visits = spark.createDataFrame([(0, 7, q) for q in range(40)], "grp long, cell long, query long")
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(tests)], "query long, vec array<double>")
    want = {(q, 1000 + int(i)) for q, v in enumerate(tests) for i in np.argsort(((points - v) ** 2).sum(1))[:4]}
    for rows in (10_000, 9):
        monkeypatch.setattr(neighbours, "VISIT_ROWS", rows)
        got = neighbours.search_groups(index, visits, queries, 3).collect()
        assert {(r.query, r.id) for r in got} == want and len(got) == len(want)


def test_functions_follow_the_cost():
    rng = np.random.default_rng(2)
    near_uniform = [v / np.linalg.norm(v) for v in rng.normal(size=(32, 64))]
    assert neighbours.chosen_functions(near_uniform, 1.1, 10**6, 0.8) <= 5
    apart = [10 * v for v in rng.normal(size=(32, 16))]  # neighbours near, all others far
    few, many = (neighbours.chosen_functions(apart, 1.0, n, 0.8) for n in (10**4, 10**7))
    assert few <= many
    assert neighbours.chosen_functions(near_uniform, 1.1, 10**4, 0.8) < neighbours.chosen_functions(near_uniform, 1.1, 10**7, 0.8)
    assert neighbours.chosen_functions([], 1.0, 0, 0.8) == 2


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_recall_of_the_index_on_embeddings(spark, monkeypatch, folder):
    """Recall against brute force, without what the exact search adds."""
    path = Path(f"/root/testdata/{folder}/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test data")
    table = spark.read.parquet(str(path))
    ids, vectors = zip(*((r.vec_id, r.embedding) for r in table.collect()), strict=True)
    m, ids = np.array(vectors, dtype=np.float64), np.array(ids)
    monkeypatch.setattr(neighbours, "further_probes", lambda *a: [])
    found = {}
    for r in neighbours.nearest_neighbours(table).collect():
        found.setdefault(r.query_id, []).append(r.score)
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sort(np.sqrt(((np.delete(m, k, axis=0) - m[k]) ** 2).sum(axis=1)))[:10]
        hits += sum(x <= d[-1] + 1e-9 for x in found.get(ids[k], []))
        total += len(d)
    assert hits >= 0.9 * total
