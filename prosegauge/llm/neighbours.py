"""Nearest neighbours by multiprobe p-stable hashing.

Each table cuts ``functions`` Gaussian projections of a vector into steps and hashes the steps to a
bucket. A query visits, besides its own bucket, perturbed ones in the order of their estimated
success: the displacement of a neighbour at the typical distance r along a projection is normal,
which gives the chance of each step of each function, and of a bucket by their product. A query
stops in a table when the visited chances reach its share of the recall asked for, so the number
of probes follows the data and nothing is capped. Candidates of all tables are merged and ranked
by exact distance.

Equal vectors are indexed once, with their smallest ids. Buckets are dealt to groups of bounded
expected size, crowded ones in several parts that each probe visits; a group that many queries visit
is held by several tasks, each with a part of the queries. r is the median distance to the k-th
neighbour of a bounded set of vectors, measured against all. The same vectors choose the number of
functions: that with the least cost of probes and of rows met.

r only starts the search. A query whose k-th found row lies farther than r goes on to probe until the
recall asked for is reached at that distance, which no true neighbour exceeds; where that takes more
probes than an exact search is worth, it is searched exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .graph import lookup

TABLES = 2
#: Vectors that measure the typical distance.
PROBE_VECTORS = 32
#: Indexed rows of a group, and visits to it, that one task holds at a time.
GROUP_ROWS = 4_000
VISIT_ROWS = 16_000
#: Of the vectors that measure r, those that choose the number of functions, and its bounds.
COST_VECTORS = 4
FUNCTIONS = range(2, 17)
#: Steps to either side that a function may be perturbed by.
REACH = 4
#: Distances that cost about as much as one more probe.
PROBE_ROWS = 1000


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: one a vector of finite numbers, not all zero.

    Rows with a null id or vector, an empty one, or null or non-finite components take no part; of
    rows with equal ids the least vector counts.
    """
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where((F.size("vec") > 0) & good)
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(ids, vec): the k + 1 smallest ids of each different vector; more can never be needed."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as doubles, a row per list."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the lists in a column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, matrix(column.take(pa.array(rows)))


def nearest(queries: np.ndarray, points: np.ndarray, k: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, the numbers and exact distances of its k nearest points and of those tied."""
    norms = (points * points).sum(axis=1)
    for a in range(0, len(queries), block):
        part = queries[a : a + block]
        rough = np.maximum(norms[None] + (part * part).sum(axis=1)[:, None] - 2 * part @ points.T, 0)
        for q, r in zip(part, rough, strict=True):
            if len(r) > k:  # rounding of the rough distances is far below this slack
                limit = np.partition(r, k - 1)[k - 1]
                rows = np.flatnonzero(r <= limit + 1e-7 * (1 + limit + q @ q))
            else:
                rows = np.arange(len(r))
            yield rows, np.sqrt(((points[rows] - q) ** 2).sum(axis=1))


def projections(length: int, table: int, functions: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([length, table, functions, 77])
    return rng.normal(size=(length, functions)), rng.uniform(0, step, functions)


def bucket(length: int, table: int, steps: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.array([length, table, *steps], dtype="<i8").tobytes()) - (1 << 63)


def chances(x: np.ndarray, step: float, r: float) -> np.ndarray:
    """function x shift (from -REACH): the chance of each step for a neighbour at distance r."""
    edges = (np.arange(-REACH, REACH + 2)[None] - x[:, None]) * step / max(r, 1e-12) / math.sqrt(2)
    below = np.array([[math.erf(e) for e in row] for row in edges])
    return np.maximum(np.diff(below, axis=1) / 2, 1e-300)


def probes(x: np.ndarray, step: float, r: float, enough: float) -> Iterator[tuple[int, ...]]:
    """Perturbations of the steps of a query in the order of their chance, until these sum to enough.

    x: where the query stands in its step of each function, from 0 to 1.
    """
    shifts = np.arange(-REACH, REACH + 1)
    chance = chances(x, step, r)
    order = np.argsort(-chance, axis=1, kind="stable")
    sorted_ = np.log(np.take_along_axis(chance, order, axis=1))
    start = (0,) * len(x)
    heap, seen, reached = [(-float(sorted_[:, 0].sum()), start)], {start}, 0.0
    while heap and reached < enough:
        cost, state = heapq.heappop(heap)
        reached += math.exp(-cost)
        yield tuple(int(shifts[order[j, s]]) for j, s in enumerate(state))
        for j, s in enumerate(state):
            if s + 1 < len(shifts):
                after = (*state[:j], s + 1, *state[j + 1 :])
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (cost + float(sorted_[j, s] - sorted_[j, s + 1]), after))


def further_probes(x: np.ndarray, step: float, r: float, far: float, enough: float, most: int) -> list[tuple[int, ...]] | None:
    """Perturbations beyond those of probes() at r until the chances at distance far sum to enough.

    None where that takes over ``most`` of them or lies out of REACH.
    """
    visited = set(probes(x, step, r, enough))
    chance = chances(x, step, far)
    of = lambda shift: math.prod(float(chance[j, s + REACH]) for j, s in enumerate(shift))
    reached, more = sum(map(of, visited)), []
    if reached >= enough:
        return more
    for shift in probes(x, step, far, math.inf):
        if shift in visited:
            continue
        if len(more) == most:
            return None
        more.append(shift)
        reached += of(shift)
        if reached >= enough:
            return more
    return None


def chosen_functions(tests: list[np.ndarray], r: float, n: int, enough: float) -> int:
    """The number of functions that costs least over some test vectors.

    A probe costs PROBE_ROWS distances; the rows met are those of n that a vector at the median
    distance of the tests has the chance to share a visited bucket with. The cost falls with the
    number at first, for buckets hold less, and then rises, for more of them must be visited.
    """
    step = 1.5 * r
    apart = [float(np.linalg.norm(a - b)) for k, a in enumerate(tests) for b in tests[:k] if len(a) == len(b)]
    far = max(r, float(np.median(apart)) if apart else r)
    most = max(1, n // PROBE_ROWS)
    best, least = FUNCTIONS[0], math.inf
    for functions in FUNCTIONS:
        cost = 0.0
        for v in tests[:COST_VECTORS]:
            a, b = projections(len(v), 0, functions, step)
            at = (v @ a + b) / step
            chance = chances(at - np.floor(at), step, far)
            count = share = 0.0
            for shift in probes(at - np.floor(at), step, r, enough):
                count += 1
                share += math.prod(float(chance[j, x + REACH]) for j, x in enumerate(shift))
                if count > most or cost + count * PROBE_ROWS > least:
                    return best  # more functions take more probes still
            cost += count * PROBE_ROWS + n * min(1.0, share)
        if cost >= least:
            return best
        best, least = functions, cost
    return best


def typical_distance(points: DataFrame, k: int) -> tuple[float, list[np.ndarray]]:
    """Median distance of PROBE_VECTORS vectors to their k-th neighbour among all, and the vectors."""
    some = points.orderBy(F.xxhash64("vec"), "vec").limit(PROBE_VECTORS).collect()
    tests = [np.array(r.vec, dtype=np.float64) for r in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[np.ndarray] = [np.zeros(0)] * len(tests)
        for batch in batches:
            for _, m in by_length(batch.column("vec")):
                for n, t in enumerate(tests):
                    if m.shape[1] == len(t):
                        d = np.sqrt(((m - t) ** 2).sum(axis=1))
                        best[n] = np.sort(np.concatenate([best[n], d[d > 0]]))[:k]
        rows = [(n, float(x)) for n, d in enumerate(best) for x in d]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows])], ["n", "d"])

    near = points.select("vec").mapInArrow(run, "n long, d double")
    rank = F.row_number().over(Window.partitionBy("n").orderBy("d"))
    found = near.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("n").agg(F.max("d").alias("d"))
    got = found.agg(F.median("d")).first()[0]
    return (float(got) if got else 1.0), tests


def search_groups(index: DataFrame, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, distance): the nearest of each query in each group.

    index: grp, cell, ids, vec; visits: grp, cell, query; queries: query, vec. A query meets the rows
    of its cells. A group with many visits goes to several tasks, each with a part of the queries.
    """
    split = stored(visits.groupBy("grp").count().where(F.col("count") > VISIT_ROWS).select("grp", F.ceil(F.col("count") / VISIT_ROWS).alias("tasks")), "split")
    tasks = F.coalesce("tasks", F.lit(1)).cast("long")
    index = lookup(index, split, "grp", "ids").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"), "cell", "ids", "vec")
    visits = lookup(visits, split, "grp", "query").withColumn("task", F.pmod(F.xxhash64("query"), tasks))
    asked = visits.join(queries, "query").select("grp", "task", "cell", "query", "vec")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        best: dict[int, list[tuple[np.ndarray, list]]] = {}
        if rows.num_rows and asked.num_rows:
            cells, of = rows.column("cell").to_numpy(), asked.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")
            cuts = np.searchsorted(cells[order], np.unique(of)), np.searchsorted(cells[order], np.unique(of), side="right")
            queries = asked.column("query").to_numpy()
            vectors, wanted, ids = rows.column("vec").combine_chunks(), asked.column("vec").combine_chunks(), rows.column("ids")
            for cell, a, b in zip(np.unique(of), *cuts, strict=True):
                if a == b:
                    continue
                mine, theirs = order[a:b], np.flatnonzero(of == cell)
                points, tests = matrix(vectors.take(pa.array(mine))), matrix(wanted.take(pa.array(theirs)))
                for q, (near, far) in zip(queries[theirs].tolist(), nearest(tests, points, k + 1), strict=True):
                    best.setdefault(q, []).append((far, mine[near]))
        out: list[tuple[int, int, float]] = []
        for q, parts in best.items():
            far, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            pairs: list[tuple[float, int]] = []
            met: set[int] = set()  # rows of one vector, which both tables may have met, count once
            for j in np.argsort(far, kind="stable").tolist():
                if len(pairs) > k and far[j] > pairs[k][0]:
                    break
                fresh = [i for i in ids[int(at[j])].as_py() if i != q and i not in met]
                met.update(fresh)
                pairs += [(float(far[j]), i) for i in fresh]
                pairs.sort()
            out += [(q, i, d) for d, i in pairs[: k + 1]]
        return pa.table({"query": pa.array([o[0] for o in out], pa.int64()), "id": pa.array([o[1] for o in out], pa.int64()), "distance": pa.array([o[2] for o in out], pa.float64())})

    return index.groupBy("grp", "task").cogroup(asked.groupBy("grp", "task")).applyInArrow(run, "query long, id long, distance double")


def nearest_neighbours(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_modulus: int = 100,
    k: int = 10,
    recall: float = 0.96,
    tables: int = TABLES,
) -> DataFrame:
    """query_id, rank (from 1), id_col and score (Euclidean distance): the k nearest found.

    Queries are the rows whose id is divisible by query_modulus; candidates are all other rows.
    Vectors of different lengths are never compared. Ties go to the smaller id. A query whose k-th
    found row is too far for the buckets visited probes further. One that finds fewer than k rows,
    or would have to probe too much, is searched exactly; so it has all candidates if there are fewer.
    See valid_vectors() for rows that take no part; without any there are no rows.
    """
    rows = stored(valid_vectors(vectors, id_col, vec_col), "vectors")
    points = stored(distinct_vectors(rows, k), "points")
    n = points.count()
    r, tests = typical_distance(points, k) if n else (1.0, [])
    step = 1.5 * r
    enough = 1 - (1 - recall) ** (1 / tables)
    functions = chosen_functions(tests, r, n, enough)
    queries = rows.where(F.col("id") % query_modulus == 0).select(F.col("id").alias("query"), "vec")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, m in by_length(batch.column("vec")):
                part = batch.take(pa.array(rows_))
                for t in range(tables):
                    a, b = projections(m.shape[1], t, functions, step)
                    steps = np.floor((m @ a + b) / step).astype(np.int64)
                    cells = pa.array([bucket(m.shape[1], t, s) for s in steps], pa.int64())
                    yield pa.RecordBatch.from_arrays([cells, part.column("ids"), part.column("vec")], ["cell", "ids", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, m in by_length(batch.column("vec")):
                part = batch.take(pa.array(rows_))
                for t in range(tables):
                    a, b = projections(m.shape[1], t, functions, step)
                    at = (m @ a + b) / step
                    own = np.floor(at).astype(np.int64)
                    cells, source = [], []
                    for j in range(len(m)):
                        for shift in probes(at[j] - own[j], step, r, enough):
                            cells.append(bucket(m.shape[1], t, own[j] + np.array(shift)))
                            source.append(j)
                        if len(cells) > 20_000 or j == len(m) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), part.column("query").take(pa.array(source, pa.int64()))], ["cell", "query"])
                            cells, source = [], []

    kind = points.schema["vec"].dataType.simpleString()
    entries = points.select("ids", "vec").mapInArrow(enter, f"cell long, ids array<bigint>, vec {kind}")
    visits = stored(queries.mapInArrow(visit, "cell long, query long"), "visits")
    groups = max(1, math.ceil(n * tables / GROUP_ROWS))
    crowded = entries.groupBy("cell").count().where(F.col("count") > GROUP_ROWS)
    crowded = stored(crowded.select("cell", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("parts")), "crowded")
    parts = F.coalesce("parts", F.lit(1))
    index = (
        lookup(entries, crowded, "cell", "ids")
        .withColumn("part", F.pmod(F.xxhash64("ids"), parts).cast("int"))
        .select(F.pmod(F.xxhash64("cell", "part"), F.lit(groups)).alias("grp"), "cell", "ids", "vec")
    )

    def asked(visits: DataFrame) -> DataFrame:
        every = lookup(visits, crowded, "cell", "query").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        return every.select(F.pmod(F.xxhash64("cell", "part"), F.lit(groups)).alias("grp"), "cell", "query")

    found = stored(search_groups(index, asked(visits), queries, k), "found").distinct()
    best = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    far = found.withColumn("rank", best).where(F.col("rank") == k).select("query", F.col("distance").alias("far"))
    most = n // PROBE_ROWS

    def visit_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Further visits of each query; one with a null cell where it is to be searched exactly."""
        for batch in batches:
            for rows_, m in by_length(batch.column("vec")):
                part = batch.take(pa.array(rows_))
                limits = part.column("far").to_pylist()
                at = [(m @ a + b) / step for a, b in (projections(m.shape[1], t, functions, step) for t in range(tables))]
                cells, source = [], []
                for j in range(len(m)):
                    own = [np.floor(x[j]).astype(np.int64) for x in at]
                    more = [None if limits[j] is None else further_probes(x[j] - o, step, r, limits[j], enough, most) for x, o in zip(at, own, strict=True)]
                    mine = [None] if None in more else [bucket(m.shape[1], t, own[t] + np.array(shift)) for t in range(tables) for shift in more[t]]
                    cells += mine
                    source += [j] * len(mine)
                    if len(cells) > 20_000 or j == len(m) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), part.column("query").take(pa.array(source, pa.int64()))], ["cell", "query"])
                        cells, source = [], []

    behind = queries.join(far, "query", "left").where(F.col("far").isNull() | (F.col("far") > r))
    further = stored(behind.select("query", "vec", "far").mapInArrow(visit_further, "cell long, query long"), "further")
    results = found
    if further.where(F.col("cell").isNotNull()).limit(1).count():
        results = results.unionByName(search_groups(index, asked(further.where(F.col("cell").isNotNull())), queries, k))
    if further.where(F.col("cell").isNull()).limit(1).count():
        short = further.where(F.col("cell").isNull()).select("query").join(queries, "query")
        exact_groups = max(1, math.ceil(n / GROUP_ROWS))
        length = F.size("vec").cast("long").alias("cell")
        all_points = points.select(F.pmod(F.xxhash64("vec"), F.lit(exact_groups)).alias("grp"), length, "ids", "vec")
        all_short = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(exact_groups - 1).cast("long"))).alias("grp"), length, "query")
        results = results.unionByName(search_groups(all_points, all_short, queries, k))
    ranked = results.distinct().withColumn("rank", best).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), F.col("distance").alias("score"))
