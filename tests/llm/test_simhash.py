import random

import numpy as np
import pytest
import xxhash

from prosegauge.llm import simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    part = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [a if x == b else x for x in part]
    return part


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " \n".join(rng.choice(["Alpha", "béta", "GAMMA", "d", "e\xa0f"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_print(text)


def clustered(rng, n):
    fps = []
    while len(fps) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            fps.append(x)
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
    return fps[:n]


@pytest.mark.parametrize("bits", [0, 3, 4])
def test_spanning_links_lose_no_component(bits):
    fps = sorted(set(clustered(random.Random(bits), 400)))
    u, v, *_ = simhash.spanning_links(np.zeros(len(fps), int), np.array(fps, dtype=np.uint64), bits)
    index = {x: i for i, x in enumerate(fps)}
    part = list(range(len(fps)))
    for a, b in zip(u.tolist(), v.tolist()):
        x, y = part[index[a]], part[index[b]]
        part = [x if p == y else p for p in part]
    want = brute_components(fps, bits)
    assert len(set(part)) == len(set(want))
    assert len({(a, b) for a, b in zip(part, want)}) == len(set(want))


def test_pairs_are_discarded_by_the_largest_coordinate_difference():
    rng = random.Random(4)
    fps = sorted({rng.getrandbits(64) for _ in range(150)})  # no links, so every pair is met
    refs = simhash.REFS.tolist()
    far = lambda x, y: max(abs((x ^ p).bit_count() - (y ^ p).bit_count()) for p in refs)
    kept = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if far(x, y) <= 20]
    half = np.arange(150) // 75
    u, _, met, verified = simhash.spanning_links(np.zeros(150, int), np.array(fps, dtype=np.uint64), 20)
    assert met <= 150 * 149 // 2 and verified <= len(kept) and len(u) < 150
    u, _, met, verified = simhash.spanning_links(np.zeros(150, int), np.array(fps, dtype=np.uint64), 4)
    assert (met, verified, len(u)) == (150 * 149 // 2, sum(far(x, y) <= 4 for i, x in enumerate(fps) for y in fps[:i]), 0)
    assert simhash.spanning_links(half, np.array(fps, dtype=np.uint64), 4)[2] == 2 * (75 * 74 // 2)


def test_figures_of_pairs(spark):
    fps = sorted(set(clustered(random.Random(2), 200)))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    met, discarded, verified = simhash.pair_figures(frame, 4)
    assert met == discarded + verified and discarded > 0 and verified >= simhash.links(frame, 4).count()


@pytest.mark.parametrize("n", [1, 10**5, 10**8, 10**11, 10**14])
@pytest.mark.parametrize("bits", [1, 4, 12])
def test_cells_stay_small_and_lose_no_pair(spark, n, bits):
    t = simhash.untouched_blocks(n, bits)
    assert t == 6 or n / 2 ** (64 * t // (bits + t)) <= simhash.CELL_MEMBERS
    if bits == 4 and t < 4:
        rng = random.Random(n)
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        signed = [(v - (1 << 64) if v >> 63 else v,) for v in (x, y)]
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(signed, "fp long").select(F.explode(F.array(*simhash.cells(4, t))).alias("c"))
        assert rows.groupBy("c").count().where("count = 2").count() >= 1


@pytest.mark.parametrize("cell_rows", [20_000, 5])
def test_links_in_spark_equal_brute_force(spark, cell_rows):
    fps = sorted(set(clustered(random.Random(9), 300)))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = simhash.links(frame, 4, cell_rows=cell_rows).collect()
    index = {x: i for i, x in enumerate(fps)}
    part = list(range(len(fps)))
    for r in got:
        x, y = part[index[r.u % (1 << 64)]], part[index[r.v % (1 << 64)]]
        part = [x if p == y else p for p in part]
    assert len({(a, b) for a, b in zip(part, brute_components(fps, 4))}) == len(set(part)) == len(set(brute_components(fps, 4)))


def test_query_rows_and_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, "x"), (3, base + " tail", "x"), (9, None, None), (7, "", "x"), (None, "lone words here now", "x"), (5, base, "x"), (11, "other text entirely made of different words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fps = [brute_print(t) for _, t, _ in rows]
    part = brute_components(fps, 4)
    want = []
    for (i, _, _), f, p in zip(rows, fps, part):
        ids = [r[0] for r, q in zip(rows, part) if q == p and r[0] is not None]
        want.append((i, f, min(ids, default=None)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
