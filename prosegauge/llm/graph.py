"""Connected components of an edge table, and joins that no single key can crowd."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Parts that the rows of one key are dealt to.
SALTS = 64


#: Rows of a table that is looked up in memory; a larger one is joined.
SMALL_ROWS = 50_000


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with values, which has one row a key, by the column key.

    A key may hold any share of the rows: they meet their value in SALTS parts, by a hash of the
    column by, and the value goes once to each part that the key has.
    """
    dealt = rows.withColumn("_pg_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    sent = dealt.select(key, "_pg_salt").distinct().join(values, key)
    return dealt.join(sent, [key, "_pg_salt"], how).drop("_pg_salt")


def lookup(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined (left) with values, one row a key: in memory where few by count, else spread."""
    if values.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(values), key, "left")
    return spread_join(rows, values, key, by, "left")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = _both_ways(edges)
    least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(sym.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(down, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the least node.

    Alternates large-star and small-star steps until the edges no longer change, which they do after
    about the logarithm of the longest chain. Each step is an aggregation and a join on the node, the
    join spread, so a hub costs rows in proportion to its links and crowds no task. Each round is
    stored in the shared folder, which also cuts the lineage. No edges: no rows.
    """
    spark = edges.sparkSession
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(
            df.agg(
                F.count("*"),
                F.bit_xor(F.xxhash64("u", "v")),
                F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 31) - 1))),
            ).first()
        )

    before = state(now)
    while before[0]:
        after = stored(_small_star(_large_star(now)).distinct(), "edges")
        drop_stored(spark, now)
        now, new = after, state(after)
        if new == before:
            break
        before = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
