"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

A source's target is its share of the word budget, stopped at ``max_repeat`` times its size, the
excess shared anew by weight. A source delivers its documents in a pseudo-random order that
depends on the id alone, again from the start once it is used up, until the target is met; the
last document is cut where the target ends. Each source's weight changes over training time
(0 to 1) along a piecewise linear schedule. Its integral, a piecewise quadratic, is the
cumulative demand for the source's words; inverting it at the words already delivered gives each
delivery its training position, and documents are range-sorted by position.

Running totals never gather a source in one task: the order starts with a bucket of the id's
hash, totals are pre-aggregated by source and bucket, and only the rows of one bucket of one
source are summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, stored

#: Weight at the start, the middle and the end of training; sources take these in turn.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
SMALL_ROWS = 50_000


def _lookup(df: DataFrame) -> DataFrame:
    """df, to be broadcast only if it is small by count; else a shuffled join takes it."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """sources (source, source_size) with number (from 0, by code point, null last) and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.select(
        "source",
        "source_size",
        (F.row_number().over(by_name) - 1).alias("number"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).alias("budget"),
    )
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    # Sources fill up in the order of cap / weight; the level is that at which the first one does not.
    fills = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fills.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = capped.withColumn("level", (F.col("budget") - before) / rest).withColumn(
        "order", F.row_number().over(fills)
    )
    open_ = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("order"))).over(Window.partitionBy())
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return levelled.select("source", "source_size", "number", target.alias("target"))


def position(demand: Column, schedule: tuple[float, ...]) -> Column:
    """The training time at which a share ``demand`` (0 to 1) of a source's words is used.

    schedule: weights at equally spaced times, linear in between, at least 0 and not all 0.
    """
    pieces = len(schedule) - 1
    step = 1.0 / pieces
    areas = [(a + b) * 0.5 * step for a, b in zip(schedule[:-1], schedule[1:], strict=True)]
    whole = sum(areas)
    out, reached = F.lit(1.0), 1.0
    for k in reversed(range(pieces)):
        a, slope = schedule[k], (schedule[k + 1] - schedule[k]) / step
        reached = sum(areas[:k]) / whole
        left = (demand - F.lit(reached)) * F.lit(whole)
        if slope == 0:
            at = left / F.lit(a) if a else F.lit(0.0)
        else:  # a x + slope x^2 / 2 = left
            at = (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * left, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        here = F.lit(k * step) + F.least(F.greatest(at, F.lit(0.0)), F.lit(step))
        out = here if k == pieces - 1 else F.when(demand < F.lit(sum(areas[: k + 1]) / whole), here).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    hex_digits: int = 3,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken, mix_delivered and mix_position.

    mix_size counts words (null text: 0); mix_taken is the words the mix takes, repeats counted;
    mix_delivered holds (words, position) of each delivery, mix_position the first one's position,
    or null where nothing is taken. Rows come range-sorted by position, those not taken last.
    A null source is a source of its own, in the last place. Documents with equal ids are ordered
    by size, then by a hash of the row. Null ids count as the empty string in the order. Columns
    of docs with the names above are replaced. Without words every target is 0. No rows: no rows.
    """
    made = ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_delivered", "mix_position"]
    docs = docs.drop(*made)
    # Plain columns, so that those nobody reads are pruned before any shuffle; a key without null,
    # so that the joins take the partitioning of the window.
    keys = docs.withColumns({
        "_pg_source": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")),
        "_pg_hash": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
        "mix_size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long"),
        "_pg_tie": F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant")),
    }).withColumn("_pg_bucket", F.substring("_pg_hash", 1, hex_digits))

    sums = stored(
        keys.groupBy(F.col("_pg_source").alias("source"), F.col("_pg_bucket").alias("bucket")).agg(
            F.sum("mix_size").alias("words")
        ),
        "mix-sums",
    )
    by_source = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    named = by_source.withColumn("source", F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)))
    goals = targets(named, weights, share, max_repeat).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_pg_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("number").alias("_pg_number"),
        F.col("target").alias("mix_target"),
    )
    goals = _lookup(stored(goals, "mix-targets"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_pg_source"),
        F.col("bucket").alias("_pg_bucket"),
        F.coalesce(F.sum("words").over(along), F.lit(0)).alias("_pg_start"),
    )

    same = Window.partitionBy("_pg_source", "_pg_bucket").orderBy("_pg_hash", id_col, "mix_size", "_pg_tie")
    inner = F.coalesce(F.sum("mix_size").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        keys.withColumn("_pg_inner", inner)
        .join(starts, ["_pg_source", "_pg_bucket"])
        .join(goals, "_pg_source")
        .withColumn("_pg_before", F.col("_pg_inner") + F.col("_pg_start"))
    )

    words = F.round("mix_target").cast("long")
    passes = F.when(F.col("mix_source_size") > 0, F.floor(words / F.col("mix_source_size"))).otherwise(0).cast("long")
    rest = words - passes * F.col("mix_source_size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("mix_size"), rest - F.col("_pg_before")))
    taken = passes * F.col("mix_size") + extra

    def at(number: Column, amount: Column) -> Column:
        """Position of the middle of a delivery in pass number."""
        share_ = (number * F.col("mix_source_size") + F.col("_pg_before") + amount / F.lit(2.0)) / F.nullif(words, F.lit(0))
        out = position(share_, schedules[-1])
        for k in range(len(schedules) - 1):
            out = F.when(F.col("_pg_number") % len(schedules) == k, position(share_, schedules[k])).otherwise(out)
        return out

    whole = F.transform(
        F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda p: F.struct(F.col("mix_size").alias("words"), at(p, F.col("mix_size")).alias("position")),
    )
    last = F.array(F.struct(extra.alias("words"), at(passes, extra).alias("position")))
    delivered = F.filter(F.concat(whole, last), lambda d: d["words"] > 0)
    result = placed.select(
        *(f"`{c}`" for c in docs.columns),
        "mix_size",
        "mix_source_size",
        "mix_target",
        taken.alias("mix_taken"),
        delivered.alias("mix_delivered"),
        "_pg_hash",
    ).withColumn("mix_position", F.try_element_at("mix_delivered", F.lit(1))["position"])
    return result.orderBy(F.col("mix_position").asc_nulls_last(), "_pg_hash").drop("_pg_hash")


def deliver(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """The mix itself: a row of docs for each delivery, in the order of training positions.

    A delivery of fewer words than the document has keeps the text up to its last word; length_col,
    if docs has it, then follows the text. Columns of docs only. See mix() for the options.
    """
    names = docs.columns
    mixed = mix(docs, text_col=text_col, **options)
    rows = mixed.select("*", F.explode("mix_delivered").alias("_pg_part"))
    whole = F.col("_pg_part.words") >= F.col("mix_size")
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    head = F.array_join(F.slice(F.split(F.col(text_col), ends), 1, F.col("_pg_part.words").cast("int")), "")
    text = F.when(whole, F.col(text_col)).otherwise(head)
    cut = rows.withColumn("_pg_text", text).withColumn("_pg_at", F.col("_pg_part.position"))
    new = {text_col: F.col("_pg_text")}
    if length_col in names:
        new[length_col] = F.when(whole, F.col(length_col)).otherwise(F.length("_pg_text").cast(docs.schema[length_col].dataType))
    return cut.withColumns(new).orderBy("_pg_at").select(*(f"`{c}`" for c in names))


def _position_sql(demand: str, schedule: tuple[float, ...]) -> str:
    """position() in SQL: the piece of the schedule in which the demand falls, solved for its time."""
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) * 0.5 * step for a, b in zip(schedule[:-1], schedule[1:], strict=True)]
    double = lambda x: f"CAST({x!r} AS DOUBLE)"
    cases = []
    for k, a in enumerate(schedule[:-1]):
        slope = (schedule[k + 1] - a) / step
        left = f"(({demand} - {double(sum(areas[:k]) / sum(areas))}) * {double(sum(areas))})"
        at = f"{left} / {double(a)}" if slope == 0 else f"(sqrt(greatest({double(a * a)} + {double(2 * slope)} * {left}, 0)) - {double(a)}) / {double(slope)}"
        when = f"WHEN {demand} < {double(sum(areas[: k + 1]) / sum(areas))} THEN" if k < len(areas) - 1 else "ELSE"
        cases.append(f"{when} {double(k * step)} + least(greatest({at}, 0), {double(step)})")
    return f"(CASE {' '.join(cases)} END)"


#: DuckDB SQL for the query op9: the same targets, order, cuts and positions over the documents table.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM sized GROUP BY source),
capped AS (
  SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget, source_size * CAST(2 AS DOUBLE) AS cap,
         CAST([3, 1, 2][number % 3 + 1] AS DOUBLE) AS weight
  FROM sources),
levelled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, number) AS ord
  FROM capped),
goals AS (
  SELECT source, source_size, number,
         coalesce(least(cap, weight * (SELECT level FROM levelled WHERE level <= cap / weight ORDER BY ord LIMIT 1)), cap) AS target
  FROM levelled),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.number, CAST(round(g.target) AS BIGINT) AS words,
         CASE WHEN g.source_size > 0 THEN CAST(round(g.target) AS BIGINT) // g.source_size ELSE 0 END AS passes,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
cut AS (
  SELECT *, greatest(0, least(size, words - passes * source_size - before)) AS extra FROM placed),
shared AS (
  SELECT *, CASE WHEN passes > 0 THEN size ELSE extra END AS amount,
         (before + (CASE WHEN passes > 0 THEN size ELSE extra END) / CAST(2 AS DOUBLE)) / nullif(words, 0) AS share
  FROM cut)
SELECT doc_id, size, source_size, target, CAST(passes * size + extra AS BIGINT) AS taken,
       CASE WHEN amount > 0 THEN CASE number % @n @cases END END AS position
FROM shared
""".replace("@n", str(len(SCHEDULES))).replace("@cases", " ".join(f"WHEN {k} THEN {_position_sql('share', s)}" for k, s in enumerate(SCHEDULES)))
