"""Threshold rules: deriving them from a corpus and holding documents against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import textprims as T
from ..functions.endings import closing_flags, register
from . import lines as L

COLUMNS = "metric string, kind string, level string, min double, max double, source string"


def published_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(t) for t in fixed.TARGETS], COLUMNS)


def unpivot(metrics: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, metric, value) of one column a metric; booleans count as 1 and 0."""
    names = [c for c in metrics.columns if c != id_col]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in names))
    return metrics.select(F.col(id_col).alias("doc_id"), F.inline(pairs))


def evaluate(values: DataFrame, targets: DataFrame) -> DataFrame:
    """values (doc_id, metric, value) with the target, ok and blocks; null values are ok."""
    joined = values.join(targets, "metric")  # a few rows of rules: Spark broadcasts them by size
    low = F.col("value") < F.col("min")
    high = F.col("value") > F.col("max")
    ok = ~(F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False)))
    return joined.select("doc_id", "metric", "value", "level", "min", "max", ok.alias("ok"), (~ok & (F.col("level") == "hard")).alias("blocks"))


def _outward(low: Column, high: Column, kind: Column) -> tuple[Column, Column]:
    least = (
        F.when(kind == "pct", F.greatest(F.lit(0.0), F.floor(low - 3).cast("double")))
        .when(kind == "len", F.floor(low - 3).cast("double"))
        .when(kind == "spp", F.round(low - 0.3, 1))
        .when(kind == "ratio", F.floor((low - 0.05) * 10) / 10)
    )
    most = (
        F.when(kind == "pct", F.least(F.lit(100.0), F.ceil(high + 3).cast("double")))
        .when(kind == "len", F.ceil(high + 3).cast("double"))
        .when(kind == "spp", F.round(high + 0.3, 1))
        .when(kind == "ratio", F.ceil((high + 0.05) * 10) / 10)
        .when(kind == "count", high + 1)
    )
    return least, most


def envelopes(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, env_min, env_max, min, max): bounds around what a corpus does.

    values: (doc_id, metric, value); rules: (metric, kind, has_min). The slack outside the corpus's
    own range is inferred from published bounds.
    """
    env = values.groupBy("metric").agg(F.min("value").alias("env_min"), F.max("value").alias("env_max"))
    joined = env.join(rules, "metric")
    least, most = _outward(F.col("env_min"), F.col("env_max"), F.col("kind"))
    return joined.select("metric", "env_min", "env_max", F.when(F.col("has_min"), least).alias("min"), most.alias("max"))


def stable_booleans(flags: DataFrame) -> DataFrame:
    """(metric, n_true, n, equals, kept) of (doc_id, metric, flag): a rule only where all agree."""
    counts = flags.groupBy("metric").agg(F.count_if("flag").alias("n_true"), F.count("flag").alias("n"), F.every("flag").alias("e"), F.bool_or("flag").alias("o"))
    kept = F.col("e") | ~F.col("o")
    return counts.select("metric", "n_true", "n", F.when(kept, F.col("e")).alias("equals"), kept.alias("kept"))


def post_metrics(posts: DataFrame, id_col: str = "slug", text_col: str = "body") -> DataFrame:
    """A row a post of the metrics that the targets are about; heading lines are left out.

    Sentences end at marks or final endings, shares are percents. Where no definition is published
    (speech levels, comma classes, closings) this engine's own is used.
    """
    body = F.regexp_replace(F.col(text_col), r"(?m)^(?:#|>|<!--).*$", "")
    paras = L.paragraphs(posts.select(id_col, body.alias("_b")), "_b")
    sents = L.sentences(paras, "paragraph", "ko").withColumns({
        "len": F.length("sentence"),
        "reg": register("sentence"),
        "conj": T.connective("sentence", (*fixed.CHECK_CONNECTIVES, "그래서", "그런데")).isNotNull(),
        "commas": F.regexp_count("sentence", F.lit(",")),
    })
    w = Window.partitionBy(id_col, "para_no").orderBy("sent_no")
    doc = Window.partitionBy(id_col).orderBy("para_no", "sent_no")
    bad = F.regexp_count("sentence", F.lit(rf"^(?:{T.literal_pattern(tuple(c for c in fixed.CHECK_CONNECTIVES if c not in fixed.COMMA_CONJUNCTIONS))}),"))
    rows = sents.withColumns({
        "haeyo2": (F.col("reg") == "해요체") & F.coalesce(F.lag("reg").over(w) == "해요체", F.lit(False)),
        "conj2": F.col("conj") & F.coalesce(F.lag("conj").over(doc), F.lit(False)),
        "bad": bad,
        "list_go": F.regexp_count("sentence", F.lit(r"고,|[가-힣](?<![은는이가고며면서데지만]),")),
        "subject": F.regexp_count("sentence", F.lit(r"[가-힣][은는이가],")),
    })
    count = lambda words: F.sum(F.regexp_count("sentence", F.lit(T.literal_pattern(words))))
    by_post = rows.groupBy(id_col).agg(
        F.avg("len").alias("len_mean"),
        T.share(F.col("len") > 100).alias("pct_xlong_gt100"),
        T.share(F.col("len") <= 35).alias("pct_short_le35"),
        T.share(F.col("len") > 70).alias("pct_long_gt70"),
        T.share(F.col("reg") == "합쇼체").alias("pct_hapsyo"),
        T.share(F.col("reg").isin("해요체", "-죠")).alias("pct_haeyo"),
        T.share(F.col("reg") == "해라체").alias("pct_haera"),
        F.count_if("haeyo2").alias("consecutive_haeyo"),
        T.share(F.col("sentence").endswith("?")).alias("pct_question"),
        T.share(F.col("conj")).alias("pct_conj_start"),
        F.sum("bad").alias("conj_comma_bad"),
        F.count_if("conj2").alias("conj_consecutive"),
        (F.sum("commas") / F.count("*")).alias("commas_per_sent"),
        T.share(F.col("commas") == 0).alias("pct_sent_no_comma"),
        T.percent(F.sum("list_go"), F.sum("commas")).alias("pct_list_or_go_comma"),
        F.sum("subject").alias("comma_after_subject"),
        count(("예를 들어", "예를 들면")).alias("ye_reul_deureo"),
        count(("여러분", "당신")).alias("yeoreobun_dangsin"),
        count(fixed.SENSORY).alias("sensory_total"),
        count(fixed.BANNED).alias("banned_total"),
        count(tuple(a for a, _ in fixed.SPELLING_PAIRS)).alias("nonpref_total"),
        T.share(F.col("sentence").rlike("아니라|보다는|말고")).alias("pct_contrast"),
    )
    per_para = rows.groupBy(id_col, "para_no").agg(F.count("*").alias("n")).groupBy(id_col).agg(
        F.avg("n").alias("sent_per_para_mean"), T.share(F.col("n") == 1).alias("pct_para_1")
    )
    last = paras.groupBy(id_col).agg(F.max_by("paragraph", "para_no").alias("p")).select(id_col, closing_flags("p").alias("c"))
    closing = last.select(id_col, F.col("c.call_or_outlook").cast("int").alias("closing_is_call_or_outlook"), F.col("c.summary").cast("int").alias("closing_is_summary"))
    bullets = posts.select(id_col, F.regexp_count(F.col(text_col), F.lit(r"(?m)^\s*[-*+]\s+\*\*[^*\n]+\*\*\s?[:：]")).alias("ai_bullet_bold"))
    return by_post.join(per_para, id_col).join(closing, id_col).join(bullets, id_col)
