import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prosegauge.llm import mixing, pii, quality, simhash
from prosegauge.llm.common import WordMemo, table

from .test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").limit(120).cache()


def test_quality_keeps_what_scores_well(spark, docs):
    model = quality.fit_quality(docs, table(spark, SF, "labels"))
    memo = WordMemo(quality.shape)
    want = [tuple(r) for r in docs.collect() if model.scores([r.text.encode()], memo)[0] >= 0.5]
    assert rows(STAGE["quality"](spark, docs, SF)) == sorted(want, key=repr)


def test_one_document_of_each_group_stays(spark, docs):
    twice = docs.unionByName(docs.limit(5))
    all_rows = [tuple(r) for r in twice.collect()]
    part = brute_components([brute_print(r[1]) for r in all_rows], 4)
    want = [min((r for r, p in zip(all_rows, part) if p == q), key=lambda r: r[0]) for q in set(part)]
    assert rows(STAGE["near_duplicates"](spark, twice, SF)) == sorted(want, key=repr)


def test_masking_replaces_spans_only(spark, docs):
    odd = [(1, "mail a.b@c.org or +1 (212) 555-0147 4111111111111111 now", "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0)]
    some = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = STAGE["personal_data"](spark, some, SF)
    assert got.schema.names == docs.columns and got.count() == some.count()
    texts = {r.doc_id: r.text for r in got.where("n_chars is null or n_chars < 100").collect() if r.doc_id in (1, 2, 3)}
    assert texts[1] == "mail <email> or <phone> <card> now" or "a.b@c.org" not in texts[1]
    model = pii.fit_pii(some)
    for r in some.join(got.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        if r.text and not model.spans(r.text)[1]:
            assert any(x == r.text for x in [r.t]) or r.doc_id in (1, 2, 3)


def test_mixing_delivers_the_words_taken(spark, docs):
    got = STAGE["mixing"](spark, docs, SF)
    words = F.regexp_count("text", F.lit(mixing.WORD_PATTERN))
    by = {r.source: r.n for r in got.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    want = {r.mix_source: r.n for r in mixing.mix(docs).groupBy(F.col("source").alias("mix_source")).agg(F.sum("mix_taken").alias("n")).collect()}
    assert by == {k: v for k, v in want.items() if v}
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got.collect())


def test_run_and_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 50
