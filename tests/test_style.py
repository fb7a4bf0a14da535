"""Operators against small expected results and row-at-a-time versions."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import endings, fixed, needles
from prosegauge.functions import textprims as T
from prosegauge.operators import corpus, fidelity, items, lines, report_check, rules, segments, stats, targets
from prosegauge.plans import fixtures as X
from prosegauge.plans.queries import ORACLE, QUERIES
from prosegauge.sources import markdown_table, readers
from prosegauge.streaming import taste

SF = "/root/testdata/sf0.001"


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression.alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("예산안 의결", "체언(명사구)"), ("법안을 의결하였다", "종결어미(-다)"), ("대책 마련이 필요", "필요"), ("협조 요망", "요망/바람"), ("확인해요", "종결어미(-요)"),
    ("사업 추진 중", "-중(진행)"), ("지원할 것", "-것"), ("세제 지원 등", "등(열거)"), ("지원을 확대함", "명사형어미(-ㅁ)"), ("부서의 책임", "체언(명사구)"),
    ("확대 계획(안)", "괄호부연"), ("집행률 65%", "수치"), ("3월", "수치"), ("See note", "기타"), ("", "기타"), ("추진함.1)2)", "명사형어미(-ㅁ)"),
])
def test_ending_classes(spark, text, want):
    assert one(spark, text, endings.ending("t")["ending_class"]) == want


def test_primitives(spark):
    assert one(spark, "a  b　c ", T.collapsed("t")) == "a b c"
    assert one(spark, "한 글 자", T.nospace_len("t")) == 3
    assert one(spark, "다만, 집행", T.connective("t")) == "다만"
    assert one(spark, "그 외 사항", T.connective("t")) == "그 외"
    assert one(spark, "1,200과 3.5 그리고 7", T.n_numbers("t")) == 3
    assert one(spark, "## **굵은** `제목`", T.strip_md("t")) == "굵은 제목"
    assert one(spark, "A - B: C", T.main_title("t")) == "A"
    assert one(spark, "국내총생산(GDP) GDP USA", T.bare_acronyms("t")) == ["USA"]
    assert one(spark, "→ ✓ 🚀 ①", T.emoji_count("t")) == 1
    assert one(spark, "start x END y", T.between("t", "start", "END")) == "start x "


def syllables(w):
    w = "".join(c for c in w.lower() if "a" <= c <= "z")
    if len(w) <= 3:
        return min(len(w), 1)
    w = re.sub("^y", "", re.sub("(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", w))
    return max(1, len(re.findall("[aeiouy]{1,2}", w)))


def test_syllables_and_sentences(spark):
    words = "a the syllable created yes yellow Don't rhythm queue houses 1st".split()
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.n for r in frame.select("w", T.syllables(F.col("w")).alias("n")).collect()} == {w: syllables(w) for w in words}
    text = "It is so here. The U.S. Army said no! “Why not now?” he asked there. Ok."
    assert one(spark, text, T.en_sentences("t")) == ["It is so here.", "The U.S. Army said no!", "“Why not now?” he asked there."]


def test_items_and_summary(spark):
    pages = X.frame(spark, X.BRIEFS, "doc string, page int, body string")
    found = items.items(lines.lines(pages, "body"), ["doc"]).orderBy("doc", "item_no").collect()
    assert [(r.doc, r.level, r.text) for r in found][:4] == [
        ("A", 1, "제도 개편 방안 의결"), ("A", 2, "법인세 등 10건 가결"), ("A", 3, "(소득) 공제 신설 등 이어지는 긴 설명 줄이 앞 항목에 붙는다"), ("A", 2, "5건은 보류하고 다음 회기에 논의할 필요 -5 이하는 제외"),
    ]
    assert ("B", 1, "빈 기호 뒤의 줄은 언제나 붙음") in [(r.doc, r.level, r.text) for r in found]
    summary = {r.doc: r for r in items.doc_summary(lines.lines(pages, "body"), ["doc"]).collect()}
    assert summary["A"].n_items == 6 and summary["A"].n_tables == 1 and summary["A"].n_figures == 1 and summary["B"].n_L3 == 3 and summary["B"].headings_approx == []


def test_pages_last_of_equal_numbers_counts(spark):
    doc = spark.createDataFrame([("d", "lost<<<PAGE 1>>>\none<<<PAGE 2>>>two<<<PAGE 1>>>again")], "doc string, text string")
    assert sorted((r.page, r.body) for r in lines.pages(doc).collect()) == [(1, "again"), (2, "two")]


def test_toc_and_ranges(spark):
    rows = [("d", 3, i, t) for i, t in enumerate(["1호", "첫 제목", "이어짐", "2", "2호", "둘째", "9"])]
    toc = lines.toc_titles(spark.createDataFrame(rows, "doc string, page int, line_no int, line string"), ["doc"], ["page", "line_no"])
    got = [(r.no, r.title, r.first_page, r.last_page) for r in lines.page_ranges(toc, ["doc"], 1, 20).orderBy("no").collect()]
    assert [g[:2] for g in got] == [(1, "첫 제목 이어짐"), (2, "둘째")]


def only_children(levels):
    out = []
    for i, lv in enumerate(levels):
        if lv >= 3:
            continue
        kids = 0
        for x in levels[i + 1 :]:
            if x <= lv:
                break
            kids += x == lv + 1
        if kids == 1:
            out.append(i)
    return out


def test_only_children_by_brute_force(spark):
    import random

    rng = random.Random(4)
    docs = {f"d{k}": [rng.choice([1, 2, 2, 3, 3]) for _ in range(rng.randrange(1, 12))] for k in range(60)}
    rows = [(d, i, lv, i) for d, ls in docs.items() for i, lv in enumerate(ls)]
    got = items.only_children(spark.createDataFrame(rows, "doc_id string, item_no int, level int, line_no int")).collect()
    assert sorted((r.doc_id, r.item_no) for r in got) == sorted((d, i) for d, ls in docs.items() for i in only_children(ls))


def test_report_checker(spark):
    docs = spark.createDataFrame(X.REPORTS, "doc_id string, text string")
    found = {(r.doc_id, r.rule_id, r.line_no) for r in report_check.check_reports(docs, limit=400).collect()}
    assert {("r1", "H5", 4), ("r1", "H5", 5), ("r4", "H4a", 2), ("r4", "H4b", 3), ("r1", "S2a", None), ("r3", "no_items", None)} <= found
    assert not {("r4", "H4a", 4), ("r2", "H5", 3)} & found
    passed = {r.doc_id: r.passed for r in report_check.verdicts(docs, report_check.check_reports(docs)).collect()}
    assert passed["r2"] and not passed["r1"]


BLANK_TEXTS = ["", " ", "\n\n", " \n  \n", "\t", "# ", "추진 현황", "사업 검토 결과\n- 예산 3% 확대\n- 집행을 개선한다\n", "Plain title\n\nIt ran well. It ended."]


@pytest.mark.parametrize("name", ["report_check_documents", "report_check_prose_documents"])
def test_report_checks_of_blank_documents(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(BLANK_TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE[name]})").fetchall()))


def test_numbered_levels_use_open_indents(spark):
    text = "1. a\n   1) b\n   2) c\n      (1) d\n2. e"
    rows = report_check.raw_lines(spark.createDataFrame([("x", text)], "doc_id string, text string"))
    assert [r.level for r in items.checker_items(rows).orderBy("item_no").collect()] == [1, 2, 2, 3, 1]


def test_rules(spark):
    loaded = rules.load_rules()
    assert len(loaded) == 67 and sum(r.detector == "density" for r in loaded) == 23
    docs = spark.createDataFrame(X.RULE_TEXTS, "doc_id string, text string")
    found = {(r.doc_id, r.rule_id) for r in rules.findings(segments.segments(docs)).collect()}
    assert {("t1", "AT-09"), ("t1", "AT-32"), ("t1", "AT-34"), ("t1", "AT-46"), ("t2", "AT-47"), ("t2", "AT-55"), ("t2", "AT-16")} <= found
    assert not [f for f in found if f[0] == "t3"]
    for r in loaded:
        if r.detector in ("regex", "literal", "density"):
            assert one(spark, "보통 글", F.regexp_count("t", F.lit(rules._java(r.pattern)))) == 0, r.id


def test_own_rule_table():
    own = markdown_table.table_cells("| a | b\\|c |\n|---|---|\n| 1 | 2 |")
    assert own == [["a", "b|c"], ["1", "2"]]


def test_targets(spark):
    got = {(r.doc_id, r.metric): (r.ok, r.blocks) for r in targets.evaluate(X.frame(spark, X.METRICS, "doc_id string, metric string, value double"), targets.published_targets(spark)).collect()}
    assert got["p1", "banned_total"] == (False, True) and got["p1", "pct_short_le35"] == (False, False)
    assert got["p2", "closing_is_summary"] == (False, True) and got["p3", "pct_para_1"] == (True, False)
    assert len(fixed.TARGETS) == 27 and sum(t[2] == "hard" for t in fixed.TARGETS) == 15


def test_published_envelopes(spark):
    values = [("a", "len_mean", 46.5), ("b", "len_mean", 61.5), ("a", "pct_hapsyo", 71.2), ("b", "pct_hapsyo", 97.5), ("a", "commas_per_sent", 0.36), ("b", "commas_per_sent", 0.64), ("a", "sent_per_para_mean", 2.8), ("b", "sent_per_para_mean", 4.5)]
    kinds = [("len_mean", "len", True), ("pct_hapsyo", "pct", True), ("commas_per_sent", "ratio", True), ("sent_per_para_mean", "spp", True)]
    got = {r.metric: (r.min, r.max) for r in targets.envelopes(spark.createDataFrame(values, "doc_id string, metric string, value double"), spark.createDataFrame(kinds, "metric string, kind string, has_min boolean")).collect()}
    assert got == {"len_mean": (43.0, 65.0), "pct_hapsyo": (68.0, 100.0), "commas_per_sent": (pytest.approx(0.3), pytest.approx(0.7)), "sent_per_para_mean": (2.5, 4.8)}


def test_fidelity(spark):
    rows = X.frame(spark, X.REWRITES, "id string, a string, b string")
    got = {(r.id, r.token, r.verdict) for r in fidelity.compare(rows.select("id", F.col("a").alias("text")), rows.select("id", F.col("b").alias("text"))).collect()}
    assert got == {("d1", "12", "lost"), ("d1", "15", "invented"), ("d3", "“새 인용”", "invented")}
    quotes = spark.createDataFrame([("있는 말",), ("없는 말",), ("하나",)], "quote string")
    texts = spark.createDataFrame([("여기 있는 말 하나",)], "text string")
    assert [r.quote for r in fidelity.missing_quotes(quotes, texts).collect()] == ["없는 말"]


def test_corpus_and_taste(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id int, text string")
    assert sorted(r.doc_id for r in corpus.drop_exact_duplicates(docs).collect()) == [1, 3]
    blocks = spark.createDataFrame([("p", 0, "x"), ("p", 1, "end"), ("q", 0, "end"), ("q", 1, "y"), ("q", 2, "end")], "doc_id string, block_no int, text string")
    assert sorted((r.doc_id, r.block_no) for r in corpus.tail_boilerplate(blocks, depth=1).where("is_boilerplate").collect()) == [("p", 1), ("q", 2)]
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "id string, content binary")
    manifest = spark.createDataFrame([("a", "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"), ("b", "0")], "id string, sha256 string")
    assert {r.id: r.status for r in corpus.verify_hashes(files, manifest).collect()} == {"a": "ok", "b": "CHANGED"}
    got = {r.rule: r.stage for r in taste.promote(X.frame(spark, X.CASES, "case_id string, rule string, comment string")).collect()}
    assert got == {"W-01": "rule", "W-02": "observation", "W-03": "trend", "W-04": "rule"}


def test_taste_stream(spark, tmp_path):
    folder = tmp_path / "ledger"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"case_id":"a","rule":"R","comment":"x"}\n{"case_id":"b","rule":"R","comment":"y"}\n')
    query = taste.watch(spark, str(folder), str(tmp_path / "cp"), "promotions")
    query.processAllAvailable()
    assert spark.table("promotions").first().stage == "trend"
    query.stop()


def test_readers(spark, tmp_path):
    (tmp_path / "p.md").write_text("# 제목\n<!-- 2022-02-24 | 글 | be-maker -->\n> 요약\n\n본문", encoding="utf-8")
    post = readers.blog_posts(spark, str(tmp_path / "p.md")).first()
    assert (post.slug, post.title, str(post.date), post.category, post.excerpt, post.body) == ("be-maker", "제목", "2022-02-24", "글", "요약", "본문")
    (tmp_path / "s.csv").write_text("﻿sample_id,source_id,pdf_page,block_indices,unit_within_group,unit_type,characters_with_spaces,characters_without_spaces,space_tokens,text_sha256,group_bbox\nx,S1,3,1 2,1,bullet,10,9,2,ab,\"1.0, 2, 3, 4.5\"\n")
    row = readers.sample_table(spark, str(tmp_path / "s.csv")).first()
    assert row.sample_id == "x" and row.bbox == [1.0, 2.0, 3.0, 4.5]
    (tmp_path / "m.json").write_text('{"sources":[{"id":"a","access":"auto","pages":[1,2],"alt_urls":[]},{"id":"b","access":"manual","pages":"4쪽"}]}', encoding="utf-8")
    got = {r.id: r.page_list for r in readers.source_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a": [1, 2], "b": None}
    assert readers.html_blocks("<p class='ad'>x</p><div>one <b>two</b></div><script>no</script><li>three", ("ad",)) == [("div", "one two"), ("li", "three")]
    assert "| 1.5 |" in readers.markdown_report(spark.createDataFrame([(1.5,)], "a double"))


def test_stats(spark):
    sents = spark.createDataFrame([("d", 1, k, "x" * n, n) for k, n in enumerate([10, 50, 95, 20], 1)], "doc_id string, para_no int, sent_no int, sentence string, len int")
    paras = spark.createDataFrame([(1, 1, [10, 50, 100, 20]), (2, 1, [5]), (2, 2, [30, 30, 31, 2])], "doc_id int, para_no int, lens array<int>")
    assert {r.step: r.n for r in stats.length_transitions(paras.where("doc_id = 1"), ["doc_id"]).collect()} == {"SM": 1, "ML": 1, "LS": 1}
    assert stats.rhythm(paras, ["doc_id"]).where("doc_id = 1").first().pattern == "SMLS"
    assert stats.after_long(paras, ["doc_id"]).first().mean == 20.0
    assert {r.doc_id: (r.first_mean, r.last_mean) for r in stats.first_last(paras, ["doc_id"]).collect()} == {1: (10.0, 20.0), 2: (17.5, 3.5)}
    assert {r.doc_id: r.n for r in stats.consecutive_short(paras, ["doc_id"]).collect()} == {1: 0, 2: 1}
    assert [r.run_length for r in stats.runs(sents, ["doc_id"], "sent_no", F.col("len") > 30).collect()] == [2]


def test_every_query_is_registered_with_known_columns(spark):
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 40
    import __spark_entry__

    flagship = __spark_entry__.entry(spark)
    assert flagship.count() > 0 and "clarity_index" in flagship.columns


def test_acceptance(spark):
    from prosegauge.operators import acceptance

    rows = X.frame(spark, X.REWRITES, "doc_id string, a string, b string")
    docs = rows.select("doc_id", F.col("b").alias("text"))
    found = acceptance.check_all(docs, rows.select("doc_id", F.col("a").alias("text")))
    got = {(r.doc_id, r.rule_id): r.blocks for r in found.where("checker = 'original'").collect()}
    assert got["d1", "number:15"] and not got["d1", "number:12"] and not got["d1", "negation"]
    assert {r.doc_id for r in acceptance.accepted(docs, found).where("not accepted").collect()} >= {"d1", "d3"}
    absent = spark.createDataFrame([("x", "정확한 수는 확인되지 않았습니다. 그래서 300명으로 적었습니다. 끝입니다.")], "doc_id string, text string")
    assert [r.sent_no for r in acceptance.fill_after_absence(absent).collect()] == [1]
    assert acceptance.render("{{n:a}} {{one_in:b}} {{ratio:a/b}} {{t}}", {"a": 10, "b": 4}, {"t": "글"}) == "10 25 2.5 글"
    with pytest.raises(KeyError):
        acceptance.render("{{n:zz}}", {})


def test_spellings_that_are_not_preferred_count(spark):
    post = spark.createDataFrame([("p", "타깃을 정하고 론칭 계획을 세웁니다. 타겟과 런칭은 세지 않습니다.")], "slug string, body string")
    assert targets.post_metrics(post).first().nonpref_total == 2


def test_profile_of_posts(spark):
    from prosegauge.operators import profile

    posts = X.frame(spark, X.POSTS, "corpus string, text string")
    got = profile.sentence_profile(stats.sentence_rows(posts, ["corpus"], language="ko"), ["corpus"]).first()
    assert (got.n_through, got.n_slashes, got.n_glosses, got.n_mixed_self) == (3, 1, 1, 2)
    assert profile.paragraph_profile(posts, ["corpus"]).first().n_emoticons == 2
    spelled = {r.author: (r.n_author, r.n_standard, r.preferred) for r in profile.spelling_preferences(posts, ["corpus"]).collect()}
    assert spelled["컨텐츠"] == (2, 0, "컨텐츠") and spelled["타겟"] == (1, 1, "혼용") and spelled["썸네일"] == (1, 0, "혼용")
    assert {(r.part, r.kind): r.n for r in profile.openings_and_closings(posts, ["corpus"]).collect()}["closing", "summary"] == 1
    assert profile.word_lists(posts.where("text = ''"), ["corpus"]).agg(F.sum("n").alias("n")).first().n == 0
    assert profile.heading_kinds(posts.where("text is null"), ["corpus"]).count() == 0


@pytest.mark.parametrize("pattern,want", [
    ("ab(?:cd|e)", ["ab"]), ("(?:ab|b)c?", ["b"]), ("a*b{1,2}", ["b"]), ("[xy]\\s*가나", ["가나"]), ("a*", None), ("(?:ab|c*)", None), ("[^a]", None),
    ("(?=abc)[0-9]x", ["x"]), ("(?i)ab", None), ("(?i:ab)c", ["c"]), ("[a-z&&[^c]]d", None), (r"\Qab\E", None),
])
def test_needles(pattern, want):
    assert needles.needles(pattern) == want


def test_rules_run_only_where_their_strings_are(spark):
    """Where a rule matches, its needles and the screen do too; over texts of the rules' own words."""
    import random

    rng = random.Random(6)
    run = [r for r in rules.load_rules() if r.detector in ("regex", "literal", "density")]
    texts = {t for _, t in [*X.RULE_TEXTS, *X.word_texts(run)]}
    for r in run:
        words = re.findall(r"[가-힣—–:*()\d]+|<!-- [a-z-]+", r.pattern.replace("\\s?", " ")) or ["x"]
        texts |= {rng.choice(["", " "]).join(rng.choice(words) for _ in range(9)) for _ in range(20)}
    found = {r.id: needles.needles(r.pattern) for r in run}
    assert all(found.values())
    screen = T.quoted(needles.screen([x for s in found.values() for x in s]))
    cells = [
        f"struct('{r.id}' AS id, regexp_count(t, {T.quoted(rules._java(r.pattern))}) > 0 AS hit, {needles.guard('t', found[r.id])} AND regexp_like(t, {screen}) AS met)" for r in run
    ]
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").select("t", F.expr(f"inline(array({', '.join(cells)}))")).where("hit").collect()
    assert len({r.id for r in rows}) > 25 and not [(r.id, r.t) for r in rows if not r.met]
    # Over a text without any of them no pattern runs: one that fails where it runs does no harm.
    bad = [replace(r, exception="`(`") for r in run]
    plain = spark.createDataFrame([("x", "Nothing of the rules. " * 9)], "doc_id string, text string")
    assert rules.rule_hits(segments.segments(plain), bad).collect() == []
