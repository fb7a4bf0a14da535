"""Small inline inputs of the Korean queries, as Spark rows and as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BRIEFS = [
    ("A", 1, "▪제도 개편 방안 의결\n‑‑ 법인세 등 10건 가결\n・(소득) 공제 신설 등\n이어지는 긴 설명 줄이 앞 항목에 붙는다\n- 5건은 보류하고 다음 회기에 논의할 필요\n-5 이하는 제외\n[표 1] 주요 경과\n일자\n1) 각주 한 줄은 항목이 아니다"),
    ("A", 2, "포커스\n12\n추진 배경\n≐ 예산은 1,200억원으로 확대\n짧은 줄\n‑ 다만, 집행률은 65%\n\n[그림 2] 추이"),
    ("B", 1, "▪\n빈 기호 뒤의 줄은 언제나 붙음\n• 세부 점검 중임\n• 개선 요망\n※ 참고 줄\n• 확대 계획(안)"),
]
ENDINGS = [
    "예산안 의결", "법안을 의결하였다", "대책 마련이 필요", "협조 요망", "확인해요", "사업 추진 중", "지원할 것", "세제 지원 등", "지원을 확대함",
    "부서의 책임", "확대 계획(안)", "집행률 65%", "총 1,200억원", "3월", "See note", "", "추진함.1)", "검토 결과 보고 2)", "도입이 늦어짐 。", "12건",
]
REPORTS = [
    ("r1", "# 청년 고용 현황\n\n□ 배경\n  ○ 고용 문제가 다양한 측면에서 상당히 심각합니다.\n  ○ 본 보고는 현황을 살펴보고 향후 방안을 도출하였다.\n    - 특히 대부분의 청년이 어려움을 겪고 있음\n□ 계획\n  ○ 예산은 21,345천원이 소요\n    - 오후 3시 30분 회의, 2024년 12월 10일 확정\n    - 또한 2024.12.10. 고시"),
    ("r2", "# 지역 산업 지원 확대 방안\n지원 대상 3곳을 추가 지정할 것을 건의\n□ 지원 2건 확정\n ○ 대상 3곳 선정 (GDP 기준)\n ○ 국내총생산(GDP) 대비 2% 지원\n1. 첫째 과제\n  가. 세부 과제\n  나. 다른 과제\n2. 둘째 과제"),
    ("r3", "줄글 보고\n기호가 없는 문서이다. 금번 사업은 적극적으로 추진한다."),
    ("r4", "# 요약\n" + "□ " + "가" * 125 + "\n□ " + "나" * 95 + "\n ○ “" + "다" * 130 + "” 인용\n"),
]
RULE_TEXTS = [
    ("t1", "# 시작\n\n이 글에서는 방법을 알아보겠습니다. 핵심은 속도입니다.\n\n정말 매우 아주 상당히 굉장히 좋습니다.\n\n- **속도**: 빠름\n- **비용**: 낮음\n- **품질**: 높음\n\n결국 우리 모두는 노력해야 합니다."),
    ("t2", "시장은 두 갈래로 갈립니다. 바로 여기에서 시작합니다.\n\n궁금한 점이 있으시면 알려 주세요. 🚀🚀\n"),
    ("t3", "2024년 조사에서 응답자 31명이 찬성했다.\n\n| 전 | 후 |\n|---|---|\n| 이 글에서는 | 없음 |\n\n```\n이 글에서는 코드\n```\n"),
]
METRICS = [
    ("p1", "len_mean", 55.4), ("p1", "pct_hapsyo", 60.0), ("p1", "banned_total", 3.0), ("p1", "pct_short_le35", 41.0),
    ("p2", "len_mean", 42.9), ("p2", "pct_hapsyo", 86.2), ("p2", "closing_is_summary", 1.0), ("p2", "commas_per_sent", 0.51),
    ("p3", "conj_comma_bad", 1.0), ("p3", "pct_sent_no_comma", 40.0), ("p3", "closing_is_call_or_outlook", 1.0), ("p3", "pct_para_1", None),
]
CASES = [
    ("c1", "W-01", "단정한 문장"), ("c2", "W-01", "[규칙] 늘 이렇게"), ("c3", "W-01", "다시"), ("c4", "W-02", "한 번"), ("c5", "W-03", "[규칙]"),
    ("c6", "W-04", "가"), ("c7", "W-04", "나"), ("c8", "W-04", "[규칙] 다"),
]
REWRITES = [
    ("d1", "매출은 12억원, \"좋다\"는 평가. 아니다.", "매출은 15억원, \"좋다\"는 평가."),
    ("d2", "2024년 3월 10건", "2024년 3월 10건"),
    ("d3", "값 1,200과 7", "값 1,200과 “새 인용” 7 7"),
]


def word_texts(rules) -> list[tuple[str, str]]:
    """For each rule of literal words a text that has them all, once as prose, once as a list."""
    found = []
    for r in rules:
        if not r.expression.startswith("`"):
            words = [w.strip() for w in r.expression.split(" · ") if w.strip()]
            found.append((f"words-{r.id}", "\n".join(f"여기에 {w} 보기." for w in words) + "\n\n" + "\n".join(f"- {w} 항목" for w in words)))
    return found


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """A FROM item of the same rows for SQL."""
    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


#: Posts (corpus, text) for the profile of a corpus.
POSTS = [
    ("posts", "# 컨텐츠를 만드는 방법\n<!-- 2024-01-01 -->\n> 요약\n\n안녕하세요. 저는 노코드 메이커입니다. 제가 내 경험을 통해 배운 것을 씁니다!\n\n## 1. 왜 쓰나요?\n\n"
              "글을 쓰면, 생각이 정리되고, 고객(Customer)도 생깁니다. 하지만, 처음은 어렵다고 생각합니다. 정말 매우 쉽게 시작할 수 있을 것 같습니다. ㅎㅎ\n\n"
              "## 시작하자\n\n타겟과 타깃을 나누고, 컨텐츠/런칭 순서를 정합니다. 저도 내 일을 통해, 통해 배웠네요. 결국 다시 쓰게 될 것입니다.\n"),
    ("posts", "어떻게 시작할까요? 게다가 반짝이는 글은 드뭅니다. 나는 그렇게 본다.\n\n### 글은 길이다\n\n이 도구는, 쉽다. 요약하면 (도구)는 도구입니다 ^^ 빠르게, 값싸게, 쉽게 합니다.\n"),
    ("posts", "노코드란 코드 없이 만드는 것을 의미합니다. 트렌드, 트랜드 모두 씁니다.\n\n썸네일은 알고리즘보다 낫죠. 함께 해 보세요.\n"),
    ("posts", ""),
    ("posts", None),
]
