"""Word lists, patterns and limits that the results depend on. Data, no code."""

# Lines of Korean briefs.
HANGUL = r"[가-힣]"
CAPTION = r"^(?:\[표|\[그림|그림(?U)\s*\d|표(?U)\s*\d|\(단위|자료(?U)\s*:|주(?U)\s*:|출처|※(?U)\s*자료)"
FOOTNOTE = r"(?U)^\d{1,2}\)\s"
NOTE = r"^[※*]"
NUMERIC_LINE = r"(?U)^[\d\s,.\-–△▲+%()~’'/:]+$"
PAGE_MARK = r"(?U)^(?:포커스|\d{1,3})$"
TABLE_HEADS = ("구분", "주요 내용", "주요내용", "비고", "일자", "내용", "구 분", "합계", "계", "연도")

# Bullet marks of each level, by dialect, tried in the order of the levels.
BULLETS = {
    "nabo": {1: r"(?U)^[≐▪]\s*", 2: r"(?U)^(?:‑‑|‑|-|–)\s*(?![\d△▲])", 3: r"(?U)^[•・·]\s*"},
    "nikl": {1: r"(?U)^□\s*", 2: r"(?U)^○\s*", 3: r"(?U)^-\s*(?![\d△▲])"},
}

# Connectives that an item may begin with, for the parser and for the checker.
CONNECTIVES = (
    "다만", "그러나", "또한", "한편", "특히", "아울러", "이에", "따라서", "반면", "향후", "이후", "그동안", "최근", "우선", "먼저", "이를 위해",
    "나아가", "즉", "그 외", "그외", "이와 같은", "이러한", "상기",
)
CHECK_CONNECTIVES = (
    "다만", "그러나", "또한", "한편", "특히", "아울러", "이에", "따라서", "반면", "향후", "이후", "그동안", "최근", "우선", "먼저", "이를 위해",
    "나아가", "즉", "그 외", "이와 같은", "이러한", "상기", "그리고", "하지만",
)

# Endings.
MIEUM = "함음임됨짐림옴줌봄뿜씀"
MIEUM_NOUNS = ("책임", "위임", "수임", "모임", "믿음", "도움", "결함", "손실", "수입", "신임")
NUMBER_UNITS = "원|명|건|개|호|년|월|일|p"
NOUN_ENDINGS = "필요|요망|바람|중요|주요|수요|소요|개요"
SENTENCE_ENDINGS = "다|요|죠|습니다|입니다|됩니다|합니다"

# Report checker.
TITLE_TAILS = (
    "방안", "계획", "결과", "현황", "분석", "검토", "대책", "보고", "시사점", "과제", "전망", "영향", "쟁점", "동향", "점검", "추진", "개선",
    "제안", "건의", "요청", "실적", "평가", "전략", "안", "내용", "경과", "필요", "요망",
)
CONCLUSIONS = ("필요", "건의", "요청", "결론", "판단", "전망", "제안", "요망", "추진", "결정", "확정", "의결", "검토", "시사", "바람", "권고", "예정", "계획")
VAGUE = (
    "대체로", "대부분", "많은", "어느 정도", "상당한", "상당히", "다양한", "적극적으로", "적극", "지속적으로", "원활", "제고", "효율적", "체계적",
    "종합적", "면밀히", "철저히", "만전", "최선을 다", "가일층", "강력히", "획기적", "극심한", "쇄도",
)
HANJA = (
    "금번", "동법", "동년", "당해", "익일", "상기", "제반", "차기", "적의 조치", "요망", "필한", "소명하", "기일 엄수", "귀 기관", "본 건",
    "만전을 기", "가일층", "경주하", "시현", "제고를 위",
)
TRANSLATED = ("에 있어서?", "을 필요로", "를 필요로", "에 의해", "에 의한", "시키[다고며]", "되어지", "되어졌", "함으로써", "에 다름 아니", "가지고 있", "~로부터")
FILLERS = ("에 대하여", "에 대한", "을 통하여", "를 통하여", "의 경우", "에 관하여", "함에 있어", "하는 것이 필요", "라고 할 수 있")
QUOTED = r"\"[^\"\n]*\"|“[^”]*”|「[^」]*」|『[^』]*』"
CHECK_BULLET = r"(?U)^(\s*)([□○◦▪■●•・·∙☐❍\-‑–—*※]|ㅇ(?=\s)|\d+[.)]|[가-힣][.)]|\(\d+\)|[①-⑳])\s*(.*)$"
CHECK_STOP = r"^(?:\[표|\[그림|자료|주:|※|\|)"

# Tables whose first two header cells show bad examples.
TEACHING_HEADERS = (
    ("쓰지 않는다", "쓴다"), ("쓴다", "쓰지 않는다"), ("전", "후"), ("유형", "내용"), ("역할", "쓰는 말 (앞이 기본)"),
    ("모호하거나 무거운 표현", "더 분명한 표현"), ("잘못된 항목", "문제"), ("구분", "목록"), ("증상", "원인"), ("시험 상황", "기대하는 처리"),
    ("상황과 입력", "올바른 처리"), ("제보 표현", "영어 원형 추정"), ("책의 항목", "우리 설계 대응"), ("광의", "협의"), ("용어", "흔한 오역"),
    ("근거의 상태", "사용할 표현"), ("정당한 용법", "구분 기준"), ("부호", "용법"), ("지양 예", "권장 예"), ("ID", "범주"), ("ID", "판정 질문"),
)

# Blog profile.
BANNED = (
    "한편", "그러므로", "게다가", "더불어", "아울러", "요약하면", "정리하면", "결론적으로", "마지막으로", "에 있어", "함으로써", "알아보겠습니다",
    "살펴보겠습니다", "핵심 포인트", "이 글에서는",
)
SENSORY = ("반짝", "부드러", "따뜻", "차가운", "향기", "눈부", "설레", "아름다", "빛나는", "싱그러", "포근", "은은", "찬란")
INTENSIFIERS = ("정말", "매우", "아주", "꽤", "무척", "굉장히", "너무", "엄청", "상당히")
COMMA_CONJUNCTIONS = ("다만", "더해서", "즉", "반면", "반면에")
# A spelling that the author does not prefer, and the one preferred.
SPELLING_PAIRS = (("콘텐츠", "컨텐츠"), ("타깃", "타겟"), ("세팅", "셋팅"), ("론칭", "런칭"), ("팬데믹", "팬더믹"), ("트랜드", "트렌드"), ("왠만", "웬만"))

# Targets: metric, kind, level, least, most (or the boolean that must hold), source.
TARGETS = (
    ("len_mean", "len", "hard", 43.0, 65.0, "envelope"),
    ("pct_xlong_gt100", "pct", "hard", None, 14.0, "envelope"),
    ("pct_short_le35", "pct", "soft", 10.0, 40.0, "envelope"),
    ("pct_long_gt70", "pct", "soft", 12.0, 40.0, "envelope"),
    ("sent_per_para_mean", "spp", "hard", 2.5, 4.8, "envelope"),
    ("pct_para_1", "pct", "soft", None, 28.0, "envelope"),
    ("pct_hapsyo", "pct", "hard", 68.0, 100.0, "envelope"),
    ("pct_haeyo", "pct", "soft", 0.0, 27.0, "envelope"),
    ("pct_haera", "pct", "hard", None, 7.0, "envelope"),
    ("consecutive_haeyo", "count", "soft", None, 5.0, "envelope"),
    ("pct_question", "pct", "soft", None, 8.0, "envelope"),
    ("pct_conj_start", "pct", "hard", 6.0, 38.0, "envelope"),
    ("conj_comma_bad", "count", "hard", None, 1.0, "policy"),
    ("conj_consecutive", "count", "soft", None, 9.0, "envelope"),
    ("commas_per_sent", "ratio", "hard", 0.3, 0.7, "envelope"),
    ("pct_sent_no_comma", "pct", "soft", 48.0, None, "envelope"),
    ("pct_list_or_go_comma", "pct", "soft", 54.0, None, "envelope"),
    ("comma_after_subject", "count", "soft", None, 2.0, "policy"),
    ("ye_reul_deureo", "count", "hard", None, 2.0, "policy"),
    ("yeoreobun_dangsin", "count", "hard", None, 2.0, "policy"),
    ("sensory_total", "count", "hard", None, 1.0, "policy"),
    ("banned_total", "count", "hard", None, 2.0, "policy"),
    ("nonpref_total", "count", "soft", None, 2.0, "policy"),
    ("pct_contrast", "pct", "soft", None, 18.0, "envelope"),
    ("closing_is_call_or_outlook", "bool", "hard", 1.0, 1.0, "boolean"),
    ("closing_is_summary", "bool", "hard", 0.0, 0.0, "boolean"),
    ("ai_bullet_bold", "count", "hard", None, 0.0, "policy"),
)

# English.
EN_WORD = r"[A-Za-z][A-Za-z'’\-]*"
PASSIVE = r"(?iU)\b(?:am|is|are|was|were|be|being|been)\s+(?:\w+ed|\w+en)\b"
NOT_EMOJI = "→✓✗⚠□○▪·※①"

# Blog profile, further lists: endings from longest to shortest, terms to watch, an author's and the standard spelling.
ENDING_TAILS = (
    "것입니다", "있습니다", "없습니다", "었습니다", "았습니다", "겠습니다", "습니다", "합니다", "입니다", "됩니다",
    "겁니다", "니다", "는데요", "세요", "고요", "까요", "네요", "요", "죠", "까",
)
WATCHLIST = (
    "경험", "수익", "실행", "검증", "전문성", "포지셔닝", "피드백", "가설", "시행착오", "고객", "커뮤니티", "니치", "오디언스", "빌딩", "메이커",
    "일잘러", "부캐", "찐팬", "레버리지", "노코드", "자동화", "생각합니다", "것 같습니다", "같은", "처럼", "식으로", "정도", "다양한", "빠르게", "쉽게",
    "저렴", "일단", "당장", "뚝딱", "짜치", "현타", "떡상", "헤헷", "쿨럭",
)
SPELLING_VARIANTS = (
    ("컨텐츠", "콘텐츠"), ("타겟", "타깃"), ("셋팅", "세팅"), ("런칭", "론칭"), ("팬더믹", "팬데믹"), ("트랜드", "트렌드"), ("왠만", "웬만"), ("어플", "앱"),
    ("메세지", "메시지"), ("레포트", "리포트"), ("비지니스", "비즈니스"), ("컨셉", "콘셉트"), ("프리젠테이션", "프레젠테이션"), ("디렉토리", "디렉터리"),
    ("데이타", "데이터"), ("스케쥴", "스케줄"), ("썸네일", "섬네일"), ("알고리듬", "알고리즘"), ("네비게이션", "내비게이션"), ("악세사리", "액세서리"),
    ("캐쥬얼", "캐주얼"), ("매니져", "매니저"), ("리더쉽", "리더십"), ("컨텐트", "콘텐트"), ("샵", "숍"),
)
LISTED = r"[가-힣A-Za-z0-9)\]”’\"']$"
EMOTICON = r"\^\^|[ㅎㅋㅠㅜ]{2,}|:\)|:D"
GLOSS = r"[가-힣] ?\([A-Za-z][^()]*\)"
HUMBLE_START = r"^(?:저는|저도|저의|저를|저희|제가|제 )"
HUMBLE = r"(?:^| )(?:저는|저도|저의|저를|저희|제가|제 )"
PLAIN_SELF = r"(?:^| )(?:나는|나도|나의|나를|내가|내 )"
