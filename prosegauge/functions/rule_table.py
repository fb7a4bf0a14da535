"""The rule table, as the Markdown table that load_rules() reads. Data, no code.

Columns: id, category, pattern name, severity, detector, scope, genre, expression, exception, threshold.
"""

TABLE = r"""
| ID | 범주 | 패턴 | 심각도 | 검출 | 범위 | 장르 | 정규식·문자열 | 예외 | 임계값 |
|---|---|---|---|---|---|---|---|---|---|
| AT-01 | 구문 | 이항 대구 연쇄 | S2 | density | prose,list | 공통 | `(?<![가-힣])아니라(?![가-힣])\|(?<![가-힣])아닌(?=\s)\|라기보다\|뿐만\s?아니라\|에\s?그치지\s?않고\|(?:을\|를)\s?넘어(?:서)?(?=\s)` | `(?:[^/\n]{2,40}\s/\s){2,}` | 2/문단 |
| AT-02 | 구문 | 부정 나열 3연 | S1 | regex | prose,list | 공통 | `도\s?아니(?:고\|며\|요)[^.!?\n]{0,20}?도\s?아(?:니라\|닌\|니다\|니고)` | | |
| AT-03 | 구문 | 열거 도입 공식 | S2 | regex | prose | 줄글 | `크게\s?(?:두\|세\|네\|다섯\|\d)\s?가지로\|다음과\s?같은\s?(?:특징\|장점\|이유\|방법)(?:이\|을\|가)\s?있` | | 2/문서 |
| AT-04 | 구문 | 3항 강박 | S3 | structure | list | 줄글 | `triad_lists` | | 3/문서 |
| AT-05 | 구문 | 단문 연타 | S2 | structure | prose | 줄글 | `short_run` | | 1/문단 |
| AT-06 | 구문 | 문장 안 숫자 괄호 인덱싱 | S2 | regex | prose | 줄글 | `(?<![\d(])1\)\s[^\n]{2,60}?2\)\s[^\n]{2,60}?3\)` | | 2/문서 |
| AT-07 | 여닫음 | 요약 마무리(문두) | S1 | regex | prose | 줄글 | `^\s{0,3}(?:결론적으로\|종합하(?:면\|자면)\|요약하자면\|정리하자면\|요약하면\|정리하면)(?![가-힣])` | | |
| AT-08 | 여닫음 | 요약 마무리(개조식) | S2 | density | prose,list | 개조식 | `(?:^\|(?<=[.!?]\s))\s{0,3}(?:요약하면\|정리하면\|결론적으로\|종합하(?:면\|자면)\|요약하자면\|정리하자면)(?![가-힣])` | `(?:표\|목록\|한\s?줄)(?:로\|으로)\s?(?:요약\|정리)` | 2/문서 |
| AT-09 | 여닫음 | 서두 자기 설명 | S1 | regex | prose,list | 공통 | `이\s?글에서는\|본\s?(?:글\|보고서\|문서)(?:에서)?는\s[^.\n]{0,30}(?:목적\|다루\|살펴\|알아보)\|(?:이\s?글\|본\s?글\|이번\s?글\|지금부터\|아래에서\|여기서)[^.!?\n]{0,40}?(?:알아보\|살펴보)겠습니다\|소개해\s?드리겠습니다\|이야기해\s?보겠습니다\|(?:함께\|자세히\|하나씩\|차근차근\|지금부터\|본격적으로\|그럼\|그렇다면)[^.!?\n]{0,30}?(?:알아\|살펴)(?:볼까요\|봅시다)\|파헤쳐\s?(?:볼까요\|보겠습니다\|봅시다)` | | |
| AT-10 | 여닫음 | 헛기침·메타 논평 | S2 | density | prose,list | 공통 | `(?<![가-힣])(?:여기서\|이때\|이\s?지점에서)?\s?(?:중요한\|핵심적인\|주목할\|흥미로운)\s?(?:것\|점\|사실\|부분)은\|(?<![가-힣])핵심은\s\|핵심\s?포인트\|주목할\s?만한\s?(?:점\|사실)은\|(?<![가-힣])(?:흥미롭게도\|놀랍게도\|아이러니하게도\|역설적이게도\|당연하게도)\|보시다시피\|생각보다\s?(?:훨씬\s?)?중요\|(?<![가-힣])이\s?(?:차이\|구분\|점)(?:이\|가\|는)\s?(?:중요\|핵심\|결정적)\|눈여겨\s?볼\s?(?:점\|대목\|부분)\|(?:솔직히\|냉정하게\|분명히\|단도직입적으로)\s?말(?:하면\|해서\|씀드리면\|하자면\|씀드리자면\|씀드릴게요)\|불편한\s?진실\|(?:진실\|현실\|정답\|(?<![가-힣])답)은\s?(?:이렇\|간단\|명확\|단순)` | `\d[^.!?\n]*(?:흥미롭게도\|놀랍게도\|아이러니하게도\|역설적이게도\|당연하게도)\|(?:흥미롭게도\|놀랍게도\|아이러니하게도\|역설적이게도\|당연하게도)[^.!?\n]*\d` | 2/문서 |
| AT-11 | 여닫음 | 수사 설정 | S2 | regex | prose | 줄글 | `(?:생각해\|상상해\|떠올려)\s?(?:보(?:세요\|십시오\|시기\s?바랍니다\|자(?![가-힣]))\|볼까요\|봅시다)` | | 2/문서 |
| AT-12 | 여닫음 | 정형 결말·전환 공식 | S1 | regex | prose,list,heading | 공통 | `[가-힣]{0,6}[할될탈갈릴올볼줄쓸들킬]\s?(?:때\|시점\|순간)입니다\|시대가\s?(?:도래\|왔\|열렸)\|새로운\s?(?:장\|지평\|가능성)(?:을\|이)\s?(?:열\|펼)` | | |
| AT-13 | 여닫음 | 변환 공식 'X'에서 'Y'로 | S2 | regex | prose,heading | 공통 | `['‘][^'’\n]{1,15}['’]에서\s?['‘][^'’\n]{1,15}['’](?:으)?로\|단순한\s?[가-힣]{1,10}(?:을\|를)\s?넘어` | | 2/문서 |
| AT-14 | 여닫음 | 잠언 마무리 | S3 | structure | prose | 줄글 | `closing_kicker` | | 40자 |
| AT-15 | 여닫음 | 정형 전망 절 | S2 | density | prose,list | 공통 | `(?:것으로\|이\|가)\s?(?:기대\|전망\|예상)(?:된다\|됩니다\|됨\|되며)\|귀추가\s?주목\|지속적인\s?(?:관심\|노력)(?:이\|을)\s?(?:필요\|요구\|기울)` | `\d\|(?:부\|처\|청\|팀\|국)(?:가\|는\|에서\|이)\s` | 2/문서 |
| AT-16 | 여닫음 | 대화 잔재 | S1 | literal | prose,list,heading,table | 공통 | 더 필요하시면 · 궁금한 점이 있으시면 · 궁금하신 점이 있으면 · 좋은 질문입니다 · 물론 맞는 말씀 · 이어서 살펴보겠습니다 · 도움이 되었기를 바랍니다 · 도움이 되셨기를 바랍니다 · 추가로 궁금한 | | |
| AT-17 | 여닫음 | 덕담 마무리 | S1 | literal | prose,list | 개조식 | 도움이 되셨길 · 도움이 되셨으면 · 응원합니다 · 행운을 빕니다 · 건승을 기원 | | |
| AT-18 | 부호 | 줄표 남용 | S2 | density | prose,list | 공통 | `[—–]` | `\d\s?[—–]\s?\d\|\*\*[^*\n]{1,30}\*\*\s?[—–]\|\[[^\]\n]*[—–][^\]\n]*\]\(` | 3/문서 |
| AT-19 | 부호 | 콜론 극적 공개 | S2 | regex | prose,list | 공통 | `(?:입니다\|습니다\|이다\|있다\|는다\|하나\|것)[:：]\s?(?=[가-힣])` | `\d[:：]\d` | 2/문서 |
| AT-20 | 부호 | 콜론 부제 제목 | S2 | regex | heading | 줄글 | `^[^:：\n]{2,30}[:：]\s?[^\n]{2,40}$` | `^\s{0,3}\d+[.)]\|\{\{` | 2/문서 |
| AT-21 | 부호 | 연결어미 뒤 쉼표 | S3 | density | prose,list | 공통 | `(?:지만\|면서\|어서\|아서\|는데\|니까\|므로\|라서),` | | 6/문서 |
| AT-22 | 행위자 | 무생물 주어 + 인간 동사 | S2 | regex | prose,list | 공통 | `(?<![가-힣])(?:결과\|데이터\|수치\|보고서\|연구\|기술\|시장\|시대\|흐름\|변화\|산업\|경쟁\|질문\|숫자\|통계\|그래프\|자료\|분석\|사례\|이\s?글\|역사\|현실\|미래)(?:은\|는\|이\|가)\s(?:[가-힣]{1,6}\s){0,5}(?:말해\s?주\|말하고\|보여\s?주\|증명하\|시사하\|던지\|요구하\|묻\|알려\s?주\|경고하\|이끌\|증언하\|웅변하\|가르쳐\s?주)` | | 2/문서 |
| AT-23 | 행위자 | 모호한 출처 귀속 | S2 | regex | prose,list | 공통 | `(?:전문가들\|많은\s?(?:이들\|사람들\|전문가)들?)(?:은\|이\|가)\s[^.\n]{0,30}(?:라고\|다고\|으로\|로)\s?(?:본다\|봅니다\|보고\|말\|주장\|평가\|지적\|강조\|전망\|분석\|여기)\|업계에서는\|널리\s?알려(?:진\|져)\|(?:으)?로\s?평가(?:된다\|됩니다\|받는다)\|(?:연구\|조사\|통계)(?:\s?결과)?에\s?따르면\|(?:일반적으로\|흔히)\s?알려진` | `\(\d{4}\)\|\d{4}년\|자료:\|출처:\|[A-Z][a-z]+\s(?:et\s?al\|&)\|\[\d+\]\|각주` | 2/문서 |
| AT-24 | 행위자 | 권위 나열 | S3 | human | prose,list | 공통 | | | |
| AT-25 | 행위자 | 추정 메우기 | S1 | human | prose,list | 공통 | | | |
| AT-26 | 어휘 | 중요성 과장 | S2 | density | prose,list,heading | 공통 | 중대한 전환점 · 획기적 · 혁신적 · 전례 없는 · 게임 체인저 · 게임체인저 · 패러다임 전환 · 패러다임의 전환 · 새로운 지평 · 시사하는 바가 크 · 주목할 만 · 간과할 수 없 · 압도적 · 폭발적 · 파격적 · 대대적 · 역사적인 순간 · 분수령 | | 2/문서 |
| AT-27 | 어휘 | 완충어 과잉 | S3 | density | prose,list | 공통 | 가능성이 있 · 여지가 있 · 여지도 있 · 측면이 있 · 경향이 있 · 수도 있 · 일정 부분 · 어느 정도 · 대체로 · 편이다 · 편입니다 · 듯하 · 것으로 판단 · 것으로 보인 · 것으로 보입니다 · 추정된 · 것 같 | | 2/문장 |
| AT-28 | 어휘 | 군더더기 구문 | S2 | density | prose,list | 공통 | 하기 위한 목적으로 · 되도록 하기 위하여 · 라는 사실로 인하여 · 현재 시점에서는 · 현 시점 기준으로 · 경우에 있어서는 · 경우에 한하여 · 할 수 있는 능력을 보유 · 수행하는 역할을 한다 · 하는 것이 가능하다 · 라고 할 수 있을 것이다 | | 2/문서 |
| AT-29 | 어휘 | 판단 회피 종결 | S2 | density | prose | 줄글 | `(?:라고\|다고)\s?(?:할\|볼)\s?수\s?있(?:다\|습니다\|을\s?것)` | | 3/문서 |
| AT-30 | 어휘 | '필요' 남발 | S2 | density | prose | 줄글 | `할\s?필요가\s?있(?:다\|습니다)\|(?:이\|가)\s?필요(?:하다\|합니다)` | | 3/문서 |
| AT-31 | 어휘 | 이중 피동 | S1 | regex | prose,list | 줄글 | `(?:되어\|시켜\|되여)[지진질져졌]` | `번역투\|비문\|표현\|피동\|어미` | |
| AT-32 | 어휘 | 정도부사 중독 | S3 | density | prose,list | 공통 | 정말 · 매우 · 아주 · 상당히 · 굉장히 · 너무 · 엄청 · 무척 | | 5/문서 |
| AT-33 | 어휘 | 용어 변주 | S3 | human | prose,list | 공통 | | | |
| AT-34 | 구조 | 굵은 라벨 목록 | S2 | structure | list | 공통 | `bold_label_run` | | 3항 |
| AT-35 | 구조 | 이모지 | S1 | structure | prose,list,heading,table | 개조식 | `emoji` | | |
| AT-36 | 구조 | 제목 되풀이 | S2 | structure | heading,list | 공통 | `heading_echo` | | 40자 |
| AT-37 | 구조 | 굵게 남발 | S3 | density | prose | 공통 | `\*\*[^*\n]+\*\*` | | 3/문단 |
| AT-38 | 구조 | 문단 요약 마무리 반복 | S3 | structure | prose | 줄글 | `para_closer` | | 50% |
| AT-39 | 구조 | 검수 상태 혼입 | S1 | literal | prose,list,heading,table | 공통 | 수정 없음 · hard 위반 · 검수 결과 · <!-- style-review · <!-- slop-rewrite · 윤문 메모 · taste-notes | `\[(?:사례\|숫자\|출처\|확인\|근거\|마무리)\s?필요\|담당\s?미정\|일정\s?미정\|(?:\*\*\|['‘’])(?:수정\s?없음\|검수\s?결과\|hard\s?위반)(?:\*\*\|['‘’])` | |
| AT-40 | 구문 | 문두 접속 남발 | S2 | 위임 | prose | 공통 | | | |
| AT-41 | 어휘 | 번역투 조사 | S2 | 위임 | prose,list | 공통 | | | |
| AT-42 | 구조 | 균일 문단·문장 길이 | S2 | 위임 | prose | 공통 | | | |
| AT-43 | 어휘 | 감각적·만능 평가어 | S2 | density | prose,list | 공통 | `(?:(?:단단\|선명\|촘촘\|정교\|탄탄\|묵직\|날카로\|깊이\s?있\|밀도\s?(?:높\|있)\|의미\s?있\|효과적\|본질적\|강력\|견고\|치밀\|탁월\|명료\|명확\|정확\|체계적\|풍부\|인상적\|유의미)(?:한\|인\|은\|운\|게)\|뛰어난\|뛰어나게)\s?(?:논리\|메시지\|구성\|글\|전략\|분석\|통찰\|설계\|접근\|구조\|근거\|성과\|결과\|방향\|해법\|도구\|무기)` | `\d\|%` | 3/문서 |
| AT-44 | 구문 | '단순한 X가 아니라 Y' | S2 | regex | prose,list | 공통 | `단순(?:한\|히)\s[^.!?\n]{0,25}?(?:아니라\|아닌\|넘어)` | | 1/문서 |
| AT-45 | 여닫음 | 상식 서론 | S2 | structure | prose,list | 공통 | `opening_platitude :: ^(?:현대\|오늘날\|최근\|요즘\|21세기\|디지털)\s?[가-힣\s]{0,20}(?:사회\|비즈니스\|시대\|환경\|기업\|세상)(?:에서\|는\|은\|이\|가)[^.!?]{0,60}(?:중요\|필수\|변화하고\|급변\|화두\|주목받)` | | 1/문서 |
| AT-46 | 여닫음 | 훈계 마무리 | S2 | structure | prose,list | 공통 | `closing_moral :: (?:우리\|모두\|우리\s?모두)(?:는\|가\|도\|에게)?\s[^.!?\n]{0,40}?해야\s?(?:할\s?것입니다\|합니다\|한다\|겠습니다)` | | 1/문서 |
| AT-47 | 직역어휘 | 분기 공식 'N 갈래로 갈립니다' | S1 | regex | prose,list | 공통 | `(?:두\|세\|네\|다섯\|여섯\|\d)\s?갈래로\s?(?:갈\|나뉘\|나눠\|나누)` | | |
| AT-48 | 직역어휘 | 축(axis) | S2 | density | prose,list | 공통 | `(?:한\|두\|세\|또\s?하나의\|다른\|중요한\|핵심)\s?축(?:이\|은\|을\|으로\|입니다)` | `(?:x\|y\|X\|Y\|가로\|세로\|회전\|좌표\|그래프\|차트)\s?축` | 2/문서 |
| AT-49 | 직역어휘 | 붙이다(attach) | S2 | density | prose,list | 공통 | `(?:도구\|기능\|모듈\|에이전트\|스킬\|플러그인\|API\|검사기\|훅\|서비스)(?:를\|을)\s?붙(?:입니다\|인다\|여\|이면\|였\|이는)` | | 2/문서 |
| AT-50 | 직역어휘 | 주입(inject) | S2 | density | prose,list | 공통 | `주입(?:한다\|합니다\|된다\|해서\|하여\|하고\|된\|하는\|시킨다\|되어)` | `인젝션\|injection\|공격\|주사\|수액\|연료\|약물` | 1/문서 |
| AT-51 | 직역어휘 | 봉인(seal) | S2 | density | prose,list | 공통 | `봉인(?:한다\|합니다\|된\|하여\|해\|됨\|하고)` | `(?:봉투\|서류\|증거\|문서\|상자)(?:를\|을)\s?봉인` | 2/문서 |
| AT-52 | 직역어휘 | 계약(contract) | S3 | density | prose,list | 공통 | `(?:출력\|응답\|형식\|인터페이스\|API\|스키마\|호출\|타입)\s?계약` | | 2/문서 |
| AT-53 | 직역어휘 | 고아(orphan) | S2 | regex | prose,list | 공통 | `고아\s?(?:노드\|파일\|항목\|페이지\|레코드\|프로세스\|링크\|데이터)\|고아(?:가\|로)\s?(?:된\|남\|되)` | | |
| AT-54 | 직역어휘 | 판정 기준(criteria) | S3 | density | prose,list | 공통 | `판정\s?기준` | | 3/문서 |
| AT-55 | 직역어휘 | '바로 여기에서 시작합니다' | S1 | regex | prose,list | 공통 | `바로\s?(?:여기\|이\s?지점\|이곳\|이\s?순간)(?:에서\|서\|부터)\s?(?:시작\|출발)` | | |
| AT-56 | 직역어휘 | '~에 가깝습니다' | S2 | density | prose,list | 공통 | `(?:에\|과\|와)\s?가깝(?:습니다\|다\|고\|지만\|습니)` | `[\d%]\s?(?:에\|과\|와)?\s?가깝\|(?:거리\|위치\|역\|집\|근처)` | 3/문서 |
| AT-57 | 직역어휘 | 열다/닫다 은유 | S3 | density | prose,list | 공통 | `(?:가능성\|길\|장\|논의\|국면\|여지\|문\|시대)(?:을\|를\|이\|가)\s?(?:열\|닫)(?:었\|린\|힌\|어\|혀\|리\|고)` | | 3/문서 |
| AT-58 | 여닫음 | 장면 헛기침 | S1 | regex | prose,list | 공통 | `(?:여기\|이\s?지점\|이\s?대목)에?\s?(?:중요한\|결정적인\|흥미로운\|재미있는)?\s?(?:장면\|대목\|순간\|포인트)이\s?(?:있\|나옵\|등장\|나타)` | | |
| AT-59 | 구조 | 이모지(줄글) | S2 | structure | prose,list,heading,table | 줄글 | `emoji` | 마지막 세그먼트 | 3/문서 |
| AT-60 | 어휘 | 설명 없는 은유·전문 은어 | S3 | human | prose,list | 공통 | | | |
| AT-61 | 어휘 | 이식 가능한 문장 | S3 | human | prose,list | 공통 | | | |
| AT-62 | 여닫음 | 거짓 통찰 도입 | S2 | regex | prose,list | 공통 | `(?:대부분(?:의\s?(?:사람\|분)들?)?(?:이\|은\|는)?\|많은\s?(?:사람\|분)들?이\|아무도\|누구도)\s?(?:[가-힣]{1,8}\s){0,2}?(?:놓치\|모르\|간과하\|잊\|말해\s?주지\s?않\|알려\s?주지\s?않\|이야기해\s?주지\s?않\|가르쳐\s?주지\s?않\|말하지\s?않\|이야기하지\s?않)는\s?(?:것\|점\|부분\|사실\|비밀\|진실\|이야기\|포인트\|함정)\|잘\s?알려지지\s?않은\s?(?:사실\|비밀\|진실)\|숨겨진\s?(?:비밀\|진실)` | `\d\|%` | 1/문서 |
| AT-63 | 구문 | 사후 의미 부여 | S2 | regex | prose,list | 공통 | `(?:^\|(?<=[.!?]\s))(?:이는\|이것은\|이\s?같은\s?[가-힣]{1,6}(?:은\|는)\|이러한\s?[가-힣]{1,6}(?:은\|는))\s[^.!?\n]{0,50}?(?:보여\s?(?:준다\|줍니다\|주는\|주며\|주고)\|반영(?:한다\|합니다\|하며\|하는)\|방증\|시사(?:한다\|합니다\|하며\|하는)\|상징(?:한다\|합니다\|하며\|하는)\|대변(?:한다\|합니다\|하며\|하는)\|의미(?:한다\|합니다\|하며))\|(?:라는\|다는\|는)\s?점에서\s?(?:큰\s?)?(?:의미\|의의)(?:가\|를)\s?(?:있\|크\|갖\|가진\|지닌)` | `\d\|%` | 1/문서 |
| AT-64 | 부호 | 물음표 극적 공개 | S2 | regex | prose | 줄글 | `(?:^\|(?<=[.!?]\s)(?<!Q\.\s))(?:[가-힣]{1,10}\s){0,2}[가-힣]{1,10}(?:은\|는)\?(?=\s\|$)` | | 2/문서 |
| AT-65 | 여닫음 | 표지 없는 문단 끝 교훈 | S3 | human | prose,list | 공통 | | | |
| AT-66 | 구조 | 세 가지 교훈형 | S2 | human | prose,list,heading | 줄글 | | | |
| AT-67 | 어휘 | 추상 홍보 구문 반복 | S3 | density | prose,list | 공통 | 잠재력을 최대한 끌어내 · 비교할 수 없는 경험 · 매끄러운 경험을 제공 | | 2/문서 |
"""
