"""Word lists, patterns, labels and messages that results depend on.

Patterns are Java regular expressions. ``(?U)`` gives white space, digits, words and
word boundaries their Unicode meaning, ``(?iu)`` ignores case.
"""

# ---- pages ----

DELETION_PATTERN = (
    r"(?iuU)삭제된\s*(?:글|톡|게시[물글]?)"
    r"|이미\s*삭제"
    r"|이\s*글을\s*볼\s*권한"
    r"|접근\s*권한이?\s*없"
    r"|신고에?\s*의해\s*삭제"
    r"|숨김\s*처리된\s*(?:글|게시[물글]?)"
    r"|글쓴이에?\s*의해\s*삭제"
    r"|존재하지\s*않는\s*(?:글|게시물|게시글|페이지)"
    r"|글이?\s*존재하지\s*않"
    r"|(?:글|게시물|게시글|페이지|주소)[을를이가]?\s*찾을\s*수\s*없(?:는|습)"
    r"|(?:신고|운영자|운영진|관리자|다수\s*신고)[로은는이가]?\s*(?:에\s*의해\s*)?차단된\s*(?:글|게시[물글]?)"
    r"|차단된\s*(?:글|게시[물글]?)\s*(?:입니다|이에요|예요|이다)"
    r"|블라인드\s*처리(?:된|됨|되었|됐)"
    r"|deleted\s+(?:post|by)"
)
BLOCKED_PATTERN = (
    r"(?iuU)(?:글|게시물|게시글|내용|본문)[을를이가]?\s*(?:보|열람|확인)\S{0,4}\s*(?:려면|시려면|기\s*위해|위해서?)?\s*로그인"
    r"|로그인\s*(?:후|하셔야|해야)\S{0,6}\s*(?:열람|볼\s*수|보실\s*수)"
    r"|회원(?:만|\s*전용|\s*등급)\S{0,4}\s*(?:열람|볼\s*수)"
    r"|가입자\s*전용"
    r"|성인\s*인증"
)
CHALLENGE_PATTERN = (
    r"(?iuU)보안\s*시스템"
    r"|잠시[^<]{0,12}기다리[^<]{0,40}자동"
    r"|Just\s+a\s+moment"
    r"|Checking\s+(?:if\s+the\s+site\s+connection\s+is\s+secure|your\s+browser)"
    r"|Attention\s+Required|cf-browser-verification|DDoS\s+protection\s+by"
    r"|Enable\s+JavaScript\s+and\s+cookies\s+to\s+continue"
    r"|로딩\s*중\b|loading\s*\.\.\.|spinner\b"
)
UNTRACKABLE_DOMAINS = ["fmkorea.com", "issuefeed.dcinside.com"]
UNTRACKABLE_REASON = "봇 차단 — 삭제 추적 불가"
BOT_BLOCK_CODES = [403, 429, 430, 503]
HARD_CODES = [404, 410]
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "igshid", "ref", "ref_src", "spm", "fromrss", "from",
]
REASON_403 = "HTTP 403 (접근 거부·안티봇 가능)"
REASON_DELETED = "삭제 표식: "
REASON_NEWLY_DELETED = "삭제 표식 새로 등장: "
REASON_MOVED = "게시물 사라짐·메인 리다이렉트: "
REASON_NEWLY_BLOCKED = "차단 표식 새로 등장: "
REASON_COLLAPSED = ("본문 급감 ", "→", "자")

# ---- deletion risk ----

SOURCE_RISK = [
    ("teamblind.com", "high"),
    ("blind.com", "high"),
    ("pann.nate.com", "high"),
    ("nate.com", "high"),
    ("dcinside.com", "high"),
    ("fmkorea.com", "high"),
    ("theqoo.net", "medium"),
    ("instiz.net", "medium"),
    ("bobaedream.co.kr", "medium"),
    ("clien.net", "medium"),
    ("mlbpark.donga.com", "medium"),
    ("ruliweb.com", "low"),
    ("ppomppu.co.kr", "low"),
    ("inven.co.kr", "low"),
]
ACCUSATION = (
    r"(?U)갑질|폭언|폭행|횡령|탈세|배임|비리|뇌물|담합|불법|위법|은폐|조작|분식|"
    r"성추행|성폭행|성희롱|성범죄|강제추행|몰카|불법촬영|"
    r"마약|대마|음주운전|음주\s*뺑소니|"
    r"임금\s*체불|체불|하청\s*갑질|단가\s*후려치|납품\s*갑질|"
    r"내부\s*고발|제보|폭로|고발|의혹|논란|규탄|"
    r"사기|먹튀|보복|괴롭힘|따돌림|직장\s*내\s*괴롭힘|"
    r"데이트\s*폭력|가정\s*폭력|학교\s*폭력|학폭"
)
ENTITY = (
    r"(?U)대기업|재벌|오너|회장|부회장|사장|대표이사|대표\b|임원|상무|전무|이사\b|본부장|"
    r"㈜|주식회사|\(주\)|법인|원장|교수|의사\b|변호사|국회의원|시의원|공무원|"
    r"\b[가-힣]{2,}그룹\b|\b[가-힣]{2,}전자\b|\b[가-힣]{2,}건설\b|\b[가-힣]{2,}제약\b|"
    r"프랜차이즈|본사|가맹|갑\s*회사|원청"
)
WHISTLEBLOWER = (
    r"(?U)내부\s*고발|제보(?:합니다|드립니다|글|자)|블라인드(?:에|글|함)|직장\s*동료|"
    r"전\s*직원|현\s*직원|퇴사(?:하면서|하고|자)|재직\s*중|사내|회사에서"
)
PRESSURE = (
    r"(?U)신상\s*(?:털|공개|박제)|좌표|"
    r"연락(?:이|\s*が)?\s*(?:왔|옴|받았)|"
    r"내리라(?:고|는)?|내려\s*달라|삭제\s*(?:해\s*달라|요청|압박|하래|하라고|당)|"
    r"캡처\s*(?:해|떠|필수|박제)|증거\s*인멸|박제\s*각|"
    r"퍼\s*날라|퍼가|빨리\s*저장|사라지기\s*전|지워지기\s*전|곧\s*삭제"
)
LEGAL = (
    r"(?U)명예\s*훼손|고소(?:하겠|장|당|함|미아)|고발(?:하겠|당|장)|"
    r"법적\s*(?:대응|조치|책임)|손해\s*배상|정정\s*보도|"
    r"내용\s*증명|변호사\s*(?:선임|통해|상담)|법무\s*법인|소송"
)
DURABLE = r"(?U)미담|훈훈|감동|선행|미소|따뜻|위로|응원\s*글|개념글|명작|레전드|박제\s*하고\s*싶"
RISK_WEIGHTS = {
    "entity_accusation": 4,
    "accusation": 2,
    "entity": 1,
    "whistleblower": 2,
    "pressure": 3,
    "legal": 1,
    "source_high": 2,
    "source_medium": 1,
    "source_unknown": 1,
    "fresh_24h": 2,
    "fresh_72h": 1,
    "kindness_penalty": 2,
}
RISK_SIGNALS = {
    "entity_accusation": "기업·실명+고발 어휘",
    "accusation": "고발·폭로 어휘",
    "entity": "기업·권력자 지목",
    "whistleblower": "내부고발·제보성",
    "pressure": "삭제 압박·자삭 정황",
    "legal": "법적 대응 언급",
    "source": "삭제 잦은 게시판",
    "fresh": "갓 올라온 글",
}

# ---- personal identifiers ----

PII_DETECTORS = [
    ("rrn", r"(?U)\b\d{6}\s*-?\s*[1-8]\d{6}\b"),
    ("mobile", r"(?U)\b01[016-9][-\s.]?\d{3,4}[-\s.]?\d{4}\b"),
    ("landline", r"(?U)\b0(?:2|[3-6][1-5])[-\s.]\d{3,4}[-\s.]\d{4}\b"),
    ("email", r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("card", r"(?U)\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b"),
    (
        "account",
        r"(?U)(?:계좌|입금|송금|이체|은행|농협|국민|신한|우리|하나|기업|카카오\s*뱅크|토스)"
        r"[^\n]{0,12}?\b\d{2,6}[-\s]\d{2,6}[-\s]\d{2,7}\b",
    ),
    ("long_digits", r"(?U)\b\d{11,}\b"),
]
PII_CHUNK, PII_OVERLAP = 4000, 128

# ---- search results ----

NEWS_PATTERN = (
    r"(?iuU)\[(?:속보|단독|종합|특보|특집|기획|르포|분석|사설|칼럼|인터뷰|이슈|화제|영상|사진|뉴스|기자수첩)\]"
    r"|\b\S{2,4}\s*(?:기자|에디터|특파원|논설위원)\b"
    r"|(?:기자|에디터|reporter|editor)\s*[:=\(\[\]]"
    r"|[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}"
    r"|(?:뉴스1|연합뉴스|뉴시스|YTN|SBS\s?뉴스|KBS\s?뉴스|MBC\s?뉴스|JTBC|TV조선|MBN|채널A"
    r"|조선일보|중앙일보|동아일보|한겨레|경향신문|국민일보|문화일보|세계일보|서울신문"
    r"|매일경제|한국경제|머니투데이|이데일리|아시아경제|파이낸셜뉴스|디지털타임스"
    r"|오마이뉴스|프레시안|미디어오늘|디스패치|일요신문|스포츠조선|스포츠동아)"
)
NEWS_URL_PARTS = [
    "mid=news", "mid=hotnews", "mid=politics_news",
    "/news/", "/article/news", "/article_view",
    "category=news", "cate=news", "issuefeed",
]
OFF_TOPIC = (
    r"(?U)보이스\s?피싱|스미싱|피싱|사기(?:꾼|범|단|당|\s?쳐|\s?피해|\s?행각)|"
    r"스토킹|스토커|협박|공갈|갈취|몰카|몰래카메라|"
    r"괴담|무서운\s*이야기|소름|귀신|미스터리|"
    r"빌려준\s*돈|빌려줬다|빌린\s*돈|떼인\s*돈|돈\s*떼|먹튀|갚지\s*(?:않|못)|안\s*갚|"
    r"잡아\s?주세요|도와\s?주세요|찾아\s?주세요|"
    r"상담|하소연|고민\s*있|고민입니다|고소|소송|법적\s*대응"
)
RESCUE = (
    r"도와줬|도와주신|도와주셔|도와준|구해줬|구해주신|구해준|되찾아|돌려줬|돌려주신|돌려준|"
    r"지켜줬|지켜준|막아줬|막아준|찾아줬|찾아주신|찾아준|양보|기부|선행|베풀|베푼|"
    r"챙겨줬|챙겨주신|챙겨준|데려다|일으켜|들어줬|씌워줬|업어|업고"
)
TITLE_PREFIX = r"(?U)^\s*\[[^\]\n]{1,15}\]\s*"
TITLE_SUFFIX = (
    r"(?iuU)\s*[-–|]\s*(에펨코리아|더쿠|클리앙|블라인드|블라인드라이트|디시인사이드|네이트\s*판|"
    r"보배드림|인스티즈|루리웹|뽐뿌|pann|FM코리아|theqoo|teamblind|보배|디시)[^\n]*$"
)
NO_RESULTS = "(검색 결과 없음)"
CONTEXT_TITLE, CONTEXT_BODY = "제목: ", "    내용: "

# ---- generated text ----

USED_SOURCES = r"(?imdU)\s*USED_SOURCES[ \t]*[:=][ \t]*\[?([0-9,\s]*)\]?\s*$"
USED_SOURCES_STRIP = r"(?i)USED_SOURCES[ \t]*[:=][ \t]*\[?[0-9,\t ]*\]?[^\n]*"
SCORE_LINE = r"(?imduU)^\s*(?:휘발성\s*점수|휘발성점수)\s*[:=]\s*(\d+)\s*$"
REASON_LINE = r"(?imduU)^\s*(?:박제\s*사유|박제사유)\s*[:=]\s*(.+?)\s*$"
META_PREFIX = (
    r"(?imduU)^\s*(?:검색\s*결과(?:에\s*따르면|의?\s*\d+\s*번을?\s*(?:선택|골라)\S*)?"
    r"|다음(?:은|과)\s+같이"
    r"|아래(?:는|와)\s+같이"
    r"|아래\s+검색\s*결과"
    r"|네[,.]?\s*"
    r"|네\s*알겠습니다"
    r")[^\n]*\n+"
)
BOLD = r"\*\*([^*\n]+?)\*\*"
UNDERSCORE = r"__([^_\n]+?)__"
ITALIC = r"(?U)(?<![*\w])\*([^*\n]+?)\*(?![*\w])"
HEADER = r"(?md)^#{1,6}[ \t]+"
RULE = r"(?md)^[ \t]*(?:-{3,}|={3,}|\*{3,})[ \t]*$"
HANJA = "[一-鿿]{2,}"
KANA = "[぀-ゟ゠-ヿ]+"
CAPS = r"(?U)\b[A-Z]{2,}(?:\s+[A-Z]{2,})+\b"
TAIL = r"(?md)^[ \t]*(?:오늘의[ \t]*한[ \t]*줄[ \t]*[:：]|※)"
NO_FIT_MARKS = ["NO_FIT", "NOFIT"]
NO_FIT_WRAP = r"""(?U)^[\s"'`*\-\[\(]+"""
NO_FIT_PROSE = (
    r"(?dU)(적합한|해당하는|관련된|마땅한)\s*(글|사연|미담|내용|제보|이야기)"
    r"[^\n]{0,10}?"
    r"(없습니다|없음|없어요|없네요|찾을\s*수\s*없\S*|찾지\s*못\S*)"
    r"\s*[.。!]?\s*$"
)
STORY_HEADERS = {"kindness": "[ 따뜻한 선행 이야기 ]", "critique": "[ 인류애가 흔들리는 대기업 사건 ]"}

# ---- feeds ----

FEED_REGISTRY = [
    ("ppomppu.co.kr", "http://www.ppomppu.co.kr/rss.php?id=ppomppu"),
    ("ppomppu.co.kr", "http://www.ppomppu.co.kr/rss.php?id=freeboard"),
    ("ruliweb.com", "https://bbs.ruliweb.com/news/rss"),
    ("mlbpark.donga.com", "https://mlbpark.donga.com/mp/rss.php"),
    ("inven.co.kr", "https://www.inven.co.kr/webzine/news/rss.php"),
    ("clien.net", "https://www.clien.net/service/board/park"),
    ("bobaedream.co.kr", "https://bobaedream.co.kr/list?code=freeb"),
]
CLIEN_ITEM = r'(?s)href="(/service/board/park/\d+[^"]*)"[^>]*>.*?title="([^"]+)"'
BOBAE_ITEM = r'(?s)<a\s+class="bsubject"[^>]*href="(/view\?[^"]*No=(\d+)[^"]*)"[^>]*>(.*?)</a>'
ENTRY_LABELS = {"kindness": "따뜻한 선행", "other": "인류애가 흔들리는 사건"}
ENTRY_CAPTURED = "🪦 삭제된 원본을 살아있을 때 박제"
ENTRY_ARCHIVED = "🗄 Arweave 박제됨"
ENTRY_SOURCES = "참고 출처:"
ENTRY_ORIGINAL = "🗄 Arweave 영구 박제 원본 보기"
SNAPSHOT_FOUND = "기존 스냅샷"
