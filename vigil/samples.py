"""Literal case rows: inputs with the results that the rules give them.

The driver's tables hold no Korean text, so queries of the Korean word lists add these
rows, and tests check them one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_text(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: title, body, url, category, age in hours, then score, hard, signals and category by the text
RISK = [
    ("제보합니다", "대기업 임원 갑질 내부 고발입니다. 곧 삭제 당할 것 같습니다", "https://www.teamblind.com/p/1", "critique", None, 10, True, "기업·실명+고발 어휘|내부고발·제보성|삭제 압박·자삭 정황|삭제 잦은 게시판", "critique"),
    ("훈훈한 이야기", "지하철에서 도와준 분께 감동", "https://www.ppomppu.co.kr/1", "kindness", None, 0, False, "", "kindness"),
    ("그냥 글", "글이 곧 삭제 될 것 같아 빨리 저장", "https://example.com/", "critique", None, 4, True, "삭제 압박·자삭 정황", "kindness"),
    ("사장 갑질", "본사 횡령", "https://theqoo.net/1", "kindness", None, 1, True, "기업·실명+고발 어휘", "critique"),
    ("사장 갑질", "본사 횡령", "https://theqoo.net/1", "critique", 3.0, 7, True, "기업·실명+고발 어휘|갓 올라온 글", "critique"),
    ("횡령 의혹", None, "https://clien.net/1", "critique", 60.0, 4, False, "고발·폭로 어휘", "critique"),
    (None, "명예 훼손 고소하겠다고 합니다", "", "critique", 80.0, 2, True, "법적 대응 언급", "kindness"),
    ("교수님 미담", "감동", "https://nate.com/1", "kindness", None, 0, False, "기업·권력자 지목|삭제 잦은 게시판", "kindness"),
]

_OBS = "net http_code final_url text_len text_hash del_match blk_match del_snip blk_snip bot_challenge reason".split()
_BASE = "captured final_url len hash del_match blk_match".split()
_URL = "https://b.example/post/1"
_LIVE = dict(captured=True, final_url=_URL, len=1000, hash="h0", del_match=False, blk_match=False)


def _ok(**change) -> dict:
    return dict(net="ok", http_code=200, final_url=_URL, text_len=1000, text_hash="h1", del_match=False, blk_match=False, del_snip="", blk_snip="", bot_challenge=False, reason=None) | change


#: observation, baseline or None, then status and reason
VERDICTS = [
    (dict(net="unsafe", reason="private"), None, "error", "private"),
    (dict(net="unsafe"), _LIVE, "error", "unsafe_url"),
    (dict(net="timeout"), None, "error", "timeout"),
    (dict(net="neterr", reason="reset"), _LIVE, "error", "reset"),
    (dict(net="redirect_loop"), None, "error", "too_many_redirects"),
    (dict(net="http", http_code=404), None, "deleted", "HTTP 404"),
    (dict(net="http", http_code=410), _LIVE, "deleted", "HTTP 410"),
    (dict(net="http", http_code=403), _LIVE, "error", "HTTP 403 (접근 거부·안티봇 가능)"),
    (dict(net="http", http_code=500), None, "error", "HTTP 500"),
    (_ok(bot_challenge=True, del_match=True), _LIVE, "error", "봇 차단 — 삭제 추적 불가"),
    (_ok(del_match=True, del_snip="삭제된 글"), None, "deleted", "삭제 표식: 삭제된 글"),
    (_ok(blk_match=True), None, "live", None),
    (_ok(), None, "live", None),
    (_ok(text_hash="h0", del_match=True), _LIVE, "live", None),
    (_ok(del_match=True, del_snip="이미 삭제"), _LIVE, "deleted", "삭제 표식 새로 등장: 이미 삭제"),
    (_ok(del_match=True), _LIVE | dict(del_match=True), "live", None),
    (_ok(final_url="https://www.b.example/?utm_source=x"), _LIVE, "deleted", "게시물 사라짐·메인 리다이렉트: https://www.b.example/?utm_source=x"),
    (_ok(final_url="https://m.b.example/post/1/?ref=z#top"), _LIVE, "live", None),
    (_ok(final_url="https://b.example/other"), _LIVE, "live", None),
    (_ok(blk_match=True, blk_snip="성인 인증"), _LIVE, "blocked", "차단 표식 새로 등장: 성인 인증"),
    (_ok(text_len=349), _LIVE, "deleted", "본문 급감 1000→349자"),
    (_ok(text_len=350), _LIVE, "live", None),
    (_ok(text_len=1), _LIVE | dict(len=799), "live", None),
    (_ok(text_len=1), _LIVE | dict(len=800), "deleted", "본문 급감 800→1자"),
    (_ok(del_match=None, blk_match=None, bot_challenge=None), _LIVE | dict(del_match=None), "live", None),
]


def verdict_rows(spark: SparkSession) -> DataFrame:
    """case_id, url, obs and base of ``VERDICTS``."""
    rows = [(i, _URL, tuple(o.get(k) for k in _OBS), tuple(b[k] for k in _BASE) if b else None) for i, (o, b, *_) in enumerate(VERDICTS)]
    obs = "struct<net:string,http_code:int,final_url:string,text_len:int,text_hash:string,del_match:boolean,blk_match:boolean,del_snip:string,blk_snip:string,bot_challenge:boolean,reason:string>"
    base = "struct<captured:boolean,final_url:string,len:int,hash:string,del_match:boolean,blk_match:boolean>"
    return spark.createDataFrame(rows, f"case_id int, url string, obs {obs}, base {base}")


#: raw text, what cleaning makes of it, what tidying makes of it
GENERATED = [
    ("네, 알겠습니다.\n\n**굵은** 글과 __밑줄__ 글.", "굵은 글과 밑줄 글.", "네, 알겠습니다. **굵은** 글과 __밑줄__ 글."),
    ("# 제목\n본문 *기울임* 입니다.\n---\n끝.", "제목 본문 기울임 입니다.\n\n끝.", "# 제목 본문 *기울임* 입니다. --- 끝."),
    ("한국 中國 사람 かな 글 SOUTH KOREA 이다. KTX 는 남는다 .", "한국 사람 글 이다. KTX 는 남는다.", "한국 中國 사람 かな 글 SOUTH KOREA 이다. KTX 는 남는다 ."),
    ("같은 문장이다. 같은 문장이다.\n다른 문장이다!\n오늘의 한 줄: 고맙다", "같은 문장이다. 같은 문장이다.\n다른 문장이다!\n오늘의 한 줄: 고맙다", "같은 문장이다. 다른 문장이다!\n오늘의 한 줄: 고맙다"),
    ("", "", ""),
]

#: raw text, number of sources, then indices, text, score, reason and refusal
MARKERS = [
    ("이야기다.\n휘발성 점수: 9\n박제 사유: 사라질 글\nUSED_SOURCES: 2, 1, 2, 7", 3, [2, 1], "이야기다.", 9, "사라질 글", False),
    ("이야기다.", 3, [], "이야기다.", 0, "", False),
    ("NO_FIT", 3, [], "NO_FIT", 0, "", True),
    ("**[no fit]** 이유", 3, [], "**[no fit]** 이유", 0, "", True),
    ("- NO_FIT", 2, [], "- NO_FIT", 0, "", True),
    ("적합한 글이 없습니다.", 2, [], "적합한 글이 없습니다.", 0, "", True),
    ("마땅한 사연 없을 줄 알았던 골목에서 만난 사람 이야기", 2, [], "마땅한 사연 없을 줄 알았던 골목에서 만난 사람 이야기", 0, "", False),
    ("글\nused_sources = [1]", 1, [1], "글", 0, "", False),
]

#: title, url, content, then news and off topic
RESULTS = [
    ("[속보] 큰일", "https://a.example/1", "내용", True, False),
    ("동네 이야기", "https://a.example/news/2", "내용", True, False),
    ("동네 이야기", "https://gall.issuefeed.dcinside.com/3", "", True, False),
    ("동네 이야기", "https://a.example/4", "김철수 기자 = 오늘", True, False),
    ("동네 이야기", "https://a.example/5", "길에서 넘어진 할머니를 일으켜 드린 학생을 보았습니다. 비가 오는 날이었는데 우산까지 내주고 말없이 뛰어갔습니다. 오래 기억에 남을 것 같아 적어 둡니다. 고맙습니다.", False, False),
    ("보이스피싱 당했어요", "https://a.example/6", "도와주세요", False, True),
    ("보이스피싱 막아준 직원", "https://a.example/7", "은행에서 막아줬습니다", False, False),
]


def payloads() -> list[tuple[str, str, bytes]]:
    """source, feed and bytes of feed documents of every kind."""
    rss = '<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><item><title>첫 글</title><link>https://a.example/1</link><guid>g1</guid><description>&lt;b&gt;요약&lt;/b&gt; 글</description></item><item><title>둘</title><guid>https://a.example/2</guid></item><item><title>셋</title><link>ftp://no</link></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Atom</title><link href="https://b.example/1"/><id>tag:1</id><summary>s</summary></entry></feed>'
    clien = '<a class="x" href="/service/board/park/123?od=T" data-x="1">\n<span title="공원 글">공원</span></a>'
    bobae = '<a class="bsubject" href="/view?code=freeb&No=77&bm=1" title="제목 속성">제목 <b>본문</b></a><a class="bsubject" href="/view?code=freeb&No=78">글 <b>둘</b></a>'
    return [
        ("a", "xml-rss", bytearray(rss.encode())),
        ("b", "xml-atom", bytearray(atom.encode())),
        ("c", "xml-bad", bytearray(b"<rss><item>")),
        ("clien.net", "clien", bytearray(clien.encode())),
        ("bobaedream.co.kr", "bobae", bytearray(bobae.encode())),
    ]
