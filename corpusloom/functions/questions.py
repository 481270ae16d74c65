"""What a question asks for, as column expressions: its route, whether it needs the fee table, advice, or an act that a
service cannot do. A null question has no hints and asks for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import needs_limit
from .text import hits

# Hints of the two kinds of documents, of tax law, and of what a fee table answers.
INSTITUTIONAL = (
    "퇴직연금 irp dc db 연금저축 중도인출 세액공제 압류 부담금 가입자교육 규약 실물이전 계약이전 디폴트옵션 종합과세 연금수령 과세재원 지연이자 중간정산 임원 "
    "연금소득세 세율 과세 원천징수 isa 사전조회"
).split()
PRODUCT = "펀드 투자신탁 총보수 판매보수 판매수수료 위험등급 환매 기준가 클래스 종류c 설정일 운용사".split()
TAX_LAW = ["저율과세", "부득이한 사유", "부득이한사유", "기타소득세", "과세이연", "해지가산세", "소득세법"]
COMPARE = [
    "이하", "이상", "미만", "초과", "넘는", "안 넘는", "안넘는", "보다 싼", "보다 낮", "보다 높", "보다 비싼", "더 싼", "더 저렴", "더 낮", "더 높", "더 비싼", "어느 쪽이", "비교", "차이", "대비",
    "낮은", "높은", "싼", "저렴", "다른가", "다릅", "다른지", "어느", "중 어", "골라", "고르",
]
SORT = ["가장 싼", "가장 비싼", "가장 낮은", "가장 높은", "가장 저렴", "싼 순", "낮은 순", "높은 순", "비싼 순", "저렴한 순", "제일 싼", "제일 낮은", "제일 저렴", "최저", "최고"]
SUM_UP = ["평균", "몇 개", "몇개", "총 몇", "얼마나 저렴", "얼마나 비싼", "얼마나 차이"]
FEE = ["총보수", "수수료", "보수", "판매보수", "판매수수료"]
CLASS_TRAIT = ["계좌", "판매경로", "연금저축", "퇴직연금", "개인연금", "온라인", "오프라인", "전용", "용 클래스", "용클래스"]
FUND_CODE = r"(?i)\b(KR\d{10}[A-Z0-9]?)\b"
CLASS_CODE = r"(?<![0-9A-Za-z])[ABCRSJ][0-9]?(?:-[A-Za-z][0-9]?[a-z]?)?[a-z]?(?![0-9A-Za-z])"
# Asking for advice, and what narrows it.
ADVICE, ADVICE_ON = r"추천|골라|고르|어떤 상품|뭐가 좋|좋은 상품|무슨 상품", r"연금|펀드|상품|IRP|퇴직|투자"
NARROWED = r"안정|공격|원금|위험|성향|손실|\d+\s*년|\d+\s*세|\d+\s*살|연금저축|IRP|퇴직연금|DC|DB|만원|억|은퇴|노후"
# Asking for an act, and acts and look-ups that need a person's identity.
ASKS = r"해\s?주(세요|실|시)|해\s?줄\s?수|해\s?줘|처리해|발급해|알려\s?주(세요|실|시)|조회해\s?(서|주)|부탁|신청해\s?주"
ACTS = r"비밀번호.{0,6}(초기화|재설정|발급)|임시\s?비밀번호|해지|중도인출\s?신청|이체(해|를|해서)|출금해|매수해|매도해|계좌\s?개설"
LOOKS_UP = r"(제|저희|내|우리|본인)\s?(회사\s?)?[^.\n]{0,12}(계좌|잔액|적립금|수익률|가입\s?(내역|정보)|전화번호|연락처|담당\s?부서)"
NOW, COMPANY = r"실시간으로|지금\s?바로|당장|현재\s?잔고", r"(저희|우리)\s?회사"
# Demands that a refusal answers.
EVASION = ["세법", "세금", "국세청", "탈세", "절세", "규제", "우회", "면제", "신고 안"]
GUARANTEE = ["무조건", "확실하게", "확실히", "보장", "손실", "떨어지지 않", "오른다", "오를 거", "반드시 오", "수익 확정", "위험 얘기"]


def _has(text: Column, words: list[str]) -> Column:
    return F.coalesce(hits(text, words) > 0, F.lit(False))


def _like(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def names_class(text: Column) -> Column:
    return F.coalesce(text.contains("클래스"), F.lit(False)) | _like(text, CLASS_CODE)


def needs_sql(text: Column) -> Column:
    """A class with one of its traits; or a fee that is compared, sorted, summed up, or of a named class or fund."""
    trait = _has(text, CLASS_TRAIT)
    narrowed = _has(text, COMPARE) | _has(text, SORT) | _has(text, SUM_UP) | names_class(text) | trait | _like(text, FUND_CODE)
    return (names_class(text) & trait) | (_has(text, FEE) & narrowed)


def route(text: Column) -> Column:
    """doc_type, hybrid, tax_mix, inst, prod, fund_code, need_sql, need_calc and reason, as one struct. Hints of one kind
    alone, two at least, name the documents; one institutional hint, or hints of both kinds, ask for both; a question of
    tax law does so too, as product documents end with it."""
    inst, prod = (F.coalesce(hits(text, words), F.lit(0)) for words in (INSTITUTIONAL, PRODUCT))
    kind = F.when((inst >= 2) & (prod == 0), F.lit("연금문서")).when((prod >= 2) & (inst == 0), F.lit("투자설명서"))
    alone = (inst == 1) & (prod == 0)
    tax = F.coalesce((kind == "연금문서"), F.lit(False)) & _has(text, TAX_LAW)
    both = (inst >= 1) & (prod >= 1)
    code = F.upper(F.nullif(F.regexp_extract(text, FUND_CODE, 1), F.lit("")))
    sql, calc = needs_sql(text), F.coalesce(needs_limit(text), F.lit(False))
    note = lambda test, words: F.when(test, F.lit(", " + words)).otherwise(F.lit(""))
    reason = F.concat(F.format_string("제도 키워드 %d개 / 상품 키워드 %d개", inst, prod), note(tax, "세법조문(투자설명서 세제부록 포함)"), note(both, "복합"), note(alone, "제도 단독 분할"), note(sql, "SQL 필요"), note(calc, "계산 필요"))
    return F.struct(F.when(~tax, kind).alias("doc_type"), (both | alone | tax).alias("hybrid"), tax.alias("tax_mix"), inst.alias("inst"), prod.alias("prod"), code.alias("fund_code"), sql.alias("need_sql"), calc.alias("need_calc"), reason.alias("reason"))


def advice(text: Column, funds: Column) -> Column:
    """'open' or 'narrowed' for a question that asks for advice and names no product (funds: names that it might hold);
    else null."""
    named = F.coalesce(F.exists(funds, lambda f: (f != "") & text.contains(f)), F.lit(False)) | _like(text, FUND_CODE) | _like(text, CLASS_CODE)
    return F.when(_like(text, ADVICE) & _like(text, ADVICE_ON) & ~named, F.when(_like(text, NARROWED), "narrowed").otherwise("open"))


def unable(text: Column) -> Column:
    """'action' or 'lookup', with 'company' or 'personal', for a request that needs a person's identity; else null."""
    act = _like(text, ACTS)
    look = _like(text, LOOKS_UP) | (_like(text, NOW) & F.coalesce(text.contains("조회"), F.lit(False)))
    kind = F.when(act, F.struct(F.lit("action").alias("kind"), F.lit("personal").alias("where"))).when(look, F.struct(F.lit("lookup").alias("kind"), F.when(_like(text, COMPANY), "company").otherwise("personal").alias("where")))
    return F.when(_like(text, ASKS), kind)


def refusal(text: Column, base: str, tax: str, guarantee: str, tail: str) -> Column:
    """The lines of a refusal: the base, then what the question demands, or else the tail."""
    evades, assures = _has(text, EVASION), _has(text, GUARANTEE)
    return F.concat_ws("\n", F.lit(base), F.when(evades, F.lit(tax)), F.when(assures, F.lit(guarantee)), F.when(~evades & ~assures, F.lit(tail)))
