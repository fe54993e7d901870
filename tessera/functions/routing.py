"""Understanding of questions: search strategy, gates of the rule tables, and what a question asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals in questions.
STRUCTURED = (
    r"제\s*\d+\s*조|제\s*\d+\s*[장절편항호]|부칙|별표\s*\d+|\d+\.\d+[\.\d]*\s*[장절항호]?"
    r"|서식\s*\d+|양식\s*\d+|표\s*\d+|그림\s*\d+|[Ss]ection\s*\d+|[Cc]hapter\s*\d+"
)
PROCEDURE_STRONG = r"방법|절차|신청|청구|접수|제출|하려면|하려고|해야\s*하나|순서|과정|단계|how\s+to|steps?|process|procedure"
PROCEDURE_WEAK = r"어떻게|가입"
INTERPRETATION_FIRST = r"정의|계산|산정|산출|의미|뜻|해석|되나요|수\s*있나"
COMPARISON = r"비교|차이|다른\s*점|구별|구분|vs|versus|다른가|뭐가\s*달라|differ|compare|distinction"
INTERPRETATION = (
    r"해석|의미|뜻|정의|판단|적용|해당|간주|해석상|계산|산정|산출|경우에|경우는|때는|하면|되나요|가능한가요|가능합니까|수\s*있나"
    r"|허용되나|인정되나|포함되나|대상인가|what\s+does|mean|apply|eligible|qualify|보장되나|보장이\s*되나|나오나요|받을\s*수\s*있나|면책|지급되나"
)
GATES = {
    "payout": r"얼마|금액|지급률|지급액|몇\s*(?:퍼센트|%|프로)|퍼센트|감액|하루\s*얼마|매월\s*얼마",
    "terms": r"청약\s*철회|철회|갱신|만기|자동\s*갱신|언제까지|며칠\s*이내",
    "coverage": r"보장\s*(?:되|돼|받|하|해|여|가능|범위|여부)|보상\s*(?:되|돼|받)",
    "exclusion": r"면책|지급.{0,3}(?:안|하지\s*않|되지\s*않|제외)|보장.{0,3}(?:안|되지\s*않|제외)|보상.{0,3}(?:안|않)|안\s*(?:되는|받는).{0,4}(?:경우|사유|때)|제외.{0,3}(?:사유|되는|경우)",
}
PAYOUT_COVERAGES = ["중환자실", "레진", "아말감", "인레이", "제자리암", "암진단자금", "소득보장"]
TERMS_COVERAGES = ["중환자실", "레진", "치아", "충치", "제자리암", "암진단자금", "소득보장", "입원"]
COVERAGE_HINTS = [("제자리암", "제자리암진단자금"), ("경계성종양", "경계성종양진단자금"), ("경계성", "경계성종양진단자금"), ("암", "암진단자금")]
DISEASE_CODES = [
    ("갑상선암", "C73"), ("자궁경부암", "C53"), ("자궁체부암", "C54"), ("전립선암", "C61"), ("다발골수종", "C90"), ("비인두암", "C11"), ("담도암", "C24"), ("식도암", "C15"),
    ("유방암", "C50"), ("위암", "C16"), ("폐암", "C34"), ("간암", "C22"), ("대장암", "C18"), ("직장암", "C20"), ("췌장암", "C25"), ("신장암", "C64"),
    ("방광암", "C67"), ("난소암", "C56"), ("후두암", "C32"), ("구강암", "C06"), ("뇌종양", "C71"), ("뇌암", "C71"), ("백혈병", "C95"), ("림프종", "C85"),
    ("흑색종", "C43"), ("피부암", "C44"), ("설암", "C02"), ("골육종", "C41"), ("제자리암", "D05"), ("상피내암", "D05"), ("경계성종양", "D41"), ("암", "C50"),
]
CAUSES = [(r"재해\s*(?:가\s*)?(?:아닌|이외|제외|아니)", "질병"), (r"질병|병으로|아파", "질병"), (r"재해|상해|다쳐|사고", "상해")]
AGES = [(r"15세\s*이상|성인", "15세이상"), (r"15세\s*미만|어린|아동", "15세미만")]
PERIODS = [(r"90일\s*(이내|안|이하|전)", "90일이하"), (r"1년\s*(지나|이상|후|넘)", "1년이상"), (r"90일.*1년|1년.*90일|반년|몇\s*달", "90일초과1년미만")]
EXCLUSION_TAGS = [
    ("고의", ["고의로"]), ("임신출산", ["임신", "출산", "산후"]), ("전쟁내란", ["전쟁", "무력행사", "혁명", "내란", "사변", "폭동"]),
    ("위험활동", ["전문등반", "글라이더", "스카이다이빙", "행글라이딩", "전문적인 등산", "모터보트", "자동차경기"]), ("무면허운전", ["무면허"]),
    ("음주운전", ["음주운전", "주취운전", "주취 상태"]), ("직업위험", ["직업, 직무", "직무 또는 동호회"]),
]
# Words of the subject, by which questions are told into segments.
SEGMENT = ["소득보장수술", "중환자실", "간병인", "입원급여금", "입원비보험", "충치", "치아우식증", "특약", "준용", "갱신", "해약환급금", "감액", "연체", "청약철회", "면책", "담보"]



def classify(question: Column) -> Column:
    """struct<strategy, query_type, dense_factor, bm25_factor> by the decision table of signals."""
    structured, strong, weak = question.rlike(STRUCTURED), question.rlike(PROCEDURE_STRONG), question.rlike(PROCEDURE_WEAK)
    procedure = strong | (weak & ~question.rlike(INTERPRETATION_FIRST))
    comparison, interpretation = question.rlike(COMPARISON), question.rlike(INTERPRETATION)
    semantic = procedure | comparison | interpretation
    mixed_type = F.when(procedure, "procedure").when(comparison, "comparison").otherwise("interpretation")
    plain_type = F.when(comparison, "comparison").when(procedure, "procedure").when(interpretation, "interpretation").otherwise("simple_fact")
    kind = F.when(structured & ~semantic, "structured_lookup").when(structured, mixed_type).otherwise(plain_type)
    strategy = F.when(structured & ~semantic, "bm25_heavy").when(~structured & semantic, "dense_heavy").otherwise("hybrid")
    factor = lambda bm25, dense: F.when(strategy == "bm25_heavy", bm25).when(strategy == "dense_heavy", dense).otherwise(6)
    return F.struct(strategy.alias("strategy"), kind.alias("query_type"), factor(3, 8).alias("dense_factor"), factor(8, 3).alias("bm25_factor"))


def gate(name: str, question: Column) -> Column:
    return question.rlike(GATES[name])


def first_match(text: Column, pairs: list[tuple[str, str]], pattern: bool = False) -> Column:
    """Value of the first pair whose key is in the text (or matches it); null if none."""
    test = (lambda k: text.rlike(k)) if pattern else (lambda k: text.contains(k))
    return reduce(lambda out, kv: out.when(test(kv[0]), kv[1]), pairs[1:], F.when(test(pairs[0][0]), pairs[0][1]))


def keyword(text: Column, words: list[str]) -> Column:
    return first_match(text, [(w, w) for w in words])


def payout_intent(question: Column) -> dict[str, Column]:
    return {
        "coverage": keyword(question, PAYOUT_COVERAGES),
        "cause": first_match(question, CAUSES, pattern=True),
        "age_band": first_match(question, AGES, pattern=True),
        "period_bucket": first_match(question, PERIODS, pattern=True),
    }


def disease_code(question: Column) -> Column:
    """A code written in the question, else that of the first disease named."""
    written = F.regexp_extract(question, r"[A-Z]\d{2}(?:\.\d)?", 0)
    return F.coalesce(F.nullif(written, F.lit("")), first_match(question, DISEASE_CODES))


def exclusion_tags(body: Column) -> Column:
    """Standard reasons that a clause names, sorted."""
    tags = [F.when(reduce(lambda a, b: a | b, (body.contains(w) for w in words)), F.lit(tag)) for tag, words in EXCLUSION_TAGS]
    return F.array_sort(F.array_compact(F.array(*tags)))


def signal(score: Column) -> Column:
    return F.when(score >= 0.7, "up").when(score >= 0.4, "reformulated").otherwise("down")


def context_budget(prompt_tokens: Column) -> Column:
    return F.lit(8192 - 2048 - 256) - prompt_tokens


def segment(question: Column, words: list[str] = SEGMENT) -> Column:
    """domain if the question has any of the words, else general."""
    return F.when(reduce(lambda a, b: a | b, (question.contains(w) for w in words)), "domain").otherwise("general")
