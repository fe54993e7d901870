"""Guards on texts: personal data is masked, injection attempts and leaks of role tokens are flagged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data, in the order in which they are masked.
PII = {
    "RRN": r"\b\d{6}[-\s]?[1-8]\d{6}\b",
    "CARD": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,7}\b",
    "ACCOUNT": r"\b\d{3}[-\s]\d{2,6}[-\s]\d{6,}\b",
    "PHONE": r"\b01[016-9][-\s]?\d{3,4}[-\s]?\d{4}\b",
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
}
# Patterns of prompt injection; a label is the pattern's first 40 characters.
INJECTION = [
    (r"이전\s*(지시|지침|명령|프롬프트)(\s+\S+){0,3}\s*(무시|잊|ignore)", "i"),
    (r"(ignore|disregard|forget)(\s+\S+){0,3}\s+(instructions?|prompts?|rules?)", "i"),
    (r"^\s*(system|assistant|user)\s*:\s*", "mi"),
    (r"<\|im_(start|end)\|>", ""),
    (r"\[INST\]|\[/INST\]", ""),
    (r"<\|endoftext\|>", ""),
    (r"</?(context|system|instructions?|admin)>", "i"),
]
INVISIBLE = "[​‌‍﻿⁠᠎]"
# Patterns that answers must not show, and words that are flagged; labels have 30 characters of the pattern.
LEAKS = [
    (r"<\|im_(start|end)\|>", ""),
    (r"\[INST\]|\[/INST\]", ""),
    (r"<\|endoftext\|>", ""),
    (r"^\s*(system|assistant)\s*:\s*", "mi"),
]
PROFANITY = r"(시발|씨발|개새끼|병신|좆|fuck|shit)"


def _flagged(pattern: str, flags: str) -> str:
    return f"(?{flags}){pattern}" if flags else pattern


def mask_pii(text: Column) -> tuple[Column, Column]:
    """The text with each kind of personal data replaced by its marker, and the kinds found, sorted. Null: '' and none."""
    masked, kinds = F.coalesce(text, F.lit("")), []
    for kind, pattern in PII.items():
        pattern = "(?U)" + pattern
        kinds.append(F.when(masked.rlike(pattern), F.lit(kind)))
        masked = F.regexp_replace(masked, pattern, f"[{kind}_MASKED]")
    return masked, F.array_sort(F.array_compact(F.array(*kinds)))


def mask_pii_each(items: Column) -> tuple[Column, Column]:
    """The same for an array of texts: masked items, and the kinds of all."""
    kinds = F.transform(items, lambda t: mask_pii(t)[1])
    return F.transform(items, lambda t: mask_pii(t)[0]), F.array_sort(F.array_distinct(F.flatten(kinds)))


def sanitize_input(query: Column) -> tuple[Column, Column]:
    """The query without invisible characters, and labels of what looks like injection; nothing else is taken out."""
    labels = [F.when(query.rlike(_flagged(p, f)), F.lit(f"injection:{p[:40]}")) for p, f in INJECTION]
    labels.append(F.when(query.rlike(INVISIBLE), F.lit("zero_width_chars")))
    return F.regexp_replace(query, INVISIBLE, ""), F.array_compact(F.array(*labels))


def sanitize_output(answer: Column) -> tuple[Column, Column]:
    """The answer without leaked role tokens, each looked for in what the last left, and labels; profanity stays."""
    labels = []
    for pattern, flags in LEAKS:
        pattern, label = _flagged(pattern, flags), f"output_leak:{pattern[:30]}"
        labels.append(F.when(answer.rlike(pattern), F.lit(label)))
        answer = F.regexp_replace(answer, pattern, "")
    labels.append(F.when(answer.rlike("(?i)" + PROFANITY), F.lit(f"profanity:{PROFANITY[:30]}")))
    return answer, F.array_compact(F.array(*labels))


def guard_input(query: Column, include: Column, exclude: Column) -> dict[str, Column]:
    """Masked and sanitised query, masked keyword lists, kinds of personal data in all of them, and threats."""
    masked, kinds = mask_pii(query)
    clean, threats = sanitize_input(masked)
    included, more = mask_pii_each(F.coalesce(include, F.array().cast("array<string>")))
    excluded, most = mask_pii_each(F.coalesce(exclude, F.array().cast("array<string>")))
    found = F.array_sort(F.array_distinct(F.concat(kinds, more, most)))
    return {"query": clean, "include_keywords": included, "exclude_keywords": excluded, "pii_found": found, "pii_count": F.size(found), "injection_threats": threats}
