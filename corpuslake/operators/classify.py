"""Document types by weighted patterns, and the collections that they go to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: types from the most to the least preferred at a tie
PRIORITY = ("past_question", "syllabus", "library_book", "rules_regulations", "academic_calendar", "notice")

# fixed values: patterns of each type with their weights
FEATURES: dict[str, list[tuple[str, int]]] = {
    "past_question": [
        (r"\bQ\.?\s?\d+\b", 3), (r"\bMarks?\b", 3), (r"\bTime\s*:\s*\d", 2), (r"\bMax(?:imum)?\s*Marks\b", 2), (r"\bFull\s+Marks\b", 2),
        (r"\bAttempt\b", 2), (r"\bAnswer\s+(?:any|all)\b", 2), (r"\bCandidates?\s+are\s+required\b", 2), (r"\bPass\s+Marks?\b", 1), (r"\bExaminer\b", 1),
    ],
    "syllabus": [
        (r"\bSyllabus\b", 3), (r"\bUnit\s+\d+\b", 2), (r"\bModule\s+\d+\b", 2), (r"\bCourse\s+Objectives?\b", 2), (r"\bCourse\s+Description\b", 1),
        (r"\bCredit(?:s)?\b", 2), (r"\bTeaching\s+Hours\b", 2), (r"\bRecommended\s+(?:Books?|Texts?|Readings?)\b", 2), (r"\bCourse\s+Outcomes?\b", 1), (r"\bPrerequisites?\b", 1),
    ],
    "library_book": [
        (r"\bChapter\s+\d+\b", 3), (r"\bTable\s+of\s+Contents\b", 3), (r"\bContents\b", 1), (r"\bPreface\b", 3), (r"\bISBN\b", 3),
        (r"\bPublisher\b", 2), (r"\bEdition\b", 2), (r"\bCopyright\b", 2), (r"\bIndex\b", 1), (r"\bAcknowledg(e)?ment(s)?\b", 1),
    ],
    "rules_regulations": [
        (r"\bRegulations?\b", 3), (r"\bOrdinance\b", 3), (r"\bEligibility\b", 2), (r"\bAttendance\b", 2), (r"\bGrievance\b", 2),
        (r"\bDisciplinary\b", 2), (r"\bCode\s+of\s+Conduct\b", 2), (r"\bRules?\b", 1), (r"\bWithdrawal\b", 1), (r"\bRe-admission\b", 1),
    ],
    "academic_calendar": [
        (r"\bAcademic\s+Calendar\b", 4), (r"\bSemester\s+Calendar\b", 3), (r"\bCommence(?:ment|s)\b", 2), (r"\b(?:Mid[- ]Semester|End[- ]Semester)\s+Exam\w*\b", 2),
        (r"\b(?:Winter|Summer|Spring)\s+Break\b", 2), (r"\bDeadlines?\b", 2), (r"\bAdmission\s+(?:opens|closes|begins)\b", 2),
        (r"\bRegistration\s+(?:opens|closes|begins)\b", 2), (r"\bHolidays?\b", 1), (r"\bExamination\s+Schedule\b", 2),
    ],
    "notice": [
        (r"\bNotice\b", 3), (r"\bThis\s+is\s+to\s+inform\b", 3), (r"\bTo\s+all\s+(?:students|staff|faculty)\b", 2), (r"\bKindly\b", 1),
        (r"\bConcerned\b", 1), (r"\bIssu(?:ed|ance)\b", 1), (r"\bDate\s*:", 1), (r"\bRe(?:garding)?\b", 1),
    ],
}
MIN_SCORE = 3

# fixed values: for patterns of letters, those that every text they match holds, in lower case
HELD: dict[str, str] = {
    p: word
    for word, patterns in {
        "mark": (r"\bMarks?\b", r"\bMax(?:imum)?\s*Marks\b", r"\bFull\s+Marks\b", r"\bPass\s+Marks?\b"),
        "time": (r"\bTime\s*:\s*\d",), "attempt": (r"\bAttempt\b",), "answer": (r"\bAnswer\s+(?:any|all)\b",), "candidate": (r"\bCandidates?\s+are\s+required\b",), "examiner": (r"\bExaminer\b",),
        "syllabus": (r"\bSyllabus\b",), "unit": (r"\bUnit\s+\d+\b",), "module": (r"\bModule\s+\d+\b",), "credit": (r"\bCredit(?:s)?\b",), "teaching": (r"\bTeaching\s+Hours\b",),
        "course": (r"\bCourse\s+Objectives?\b", r"\bCourse\s+Description\b", r"\bCourse\s+Outcomes?\b"), "recommended": (r"\bRecommended\s+(?:Books?|Texts?|Readings?)\b",), "prerequisite": (r"\bPrerequisites?\b",),
        "chapter": (r"\bChapter\s+\d+\b",), "contents": (r"\bTable\s+of\s+Contents\b", r"\bContents\b"), "preface": (r"\bPreface\b",), "isbn": (r"\bISBN\b",), "publisher": (r"\bPublisher\b",),
        "edition": (r"\bEdition\b",), "copyright": (r"\bCopyright\b",), "index": (r"\bIndex\b",), "acknowledg": (r"\bAcknowledg(e)?ment(s)?\b",),
        "regulation": (r"\bRegulations?\b",), "ordinance": (r"\bOrdinance\b",), "eligibility": (r"\bEligibility\b",), "attendance": (r"\bAttendance\b",), "grievance": (r"\bGrievance\b",),
        "disciplinary": (r"\bDisciplinary\b",), "conduct": (r"\bCode\s+of\s+Conduct\b",), "rule": (r"\bRules?\b",), "withdrawal": (r"\bWithdrawal\b",), "re-admission": (r"\bRe-admission\b",),
        "calendar": (r"\bAcademic\s+Calendar\b", r"\bSemester\s+Calendar\b"), "commence": (r"\bCommence(?:ment|s)\b",), "exam": (r"\b(?:Mid[- ]Semester|End[- ]Semester)\s+Exam\w*\b", r"\bExamination\s+Schedule\b"),
        "break": (r"\b(?:Winter|Summer|Spring)\s+Break\b",), "deadline": (r"\bDeadlines?\b",), "admission": (r"\bAdmission\s+(?:opens|closes|begins)\b",), "registration": (r"\bRegistration\s+(?:opens|closes|begins)\b",),
        "holiday": (r"\bHolidays?\b",), "notice": (r"\bNotice\b",), "inform": (r"\bThis\s+is\s+to\s+inform\b",), "to": (r"\bTo\s+all\s+(?:students|staff|faculty)\b",), "kindly": (r"\bKindly\b",),
        "concerned": (r"\bConcerned\b",), "issu": (r"\bIssu(?:ed|ance)\b",), "date": (r"\bDate\s*:",),
    }.items()
    for p in patterns
}


def scores(text: Column, features: Mapping[str, Sequence[tuple[str, int]]] = FEATURES) -> Column:
    """Struct of each type's score: the weights of its patterns that occur, in any case.

    A pattern of HELD is only tried on texts that hold its letters.
    """
    low = F.lower(text)

    def occurs(p: str) -> Column:
        found = text.rlike(f"(?i){p}")
        return low.contains(HELD[p]) & found if p in HELD else found

    return F.struct(*(sum((F.when(occurs(p), w).otherwise(0) for p, w in found), start=F.lit(0)).alias(kind) for kind, found in features.items()))


def pick_type(scored: Column, priority: Sequence[str] = PRIORITY, min_score: int = MIN_SCORE) -> Column:
    """The type of the best score of at least ``min_score``, the preferred one at a tie, else unknown. Each score is asked for once."""
    best = F.array_max(F.array(*(F.struct(scored[kind].alias("s"), F.lit(-i).alias("at"), F.lit(kind).alias("kind")) for i, kind in enumerate(priority))))
    return F.get(F.transform(F.array(best), lambda b: F.when(F.coalesce(b["s"], F.lit(0)) < min_score, "unknown").otherwise(b["kind"])), F.lit(0))


def collection_for(document_type: Column) -> Column:
    return F.when(document_type == "library_book", "library").when(document_type == "past_question", "past_questions").otherwise("academic")
