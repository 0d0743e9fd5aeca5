"""Text rules as column expressions: segments, evidence kinds, formulas, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of evidence. Fixed values.
NORMATIVE = r"(?i)\b(must|shall|required|requires|should|expected(?:\s+(?:to|result))?|needs?\s+to|has\s+to|cannot|may\s+not)\b"
OBSERVATION = r"(?i)\b(currently|actual(?:ly)?|observed|returns?\s+instead|got\b|traceback|stack\s*trace|fails?\s+with|version\s*[:=])\b"
PRESERVATION = r"(?i)\b(preserve|remain|unchanged|backward compatible|still (?:works?|passes?)|must not (?:change|break|mutate))\b"
QUESTION = r"(?i)\?|\b(could|would|is it possible|why does|how can)\b"
VERSION_ONLY = r"^\s*[A-Za-z][\w.-]*\s*(?:==|=|:|\s)\s*v?\d+(?:\.\d+){1,3}\s*$"
NEGATIONS = r"\b(not|never|cannot|must not|shall not)\b|!="
NEGATIVE = r"\b(not|never|cannot|must not|shall not|!=)\b"
SUBJECT = r"`([^`]+)`|\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\b|\b([A-Za-z_]\w*)\b"
NOT_SUBJECTS = ["the", "a", "an", "this", "that", "must", "shall", "should", "expected", "currently", "return", "returns", "raise", "raises"]


def evidence_kind(text: Column) -> Column:
    """Of a segment of an issue: a version alone, a question without obligation, an obligation, or a witness."""
    return F.when(text.rlike(VERSION_ONLY), "CURRENT_BEHAVIOR").when(text.rlike(NORMATIVE), "ISSUE_NORMATIVE").otherwise("ISSUE_WITNESS")


def evidence_authority(text: Column) -> Column:
    """Only obligations have one."""
    return F.when(evidence_kind(text) == "ISSUE_NORMATIVE", "A").otherwise("PROVISIONAL")


def semantic_parse(kind: Column, text: Column) -> Column:
    """struct(node, authority, rule): what evidence of this kind claims."""
    said = lambda node, authority, rule: F.struct(F.lit(node).alias("node"), F.lit(authority).alias("authority"), F.lit(rule).alias("rule"))
    duty = (kind == "ISSUE_NORMATIVE") & text.rlike(NORMATIVE)
    return (
        F.when(kind == "PUBLIC_TEST", said("PRESERVATION_CONTRACT", "A", "visible_public_assertion"))
        .when(kind.isin("DOCUMENTATION", "TYPE_CONTRACT"), said("NORMATIVE_REQUIREMENT", "B", "resolved_public_contract"))
        .when(kind == "MODEL_HYPOTHESIS", said("SEMANTIC_HYPOTHESIS", "PROVISIONAL", "model_cannot_assign_authority"))
        .when(duty & text.rlike(PRESERVATION), said("PRESERVATION_CONTRACT", "A", "explicit_modal_obligation"))
        .when(duty, said("NORMATIVE_REQUIREMENT", "A", "explicit_modal_obligation"))
        .when(kind == "PRESERVATION_BEHAVIOR", said("PRESERVATION_CONTRACT", "C", "checked_behavior_classification"))
        .when(kind == "CURRENT_BEHAVIOR", said("OBSERVATION", "PROVISIONAL", "checked_behavior_classification"))
        .when(text.rlike(QUESTION), said("SEMANTIC_HYPOTHESIS", "PROVISIONAL", "question_proposes_hypothesis_without_authority"))
        .when(text.rlike(OBSERVATION) | text.rlike(VERSION_ONLY), said("OBSERVATION", "PROVISIONAL", "observation_or_question_not_normative"))
        .otherwise(said("SEMANTIC_HYPOTHESIS", "PROVISIONAL", "unqualified_issue_claim"))
    )


def normalize_formula(text: Column) -> Column:
    """Without fences of code, blanks folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "```\\w*", " "), "\\s+", " "))


def polarity_base(formula: Column) -> Column:
    """Lower case without negations, blanks folded, no blank or dot at either end."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(formula), "\\s+", " "), NEGATIONS, " "), "\\s+", " ")
    return F.regexp_replace(bare, "^[ .]+|[ .]+$", "")


def is_negative(formula: Column) -> Column:
    """A negation that stands as a word; != only counts between word characters."""
    return F.regexp_replace(F.lower(formula), "\\s+", " ").rlike(NEGATIVE)


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "\\.py$", ""), "/__init__$", ""), "/", ".")


def subject(text: Column) -> Column:
    """The first back-ticked, dotted or plain name that isn't a common word; else `behavior`."""
    found = F.regexp_extract_all(text, F.lit(SUBJECT), F.lit(0))
    names = F.transform(found, lambda x: F.regexp_replace(x, "^`|`$", ""))
    return F.coalesce(F.get(F.filter(names, lambda x: ~F.lower(x).isin(NOT_SUBJECTS)), 0), F.lit("behavior"))
