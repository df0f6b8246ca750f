"""Scalar helpers on text and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 140
#: Characters that Markdown gives a meaning (fixed value).
MARKDOWN = r"([\\`*_{}\[\]()#+\-.!|>])"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
#: An answer with one of these says that nothing was found.
WEAK_SIGNALS = (
    "i don't have", "i do not have", "not in the curriculum",
    "not mentioned", "cannot find", "can't find", "no information",
    "does not contain", "doesn't contain", "not provided in",
    "not available in the", "i'm not sure", "i am not sure",
    "no relevant information", "unable to find", "the curriculum does not",
    "the provided excerpts", "out of scope",
)
DISCLAIMER = "DISCLAIMER: This response was generated. Please verify important information."


#: The two instructions.
TEACHER_MODE = (
    "Teacher mode: respond as a curriculum-support assistant. "
    "Prioritize lesson structure, pedagogy, assessment, differentiation, and classroom use."
)
STUDENT_MODE = (
    "Student mode: respond in clear, simple, supportive language. "
    "Focus on short explanations, examples, and study help without unnecessary teaching detail."
)


def text_of(value: Column) -> Column:
    """Null is the empty text."""
    return F.coalesce(value, F.lit(""))


def stripped(value: Column) -> Column:
    """Without white space (Unicode's too) at both ends."""
    return F.regexp_replace(text_of(value), r"(?U)^\s+|\s+$", "")


def collapsed(value: Column) -> Column:
    """Stripped, with runs of white space as one blank."""
    return F.regexp_replace(stripped(value), r"(?U)\s+", " ")


def contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of ``parts`` occurs in ``value``, which is worked out once for all of them."""
    return F.rlike(value, F.lit("|".join(rf"\Q{p}\E" for p in parts)))


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normal_email(value: Column) -> Column:
    return F.lower(stripped(value))


def access_role(email: Column) -> Column:
    """teacher or student by the address's parts; null without an @."""
    e = normal_email(email)
    local = F.substring_index(e, "@", 1)
    domain = F.regexp_replace(e, "^[^@]*@", "")
    teacher = F.startswith(domain, F.lit("education.")) | F.contains(local, F.lit(".education"))
    return F.when(F.contains(e, F.lit("@")), F.when(teacher, "teacher").otherwise("student"))


def role_instruction(role: Column) -> Column:
    """What the model is told about the reader; whoever is no teacher counts as a student."""
    return F.when(role == "teacher", TEACHER_MODE).otherwise(STUDENT_MODE)


def snippet(value: Column, limit: int = SNIPPET) -> Column:
    """One line of at most ``limit`` characters; a cut ends in an ellipsis."""
    flat = collapsed(value)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def iso_to_utc(value: Column) -> Column:
    """Timestamp without zone, in UTC; text without offset counts as UTC, what isn't a time is null."""
    return F.try_to_timestamp(value).cast("timestamp_ntz")


def html_escaped(value: Column) -> Column:
    out = text_of(value)
    for char, entity in ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def escape_markdown(value: Column) -> Column:
    return F.regexp_replace(html_escaped(value), MARKDOWN, r"\\$1")


def clean_markdown(value: Column) -> Column:
    return F.translate(text_of(value), "*_`~<>", "")


def with_disclaimer(value: Column, disclaimer: str = DISCLAIMER) -> Column:
    """The answer with the disclaimer behind it, once."""
    trimmed = F.regexp_replace(text_of(value), r"(?U)\s+$", "")
    appended = F.when(trimmed == "", disclaimer).otherwise(F.concat(trimmed, F.lit("\n\n---\n\n" + disclaimer)))
    return F.when(F.contains(text_of(value), F.lit(disclaimer)), value).otherwise(appended)


def weak_answer(value: Column) -> Column:
    low = F.lower(stripped(value))
    return (F.length(low) < 40) | contains_any(low, WEAK_SIGNALS)


def escape_pdf(value: Column) -> Column:
    """The text as it stands between the parentheses of a PDF string."""
    return F.regexp_replace(text_of(value), r"[\\()]", r"\\$0")


def plus_quoted(value: Column) -> Column:
    """URL quoting with + for blanks, ~ kept and * encoded."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def nfkc(value: Column) -> Column:
    """Compatibility composition, by the ICU library that Spark has."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text_of(value), F.lit(True))
