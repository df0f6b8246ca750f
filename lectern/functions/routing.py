"""What a message asks for: predicates and labels over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bound, contains_any, stripped, text_of, weak_answer

# The signals of each class of message.
MATH_SIGNALS = ("solve", "integrate", "integral", "differentiate", "derivative", "evaluate", "calculate", "simplify", "∫", "∑", "√")
ARITHMETIC = r"\b\d+(?:\s*[+\-*/^=]\s*\d+)+(?:\s*\b|$)"
REASONING_SIGNALS = (
    "analyze", "analyse", "analysis", "reason", "reasoning", "explain",
    "compare", "contrast", "deduce", "infer", "prove", "why does",
    "why is", "how does", "how do", "what happens if", "step by step",
)
WEB_SIGNALS = ("search", "google", "wikipedia", "wiki", "latest", "news", "lookup", "look up")
WEB_COMMAND = r"(?i)^(search|google|find|look up|lookup|wikipedia|wiki)\s+(for\s+)?"
IMAGE_NOUNS = (
    "image", "images", "imahe", "picture", "pictures", "photo", "photos", "illustration", "illustrations",
    "diagram", "diagrams", "drawing", "drawings", "sketch", "sketches", "painting", "paintings",
    "poster", "posters", "graphic", "graphics", "visual", "visuals", "artwork", "portrait", "portraits",
)
IMAGE_VERBS = ("generate", "create", "make", "draw", "design", "produce", "build")
IMAGE_THINGS = ("rose", "flower", "tree", "sun", "cat", "dog", "mountain", "landscape", "scene")
NO_TEXT = ("no text", "without text", "no words", "no writing", "text-free", "no labels")
WANTS_TEXT = ("with the text", "that says", "saying", "with the words", "captioned", "titled", "with the title", "label it")
AMBIGUOUS = ("banner", "poster", "flyer", "sign", "logo", "certificate", "card", "cover", "brochure", "advertisement", "advert", "infographic", "menu", "ticket", "invitation", "billboard")
QUOTED = "[\"“‘']([^\"”’']{1,80})[\"”’']"
ALL_BUT = r"\ball but\s+(\d+)\b"
ALL_BUT_SIGNALS = ("how many", "how much", "left", "remain", "remaining", "stay", "sheep", "die")
LESSON = ("lesson plan", "create lesson", "create a lesson", "make a lesson", "teaching plan")
NOTES = ("short notes", "short note", "summarize")
IMAGE_WORDS = ("image", "diagram", "draw", "visual")
STATUS = {
    "document": "Processing document...",
    "lesson-plan-blocked": "Checking lesson plan access...",
    "lesson-plan": "Generating lesson plan...",
    "short-notes": "Generating short notes...",
    "pdf": "Generating PDF...",
    "image": "Generating image...",
    "wikipedia": "Searching Wikipedia...",
    "web": "Searching ...",
    "general": "Thinking...",
}
GRADE = r"(?i)grade\s*(\d{1,2})"
DURATION = r"(?i)(\d+\s*(?:minutes|minute|mins|min|hours|hour|hrs|hr))"
TOPIC = r"(?i)(?:lesson plan|create a lesson|make a lesson)\s*(?:on|about)\s+([^,.\n]+)"
SUBJECT = r"(?i)in\s+([^,.\n]+)\s*(?:for|grade|$)"
PREREQUISITE = r"(?i)prereq(?:uisite)?s?:?\s*([^,.\n]+)"


def image_request_pattern() -> tuple[str, str]:
    """The nouns that suffice alone, and a verb followed by a thing."""
    return rf"\b({'|'.join(IMAGE_NOUNS)})\b", rf"\b({'|'.join(IMAGE_VERBS)})\b.*\b({'|'.join(IMAGE_THINGS)})\b"


def _low(message: Column) -> Column:
    return F.lower(stripped(message))


def is_math(message: Column) -> Column:
    def signs(low: Column) -> Column:
        kinds = sum((F.contains(low, F.lit(c)).cast("int") for c in "∫∑√^="), F.lit(0))
        return contains_any(low, MATH_SIGNALS) | F.rlike(low, F.lit(ARITHMETIC)) | (kinds >= 2)

    return bound(F.lower(text_of(message)), signs)


def is_reasoning(message: Column) -> Column:
    return contains_any(_low(message), REASONING_SIGNALS)


def is_web(message: Column) -> Column:
    return contains_any(_low(message), WEB_SIGNALS)


def web_query(message: Column) -> Column:
    """The message without its leading command; the message itself if nothing else is in it."""
    rest = F.regexp_replace(stripped(message), WEB_COMMAND, "")
    return F.when(rest != "", rest).otherwise(message)


def is_image_request(message: Column) -> Column:
    nouns, pairs = image_request_pattern()
    low = _low(message)
    return F.rlike(low, F.lit(nouns)) | F.rlike(low, F.lit(pairs))


def image_intent(message: Column) -> Column:
    low = _low(message)
    quoted = F.rlike(stripped(message), F.lit(QUOTED))
    return F.when(contains_any(low, NO_TEXT), "no_text").when(quoted | contains_any(low, WANTS_TEXT), "wants_text").when(contains_any(low, AMBIGUOUS), "ambiguous").otherwise("no_text")


def image_text(message: Column) -> Column:
    """The quoted text that an image shall show."""
    quoted = stripped(F.regexp_extract(stripped(message), QUOTED, 1))
    return F.when(contains_any(_low(message), NO_TEXT), "").otherwise(quoted)


def all_but_number(message: Column) -> Column:
    """What is left when all but so many go; empty if that isn't asked."""
    low = _low(message)
    return F.when(contains_any(low, ALL_BUT_SIGNALS), F.regexp_extract(low, ALL_BUT, 1)).otherwise("")


def all_but_answer(message: Column) -> Column:
    """The answer to an all-but question in words; empty if the message asks none."""
    n = all_but_number(message)
    return F.when(n != "", F.concat(F.lit("The answer is "), n, F.lit(". Because 'all but "), n, F.lit("' means every one except "), n, F.lit(" is gone, so "), n, F.lit(" are left."))).otherwise("")


def image_prompt(message: Column, intent: Column, shown: Column) -> Column:
    """What an image model is asked for: the wish, and what wording the image shall show."""
    exact = F.concat(message, F.lit('. Clean professional design. IMPORTANT: display the exact text "'), shown, F.lit('", spelled correctly, sharp and clearly readable. No other text, no random letters. High resolution.'))
    worded = F.concat(message, F.lit(". Clean professional design with the requested wording spelled correctly and clearly readable. No random or extra text. High resolution."))
    plain = F.concat(message, F.lit(". Clean, high-quality illustration with NO text, NO words, NO letters, no captions, no labels, no watermark. High resolution."))
    return F.when(intent != "wants_text", plain).when(shown != "", exact).otherwise(worded)


def is_lesson(message: Column) -> Column:
    return contains_any(F.lower(text_of(message)), LESSON)


def route(message: Column, role: Column, staged_file: Column | None = None) -> Column:
    """What a message starts; the first rule that holds counts."""
    low = F.lower(text_of(message))
    staged = F.lit(False) if staged_file is None else text_of(staged_file) != ""
    lesson = contains_any(low, LESSON[:4])
    return (
        F.when(staged, "document")
        .when(lesson & ~role.eqNullSafe(F.lit("teacher")), "lesson-plan-blocked")
        .when(lesson, "lesson-plan")
        .when(contains_any(low, NOTES), "short-notes")
        .when(F.contains(low, F.lit("pdf")), "pdf")
        .when(contains_any(low, IMAGE_WORDS), "image")
        .when(contains_any(low, ("wikipedia", "wiki")), "wikipedia")
        .when(is_web(message), "web")
        .otherwise("general")
    )


def chat_action(message: Column, role: Column, staged_file: Column, url: Column) -> Column:
    """What a request starts: reading a page if it names one, else what its message and staged file ask for."""
    return F.when(stripped(url) != "", "web").otherwise(route(message, role, staged_file))


def route_status(action: Column) -> Column:
    """The line shown while a route's action runs."""
    pairs = [F.lit(x) for pair in STATUS.items() for x in pair]
    return F.create_map(*pairs)[action]


def answer_route(message: Column, role: Column, self_query: Column) -> Column:
    """Which step of the answer cascade takes a message."""
    low = F.lower(text_of(message))
    plain = ~is_math(message) & ~is_reasoning(message)
    return (
        F.when(is_lesson(message) & ~role.eqNullSafe(F.lit("teacher")), "lesson-blocked")
        .when(all_but_number(message) != "", "all-but")
        .when(is_math(message), "math")
        .when(self_query, "faq")
        .when(plain & contains_any(low, ("wikipedia", "wiki")), "wikipedia")
        .when(plain & is_web(message), "web")
        .otherwise("retrieval")
    )


def answer_cascade(message: Column, role: Column, *, cancelled: Column, url: Column, pending_image: Column, faq_hit: Column, answer: Column, has_document: Column) -> Column:
    """Which step of the whole cascade answers a request; the first rule that holds counts.

    ``faq_hit`` says whether the question bank answers, ``answer`` is what retrieval gave: a weak one goes to the web unless the session
    has a document. Lesson plans are blocked by fewer phrases here than in ``is_lesson``.
    """
    low = F.lower(text_of(message))
    plain = ~is_math(message) & ~is_reasoning(message)
    blocked = contains_any(low, LESSON[:4]) & ~role.eqNullSafe(F.lit("teacher"))
    return (
        F.when(cancelled, "cancelled")
        .when(stripped(url) != "", "url")
        .when(blocked, "lesson-blocked")
        .when(pending_image, "pending-image")
        .when(all_but_number(message) != "", "all-but")
        .when(is_math(message), "math")
        .when(faq_hit, "faq")
        .when(plain & contains_any(low, ("wikipedia", "wiki")), "wikipedia")
        .when(plain & is_web(message), "web")
        .when(weak_answer(answer) & ~has_document, "retrieval-to-web")
        .otherwise("retrieval")
    )


def lesson_metadata(message: Column) -> dict[str, Column]:
    """grade, duration, topic, subject, prerequisite; empty where the message has none."""
    text = text_of(message)
    grade = F.regexp_extract(text, GRADE, 1)
    topic = stripped(F.split(stripped(F.regexp_extract(text, TOPIC, 1)), r"(?i)\s+for\b")[0])
    named = F.rlike(text, F.lit(TOPIC))
    short = F.size(F.split(topic, r"\s+")) <= 3
    return {
        "grade": F.when(grade != "", F.concat(F.lit("Grade "), grade)).otherwise(""),
        "duration": F.regexp_extract(text, DURATION, 1),
        "topic": F.when(named, topic).otherwise(""),
        "subject": F.when(named, F.when(short, topic).otherwise("")).otherwise(stripped(F.regexp_extract(text, SUBJECT, 1))),
        "prerequisite": stripped(F.regexp_extract(text, PREREQUISITE, 1)),
    }


def lesson_timing(minutes: Column) -> dict[str, Column]:
    """Minutes of each part of a lesson; halves round to even."""
    part = lambda share, least: F.greatest(F.lit(least), F.bround(minutes * F.lit(share)).cast("int"))
    intro, direct, guided, own = part(0.12, 3), part(0.30, 8), part(0.30, 8), part(0.18, 5)
    long = minutes >= 10
    pick = lambda value, default: F.when(long, value).otherwise(default).cast("int")
    return {
        "intro": pick(intro, 5),
        "direct": pick(direct, 15),
        "guided": pick(guided, 10),
        "independent": pick(own, 7),
        "closure": pick(F.greatest(F.lit(3), minutes - (intro + direct + guided + own)), 3),
    }


def route_histogram(messages, role: Column):
    """How many messages take each route; partial counts, so no shuffle of messages."""
    return messages.groupBy(route(F.col("text"), role).alias("action")).agg(F.count("*").alias("messages"))
