"""Lesson plans: a request's facts and minutes in one template, with the model's draft behind it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.routing import is_lesson, lesson_metadata, lesson_timing
from lectern.functions.scalars import bound, stripped, text_of

MISSING, MINUTES = "Not specified", "40 minutes"
# The template, with the names of what is filled in.
TEMPLATE = """# {title}
## Quick Snapshot
| Item | Details |
|---|---|
| Grade / Level | {grade} |
| Subject | {subject} |
| Topic | {topic} |
| Duration | {duration} |
| Prerequisite Knowledge | {prerequisite} |
## Lesson Overview
A short explanation of what the lesson is about, why it matters, and how it connects to what students already know.
## What Students Will Learn
- Understand the key idea behind the topic
- Use important vocabulary correctly
- Apply the idea in a guided activity or example
- Show understanding in a short check for learning
## Materials
- Whiteboard or slides
- Markers or pen
- Student workbook, handout, or notebook
- Any demonstration items or digital resources
## Lesson Flow
| Stage | Time | Teacher does | Students do |
|---|---:|---|---|
| Warm-up | {intro} min | Open with a question, image, or quick review to activate prior knowledge. | Share ideas, predict the topic, or recall what they already know. |
| Teach | {direct} min | Explain the main concept with clear examples and simple checks for understanding. | Listen, note key ideas, and answer short questions. |
| Guided Practice | {guided} min | Model one task and support students while they try it together. | Work with the teacher, ask questions, and complete the guided task. |
| Independent Practice | {independent} min | Give an application task and monitor progress. | Work independently or in pairs to show understanding. |
| Wrap-up | {closure} min | Summarize the lesson and end with a quick exit check. | Reflect on learning and complete the closing question. |
## Assessment
- Formative: questioning, quick recap, or mini whiteboard check
- Summative: a short task, quiz, worksheet, or exit ticket that shows the main skill
- Success criteria: students can explain the idea, use the vocabulary, and complete the task with support
## Support and Extension
- Support: sentence starters, visuals, worked examples, or partner support
- Core: scaffolded practice with clear steps
- Extension: challenge questions, deeper reasoning, or an independent task
## Homework / Reflection
- One short practice task or reflection question to check understanding
- Optional extension activity for students who finish early
## Teacher Notes
- Common misconceptions to watch for
- Pacing or classroom management tips
- Any materials, safety notes, or reminders"""
DRAFT = """
## Original Draft
<details>
<summary>View the model draft used to create this lesson plan</summary>
{draft}
</details>"""


def pieces(template: str) -> list[tuple[str, bool]]:
    """The template's texts and names in order, with whether each is a name."""
    return [(part, i % 2 == 1) for i, part in enumerate(re.split(r"\{(\w+)\}", template)) if part]


def requested_minutes(duration: Column) -> Column:
    """The first number of a duration as minutes; null without one."""
    digits = F.regexp_extract(duration, "([0-9]+)", 1)
    return F.when(digits != "", digits).try_cast("int")


def cell(value: Column) -> Column:
    """A value inside of a table's row."""
    own = stripped(F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), "[\n\r]", " "))
    return F.when(own == "", MISSING).otherwise(own)


def lesson_plan(answer: Column, message: Column) -> Column:
    """The answer to a request for a lesson as a plan in the template; other answers as they are, null ones empty."""
    facts = lesson_metadata(message)

    def filled(template: str, values: dict[str, Column]) -> Column:
        return F.concat(*[values[part].cast("string") if name else F.lit(part) for part, name in pieces(template)])

    def plan(f: Column) -> Column:
        minutes = lesson_timing(F.coalesce(requested_minutes(f["duration"]), F.lit(0)))
        values = {name: cell(f[name]) for name in facts} | minutes
        return filled(TEMPLATE, values | {"title": F.when(f["topic"] == "", "Lesson Plan").otherwise(values["topic"])})

    draft = stripped(answer)
    given = F.struct(*[(F.when(c == "", MINUTES).otherwise(c) if n == "duration" else c).alias(n) for n, c in facts.items()])
    behind = F.when(draft == "", "").otherwise(filled(DRAFT, {"draft": draft}))
    return F.when(is_lesson(message), F.concat(bound(given, plan), behind)).otherwise(text_of(answer))
