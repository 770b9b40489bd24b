"""Prompt texts for simplification and questions, and answer scoring."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselight.functions.text import normalise, strip

DEFAULT_LEVEL = "standard"
DEFAULT_AUDIENCE = "general_public"

TASK = (
    "You explain legal documents to people who are not lawyers. Stay accurate, "
    "write plainly, and cover what the document is for, the terms it relies on, "
    "dates and duties, risks, and what the reader should do next."
)


class Guidance(NamedTuple):
    """What to tell the model for each level and audience; both tables hold the defaults' keys."""

    levels: Mapping[str, str]
    audiences: Mapping[str, str]


PLAIN = Guidance(
    {DEFAULT_LEVEL: "Keep to the level named above."},
    {DEFAULT_AUDIENCE: "Write for the readers named above."},
)
# The contract the response reader relies on.
RESPONSE_CONTRACT = (
    "Answer with one JSON object holding exactly these fields:\n"
    '{"summary": "text", "key_points": ["text"], "important_terms": {"term": "definition"},'
    ' "deadlines_obligations": ["text"], "warnings": ["text"], "next_steps": ["text"]}'
)
DOCUMENT_MARK = "DOCUMENT TO SIMPLIFY:\n"
QUESTION_TASK = (
    "You answer questions about a legal document. Use only what the document says, "
    "in short plain sentences, and say so when it does not hold the answer."
)
# Fixed value: what a failed question is answered with.
APOLOGY = "I'm sorry, I couldn't find the answer in the document."
ANSWERED, UNANSWERED = 0.7, 0.3


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    """A fixed table as an expression; an unknown or missing key takes the default."""
    chain = F.lit(table[default])
    for name, value in table.items():
        if name != default:
            chain = F.when(key == name, value).otherwise(chain)
    return chain


def level_guidance(level: Column, guidance: Guidance = PLAIN) -> Column:
    return lookup(level, guidance.levels, DEFAULT_LEVEL)


def audience_guidance(audience: Column, guidance: Guidance = PLAIN) -> Column:
    return lookup(audience, guidance.audiences, DEFAULT_AUDIENCE)


def audience_title(audience: Column) -> Column:
    return F.initcap(F.replace(audience, F.lit("_"), F.lit(" ")))


def simplification_prompt(
    cleaned: Column, level: Column, audience: Column, guidance: Guidance = PLAIN
) -> Column:
    """Prompt for a text already cleaned by ``normalise``."""
    return F.concat(
        F.lit(TASK + "\n\nSIMPLIFICATION LEVEL: "),
        F.upper(level),
        F.lit("\n"),
        level_guidance(level, guidance),
        F.lit("\n\nTARGET AUDIENCE: "),
        audience_title(audience),
        F.lit("\n"),
        audience_guidance(audience, guidance),
        F.lit("\n\n" + RESPONSE_CONTRACT + "\n\n" + DOCUMENT_MARK),
        cleaned,
    )


def question_prompt(text: Column, question: Column, audience: Column, *, collapsed: bool = False) -> Column:
    return F.concat(
        F.lit(QUESTION_TASK + "\n\nTARGET AUDIENCE: "),
        audience_title(audience),
        F.lit("\n\nDOCUMENT:\n"),
        normalise(text, collapsed=collapsed),
        F.lit("\n\nQUESTION:\n"),
        question,
        F.lit("\n\nGive the answer and nothing else."),
    )


def answer(response: Column) -> Column:
    """The stripped answer, or the apology when generation failed."""
    return F.coalesce(strip(response), F.lit(APOLOGY))


def answer_confidence(response: Column) -> Column:
    return F.when(strip(response) != "", ANSWERED).otherwise(UNANSWERED)
