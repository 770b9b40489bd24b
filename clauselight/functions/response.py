"""Turning model responses into structured records.

A response is read as JSON when it holds a JSON object, otherwise line by line;
where neither works it becomes a canned record or a failed row. All of it is
row-local: no shuffle, no Python worker. The session settings of
``clauselight.session`` must be applied (later duplicate keys win).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselight.functions.text import WHITESPACE

LIST_FIELDS = ("key_points", "deadlines_obligations", "warnings", "next_steps")
FIELDS = (
    "summary",
    "key_points",
    "important_terms",
    "deadlines_obligations",
    "warnings",
    "next_steps",
)

# The words that make a line a section heading, first match wins.
SECTION_WORDS = (
    ("summary", ("summary",)),
    ("key_points", ("key points", "main points")),
    ("important_terms", ("terms", "definitions")),
    ("deadlines_obligations", ("deadline", "obligation")),
    ("warnings", ("warning", "risk")),
    ("next_steps", ("next step", "action")),
)
BULLETS = ("-", "•", "*")

# The canned record.
FALLBACK_KEY_POINT = "Unable to parse structured response"
FALLBACK_WARNING = "Please review the original document for important details"
FALLBACK_NEXT_STEP = "Consider consulting with a legal professional"

_EMPTY_LIST = "CAST(array() AS array<string>)"
_EMPTY_TERMS = "from_json('{}', 'map<string,string>')"
# Longer than any list, short enough not to overflow when added to a position.
_ALL = 2**30

# The expressions below are SQL text: they nest deeply, and text is parsed once
# where every call of the column functions would be a round trip.


def _literal(text: str) -> str:
    """A text as an SQL literal, character by character."""
    return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"


_WHITESPACE = _literal(WHITESPACE)
_BREAK = _literal("\n")


def _strip(text: str) -> str:
    return f"btrim({text}, {_WHITESPACE})"


# --- JSON ----------------------------------------------------------------


def json_block(response: Column) -> Column:
    """From the first opening to the last closing brace; empty when there is none."""
    whole = F.startswith(response, F.lit("{")) & F.endswith(response, F.lit("}"))
    return F.when(whole, response).otherwise(F.regexp_extract(response, r"(?s)\{.*\}", 0))


def strict_json(text: Column) -> Column:
    """A text that is exactly one JSON value, as a variant; otherwise NULL.

    The parser stops at the end of a value and ignores what follows, so the
    text is read once as the only item of a list and once as a member of an
    object: what follows the value would have to suit both and cannot.
    """
    items = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(items) == 1) & member.isNotNull(), items[0])


def _text_of(value: str) -> str:
    """A JSON value as text: None, True and False by name, the rest as JSON has it."""
    text = f"try_variant_get({value}, '$', 'string')"
    return (
        f"CASE WHEN is_variant_null({value}) THEN 'None'"
        f" WHEN schema_of_variant({value}) = 'BOOLEAN' THEN initcap({text}) ELSE {text} END"
    )


def _is_truthy(value: str) -> str:
    kind = f"schema_of_variant({value})"
    text = f"try_variant_get({value}, '$', 'string')"
    return (
        f"CASE WHEN {value} IS NULL OR is_variant_null({value}) THEN false"
        f" WHEN {kind} = 'STRING' THEN {text} <> ''"
        f" WHEN {kind} = 'BOOLEAN' THEN {text} = 'true'"
        f" WHEN startswith({kind}, 'ARRAY') THEN {text} <> '[]'"
        f" WHEN startswith({kind}, 'OBJECT') THEN {text} <> '{{}}'"
        f" ELSE coalesce(try_variant_get({value}, '$', 'double') <> 0, true) END"
    )


def _clean(items: str) -> str:
    return f"filter(transform({items}, x -> {_strip(_text_of('x'))}), s -> s <> '')"


def _json_list(value: str, keep_falsy: bool) -> str:
    """A field as a list: a lone value is a list of one, a missing one is empty."""
    items = f"try_variant_get({value}, '$', 'array<variant>')"
    keep = f"{value} IS NOT NULL" if keep_falsy else _is_truthy(value)
    return (
        f"CASE WHEN {items} IS NOT NULL THEN {_clean(items)}"
        f" WHEN {keep} THEN {_clean(f'array({value})')} ELSE {_EMPTY_LIST} END"
    )


def _json_terms(value: str) -> str:
    entries = f"map_entries(try_variant_get({value}, '$', 'map<string,variant>'))"
    kept = f"filter({entries}, e -> e.key <> '' AND {_is_truthy('e.value')})"
    pair = f"struct({_strip('e.key')} AS key, {_strip(_text_of('e.value'))} AS value)"
    return f"coalesce(map_from_entries(transform({kept}, e -> {pair})), {_EMPTY_TERMS})"


def _struct(values: dict[str, str]) -> str:
    return "struct(" + ", ".join(f"{values[f]} AS {f}" for f in FIELDS) + ")"


def _json_record(variant: str) -> str:
    def field(name: str) -> str:
        return f"try_variant_get({variant}, '$.{name}', 'variant')"

    summary = _strip(_text_of(field("summary")))
    return _struct(
        {
            "summary": f"coalesce({summary}, '')",
            "important_terms": _json_terms(field("important_terms")),
            **{n: _json_list(field(n), keep_falsy=n == "key_points") for n in LIST_FIELDS},
        }
    )


# --- lines ---------------------------------------------------------------


def _is_bullet(line: str) -> str:
    return f"substring({line}, 1, 1) IN ({', '.join(map(_literal, BULLETS))})"


def _section_blocks(response: str) -> str:
    """Lines grouped by heading: a list of [section, line, line, ...].

    Stripped lines are never empty, so a blank line can stand for a heading:
    headings are replaced by a blank line and the section's name, and the
    joined text is cut at blank lines. Lines before the first heading are lost,
    as is the text of the heading itself.
    """
    arms = "".join(
        f" WHEN {' OR '.join(f'contains(low, {_literal(w)})' for w in words)}"
        f" THEN {_literal(chr(10) + section)}"
        for section, words in SECTION_WORDS
    )
    line = _strip("raw")
    encode = f"CASE WHEN {line} = '' THEN ''{arms} ELSE {line} END"
    encoded = (
        f"zip_with(split({response}, {_BREAK}), split(lower({response}), {_BREAK}),"
        f" (raw, low) -> {encode})"
    )
    joined = f"concat({_BREAK}, array_join(filter({encoded}, l -> l <> ''), {_BREAK}))"
    blocks = f"slice(split({joined}, {_literal(chr(10) * 2)}), 2, {_ALL})"
    return f"transform({blocks}, b -> split(b, {_BREAK}))"


def _section(blocks: str, name: str) -> str:
    own = f"filter({blocks}, b -> b[0] = '{name}')"
    return f"flatten(transform({own}, b -> slice(b, 2, {_ALL})))"


def _bulleted(lines: str) -> str:
    kept = f"filter({lines}, l -> {_is_bullet('l')})"
    return f"transform({kept}, l -> {_strip('substring(l, 2)')})"


def _text_terms(lines: str) -> str:
    plain = f"filter({lines}, l -> NOT {_is_bullet('l')} AND contains(l, ':'))"
    key = _strip("substring_index(l, ':', 1)")
    value = _strip("substring(l, locate(':', l) + 1)")
    return f"map_from_entries(transform({plain}, l -> struct({key} AS key, {value} AS value)))"


def _text_record(blocks: str) -> str:
    plain = f"filter({_section(blocks, 'summary')}, l -> NOT {_is_bullet('l')})"
    return _struct(
        {
            "summary": f"coalesce(get({plain}, 0), '')",
            "important_terms": _text_terms(_section(blocks, "important_terms")),
            **{n: _bulleted(_section(blocks, n)) for n in LIST_FIELDS},
        }
    )


def _fallback_record(response: str) -> str:
    return _struct(
        {
            "summary": response,
            "key_points": f"array({_literal(FALLBACK_KEY_POINT)})",
            "important_terms": _EMPTY_TERMS,
            "deadlines_obligations": _EMPTY_LIST,
            "warnings": f"array({_literal(FALLBACK_WARNING)})",
            "next_steps": f"array({_literal(FALLBACK_NEXT_STEP)})",
        }
    )


# --- cascade -------------------------------------------------------------


def with_structure(
    df: DataFrame, response: str = "response", only: Sequence[str] | None = None
) -> DataFrame:
    """Add ``parse_path`` and the six content fields of a response column.

    ``parse_path`` is json, text, fallback or error; a NULL response gives
    NULLs. A bullet below a summary heading breaks the line reading: a response
    without braces then takes the canned record, one with broken JSON fails.

    ``only`` keeps the rows read in one of these ways. They come out of a generator, so
    each response is read once; a filter on ``parse_path`` or content put on top of the plain form
    is evaluated at the scan and reads every response twice.
    """
    text = f"`{response}`"
    broken = (
        "exists(_blocks, b -> b[0] = 'summary' AND"
        f" exists(slice(b, 2, {_ALL}), l -> {_is_bullet('l')}))"
    )
    path = (
        f"CASE WHEN {text} IS NULL THEN NULL WHEN _variant IS NOT NULL THEN 'json'"
        f" WHEN NOT {broken} THEN 'text' WHEN _json = '' THEN 'fallback' ELSE 'error' END"
    )
    record = (
        f"CASE parse_path WHEN 'json' THEN {_json_record('_variant')}"
        f" WHEN 'text' THEN {_text_record('_blocks')}"
        f" WHEN 'fallback' THEN {_fallback_record(text)} END"
    )
    kept = [F.col(c) for c in df.columns]
    variant = F.when(F.col("_json") != "", strict_json(F.col("_json")))
    blocks = F.expr(f"CASE WHEN _variant IS NULL THEN {_section_blocks(text)} END")
    # Each stage names what the next one uses more than once.
    staged = (
        df.select(*kept, json_block(F.col(response)).alias("_json"))
        .select("*", variant.alias("_variant"))
        .select("*", blocks.alias("_blocks"))
        .select("*", F.expr(path).alias("parse_path"))
    )
    if only is None:
        read = staged.select("*", F.expr(record).alias("_record"))
    else:
        row = F.struct("parse_path", F.expr(record).alias("_record"))
        row = F.when(F.col("parse_path").isin(*only), F.array(row))
        read = staged.select(*kept, F.inline(row))
    return read.select(*kept, "parse_path", *[F.col(f"_record.{n}").alias(n) for n in FIELDS])


def confidence() -> Column:
    """Score of a structured record, added up in a fixed order of doubles.

    A row without a record, such as a failed one, has no score.
    """

    def bonus(found: Column, points: float) -> Column:
        return F.when(found, F.lit(points)).otherwise(F.lit(0.0))

    score = F.lit(0.5) + bonus(F.length("summary") > 50, 0.2)
    for name in ("key_points", "important_terms", "next_steps"):
        score = score + bonus(F.size(name) > 0, 0.1)
    return F.when(F.col("summary").isNotNull(), F.least(score, F.lit(1.0)))
