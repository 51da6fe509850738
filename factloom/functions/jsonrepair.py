"""Recovery of JSON from model responses that wrap or decorate it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE_JSON, _FENCE = r"(?s)```json\s*(.*?)```", r"(?s)```\s*(.*?)```"


def _valid(text: Column) -> Column:
    """The text if it is a JSON object or array, else null."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull() & F.regexp_like(text, F.lit(r"^\s*[\[{]")), text)


def _group(text: Column, pattern: str) -> Column:
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def recovered(text: Column) -> Column:
    """JSON text of a response: as it is, in a json fence, in any fence, from its first bracket, or to its last one; else null."""
    first = _group(text, r"(?s)([\[{].*)$")
    widest = _group(text, r"(?s)(\{.*\})")
    return F.coalesce(_valid(F.trim(text)), *(_valid(F.trim(x)) for x in (_group(text, _FENCE_JSON), _group(text, _FENCE), first, widest)))


def as_map(text: Column) -> Column:
    """A map from JSON or a Python dict literal, empty if it is neither."""
    python = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    parse = lambda c: F.from_json(c, "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(parse(text), parse(python), F.create_map().cast("map<string,string>"))


def variant(text: Column) -> Column:
    """The recovered response as a VARIANT, so that unexpected keys survive."""
    return F.try_parse_json(recovered(text))
