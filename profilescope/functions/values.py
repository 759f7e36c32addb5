r"""Request values as SQL expressions, so that whole tables of requests decode in one pass.

Every function takes the SQL text of an expression and returns one.
"""

from __future__ import annotations

from profilescope.functions.text import NO_STRINGS, literal

# The experience ranges in ascending order.
EXPERIENCE_LADDER = ["0..1", "1..2", "2..4", "4..6", "6..8", "8+"]
DEFAULT_OFFSET = 0
DEFAULT_PER_PAGE = 10

NO_LONGS = "cast(array() AS array<bigint>)"
LIST = literal(r"\A\s*\[")
BLANKS_AROUND = literal(r"\A\s+|\s+\z")


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {BLANKS_AROUND}, '')"


def whole_number(text: str, low: int, high: int, sign: str) -> str:
    """A number within limits, else null."""
    form = literal(rf"\A{sign}[0-9]+\z")
    number = f"try_cast({text} AS decimal(38,0))"
    return f"CASE WHEN {text} RLIKE {form} AND {number} BETWEEN {low} AND {high} THEN cast({number} AS bigint) END"


def parse_u8(text: str) -> str:
    return f"cast({whole_number(text, 0, 255, '[+]?')} AS int)"


def parse_i32(text: str) -> str:
    return whole_number(text, -(2**31), 2**31 - 1, "[+-]?")


def parse_u63(text: str) -> str:
    """A non-negative number that fits Spark's long."""
    return whole_number(text, 0, 2**63 - 1, "[+]?")


def parse_role_filter(text: str) -> str:
    """``role[:minimum[:maximum]]`` as a struct; null for an empty text."""
    parts = f"split({trimmed(text)}, ':')"
    minimum, maximum = parse_u8(f"get({parts}, 1)"), parse_u8(f"get({parts}, 2)")
    fields = (
        f"'role', get({parts}, 0), 'minimum', {minimum}, "
        f"'maximum', CASE WHEN {maximum} >= {minimum} THEN {maximum} END"
    )
    return f"CASE WHEN {trimmed(text)} <> '' THEN named_struct({fields}) END"


def experience_ranges(minimum: str) -> str:
    """The range labels that a minimum number of years admits; null for a null minimum."""
    ladder = ", ".join(literal(label) for label in EXPERIENCE_LADDER)
    rung = f"CASE WHEN {minimum} < 2 THEN 0 ELSE (least({minimum}, 9) + 1) DIV 2 END"
    return f"slice(array({ladder}), cast({rung} AS int) + 1, {len(EXPERIENCE_LADDER)} - cast({rung} AS int))"


def string_list(value: str) -> str:
    """A JSON list of strings; anything else is an empty list."""
    listed = f"CASE WHEN {value} RLIKE {LIST} THEN from_json({value}, 'array<string>') END"
    return f"coalesce({listed}, {NO_STRINGS})"


def int_list(value: str) -> str:
    """A JSON list of numbers (all must convert) or comma-separated numbers (bad ones dropped)."""
    listed = f"transform(from_json({value}, 'array<string>'), item -> {parse_i32('item')})"
    whole = f"CASE WHEN NOT exists({listed}, number -> number IS NULL) THEN {listed} END"
    separated = f"transform(split({value}, ','), item -> {parse_i32(trimmed('item'))})"
    chosen = f"CASE WHEN {value} RLIKE {LIST} THEN {whole} ELSE array_compact({separated}) END"
    return f"coalesce({chosen}, {NO_LONGS})"


def string_scalar(value: str) -> str:
    """A scalar as a list of at most one element."""
    return f"array_compact(array(CASE WHEN NOT {value} RLIKE {LIST} THEN {value} END))"


def int_scalar(value: str) -> str:
    return f"array_compact(array({parse_i32(value)}))"


def instant(value: str) -> str:
    """A date with an optional time; null where it cannot be read."""
    return f"try_to_timestamp({value})"


def page_offset(value: str) -> str:
    return f"coalesce({parse_u63(value)}, {DEFAULT_OFFSET}L)"


def page_size(value: str) -> str:
    return f"coalesce({parse_u63(value)}, {DEFAULT_PER_PAGE}L)"


def feature(features: str, name: str) -> str:
    return f"coalesce(array_contains({features}, {literal(name)}), false)"
