"""Keyword matching of one request as a SQL condition: substring, whole word and exact mode."""

from __future__ import annotations

import re

from profilescope.functions import text
from profilescope.functions.keywords import EXACT, SUBSTRING, WORD, Clause, KeywordQuery
from profilescope.schema import ARRAY_TEXT_FIELDS, TEXT_FIELDS


def matchable(mode: str, token: str) -> bool:
    """Substring mode indexes lengths 2 to 20 only; other tokens can never match."""
    return mode != SUBSTRING or text.MIN_GRAM <= len(token) <= text.MAX_GRAM


def needle(mode: str, token: str) -> str:
    """What a folded field contains exactly when the token occurs."""
    return text.SEPARATOR + token + text.SEPARATOR if mode == WORD else token


def has_gap(mode: str, token: str) -> bool:
    return mode == WORD and text.SEPARATOR + text.STOPPED + text.SEPARATOR in token


def pattern(mode: str, token: str) -> str:
    """The needle as a regular expression; the place of a stop word in a phrase takes any word."""
    gap = re.escape(text.STOPPED)
    inner = re.escape(needle(mode, token))
    if not has_gap(mode, token):
        return inner
    mark = re.escape(text.SEPARATOR)
    return re.sub(f"(?<={re.escape(mark)}){re.escape(gap)}(?={re.escape(mark)})", lambda _: "[^\\n\\t]+", inner)


def content_test(content: str, mode: str, token: str) -> str:
    if has_gap(mode, token):
        return f"rlike({content}, {text.literal(pattern(mode, token))})"
    return f"contains({content}, {text.literal(needle(mode, token))})"


def is_stored(mode: str, columns: list[str]) -> bool:
    return text.index_column("summary", mode) in columns


def may_hold(value: str, mode: str, tokens: list[str]) -> str:
    """A cheap test that a value without any of the tokens mostly fails, and one with a token never.

    The words of a token stand in the lower-cased text as they are. Lower case of plain letters doesn't depend on what
    is beside them; other tokens, and terms of substring mode, which marks may part, pass.
    """
    if mode != WORD or not all(t.isascii() for t in tokens):
        return "true"

    def words(token: str) -> str:
        parts = [w for w in dict.fromkeys(token.split(text.SEPARATOR)) if w != text.STOPPED]
        return " AND ".join(f"contains(low, {text.literal(w)})" for w in parts) or "true"

    return f"exists(array({text.lowercase(value)}), low -> " + " OR ".join(f"({words(t)})" for t in tokens) + ")"


def folded_fields(mode: str, columns: list[str], tokens: list[str]) -> str:
    """The folded form of every text field as an array, stored or computed; values in which no token can be are empty."""
    if is_stored(mode, columns):
        return f"array({', '.join(text.index_column(f, mode) for f in TEXT_FIELDS)})"
    worth = may_hold("item", mode, tokens)
    items = "items" if worth == "true" else f"transform(items, item -> CASE WHEN {worth} THEN item ELSE '' END)"
    return f"transform({text.all_fields()}, items -> {text.folded(items, mode)})"


def value_test(name: str, token: str) -> str:
    """Whether a whole value of a field equals the token."""
    if name in ARRAY_TEXT_FIELDS:
        return f"coalesce(array_contains({name}, {text.literal(token)}), false)"
    return f"coalesce({name} = {text.literal(token)}, false)"


def clause_matches(clause: Clause, mode: str, columns: list[str]) -> str:
    """Any token of the clause in any of the six fields.

    Stored forms are tested one by one inside generated code; else each field is folded once per row.
    """
    tokens = [t for t in clause.tokens if matchable(mode, t)]
    if not tokens:
        return "false"
    if mode == EXACT:
        tests = [value_test(f, t) for f in TEXT_FIELDS for t in tokens]
    elif is_stored(mode, columns):
        tests = [content_test(text.index_column(f, mode), mode, t) for f in TEXT_FIELDS for t in tokens]
    else:
        hits = " OR ".join(content_test("form", mode, t) for t in tokens)
        return f"exists({folded_fields(mode, columns, tokens)}, form -> {hits})"
    return "(" + " OR ".join(tests) + ")"


def keywords_predicate(query: KeywordQuery, columns: list[str]) -> str:
    """All ``must``, no ``must_not``, and without a ``must`` at least one ``should``."""
    if not query.clauses:
        return "false"

    def tests(occur: str) -> list[str]:
        return [clause_matches(c, query.mode, columns) for c in query.with_occur(occur)]

    must, should, must_not = tests("must"), tests("should"), tests("must_not")
    conditions = must + [f"NOT {m}" for m in must_not]
    if should and not must:
        conditions.append("(" + " OR ".join(should) + ")")
    return " AND ".join(conditions)
