"""Highlights: per field the words that hold a hit, each with the gap before it, HTML-encoded."""

from __future__ import annotations

from profilescope.functions import text
from profilescope.functions.keywords import EXACT, SUBSTRING, WORD, KeywordQuery
from profilescope.operators.fulltext import matchable, may_hold
from profilescope.schema import TEXT_FIELDS

# Default of fragments per field, fields with a whole-word highlight, encoded characters.
FRAGMENTS = 5
WORD_HIGHLIGHT_FIELDS = ["skills", "summary", "headline"]
HTML_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;", "/": "&#x2F;"}

HIGHLIGHT_TYPE = "map<string,array<string>>"
SPACED_WORD = rf"{text.WHITESPACE}*{text.NOT_WHITESPACE}+(?:{text.WHITESPACE}+\z)?"
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"
TOKEN_WITH_GAP = rf"{NOT_WORD}*{text.WORD}(?:{NOT_WORD}*\z)?"


def html_encode(value: str) -> str:
    for plain, entity in HTML_ENTITIES.items():
        value = f"replace({value}, {text.literal(plain)}, {text.literal(entity)})"
    return value


def highlighted_fields(mode: str) -> list[str]:
    return WORD_HIGHLIGHT_FIELDS if mode == WORD else list(TEXT_FIELDS)


def field_label(name: str, mode: str) -> str:
    return name + {WORD: ".keyword", EXACT: ".raw", SUBSTRING: ""}[mode]


def _is_hit(piece: str, mode: str, tokens: list[str]) -> str:
    if mode == EXACT:
        return f"{piece} IN ({text.literals(tokens)})"
    if mode == WORD:
        words = list(dict.fromkeys(w for t in tokens for w in t.split(text.SEPARATOR)))
        word = f"regexp_extract({piece}, {text.literal(text.WORD)}, 0)"
        return f"{text.strip_js(text.lowercase(word))} IN ({text.literals(words)})"
    # Bound as a lambda variable, so that a piece is lowered once.
    return f"exists(array({text.lowercase(piece)}), low -> {text.word_holds('low', tokens)})"


def fragments_of(value: str, mode: str) -> str:
    if mode == EXACT:
        return f"array({value})"
    return text.extract_all(value, SPACED_WORD if mode == SUBSTRING else TOKEN_WITH_GAP)


def _holds(piece: str, mode: str, tokens: str) -> str:
    """``_is_hit`` for tokens in an array column."""
    if mode == EXACT:
        return f"array_contains({tokens}, {piece})"
    if mode == WORD:
        words = f"flatten(transform({tokens}, t -> split(t, {text.literal(text.SEPARATOR)})))"
        word = f"regexp_extract({piece}, {text.literal(text.WORD)}, 0)"
        return f"array_contains({words}, {text.strip_js(text.lowercase(word))})"
    low = text.lowercase(piece)
    plain, bare = (f"exists({tokens}, t -> contains({x}, t))" for x in (low, text.squashed(low)))
    return f"({plain} OR (rlike({low}, {text.literal(text.MARK)}) AND {bare}))"


def _mapped(mode: str, hit: str, most: int, worth: str = "true") -> str:
    """A map from field to the first pieces for which ``hit`` holds of ``piece``; null without any.

    Only items for which ``worth`` holds of ``item`` are split into pieces.
    """
    labels = {field_label(f, mode): text.field_items(f) for f in highlighted_fields(mode)}
    fields = ", ".join(f"named_struct('key', {text.literal(k)}, 'items', {v})" for k, v in labels.items())
    items = "field.items" if worth == "true" else f"filter(field.items, item -> {worth})"
    pieces = f"flatten(transform({items}, item -> {fragments_of('item', mode)}))"
    shown = f"transform(slice(filter({pieces}, piece -> {hit}), 1, {most}), p -> {html_encode('p')})"
    entries = f"transform(array({fields}), field -> named_struct('key', field.key, 'value', {shown}))"
    found = f"filter({entries}, e -> size(e.value) > 0)"
    # Bound as a lambda variable, so that the entries are built once.
    mapped = "CASE WHEN size(found) > 0 THEN map_from_entries(found) END"
    return f"transform(array({found}), found -> {mapped})[0]"


def highlights(query: KeywordQuery, fragments: int = FRAGMENTS) -> str:
    """A map from field to its first ``fragments`` fragments; fields without a hit are absent, no hit at all is null."""
    tokens = [t for c in query.positive for t in c.tokens if matchable(query.mode, t)]
    if not tokens:
        return f"cast(null AS {HIGHLIGHT_TYPE})"
    tokens = list(dict.fromkeys(tokens))
    # Any word of a phrase is a hit.
    worth = may_hold("item", query.mode, list(dict.fromkeys(w for t in tokens for w in t.split(text.SEPARATOR))))
    return _mapped(query.mode, _is_hit("piece", query.mode, tokens), fragments, worth)


def row_highlights(mode: str, tokens: str, fragments: int = FRAGMENTS) -> str:
    """``highlights`` where each row has its own mode and array of tokens, as columns."""
    ways = " ".join(f"WHEN '{m}' THEN {_mapped(m, _holds('piece', m, tokens), fragments)}" for m in (SUBSTRING, WORD, EXACT))
    return f"CASE WHEN size({tokens}) > 0 THEN CASE {mode} {ways} END END"
