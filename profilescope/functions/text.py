r"""Analyzers as SQL expressions: every function takes the SQL text of an expression and returns one.

They compose into one expression that Spark parses once, work on whole texts, and stay in the JVM. Two
folded forms make the keyword tests plain ``contains`` calls, which stay inside generated code and need
no token arrays:

* ``substring_index(text)``: the lower-cased text plus, for words holding punctuation, the word
  without it. A term without white space is a substring of some delimited token exactly when it is
  a substring of this form.
* ``word_index(text)``: all word tokens, each between line feeds. A token (or a phrase of several)
  occurs exactly when it, between line feeds, is a substring of this form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.schema import ARRAY_TEXT_FIELDS, TEXT_FIELDS

# The 33 English stop words, and the length limits of the substring index.
ENGLISH_STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
).split()
TECH_STOP_WORDS = ["js"]
MIN_GRAM = 2
MAX_GRAM = 20

WHITESPACE = r"[ \t\n\x0B\f\r]"
NOT_WHITESPACE = r"[^ \t\n\x0B\f\r]"
WORD = r"[\p{L}\p{M}\p{N}_]+(?:[.'][\p{L}\p{M}\p{N}_]+)*"
PART = r"[\p{L}\p{M}]+|\p{N}+"
POSSESSIVE = r"([\p{L}\p{M}])'s([^\p{L}\p{M}\p{N}]|\z)"
MARK = r"[^\p{L}\p{M}\p{N} \t\n\x0B\f\r]"
PUNCTUATED_WORD = rf"(?<!{NOT_WHITESPACE})[\p{{L}}\p{{M}}\p{{N}}]*+{MARK}{NOT_WHITESPACE}*"
PUNCTUATION = MARK + "+"
BARE_MARKS = rf"(?<!{NOT_WHITESPACE}){MARK}+(?!{NOT_WHITESPACE})"
TRAILING_JS = r"(.*?)\.?js\z"

SEPARATOR = "\n"
VALUE_GAP = "\t"  # parts the values of an array field, so that no phrase runs over two values
STOPPED = " "  # holds the place of a removed stop word, so that phrases keep their gaps
NO_STRINGS = "cast(array() AS array<string>)"


def literal(value: str) -> str:
    """A string literal in which nothing is an escape but the escapes made here."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def literals(values: list[str]) -> str:
    return ", ".join(literal(v) for v in values)


def lowercase(text: str) -> str:
    return f"lower({text})"


def extract_all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, 0)"


def whitespace_tokens(text: str) -> str:
    return extract_all(text, NOT_WHITESPACE + "+")


def standard_tokens(text: str) -> str:
    """Unicode words: keeps ``react.js`` whole, drops ``+`` and ``#``."""
    return extract_all(text, WORD)


def without_possessive(text: str) -> str:
    return f"regexp_replace({text}, {literal(POSSESSIVE)}, '$1$2')"


def delimiter_parts(token: str) -> str:
    """Letter runs and digit runs of one token, without a trailing ``'s``."""
    return extract_all(without_possessive(token), PART)


def delimited_tokens(token: str) -> str:
    """One token as itself, its parts, and its parts joined."""
    parts = delimiter_parts(token)
    forms = f"concat(array({token}), {parts}, array(array_join({parts}, '')))"
    return f"filter(array_distinct({forms}), form -> form <> '')"


def is_stop_word(token: str) -> str:
    return f"{token} IN ({literals(ENGLISH_STOP_WORDS)})"


def is_tech_stop_word(token: str) -> str:
    return f"{token} IN ({literals(TECH_STOP_WORDS)})"


def drop_stop_words(tokens: str) -> str:
    return f"filter({tokens}, token -> NOT {is_stop_word('token')})"


def drop_tech_stop_words(tokens: str) -> str:
    return f"filter({tokens}, token -> NOT {is_tech_stop_word('token')})"


def strip_js(token: str) -> str:
    stripped = f"regexp_replace({token}, {literal(TRAILING_JS)}, '$1')"
    return f"CASE WHEN endswith({token}, 'js') THEN {stripped} ELSE {token} END"


def grams_of_length(token: str, length: str) -> str:
    """All substrings of one length, with repeats."""
    starts = f"sequence(1, length({token}) - {length} + 1)"
    return (
        f"CASE WHEN length({token}) >= {length} THEN "
        f"transform({starts}, start -> substr({token}, start, {length})) ELSE {NO_STRINGS} END"
    )


def grams(token: str, shortest: int = MIN_GRAM, longest: int = MAX_GRAM) -> str:
    """All substrings of ``token`` of the given lengths, with repeats."""
    lengths = f"sequence({shortest}, {longest})"
    return f"flatten(transform({lengths}, size -> {grams_of_length(token, 'size')}))"


def substring_tokens(text: str) -> str:
    """Every delimited token of every word of a text, in order, stop words included."""
    words = whitespace_tokens(lowercase(text))
    return f"flatten(transform({words}, word -> {delimited_tokens('word')}))"


def substring_token_counts(rows: DataFrame, text: str) -> DataFrame:
    """How often each of ``substring_tokens`` occurs in all rows: ``token, n``. Each distinct word is split once."""
    words = rows.selectExpr(f"explode({whitespace_tokens(lowercase(text))}) AS word")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    tokens = counted.selectExpr("times", f"explode({delimited_tokens('word')}) AS token")
    return tokens.groupBy("token").agg(F.sum("times").alias("n"))


def substring_positions(text: str) -> str:
    """Number of token positions: the parts of each word, at least one per word."""
    parts = f"regexp_count({without_possessive(lowercase(text))}, {literal(PART)})"
    return f"({parts} + regexp_count({text}, {literal(BARE_MARKS)}))"


def word_positions(text: str) -> str:
    """Word tokens in order, with a place holder for each stop word."""
    kept = f"CASE WHEN {is_stop_word('word')} THEN {literal(STOPPED)} ELSE {strip_js('word')} END"
    return f"transform({standard_tokens(lowercase(text))}, word -> {kept})"


def word_tokens(text: str) -> str:
    return f"filter({word_positions(text)}, kept -> kept <> {literal(STOPPED)})"


def squashed(text: str) -> str:
    """Words without their punctuation and their possessive ``'s``."""
    return f"regexp_replace({without_possessive(text)}, {literal(PUNCTUATION)}, '')"


def substring_index(text: str) -> str:
    lowered = lowercase(text)
    punctuated = f"array_join({extract_all(lowered, PUNCTUATED_WORD)}, {literal(SEPARATOR)})"
    return f"concat({lowered}, {literal(SEPARATOR)}, {squashed(punctuated)})"


def word_holds(word: str, terms: list[str]) -> str:
    """Whether one lower-case word holds any term, as it is or without its punctuation."""
    plain = " OR ".join(f"contains({word}, {literal(t)})" for t in terms)
    bare = " OR ".join(f"contains({squashed(word)}, {literal(t)})" for t in terms)
    return f"({plain} OR (rlike({word}, {literal(MARK)}) AND ({bare})))"


def word_index(text: str) -> str:
    """Empty for a text without words; an empty token can then still be told from no token."""
    joined = f"array_join({word_positions(text)}, {literal(SEPARATOR)})"
    between = f"concat({literal(SEPARATOR)}, {joined}, {literal(SEPARATOR)})"
    return f"CASE WHEN rlike({text}, {literal(WORD)}) THEN {between} ELSE '' END"


def field_items(name: str) -> str:
    if name in ARRAY_TEXT_FIELDS:
        return f"coalesce({name}, {NO_STRINGS})"
    return f"array(coalesce({name}, ''))"


def all_fields() -> str:
    """The values of every text field, in the order of ``TEXT_FIELDS``: an array of arrays.

    Expressions over the six fields are lambdas over this array, so they are planned once, not six times.
    """
    return f"array({', '.join(field_items(f) for f in TEXT_FIELDS)})"


def content(items: str) -> str:
    """One text from the values of a field, parted by white space."""
    return f"array_join({items}, {literal(SEPARATOR)})"


def folded(items: str, mode: str) -> str:
    """The folded form of one field's values that keyword tests of a mode look into."""
    if mode == "substring":
        return substring_index(content(items))
    return f"array_join(transform({items}, item -> {word_index('item')}), {literal(VALUE_GAP)})"


def index_column(name: str, mode: str) -> str:
    return f"_{mode}_{name}"


def with_text_indexes(profiles: DataFrame, modes: tuple[str, ...] = ("substring", "word")) -> DataFrame:
    """Store the folded forms beside the fields, so that searches only read them."""
    forms = [f"{folded(field_items(f), m)} AS {index_column(f, m)}" for m in modes for f in TEXT_FIELDS]
    return profiles.selectExpr("*", *forms)


def match_tokens(tokens: str, query_tokens: list[str]) -> str:
    """Any analysed query token occurs."""
    return f"coalesce(arrays_overlap({tokens}, array({literals(query_tokens)})), false)"


def match_phrase(tokens: str, query_tokens: list[str]) -> str:
    """All analysed query tokens occur one after the other."""
    mark = literal(SEPARATOR)
    between = f"concat({mark}, array_join({tokens}, {mark}), {mark})"
    wanted = literal(SEPARATOR + SEPARATOR.join(query_tokens) + SEPARATOR)
    return f"coalesce(contains({between}, {wanted}), false)"
