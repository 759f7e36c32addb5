"""Keyword strings as clauses.

A clause is ``(occur, tokens)``: ``must``, ``should`` or ``must_not``, and the analysed tokens any of
which satisfies it. In word mode a quoted phrase is one token whose words are parted by line feeds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from profilescope.functions import text

SUBSTRING, WORD, EXACT = "substring", "word", "exact"
OPERATORS = ["AND", "OR", "NOT", "+", "-"]
TERMS = r'[+-]?"[^"]*"|' + text.NOT_WHITESPACE + "+"
CLAUSES_TYPE = "array<struct<occur:string,tokens:array<string>>>"


@dataclass(frozen=True)
class Clause:
    occur: str
    tokens: tuple[str, ...]


@dataclass(frozen=True)
class KeywordQuery:
    mode: str
    clauses: tuple[Clause, ...] = field(default_factory=tuple)

    @property
    def positive(self) -> list[Clause]:
        return [c for c in self.clauses if c.occur != "must_not"]

    def with_occur(self, occur: str) -> list[Clause]:
        return [c for c in self.clauses if c.occur == occur]


def keyword_mode(keywords: str, whole_words: str) -> str:
    """Whole-word mode wins; otherwise one quote makes every term exact."""
    return (
        f"CASE WHEN {whole_words} THEN '{WORD}' "
        f"WHEN contains({keywords}, '\"') THEN '{EXACT}' ELSE '{SUBSTRING}' END"
    )


def has_keywords(keywords: str) -> str:
    return f"coalesce({keywords} <> '', false)"


def phrase_token(term: str) -> str:
    """The words of a phrase as one token, inner stop words kept as gaps."""
    joined = f"array_join({text.word_positions(term)}, {text.literal(text.SEPARATOR)})"
    gaps = rf"\A(?:{text.STOPPED}\n)+|(?:\n{text.STOPPED})+\z"
    return f"regexp_replace({joined}, {text.literal(gaps)}, '')"


def query_tokens(term: str, quoted: str, mode: str) -> str:
    pieces = text.delimited_tokens(text.lowercase(term))
    substring = text.drop_tech_stop_words(text.drop_stop_words(pieces))
    words = text.word_tokens(term)
    return (
        f"CASE WHEN {mode} = '{SUBSTRING}' THEN {substring} "
        f"WHEN {mode} = '{WORD}' AND {quoted} AND size({words}) > 1 THEN array({phrase_token(term)}) "
        f"WHEN {mode} = '{WORD}' THEN {words} ELSE array({term}) END"
    )


def keyword_clauses(keywords: str, mode: str) -> str:
    """The clauses of a keyword string. Terms without tokens (stop words) are dropped."""
    terms = text.extract_all(keywords, TERMS)
    # Each term with its neighbours; the operator before a sign is one place further back.
    placed = (
        f"transform({terms}, (term, place) -> named_struct('term', term, "
        f"'before', get({terms}, place - 1), 'earlier', get({terms}, place - 2), "
        f"'next', get({terms}, place + 1), "
        f"'sign', CASE WHEN length(term) > 1 AND left(term, 1) IN ('+', '-') THEN left(term, 1) ELSE '' END))"
    )
    body = "substr(t.term, length(t.sign) + 1)"
    joined = "CASE WHEN t.before IN ('NOT', '+', '-') THEN t.earlier ELSE t.before END"
    occur = (
        "CASE WHEN t.sign = '-' OR t.before <=> 'NOT' OR t.before <=> '-' THEN 'must_not' "
        f"WHEN t.sign = '+' OR t.before <=> '+' OR ({joined}) <=> 'AND' OR t.next <=> 'AND' "
        "THEN 'must' ELSE 'should' END"
    )
    operands = f"filter({placed}, t -> t.term NOT IN ({text.literals(OPERATORS)}))"
    plain = f"replace({body}, '\"', '')"
    tokens = query_tokens(plain, f"startswith({body}, '\"')", mode)
    clauses = f"transform({operands}, t -> named_struct('occur', {occur}, 'tokens', {tokens}))"
    kept = f"size(c.tokens) > 0 AND ({mode} = '{WORD}' OR exists(c.tokens, part -> part <> ''))"
    return (
        f"CASE WHEN {has_keywords(keywords)} THEN filter({clauses}, c -> {kept}) "
        f"ELSE cast(array() AS {CLAUSES_TYPE}) END"
    )


def analyse_keywords(spark: SparkSession, keywords: str | None, whole_words: bool) -> KeywordQuery | None:
    """Analyse the keywords of one request; an empty string asks for nothing.

    The one-row relation is literal, so the optimizer evaluates it and no job runs.
    """
    if not keywords:
        return None
    row = spark.sql(
        f"SELECT mode, {keyword_clauses('keywords', 'mode')} AS clauses FROM (SELECT keywords, "
        f"{keyword_mode('keywords', 'whole_words')} AS mode "
        "FROM VALUES (:keywords, :whole_words) AS request(keywords, whole_words))",
        args={"keywords": keywords, "whole_words": whole_words},
    ).first()
    return KeywordQuery(
        row["mode"], tuple(Clause(c["occur"], tuple(c["tokens"])) for c in row["clauses"])
    )
