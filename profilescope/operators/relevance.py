"""Relevance of one request: TF-IDF per field with boosts, best field per clause, sum over clauses.

    idf(q, f)   = 1 + ln(N / (df + 1))
    field(f, d) = matched tokens / tokens * sum of sqrt(freq) * idf^2 * boost / sqrt(positions)
    clause(d)   = best field
    score(d)    = matched positive clauses / positive clauses * sum of clauses

Corpus statistics are one row (N and one count per query token and field): a scalar subquery, so
nothing that grows with the table is broadcast. Frequencies are counted for matching rows only.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.functions import text
from profilescope.functions.keywords import EXACT, SUBSTRING, WORD, KeywordQuery
from profilescope.operators.fulltext import content_test, folded_fields, matchable, pattern, value_test
from profilescope.schema import TEXT_FIELDS, WORD_BOOST

if TYPE_CHECKING:
    from profilescope.sources.keyword_index import KeywordIndex

STATS = "_corpus"
SCORE_DIGITS = 9  # sums of doubles depend on their order; rounded scores rank the same on every run


def field_boost(name: str, mode: str) -> float:
    """Whole-word forms weigh 2, exact forms 1, whole texts by field."""
    return {WORD: WORD_BOOST, EXACT: 1.0}.get(mode, TEXT_FIELDS[name])


def scored_tokens(query: KeywordQuery) -> list[str]:
    return list(dict.fromkeys(t for c in query.positive for t in c.tokens if matchable(query.mode, t)))


def corpus_statistics(profiles: DataFrame, query: KeywordQuery) -> DataFrame:
    """One row: the number of rows and, per query token and field, the rows that contain it."""
    mode = query.mode
    if mode != EXACT:
        profiles = profiles.selectExpr(f"{folded_fields(mode, profiles.columns, scored_tokens(query))} AS _folded")

    def test(place: int, field: str, token: str) -> str:
        return value_test(field, token) if mode == EXACT else content_test(f"_folded[{place}]", mode, token)

    per_token = [
        "array(" + ", ".join(f"count_if({test(i, f, token)})" for i, f in enumerate(TEXT_FIELDS)) + ")"
        for token in scored_tokens(query)
    ]
    return profiles.selectExpr(
        f"named_struct('n', count(1), 'df', array({', '.join(per_token)})) AS {STATS}"
    )


def stored_statistics(index: KeywordIndex, query: KeywordQuery) -> DataFrame | None:
    """The row of ``corpus_statistics`` from the stored document frequencies; None for terms that are not single tokens.

    Of the stored table only rows of the query's tokens are read on.
    """
    tokens = scored_tokens(query)
    if query.mode == SUBSTRING or (query.mode == WORD and any(text.SEPARATOR in t for t in tokens)):
        return None
    known = index.term_statistics(query.mode).where(F.col("token").isin(tokens))

    def count(token: str, field: str) -> str:
        return f"coalesce(sum(CASE WHEN token = {text.literal(token)} AND field = '{field}' THEN df END), 0L)"

    per_token = ["array(" + ", ".join(count(t, f) for f in TEXT_FIELDS) + ")" for t in tokens]
    return known.selectExpr(f"named_struct('n', {index.documents}L, 'df', array({', '.join(per_token)})) AS {STATS}")


def term_statistics(profiles: DataFrame, mode: str = WORD) -> DataFrame:
    """Document frequency of every token of every field, as a table: ``field, token, df``.

    Tokens are made distinct per row before they are exploded, and counts are combined before the
    shuffle, so one frequent token costs one row per task.
    """
    tokens = text.word_tokens if mode == WORD else text.substring_tokens
    names = text.literals(list(TEXT_FIELDS))
    return (
        profiles.selectExpr(f"posexplode({text.all_fields()}) AS (place, items)")
        .selectExpr(f"array({names})[place] AS field", f"array_distinct({tokens(text.content('items'))}) AS tokens")
        .selectExpr("field", "explode(tokens) AS token")
        .groupBy("field", "token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def _countable(query: KeywordQuery, columns: list[str]) -> str:
    """Per field the text in which occurrences are counted: only words that hold a query token are split."""
    if query.mode == WORD:
        return folded_fields(WORD, columns, scored_tokens(query))
    words = text.whitespace_tokens(text.lowercase(text.content("items")))
    holding = f"filter({words}, w -> {text.word_holds('w', scored_tokens(query))})"
    tokens = f"flatten(transform({holding}, w -> {text.delimited_tokens('w')}))"
    return f"transform({text.all_fields()}, items -> array_join({tokens}, {text.literal(text.SEPARATOR)}))"


def _frequencies(query: KeywordQuery) -> str:
    """Per query token and field the number of occurrences, overlapping ones included."""
    tokens = scored_tokens(query)
    if query.mode == EXACT:
        counts = [
            f"transform({text.all_fields()}, items -> size(filter(items, item -> item = {text.literal(t)})))"
            for t in tokens
        ]
    else:
        counts = [
            f"transform(_countable, form -> regexp_count(form, {text.literal(f'(?={pattern(query.mode, t)})')}))"
            for t in tokens
        ]
    return f"array({', '.join(counts)})"


def norm(content: str, boost: str, mode: str) -> str:
    """Boost over the square root of the number of token positions; exact values have no length."""
    if mode == EXACT:
        return f"({boost})"
    positions = text.substring_positions(content) if mode == SUBSTRING else f"size({text.word_tokens(content)})"
    return f"({boost}) / sqrt(greatest({positions}, 1))"


def boosts(mode: str) -> str:
    return "array(" + ", ".join(f"{field_boost(f, mode)}D" for f in TEXT_FIELDS) + ")"


def with_score(
    matches: DataFrame, profiles: DataFrame, query: KeywordQuery, name: str = "score", statistics: DataFrame | None = None
) -> DataFrame:
    """Add the relevance of each row of ``matches``; statistics come from all of ``profiles``, if they aren't given."""
    tokens, columns = scored_tokens(query), matches.columns
    if not tokens:
        return matches.withColumn(name, F.lit(0.0))
    slot = {token: i for i, token in enumerate(tokens)}
    countable = "array('')" if query.mode == EXACT else _countable(query, columns)
    field_norm = norm(text.content("items"), f"{boosts(query.mode)}[f]", query.mode)
    if query.mode != EXACT:  # the length of a field without a hit, which scores nothing, is not needed
        field_norm = f"CASE WHEN replace(_countable[f], {text.literal(text.VALUE_GAP)}, '') <> '' THEN {field_norm} ELSE 0D END"
    norms = f"transform({text.all_fields()}, (items, f) -> {field_norm})"

    def clause_score(clause_tokens: tuple[str, ...]) -> str:
        slots = [slot[t] for t in clause_tokens if t in slot]
        if not slots:
            return "0D"
        matched = " + ".join(f"cast(_freq[{i}][f] > 0 AS int)" for i in slots)
        weight = " + ".join(f"sqrt(_freq[{i}][f]) * _weight[{i}][f]" for i in slots)
        return (
            f"array_max(transform(_norm, (norm, f) -> "
            f"({matched}) / {float(len(clause_tokens))}D * ({weight}) * norm))"
        )

    clauses = [clause_score(c.tokens) for c in query.positive]
    total = "aggregate(_clauses, 0D, (total, c) -> total + c)"
    found = f"size(filter(_clauses, c -> c > 0)) / {float(len(clauses))}D"
    weights = (
        f"transform({STATS}.df, per_field -> transform(per_field, df -> "
        f"pow(1D + ln({STATS}.n / (df + 1)), 2)))"
    )
    return (
        matches.selectExpr("*", f"{countable} AS _countable")
        .selectExpr("*", f"{norms} AS _norm")
        .withColumn(STATS, (corpus_statistics(profiles, query) if statistics is None else statistics).scalar())
        .selectExpr("*", f"{_frequencies(query)} AS _freq", f"{weights} AS _weight")
        .selectExpr("*", f"array({', '.join(clauses)}) AS _clauses")
        .selectExpr(*columns, f"round({found} * {total}, {SCORE_DIGITS}) AS {name}")
    )
