"""Keyword matching of a whole table of requests against a whole table of profiles.

Tokens of the profiles meet tokens of the requests in equi-joins, never in a cross join:

* whole words and exact values join on the token itself;
* substrings join on the token too, after the vocabulary (the distinct tokens) has met the query
  terms through its character grams of just the lengths that the requests use;
* phrases join on their words and are then counted per start position.

The side of the requests is broadcast only after its rows were counted, else hot tokens are salted. What
was found is written once, since both the document frequencies and the scores read it. The pairs are spread by ``(request_id, id)`` once, and the three aggregations
that follow (fields, clauses, verdict) all run on that partitioning.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.functions import text
from profilescope.functions.keywords import EXACT, SUBSTRING, WORD
from profilescope.operators.joins import hot_join, is_small, written_once
from profilescope.operators.relevance import SCORE_DIGITS, boosts, norm
from profilescope.schema import TEXT_FIELDS

if TYPE_CHECKING:
    from profilescope.sources.keyword_index import KeywordIndex

PHRASE = "phrase"
MODES = (SUBSTRING, WORD, PHRASE, EXACT)


def clause_tokens(requests: DataFrame) -> DataFrame:
    """One row per request, clause and token, with what the verdict needs of the whole request."""
    positive = "size(filter(clauses, c -> c.occur <> 'must_not'))"
    musts = "size(filter(clauses, c -> c.occur = 'must'))"
    clauses = requests.selectExpr(
        "request_id", "mode", f"{positive} AS positive", f"{musts} AS musts", "posexplode(clauses) AS (clause, c)"
    )
    return clauses.selectExpr(
        "request_id", "mode", "positive", "musts", "clause", "c.occur AS occur", "size(c.tokens) AS k",
        "explode(array_distinct(c.tokens)) AS q",
    ).where(
        f"mode <> '{SUBSTRING}' OR length(q) BETWEEN {text.MIN_GRAM} AND {text.MAX_GRAM}"
    )


def _items(profiles: DataFrame, mode: str) -> DataFrame:
    """One row per profile and text field: ``id, field, boost, items``."""
    names = text.literals(list(TEXT_FIELDS))
    return profiles.selectExpr("id", f"posexplode({text.all_fields()}) AS (f, items)").selectExpr(
        "id", f"array({names})[f] AS field", f"{boosts(mode)}[f] AS boost", "items"
    )


def _contents(profiles: DataFrame, mode: str) -> DataFrame:
    """One row per profile and text field: ``id, field, norm, content``."""
    contents = _items(profiles, mode).selectExpr("id", "field", "boost", f"{text.content('items')} AS content")
    return contents.where("content <> ''").selectExpr("id", "field", f"{norm('content', 'boost', mode)} AS norm", "content")


def _posted(found: DataFrame, mode: str, freq: str) -> DataFrame:
    return found.groupBy("q", "id", "field").agg(
        F.expr(freq).alias("freq"), F.min("norm").alias("norm")
    ).select(F.lit(mode).alias("mode"), "q", "id", "field", "freq", "norm")


def substring_postings(profiles: DataFrame, wanted: DataFrame, fits: bool) -> DataFrame:
    """Words are split into tokens and grams once per distinct word, not once per occurrence."""
    words = _contents(profiles, SUBSTRING).selectExpr(
        "id", "field", "norm", f"explode({text.whitespace_tokens(text.lowercase('content'))}) AS word"
    )
    lengths = wanted.agg(F.collect_set(F.length("q"))).scalar()  # at most 19 numbers
    vocabulary = words.select("word").distinct().withColumn("lengths", lengths)
    grams = vocabulary.selectExpr("word", "lengths", f"explode({text.delimited_tokens('word')}) AS token").selectExpr(
        "word", f"explode(flatten(transform(lengths, size -> {text.grams_of_length('token', 'size')}))) AS q"
    )
    contained = written_once(
        hot_join(grams, wanted, ["q"], ["word"], fits)
        .groupBy("q", "word")
        .agg(F.count(F.lit(1)).alias("times")),
        "words",
    )
    found = hot_join(words, contained, ["word"], ["id"], is_small(contained))
    return _posted(found, SUBSTRING, "sum(times)")


def word_postings(profiles: DataFrame, wanted: DataFrame, fits: bool) -> DataFrame:
    tokens = _contents(profiles, WORD).selectExpr(
        "id", "field", "norm", f"explode({text.word_tokens('content')}) AS q"
    )
    single = wanted.where(~F.col("q").contains(text.SEPARATOR))
    return _posted(hot_join(tokens, single, ["q"], ["id"], fits), WORD, "count(1)")


def phrase_postings(profiles: DataFrame, wanted: DataFrame, fits: bool) -> DataFrame:
    """Phrases: a start position counts when all words of the phrase are at their places after it."""
    mark = text.literal(text.SEPARATOR)
    words = wanted.where(F.col("q").contains(text.SEPARATOR)).selectExpr(
        "q", f"posexplode(split(q, {mark})) AS (place, token)",
        f"size(filter(split(q, {mark}), w -> w <> {text.literal(text.STOPPED)})) AS words",
    ).where(F.col("token") != text.STOPPED)
    items = _items(profiles, WORD).selectExpr(
        "id", "field", f"{norm(text.content('items'), 'boost', WORD)} AS norm", "posexplode(items) AS (item, value)"
    )
    tokens = items.selectExpr(
        "id", "field", "norm", "item", f"posexplode({text.word_positions('value')}) AS (spot, token)"
    )
    starts = (
        hot_join(tokens, words, ["token"], ["id"], fits)
        .groupBy("q", "id", "field", "item", (F.col("spot") - F.col("place")).alias("start"))
        .agg(F.count(F.lit(1)).alias("found"), F.min("words").alias("words"), F.min("norm").alias("norm"))
        .where("found = words")
    )
    return _posted(starts, WORD, "count(1)")


def exact_postings(profiles: DataFrame, wanted: DataFrame, fits: bool) -> DataFrame:
    values = _items(profiles, EXACT).selectExpr("id", "field", "boost AS norm", "explode(items) AS q")
    return _posted(hot_join(values, wanted, ["q"], ["id"], fits), EXACT, "count(1)")


def postings(profiles: DataFrame, tokens: DataFrame, modes: tuple[str, ...], fits: bool) -> DataFrame:
    """``mode, q, id, field, freq, norm`` for every query token found in a field."""

    def wanted(mode: str) -> DataFrame:
        return tokens.where(F.col("mode") == mode).select("q").distinct()

    found = []
    if SUBSTRING in modes:
        found.append(substring_postings(profiles, wanted(SUBSTRING), fits))
    if WORD in modes:
        found.append(word_postings(profiles, wanted(WORD), fits))
    if PHRASE in modes:
        found.append(phrase_postings(profiles, wanted(WORD), fits))
    if EXACT in modes:
        found.append(exact_postings(profiles, wanted(EXACT), fits))
    return reduce(DataFrame.unionByName, found)


def used_modes(requests: DataFrame) -> tuple[str, ...]:
    """The ways of matching that occur: at most four values, so that unused ones cost nothing."""
    phrase = f"mode = '{WORD}' AND contains(q, {text.literal(text.SEPARATOR)})"
    way = F.expr(f"CASE WHEN {phrase} THEN '{PHRASE}' ELSE mode END")
    return tuple(r[0] for r in clause_tokens(requests).select(way).distinct().collect())


def keyword_classes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose keywords say the same are one class: ``class, mode, clauses``, and members as ``request_id, class``.

    What is found depends on nothing else of a request, so it is judged once per class. Rows of one ``request_id`` stay together.
    """
    per_request = (
        requests.where("size(clauses) > 0")
        .groupBy("request_id")
        .agg(F.sort_array(F.collect_list(F.struct("mode", "clauses"))).alias("asked"))
    )
    classes = per_request.select("asked").distinct().withColumn("class", F.monotonically_increasing_id())
    classes = written_once(classes, "classes")
    members = per_request.join(classes, "asked").select("request_id", "class")
    return classes.selectExpr("class", "inline(asked)"), written_once(members, "members")


def judge_keywords(
    requests: DataFrame, profiles: DataFrame, modes: tuple[str, ...] | None = None, index: KeywordIndex | None = None
) -> DataFrame:
    """Every pair with a keyword hit: ``request_id, id, score, matched, barred``.

    With a stored ``index`` of the profiles, their texts are not read, but the postings of the tokens asked for.
    ``matched`` holds if all ``must`` and no ``must_not`` clauses hit, and without a ``must`` some
    ``should``. ``barred`` holds if a ``must_not`` clause hits.
    """
    judged, members = judge_classes(requests, profiles, modes, index)
    return of_members(judged, members).select("request_id", "id", "score", "matched", "barred")


def of_members(judged: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for classes, for each of their requests."""
    return hot_join(judged, members, ["class"], ["id"], is_small(members))


def judge_classes(
    requests: DataFrame, profiles: DataFrame, modes: tuple[str, ...] | None = None, index: KeywordIndex | None = None
) -> tuple[DataFrame, DataFrame]:
    """``judge_keywords`` for classes of requests (``class`` instead of ``request_id``), and the classes' members."""
    classes, members = keyword_classes(requests)
    judged = _judge(classes.withColumnRenamed("class", "request_id"), profiles, modes, index)
    return judged.withColumnRenamed("request_id", "class"), members


def _judge(
    requests: DataFrame, profiles: DataFrame, modes: tuple[str, ...] | None, index: KeywordIndex | None
) -> DataFrame:
    tokens = clause_tokens(requests)
    modes = used_modes(requests) if modes is None else modes
    if not modes:
        return requests.sparkSession.createDataFrame(
            [], f"request_id {requests.schema['request_id'].dataType.simpleString()}, id long, score double, "
            "matched boolean, barred boolean"
        )
    fits = is_small(tokens)
    found = postings(profiles, tokens, modes, fits) if index is None else index.postings(tokens, modes)
    found = written_once(found, "postings")
    frequency = (
        found.groupBy("mode", "q", "field")
        .agg(F.count(F.lit(1)).alias("df"))
        .groupBy("mode", "q")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "df"))).alias("df"))  # six fields at most
    )
    weighed = tokens.join(frequency, ["mode", "q"])
    total = profiles.agg(F.count(F.lit(1))).scalar() if index is None else F.lit(index.documents)
    pairs = (
        hot_join(found, weighed, ["mode", "q"], ["id"], fits)
        .withColumn("n", total)
        .selectExpr(
            "request_id", "id", "clause", "occur", "field", "positive", "musts", "k", "norm",
            "sqrt(freq) * pow(1D + ln(n / (df[field] + 1)), 2) AS weight",
        )
        .repartition("request_id", "id")
    )
    whole = ["request_id", "id", "positive", "musts"]
    per_field = pairs.groupBy(*whole, "clause", "occur", "k", "field").agg(
        (F.count(F.lit(1)) / F.col("k") * F.sum("weight") * F.min("norm")).alias("s")
    )
    per_clause = per_field.groupBy(*whole, "clause", "occur").agg(F.max("s").alias("s"))
    verdict = per_clause.groupBy(*whole).agg(
        F.count_if(F.col("occur") == "must").alias("must_hits"),
        F.count_if(F.col("occur") == "must_not").alias("barred_hits"),
        F.count_if(F.col("occur") != "must_not").alias("hits"),
        F.sum(F.expr("CASE WHEN occur <> 'must_not' THEN s END")).alias("sum"),
    )
    return verdict.selectExpr(
        "request_id", "id",
        f"CASE WHEN hits > 0 THEN round(hits / positive * sum, {SCORE_DIGITS}) ELSE 0D END AS score",
        "must_hits = musts AND barred_hits = 0 AND hits > 0 AS matched",
        "barred_hits > 0 AS barred",
    )


def match_keywords(
    requests: DataFrame, profiles: DataFrame, modes: tuple[str, ...] | None = None, index: KeywordIndex | None = None
) -> DataFrame:
    """Pairs that keywords with at least one positive clause select: ``request_id, id, score``."""
    judged, members = judge_classes(requests, profiles, modes, index)
    return of_members(judged.where("matched"), members).select("request_id", "id", "score")
