"""One search over one profile table.

The whole request becomes one filter Column. A page is ``orderBy.offset.limit``, which Spark runs as
a distributed top-k; the total is a separate count that reads only the filter columns.
"""

from __future__ import annotations

import contextlib
import io
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilescope.functions import predicates as p
from profilescope.functions.keywords import KeywordQuery, analyse_keywords
from profilescope.operators.deep_pages import SHALLOW, Key, key_page
from profilescope.operators.fulltext import keywords_predicate
from profilescope.operators.highlight import HIGHLIGHT_TYPE, highlights
from profilescope.operators.joins import written_once
from profilescope.operators.relevance import stored_statistics, with_score
from profilescope.plans.requests import SearchRequest

if TYPE_CHECKING:
    from profilescope.sources.keyword_index import KeywordIndex

#: The name of the table that searches are about, if none is told.
DEFAULT_TABLE = "profiles"
HIT_FIELDS = [
    "id",
    "headline",
    "avatar_url",
    "work_locations",
    "current_location",
    "salary_expectations",
    "roles_experiences",
    "latest_position",
    "batch_starts_at",
]


def visibility(request: SearchRequest, like: str) -> Column:
    """Accepted and inside the batch window, or of exactly one batch; presented ids pass as well.

    An instant that can't be read shows nothing.
    """
    instant = p.instant_literal(request.as_of if request.epoch is None else request.epoch, like)
    rule = p.visible_at(instant) if request.epoch is None else p.in_batch(instant)
    shown = p.any_of([rule, p.scalar_in("id", request.presented)])
    return p.all_of([shown, instant.isNotNull()])


def facets(request: SearchRequest, instant_type: str) -> Column:
    """Values of one facet are alternatives; facets all have to hold."""
    return p.all_of(
        [
            p.array_all("languages", request.languages),
            p.scalar_in("professional_experience", request.professional_experience),
            p.scalar_in("work_authorization", request.work_authorization),
            p.array_any("work_locations", request.work_locations),
            p.scalar_in("current_location", request.current_location),
            p.scalar_in("id", request.bookmarked),
            visibility(request, instant_type),
            p.salary_within(request.maximum_salary, request.work_locations),
            p.role_matches(request.roles),
            p.array_lacks("contacted_company_ids", request.company_id),
            p.array_lacks("blocked_companies", request.company_id),
            p.not_in("id", request.contacted),
            p.not_in("id", request.ignored),
        ]
    )


def roles_experiences() -> Column:
    """One entry per role; a missing experience is empty, surplus experiences are dropped."""
    experience = F.col("desired_work_roles_experience")
    return F.transform(
        "desired_work_roles",
        lambda role, i: F.struct(
            role.alias("role"), F.coalesce(F.get(experience, i), F.lit("")).alias("experience")
        ),
    )


BUSINESS_KEYS = [*(Key(c, descending=True) for c in ("batch_starts_at", "weight", "added_to_batch_at")), Key("id")]
RELEVANCE_KEYS = [Key("score", descending=True), Key("id")]


def business_order() -> list[Column]:
    return [k.column() for k in BUSINESS_KEYS]


def relevance_order() -> list[Column]:
    return [k.column() for k in RELEVANCE_KEYS]


def _instant_type(profiles: DataFrame) -> str:
    return profiles.schema["batch_starts_at"].dataType.simpleString()


def matches(
    profiles: DataFrame, request: SearchRequest, index: KeywordIndex | None = None, table: str = DEFAULT_TABLE
) -> tuple[DataFrame, KeywordQuery | None]:
    """All matching rows, scored if there are keywords, in no order.

    ``table`` is the name of the profiles' table; a request that names another one finds nothing in it.

    With the stored ``index`` of the profiles, the document frequencies of single tokens come from there, and texts are
    read once.
    """
    query = analyse_keywords(profiles.sparkSession, request.keywords, request.whole_words)
    condition = facets(request, _instant_type(profiles))
    if (request.index or table) != table:
        condition = F.lit(False)
    if query is None:
        return profiles.where(condition), None
    if not request.keywords_should:
        condition = condition & F.expr(keywords_predicate(query, profiles.columns))
    statistics = None if index is None else stored_statistics(index, query)
    scored = with_score(profiles.where(condition), profiles, query, statistics=statistics)
    if request.min_score is not None:
        # Generated as a row, so that the filter doesn't move below, where the score would be computed for it once more.
        scored = scored.select(*profiles.columns, F.explode(F.array("score")).alias("score"))
        scored = scored.where(F.col("score") >= request.min_score)
    return scored, query


def _project(found: DataFrame, query: KeywordQuery | None, fragments: int) -> DataFrame:
    """Only the public fields, with highlights (null without keywords)."""
    fields = [f if f != "roles_experiences" else roles_experiences().alias(f) for f in HIT_FIELDS]
    highlight = F.lit(None).cast(HIGHLIGHT_TYPE) if query is None else F.expr(highlights(query, fragments))
    score = [F.col("score")] if query is not None else []
    return found.select(*fields, highlight.alias("highlight"), *score)


LAST_PLACE = 2**31 - 1


def ordered(
    profiles: DataFrame, request: SearchRequest, index: KeywordIndex | None = None, table: str = DEFAULT_TABLE
) -> tuple[DataFrame, KeywordQuery | None]:
    found, query = matches(profiles, request, index, table)
    order = business_order() if query is None else relevance_order()
    return found.orderBy(*order), query


def search_profiles(
    profiles: DataFrame, request: SearchRequest, index: KeywordIndex | None = None, table: str = DEFAULT_TABLE
) -> DataFrame:
    """One page of hits; places from 2^31 - 1 on, which Spark cannot name, hold none.

    A page far down is found by its keys (see ``deep_pages.py``); the hits' keys are then written once.
    """
    found, query = ordered(profiles, request, index, table)
    start = min(request.offset, LAST_PLACE)
    if start + min(request.per_page, LAST_PLACE - start) > SHALLOW and start:
        return _deep_page(profiles, request, index, table)
    return _project(found.offset(start).limit(min(request.per_page, LAST_PLACE - start)), query, request.fragments)


def _deep_page(profiles: DataFrame, request: SearchRequest, index: KeywordIndex | None, table: str) -> DataFrame:
    found, query = matches(profiles, request, index, table)
    keys = BUSINESS_KEYS if query is None else RELEVANCE_KEYS
    known = written_once(found.select(*(k.name for k in keys)), "keys")
    start = min(request.offset, LAST_PLACE)
    page = key_page(known, keys, start, min(request.per_page, LAST_PLACE - start)).select("id")
    return _project(found.join(page, "id", "left_semi").orderBy(*(k.column() for k in keys)), query, request.fragments)


def all_hits(
    profiles: DataFrame, request: SearchRequest, index: KeywordIndex | None = None, table: str = DEFAULT_TABLE
) -> DataFrame:
    """Every hit in order, without paging.

    A sort reads its rows twice, first for a sample of the keys; hits with a score are dealt out before, so that they are
    scored, and their words highlighted, once.
    """
    found, query = matches(profiles, request, index, table)
    if query is None:
        return _project(found.orderBy(*business_order()), None, request.fragments)
    shown = _project(found, query, request.fragments)
    return shown.repartition("score", "id").orderBy(*relevance_order())


def total_hits(profiles: DataFrame, request: SearchRequest, table: str = DEFAULT_TABLE) -> DataFrame:
    found, query = matches(profiles, request, table=table)
    if query is not None and request.min_score is None:
        found = found.drop("score")  # lets the optimizer leave the scoring out of the count
    return found.agg(F.count(F.lit(1)).alias("total"))


def explain_search(profiles: DataFrame, request: SearchRequest, table: str = DEFAULT_TABLE) -> str:
    """The formatted plan of a search, for debugging."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        search_profiles(profiles, request, table=table).explain("formatted")
    return text.getvalue()


def search_results(profiles: DataFrame, request: SearchRequest, table: str = DEFAULT_TABLE) -> DataFrame:
    """One row ``{total, talents: [{talent, highlight}], raw_es_query}`` for a page.

    Only the page, at most ``per_page`` rows, is gathered; the total is a scalar subquery.
    """
    page = search_profiles(profiles, request, table=table)
    hit = F.struct(F.struct(*HIT_FIELDS).alias("talent"), "highlight").alias("hit")
    placed = page.select(F.monotonically_increasing_id().alias("place"), hit)
    talents = F.expr(
        "transform(array_sort(collect_list(struct(place, hit)), "
        "(a, b) -> cast(sign(a.place - b.place) AS int)), x -> x.hit)"
    )
    raw_query = F.lit(explain_search(profiles, request, table) if request.debug else None).cast("string")
    return placed.agg(talents.alias("talents")).select(
        total_hits(profiles, request, table).scalar().alias("total"), "talents", raw_query.alias("raw_es_query")
    )


def to_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def select_table(spark: SparkSession, default: str, requested: str | None, empty: DataFrame) -> DataFrame:
    """The requested table or the default one; a missing table is an empty result."""
    name = requested or default
    return spark.table(name) if spark.catalog.tableExists(name) else empty


def search_tables(spark: SparkSession, request: SearchRequest, empty: DataFrame, default: str = DEFAULT_TABLE) -> DataFrame:
    """A page of hits from the table that the request names, or from the default one; none from a missing table."""
    name = request.index or default
    return search_profiles(select_table(spark, default, request.index, empty), request, table=name)
