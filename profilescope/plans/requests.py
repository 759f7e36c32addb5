"""Search requests: raw parameter maps decoded to typed rows, one request or a whole table."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from profilescope.functions import keywords as kw
from profilescope.functions import values as v
from profilescope.operators.highlight import FRAGMENTS

NO_FULLTEXT_SEARCH = "no_fulltext_search"
KEYWORDS_SHOULD = "keywords_should"
STRING_LISTS = (
    "professional_experience",
    "work_authorization",
    "work_locations",
    "current_location",
    "languages",
)
ID_LISTS = {
    "presented": "presented_talents",
    "bookmarked": "bookmarked_talents",
    "contacted": "contacted_talents",
    "ignored": "ignored_talents",
}


def _bound(rows: DataFrame, keep: list[str], columns: dict[str, str], once: bool) -> DataFrame:
    """``keep`` and the new columns. With ``once`` they are generated as one row each, which filters do
    not move below: an expression used by many later conditions is then evaluated, and planned, once.
    """
    if not once:
        return rows.selectExpr(*keep, *[f"{sql} AS `{name}`" for name, sql in columns.items()])
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return rows.selectExpr(*keep, f"inline(array(named_struct({fields})))")


def decode_requests(raw: DataFrame, params: str = "params", once: bool = True) -> DataFrame:
    """Typed requests from a ``map<string,string>`` column of raw parameters.

    List parameters are JSON lists, scalars plain text. All other columns (``request_id``) stay. The
    work is SQL expressions only: one narrow pass without Python. ``unreadable`` marks requests whose instant is given but
    can't be read.
    """

    def p(name: str) -> str:
        return f"{params}['{name}']"

    features = v.string_list(p("features"))
    parsed = f"transform({v.string_list(p('desired_work_roles'))}, role -> {v.parse_role_filter('role')})"
    ranges = f"CASE WHEN r.minimum IS NOT NULL THEN {v.experience_ranges('r.minimum')} END"
    roles = (
        f"transform(array_compact({parsed}), r -> named_struct('role', r.role, "
        f"'minimum', r.minimum, 'maximum', r.maximum, 'ranges', {ranges}))"
    )
    typed = {
        "index": p("index"),
        "as_of": v.instant(p("as_of")),
        "epoch": v.instant(p("epoch")),
        "unreadable": f"CASE WHEN {p('epoch')} IS NOT NULL THEN {v.instant(p('epoch'))} IS NULL"
        f" ELSE {p('as_of')} IS NOT NULL AND {v.instant(p('as_of'))} IS NULL END",
        "keywords": p("keywords"),
        "has_keywords": kw.has_keywords(p("keywords")),
        "mode": kw.keyword_mode(p("keywords"), v.feature(features, NO_FULLTEXT_SEARCH)),
        "whole_words": v.feature(features, NO_FULLTEXT_SEARCH),
        "keywords_should": v.feature(features, KEYWORDS_SHOULD),
        "roles": roles,
        **{name: v.string_list(p(name)) for name in STRING_LISTS},
        "maximum_salary": v.parse_u63(p("maximum_salary")),
        "company_id": f"get({v.int_scalar(p('company_id'))}, 0)",
        **{name: v.int_list(p(source)) for name, source in ID_LISTS.items()},
        "offset": v.page_offset(p("offset")),
        "per_page": v.page_size(p("per_page")),
        "debug": f"coalesce({p('debug_es_query')}, {p('debug')}, '') = 'true'",
    }
    keep = [c for c in raw.columns if c != params]
    decoded = _bound(raw, keep, typed, once)
    return _bound(decoded, ["*"], {"clauses": kw.keyword_clauses("keywords", "mode")}, once)


@dataclass(frozen=True)
class SearchRequest:
    """One search. Absent values restrict nothing; ``as_of`` defaults to the current time.

    An instant that is given but can't be read finds nothing.
    """

    index: str | None = None
    as_of: Any = None
    epoch: Any = None
    keywords: str | None = None
    whole_words: bool = False
    keywords_should: bool = False
    roles: tuple[tuple[str, int | None], ...] = ()
    professional_experience: tuple[str, ...] = ()
    work_authorization: tuple[str, ...] = ()
    work_locations: tuple[str, ...] = ()
    current_location: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    maximum_salary: int | None = None
    company_id: int | None = None
    presented: tuple[int, ...] = ()
    bookmarked: tuple[int, ...] = ()
    contacted: tuple[int, ...] = ()
    ignored: tuple[int, ...] = ()
    offset: int = v.DEFAULT_OFFSET
    per_page: int = v.DEFAULT_PER_PAGE
    debug: bool = False
    min_score: float | None = None
    fragments: int = FRAGMENTS

    @classmethod
    def from_params(cls, spark: SparkSession, params: Mapping[str, Any], **overrides: Any) -> SearchRequest:
        """Decode raw parameters through the same expressions that decode request tables."""
        encoded = json.dumps({k: _as_text(x) for k, x in params.items() if x is not None})
        one = spark.sql(
            "SELECT from_json(params, 'map<string,string>') AS params FROM VALUES (:params) AS r(params)",
            args={"params": encoded},
        )
        row = decode_requests(one, once=False).first()
        values = {
            name: tuple(row[name]) if isinstance(row[name], list) else row[name]
            for name in cls.__dataclass_fields__
            if name in row and name not in ("roles", "as_of", "epoch")
        }
        values["roles"] = tuple((r["role"], r["minimum"]) for r in row["roles"])
        for instant in ("as_of", "epoch"):
            values[instant] = params.get(instant)
        return cls(**{**values, **overrides})


def _as_text(value: Any) -> str:
    if isinstance(value, (list, tuple)):
        return json.dumps([str(x) for x in value])
    return str(value)
