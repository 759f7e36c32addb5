"""Facet predicates of one request as Columns.

Scalar facets become ``IN`` lists that reach the Parquet scan; array and nested facets run inside the
scan stage. An empty list means no predicate. A predicate over a null field may be null, which a filter
takes for false; predicates that are negated here are made false first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilescope.functions.values import EXPERIENCE_LADDER


def _never_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def all_of(conditions: Sequence[Column | None]) -> Column:
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present) if present else F.lit(True)


def any_of(conditions: Sequence[Column | None]) -> Column:
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, present) if present else F.lit(True)


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scalar_in(column: str, values: Sequence) -> Column | None:
    return F.col(column).isin(list(values)) if values else None


def array_any(column: str, values: Sequence) -> Column | None:
    return F.arrays_overlap(F.col(column), _literals(values)) if values else None


def array_all(column: str, values: Sequence) -> Column | None:
    if not values:
        return None
    return F.size(F.array_except(_literals(values), F.col(column))) == 0


def not_in(column: str, values: Sequence) -> Column | None:
    return ~_never_null(F.col(column).isin(list(values))) if values else None


def array_lacks(column: str, value) -> Column | None:
    if value is None:
        return None
    return ~_never_null(F.array_contains(F.col(column), F.lit(value).cast("bigint")))


def instant_literal(value, like: str) -> Column:
    """A point in time, typed as the (zoned or unzoned) column it is compared with; null for text that is none."""
    if value is None:
        return F.current_timestamp().cast(like)
    return (F.try_to_timestamp(F.lit(value)) if isinstance(value, str) else F.lit(value)).cast(like)


def visible_at(as_of: Column) -> Column:
    return F.col("accepted") & (F.col("batch_starts_at") <= as_of) & (F.col("batch_ends_at") >= as_of)


def in_batch(starts_at: Column) -> Column:
    return F.col("accepted") & (F.col("batch_starts_at") == starts_at)


def salary_within(maximum: int | None, cities: Sequence[str] = ()) -> Column | None:
    """Some salary expectation is at most ``maximum``; with cities, one of those cities' own."""
    if maximum is None:
        return None
    wanted = list(cities)

    def fits(salary: Column) -> Column:
        low_enough = salary["minimum"] <= F.lit(maximum).cast("bigint")
        return low_enough & salary["city"].isin(wanted) if wanted else low_enough

    return F.exists("salary_expectations", fits)


def ranges_from(minimum: int) -> list[str]:
    rung = 0 if minimum < 2 else (min(minimum, 9) + 1) // 2
    return EXPERIENCE_LADDER[rung:]


def role_matches(roles: Sequence[tuple[str, int | None]]) -> Column | None:
    """Any wanted role; those with a minimum need that experience in the same element."""
    plain = [role for role, minimum in roles if minimum is None]
    experienced = [(role, minimum) for role, minimum in roles if minimum is not None]
    tests = [array_any("desired_work_roles", plain)]
    if experienced:
        tests.append(
            F.exists(
                "desired_roles",
                lambda r: any_of(
                    [
                        (r["role"] == F.lit(role)) & r["experience"].isin(ranges_from(minimum))
                        for role, minimum in experienced
                    ]
                ),
            )
        )
    return any_of(tests) if roles else None
