"""JSON documents in, typed rows out.

Decoding accepts a batch whole or not at all: any missing or wrongly typed field fails the job, and Spark's
output commit then publishes nothing. Inspecting reads the same documents under the same rules, but tells the reason beside
each row instead (``_reason``, null for a good document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilescope.operators.scores import search_scores
from profilescope.operators.search import DEFAULT_TABLE, search_profiles
from profilescope.schema import PROFILE_SCHEMA, ROLE, SALARY, SCORE_SCHEMA, STRINGS, TableSpec

DEFAULTED = ("desired_work_roles", "desired_work_roles_experience", "desired_roles")
INSTANTS = ("batch_starts_at", "batch_ends_at", "added_to_batch_at")
OPTIONAL_SCORE_FIELDS = ("person_id", "company_id", "position_id")
UNSIGNED = 2**32 - 1


def _raw_type(field: T.StructField) -> T.DataType:
    """Salaries stay raw JSON text until their form is known; instants are text in the input."""
    if field.name == "salary_expectations":
        return STRINGS
    return T.StringType() if field.name in INSTANTS else field.dataType


RAW_PROFILE = T.StructType([T.StructField(f.name, _raw_type(f)) for f in PROFILE_SCHEMA.fields])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text rows, one JSON document or one JSON list of documents per row."""
    return split_lists(spark.read.text(path))


def split_lists(lines: DataFrame) -> DataFrame:
    """One row per document; a row that holds a list becomes several."""
    elements = F.when(
        F.col("value").rlike(r"\A\s*\["),
        F.transform(
            F.expr("variant_get(parse_json(value), '$', 'array<variant>')"), lambda d: F.to_json(d)
        ),
    ).otherwise(F.array("value"))
    return lines.where(F.trim("value") != "").select(F.explode(elements).alias("value"))


REASON = "_reason"


def split_files(files: DataFrame) -> DataFrame:
    """One row per document of whole files (``value``), with its ``place`` in the file; other columns stay.

    A file has a JSON document or list on each line, or, if its first line is none, is one as a whole. What is no JSON is a
    document that inspection rejects.
    """
    split = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    by_line = F.try_parse_json(F.get(split, F.lit(0))).isNotNull()
    lines = F.when(by_line | (F.size(split) == 0), split).otherwise(F.array("value"))
    elements = F.transform(
        lines,
        lambda line: F.coalesce(
            F.transform(F.try_variant_get(F.try_parse_json(line), "$", "array<variant>"), lambda d: F.to_json(d)), F.array(line)
        ),
    )
    others = [c for c in files.columns if c != "value"]
    return files.select(*others, F.posexplode(F.flatten(elements)).alias("place", "value"))


def _checked(value: Column, valid: Column, name: str) -> Column:
    """The value, or a failure of the job that names the field."""
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(F.raise_error(F.lit(_fault(name))).cast("void"))


def _fault(name: str) -> str:
    return f"bad or missing field: {name}"


def _rows(
    lines: DataFrame, column: str, raw: T.StructType, fields: list[T.StructField], decoded, strict: bool,
    derived: dict[str, Column] | None = None,
) -> DataFrame:
    """The typed fields that ``decoded`` gives as (value, valid), beside the other columns of the lines.

    Strictly, what is not valid fails the job; else it is null, and the first of them makes the row's reason.
    ``derived`` columns are computed once from the parsed ones, for values and checks that both read them.
    """
    others = [c for c in lines.columns if c != column]
    reader, mode = (F.parse_json, "FAILFAST") if strict else (F.try_parse_json, "PERMISSIVE")
    parsed = lines.select(*others, F.from_json(column, raw, {"mode": mode}).alias("_d"), reader(column).alias("_json"))
    parsed = parsed.withColumns(derived or {})
    if strict:
        typed = [_checked(*decoded(f), f.name).cast(f.dataType).alias(f.name) for f in fields]
        return parsed.select(*others, *typed)
    found = [(f, value, F.coalesce(valid, F.lit(False))) for f in fields for value, valid in [decoded(f)]]
    typed = [F.when(valid, value).cast(f.dataType).alias(f.name) for f, value, valid in found]
    object_ = F.schema_of_variant("_json").startswith("OBJECT")
    faults = [F.when(~valid, F.lit(_fault(f.name))) for f, _, valid in found]
    reason = F.coalesce(F.when(~F.coalesce(object_, F.lit(False)), F.lit("no JSON object")), *faults)
    return parsed.select(*others, *typed, reason.alias(REASON))


def _json_types(allowed: list[str], path: str) -> Column:
    """Whether the JSON value at ``path`` has one of the given types (text is not a number)."""
    return F.schema_of_variant(F.expr(f"variant_get(_json, '$.{path}', 'variant')")).isin(allowed)


def _type_check(field: T.StructField) -> Column | None:
    """Strict checks that a typed JSON read leaves open: it would turn numbers into text."""
    if field.dataType == T.StringType() or field.name in INSTANTS:
        return _json_types(["STRING"], field.name)
    if field.dataType == STRINGS:
        kinds = ["ARRAY<STRING>", "ARRAY<VOID>"]
        return _json_types(kinds, field.name) & ~F.exists(F.col(f"_d.{field.name}"), F.isnull)
    if isinstance(field.dataType, T.ArrayType) and field.dataType.elementType == T.LongType():
        return ~F.exists(F.col(f"_d.{field.name}"), lambda x: ~F.coalesce(x.between(0, UNSIGNED), F.lit(False)))
    return None


def _kind(value: Column, path: str) -> Column:
    """The JSON type at a path of a variant; what is absent is void."""
    return F.coalesce(F.schema_of_variant(F.variant_get(value, path, "variant")), F.lit("VOID"))


def decode_salary(value: Column) -> Column:
    """A parsed salary, an object or the list ``[minimum, currency, city]``; null where it is neither.

    The minimum is an integer from 0 to 2^63 - 1 or absent, currency and city are strings, and a list has three
    elements.
    """

    def read(value: Column, minimum: str, currency: str, city: str) -> Column:
        least = F.try_variant_get(value, minimum, "bigint")
        good = _kind(value, currency) == "STRING"
        good &= _kind(value, city) == "STRING"
        good &= (_kind(value, minimum) == "VOID") | ((_kind(value, minimum) == "BIGINT") & (least >= 0))
        found = F.struct(
            least.alias("minimum"),
            F.try_variant_get(value, currency, "string").alias("currency"),
            F.try_variant_get(value, city, "string").alias("city"),
        )
        return F.when(good, found)

    size = F.size(F.try_variant_get(value, "$", "array<variant>"))
    listed = F.when(size == 3, read(value, "$[0]", "$[1]", "$[2]"))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(
        read(value, "$.minimum", "$.currency", "$.city")
    )


def _salary_ok(s: Column) -> Column:
    return s.isNotNull()


def decode_profiles(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Profiles from one JSON document per row. Other columns (a change sequence) are kept."""

    def decoded(field: T.StructField) -> tuple[Column, Column]:
        raw = F.col(f"_d.{field.name}")
        if field.name in DEFAULTED:
            present = F.expr(f"variant_get(_json, '$.{field.name}', 'variant')").isNotNull()
            empty = F.array().cast(field.dataType)
            typed = _type_check(field)
            if field.name == "desired_roles":
                given = F.expr("variant_get(_json, '$.desired_roles', 'array<variant>')")
                typed = ~F.exists(given, lambda r: (_kind(r, "$.role") != "STRING") | (_kind(r, "$.experience") != "STRING"))
            return F.when(present, raw).otherwise(empty), ~present | (typed & raw.isNotNull())
        valid = raw.isNotNull()
        typed = _type_check(field)
        if typed is not None:
            valid = valid & typed
        value = raw
        if field.name == "id":
            valid = valid & raw.between(0, UNSIGNED)
        if field.name in INSTANTS:
            value = F.try_to_timestamp(raw)
            valid = valid & value.isNotNull()
        if field.name == "salary_expectations":
            value = F.col("_salaries")
            valid = valid & ~F.exists(value, lambda s: ~_salary_ok(s))
        return value, valid

    # Parsed first, so that each element's text is parsed once.
    salaries = F.transform(F.transform("_d.salary_expectations", lambda s: F.parse_json(s)), decode_salary)
    return _rows(lines, column, RAW_PROFILE, PROFILE_SCHEMA.fields, decoded, strict, {"_salaries": salaries})


def sync_roles(profiles: DataFrame) -> DataFrame:
    """Fill the role lists from ``desired_roles``, or that from the lists, cut to the shorter one."""
    roles, structured = F.col("desired_work_roles"), F.col("desired_roles")
    experiences = F.col("desired_work_roles_experience")
    given = F.size(structured) > 0
    zipped = F.transform(
        F.slice(roles, F.lit(1), F.least(F.size(roles), F.size(experiences))),
        lambda role, i: F.struct(role.alias("role"), F.get(experiences, i).alias("experience")),
    )
    return profiles.withColumns(
        {
            "desired_work_roles": F.when(given, structured["role"]).otherwise(roles),
            "desired_work_roles_experience": F.when(given, structured["experience"]).otherwise(experiences),
            "desired_roles": F.when(given, structured).otherwise(zipped.cast(T.ArrayType(ROLE))),
        }
    )


def ingest_profiles(lines: DataFrame) -> DataFrame:
    return sync_roles(decode_profiles(lines))


def inspect_profiles(lines: DataFrame) -> DataFrame:
    return sync_roles(decode_profiles(lines, strict=False))


def decode_scores(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """Scores from one JSON document per row; the three foreign ids may be absent."""

    def decoded(field: T.StructField) -> tuple[Column, Column]:
        raw = F.col(f"_d.{field.name}")
        if field.name in OPTIONAL_SCORE_FIELDS:
            valid = raw.isNull() | _json_types(["STRING"], field.name)
        elif field.name == "request_id":
            valid = raw.isNotNull() & _json_types(["STRING"], field.name)
        elif isinstance(field.dataType, T.LongType):
            valid = raw.between(0, UNSIGNED)
        else:
            valid = raw.isNotNull()
        return raw, valid

    return _rows(lines, column, SCORE_SCHEMA, SCORE_SCHEMA.fields, decoded, strict)


def inspect_scores(lines: DataFrame) -> DataFrame:
    return decode_scores(lines, strict=False)


PROFILES = TableSpec(DEFAULT_TABLE, PROFILE_SCHEMA, "id", ingest_profiles, find=search_profiles, inspect=inspect_profiles)
SCORES = TableSpec("scores", SCORE_SCHEMA, "request_id", decode_scores, find=search_scores, inspect=inspect_scores)
