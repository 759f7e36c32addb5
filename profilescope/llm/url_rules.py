"""Operator 2: URL filtering by host-and-path rules and by association rules mined from labels.

A listed rule such as ``example.net/en/`` fits its host, all subdomains and paths that start with its path; the
longest fitting rule decides. For other URLs Spark's FP-growth mines combinations of URL tokens that
mostly belong to pages labelled bad. Rules below the least support or confidence are dropped. Tokens that occur in the
same labelled pages are one item, for any of which a rule asks; no token of a page is left out. A rule
matches a URL that has all its items: rules are indexed by item, equal token sets are looked up once, and a rule whose
every item was found has matched.

Everything is DataFrame and SQL expressions and Spark ML. Mined rules and listed rules are tables; Spark broadcasts them
where their size allows it and splits hot tokens and hosts of a shuffle join otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilescope.llm.common import written_once

#: The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 20, 0.6
_BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end with A-Z
    lower-cased, and from there up to ``?``, ``#`` or the end. Without ``://``, or of a null, both are empty."""
    host = F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), F.lit(""))
    return urls.withColumns({"host": F.translate(host, _UPPER, _LOWER), "path": path})


def listed_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, listed) for each distinct host and path that a rule of (rule, verdict) fits.

    The longest rule wins; of rules of one length the smallest string, of a rule listed twice ``block``.
    """
    parsed = rules.select(
        "rule",
        "verdict",
        F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("_host"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("_path"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))")
    places = urls.select("host", "path").distinct().where("host <> ''").withColumn("_labels", labels)
    fits = places.select("host", "path", F.explode(suffixes).alias("_host")).join(parsed, "_host")
    order = F.struct((-F.length("rule")).alias("length"), "rule", (F.col("verdict") != "block").alias("other"), "verdict")
    best = fits.where(F.col("path").startswith(F.col("_path"))).groupBy("host", "path").agg(F.min(order).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("listed"))


def tokens() -> str:
    """SQL for the distinct tokens of a URL with host and path: scheme, host labels and suffixes, path words,
    query keys. Digits count as one kind of character, so that numbers of one length are one token."""
    return r"""array_sort(array_distinct(filter(concat(
        array(concat('scheme:', lower(substring_index(url, '://', 1)))),
        transform(split(host, '\\.'), x -> concat('label:', x)),
        transform(sequence(1, size(split(host, '\\.'))),
                  i -> concat('host:', array_join(slice(split(host, '\\.'), i, 200), '.'))),
        transform(split(path, '/'), x -> concat('path:', regexp_replace(lower(x), '[0-9]', '0'))),
        transform(split(regexp_extract(url, '\\?([^#]*)', 1), '&'), x -> concat('query:', substring_index(x, '=', 1))),
        array(if(contains(url, '#'), 'fragment:yes', 'fragment:'))
    ), x -> NOT endswith(x, ':'))))"""


def tokenized(urls: DataFrame) -> DataFrame:
    """Adds ``tokens`` and ``token_set``, a digest of them; null URLs have none."""
    found = F.coalesce(F.expr(f"CASE WHEN host <> '' THEN {tokens()} END"), F.expr("cast(array() AS array<string>)"))
    return urls.withColumn("tokens", found).withColumn("token_set", F.md5(F.array_join("tokens", " ")))


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(antecedent, confidence, support) of the token combinations that stand for bad pages.

    ``labelled`` has ``tokens`` and ``bad``. A combination needs ``min_support`` of the labelled pages and at
    least ``min_count`` of them. Pages without a label or without tokens don't count; without labelled pages there are no rules.
    An antecedent is an array of items, and an item an array of tokens that occur in the same labelled pages: a URL has
    the item if it has any of them. Left out are rules that a part of their antecedent makes superfluous, being
    at least as confident: items that are bad without exception, or are in all pages, therefore stand alone.
    """
    rows = written_once(labelled.where("bad IS NOT NULL AND size(tokens) > 0").select("tokens", "bad"), "labelled-urls")
    total = rows.count()
    schema = "antecedent array<array<string>>, confidence double, support double"
    if not total:
        return rows.sparkSession.createDataFrame([], schema)
    least = max(min_support, min(1.0, min_count / total))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    numbered = written_once(numbered, "numbered-urls")
    exploded = numbered.select("_row", "bad", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64("_row", F.lit(i))).alias(f"_rows{i}") for i in range(2)]
    counts = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *same)
    frequent = counts.where(F.col("n_bad") >= least * total)
    items = frequent.groupBy("n", "n_bad", "_rows0", "_rows1").agg(F.array_sort(F.collect_list("token")).alias("members"))
    items = written_once(items.select("n", "n_bad", F.array_min("members").alias("token"), "members"), "url-items")
    alone = (F.col("n_bad") == F.col("n")) | (F.col("n") == total)
    kept = exploded.join(items.where(~alone).select("token"), "token").groupBy("_row").agg(F.collect_list("token").alias("kept"))
    rest = numbered.select("_row", "bad").join(kept, "_row", "left")
    basket = F.concat(F.coalesce("kept", F.array().cast("array<string>")), F.expr(f"if(bad, array('{_BAD}'), array())"))
    model = FPGrowth(minSupport=least, minConfidence=min_confidence).fit(rest.select(basket.alias("items")))
    mined = model.associationRules.where(F.array_contains("consequent", _BAD) & (F.size("antecedent") > 0))
    confidence, support = F.col("n_bad") / F.col("n"), F.col("n_bad") / F.lit(total)
    single = items.where(alone).select(F.array("token").alias("antecedent"), confidence.alias("confidence"), support.alias("support"))
    rules = mined.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = written_once(rules.unionAll(single.where(F.col("confidence") >= min_confidence)), "mined-rules")
    parts = rules.select("antecedent", "confidence", F.explode("antecedent").alias("_without"))
    parts = parts.withColumn("_part", F.array_remove("antecedent", F.col("_without")))
    part = rules.select(F.col("antecedent").alias("_part"), F.col("confidence").alias("_confidence"))
    dominated = parts.join(part, "_part").where("_confidence >= confidence").select("antecedent")
    best = rules.join(dominated, "antecedent", "left_anti")
    named = best.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token"))
    named = named.join(items.select("token", "members"), "token").groupBy("antecedent", "confidence", "support")
    named = named.agg(F.array_sort(F.collect_list("members")).alias("members"))
    return written_once(named.select(F.col("members").alias("antecedent"), "confidence", "support"), "named-rules")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(token_set, confidence) of every token set that a mined rule matches, with the best rule's confidence."""
    indexed = rules.select(
        F.col("antecedent").alias("_rule"),
        "confidence",
        F.size("antecedent").alias("_needed"),
        F.explode("antecedent").alias("_item"),
    )
    items = indexed.select("_item").distinct().select("_item", F.explode("_item").alias("token"))
    sets = urls.select("token_set", "tokens").distinct().select("token_set", F.explode("tokens").alias("token"))
    held = sets.join(items, "token").select("token_set", "_item").distinct()
    hits = held.join(indexed, "_item").groupBy("token_set", "_rule", "_needed").agg(
        F.count(F.lit(1)).alias("_found"), F.max("confidence").alias("confidence")
    )
    return hits.where("_found = _needed").groupBy("token_set").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame | None, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """All pages with host, path, rule, verdict and the best mined rule's confidence.

    ``pages`` has page_id and url; ``labels`` has url and bad (null: unknown). A listed rule decides; else a matching mined
    rule blocks; else the page is allowed. Nulls: a null url has an empty host and path, no rule and is
    allowed; a null page_id is kept. Repeated rows are judged each. Without pages there are no rows, and without labels
    no mined rules. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = tokenized(host_and_path(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))))
    table = spark.createDataFrame(list(rules), "rule string, verdict string")
    judged = rows.join(listed_rules(rows, table), ["host", "path"], "left")
    if labels is not None:
        known = tokenized(host_and_path(labels.select(F.col("url").cast("string").alias("url"), "bad")))
        judged = judged.join(mined_verdicts(rows, mine(known)), "token_set", "left")
    else:
        judged = judged.withColumn("confidence", F.lit(None).cast("double"))
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), F.col("confidence").alias("bad_confidence")
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document, the number after the language in the path, is labelled.

    Bad is toxic or poor; an id labelled several times is bad if it ever was.
    """
    bad = F.coalesce(F.col("toxic") >= 1, F.lit(False)) | F.coalesce(F.col("quality") < 1, F.lit(False))
    rated = labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)")
    rated = rated.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(bad).alias("bad"))
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS bigint)")
    return pages.select(F.col("url").cast("string").alias("url"), number.alias("_doc")).join(rated, "_doc").select("url", "bad")


def op2(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(pages, page_labels(pages, labels))


