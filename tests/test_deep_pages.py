"""Pages far down equal those of a whole sort, and no task sorts what comes before them."""

import random
import re

import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from profilescope.operators import deep_pages, search
from profilescope.operators.deep_pages import Key, key_page
from profilescope.operators.search import all_hits, search_profiles
from profilescope.plans.requests import SearchRequest

KEYS = [Key("a", descending=True), Key("b"), Key("t", descending=True), Key("id")]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    hot = [(rng.choice([None, 1.5, 2.5]) if i % 3 else 7.0, rng.choice([None, "x", "y"]), i) for i in range(3000)]
    frame = spark.createDataFrame(hot, "a double, b string, id long").repartition(5)
    return frame.withColumn("t", F.when(F.col("id") % 7 > 0, F.timestamp_micros(F.col("id") % 13 * 1_000_001))).cache()


@pytest.mark.parametrize("shallow,sample,ranges", [(50, 200, 8), (300, 64, 64), (10, 3000, 2), (100_000, 10, 4)])
def test_pages_equal_a_whole_sort(rows, monkeypatch, shallow, sample, ranges):
    for name, value in (("SHALLOW", shallow), ("SAMPLE", sample), ("RANGES", ranges)):
        monkeypatch.setattr(deep_pages, name, value)
    whole = [r["id"] for r in rows.orderBy(*(k.column() for k in KEYS)).collect()]
    for offset, size in ((0, 5), (45, 10), (1000, 7), (2990, 30), (5000, 10), (1200, 900), (0, 3000)):
        assert [r["id"] for r in key_page(rows, KEYS, offset, size).collect()] == whole[offset : offset + size]
    assert key_page(rows.limit(0), KEYS, 500, 5).collect() == []


def test_the_last_sort_is_short(rows, monkeypatch):
    for name, value in (("SHALLOW", 100), ("SAMPLE", 500), ("RANGES", 16)):
        monkeypatch.setattr(deep_pages, name, value)
    page = key_page(rows, KEYS, 2500, 10)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 1
    limits = [int(x) for line in plan.splitlines() for x in re.findall(r"Offset (\d+)", line)]
    assert limits and max(limits) <= 100


@pytest.mark.parametrize("keywords", [None, "maps perl lua+"])
def test_searches_page_deep(spark, profiles, monkeypatch, keywords):
    monkeypatch.setattr(search, "SHALLOW", 1)
    monkeypatch.setattr(deep_pages, "SHALLOW", 1)
    request = SearchRequest(as_of=AS_OF, keywords=keywords, keywords_should=True, offset=1, per_page=2)
    whole = [r["id"] for r in all_hits(profiles, request).collect()]
    page = search_profiles(profiles, request)
    assert [r["id"] for r in page.collect()] == whole[1:3] and page.columns == all_hits(profiles, request).columns


def test_the_input_is_read_three_times(spark, monkeypatch):
    for name, value in (("SHALLOW", 10), ("SAMPLE", 100), ("RANGES", 4)):
        monkeypatch.setattr(deep_pages, name, value)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    numbers = spark.range(0, 4000, 1, 2).selectExpr("id * 7919 % 4000 AS a", "id").mapInArrow(count, "a long, id long")
    page = key_page(numbers, [Key("a", descending=True), Key("id")], 3000, 5)
    assert [r["a"] for r in page.collect()] == [999, 998, 997, 996, 995]
    assert read.value <= 3 * 4000
