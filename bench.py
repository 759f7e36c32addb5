"""Headline queries on stored tables: prints one JSON line.

The profile snapshot (with its folded text forms) and the decoded requests are written first, as a
service would hold them; their build time is reported apart. Each query runs once to warm up, then up to
``BENCH_RUNS`` times (once, if that takes long); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from profilescope.functions.text import with_text_indexes
from profilescope.operators import batch, changelog
from profilescope.operators.postings import match_keywords
from profilescope.operators.search import search_profiles, total_hits
from profilescope.plans import binding
from profilescope.plans.requests import SearchRequest, decode_requests
from profilescope.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ENOUGH_SECONDS = 20.0


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": str(CPUS * 2),
            "spark.driver.memory": "16g",
            # Text work after a small shuffle is heavy for its bytes: keep all cores busy.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    home = tempfile.mkdtemp(prefix="profilescope-bench-")
    started = time.perf_counter()
    people = with_text_indexes(binding.profiles(spark, FOLDER).repartition(CPUS * 2, "id"))
    people.write.parquet(f"{home}/profiles")
    decode_requests(binding.raw_requests(spark, FOLDER)).write.parquet(f"{home}/requests")
    build = time.perf_counter() - started
    profiles, requests = spark.read.parquet(f"{home}/profiles"), spark.read.parquet(f"{home}/requests")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))

    def asked(**more) -> SearchRequest:
        return SearchRequest.from_params(spark, {"as_of": binding.AS_OF, **more})

    facets = {"work_locations": ["NATION_2", "NATION_4"], "languages": ["en"], "desired_work_roles": ["PROMO:5"]}
    pages = {
        "search_first_page": lambda: search_profiles(profiles, asked()),
        "search_facets": lambda: search_profiles(profiles, asked(**facets)),
        "search_total": lambda: total_hits(profiles, asked(**facets)),
        "search_keywords_substring": lambda: search_profiles(profiles, asked(keywords="ention ngbol")),
        "search_keywords_whole_word": lambda: search_profiles(
            profiles, asked(keywords="widget AND thnt NOT machinery", features=["no_fulltext_search"])
        ),
        "saved_searches_by_facets": lambda: batch.match_facets(requests, profiles),
        "saved_searches_by_keywords": lambda: match_keywords(requests, profiles),
        "saved_searches": lambda: batch.match_saved_searches(requests, profiles),
        "saved_search_pages_by_facets": lambda: batch.pages(
            batch.match_facets(requests, profiles).selectExpr("*", "cast(NULL AS double) AS score"), requests
        ),
        "change_log_snapshot": lambda: changelog.latest(
            binding.score_changes(binding.table(spark, FOLDER, "events")), "request_id"
        ),
    }
    seconds = {}
    for name, frame in pages.items():
        times = []
        while len(times) <= RUNS and (len(times) < 2 or sum(times) < ENOUGH_SECONDS):
            started = time.perf_counter()
            frame().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "profile search and matching, warm median",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "build_seconds": round(build, 3),
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
