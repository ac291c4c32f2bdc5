"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (optional, comma
separated, or ``all``) the queries. Each query is planned and run into the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from conformance.inputs import stored_index
from conformance.suite import CASES
from facetlake.session import local_session

HEADLINE = (
    "tokenize", "strip_markup", "postings", "term_positions", "corpus_stats", "search_page",
    "term", "all_of", "grouping", "none_of", "phrase", "phrase_slop", "bm25f_score", "page",
    "facet_counts_all", "facet_counts_multi", "facet_counts_search", "facet_tree",
    "limit_with_leeway", "collection_ancestors", "facet_collection", "related_forward",
    "related_reverse", "related_limit", "resolve_id", "children_by_parent", "dirty_documents",
    "upsert_documents", "url_inventory", "build_documents", "citation_tags",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(CASES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE

    spark = local_session("bench", cores)
    spark.read.parquet(f"{folder}/region.parquet").count()
    start = time.perf_counter()
    stored_index(spark, folder)
    timings = {"index_build": round(time.perf_counter() - start, 3)}
    for name in names:
        start = time.perf_counter()
        CASES[name].query(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
