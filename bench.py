"""Headline queries at one scale; prints one JSON line of seconds per query.

Every query runs once to warm the JVM and once for the clock. A run builds the
DataFrame, plans it and executes it in full into a sink that drops the rows. Text
searches count the building of the index they read; ``index_build`` and the
``lookup_`` entries tell the two apart. ``small`` holds the same queries over a
tenth of the rows, where that folder is beside the other, so that fixed cost and
growth can be told apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobtide.session import get_spark  # noqa: E402
from jobtide.workloads import QUERIES  # noqa: E402
from jobtide.workloads.q_text import LOOKUPS, build_store  # noqa: E402

HEADLINE = [
    "screen_three_valued", "facets_leave_one_out", "facets_finished", "facet_salary_ladder", "funnel", "rank_relevance_topk", "search_page",
    "sort_company", "collapse_duplicates", "unknown_shares", "title_gate_any", "text_any", "text_phrase", "text_all_prefix", "text_scan", "search_text",
    "token_index", "description_hits", "fold_text", "html_to_text", "text_signals", "years_claims", "seniority_from_title", "job_function",
    "annual_salary", "salary_ladder_offers", "location", "title_places", "metro_registry", "derive_all", "merge_snapshot", "merge_events",
    "snapshot_events", "new_since", "activity_pivot", "daily_report", "daily_totals", "corpus_sweep", "corpus_meta", "ashby_postings", "greenhouse_postings", "lever_postings",
    "workday_postings", "slug_normalise", "slug_store_merge", "source_quality", "upsert_saved", "hydrate_saved", "company_dossier", "sector_mix",
]


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timed_lookups(spark, sf_dir: str) -> dict[str, float]:
    """Building the token store, and searches of the built one."""
    start = time.perf_counter()
    store = build_store(spark, sf_dir)
    out = {"index_build": time.perf_counter() - start}
    for name in ("text_any", "text_phrase", "text_all_prefix"):
        for _ in range(2):
            start = time.perf_counter()
            LOOKUPS[name](store, spark, sf_dir).write.format("noop").mode("overwrite").save()
            out[f"lookup_{name}"] = time.perf_counter() - start
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_spark("jobtide-bench", cores=cores, shuffle_partitions=int(cores))
    small_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    seconds, small = {}, {}
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(timed(spark, sf_dir, name), 3)
        if os.path.basename(sf_dir.rstrip("/")) == "sf0.1" and os.path.isdir(small_dir):
            small[name] = round(timed(spark, small_dir, name), 3)
        print(name, seconds[name], small.get(name), file=sys.stderr, flush=True)
    apart = {k: round(v, 3) for k, v in timed_lookups(spark, sf_dir).items()} if "text_any" in names else {}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "index": apart, "small": small,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
