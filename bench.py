"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated names or ``all``).
Every query is executed in full (all rows, all columns, no collect); small queries are repeated and the median is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from plantlens.plans import load_all
from plantlens.session import local_session

HEADLINE = (
    "tokens_b5 page_text_b17 project_spec_b9 split_recursive_c1 split_windows_c2 link_catalog_d1 hour_bins_d9 previous_question_d10 "
    "corpus_stats_e1 day_status_e2 alarm_groups_e4 machine_trend_e5 readiness_e13 bm25_topk_i1 vector_topk_i2 hybrid_i5 "
    "tfidf_words_i14 expand_pages_i10 nearby_figures_i11 highlight_i13 kg_edges_j1b related_edges_j2b neighbours_j4 ppr_topk_j10 "
    "steps_l1 xref_l9 trace_up_l10 sync_plan_k1 revisions_k3 cms_report_m2 delivery_risk_m7 forecast_weighted_m6 "
    "completed_turns_f10 last_slots_f11 pagination_g4 episodes_s1 hourly_stream_s6b citation_audit_n6 verify_quotes_n2"
).split()


def run_once(spark, entry, sf_dir) -> float:
    start = time.perf_counter()
    entry.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry = load_all()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(registry) if wanted == "all" else (wanted.split(",") if wanted else list(HEADLINE))
    spark = local_session(cpus, "plantlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run_once(spark, registry["tokens_b5"], sf_dir)  # warm up the session and the Python workers
    times: dict[str, float] = {}
    for name in names:
        runs = [run_once(spark, registry[name], sf_dir)]
        while len(runs) < 3 and sum(runs) < 2 and wanted != "all":
            runs.append(run_once(spark, registry[name], sf_dir))
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
