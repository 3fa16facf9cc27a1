"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores. Every result is computed in full and
discarded, so nothing is collected. Rendering the sales data as filings is fixture work and timed apart ("prepared");
ingest (pages, tags, facts, passages) counts as a query, with its pages, passages and questions per second beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlake.plans.queries import CATALOGUE, _lake, prepare  # noqa: E402
from ledgerlake.session import local_session  # noqa: E402

# One per stage: facts, metrics, segments, markup and tags, passages, questions, retrieval, gate, usage.
HEADLINE = (
    "facts_consolidated metric_profit metric_averaged metric_direct facts_by_segment xbrl_facts facts_combined question_values "
    "document_passages html_text question_metric bm25_top10 rrf_top10 quote_on_page verify_answers "
    "reconstruct_pairs usage_daily"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    prepared: dict[str, float] = {}
    rates: dict[str, float] = {}
    if len(sys.argv) == 1:
        for step, build in prepare(spark, folder):
            start = time.time()
            build()
            (seconds if step == "ingest" else prepared)[step] = round(time.time() - start, 3)
        lake = _lake(spark, folder)
        rates = {f"{n}_per_s": round(getattr(lake, n).count() / seconds["ingest"], 1) for n in ("pages", "passages")}
    for name in names:
        start = time.time()
        CATALOGUE[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "prepared": prepared, "rates": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
