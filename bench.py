"""Times the headline queries, each run once after a warm-up, at $BENCH_SF_DIR on local[$BENCH_CPUS]. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from querent.plans import registry
from querent.session import session

NAMES = [
    "cosine_topk",
    "cosine_topk_filtered",
    "faiss_flat_ip",
    "ivf_probe_topk",
    "recall_at_k",
    "bm25_index_terms",
    "bm25_topk",
    "hybrid_rrf",
    "two_stage",
    "ndcg_at_k",
    "chunk_naive",
    "chunk_tokens",
    "line_assembly",
    "md_table_facts_rows",
    "prompt_rag",
    "events_tumbling",
    "answer_pipeline",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    registry.QUERIES["cosine_topk"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in sys.argv[1:] or NAMES:
        began = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
