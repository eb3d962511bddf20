"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  The indexes
are built first and timed under their own names; retrieval then opens them.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankbench.plans.collections import collection
from rankbench.plans.queries import QUERIES
from rankbench.session import local_session

HEADLINE = [
    "index_postings",
    "retrieve_bm25",
    "retrieve_bm25_ng2",
    "retrieve_tfidf",
    "retrieve_dense",
    "retrieve_dense_text",
    "retrieve_pairscore_exhaustive",
    "rerank_bm25_dense",
    "rerank_bm25_pair",
    "rerank_dense_pair",
    "eval_run",
    "run_matrix",
    "dense_encode",
    "prep_pretokenize",
    "prep_triples",
    "diag_bad_triples",
    "diag_contradiction",
    "diag_length_stats",
    "diag_shift_vocab",
    "lm_pack_blocks",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "rankbench-bench")
    spark.sparkContext.setLogLevel("ERROR")
    timed(lambda: spark.range(1000).selectExpr("sum(id)").collect())  # start the executors

    seconds = {}
    for name in ("bench", "chat"):
        c = collection(spark, sf_dir, name)
        seconds[f"build_{name}_index"] = timed(lambda: c.index)
        seconds[f"build_{name}_bigram_index"] = timed(lambda: c.bigram_index)
        seconds[f"build_{name}_vectors"] = timed(lambda: c.vectors)
    for name in HEADLINE:
        seconds[name] = timed(
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        )
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
