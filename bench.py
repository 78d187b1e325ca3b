"""Headline queries at one scale: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from rankjobs.queries import registry  # noqa: E402
from rankjobs.session import local_session  # noqa: E402

# name in the report -> registered query
HEADLINE = {
    "eval_hybrid_reranked": "eval_summary",
    "label_eval_dense": "label_eval",
    "recommend_hybrid": "recommend",
    "recommend_dense": "recommend_dense",
    "bm25_passages": "bm25_topk",
    "bm25_all_documents": "bm25_self",
    "dense_all_vectors": "dense_topk_excl",
    "master": "master",
    "validation_report": "validation_report",
    "enriched_text": "enriched_text",
    "tokens": "tokens",
    "clean_html": "clean_html",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cpus, checkpoint_dir=tempfile.mkdtemp(prefix="bench-checkpoints-"))
    spark.sparkContext.setLogLevel("ERROR")
    entries = registry()
    # start the JVM's and the Python workers' code paths outside the timings
    entries["tokens"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    entries["vector_artifact"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        entries[HEADLINE.get(name, name)][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
