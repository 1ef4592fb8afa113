"""Headline timings: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicloom.session import local_session  # noqa: E402

HEADLINE = [
    "term_frequency", "build_vocab_sorted", "encode_docs", "topic_top_words", "segment_corpus", "gibbs_sweep_sync",
    "vocab_update_batch", "blend_batch", "decayed_backfill", "loglik_with_prior", "fit_distributed", "fit_online",
    "infer_batch", "stream_train",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    from topicloom.catalog import QUERIES

    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    QUERIES["term_frequency"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the session
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
