"""Time the headline queries: BENCH_SF_DIR (default sf0.1), local[BENCH_CPUS]; prints one JSON line.

Every run of a query starts from the given tables.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from seqprep.plans import all_queries
from seqprep.session import local_session

HEADLINE = [
    "corpus_encode_english", "text_english_cleaners", "text_normalize_prices", "mix_blended", "mix_blended_pref", "agg_masked_mean_std",
    "blocks_position", "window_frame", "signal_spectrum", "signal_log_mel", "window_voice_activity", "vector_nearest_codeword",
    "sample_similar_length_order", "sample_shuffle_split", "batch_char_lanes", "batch_chunk_overlap1", "score_check_species2", "score_align_voices",
    "score_quantized_corpus", "stroke_separate", "phones_rule_g2p", "phones_hyphenate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    queries = all_queries()[0]
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    # start the JVM's compilers and one Python worker per core once
    queries["agg_line_count"](spark, folder).write.format("noop").mode("overwrite").save()
    spark.range(0, 1000, 1, int(cpus) if cpus.isdigit() else 8).mapInPandas(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
