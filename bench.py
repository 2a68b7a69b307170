"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textsieve.plans.catalog import all_queries  # noqa: E402
from textsieve.session import local_session  # noqa: E402

HEADLINE = [
    "clean_text",
    "first_fifty_words",
    "drop_duplicate_texts",
    "number_counts_of_documents",
    "number_auc_by_feature",
    "style_ratios",
    "word_ngrams",
    "char_ngrams",
    "top_vocabulary",
    "smoothed_idf",
    "unit_weights",
    "copies_of_reference",
    "prepared_corpus",
    "recency_split",
    "metrics_by_source",
    "lead_excerpt",
    "words_svm_balanced",
    "characters_svm",
    "drop_near_copies",
    "decontaminate",
    "mask_by_lexicon",
    "word_contributions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus, app="textsieve-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    catalog["word_count"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    base = os.path.basename(folder.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(base[2:]) if base.startswith("sf") else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
