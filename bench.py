"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the number of local cores.  BENCH_QUERIES can name a subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlens.catalog import load_catalog  # noqa: E402
from reviewlens.scale import build_session  # noqa: E402

HEADLINE = (
    "dataset_stats", "count_back_on_row", "numeric_profile", "sample_exact_n", "markup_clean", "markup_usage",
    "sentences", "study_sentences", "top_words_per_source", "study_vocabulary", "bag_of_known_words",
    "tfidf_smooth", "tfidf_log2", "topic_ngram_counts", "topic_similarity", "coherence_cosine", "coherence_cv",
    "topic_sentiment", "feed_reviews", "document_topics", "lsa_topics", "nmf_topics", "lda_topics",
    "topic_count_study", "density_clusters", "review_analysis_sentiment",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "reviewlens-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_catalog()
    spark.read.parquet(f"{folder}/documents.parquet").count()  # session warm-up
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
