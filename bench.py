"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Answered from an index that is built once, as the reference answers them.
SEARCHES = ["term_bm25", "bool_must", "bool_should_dismax", "bool_must_not", "phrase_exact", "phrase_slop", "wildcard_prefix", "field_exists", "range_numeric", "facet_counts", "facet_filtered_search", "ranked_page", "highlight_snippets", "search_many"]
OTHERS = ["tokenize_regex", "tokenize_whitespace", "term_dictionary", "facet_top_n", "facet_orders", "range_lineitem"]


def main() -> None:
    from pyspark.sql import SparkSession

    from lantern.plans import catalogue

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lantern-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lantern-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def run(name: str, f) -> None:
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    catalogue.table(spark, SF_DIR, "region").count()  # the session starts outside the figures
    began = time.perf_counter()
    index = catalogue.documents_engine(spark, SF_DIR).index
    index.terms.count()
    took["index_build"] = round(time.perf_counter() - began, 3)
    documents = index.doc_count
    catalogue.parts_engine(spark, SF_DIR).index.terms.count()
    for name in SEARCHES:
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # one warm-up, as in the baseline
        run(name, lambda n=name: catalogue.QUERIES[n](spark, SF_DIR))
    for name in OTHERS:
        run(name, lambda n=name: catalogue.QUERIES[n](spark, SF_DIR))
    try:
        from lantern.llm import registry
    except ImportError:
        registry = None
    for name in registry.QUERIES if registry else ():
        run(name, lambda n=name: registry.QUERIES[n](spark, SF_DIR))
    print(json.dumps({
        "metric": "seconds of all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "index_docs_per_sec": round(documents / took["index_build"], 1), "documents": documents,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
