"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Index build and searches run against a persisted index of all documents; the others are registered queries over the tables.
Every query runs once to warm up (code generation, file listing); then searches run `REPEATS` times and the median counts, table
queries once. The build counts once, cold.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

REPEATS = 3
SEARCHES = {
    "search_term": "tion",
    "search_phrase": '"of the"',
    "search_boolean": "tion AND queque",
    "search_prefix": "than*",
    "search_nested": '("of the" OR queq*) AND NOT tion AND type:DOC',
    "search_metadata": "ext:md AND size:1KB..64KB",
}
TABLE_QUERIES = ("term_bm25", "bool_nested", "dictionary", "incremental_diff")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    from inkwell import queries
    from inkwell.operators.index import Index
    from inkwell.session import session, ship
    from inkwell.sources.tables import read_documents

    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    out: dict[str, float] = {}
    at = tempfile.mkdtemp(prefix="inkwell-bench-")
    try:
        index = Index.open(spark, at)
        docs = read_documents(spark, sf)
        n, size = docs.selectExpr("count(*)", "sum(size_bytes)").first()
        start = time.perf_counter()
        index.update_from(docs)
        out["index_build"] = time.perf_counter() - start
        for name, q in SEARCHES.items():
            out[name] = timed(lambda q=q: index.search(q, 10).hits.collect())
        for name in TABLE_QUERIES:
            out[name] = timed(lambda name=name: queries.queries()[name](spark, sf).write.format("noop").mode("overwrite").save(), 1)
    finally:
        shutil.rmtree(at, ignore_errors=True)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in out.items()}, "sf": sf, "documents": n, "index_docs_per_s": round(n / out["index_build"]), "index_mb_per_s": round(size / 1e6 / out["index_build"], 1)}))
    spark.stop()


def timed(run, repeats: int = REPEATS) -> float:
    run()
    took = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return statistics.median(took)


if __name__ == "__main__":
    main()
