"""Times the headline queries; prints one line of JSON.

Every query is evaluated in full into the `noop` sink. The reported time of a
query is the faster of two runs; `first` holds the first runs, which include
code generation.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from parcelio.plans import catalog
from parcelio.session import build_session

HEADLINE = (
    "provision_all",
    "debt_projection",
    "contract_lifecycle",
    "account_balance_extract",
    "balance_table",
    "latest_state_balance",
    "monthly_series",
    "feature_buckets",
    "rare_category",
    "bootstrap_sample",
    "train_test_split",
    "roc_curve",
    "ks_two_sample",
    "confusion_matrix",
    "score_contracts",
    "keyword_search",
    "keyword_digest",
    "page_fields",
    "programme_digest",
    "choropleth_join",
    "polygon_vertices",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "parcelio-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="parcelio-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    times, first = {}, {}
    for name in names:
        query = catalog.QUERIES[name]
        first[name] = run(query, spark, sf_dir)
        times[name] = min(first[name], run(query, spark, sf_dir))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of the faster of two runs of each headline query",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "first": {k: round(v, 3) for k, v in first.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
