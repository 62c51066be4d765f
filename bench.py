"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS: input and threads. BENCH_REPEATS: the best of so many
runs counts (default 2; the first also compiles). BENCH_SWEEP=1,2,4: a support
pass by numbers of threads as well, each in a session of its own. A query that
fails is reported as FAIL and the others still run.
"""

from __future__ import annotations

import json
import os
import sys
import time
import traceback

from pyspark.sql import SparkSession

from edgeloom.operators import model, triangles, truss
from edgeloom.plans import summary
from edgeloom.sources.derived import graph

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
SWEEP = [n for n in os.environ.get("BENCH_SWEEP", "").split(",") if n]

QUERIES = {
    "edges": lambda e: e,
    "degrees": model.degrees,
    "triangles": triangles.triangles,
    "support": triangles.support,
    "trussness_hindex": lambda e: truss.truss(e, "hindex"),
    "trussness_peel": lambda e: truss.truss(e, "peel"),
    "summary": summary.summary,
}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    graph(spark, SF_DIR).count()  # starts the JVM's threads and the table's footers
    return spark


def best(spark: SparkSession, query, repeats: int) -> float | str:
    """Seconds of the fastest run."""
    took = []
    for _ in range(repeats):
        began = time.time()
        try:
            query(graph(spark, SF_DIR)).write.format("noop").mode("overwrite").save()
        except Exception:
            traceback.print_exc(file=sys.stderr)
            return "FAIL"
        took.append(time.time() - began)
    return round(min(took), 3)


def main() -> None:
    spark = session(CPUS)
    took = {name: best(spark, query, REPEATS) for name, query in QUERIES.items()}
    out = {"metric": "total time of graph queries on g_part_r", "value": round(sum(t for t in took.values() if t != "FAIL"), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}
    if SWEEP:
        out["support_by_threads"] = {}
        for cpus in SWEEP:
            spark.stop()
            spark = session(cpus)
            out["support_by_threads"][cpus] = best(spark, triangles.support, REPEATS)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
