"""python -m gripeline: builds a graph from Tables A and B, or from planted demo data, and renders the report.

    python -m gripeline --tagged A.parquet --dimensions B.parquet --graph DIR --report DIR
    python -m gripeline --tagged A.parquet --demo 10000 --graph DIR       dimensions are planted, on a sample
    python -m gripeline --tagged A.parquet --dimensions B.parquet --graph DIR --batch 3 --batch-size 50000
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .plans import build, graph, report
from .sources import files, planted, taxonomy, threads
from .streaming import incremental


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="gripeline", description=__doc__.splitlines()[0])
    p.add_argument("--tagged", required=True, help="Table A, Parquet")
    p.add_argument("--dimensions", help="Table B, Parquet; planted where it is missing")
    p.add_argument("--graph", required=True, help="folder of the graph's versions")
    p.add_argument("--report", help="folder for the report")
    p.add_argument("--run-id", default="run")
    p.add_argument("--demo", type=int, metavar="N", help="build from a sample of N conversations")
    p.add_argument("--batch", type=int, metavar="N", help="build from the N-th slice only, unless the graph has it")
    p.add_argument("--batch-size", type=int, default=50_000)
    p.add_argument("--taxonomy", help="taxonomy pack, JSON")
    x = p.parse_args(argv)
    spark = SparkSession.builder.appName("gripeline").getOrCreate()
    a = files.read_parquet(spark, x.tagged)
    if x.demo:
        a = threads.exact_sample(a, x.demo)
    b = files.read_parquet(spark, x.dimensions) if x.dimensions else planted.plant(a)
    pack = taxonomy.Pack.from_dict(files.read_taxonomy(x.taxonomy)) if x.taxonomy else taxonomy.own_pack()
    store, stamp = graph.Store(spark, x.graph), datetime.now(UTC).isoformat(timespec="seconds")
    if x.batch:
        done = incremental.run_slice(a, b, store, x.batch, stamp, x.batch_size, pack)
    else:
        done = build.run(a, b, store, x.run_id, stamp, pack)
    summary = done.summary | ({"report": report.render(store.read(), done.summary["run_id"], x.report)} if x.report else {})
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
