"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["t16_event_fields", "p3_deal", "p7_line_item", "f11_dry_run_summary", "a3_summary", "j10_required_parent",
            "m1_merge", "k4_writeback", "w1_batches"]


def main() -> None:
    from recordmill.session import local_session
    from verification import queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores=cores, shuffle_partitions=cores)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts, when code is compiled
            queries._RUNS.clear()  # no query reads what another one wrote
            start = time.time()
            queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
