"""Benchmark of the headline queries.

Runs each query over the driver tables at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``: one warm-up, then the
median of ``$BENCH_RUNS`` timed runs. Every run executes the whole plan into
Spark's ``noop`` sink (nothing is collected to the driver). Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["activity_count_7", "activity_profile", "co_holders_all", "v_accounts_by_manager", "branch_payroll",
            "post", "running_balance", "post_transfers", "accept_holders", "post_stream"]


def main() -> None:
    from ledgerlake.session import build_local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")),
                                app="ledgerlake-bench")
    from ledgerlake.plans.catalog import QUERIES

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        fn = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            df = fn(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            el = time.perf_counter() - t0
            if i > 0:
                samples.append(el)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = fn(spark, sf_dir).count()
        print(f"{name}: {times[name]}s rows={rows[name]}", file=sys.stderr, flush=True)
    extra = {}
    if "post_transfers" in names:
        # Rounds of the transfer fixpoint (one more, untimed run).
        from ledgerlake.operators.transfers import run_transfers
        from ledgerlake.plans.catalog import _singles
        from ledgerlake.sources.fixture import Fixture

        fx = Fixture(spark, sf_dir)
        b = fx.bank()
        _, rounds = run_transfers(b, _singles(b), fx.view("transfer_req"))
        extra["post_transfers_rounds"] = rounds
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
