"""Benchmark: consolidation (T1) and reports (T2-T4) on one input scale.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.

T1 builds the consolidated table from the derived base/charges tables and
writes it partitioned by billing month (K1) into the shared checkpoint
folder; the reports read that table back, as a production job would. Each
timed query runs to completion through the ``noop`` sink (no collect).
A first pass on the smallest fixture warms the JVM (JIT, code cache).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kwhrecon.plans import consolidate as T1  # noqa: E402
from kwhrecon.plans import report as RP  # noqa: E402
from kwhrecon.operators import reconcile as R  # noqa: E402
from kwhrecon.session import get_spark, scratch_path  # noqa: E402
from kwhrecon.sources import fixtures as X  # noqa: E402

AS_OF = "1996-06-01"


def run_all(spark, sf_dir: str) -> dict:
    times = {}
    out = scratch_path(spark, f"bench-{uuid.uuid4().hex}/consolidated")

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    base = X.base_table(spark, sf_dir)
    charges = X.charges_table(spark, sf_dir)
    meta = X.metadata_table(spark, sf_dir)
    groups, months = X.client_groups_table(spark, sf_dir), X.group_periods_table(spark, sf_dir)

    def t1():
        res = T1.consolidate(base, charges)
        T1.write_consolidated(res.consolidated, out)
        # the gap report reads the table just written (no recomputation)
        gaps = R.gap_rows(spark.read.parquet(out), res.unit_keys)
        T1.gap_report_items(gaps).write.format("noop").mode("overwrite").save()

    timed("t1_consolidate", t1)
    cons = spark.read.parquet(out)

    def report(**kw):
        opts = RP.ReportOptions(as_of=AS_OF, **kw)
        return RP.flat_report(RP.generate(cons, [], [], meta, opts))

    timed("t2_report_distributor",
          lambda: report(grouping_mode="distributor").write.format("noop").mode("overwrite").save())
    timed("t2_report_default", lambda: report().write.format("noop").mode("overwrite").save())
    timed("t3_report_by_group", lambda: RP.flat_report(RP.generate_many(
        cons, groups, months, meta, RP.ReportOptions(as_of=AS_OF))).write.format("noop").mode("overwrite").save())
    timed("t4_report_by_month", lambda: RP.flat_report(RP.generate_by_month(
        cons, [], [], None, RP.ReportOptions(as_of=AS_OF, grouping_mode="distributor")))
        .write.format("noop").mode("overwrite").save())
    return times


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8))
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        run_all(spark, warm)
    times = run_all(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
