"""Time the ingest and the headline queries; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.
"""

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tools"))
from check_queries import session  # noqa: E402

from hitloom.operators import query  # noqa: E402
from hitloom.plans import catalog, presets, reports  # noqa: E402
from hitloom.plans.refresh import Warehouse  # noqa: E402
from hitloom.sources import derived, storage  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main():
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    root = tempfile.mkdtemp(prefix="hitloom-bench-")
    spark.sparkContext.setCheckpointDir(root)
    times = {}

    def timed(name, action):
        start = time.time()
        action()
        times[name] = round(time.time() - start, 3)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    raw = catalog.raw_folder(spark, SF)
    w = Warehouse(spark, f"{root}/warehouse", catalog.RULES)
    w.load_search(derived.search_perf(spark, SF))
    dates = w.changed_dates(raw)
    timed("ingest_parse", lambda: w.load_parsed(storage.read_raw(spark, raw)))
    timed("ingest_parse_again", lambda: w.load_parsed(storage.read_raw(spark, raw)))
    timed("refresh_aggregates", lambda: w.refresh(dates))
    parsed = w.parsed()
    for name in presets.PRESETS:
        timed(f"preset_{name}", lambda: noop(query.run(parsed, presets.preset(name))))
    for name in reports.INSIGHTS:
        timed(f"insight_{name}", lambda: noop(reports.insight(name, w.table)))
    for name in ("daily", "top_urls_daily", "bot_top_urls_daily", "ai_crawler_daily"):
        timed(f"direct_{name}", lambda: noop(catalog.aggregates.TABLES[name](parsed)))
    strategic = w.table("gsc_bot_daily")
    for f in (reports.strategic_kpis, reports.strategic_by_class, reports.strategic_by_segment):
        timed(f.__name__, lambda: noop(f(strategic)))
    timed("histogram_errors", lambda: noop(query.histogram(parsed, query.QuerySpec(), "errors")))
    timed("rows_page", lambda: noop(query.rows(parsed, query.QuerySpec(page=3))))
    print(json.dumps({"metric": "total seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF.rstrip("/")), "rows": parsed.count()}))
    spark.stop()
    shutil.rmtree(root, ignore_errors=True)


if __name__ == "__main__":
    main()
