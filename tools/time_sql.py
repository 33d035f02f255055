"""Seconds that DuckDB takes for the SQL of named queries, on the same tables and machine as ``bench.py``.

    python tools/time_sql.py [data folder] [threads]
"""

import json
import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
from check_queries import database  # noqa: E402

from hitloom.operators.aggregates import TABLES  # noqa: E402
from hitloom.plans import expected, presets, reports  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con, sql = database(folder), expected.oracle_sql()
    con.execute(f"SET threads = {int(sys.argv[2]) if len(sys.argv) > 2 else 8}")
    names = [*TABLES, *[f"preset_{n.replace('-', '_')}" for n in presets.PRESETS], *[f"insight_{n.replace('-', '_')}" for n in reports.INSIGHTS],
             "strategic_kpis", "strategic_by_class", "strategic_by_segment", "q_histogram60_errors", "rows_page"]
    times = {}
    for name in names:
        start = time.time()
        con.execute(sql[name]).fetchall()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}))


if __name__ == "__main__":
    main()
