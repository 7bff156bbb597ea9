"""Run registered queries against their SQL twins and print one line each.

    python tests/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from drayline import build_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(
        master=f"local[{os.environ.get("CPUS", "8")}]",
        extra={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if chosen and not any(c in name for c in chosen):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            found = differences(df, con, sql[name]) if name in sql else f"rows {df.count()} (no SQL)"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        good = found is None or name not in sql and found.startswith("rows")
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
