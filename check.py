"""Developer loop: ``python check.py [sf] [name ...]`` compares queries with their SQL and times both."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))

import compare as cmp  # noqa: E402

from textsieve.plans import catalog  # noqa: E402
from textsieve.session import local_session  # noqa: E402


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = cmp.duck(folder), 0
    for name, item in catalog.all_queries().items():
        if wanted and not any(name.startswith(w) or w in item.covers.split() for w in wanted):
            continue
        t0 = time.time()
        try:
            if item.sql:
                diff = cmp.compare(spark, con, item, folder)
                note = "ok" if diff is None else "DIFF " + diff
            else:
                n = item.run(spark, folder).count()
                diff, note = None, f"rows only, {n}"
        except Exception as exc:  # noqa: BLE001
            diff = str(exc)
            note = "ERROR " + str(exc)[:900]
        failed += diff is not None
        print(f"{name:32s} {item.covers:14s} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
