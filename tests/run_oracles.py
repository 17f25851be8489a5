"""Command line: compare registered queries with their SQL.

python tests/run_oracles.py [--sf 0.01] [name prefix ...]
"""
import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from slotwise.session import local_session  # noqa: E402

ap = argparse.ArgumentParser()
ap.add_argument("--sf", default="0.01")
ap.add_argument("names", nargs="*")
a = ap.parse_args()
sf_dir = f"/root/testdata/sf{a.sf}"
spark = local_session()
con = duck(sf_dir)
qs, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in qs.items():
    if a.names and not any(name.startswith(p) for p in a.names):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in sqls:
            diff = compare(df, con, sqls[name])
            note = "ok" if diff is None else diff
        else:
            n = len(df.collect())
            diff, note = (None, f"rows only: {n}") if n else ("no rows", "no rows")
    except Exception as e:  # noqa: BLE001
        diff = note = f"{type(e).__name__}: {str(e)[:400]}"
        if os.environ.get("TB"):
            traceback.print_exc()
    bad += diff is not None
    print(f"{'  ' if diff is None else 'X '}{name} {time.time() - t0:.1f}s {note}", flush=True)
print(f"{bad} of {len(qs)} differ")
