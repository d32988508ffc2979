"""Development aid: ``python tests/run_queries.py FOLDER [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference, duck_rows, spark_rows  # noqa: E402
from shellsieve.session import build_session  # noqa: E402

folder, names = sys.argv[1], sys.argv[2:]
queries, oracles = entry.queries(), entry.oracle_sql()
spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
con = connect(folder)
bad = 0
for name in names or queries:
    t = time.time()
    try:
        left = spark_rows(queries[name](spark, folder))
        took = time.time() - t
        t = time.time()
        verdict = difference(left, duck_rows(con, oracles[name])) if name in oracles else "(no SQL)"
        duck = time.time() - t
    except Exception as exc:
        took, duck, verdict = time.time() - t, 0, "ERROR " + str(exc)[:1500]
        if names:
            traceback.print_exc()
    ok = verdict in (None, "(no SQL)")
    bad += not ok
    print(f"{'ok  ' if ok else 'BAD '} {name:34s} {took:6.2f}s duck {duck:5.2f}s rows {len(left[1]) if ok else '-'} {verdict or ''}", flush=True)
print("bad:", bad)
