"""Command line form of the oracle comparison: ``python tests/check.py DIR [name…]``."""

import sys
import time

sys.path[:0] = [".", "tests"]
from oracle import connect, difference  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from telltale.session import build_session  # noqa: E402

spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
sf, names = sys.argv[1], sys.argv[2:]
con, sql, bad = connect(sf), e.oracle_sql(), 0
for name, run in e.queries().items():
    if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
        continue
    start = time.time()
    try:
        if name in sql:
            out = difference(run(spark, sf), con, sql[name])
        else:
            out = "" if run(spark, sf).count() else "no rows"
    except Exception as error:  # report and go on
        out = f"{type(error).__name__}: {str(error)[:900]}"
    took = time.time() - start
    if out:
        bad += 1
    if out or took > 3 or names:
        print(f"{'FAIL' if out else 'ok'} {name} {took:.1f}s {out}", flush=True)
print(f"{bad} failing")
