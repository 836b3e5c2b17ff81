"""python tests/run_queries.py [name or prefix ...]: compare registered queries with their SQL."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import difference, duck  # noqa: E402
from vigilflow.session import local_session  # noqa: E402


def main() -> int:
    wanted = sys.argv[1:]
    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                diff = difference(df, con, oracle[name])
                note = "ok" if diff is None else "DIFF " + diff
            else:
                note = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = "ERROR " + str(e)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
